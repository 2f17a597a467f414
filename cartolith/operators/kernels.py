"""Graph kernels: bounded search, closure, strong components and ranks.

Bounded searches are plain joins, a level each. Unbounded ones run rounds until
nothing is new, each cut from its lineage. A graph of at most ``LOCAL_EDGES``
edges (counted first) may instead be walked in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.plans.lineage import cut, ship_package, small

from .rounds import grow, numbered_links

#: Edges up to which one task takes the whole graph: some tens of MB.
LOCAL_EDGES = 200_000


def levels(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Search from ``start(id)`` along ``edges(near, far, via, certainty)``: (depth, id, via, certainty).

    Each node comes at its first level with the least (near, via, certainty)
    that leads to it; the start itself is left out. Each level is computed once,
    since the next ones use it several times.
    """
    spark = edges.sparkSession
    seen = cut(start.select("id").distinct())
    frontier = seen
    out = None
    for d in range(1, depth + 1):
        steps = small(frontier).join(edges, F.col("id") == F.col("near")).groupBy("far").agg(F.min(F.struct("near", "via", "certainty")).alias("best"))
        new = cut(steps.select(F.col("far").alias("id"), "best.via", "best.certainty").join(seen, "id", "left_anti"))
        level = new.select(F.lit(d).alias("depth"), "id", "via", "certainty")
        out = level if out is None else out.unionByName(level)
        frontier = new.select("id")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return out if out is not None else spark.createDataFrame([], "depth int, id string, via string, certainty string")


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id): what ``start(id)`` reaches along ``edges(source, target)``, itself included."""
    edges = edges.select("source", "target")
    seen = cut(start.select("id").distinct())
    frontier = seen
    while not frontier.isEmpty():
        reached = small(frontier).join(edges, F.col("id") == F.col("source")).select(F.col("target").alias("id")).distinct()
        frontier = cut(reached.join(seen, "id", "left_anti"))
        seen = cut(seen.unionByName(frontier))
    return seen


def components_of(edges: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Each node's strong component, named by its least node; one pass without recursion."""
    after: dict[str, list[str]] = defaultdict(list)
    nodes: set[str] = set()
    for a, b in edges:
        after[a].append(b)
        nodes |= {a, b}
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    open_nodes: list[str] = []
    is_open: set[str] = set()
    name: dict[str, str] = {}
    for root in sorted(nodes):
        if root in number:
            continue
        work = [(root, iter(after[root]))]
        number[root] = low[root] = len(number)
        open_nodes.append(root)
        is_open.add(root)
        while work:
            node, rest = work[-1]
            child = next(rest, None)
            if child is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    members = []
                    while True:
                        members.append(open_nodes.pop())
                        is_open.discard(members[-1])
                        if members[-1] == node:
                            break
                    name |= dict.fromkeys(members, min(members))
            elif child not in number:
                number[child] = low[child] = len(number)
                open_nodes.append(child)
                is_open.add(child)
                work.append((child, iter(after[child])))
            elif child in is_open:
                low[node] = min(low[node], number[child])
    return name


def _trim(links: DataFrame, rounds: int = 3) -> DataFrame:
    """Drop ``links(a, b)`` from nodes that none enters and to nodes that none leaves; they are in no cycle."""
    for _ in range(rounds):
        links = links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        links = links.join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        links = cut(links.select("a", "b"))
    return links


def strong_components(edges: DataFrame) -> DataFrame:
    """(cycle, node): members of strong components of more than one node, or with a loop."""
    ship_package(edges.sparkSession)
    edges = cut(edges.select("source", "target").distinct())
    loops = edges.where("source = target").select(F.col("source").alias("cycle"), F.col("source").alias("node"))
    core = edges.where("source <> target")
    if core.count() <= LOCAL_EDGES:
        found = core.groupBy(F.lit(0).alias("all")).applyInPandas(_local_components, "cycle string, node string")
    else:
        found = _coloured_components(core)
    return found.unionByName(loops.join(found, "node", "left_anti").select("cycle", "node"))


def _local_components(pdf: pd.DataFrame) -> pd.DataFrame:
    name = components_of(zip(pdf["source"], pdf["target"], strict=True))
    size: dict[str, int] = defaultdict(int)
    for c in name.values():
        size[c] += 1
    rows = sorted((c, n) for n, c in name.items() if size[c] > 1)
    return pd.DataFrame(rows, columns=["cycle", "node"])


def _coloured_components(edges: DataFrame) -> DataFrame:
    """Forward colours (the least number that reaches a node), then backward within a colour, over and over.

    Nodes are numbers meanwhile. What is left of the links after a pass goes to
    one task once there are at most ``LOCAL_EDGES``.
    """
    numbers = cut(edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("n", F.monotonically_increasing_id()))
    links = _trim(numbered_links(edges, numbers))
    parts = []
    while count := links.count():
        if count <= LOCAL_EDGES:
            whole = links.select(F.col("a").alias("source"), F.col("b").alias("target")).groupBy(F.lit(0).alias("all"))
            parts.append(whole.applyInPandas(_local_components, "cycle long, node long"))
            break
        colours = grow(*_offers(links, links.select(F.explode(F.array("a", "b")).alias("n")).distinct().withColumn("label", F.col("n"))))
        ends = [colours.select(F.col("n").alias(end), F.col("label").alias(f"{end}_label")) for end in ("a", "b")]
        back = cut(links.join(ends[0], "a").join(ends[1], "b").where("a_label = b_label").select(F.col("b").alias("a"), F.col("a").alias("b")))
        marked = grow(*_offers(back, colours.select("n", F.when(F.col("n") == F.col("label"), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("label"))))
        members = cut(marked.where("label = 0").select("n").join(colours, "n").select(F.col("label").alias("cycle"), F.col("n").alias("node")))
        parts.append(members.join(members.groupBy("cycle").count().where("count > 1"), "cycle", "left_semi").select("cycle", "node"))
        links = links.join(members.select(F.col("node").alias("a")), "a", "left_anti")
        links = _trim(links.join(members.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"))
    if not parts:
        return edges.select(F.col("source").alias("cycle"), F.col("target").alias("node")).limit(0)
    found = reduce(DataFrame.unionByName, parts).join(numbers.select(F.col("n").alias("node"), "id"), "node")
    found = cut(found.select("cycle", "id"))
    least = found.groupBy("cycle").agg(F.min("id").alias("least"))
    return found.join(least, "cycle").select(F.col("least").alias("cycle"), F.col("id").alias("node"))


def _offers(links: DataFrame, state: DataFrame):
    """Arguments of :func:`grow` that carry the least ``label`` of ``state(n, label)`` along ``links(a, b)``."""
    return state, lambda grown: grown.join(links, F.col("n") == F.col("a")).select(F.col("b").alias("n"), "label"), F.min, "n", "label"


def ranks_of(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> dict[str, int]:
    """Longest path to each node over the components of a graph; members of a cycle share it."""
    nodes, edges = list(nodes), list(edges)
    name = {n: n for n in nodes} | components_of(edges)
    after: dict[str, set[str]] = defaultdict(set)
    waiting: dict[str, int] = defaultdict(int)
    for a, b in edges:
        if name[a] != name[b] and name[b] not in after[name[a]]:
            after[name[a]].add(name[b])
            waiting[name[b]] += 1
    rank = {c: 0 for c in set(name.values())}
    ready = [c for c in rank if not waiting[c]]
    while ready:
        c = ready.pop()
        for d in after[c]:
            rank[d] = max(rank[d], rank[c] + 1)
            waiting[d] -= 1
            if not waiting[d]:
                ready.append(d)
    return {n: rank[name[n]] for n in nodes}
