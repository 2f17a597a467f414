"""Callers, callees, impact, call flow, neighbourhoods and relations between classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.functions import names as N
from cartolith.plans.graph import Graph

from .entrypoints import entry_symbols
from .kernels import closure, levels

CLASS_RELATIONS = ("inherits", "implements", "composes", "aggregates", "associates")
#: Of several relations of a pair the strongest is shown.
STRENGTH = {"composes": 3, "aggregates": 2, "associates": 1}


def as_start(graph: Graph, *ids: str) -> DataFrame:
    return graph.spark.createDataFrame([(i,) for i in ids], "id string")


def _calls(graph: Graph, incoming: bool) -> DataFrame:
    near, far = ("target", "source") if incoming else ("source", "target")
    return graph.edges_of("calls").select(F.col(near).alias("near"), F.col(far).alias("far"), F.lit("calls").alias("via"), "certainty")


def callers(graph: Graph, start: DataFrame, depth: int = 1) -> DataFrame:
    """(depth, id, certainty) of what calls ``start(id)``, up to ``depth`` levels (one at least)."""
    return levels(_calls(graph, True), start, max(1, depth)).select("depth", "id", "certainty")


def callees(graph: Graph, start: DataFrame, depth: int = 1) -> DataFrame:
    """(depth, id, certainty) of what ``start(id)`` calls."""
    return levels(_calls(graph, False), start, max(1, depth)).select("depth", "id", "certainty")


def impact(graph: Graph, targets: DataFrame, depth: int = 3) -> DataFrame:
    """(depth, id, via, certainty, is_entrypoint) of what calls or imports ``targets(id)``."""
    reverse = graph.edges_of("calls", "imports").select(
        F.col("target").alias("near"), F.col("source").alias("far"), F.col("kind").alias("via"), "certainty"
    )
    found = levels(reverse, targets, depth)
    entries = entry_symbols(graph).withColumn("is_entrypoint", F.lit(True))
    return found.join(entries, "id", "left").select("depth", "id", "via", "certainty", F.coalesce("is_entrypoint", F.lit(False)).alias("is_entrypoint"))


def impact_targets(graph: Graph, focus: str) -> DataFrame:
    """(id): all nodes of the file ``focus``, or the symbols that it names."""
    in_file = graph.nodes.where(F.col("file") == focus).select("id")
    symbol = (F.col("id") == focus) | (F.col("qualname") == focus) | F.col("qualname").endswith(f".{focus}")
    return in_file if not in_file.isEmpty() else graph.nodes.where(symbol).select("id")


def reachable(graph: Graph, start: DataFrame, *kinds: str) -> DataFrame:
    """(id) of all that ``start(id)`` reaches along edges of some kinds."""
    return closure(graph.edges_of(*(kinds or ("calls",))), start)


def call_flow(graph: Graph, start: DataFrame, depth: int = 3) -> DataFrame:
    """(source, target, certainty): calls out of nodes less than ``depth`` steps ahead of ``start``, and into those behind."""
    out = None
    for incoming in (False, True):
        edges = _calls(graph, incoming)
        near = start.select("id").distinct()
        if depth > 1:
            near = near.unionByName(levels(edges, start, depth - 1).select("id"))
        side = "target" if incoming else "source"
        crossed = graph.edges_of("calls").join(near.withColumnRenamed("id", side), side, "left_semi").select("source", "target", "certainty")
        out = crossed if out is None else out.unionByName(crossed)
    if depth < 1:
        out = out.limit(0)
    return out.distinct()


def class_neighbourhood(graph: Graph, start: DataFrame, depth: int = 1) -> DataFrame:
    """(id): classes at most ``depth`` relations away, in either direction, itself included."""
    edges = graph.edges_of(*CLASS_RELATIONS)
    either = edges.select(F.col("source").alias("near"), F.col("target").alias("far")).union(edges.select("target", "source"))
    found = levels(either.select("near", "far", F.lit("").alias("via"), F.lit("").alias("certainty")).distinct(), start, depth).select("id")
    return found.unionByName(start.select("id")).distinct().join(graph.nodes_of("class", "interface", "enum").select("id"), "id", "left_semi")


def strongest_relations(graph: Graph) -> DataFrame:
    """(source, target, kind): the strongest holding relation of each pair of classes."""
    rank = F.create_map(*[x for k, v in STRENGTH.items() for x in (F.lit(k), F.lit(v))])
    rows = graph.edges_of(*STRENGTH).select("source", "target", "kind", F.element_at(rank, F.col("kind")).alias("strength"))
    return rows.groupBy("source", "target").agg(F.max_by("kind", "strength").alias("kind"))


def service_dependencies(graph: Graph) -> DataFrame:
    """(source, target, nature): links between subprojects, ``déclaré`` where a manifest names them."""
    declared = graph.subprojects.select(F.col("id").alias("source"), F.explode("declared_deps").alias("target"), F.lit("déclaré").alias("nature"))
    links = graph.edges_of("service_dep").select("source", "target")
    return links.join(declared.distinct(), ["source", "target"], "left").select("source", "target", F.coalesce("nature", F.lit("import")).alias("nature"))


def service_edges(nodes: DataFrame, subprojects: DataFrame) -> DataFrame:
    """(source, target): declared dependencies, and modules that import another subproject by its name."""
    declared = subprojects.select(F.col("id").alias("source"), F.explode("declared_deps").alias("target"))
    known = subprojects.select(F.col("id").alias("target"))
    imported = (
        nodes.where("kind = 'module'")
        .select(F.col("subproject").alias("source"), F.explode("modifiers").alias("m"))
        .where(F.col("m").startswith("ext-import:"))
        .select("source", F.regexp_replace("m", "^ext-import:", "").alias("name"))
    )
    named = subprojects.where("name <> ''").select("name", F.col("id").alias("target"))
    by_name = imported.join(named, "name").where("source <> target").select("source", "target")
    return declared.join(known, "target", "left_semi").select("source", "target").unionByName(by_name).distinct()


def relations_index(graph: Graph) -> DataFrame:
    """(id, direction, other, certainty) of each call of a symbol, seen from both ends."""
    calls = graph.edges_of("calls")
    back = calls.select(F.col("target").alias("id"), F.lit("caller").alias("direction"), F.col("source").alias("other"), "certainty")
    ahead = calls.select(F.col("source").alias("id"), F.lit("callee").alias("direction"), F.col("target").alias("other"), "certainty")
    return back.unionByName(ahead)


def relations_lists(graph: Graph) -> DataFrame:
    """(id, callers, callees) as sorted lists of (qualname, certain)."""
    item = F.struct(N.qualname(F.col("other")).alias("qualname"), (F.col("certainty") == "certain").alias("certain"))
    rows = relations_index(graph).groupBy("id").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("direction") == d, item))).alias(d + "s") for d in ("caller", "callee")]
    )
    return rows
