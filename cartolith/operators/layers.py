"""The layered layout of a graph too large for one task, by joins.

The same places as :func:`explorer.positions_of`, from tables: cycles are put together
(:func:`kernels.strong_components`); ranks are longest paths over what is left, a
join a round from the nodes whose rank has just grown; a sweep goes over the
ranks in order, and each takes the mean row of its neighbours by one join and
one sort by ranges, which numbers its nodes anew. So there are as many rounds
as the longest path has nodes, and ``SWEEPS`` sorts a rank; no task sees more than
``rounds.TASK_ROWS`` of them at once. Nodes are numbers, in the order of their names, and
each round writes one table of them, whose plan does not grow with the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.plans.lineage import cut

from . import rounds
from .kernels import strong_components

#: Gaps of the layout, and its sweeps.
X_GAP, Y_GAP, SWEEPS = 240, 96, 4


def longest_path_ranks(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, rank) of ``nodes(id)``: the longest path over ``links(source, target)`` to each; members of a cycle share it."""
    cycles = strong_components(links).select(F.col("node").alias("id"), "cycle")
    part = cut(nodes.join(cycles, "id", "left").select("id", F.coalesce("cycle", "id").alias("part")))
    numbers = cut(part.select(F.col("part").alias("id")).distinct().withColumn("n", F.monotonically_increasing_id()))
    ends = [part.select(F.col("id").alias(n), F.col("part").alias(f"{n}_part")) for n in ("source", "target")]
    steps = links.join(ends[0], "source").join(ends[1], "target").where("source_part <> target_part")
    steps = rounds.numbered_links(steps.select(F.col("source_part").alias("source"), F.col("target_part").alias("target")).distinct(), numbers)
    ahead = lambda grown: grown.join(steps, F.col("n") == F.col("a")).select(F.col("b").alias("n"), (F.col("rank") + 1).alias("rank"))
    rank = rounds.grow(numbers.select("n", F.lit(0).cast("long").alias("rank")), ahead, F.max, "n", "rank")
    named = numbers.join(rank, "n").select(F.col("id").alias("part"), "rank")
    return part.join(named, "part").select("id", "rank")


def layered_positions(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, x, y) of ``nodes(id)`` with ``links(source, target)`` between them."""
    links = cut(links.where("source <> target").select("source", "target").distinct())
    ranked = cut(longest_path_ranks(nodes.select("id").distinct(), links))
    sizes = {r["rank"]: r["count"] for r in ranked.groupBy("rank").count().orderBy("rank").collect()}  # a row a rank
    count = sum(sizes.values())
    numbers = cut(rounds.placed(ranked, count, "id", place="n"))
    pairs = rounds.numbered_links(links, numbers)
    both = pairs.select(F.col("a").alias("n"), F.col("b").alias("there")).unionByName(pairs.select(F.col("b").alias("n"), F.col("a").alias("there")))
    near = cut(both.join(numbers.select("n", "rank"), "n").select("n", "there", "rank"))
    starts, before = [], 0
    for r, size in sizes.items():
        starts.append((r, before, size))
        before += size
    by_rank = F.broadcast(nodes.sparkSession.createDataFrame(starts, "rank long, start long, size long"))
    ordered = rounds.placed(numbers.select("n", "rank"), count, "rank", "n")
    tasks = max(1, -(-count // rounds.TASK_ROWS))
    places = cut(ordered.join(by_rank, "rank").select("n", "rank", (F.col("row") - F.col("start")).cast("double").alias("row")))
    for _ in range(SWEEPS):
        for r, size in sizes.items():
            there = places.select(F.col("n").alias("there"), F.col("row").alias("beside"))
            mean = near.where(F.col("rank") == r).join(there, "there").groupBy("n").agg((F.sum("beside") / F.count("*")).alias("mean"))
            moved = places.where(F.col("rank") == r).join(mean, "n", "left").select("n", "rank", F.coalesce("mean", "row").alias("mean"))
            new = rounds.placed(moved, size, "mean", "n").select("n", "rank", F.col("row").cast("double").alias("row"))
            places = cut(places.where(F.col("rank") != r).unionByName(new).coalesce(tasks))
    place = [(F.col("rank") * X_GAP).alias("x"), F.rint((F.col("row") - (F.col("size") - 1) / 2) * Y_GAP).cast("long").alias("y")]
    return places.join(by_rank, "rank").join(numbers.select("id", "n"), "n").select("id", *place)
