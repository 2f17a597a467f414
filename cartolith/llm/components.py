"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut


def _signature(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"), F.sum((F.xxhash64("a", "b") % 1_000_000_007).cast("long")).alias("h")
    ).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs to ``(node, root)``: the smallest node of each one's component.

    Nodes without a link to another node are left out. Each round hangs larger
    neighbours on the smallest one (large star), then smaller ones (small
    star), until nothing changes; it needs rounds in the logarithm of the
    number of nodes. No neighbour list is gathered in one place: each round is
    two grouped minima and two joins, and ends in a checkpoint.
    """
    edges = cut(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
    )
    before = _signature(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(least, "a")
            .where((F.col("b") > F.col("a")) & (F.col("b") != F.col("m")))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .where(F.col("b") != F.col("m"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        edges = cut(small)
        after = _signature(edges)
        if after == before:
            break
        before = after
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
