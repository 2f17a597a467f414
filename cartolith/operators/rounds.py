"""Small steps that the rounds of graph kernels share: numbers for names, and places in an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.plans.lineage import cut

#: Rows of a table of numbers that one task sorts.
TASK_ROWS = 100_000


def placed(rows: DataFrame, count: int, *order: str, place: str = "row") -> DataFrame:
    """``rows`` with the place of each in ``order``, from 0: ``count`` rows, dealt by ranges of at most some ``TASK_ROWS``.

    Each task numbers its own range; a row a range, the ranges' sizes, comes to the driver.
    Up to ``TASK_ROWS`` rows are one range, and nothing is computed here.
    """
    at, tasks = f"_{place}", -(-count // TASK_ROWS)
    if tasks <= 1:
        return rows.coalesce(1).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    dealt = cut(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    task = F.shiftright(at, 33).cast("int")
    sizes = {r["task"]: r["count"] for r in dealt.groupBy(task.alias("task")).count().collect()}
    before = [sum(sizes.get(i, 0) for i in range(k)) for k in range(tasks)]
    return dealt.withColumn(place, F.element_at(F.lit(before).cast("array<bigint>"), task + 1) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at)


def numbered_links(links: DataFrame, numbers: DataFrame) -> DataFrame:
    """(a, b): ``links(source, target)`` by ``numbers(id, n)`` of their ends, computed once."""
    source, target = (numbers.select(F.col("id").alias(end), F.col("n").alias(n)) for end, n in (("source", "a"), ("target", "b")))
    return cut(links.join(source, "source").join(target, "target").select("a", "b"))


def grow(state: DataFrame, reached, merge, key: str, value: str) -> DataFrame:
    """``state(key, value)`` after rounds in which ``reached(grown)`` offers (key, value) and ``merge`` keeps one of each key.

    Only rows that changed in a round offer anything in the next; each round is
    computed once. Keys that are offered but not there are left out.
    """
    state = cut(state.select(key, value, F.lit(True).alias("grown")))
    while True:
        offered = reached(state.where("grown").select(key, value)).select(key, value, F.lit(None).cast("long").alias("own"))
        both = state.select(key, value, F.col(value).alias("own")).unionByName(offered).groupBy(key).agg(merge(value).alias(value), F.max("own").alias("own"))
        state = cut(both.where("own is not null").select(key, value, (F.col(value) != F.col("own")).alias("grown")))
        if state.where("grown").isEmpty():
            return state.select(key, value)
