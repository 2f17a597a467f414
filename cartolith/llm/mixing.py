"""Mixing sources to target weights by the cube method.

Sources in order of code points, null last, have weights 5, 2, 1, repeating,
and share ``TOTAL_SHARE`` of all sizes (words). No target exceeds ``CAP`` times
its source's size; the excess goes to the others by weight. That is the level
``t`` with ``sum(min(cap * size, weight * t))`` equal to the total, found from
running sums over ranges of sources, of which only totals meet in one place.

A source with target over size ``r`` takes each document ``floor(r)`` times and
once more with probability ``r - floor(r)``. The cube method draws these last
copies: it moves the probabilities along the null space of the balancing
equations (words and documents of the source stay equal) until they are 0 or 1.
Each source is dealt into blocks by hash; a block's walk holds three undecided
documents at a time and leaves at most two, which meet in the next, smaller
round, until one block a source is left, where :func:`settle` lands the last:
what is left of the probabilities is written as a mixture of choices, those
nearest in words first, and one is drawn, so that each document keeps its
inclusion probability to the end.

Defined cases: a null or empty text has size 0 and is never taken. A null
source is a source of its own. Rows repeat as they do in the input; those of
equal id, text and source are numbered, so that they are spread over blocks. An empty
table gives an empty result. If all sizes are 0, targets are 0. The draws
depend on ids, texts and the seed alone. Only the id, text and source columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, free_names, map_stream

WEIGHTS = (5, 2, 1)
TOTAL_SHARE, CAP = 1.5, 2.0
#: Expected documents of a block.
BLOCK = 4096
#: Documents that the last walk of a source leaves out, for the landing.
LANDING = 12
SEED = 11
WORD = r"[^\x20\x09-\x0D]+"
_NEAR = 1e-9


def running(df: DataFrame, order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with running sums over the rows before, by ``order``; ``sums`` names them, and the columns added up.

    Rows are dealt into ranges; what the ranges add up to (one row a range)
    meets on the driver, and each range begins from there.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy("__range").agg(*[F.sum(c).alias(n) for n, c in sums.items()]).orderBy("__range").collect()
    before, rows = dict.fromkeys(sums, 0.0), []
    for t in totals:
        rows.append((t["__range"], *(float(x) for x in before.values())))
        before = {n: v + t[n] for n, v in before.items()}
    schema = "__range int, " + ", ".join(f"`__from_{n}` double" for n in sums)
    offsets = df.sparkSession.createDataFrame(rows, schema)
    own = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.join(F.broadcast(offsets), "__range")
    for n, c in sums.items():
        found = found.withColumn(n, F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"__from_{n}"))
    return found.drop("__range", *[f"__from_{n}" for n in sums])


def targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = TOTAL_SHARE, cap: float = CAP
) -> DataFrame:
    """(source, source_size, docs, rank, target) from (source, source_size, docs), a row for each source."""
    named = sizes.select("*", F.col("source").isNull().alias("last"), F.lit(1).alias("one"))
    ranked = running(named, ["last", "source"], {"rank": "one"}).withColumn("rank", F.col("rank").cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int") + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("limit", cap * F.col("source_size")).withColumn("full", F.col("limit") / F.col("weight"))
    # sources in the order in which a rising level fills them: what is filled, and what is open from here on
    levels = cut(running(ranked, ["full", "rank"], {"filled": "limit", "closed": "weight"}))
    every = levels.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, open_ = share * (every["size"] or 0), F.lit(every["weight"] or 0.0) - F.col("closed")
    # the level at the first source that it does not fill; all are full if there is none
    level = (F.lit(total) - F.col("filled")) / open_
    t = levels.withColumn("level", level).where("level <= full").agg(F.min(F.struct("full", "rank", "level")).alias("t")).first()["t"]
    target = F.col("limit") if t is None else F.least("limit", F.col("weight") * F.lit(t["level"]))
    return levels.select("source", "source_size", "docs", "rank", target.cast("double").alias("target"))


def _draw(*key: object) -> float:
    return xxhash.xxh64_intdigest(repr(key), SEED) / 2**64


class Walk:
    """The cube method's flight over a stream of units (key, size, probability)."""

    def __init__(self, seed: tuple) -> None:
        self.seed, self.step = seed, 0
        self.live: list[list] = []  # [key, size, probability], at most three

    def add(self, key: object, size: float, p: float) -> Iterator[tuple[object, int]]:
        """Take in a unit; yield those that are decided."""
        self.live.append([key, size, p])
        if len(self.live) == 3:
            yield from self._move(self._direction([1.0, 1.0, 1.0], [u[1] for u in self.live]))

    @staticmethod
    def _direction(ones: list[float], sizes: list[float]) -> list[float]:
        """A vector of the null space: the cross product of the equations, or any where sizes agree."""
        a, b, c = sizes
        u = [c - b, a - c, b - a]
        return u if any(u) else [1.0, -1.0, 0.0]

    def _move(self, u: list[float]) -> Iterator[tuple[object, int]]:
        p = [x[2] for x in self.live]
        forth = min(((1 - q) / v if v > 0 else -q / v) for q, v in zip(p, u, strict=True) if v)
        back = min((q / v if v > 0 else (q - 1) / v) for q, v in zip(p, u, strict=True) if v)
        self.step += 1
        by = forth if _draw(*self.seed, self.step) < back / (forth + back) else -back
        for x, v in zip(self.live, u, strict=True):
            x[2] += by * v
        kept = []
        for x in self.live:
            if x[2] < _NEAR or x[2] > 1 - _NEAR:
                yield x[0], int(x[2] > 0.5)
            else:
                kept.append(x)
        self.live = kept


def land(size: np.ndarray, p: np.ndarray, u: float) -> np.ndarray:
    """A choice of units, drawn by ``u``, that has each with its probability ``p``.

    The probabilities are a mixture of choices. Of all choices that agree with
    what is left, that whose words (then whose documents) differ least from what
    is expected gets as much of the mixture as the units bear; then one unit at
    least is decided, so that there are at most as many choices as units, and one.
    """
    choices = ((np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1).astype(bool)
    choices = choices[np.lexsort((np.abs(choices.sum(axis=1) - p.sum()), np.abs(choices @ size - size @ p)))]
    left = p.copy()
    while True:
        out, in_ = left < _NEAR, left > 1 - _NEAR
        choices = choices[~choices[:, out].any(axis=1) & choices[:, in_].all(axis=1)]
        open_ = ~(out | in_)
        if not open_.any():
            return choices[0]
        most = float(np.where(choices[0], left, 1 - left)[open_].min())
        if u < most:
            return choices[0]
        u = (u - most) / (1 - most)
        left = np.clip((left - most * choices[0]) / (1 - most), 0.0, 1.0)


def settle(units: list[tuple[object, float, float]], seed: tuple) -> list[tuple[object, int]]:
    """Decide a small block wholly: walk, then land.

    The walk leaves out ``LANDING`` units spread over the sizes. These and the
    two that it cannot decide :func:`land` together.
    """
    units = sorted(units, key=lambda u: (u[1], u[2], str(u[0])))
    spread = {len(units) * (2 * i + 1) // (2 * LANDING) for i in range(LANDING)} if units else set()
    walk, out = Walk(seed), []
    for i, u in enumerate(units):
        if i not in spread:
            out += walk.add(*u)
    rest = [*walk.live, *([*units[i]] for i in sorted(spread))]
    best = land(np.array([u[1] for u in rest], float), np.array([u[2] for u in rest]), _draw(*seed, "land"))
    return out + [(u[0], int(t)) for u, t in zip(rest, best, strict=True)]


def _flight(units: DataFrame, last: bool, round_no: int) -> DataFrame:
    """Walk each (rank, block) of ``units``; decided ones have ``more`` 0 or 1, others null and a new ``p``."""
    columns = ["rank", "block", "id", "mark", "number", "size", "p"]
    dealt = units.repartition("rank", "block").sortWithinPartitions(*columns)

    def make():
        def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
            group, walk, place = None, None, 0
            out: list[tuple] = []
            held: dict[int, tuple] = {}
            block_units: list[tuple] = []  # of the last round, in which a source has one small block

            def decide(pairs) -> None:
                for k, more in pairs:
                    out.append((*held.pop(k), 0.0, more))

            def finish() -> None:
                if walk is None:
                    return
                if last:
                    decide(settle(block_units, (round_no, *group)))
                    block_units.clear()
                for k, _, p in walk.live:
                    out.append((*held.pop(k), p, None))
                walk.live = []

            def flush() -> dict[str, list]:
                cols = list(zip(*out, strict=True)) if out else [()] * 7
                out.clear()
                return dict(zip(("rank", "id", "mark", "number", "size", "p", "more"), map(list, cols), strict=True))

            for c in batches:
                for rank, block, key, mark, number, size, p in zip(*(c[n] for n in columns), strict=True):
                    if (rank, block) != group:
                        finish()
                        group, place = (rank, block), 0
                        walk = Walk((round_no, rank, block))
                    place += 1
                    if p < _NEAR or p > 1 - _NEAR:
                        out.append((rank, key, mark, number, size, 0.0, int(p > 0.5)))
                        continue
                    held[place] = (rank, key, mark, number, size)
                    if last:
                        block_units.append((place, float(size), p))
                    else:
                        decide(walk.add(place, float(size), p))
                yield flush()
            finish()
            yield flush()

        return run

    return map_stream(dealt.select(*columns), make, "rank int, id long, mark long, number long, size long, p double, more int")


def _deal(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks by hash of id, text and number, as many as ``blocks`` (rank, blocks) says."""
    place = F.pmod(F.xxhash64("id", "mark", "number", F.lit(SEED)), F.col("blocks")).cast("int")
    return units.join(blocks, "rank").withColumn("block", place).drop("blocks")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, mark, size, source): mark is a hash of the text, that tells apart rows of one id."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(
        docs[id_col].cast("long").alias("id"),
        F.xxhash64(text).alias("mark"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        docs[source_col].cast("string").alias("source"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = TOTAL_SHARE,
    cap: float = CAP,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, mark, size, source, source_size, target, copies, taken) for each row of ``docs``."""
    counted = cut(sized(docs, id_col, text_col, source_col).groupBy("id", "mark", "size", "source").agg(F.count("*").alias("rows")))
    rows = counted.withColumn("number", F.explode(F.sequence(F.lit(1), F.col("rows").cast("long")))).drop("rows")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    plan = cut(targets(sums, weights, share, cap))
    named = plan.withColumn("name", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))).drop("source", "docs")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (
        rows.withColumn("name", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
        .join(named, "name")
        .withColumn("whole", F.least(F.floor(ratio + _NEAR), F.lit(int(cap))))
        .withColumn("p", F.when(F.col("size") > 0, F.greatest(ratio - F.col("whole"), F.lit(0.0))).otherwise(0.0))
        .select("rank", "id", "mark", "number", "size", "p")
    )
    done = None
    round_no = 0
    left = plan.select("rank", "docs")
    while True:
        blocks = left.select("rank", F.ceil(F.col("docs") / block).cast("int").alias("blocks"))
        last = not blocks.where("blocks > 1").limit(1).count()
        walked = _flight(_deal(units, blocks), last, round_no)
        if last:
            done = walked if done is None else done.unionByName(walked)
            break
        walked = cut(walked)
        decided = walked.where("more is not null")
        done = decided if done is None else done.unionByName(decided)
        units = walked.where("more is null").select("rank", "id", "mark", "number", "size", "p")
        left = units.groupBy("rank").agg(F.count("*").alias("docs"))
        round_no += 1
    info = plan.withColumn("whole", F.least(F.floor(ratio + _NEAR), F.lit(int(cap)))).drop("docs")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(0)
    return (
        done.join(info, "rank")
        .withColumn("copies", copies.cast("int"))
        .select(
            F.col("id").alias("doc_id"), "mark", "size", "source", "source_size", "target", "copies",
            (F.col("size") * F.col("copies")).cast("long").alias("taken"),
        )
    )


def repeat_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows of equal id and text share the sum of their copies, dealt evenly.
    """
    per_row = cut(mixed.groupBy("doc_id", "mark").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")))
    own_id, own_mark, copies, repeats, mark, copy = free_names(docs, "own_id", "own_mark", "copies", "repeats", "mark", "copy")
    wanted = per_row.where("copies > 0").select(
        F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark), F.col("copies").alias(copies), F.col("rows").alias(repeats)
    )
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    one = marked.join(wanted, marked[id_col].cast("long").eqNullSafe(wanted[own_id]) & (marked[mark] == wanted[own_mark]))
    if per_row.where("rows > 1 and copies > 0").isEmpty():
        rows = one
    else:  # rows that repeat: one of them stands for all
        again = one.where(F.col(repeats) > 1).dropDuplicates([own_id, own_mark])
        rows = one.where(F.col(repeats) == 1).unionByName(again)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
