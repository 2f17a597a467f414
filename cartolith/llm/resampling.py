"""Importance resampling towards a target text, on hashed word features.

Features are all runs of one and two consecutive words; a feature's bucket is
its CRC-32 modulo ``BUCKETS``. The CRC of two words continues that of the first,
so no pair is put together. The first pass gives one vector of bucket counts a
partition (``np.bincount``), which a tree of reductions adds up. The logarithmic
gain of each bucket, target over raw text, is broadcast: ``BUCKETS`` numbers,
whatever the input. The second pass gathers the gains and sums them by document
(``np.bincount`` with weights). A document's score is the floored mean of its
gains plus Gumbel noise that its id and the seed alone decide; the highest
scores are drawn. Ranks are running counts over ranges of scores, so that no
task sees all rows.

Defined cases: a null or empty text has no words, no features and weight 0. A
null id draws its noise from the empty string and comes last among ties. Rows
repeat as they do in the input, each with a rank of its own. An empty table
gives an empty result; an empty target gives every bucket its gain all the same.
Texts of any length are read whole, some megabytes at a time. Only the id and
text columns are read, whatever other columns are called.
"""

from __future__ import annotations

import math
from itertools import repeat
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import running
from .runtime import cut, map_batches, map_stream
from .words import byte_table, pieces

BUCKETS = 10_000
SEED, MIN_WORDS, PERCENT = 7, 20, 25
_TABLE = byte_table(digits=True)


def features(text: bytes | None) -> tuple[int, list[np.ndarray]]:
    """The number of words and the buckets of all features of a text."""
    n, found, last = 0, [], None
    for words in pieces(text, _TABLE):
        one = list(map(crc32, words))
        spaced = list(map(crc32, repeat(b" "), one))
        two = map(crc32, words[1:], spaced)
        found += [np.array(one, np.uint32), np.fromiter(two, np.uint32, len(words) - 1)]
        if last is not None:
            found.append(np.array([crc32(words[0], last)], np.uint32))
        n, last = n + len(words), spaced[-1]
    return n, [(x % np.uint32(BUCKETS)).astype(np.int64) for x in found]


def bucket_counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts are in each bucket."""

    def make():
        def run(batches):
            total = np.zeros(BUCKETS, np.int64)
            for batch in batches:
                for text in batch["text"]:
                    for part in features(text)[1]:
                        total += np.bincount(part, minlength=BUCKETS)
            yield {"counts": [total.tobytes()]}

        return run

    vectors = map_stream(df.select(df[text_col].cast("string").cast("binary").alias("text")), make, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(BUCKETS, np.int64)
    return vectors.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(np.add)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of each bucket, rounded down."""
    s_all, t_all = float(raw.sum()), float(target.sum())
    ratio = [(t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS)) for s, t in zip(raw.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(h: int) -> int:
    """Gumbel noise in thousandths from an unsigned 32-bit number."""
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain.astype(np.float64))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit("")))
    narrow = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long").alias("h"),
        docs[text_col].cast("string").cast("binary").alias("text"),
    )

    def make():
        own = shared.value

        def step(c: dict[str, list]) -> dict[str, list]:
            rows, words, count, total = len(c["text"]), [], np.zeros(len(c["text"]), np.int64), np.zeros(len(c["text"]))
            held, at, size = [], [], 0

            def add() -> None:
                nonlocal held, at, size, count, total
                doc = np.repeat([i for i, _ in at], [k for _, k in at])
                count = count + np.bincount(doc, minlength=rows)
                total = total + np.bincount(doc, weights=own[np.concatenate(held)], minlength=rows)
                held, at, size = [], [], 0

            for i, text in enumerate(c["text"]):
                n, found = features(text)
                words.append(n)
                held += found
                at += [(i, len(x)) for x in found]
                size += 2 * n
                if size > 1 << 20:
                    add()
            if held:
                add()
            weight = [int(t) // n if n else 0 for t, n in zip(total.tolist(), count.tolist(), strict=True)]
            score = [w + noise(h) for w, h in zip(weight, c["h"], strict=True)]
            return {"doc_id": c["doc_id"], "n_words": words, "n_features": count.tolist(), "weight": weight, "score": score}

        return step

    return map_batches(narrow, make, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row; ``rank`` is null for those not drawn.

    Of the documents with ``min_words`` words or more, ``percent`` of a hundred are
    drawn (rounded down), highest scores first, ties by smaller id.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    rows = cut(scored(docs, gain, seed, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= min_words
    drawn = percent * rows.where(able).count() // 100
    order = ["down", "no_id", "doc_id", "n_features", "row"]
    named = rows.where(able).select("*", (-F.col("score")).alias("down"), F.col("doc_id").isNull().alias("no_id"), F.lit(1).alias("one"))
    ranked = running(named, order, {"before": "one"}).withColumn("rank", F.col("before").cast("long") + 1)
    out = ["doc_id", "n_features", "weight", "score"]
    first = ranked.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return first.unionByName(rows.where(~able).select(*out, F.lit(None).cast("long").alias("rank")))


#: ``crc`` folds the bytes of a feature, as hexadecimal digits, into the table of the reflected polynomial 0xEDB88320.
ORACLE_SQL = """
WITH table_of AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
        FROM (SELECT unnest(range(256))::BIGINT AS i))),
texts AS (
    SELECT row_number() OVER () AS row, doc_id, text, FALSE AS target FROM documents
    UNION ALL SELECT row_number() OVER (), NULL, text, TRUE FROM benchmark),
words AS (
    SELECT row, doc_id, target, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM texts),
grams AS (
    SELECT row, target, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
counted AS (SELECT row, target, f, count(*) AS n FROM grams GROUP BY ALL),
hexed AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM counted)),
bytes AS (
    SELECT f, list_transform(range(1, len(x), 2), lambda i:
        16 * (strpos('0123456789ABCDEF', x[i]) - 1) + strpos('0123456789ABCDEF', x[i + 1]) - 1) AS b FROM hexed),
bucketed AS (
    SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x:
        xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket
    FROM bytes, table_of),
placed AS (SELECT row, target, bucket, sum(n)::BIGINT AS n FROM counted JOIN bucketed USING (f) GROUP BY ALL),
sides AS (
    SELECT bucket, coalesce(sum(n) FILTER (NOT target), 0)::BIGINT AS s, coalesce(sum(n) FILTER (target), 0)::BIGINT AS t
    FROM placed GROUP BY bucket),
totals AS (SELECT sum(s)::BIGINT AS sa, sum(t)::BIGINT AS ta FROM sides),
gain AS (
    SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (sa + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (ta + 10000.0::DOUBLE))))::BIGINT AS g
    FROM sides, totals),
weighed AS (
    SELECT row, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS total FROM placed JOIN gain USING (bucket) WHERE NOT target GROUP BY row),
scores AS (
    SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features,
        coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
        ('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
    FROM words LEFT JOIN weighed USING (row) WHERE NOT target),
final AS (
    SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scores),
ranked AS (
    SELECT *, CASE WHEN able THEN row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) END AS r,
        25 * count(*) FILTER (able) OVER () // 100 AS drawn
    FROM final)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= drawn THEN r END AS rank FROM ranked
"""
