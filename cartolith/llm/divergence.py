"""How far the sources of a language lie apart, by the terms that they use.

A term belongs to a language if ``MIN_DOCS`` of its documents have it. Every group
(language, source), and the language itself, gives each of its terms a share
``p = 1 + floor(SCALE * (count + 1) / (N + V))``, and a term by which a group p departs
from another q has the value ``floor((p - q)^2 / q)``. All arithmetic is on whole numbers.

Counting: tasks count the words of their documents by term, and send a row for
each (language, term); the rows are dealt by (language, block of terms), where a
block makes the counts of its terms into one compressed vector a group. No term's
rows or group's vector meet whole in one place: a group is a vector in each block.

Comparing: systolic rotation. The groups of a language sit on a ring of at most
``SEATS`` seats, in every block. They stay resident (persisted by block and seat),
while copies of their compressed vectors circulate: in round r each has moved r
seats on and meets who sits there. A meeting gives both directions of a pair.
After half a turn each two seats have met once; groups that share a seat meet in
round 0. So the number of rounds is bounded, and each moves every vector once; ``WAVE``
rounds run at a time. The values of the blocks add up.

Terms: the blocks rank the terms of each group against the language by local
heaps of ``TOP``, which alone meet in the last ranking.

Defined cases: null texts, languages and sources are the empty string. A group
without terms, or of a language without any, still has its pairs, of value 0 if
the language has no terms. Ties rank by the bytes of the item. Repeated rows count as documents of their
own. An empty table gives an empty result. Texts of any length are read whole,
some megabytes at a time. Only the text, language and source columns are read.
The list of groups is gathered on the driver: the result has a row for each two of
them, so that it is small beside the result. The folder ``divergence-*`` in the
shared folder holds the vectors until it is deleted.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, map_arrays, map_stream, stored
from .words import byte_table

MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Seats of a language's ring, at most; twice the rounds.
SEATS = 64
#: Rounds that are on the way at once; then their meetings are written.
WAVE = 8
#: Bytes of text whose words a task counts at once.
HELD = 8 << 20
_TABLE = byte_table(digits=False)
#: Vectors of a batch.
_VECTORS = 64
_SPACE = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def share(count: np.ndarray, n: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (n + terms)) in whole numbers, three digits of SCALE at a time."""
    rest, whole, below = count.astype(np.int64) + 1, np.zeros(len(count), np.int64), n + terms
    for _ in range(3):
        rest *= 1000
        whole = whole * 1000 + rest // below
        rest %= below
    return whole + 1


def value(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _groups(docs: DataFrame) -> list[tuple[str, str]]:
    found = docs.select("lang", "source").distinct().collect()
    return sorted((r["lang"], r["source"]) for r in found)


def _spans(groups: list[tuple[str, str]]) -> dict[str, range]:
    """The places of each language's groups."""
    spans: dict[str, range] = {}
    for i, (lang, _) in enumerate(groups):
        spans[lang] = range(spans[lang].start if lang in spans else i, i + 1)
    return spans


def _words(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of some bytes, and where they start."""
    plain = np.frombuffer(data.translate(_TABLE), np.uint8)
    inside = plain != 32
    edge = np.concatenate([[False], inside, [False]])
    edge = np.flatnonzero(edge[1:] != edge[:-1])
    start, end = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(plain[inside])]), start


def _counted(texts: list[bytes], places: list[int], lang_of: np.ndarray, whole: bool = True) -> dict[str, object]:
    """Rows of :func:`term_counts` of some texts; parts of a text count no document."""
    words, start = _words(b" ".join(texts))
    coded = words.dictionary_encode()
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    place = np.array(places, np.int64)
    key = coded.indices.to_numpy().astype(np.int64) << 38 | place[doc] << 18 | doc
    key.sort()
    fresh = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    pair = key >> 18
    at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])[: len(key)])
    n = np.diff(np.append(at, len(key)))
    docs = np.add.reduceat(fresh.astype(np.int64), at) if len(at) else n
    term, place = pair[at] >> 20, pair[at] & (1 << 20) - 1
    lang = lang_of[place]
    row = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])])[: len(term)])
    offsets = pa.array(np.append(row, len(term)), pa.int32())
    have = np.add.reduceat(docs, row) if len(row) else docs
    return {
        "lang": lang[row], "term": coded.dictionary.take(pa.array(term[row])).cast(pa.string()), "docs": have if whole else 0 * have,
        "places": pa.ListArray.from_arrays(offsets, pa.array(place, pa.int32())), "counts": pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64())),
    }


def _lang_of(groups: list[tuple[str, str]]) -> np.ndarray:
    """The number of each group's language, in the order of :func:`_spans`."""
    return np.repeat(np.arange(len(_spans(groups))), [len(s) for s in _spans(groups).values()])


def term_counts(docs: DataFrame, groups: list[tuple[str, str]]) -> DataFrame:
    """(lang, term, docs, places, counts) of texts: what each task found of a term, by the groups at ``places``; lang is a number."""
    shared = docs.sparkSession.sparkContext.broadcast(({g: i for i, g in enumerate(groups)}, _lang_of(groups)))

    def make():
        place, lang_of = shared.value

        def long(text: bytes, where: int) -> Iterator[dict[str, object]]:
            """A text beyond ``HELD``, cut between words; its terms count a document once."""
            seen, at = None, 0
            while at < len(text):
                end = _SPACE.search(text, at + HELD)
                part = text[at : end.start() if end else len(text)]
                out = _counted([part], [where], lang_of, False)
                yield out
                seen = out["term"] if seen is None else pa.chunked_array([seen, out["term"]]).unique()
                at += max(1, len(part))
            none = pa.ListArray.from_arrays(pa.array([0] * (len(seen) + 1), pa.int32()), pa.array([], pa.int32()))
            one = np.ones(len(seen), np.int64)
            yield {"lang": one * lang_of[where], "term": seen, "docs": one, "places": none, "counts": none.cast(pa.list_(pa.int64()))}

        def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, object]]:
            texts: list[bytes] = []
            places: list[int] = []
            size = 0
            for b in batches:
                for lang, source, text in zip(*(b[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                    if not text:
                        continue
                    if len(text) > HELD:
                        yield from long(text, place[lang, source])
                        continue
                    texts.append(text)
                    places.append(place[lang, source])
                    size += len(text)
                    if size >= HELD or len(texts) == 1 << 18:
                        yield _counted(texts, places, lang_of)
                        texts, places, size = [], [], 0
            if texts:
                yield _counted(texts, places, lang_of)

        return run

    return map_arrays(docs, make, "lang int, term string, docs long, places array<int>, counts array<long>")


def _packed(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.astype(np.int64 if len(numbers) and numbers.max() >= 1 << 31 else np.int32).tobytes(), 1)


def _unpacked(data: bytes, terms: int) -> np.ndarray:
    plain = zlib.decompress(data)
    return np.frombuffer(plain, np.int64 if len(plain) > 4 * terms else np.int32).astype(np.int64)


def vectors(counts: DataFrame, groups: list[tuple[str, str]], min_docs: int = MIN_DOCS, seats: int = SEATS) -> DataFrame:
    """(lang, block, place, seat, seats, terms, total, counts, names): a compressed vector of each group in each block of terms.

    ``seat`` is the group's on its language's ring of ``seats``. The language's own
    vector has place -1, and the terms' ``names``, in the order of their bytes.
    """
    blocks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    dealt = dealt.repartition(blocks, "lang", "block").sortWithinPartitions("lang", "block", "term")
    shared = counts.sparkSession.sparkContext.broadcast(list(_spans(groups).values()))
    names = ("lang", "block", "place", "seat", "seats", "terms", "total", "counts", "names")

    def make():
        spans = shared.value

        def block(lang: int, number: int, held: list[dict[str, pa.Array]]) -> Iterator[dict[str, list]]:
            term, docs, places, counts = (pa.chunked_array([h[c] for h in held]).combine_chunks() for c in ("term", "docs", "places", "counts"))
            coded = term.dictionary_encode()
            own = coded.indices.to_numpy()
            kept = np.bincount(own, weights=docs.to_numpy()) >= min_docs
            n = int(kept.sum())
            if not n:
                return
            which = np.repeat(own, np.diff(places.offsets.to_numpy()))
            place, size = places.flatten().to_numpy(), counts.flatten().to_numpy()
            some = kept[which]
            at, place, size = (np.cumsum(kept) - 1)[which[some]], place[some], size[some]
            order = np.argsort(place, kind="stable")
            place, at, size = place[order], at[order], size[order]
            span = spans[lang]
            ring = min(seats, len(span))
            edge = np.searchsorted(place, np.arange(span.start, span.stop + 1))
            total = np.zeros(n, np.int64)
            out: dict[str, list] = {x: [] for x in names}

            def add(*row: object) -> None:
                for x, v in zip(names, row, strict=True):
                    out[x].append(v)

            for i, g in enumerate(span):
                part, mine = slice(edge[i], edge[i + 1]), np.zeros(n, np.int64)
                np.add.at(mine, at[part], size[part])
                total += mine
                add(lang, number, g, i % ring, ring, n, int(mine.sum()), _packed(mine), None)
                if len(out["lang"]) == _VECTORS:
                    yield out
                    out = {x: [] for x in names}
            spelt = coded.dictionary.filter(pa.array(kept)).to_pylist()
            add(lang, number, -1, 0, ring, n, int(total.sum()), _packed(total), zlib.compress("\n".join(spelt).encode(), 1))
            yield out

        def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, list]]:
            key: tuple[int, int] = (-1, -1)
            held: list[dict[str, pa.Array]] = []
            for b in batches:
                lang, number = b["lang"].to_numpy(), b["block"].to_numpy()
                begin = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (number[1:] != number[:-1])])[: len(lang)])
                for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(lang)], strict=True):
                    if (lang[s], number[s]) != key:
                        if held:
                            yield from block(*key, held)
                        key, held = (int(lang[s]), int(number[s])), []
                    held.append({c: b[c].slice(s, e - s) for c in ("term", "docs", "places", "counts")})
            if held:
                yield from block(*key, held)

        return run

    schema = "lang int, block int, place int, seat int, seats int, terms long, total long, counts binary, names binary"
    return map_arrays(dealt.select("lang", "block", "term", "docs", "places", "counts"), make, schema)


def _meetings(met: DataFrame, sums) -> DataFrame:
    """(a, b, there, back): the values of each meeting in its block, of a seen from b and the reverse."""

    def make():
        size, terms, _ = sums.value

        def step(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
            for c in batches:
                out: dict[str, list] = {"a": c["a"], "b": c["b"], "there": [], "back": []}
                for a, b, lang, n, x, y in zip(c["a"], c["b"], c["lang"], c["terms"], c["counts"], c["others"], strict=True):
                    p, q = share(_unpacked(x, n), size[a], terms[lang]), share(_unpacked(y, n), size[b], terms[lang])
                    apart = (p - q) ** 2
                    out["there"].append(int((apart // q).sum()))
                    out["back"].append(int((apart // p).sum()))
                yield out

        return step

    return map_stream(met, make, "a int, b int, there long, back long", rows=_VECTORS)


def rotate(found: DataFrame, groups: list[tuple[str, str]], sums, seats: int = SEATS) -> DataFrame:
    """(place, other, value) of all ordered pairs of groups of one language that has terms."""
    spark, own = found.sparkSession, found.where("place >= 0")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    resident = own.select("lang", "block", "seat", F.col("place").alias("a"), "terms", "counts").repartition(parts, "lang", "block", "seat").persist()

    def met(r: int) -> DataFrame:
        on = own.select(
            "lang", "block", F.pmod(F.col("seat") + r, F.col("seats")).alias("seat"), F.col("seat").alias("home"), "seats",
            F.col("place").alias("b"), F.col("counts").alias("others"),
        )
        if r:  # half a turn meets each pair of seats from both sides
            on = on.where(F.lit(2 * r) <= F.col("seats"))
            apart = (F.lit(2 * r) < F.col("seats")) | (F.col("home") < F.col("seat"))
        else:
            apart = F.col("a") < F.col("b")
        return resident.join(on, ["lang", "block", "seat"]).where(apart).select("a", "b", "lang", "terms", "counts", "others")

    last = min(seats, max(map(len, _spans(groups).values()), default=0)) // 2
    waves = [range(r, min(r + WAVE, last + 1)) for r in range(0, last + 1, WAVE)]
    try:
        rounds = reduce(DataFrame.unionByName, [cut(_meetings(reduce(DataFrame.unionByName, map(met, wave)), sums)) for wave in waves])
    finally:
        resident.unpersist()
    added = rounds.groupBy("a", "b").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("place"), F.col("b").alias("other"), F.col("there").alias("value")),
            F.struct(F.col("b").alias("place"), F.col("a").alias("other"), F.col("back").alias("value")),
        )
    )
    return added.select(both.alias("x")).select("x.*")


def top_terms(found: DataFrame, sums, top: int = TOP) -> DataFrame:
    """(place, item, value): the best terms of each group in each block, by heaps of ``top``."""
    own = found.where("place < 0").select("lang", "block", F.col("counts").alias("totals"), "names")
    beside = found.where("place >= 0").drop("names").join(own, ["lang", "block"])

    def make():
        size, terms, whole = sums.value

        def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
            held: tuple = ()
            for c in batches:
                out: dict[str, list] = {"place": [], "item": [], "value": []}
                for lang, block, place, n, x, y, names in zip(*(c[k] for k in ("lang", "block", "place", "terms", "counts", "totals", "names")), strict=True):
                    if held[:2] != (lang, block):
                        q = share(_unpacked(y, n), whole[lang], terms[lang])
                        held = lang, block, q, np.array(zlib.decompress(names).split(b"\n"), object)
                    q, spelt = held[2:]
                    count = _unpacked(x, n)
                    p = share(count, size[place], terms[lang])
                    at = np.flatnonzero((count > 0) & (p > q))
                    worth = value(p[at], q[at])
                    if len(at) > top:
                        least = np.partition(worth, len(at) - top)[len(at) - top]
                        at, worth = at[worth >= least], worth[worth >= least]
                    best = heapq.nsmallest(top, zip((-worth).tolist(), spelt[at].tolist(), strict=True))
                    out["place"] += [place] * len(best)
                    out["item"] += [t.decode() for _, t in best]
                    out["value"] += [-v for v, _ in best]
                yield out

        return run

    names = ("lang", "block", "place", "terms", "counts", "totals", "names")
    return map_stream(beside.select(*names), make, "place int, item string, value long", rows=_VECTORS)


def audit(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    top: int = TOP,
    seats: int = SEATS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's distance to the others, and the terms that set it apart."""
    spark = docs.sparkSession
    named = docs.select(
        *[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))],
        docs[text_col].cast("string").cast("binary").alias("text"),
    )
    groups = _groups(named)
    found = stored(vectors(term_counts(named, groups), groups, min_docs, seats), "divergence")
    added = found.groupBy("lang", "place").agg(F.sum("total").alias("n"), F.sum("terms").alias("v")).collect()  # a row a group
    size = {r["place"]: r["n"] for r in added if r["place"] >= 0}
    whole = {r["lang"]: r["n"] for r in added if r["place"] < 0}
    terms = {r["lang"]: r["v"] for r in added if r["place"] < 0}
    sums = spark.sparkContext.broadcast((size, terms, whole))
    name = spark.createDataFrame([(i, lang, source) for i, (lang, source) in enumerate(groups)], "place int, lang string, source string")
    other = name.select(F.col("place").alias("other"), "lang", F.col("source").alias("item"))
    pairs = name.join(other, "lang").where("place <> other")
    worth = rotate(found, groups, sums, seats)
    pairs = pairs.join(worth, ["place", "other"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
    best = top_terms(found, sums, top).join(name, "place").select("lang", "source", "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair")).select(*out)
        .unionByName(ranked.withColumn("part", F.lit("term")).select(*out))
    )


ORACLE_SQL = """
WITH docs AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (
    SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS d
    FROM (SELECT row, lang, source, unnest(w) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counted GROUP BY lang, term HAVING sum(d) >= 3),
sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
full_counts AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS c, k.n AS all_n
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)),
shares AS (
    SELECT f.*, s.total, s.v, 1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY f.lang, source)::HUGEINT + s.v) AS p,
        1 + (1000000000::HUGEINT * (all_n + 1)) // (s.total + s.v) AS q
    FROM full_counts f JOIN sizes s USING (lang)),
apart AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
best AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
    row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (
    SELECT lang, source, 'term', item, value,
        row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM best) WHERE rank <= 200
"""
