"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a
document of smaller id, or further ahead in the same one. In suffix order, the
earlier starts that share most with a suffix are the previous and the next smaller
position; what it shares with them is its longest previous factor, and a start
goes if that is ``LENGTH`` or more (:mod:`suffixes`).

No suffix array of all texts is built. Each string of ``LENGTH`` bytes holds
``LENGTH - GRAM + 1`` substrings of ``GRAM`` bytes; the least hash of these is its key.
Equal strings have equal keys, so that each key can be judged alone, and starts
that follow each other mostly share their key, so that a document is a row for
each run of some thirty starts:

1. :func:`runs`: keyed runs, with a hash of the bytes that they cover.
2. :func:`settle`: rows meet by key, sorted. Of runs that are equal as a whole (key
   and hash, 128 bits) all but the first go. Where a key has runs that differ, the first of
   each kind needs its bytes.
3. :func:`segments`: those bytes are taken from the texts, compressed on the way.
4. :func:`blocks`: the segments of some keys at a time are put in suffix order, and
   their longest previous factors tell which starts go.
5. :func:`kept_bytes`: the removed starts come back to the texts.

Hot keys: equal runs of a task's chunk are sent once. Keys found in many
documents of a bounded sample (``SAMPLE`` documents, by hash) are not dealt as runs: each
of their starts is a row of its own, keyed by its ``LENGTH`` bytes, so that a passage that a
third of the documents holds meets by its own strings and not beside all that
surrounds it. The runs of a key with more than ``HOT`` different ones are settled in this way too. The sample steers the dealing alone, not the result.

Defined cases: a null or empty text has no bytes and nothing goes. A null id counts as
the greatest long. Rows that repeat an id are one document in the order of starts: a start goes if
the same string starts at a smaller (id, start), so rows equal in both keep what each
other keeps. Texts of any length are read whole, in slices that overlap. An empty table gives an empty
result. Only the id and text columns are read. The folder ``longest-match-*`` in the shared folder holds
the settled runs until it is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import map_arrays, stored
from .suffixes import common_prefix, longest_previous, ranks, suffix_order

LENGTH, GRAM = 100, 24
#: Bytes that are hashed at once, and bytes of segments that are put in order at once.
SLICE, BLOCK = 1 << 20, 1 << 20
#: Documents of the sample that finds hot keys, about, and the share of them that makes a key hot.
SAMPLE, HOT_SHARE = 4096, 1 / 64
#: Different runs of a key whose bytes are compared; further ones are settled by start.
HOT = 4_096
_SEED = 100
_ODD, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(_SEED).integers(0, 1 << 64, 256, dtype=np.uint64)
_RUNS = "key long, doc long, twin long, at long, n int, sig long"
REMOVED, WANTED, SINGLE = 0, 1, 2


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on."""
    part, size, whole, done = _TABLE[data], 1, None, 0
    while True:
        if gram & size:
            whole = part if whole is None else whole[: len(part) - done] * np.uint64(pow(_ODD, size, 1 << 64)) + part[done : done + len(whole)]
            done += size
        if done == gram:
            break
        part = part[:-size] * np.uint64(pow(_ODD, size, 1 << 64)) + part[size:]
        size *= 2
    whole = whole[: len(data) - gram + 1]
    whole = (whole ^ (whole >> np.uint64(32))) * _MIX
    return whole ^ (whole >> np.uint64(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def keyed_runs(data: np.ndarray, edges: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, n) of the runs of starts in texts that end at ``edges``: the least hash of the grams of each ``length`` bytes.

    A run ends where the first gram of that hash is left behind, so that its own strings all differ.
    """
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    hashes = _gram_hashes(data, gram)
    key = _least(hashes, length - gram + 1)
    starts = np.ones(len(data) + length, bool)  # those whose string ends in their own text
    back = edges[:, None] - np.arange(1, length)
    starts[back[back >= 0]] = False
    at = np.flatnonzero(starts[: len(key)])
    if not len(at):
        return key[:0], at, at
    own = key[at]
    parted = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1) | (own[1:] == hashes[at[1:] - 1])
    first = np.flatnonzero(np.concatenate([[True], parted]))
    n = np.diff(np.concatenate([first, [len(at)]]))
    return own[first], at[first], n


def _sliced(batches: Iterator[dict[str, pa.Array]], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, edges, doc, twin, offset) of some texts, or of a slice of a long one, at a time."""
    held: list[bytes] = []
    names: list[tuple[int, int, int]] = []
    size = 0

    def out() -> tuple:
        own = np.array(names, np.int64).reshape(-1, 3)
        return b"".join(held), np.cumsum([len(x) for x in held]), own[:, 0], own[:, 1], own[:, 2]

    for b in batches:
        for doc, twin, text in zip(*(b[c].to_pylist() for c in ("doc", "twin", "data")), strict=True):
            for at in range(0, len(text) - length + 1, SLICE):
                held.append(text[at : at + SLICE + length - 1])
                names.append((doc, twin, at))
                size += len(held[-1])
                if size >= SLICE:
                    yield out()
                    held, names, size = [], [], 0
    if held:
        yield out()


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).astype(np.uint64).view(np.int64)


def _hashes(data: bytes, at: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(data[s:e], seed) for s, e in zip(at.tolist(), end.tolist(), strict=True)], np.uint64)


def _by_start(data: bytes, first: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, key, hash) of each start of some runs: both hashes are of its ``length`` bytes."""
    run = np.repeat(np.arange(len(n)), n)
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(run))
    return run, _hashes(data, at, at + length, 1), _hashes(data, at, at + length, 2)


def named_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc, twin, data, doc_id) of all rows, and (doc, twin, data) of those that differ.

    ``twin`` tells texts of one id apart; it is 0 where all ids differ.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    named = own.withColumn("doc", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    unique = named.groupBy("doc").count().where("count > 1").isEmpty()
    twin: Column = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce("text", F.lit("")))
    every = named.select("doc", twin.alias("twin"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"), "doc_id")
    once = every.drop("doc_id")
    return every, once if unique else once.dropDuplicates(["doc", "twin"])


def hot_keys(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, sample: int = SAMPLE, share: float = HOT_SHARE) -> np.ndarray:
    """Keys that more than ``share`` of a sample of documents have, sorted; at most ``sample`` documents or so are looked at."""
    count = texts.count()
    few = texts.where(F.pmod(F.xxhash64("doc", "twin", F.lit(_SEED)), F.lit(1 << 30)) < int(min(1.0, sample / max(1, count)) * (1 << 30)))

    def make():
        def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, object]]:
            for data, edges, doc, twin, _ in _sliced(batches, length):
                key, first, _ = keyed_runs(np.frombuffer(data, np.uint8), edges, length, gram)
                of = np.searchsorted(edges, first, side="right")
                own = np.unique(np.stack([_signed(key), doc[of], twin[of]]), axis=1)
                yield {"key": own[0], "doc": own[1], "twin": own[2]}

        return run

    found = map_arrays(few.select("doc", "twin", "data"), make, "key long, doc long, twin long").distinct()
    hot = found.groupBy("key").count().where(F.col("count") > max(16, share * min(sample, count))).collect()
    return np.sort(np.array([r["key"] for r in hot], np.int64))


def runs(texts: DataFrame, hot: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Rows ``_RUNS``, and those that are equal to an earlier one of the same chunk with ``n`` below 0: they are settled."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def make():
        warm = shared.value

        def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, object]]:
            for data, edges, doc, twin, offset in _sliced(batches, length):
                key, first, n = keyed_runs(np.frombuffer(data, np.uint8), edges, length, gram)
                key = _signed(key)
                sig = _signed(_hashes(data, first, first + n + length - 1, 2))
                if len(warm) and len(key):
                    single = np.isin(key, warm)
                    which, own, hashed = _by_start(data, first[single], n[single], length)
                    place = first[single][which] + np.arange(len(which)) - np.searchsorted(which, which)
                    key = np.concatenate([key[~single], _signed(own)])
                    sig = np.concatenate([sig[~single], _signed(hashed)])
                    first = np.concatenate([first[~single], place])
                    n = np.concatenate([n[~single], np.ones(len(place), np.int64)])
                of = np.searchsorted(edges, first, side="right")
                at = first - np.concatenate([[0], edges])[of] + offset[of]
                out = np.stack([key, sig, n, doc[of], at, twin[of]]) if len(key) else np.zeros((6, 0), np.int64)
                order = np.lexsort(out[4::-1])  # by key, then hash, n, id and place
                out = out[:, order]
                again = np.zeros(out.shape[1], bool)
                if len(again):
                    same = np.all(out[:3, 1:] == out[:3, :-1], axis=0)
                    begin = np.flatnonzero(np.concatenate([[True], ~same]))
                    of = np.cumsum(np.concatenate([[True], ~same])) - 1
                    again = (out[3] > out[3][begin][of]) | (out[4] > out[4][begin][of])
                yield {
                    "key": np.where(again, out[3] ^ out[4], out[0]), "doc": out[3], "twin": out[5], "at": out[4],
                    "n": np.where(again, -out[2], out[2]), "sig": np.where(again, 0, out[1]),
                }

        return run

    return map_arrays(texts.select("doc", "twin", "data"), make, _RUNS)


def settle(rows: DataFrame) -> DataFrame:
    """(doc, twin, at, n, key, kind): runs that go (``REMOVED``), and those that need their bytes (``WANTED``) or starts (``SINGLE``).

    Rows come sorted; a task holds the first runs of each kind of one key, ``HOT`` at most.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "key").sortWithinPartitions("key", "sig", "n", "doc", "at")

    def make():
        def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, object]]:
            last = np.zeros((3, 0), np.int64)  # key, hash and n of the last row
            begin = np.zeros((2, 1), np.int64)  # first id and place of its kind
            held = np.zeros((5, 0), np.int64)  # first runs of the last key: key, doc, twin, at, n
            over: int | None = None  # a key with more than HOT of them

            def released(first: np.ndarray, end: int) -> list[tuple[np.ndarray, int]]:
                """The first runs up to ``end``, where their key has others, by kind."""
                own = first[0]
                new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                size = np.diff(np.append(new, len(own)))
                size = np.repeat(size, size)[:end]
                single = (size > HOT) | (own[:end] == over if over is not None else False)
                return [(first[:, :end][:, single], SINGLE), (first[:, :end][:, ~single & (size > 1)], WANTED)]

            def out(parts: list[tuple[np.ndarray, int]]) -> dict[str, object]:
                every = np.concatenate([p for p, _ in parts], axis=1)
                kinds = np.concatenate([np.full(p.shape[1], k) for p, k in parts])
                return dict(zip(("key", "doc", "twin", "at", "n"), every, strict=True)) | {"kind": kinds}

            for b in batches:
                key, doc, twin, at, n, sig = (b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "doc", "twin", "at", "n", "sig"))
                every, done = np.stack([key, doc, twin, at, np.abs(n)]), n < 0
                parts = [(every[:, done], REMOVED)]
                every, name = every[:, ~done], np.stack([key, sig, n])[:, ~done]
                if every.shape[1]:
                    joined = np.concatenate([last, name], axis=1)
                    fresh = np.any(joined[:, 1:] != joined[:, :-1], axis=0)
                    fresh = fresh if last.shape[1] else np.concatenate([[True], fresh])
                    begin = np.concatenate([begin, every[[1, 3]][:, fresh]], axis=1)
                    of = np.cumsum(fresh)
                    parts.append((every[:, (every[1] > begin[0][of]) | (every[3] > begin[1][of])], REMOVED))
                    last, begin = name[:, -1:], begin[:, -1:]
                    held = np.concatenate([held, every[:, fresh]], axis=1)
                if held.shape[1]:
                    end = int(np.searchsorted(held[0], held[0, -1]))
                    parts += released(held, end)
                    held = held[:, end:]
                    if held.shape[1] > HOT:
                        parts.append((held, SINGLE))
                        over, held = int(held[0, 0]), held[:, :0]
                yield out(parts)
            if held.shape[1]:
                yield out(released(held, held.shape[1]))

        return run

    schema = "doc long, twin long, at long, n int, key long, kind int"
    return map_arrays(dealt.select("key", "doc", "twin", "at", "n", "sig"), make, schema)


def packed(texts: DataFrame) -> DataFrame:
    """``texts`` with their bytes compressed, so that a shuffle moves less."""
    names = [c for c in texts.columns if c != "data"]

    def make():
        def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, object]]:
            for b in batches:
                data = b["data"].to_pylist()
                yield {n: b[n] for n in names} | {"size": [len(x) for x in data], "data": [pa.compress(x, "zstd", asbytes=True) for x in data]}

        return run

    return map_arrays(texts.select(*names, "data"), make, ", ".join(f"{n} long" for n in names) + ", size long, data binary")


def _unpacked(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, "zstd", asbytes=True) if size else b""


def _asked(texts: DataFrame, settled: DataFrame) -> DataFrame:
    """Texts with the list of runs that ask for their bytes; a list is no longer than its text."""
    asks = settled.groupBy("doc", "twin").agg(F.collect_set(F.struct("key", "at", "n")).alias("asks"))
    return packed(texts).join(asks, ["doc", "twin"]).select("doc", "twin", "size", "data", "asks")


def _asks(asks: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = asks[i].values
    return tuple(part.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))


def segments(texts: DataFrame, settled: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, doc, twin, at, n, data): the bytes of each wanted run."""

    def make():
        def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, object]]:
            for b in batches:
                for i, (doc, twin, size, data) in enumerate(zip(*(b[c].to_pylist() for c in ("doc", "twin", "size", "data")), strict=True)):
                    key, at, n = _asks(b["asks"], i)
                    text = _unpacked(data, size)
                    cut = [text[s:e] for s, e in zip(at.tolist(), (at + n + length - 1).tolist(), strict=True)]
                    yield {"key": key, "doc": np.full(len(key), doc), "twin": np.full(len(key), twin), "at": at, "n": n, "data": cut}

        return run

    return map_arrays(_asked(texts, settled), make, "key long, doc long, twin long, at long, n int, data binary")


def single_starts(texts: DataFrame, settled: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows ``_RUNS`` of the starts, one by one, of runs of keys with too many kinds."""

    def make():
        def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, object]]:
            for b in batches:
                for i, (doc, twin, size, data) in enumerate(zip(*(b[c].to_pylist() for c in ("doc", "twin", "size", "data")), strict=True)):
                    _, at, n = _asks(b["asks"], i)
                    which, key, sig = _by_start(_unpacked(data, size), at, n, length)
                    place = at[which] + np.arange(len(which)) - np.searchsorted(which, which)
                    one = np.ones(len(which), np.int64)
                    yield {"key": _signed(key), "doc": one * doc, "twin": one * twin, "at": place, "n": one, "sig": _signed(sig)}

        return run

    return map_arrays(_asked(texts, settled), make, _RUNS)


def repeated_starts(data: list[bytes], doc: np.ndarray, at: np.ndarray, n: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each start of some segments, one after the other, has a longest previous factor of ``length`` or more."""
    edges = np.cumsum([0, *map(len, data)])
    segment = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
    own, first = doc[segment], at[segment] + step
    order = np.lexsort((first, own))
    new = (own[order][1:] != own[order][:-1]) | (first[order][1:] != first[order][:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.concatenate([[0], np.cumsum(new)])
    where = edges[segment] + step
    levels = ranks(np.frombuffer(b"".join(data), np.uint8), length)
    order = suffix_order(levels, where, place, length)
    shared = common_prefix(levels, where[order][:-1], where[order][1:], length)
    found = np.zeros(len(order), bool)
    found[order] = longest_previous(place[order], np.concatenate([[0], shared]), length) >= length
    return found


def blocks(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, twin, at, n): runs of starts whose longest previous factor is long enough."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartition(parts, "key").sortWithinPartitions("key")

    def make():
        def judged(held: list[tuple]) -> dict[str, object]:
            doc, twin, at, n = (np.array([h[k] for h in held], np.int64) for k in (1, 2, 3, 4))
            goes = repeated_starts([h[5] for h in held], doc, at, n, length)
            inside = np.ones(len(goes), bool)
            inside[np.cumsum(n) - n] = False  # a segment's first start follows nothing
            begin = np.flatnonzero(goes & ~(inside & np.concatenate([[False], goes[:-1]])))
            stop = np.flatnonzero(goes & ~np.append(goes[1:] & inside[1:], False)) + 1
            of = np.repeat(np.arange(len(n)), n)[begin]
            return {"doc": doc[of], "twin": twin[of], "at": at[of] + begin - (np.cumsum(n) - n)[of], "n": stop - begin}

        def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, object]]:
            held: list[tuple] = []
            size = 0
            for b in batches:
                for row in zip(*(b[c].to_pylist() for c in ("key", "doc", "twin", "at", "n", "data")), strict=True):
                    if size >= BLOCK and row[0] != held[-1][0]:
                        yield judged(held)
                        held, size = [], 0
                    held.append(row)
                    size += len(row[5])
            if held:
                yield judged(held)

        return run

    return map_arrays(dealt.select("key", "doc", "twin", "at", "n", "data"), make, "doc long, twin long, at long, n int")


def kept_bytes(texts: DataFrame, gone: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each text, without the strings of ``length`` bytes from the starts in ``gone``."""
    spans = gone.groupBy("doc", "twin").agg(F.collect_set(F.struct("at", "n")).alias("gone"))
    beside = packed(texts).join(spans, ["doc", "twin"], "left")
    whole = length - 1

    def make():
        def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, object]]:
            for b in batches:
                out: dict[str, list] = {n: [] for n in ("n_removed", "n_spans", "kept")}
                for i, (size, data) in enumerate(zip(b["size"].to_pylist(), b["data"].to_pylist(), strict=True)):
                    text, removed, runs_ = _unpacked(data, size), 0, 0
                    if b["gone"][i].is_valid:
                        at, n = (b["gone"][i].values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                        edge = np.zeros(size + 1, np.int32)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + n + whole, -1)
                        away = np.cumsum(edge[:-1]) > 0
                        removed, runs_ = int(away.sum()), int(away[0]) + int((away[1:] & ~away[:-1]).sum())
                        text = np.frombuffer(text, np.uint8)[~away].tobytes()
                    out["n_removed"].append(removed)
                    out["n_spans"].append(runs_)
                    out["kept"].append(text)
                yield {"doc_id": b["doc_id"], "n_bytes": b["size"]} | out

        return run

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return map_arrays(beside.select("doc_id", "size", "data", "gone"), make, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row: its bytes without what strings of ``length`` bytes that start earlier cover."""
    if gram < 1 or length < max(16, gram):
        raise ValueError("length must be 16 or more and at least gram")
    texts, once = named_texts(docs, id_col, text_col)
    hot = hot_keys(once, length, gram)
    settled = stored(settle(runs(once, hot, length, gram)), "longest-match")
    gone = settled.where(F.col("kind") == REMOVED).select("doc", "twin", "at", "n")
    gone = gone.unionByName(blocks(segments(once, settled.where(F.col("kind") == WANTED), length), length))
    single = settled.where(F.col("kind") == SINGLE)
    if not single.isEmpty():
        gone = gone.unionByName(settle(single_starts(once, single, length)).where(F.col("kind") == REMOVED).select("doc", "twin", "at", "n"))
    return kept_bytes(texts, gone, length)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    found = remove_repeats(docs)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
