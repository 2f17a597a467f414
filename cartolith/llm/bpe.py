"""Byte-level BPE: overlapping chunks, stitched where their pre-tokens meet again.

A pre-token match depends only on the text from its start on. So once two
neighbouring chunks, tokenised apart, share the start of a pre-token, they
agree from there. A seam never follows white space, since the last white space
of a run goes to the next pre-token only where the run's end is seen.

Texts of at most a chunk and its overlap are encoded as they are. Longer ones
become rows, a chunk each, that are pre-tokenised in parallel, each ``overlap``
characters into the next; the first start that both neighbours have is the seam
(a join of neighbours by small lists). The pieces between seams are encoded in
parallel and meet again, in order, only as ids, which are digested and decoded
as a stream. Where two chunks share no start in the overlap (one pre-token may
fill a chunk), the whole text is encoded by one task, which carries the earlier
chunk on in steps that double (:func:`seams`). Decoding concatenates raw bytes.

Defined cases: a null text is an empty one and has no ids. Repeated rows stay
repeated. An empty table gives an empty result. Texts of any length are encoded
whole. Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, map_batches, map_stream

#: Characters of a chunk, and how far it runs into the next.
CHUNK, OVERLAP = 32_768, 512
#: Pre-tokens of more bytes are merged by a heap; the library's merge is quadratic in their length.
LONG_PIECE = 2_048


def seams(text: str, pattern: regex.Pattern, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Starts of pre-tokens, from 0 to the text's end, about ``chunk`` apart."""
    n = len(text)
    cuts = [0]
    start = 0  # a start of a pre-token, known to be true
    while n - start > chunk + overlap:
        guess = start + chunk
        reach = overlap
        while True:
            end = min(n, guess + reach)
            left = [m.start() for m in pattern.finditer(text, start, end)]
            right = {m.start() for m in pattern.finditer(text, guess, end)}
            seam = next((s for s in left if s >= guess and s in right and not text[s - 1].isspace()), None)
            if seam is not None:
                break
            if end == n:
                return [*cuts, n]
            start = left[-1]
            reach *= 2
        cuts.append(seam)
        start = seam
    if cuts[-1] != n:
        cuts.append(n)
    return cuts


class Codec:
    """Encoder and decoder for a rank file of byte-level BPE."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.pattern = regex.compile(pattern)
        self.long_run = regex.compile(rf"\S{{{LONG_PIECE},}}|\s{{{LONG_PIECE},}}")
        self.inner = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the lowest-ranked, leftmost pair merges first."""
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        alive = [True] * n
        ranks = self.ranks
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i], after[i] = stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (b := before[i]) >= 0 and (r := ranks.get(piece[b:stop])) is not None:
                heapq.heappush(heap, (r, b, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a text that begins and ends with pre-tokens."""
        if not self.long_run.search(piece):
            return self.inner.encode_ordinary(piece)
        ids: list[int] = []
        for m in self.pattern.finditer(piece):
            ids += self.merge(m.group().encode("utf-8", "surrogatepass"))
        return ids

    def encode(self, text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        text = text or ""
        cuts = seams(text, self.pattern, chunk, overlap)
        ids: list[int] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            ids += self.encode_piece(text[a:b])
        return ids

    def starts(self, text: str, start: int, end: int) -> list[int]:
        """Starts of pre-tokens from ``start`` to ``end`` that a seam may have: those not after white space."""
        return [m.start() for m in self.pattern.finditer(text) if start <= m.start() <= end and not (m.start() and text[m.start() - 1].isspace())]

    def decode(self, ids: list[int]) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    """Path and pattern of the public 50k vocabulary; parameters of every function here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _id_pieces(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(row, doc_id, k, ids) of the pieces of each text (row, doc_id, text); ``k`` puts them in order."""

    def make_chunks():
        def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
            names = ("row", "doc_id", "n", "k", "text")
            for c in batches:
                for row, doc, text in zip(c["row"], c["doc_id"], c["text"], strict=True):
                    n = max(1, -(-(len(text) - overlap) // chunk))
                    for first in range(0, n, 64):
                        ks = range(first, min(n, first + 64))
                        parts = [text[k * chunk : (k + 1) * chunk + overlap if k + 1 < n else None] for k in ks]
                        yield dict(zip(names, ([row] * len(ks), [doc] * len(ks), [n] * len(ks), list(ks), parts), strict=True))

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = cut(map_stream(docs.select("row", "doc_id", "text"), make_chunks, f"row long, doc_id {kind}, n long, k long, text string"))

    def make_starts():
        own = codec(path, pattern)

        def step(c: dict[str, list]) -> dict[str, list]:
            head = [own.starts(t[: 2 * overlap], 0, overlap) for t in c["text"]]
            tail = [own.starts(t, chunk, chunk + overlap) for t in c["text"]]
            return {"row": c["row"], "k": c["k"], "n": c["n"], "head": head, "tail": tail}

        return step

    spread = chunks.repartition("row", "k")
    found = cut(map_batches(spread.select("row", "k", "n", "text"), make_starts, "row long, k long, n long, head array<int>, tail array<int>"))
    after = found.select("row", (F.col("k") - 1).alias("k"), F.transform("head", lambda x: x + F.lit(chunk)).alias("head"))
    seam = F.array_min(F.array_intersect("tail", "head")) - F.lit(chunk)  # from the next chunk's begin
    met = cut(found.where("k + 1 < n").select("row", "k", "tail").join(after, ["row", "k"]).select("row", "k", seam.alias("seam")))
    apart = met.where("seam is null").select("row").distinct()
    begin = met.select("row", (F.col("k") + 1).alias("k"), F.col("seam").alias("begin"))
    end = met.select("row", "k", (F.col("seam") + F.lit(chunk)).alias("end"))
    pieces = (
        chunks.join(apart, "row", "left_anti").join(begin, ["row", "k"], "left").join(end, ["row", "k"], "left")
        .select("row", "doc_id", "k", F.coalesce("begin", F.lit(0)).alias("begin"), "end", "text")
    )
    whole = docs.join(apart, "row", "left_semi").select(
        "row", "doc_id", F.lit(0).cast("long").alias("k"), F.lit(-1).alias("begin"), F.lit(None).cast("int").alias("end"), "text"
    )

    def make_ids():
        own = codec(path, pattern)

        def step(c: dict[str, list]) -> dict[str, list]:
            ids = [
                own.encode(t, chunk, overlap) if a < 0 else own.encode_piece(t[a:b])
                for t, a, b in zip(c["text"], c["begin"], c["end"], strict=True)
            ]
            return {"row": c["row"], "doc_id": c["doc_id"], "k": c["k"], "ids": ids}

        return step

    return map_batches(pieces.unionByName(whole), make_ids, f"row long, doc_id {kind}, k long, ids array<int>")


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text."""
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    long = F.coalesce(F.length("text") > chunk + overlap, F.lit(False))

    def make():
        own = codec(path, pattern)
        return lambda c: {"doc_id": c["doc_id"], "ids": [own.encode_piece(t or "") for t in c["text"]]}

    short = map_batches(narrow.where(~long), make, f"doc_id {kind}, ids array<int>")
    some = cut(narrow.where(long).withColumn("row", F.monotonically_increasing_id()))
    if some.isEmpty():
        return short
    pieces = _id_pieces(some, path, pattern, chunk, overlap).groupBy("row", "doc_id")
    ordered = F.array_sort(F.collect_list(F.struct("k", "ids")))
    return short.unionByName(pieces.agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids")).select("doc_id", "ids"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes): the concatenated bytes of ``ids``; null ids are no ids."""
    narrow = encoded.select("doc_id", "ids")
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def make():
        own = codec(path, pattern)
        return lambda c: {"doc_id": c["doc_id"], "bytes": [own.decode(i or []) for i in c["ids"]]}

    return map_batches(narrow, make, f"doc_id {kind}, bytes binary")


def round_trip(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, maybe ids): encode, decode, and digest both."""
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    long = F.coalesce(F.length("text") > chunk + overlap, F.lit(False))
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def make():
        own = codec(path, pattern)

        def step(c: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {n: [] for n in names}
            for doc, text in zip(c["doc_id"], c["text"], strict=True):
                digest = _Digest(own, doc, keep_ids)
                digest.add(own.encode_piece(text or ""))
                digest.put(out)
            return out

        return step

    short = map_batches(narrow.where(~long), make, schema)
    some = cut(narrow.where(long).withColumn("row", F.monotonically_increasing_id()))
    if some.isEmpty():
        return short
    pieces = _id_pieces(some, path, pattern, chunk, overlap).repartition("row").sortWithinPartitions("row", "k")

    def make_digests():
        own = codec(path, pattern)

        def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
            row, digest = None, None
            for c in batches:
                out: dict[str, list] = {n: [] for n in names}
                for at, doc, ids in zip(c["row"], c["doc_id"], c["ids"], strict=True):
                    if at != row:
                        if digest:
                            digest.put(out)
                        row, digest = at, _Digest(own, doc, keep_ids)
                    digest.add(ids)
                yield out
            if digest:
                out = {n: [] for n in names}
                digest.put(out)
                yield out

        return run

    return short.unionByName(map_stream(pieces.select("row", "doc_id", "ids"), make_digests, schema))


class _Digest:
    """The digests of a text's ids and of the bytes decoded from them, fed piece by piece."""

    def __init__(self, own: Codec, doc_id: int | None, keep_ids: bool) -> None:
        self.own, self.doc_id, self.keep_ids = own, doc_id, keep_ids
        self.n, self.ids, self.bytes = 0, hashlib.sha256(), hashlib.sha256()
        self.kept: list[int] = []

    def add(self, ids: list[int]) -> None:
        decimal = self.own.decimal
        self.ids.update((" " * bool(self.n and ids) + " ".join([decimal[i] for i in ids])).encode())
        self.bytes.update(self.own.decode(ids))
        self.n += len(ids)
        if self.keep_ids:
            self.kept += ids

    def put(self, out: dict[str, list]) -> None:
        values = (self.doc_id, self.n, self.ids.hexdigest(), self.bytes.hexdigest(), self.kept)
        for name, value in zip(out, values, strict=True):
            out[name].append(value)
