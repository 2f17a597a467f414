"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: words are the runs of non-white-space bytes of the text, A-Z
lower-cased; each shingle of ``k`` words (a shorter text: all its words) is
hashed by XXH64 with seed 42; a bit is 1 if it is set in over half the hashes.

Links: the index is a hierarchy of masked bit patterns. Its uppermost nodes are
buckets: with the 64 bits cut into ``radius + s`` blocks, two fingerprints within
``radius`` bits agree on ``s`` blocks at least, so each choice of ``s`` blocks is a
table of buckets that share their bits, and no link is lost. Only as many bits
of a block count as bring a bucket to about ``BUCKET_ROWS``; where the buckets of all
tables would compare more pairs than there are, the table is one bucket. A bucket beyond ``HOT_ROWS`` is parted by further bits in the same way,
until it fits or its members agree on so many bits that few can differ. Below a
bucket the :class:`GrayIndex` sorts by Gray rank and prunes pairs of nodes.
Buckets return a spanning forest, not all pairs;
:func:`components.connected_components` joins the forests.

:func:`keep_one` takes wide fingerprints: ``WIDE`` words of 64 bits, the further
ones from the same hashes, mixed anew. A link needs at most ``NEAR_BITS`` different bits
over all, wherever they lie; shingle sets of similarity 0.8 have that in nine cases of ten (about
15 % of the bits differ, give or take 2 %), and more similar ones nearly always;
chance alone gives no such pair. The search is exact at any size: fingerprints
are dealt to blocks, every pair of blocks is a piece of work of its own, or several, and the
:class:`WideIndex` finds all links in it. Size decides only how they are dealt and in which order.

Defined cases: a null or empty text has no words and fingerprint 0, which is
linked like any other. A null id never names a component if the component has
another id. Texts of any length are read whole. Repeated rows stay repeated. An empty table gives an empty result.
Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import cut, free_names, map_arrays, map_batches, map_stream

#: Rows that a bucket of the upper nodes should hold, and those beyond which it is parted again.
BUCKET_ROWS, HOT_ROWS = 4_096, 131_072
#: Times that hot buckets are parted again at most; see :func:`parted`.
MAX_PARTED = 4
#: Fingerprints of a leaf of the index, and children of a node above.
LEAF, FANOUT = 16, 8
#: Rows that a task joins at once, and pairs that it compares at once.
CHUNK_ROWS, CHUNK_PAIRS = 65_536, 1 << 20
#: Words of a wide fingerprint; shingle size, bits within which texts are near-duplicates; the first word has no limit of its own.
WIDE, NEAR_SHINGLE, NEAR_BITS = 4, 5, 46
NEAR_RADIUS = NEAR_BITS
#: See :func:`bands`, which no search uses any more.
BAND_ROWS, BAND_BITS, BANDS = 32_768, 8, 21
#: Wide fingerprints beyond which several tasks search a block, and those of a block at most, or so.
LEAST_BLOCK, MOST_BLOCK = 16_384, 1 << 19
#: Pairs of wide fingerprints compared at once, and near ones held before they are verified and joined.
WIDE_PAIRS, HELD_LINKS = 1 << 16, 1 << 16
#: Groups of a block that are looked up at once, and pairs that take the time which a group takes besides its own.
GROUPS, GROUP_PAIRS = 64, 10_000
_SHINGLES_AT_ONCE = 1 << 17
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Another hash of the same shingles for each word of a wide fingerprint."""
    if not word:
        return h
    h = (h + np.uint64((0x9E3779B97F4A7C15 * word) & (1 << 64) - 1)) * _MIX
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(31))


def wide_fingerprint(text: str | None, k: int = 4, words: int = 1) -> list[int]:
    """Unsigned 64-bit SimHashes of a text, the first by the plain shingle hash."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return [0] * words
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(tokens) < k:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(tokens) - k + 1], ends[k - 1 :]
    set_bits = np.zeros((words, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _SHINGLES_AT_ONCE):
        part = slice(at, at + _SHINGLES_AT_ONCE)
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts[part].tolist(), ends[part].tolist(), strict=True)], "<u8")
        for w in range(words):
            bits = np.unpackbits(_mixed(hashes, w).view(np.uint8), bitorder="little")
            set_bits[w] += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * set_bits > len(starts), axis=1, bitorder="little")
    return packed.view("<u8").ravel().tolist()


def fingerprint(text: str | None, k: int = 4) -> int:
    """The unsigned 64-bit SimHash of a text."""
    return wide_fingerprint(text, k)[0]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, words: int = 1) -> DataFrame:
    """(doc_id, text_hash, fp, more): signed longs, for each row; ``more`` holds the further words."""

    def make():
        def step(c: dict[str, list]) -> dict[str, list]:
            found = [[signed(x) for x in wide_fingerprint(t, k, words)] for t in c["text"]]
            return {"doc_id": c["doc_id"], "text_hash": c["text_hash"], "fp": [f[0] for f in found], "more": [f[1:] for f in found]}

        return step

    text = docs[text_col].cast("string")
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return map_batches(narrow, make, "doc_id long, text_hash long, fp long, more array<long>")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (least positions) after each of ``a`` is joined with that of ``b``; the same array if nothing changes."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        label = parent[label]
    return label


class GrayIndex:
    """Fingerprints of some groups, each sorted by Gray rank, under nodes of shared bits.

    A leaf covers ``LEAF`` fingerprints, a node above ``FANOUT`` nodes. ``mask`` and
    ``pattern`` are the bits on which all its fingerprints agree, and their values;
    bits that the node above has already are factored out, so that ``rest`` marks
    those it adds itself. A pair of nodes is opened on one side, then on the
    other, and the differences in the bits that come to be common on the way
    down are added up. A pair over ``radius`` is dropped with all that lies under
    it; one that cannot exceed it is linked whole; one that is in one component
    already is left. Fingerprints of two leaves are compared in one block.
    ``pruned`` counts these cases.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray) -> None:
        order = np.lexsort((gray_rank(fp), group))
        self.order, self.group, self.fp = order, group[order], fp[order]
        n = len(fp)
        self.label = np.arange(n)
        self.pruned = {"bits": 0, "groups": 0, "joined": 0, "whole": 0, "compared": 0}
        self.leaves = np.concatenate([self.fp, np.repeat(self.fp[-1:], -n % LEAF)]).reshape(-1, LEAF)
        self.pattern, self.mask, self.low, self.high = [], [], [], []
        pattern, mask, low, high, wide = self.fp, np.full(n, ~np.uint64(0)), self.group, self.group, LEAF
        while not self.pattern or len(pattern) > FANOUT:
            at = np.arange(0, len(pattern), wide)
            every, some = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern, at)
            mask = np.bitwise_and.reduceat(mask, at) & ~(every ^ some)
            pattern, low, high, wide = every & mask, np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), FANOUT
            for held, new in zip((self.pattern, self.mask, self.low, self.high), (pattern, mask, low, high), strict=True):
                held.append(new)
        above = [np.repeat(m, FANOUT)[: len(b)] for m, b in zip(self.mask[1:], self.mask, strict=False)]
        self.rest = [m & ~up for m, up in zip(self.mask, above, strict=False)]
        self._spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _merge(self, a: np.ndarray, b: np.ndarray) -> None:
        before, self.label = self.label, merged(self.label, a, b)
        if self.label is not before:
            self._spans.clear()

    def _joined(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs of nodes all of whose fingerprints are in one component already."""
        if level not in self._spans:
            at = np.arange(0, len(self.fp), LEAF * FANOUT**level)
            self._spans[level] = np.minimum.reduceat(self.label, at), np.maximum.reduceat(self.label, at)
        low, high = self._spans[level]
        return (low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j])

    def _open(self, level: int, one: np.ndarray, other_level: int, other: np.ndarray, acc: np.ndarray, radius: int) -> tuple:
        """Children of ``one`` (a level below) beside ``other``, with the differences added up, where these do not exceed ``radius``."""
        below = level - 1
        child = (one[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        other, acc = np.repeat(other, FANOUT), np.repeat(acc, FANOUT)
        there = child < len(self.pattern[below])
        if not there.all():
            child, other, acc = child[there], other[there], acc[there]
        meet = (self.low[below][child] <= self.high[other_level][other]) & (self.low[other_level][other] <= self.high[below][child])
        new = self.rest[below][child] & self.mask[other_level][other]
        acc = acc + np.bitwise_count((self.pattern[below][child] ^ self.pattern[other_level][other]) & new)
        near = acc <= radius
        keep = near & meet
        self.pruned["groups"] += int((~meet).sum())
        self.pruned["bits"] += int((meet & ~near).sum())
        return child[keep], other[keep], acc[keep]

    def _link_whole(self, level: int, i: np.ndarray, j: np.ndarray) -> None:
        """Link all fingerprints under each pair of nodes."""
        span, n = LEAF * FANOUT**level, len(self.fp)
        nodes = np.unique(np.concatenate([i, j]))
        at = (nodes[:, None] * span + np.arange(span - 1)).ravel()
        at = at[at < np.minimum(n, np.repeat((nodes + 1) * span, span - 1)) - 1]
        self._merge(np.concatenate([at, i * span]), np.concatenate([at + 1, j * span]))

    def _compare(self, i: np.ndarray, j: np.ndarray, radius: int) -> None:
        """Compare all fingerprints of each pair of leaves."""
        self.pruned["compared"] += len(i) * LEAF * LEAF
        differ = np.bitwise_count(self.leaves[i][:, :, None] ^ self.leaves[j][:, None, :])
        hit = np.flatnonzero(differ <= radius)
        if not len(hit):
            return
        pair, place = np.divmod(hit, LEAF * LEAF)
        a, b = i[pair] * LEAF + place // LEAF, j[pair] * LEAF + place % LEAF
        there = (a < b) & (b < len(self.fp))
        a, b = a[there], b[there]
        keep = self.group[a] == self.group[b]
        self._merge(a[keep], b[keep])

    def link(self, radius: int) -> np.ndarray:
        """Labels (positions) of the components of links within the groups."""
        n = len(self.fp)
        if n < 2:
            return self.label
        a = np.arange(n - 1)
        acc = np.bitwise_count(self.fp[1:] ^ self.fp[:-1]).astype(np.int64)
        a = a[(acc <= radius) & (self.group[1:] == self.group[:-1])]
        self._merge(a, a + 1)  # Gray neighbours first: dense groups then need few comparisons
        top = len(self.pattern) - 1
        i, j = np.triu_indices(len(self.pattern[top]))
        common = self.mask[top][i] & self.mask[top][j]
        acc = np.bitwise_count((self.pattern[top][i] ^ self.pattern[top][j]) & common).astype(np.int64)
        near = acc <= radius
        self.pruned["bits"] += int((~near).sum())
        stack = [(top, i[near], j[near], acc[near])]
        while stack:
            level, i, j, acc = stack.pop()
            if len(i) > CHUNK_PAIRS // (FANOUT * FANOUT if level else LEAF * LEAF):
                half = len(i) // 2
                stack += [(level, i[half:], j[half:], acc[half:]), (level, i[:half], j[:half], acc[:half])]
                continue
            keep = ~self._joined(level, i, j)
            self.pruned["joined"] += int((~keep).sum())
            i, j, acc = i[keep], j[keep], acc[keep]
            if len(i):
                free = np.bitwise_count(~(self.mask[level][i] & self.mask[level][j]))
                one_group = (self.low[level][i] == self.high[level][j]) & (self.high[level][i] == self.low[level][j])
                whole = (acc + free <= radius) & one_group
                if whole.any():
                    self.pruned["whole"] += int(whole.sum())
                    self._link_whole(level, i[whole], j[whole])
                    i, j, acc = i[~whole], j[~whole], acc[~whole]
            if not len(i):
                continue
            if not level:
                self._compare(i, j, radius)
                continue
            i, j, acc = self._open(level, i, level, j, acc, radius)
            j, i, acc = self._open(level, j, level - 1, i, acc, radius)
            half = i <= j
            stack.append((level - 1, i[half], j[half], acc[half]))
        return self.label


class WideIndex:
    """Wide fingerprints of two blocks, ``first`` of the one before those of the other, or of one block (``first`` is all).

    A link joins one of each block, or two of the only one. Of two fingerprints
    within ``bits``, one word at least differs in no more bits than the mean word,
    and one part of 16 bits of that word in no more than its mean part. So for each
    of the ``parts`` (of all, no link is lost), all pairs are compared whose part is that near, by the
    word it lies in, and those near by the word are verified by all words. Pairs
    are met a group at a time: rows of one block that agree in the first ``width`` bits of the part, and all rows
    of the other whose first bits are that near; ``width`` weighs pairs against groups.
    """

    def __init__(self, words: np.ndarray, first: int, radius: int, bits: int, parts: range | None = None) -> None:
        self.words, self.first, self.radius, self.bits = np.ascontiguousarray(words), first, radius, bits
        self.label = np.arange(len(words))
        self.compared = 0
        self.parts = range(4 * words.shape[1]) if parts is None else parts
        self.most = bits // words.shape[1]
        self._near: list[tuple[np.ndarray, np.ndarray]] = []
        self._waiting = 0
        self._differ, self._count = np.empty(WIDE_PAIRS, np.uint64), np.empty(WIDE_PAIRS, np.uint8)

    def _verify(self) -> None:
        """Link those of the pairs found near by a word that are near by all."""
        if self._near:
            i, j = (np.concatenate(x) for x in zip(*self._near, strict=True))
            self._near, self._waiting = [], 0
            apart = self.label[i] != self.label[j]
            i, j = i[apart], j[apart]
            differ = np.bitwise_count(self.words[i] ^ self.words[j])
            near = (differ.sum(axis=1, dtype=np.int64) <= self.bits) & (differ[:, 0] <= self.radius)
            self.label = merged(self.label, i[near], j[near])

    def _masks(self, count: float) -> tuple[int, np.ndarray]:
        """The bits of a part to group by where ``count`` pairs are to be met, and the masks of so few of them."""
        few = min(16, self.most // 4)
        masks = {w: [sum(1 << b for b in c) for k in range(min(few, w) + 1) for c in combinations(range(w), k)] for w in range(1, 17)}
        width = min(masks, key=lambda w: GROUP_PAIRS * (1 << w) + count * len(masks[w]) / (1 << w))
        return width, np.array(masks[width])

    def _compare(self, i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray) -> None:
        """Compare rows ``i`` with rows ``j`` by a word of each (``x``, ``y``), at most ``WIDE_PAIRS`` at once."""
        size = len(x) * len(y)
        differ = np.bitwise_xor(x[:, None], y, out=self._differ[:size].reshape(len(x), -1))
        hit = np.flatnonzero(np.bitwise_count(differ, out=self._count[:size].reshape(differ.shape)) <= self.most)
        self.compared += size
        if len(hit):
            row, place = np.divmod(hit, len(y))
            self._near.append((i[row], j[place]))
            self._waiting += len(hit)
            if self._waiting >= HELD_LINKS:
                self._verify()

    def _compare_many(self, i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray) -> None:
        """The same for more rows. Those joined already, as in a dense group, need not meet again."""
        step = max(1, WIDE_PAIRS // len(j))
        dense = len(i) * len(j) > 4 * WIDE_PAIRS
        for at in range(0, len(i), step):
            now = slice(at, at + step)
            if not dense:
                self._compare(i[now], x[now], j, y)
                continue
            label, count = np.unique(self.label[i[now]], return_counts=True)
            own = self.label[i[now]] == label[count.argmax()]
            rest = np.flatnonzero(self.label[j] != label[count.argmax()])
            for some, others in ((own, rest), (~own, slice(None))):
                i_now, x_now, j_now, y_now = i[now][some], x[now][some], j[others], y[others]
                for begin in range(0, len(j_now) if len(i_now) else 0, WIDE_PAIRS):
                    part = slice(begin, begin + WIDE_PAIRS)
                    self._compare(i_now, x_now, j_now[part], y_now[part])

    def link(self) -> np.ndarray:
        """Labels (positions) of the components of links."""
        alone = self.first == len(self.words)
        skip = 0 if alone else self.first
        width, masks = self._masks(self.first * (len(self.words) - skip) / (1 + alone))
        parts = self.words.view(np.uint16)
        for p in self.parts:
            value = parts[:, p] >> (16 - width)
            one, other = np.argsort(value[: self.first], kind="stable"), np.argsort(value[skip:], kind="stable") + skip
            one_word, other_word = self.words[one, p // 4], self.words[other, p // 4]
            upto = np.concatenate([[0], np.cumsum(np.bincount(value[: self.first], minlength=1 << width))])
            at = np.concatenate([[0], np.cumsum(np.bincount(value[skip:], minlength=1 << width))])
            groups = np.flatnonzero(np.diff(upto))
            begin = 0
            while begin < len(groups):  # so many groups at once, or as meet so many rows, one at least
                group = groups[begin : begin + GROUPS, None]
                sought = group ^ masks
                low = at[sought]
                count = (at[sought + 1] - low) * (sought >= group if alone else 1)
                ends = np.cumsum(count.sum(axis=1))
                done = max(1, int(np.searchsorted(ends, GROUPS * WIDE_PAIRS, "right")))
                begin += done
                low, count, ends = low[:done].ravel(), count[:done].ravel(), ends[:done]
                place = np.arange(ends[-1]) + np.repeat(low - np.cumsum(count) + count, count)
                j, y = other[place], other_word[place]
                edges = [0, *ends.tolist()]
                for g, lo, hi in zip(group[:done, 0].tolist(), edges, edges[1:], strict=False):
                    own = slice(upto[g], upto[g + 1])
                    if hi > lo:
                        size = (hi - lo) * (own.stop - own.start)
                        compare = self._compare if size <= WIDE_PAIRS else self._compare_many
                        compare(one[own], one_word[own], j[lo:hi], y[lo:hi])
            self._verify()
        return self.label


def _blocks(free: int, parts: int, bits: int) -> list[int]:
    """Masks of ``parts`` blocks of the bits in ``free``, at most ``bits`` of each."""
    places = [b for b in range(64) if free >> b & 1]
    edges = [len(places) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in places[lo : min(hi, lo + bits)]) for lo, hi in zip(edges, edges[1:], strict=False)]


def bucket_masks(count: int, radius: int, free: int = (1 << 64) - 1) -> list[int]:
    """Masks within ``free`` bits: any two of ``count`` fingerprints within ``radius`` agree under one of them."""
    bits = max(0, (max(count, 1) - 1) // BUCKET_ROWS).bit_length()
    if not bits:
        return [0]
    size = free.bit_count()
    for spare in range(1, 5):
        each = -(-bits // spare)
        if each <= size // (radius + spare) or spare == 4:
            found = [sum(c) for c in combinations(_blocks(free, radius + spare, each), spare)]
            return found if 2 * len(found) <= 1 << bits else [0]
    raise AssertionError


def bands(count: int, words: range = range(WIDE), most: int | None = None) -> list[tuple[int, int]]:
    """(word, mask) of the bands of ``count`` wide fingerprints, over all words in turn."""
    bits = min(32, max(BAND_BITS, ((max(count, 1) - 1) // BAND_ROWS).bit_length()))
    found = [(w, (1 << bits) - 1 << bits * i) for i in range(64 // bits) for w in words]
    return found[: BANDS if most is None else most]


def _keyed(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """Rows under each mask of their table ``t``; a table's masks are lists of (new table, mask)."""
    tables = F.create_map(
        *[x for t, own in masks.items() for x in (F.lit(t), F.array(*[F.struct(F.lit(n).alias("n"), F.lit(signed(m)).alias("m")) for n, m in own]))]
    )
    return rows.select("node", "fp", "more", F.explode(F.element_at(tables, F.col("t"))).alias("x")).select(
        "node", "fp", "more", F.col("x.n").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key")
    )


def parted(nodes: DataFrame, radius: int) -> DataFrame:
    """(node, fp, more, t, key): each fingerprint in its buckets (table t, key).

    A bucket beyond ``HOT_ROWS`` is replaced by buckets over bits that its members
    may still differ in, up to ``MAX_PARTED`` times. After that its members agree on
    all but some 24 bits at a radius of 4, and there are no more different values.
    """
    count = nodes.count()
    masks = bucket_masks(count, radius)
    used = dict(enumerate(masks))
    rows = _keyed(nodes.withColumn("t", F.lit(-1)), {-1: list(used.items())})
    if count <= HOT_ROWS:
        return rows
    done: DataFrame | None = None
    for _ in range(MAX_PARTED):
        hot = cut(rows.groupBy("t", "key").count().where(F.col("count") > HOT_ROWS))
        most = {r["t"]: r["n"] for r in hot.groupBy("t").agg(F.max("count").alias("n")).collect()}
        if not most:
            break
        cold = rows.join(hot.select("t", "key"), ["t", "key"], "left_anti").select("node", "fp", "more", "t", "key")
        done = cold if done is None else done.unionByName(cold)
        fresh: dict[int, list[tuple[int, int]]] = {}
        for t, n in sorted(most.items()):
            own = bucket_masks(n, radius, (1 << 64) - 1 & ~used[t])
            fresh[t] = [(len(used) + i, used[t] | m) for i, m in enumerate(own)]
            used |= dict(fresh[t])
        rows = _keyed(rows.join(hot.select("t", "key"), ["t", "key"], "left_semi"), fresh)
    return rows if done is None else done.unionByName(rows)


def near_links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): a spanning forest, by bucket, of nodes (``node``, ``fp``) within ``radius`` bits."""
    order = ["t", "key"]
    spread = parted(nodes, radius).repartition(*order).sortWithinPartitions(*order)

    def make():
        def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
            held: list[np.ndarray] = []
            rows = 0

            def search(part: np.ndarray) -> dict[str, list]:
                change = np.any(part[1:, 2:] != part[:-1, 2:], axis=1)
                index = GrayIndex(np.concatenate([[0], np.cumsum(change)]), part[:, 1].astype(np.uint64))
                label = index.link(radius)
                member = np.flatnonzero(label != np.arange(len(label)))
                node = part[index.order, 0]
                return {"a": node[member].tolist(), "b": node[label[member]].tolist()}

            for batch in batches:
                held.append(np.array([batch["node"], batch["fp"], batch["t"], batch["key"]], np.int64).T)
                rows += len(batch["fp"])
                if rows >= CHUNK_ROWS:
                    part = np.concatenate(held)
                    other = np.flatnonzero(np.any(part[:, 2:] != part[-1, 2:], axis=1))
                    if len(other):
                        done = int(other[-1]) + 1
                        yield search(part[:done])
                        part = part[done:]
                    held, rows = [part], len(part)
            if rows:
                yield search(np.concatenate(held))

        return run

    return map_stream(spread.select("node", "fp", *order), make, "a long, b long", rows=8192)


def wide_links(nodes: DataFrame, radius: int = NEAR_RADIUS, bits: int = NEAR_BITS) -> DataFrame:
    """(a, b): a spanning forest, by task, of nodes (``node``, ``fp``, ``more``) within ``bits`` over all (and ``radius`` of ``fp``).

    A task holds two blocks at most, of ``MOST_BLOCK`` rows or so. While pairs of blocks are
    few, each is dealt to several tasks by the parts of the fingerprints, so that a row goes to 16 tasks, or as many as there are blocks.
    """
    count = nodes.count()
    blocks = max(1, -(-count // MOST_BLOCK))
    pairs = blocks * (blocks + 1) // 2
    shares = 1 if count <= LEAST_BLOCK else next(s for s in (1, 2, 4, 8, 16) if pairs * s >= 16)
    own = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks * shares - 1))).alias("with")
    words = ["fp", *[F.element_at("more", w).alias(f"w{w}") for w in range(1, WIDE)]]
    other, share = F.floor(F.col("with") / shares).cast("int"), F.col("with") % shares
    least, most = F.least("own", other), F.greatest("own", other)
    task = (least * blocks - F.floor(least * (least - 1) / 2).cast("int") + most - least) * shares + share
    spread = nodes.select("node", *words, own.alias("own"), every).withColumns({"task": task, "second": (F.col("own") != least).cast("int")})
    spread = spread.repartitionById(pairs * shares, "task").sortWithinPartitions("task", "second")
    names = ["node", "fp", *[f"w{w}" for w in range(1, WIDE)]]
    alone = {(k * blocks - k * (k - 1) // 2) * shares + s for k in range(blocks) for s in range(shares)}

    def make():
        def search(task: int, held: list[np.ndarray], first: int) -> dict[str, np.ndarray]:
            rows = np.concatenate(held)
            held.clear()
            node, words = rows[:, 0].copy(), rows[:, 1:].astype(np.uint64)
            del rows
            if not first or (first == len(node) and task not in alone):
                return {"a": node[:0], "b": node[:0]}
            label = WideIndex(words, first, radius, bits, range(task % shares, 4 * WIDE, shares)).link()
            member = np.flatnonzero(label != np.arange(len(label)))
            return {"a": node[member], "b": node[label[member]]}

        def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, np.ndarray]]:
            held: list[np.ndarray] = []
            now, first = -1, 0
            for batch in batches:
                task, second = batch["task"].to_numpy(), batch["second"].to_numpy()
                rows = np.stack([batch[n].to_numpy() for n in names], axis=1)
                edges = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    if held and task[lo] != now:
                        yield search(now, held, first)
                        first = 0
                    if hi > lo:
                        now = int(task[lo])
                        held.append(rows[lo:hi])
                        first += int((second[lo:hi] == 0).sum())
            if held:
                yield search(now, held, first)

        return run

    return map_arrays(spread.select("task", "second", *names), make, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``."""
    prints = cut(fingerprints(docs, id_col, text_col, k).select("doc_id", "fp"))
    by_print = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = by_print.select(F.col("fp").alias("node"), "fp", F.lit(None).cast("array<long>").alias("more"))
    roots = connected_components(near_links(nodes, radius))
    in_component = by_print.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = in_component.groupBy("root").agg(F.min("least").alias("component_id"))
    names = cut(in_component.join(least, "root").select("fp", "component_id"))
    return prints.join(names, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = NEAR_SHINGLE,
    radius: int = NEAR_RADIUS,
    bits: int = NEAR_BITS,
) -> DataFrame:
    """The rows of ``docs`` with one document of each component of near-duplicates by wide fingerprints.

    The row with the smallest id stays (rows without an id come last); of rows
    with that id, the one with the least hash of its text; of equal rows, one.
    """
    prints = cut(fingerprints(docs, id_col, text_col, k, WIDE))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    by_print = cut(
        prints.groupBy("fp", "more").agg(F.min(row).alias("least")).withColumn("node", F.monotonically_increasing_id())
    )
    roots = connected_components(wide_links(by_print.select("node", "fp", "more"), radius, bits))
    in_component = by_print.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = in_component.groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.text_hash")
    found = prints.groupBy("doc_id", "text_hash").count()
    same = [F.col("k.doc_id").eqNullSafe(F.col("f.doc_id")), F.col("k.text_hash") == F.col("f.text_hash")]
    kept = cut(kept.alias("k").join(found.alias("f"), same).select("k.doc_id", "k.text_hash", "count"))
    text_hash, own_id, own_hash = free_names(docs, "text_hash", "own_id", "own_hash")
    hashed = docs.withColumn(text_hash, F.xxhash64(docs[text_col].cast("string")))

    def of(some: DataFrame) -> DataFrame:
        own = some.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash))
        return hashed.join(own, (hashed[text_hash] == own[own_hash]) & hashed[id_col].cast("long").eqNullSafe(own[own_id]), "left_semi")

    out = of(kept.where("count = 1"))
    repeated = kept.where("count > 1")
    if not repeated.isEmpty():
        out = out.unionByName(of(repeated).dropDuplicates([id_col, text_hash]))
    return out.select(*docs.columns)
