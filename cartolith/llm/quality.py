"""Quality rules and an isolation forest on their statistics.

The base rules count words, symbols, repeated lines and repeated 8-word windows
over whole texts. The trees of the forest split the box of possible statistics
at random. They hold all good labelled rows (or, where there are none, all
documents), one row an id, so that a document which few splits
part from these has a short path and is anomalous. Splits run
over a node's box, not its rows: a statistic that is 0 in all good rows still
parts the others. So the splits are known before the rows, which are counted by
leaf on the executors. An isolation tree holds ``SUBSAMPLE`` rows; here none are
drawn, but each path is its mean over all draws of so many of the counted
rows. The threshold is calibrated on all labelled rows that pass the
base rules: it takes the most while at most ``MAX_GOOD_LOSS`` of the good ones go.

Defined cases: a null text has no words and fails the base rules; so does an
empty one. Repeated rows stay repeated; an empty table gives an empty result;
without labelled rows of both kinds the forest drops nothing. Of several labels
of a document the least counts; of rows that repeat an id one enters the fit. Texts
of any length are read whole. Only the id and text columns are read. The texts
are read once: :func:`measure` keeps their statistics as a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, map_batches, map_stream

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
TREES, SUBSAMPLE, SEED = 128, 256, 20
#: Levels of splits: four more than part so many rows.
DEPTH = 12
#: Share of good labelled rows that the threshold may drop.
MAX_GOOD_LOSS = 0.001
#: The statistics of the forest, and the box over which its trees split.
FEATURES = ("symbols", "duplicate_lines", "repeated_words", "word_length", "upper", "stutter")
LOW, HIGH = np.zeros(6), np.array([1.0, 1.0, 1.0, 20.0, 1.0, 1.0])


def repeated_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words that lie in windows of k words found twice or more."""
    n = len(words)
    if n <= k:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, n)
    windows = n - k + 1
    h = np.zeros(windows, np.uint64)
    for i in range(k):
        h = (h ^ ids[i : i + windows]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(windows, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    # a 64-bit hash of two different windows may agree: compare the words themselves
    seen: dict[bytes, int] = {}
    view = np.lib.stride_tricks.sliding_window_view(ids, k)
    texts = [view[i].tobytes() for i in at.tolist()]
    for t in texts:
        seen[t] = seen.get(t, 0) + 1
    edge = np.zeros(n + 1, np.int64)
    for i, t in zip(at.tolist(), texts, strict=True):
        if seen[t] > 1:
            edge[i] += 1
            edge[i + k] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the forest's features."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    upper = len(text) - len(text.translate(_NO_UPPER)) if n else 0
    stutter = sum(map(eq, words[1:], words))
    some = max(n, 1)
    features = [
        min(symbols / some, 1.0),
        dup / (len(lines) + 20),  # one repeated line of three says little
        repeat / (n + 200),
        min(chars / some, 20.0),
        upper / max(chars, 1),
        stutter / some,
    ]
    return n, chars, symbols, dup, repeat, features


def base_failed(s: tuple) -> bool:
    return s[0] < 20 or 100 * s[4] > 30 * s[0]


_NO_UPPER = dict.fromkeys(range(ord("A"), ord("Z") + 1))


def average_path(n: float) -> float:
    """Mean path of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Whole binary trees, a row a tree: nodes in the order of their levels, ``path`` of each leaf."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray | None = None
    norm: float = 1.0
    threshold: float = np.inf

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        tree = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        row = np.arange(len(x))[:, None]
        while len(x) and at[0, 0] < self.feature.shape[1]:
            at = 2 * at + np.where(x[row, self.feature[tree, at]] < self.split[tree, at], 1, 2)
        return at - self.feature.shape[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row: 2 to the power of minus its mean path over the usual one."""
        return 2.0 ** (-self.path[np.arange(len(self.feature))[None, :], self.leaf(x)].mean(axis=1) / self.norm)

    def counted(self, x: np.ndarray) -> np.ndarray:
        """Rows in each leaf of each tree."""
        trees, leaves = len(self.feature), self.feature.shape[1] + 1
        at = self.leaf(x) + np.arange(trees)[None, :] * leaves
        return np.bincount(at.ravel(), minlength=trees * leaves).reshape(trees, leaves)

    def hold(self, held: np.ndarray, subsample: int = SUBSAMPLE) -> Forest:
        """Set the paths by the rows in each leaf: means over all draws of ``subsample`` of these rows.

        A draw's path ends at the first node with fewer than two of its rows; at
        the last level the expected rest is added.
        """
        rows = int(held[0].sum())
        size = min(subsample, rows)
        self.path, self.norm = _by_count(held, lambda c: _drawn(c, rows, size) @ _RESTS[: size + 1]), average_path(size) or 1.0
        while held.shape[1] > 1:
            held = held.reshape(len(held), -1, 2).sum(axis=2)
            part = _by_count(held, lambda c: _drawn(c, rows, size, 1).sum(axis=1))
            self.path += np.repeat(1 - part, self.path.shape[1] // held.shape[1], axis=1)
        return self


def _by_count(held: np.ndarray, of) -> np.ndarray:
    """A function of a node's rows, computed once for each number, some at a time."""
    counts, place = np.unique(held, return_inverse=True)
    return np.concatenate([of(counts[i : i + 1024]) for i in range(0, len(counts), 1024)])[place.reshape(held.shape)]


_RESTS = np.array([average_path(k) for k in range(SUBSAMPLE + 1)])
_log_factorial = np.vectorize(lambda n: lgamma(n + 1.0), otypes=[float])


def _drawn(counts: np.ndarray, rows: int, size: int, most: int | None = None) -> np.ndarray:
    """Chance that 0, 1 ... ``most`` (else ``size``) of ``size`` rows drawn from ``rows`` are among so many of them."""
    k = np.arange((size if most is None else min(most, size)) + 1)[None, :]
    c = counts[:, None]
    can = (k <= c) & (size - k <= rows - c)
    inner, outer = np.where(can, c - k, 0), np.where(can, rows - c - size + k, 0)
    ways = _log_factorial(c) + _log_factorial(rows - c) - _log_factorial(inner) - _log_factorial(outer)
    ways = ways - _log_factorial(k) - _log_factorial(size - k)
    all_ways = lgamma(rows + 1.0) - lgamma(size + 1.0) - lgamma(rows - size + 1.0)
    return np.where(can, np.exp(np.where(can, ways - all_ways, 0.0)), 0.0)


def grow(trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
    """Random splits of the box from ``LOW`` to ``HIGH``, without rows."""
    rng = np.random.default_rng(seed)
    low, high = (np.broadcast_to(edge, (trees, 1, len(edge))) for edge in (LOW, HIGH))
    feature, split = [], []
    for _ in range(depth):
        f = rng.integers(len(LOW), size=low.shape[:2])[..., None]
        s = rng.uniform(np.take_along_axis(low, f, 2), np.take_along_axis(high, f, 2))
        feature.append(f[..., 0])
        split.append(s[..., 0])
        cut_at = np.arange(len(LOW)) == f
        low = np.stack([low, np.where(cut_at, s, low)], axis=2).reshape(trees, -1, len(LOW))
        high = np.stack([np.where(cut_at, s, high), high], axis=2).reshape(trees, -1, len(LOW))
    return Forest(np.concatenate(feature, axis=1), np.concatenate(split, axis=1))


def fit(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> Forest:
    """A forest that holds the rows ``x``."""
    forest = grow(trees, seed=seed)
    return forest.hold(forest.counted(x), subsample)


#: Parts of the range of scores that a pass over them counts.
BINS = 4096


def threshold(scored: DataFrame, loss: float = MAX_GOOD_LOSS) -> float:
    """A score that at most a share ``loss`` of the good rows of ``scored(anomaly, good)`` exceeds.

    It lies halfway from there to the least score of a low-quality row above,
    so that good rows like those seen keep their distance. The rank is found by
    passes, each of which counts the parts of a narrower range.
    """
    kept = scored.where("good")
    ends = kept.agg(F.count("*").alias("n"), F.min("anomaly").alias("low"), F.max("anomaly").alias("high")).first()
    if not ends["n"] or scored.where("not good").isEmpty():
        return np.inf
    low, high, left = ends["low"], ends["high"], int(loss * ends["n"])
    while low < high:
        part = F.floor((F.col("anomaly") - low) / (high - low) * BINS).alias("part")
        inside = kept.where(F.col("anomaly").between(low, high)).groupBy(part)
        found = inside.agg(F.count("*").alias("n"), F.min("anomaly").alias("low"), F.max("anomaly").alias("high")).collect()
        for r in sorted(found, key=lambda r: -r["part"]):
            if left < r["n"]:
                low, high = r["low"], r["high"]
                break
            left -= r["n"]
    above = scored.where(~F.col("good") & (F.col("anomaly") > low)).agg(F.min("anomaly")).first()[0]
    return low if above is None else (low + above) / 2


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the base counts, base_failed, features) of each row, as a table of about 120 bytes a row."""
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def make():
        def step(c: dict[str, list]) -> dict[str, list]:
            found = [statistics(t) for t in c["text"]]
            out: dict[str, list] = {"doc_id": c["doc_id"]} | {n: [s[i] for s in found] for i, n in enumerate(COUNTS)}
            return out | {"base_failed": [base_failed(s) for s in found], "features": [s[5] for s in found]}

        return step

    counts = ", ".join(f"{n} long" for n in COUNTS)
    return cut(map_batches(narrow, make, f"doc_id long, {counts}, base_failed boolean, features array<double>"))


def _matrix(c: dict[str, list]) -> np.ndarray:
    return np.array(c["features"], float).reshape(-1, len(FEATURES))


def _held(rows: DataFrame, forest: Forest) -> np.ndarray:
    """Rows in each leaf of each tree, counted on the executors."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def make():
        def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
            held = sum(shared.value.counted(_matrix(c)) for c in batches)
            at = np.flatnonzero(held)
            yield {"at": at.tolist(), "n": np.ravel(held)[at].tolist()}

        return run

    counts = map_stream(rows.select("features"), make, "at int, n long", rows=2048).groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros((len(forest.feature), forest.feature.shape[1] + 1), np.int64)
    held.ravel()[counts["at"].to_numpy()] = counts["n"].to_numpy()
    return held


def learn(measured: DataFrame, labels: DataFrame) -> Forest | None:
    """A calibrated forest from :func:`measure`'s table; None if there is nothing to fit on.

    All labelled rows that pass the base rules count; only without good ones
    among them, all rows that pass.
    """
    passed = measured.where(~F.col("base_failed"))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    least = F.min("features").alias("features")
    rows = cut(passed.join(known, "doc_id").groupBy("doc_id", "quality").agg(least).select("features", (F.col("quality") > 0).alias("good")))
    forest = grow()
    held = _held(rows.where("good"), forest)
    labelled = held.any()
    if not labelled:
        held = _held(passed.groupBy("doc_id").agg(least), forest)
    if not held.any():
        return None
    forest.hold(held)
    if labelled:
        forest.threshold = threshold(_scored(rows, forest))
    return forest


def _scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """(anomaly, good) of each labelled row, as a table."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def make():
        return lambda c: {"anomaly": shared.value.score(_matrix(c)).tolist(), "good": c["good"]}

    return cut(map_batches(rows.select("features", "good"), make, "anomaly double, good boolean"))


def judge(measured: DataFrame, forest: Forest | None) -> DataFrame:
    """Counts, base rules, anomaly and verdict of each row of :func:`measure`'s table."""
    shared = measured.sparkSession.sparkContext.broadcast(forest)
    names = ["doc_id", *COUNTS, "base_failed"]

    def make():
        own = shared.value

        def step(c: dict[str, list]) -> dict[str, list]:
            x = _matrix(c)
            anomaly = own.score(x) if own is not None and len(x) else np.zeros(len(x))
            limit = own.threshold if own is not None else np.inf
            kept = ~np.array(c["base_failed"], bool) & ~(anomaly > limit)
            return {n: c[n] for n in names} | {"anomaly": anomaly.tolist(), "kept": kept.tolist()}

        return step

    counts = ", ".join(f"{n} long" for n in COUNTS)
    return map_batches(
        measured.select(*names, "features"), make, f"doc_id long, {counts}, base_failed boolean, anomaly double, kept boolean"
    )
