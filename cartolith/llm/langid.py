"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays.

Texts are lower-cased, each run of other characters than letters becomes one
space, and a space stands before and after. For each language the counts of
``ORDER``-grams over a bounded sample of labelled training documents give an
interpolated Kneser-Ney model: lower orders use continuation counts, and the
discount of an order is n1 / (n1 + 2 n2), both from all n-grams of the sample.
Beyond ``MAX_GRAMS`` of an order, each language keeps its most frequent ones up
to an equal share (what small languages leave goes to the others), with the
suffixes of longer ones first; kept n-grams have the probability of the whole
model, and back-off weights give the rest to the others. The models of all languages share
one sorted array of 64-bit n-gram hashes per order, with a row of log
probabilities and of back-off weights per entry. A text gets the language of
least cross-entropy per character; the score is a softmax over these with a
temperature fitted on calibration documents, and a text is ``rejected`` when
its cross-entropy lies beyond what calibration documents show.

Defined cases: a null text or one without letters is ``und`` with score 0 and
rejected. Ties take the first language by code point. Repeated rows stay
repeated; an empty table gives an empty result; without any labelled document
every text is ``und``. A language without a document to fit on is fitted on its
calibration documents; one without any letter is left out with a warning, and
more languages than n-grams raise an error. Rows that repeat id and text enter the
sample once. Texts of any length are scored whole. A null id counts as the empty text for the split.
Language, source and id are never inputs of a prediction.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, map_batches

#: Characters of the longest n-gram.
ORDER = 5
#: Documents a language from which models are fitted, and on which they are calibrated (expected numbers).
FIT_DOCS, CALIBRATION_DOCS = 1500, 400
#: n-grams kept of each order, dealt to the languages; bounds the broadcast at about 24 bytes + 8 a language each.
MAX_GRAMS = 400_000
#: Characters scored at once.
_SLICE = 1 << 18
_ALPHA = np.array([chr(i).isalpha() for i in range(0x10000)])
_BASE = np.uint64(0x9E3779B97F4A7C15)


def codes(text: str | None) -> np.ndarray:
    """Code points of the normalised text; empty if it has no letter."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _ALPHA[np.minimum(raw, 0xFFFF)]
    wide = np.flatnonzero(raw > 0xFFFF)
    if len(wide):
        letter = letter.copy()
        letter[wide] = [chr(i).isalpha() for i in raw[wide].tolist()]
    if not letter.any():
        return raw[:0]
    out = np.concatenate([[32], np.where(letter, raw, 32), [32]]).astype(np.uint32)
    return out[np.concatenate([[True], (out[1:] != 32) | (out[:-1] != 32)])]


def hashes(code: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n-gram, by its first position."""
    h = np.full(max(0, len(code) - n + 1), n, np.uint64)
    for k in range(n):
        h = (h ^ code[k : k + len(h)]) * _BASE
        h ^= h >> np.uint64(29)
    return h


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted array, -1 where missing."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _rows(grams: np.ndarray) -> np.ndarray:
    """Hashes of the rows of an array of n-grams."""
    n = grams.shape[1]
    h = np.full(len(grams), n, np.uint64)
    for k in range(n):
        h = (h ^ grams[:, k]) * _BASE
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Model:
    """Log probabilities of all languages; index 0 of the lists is order 1."""

    languages: list[str]
    keys: list[np.ndarray]
    log_p: list[np.ndarray]
    contexts: list[np.ndarray]  # of each order, hashes of its contexts (one character less)
    log_backoff: list[np.ndarray]
    unknown: np.ndarray
    temperature: float = 10.0
    limit: float = np.inf

    def entropies(self, text: str | None) -> tuple[np.ndarray | None, int]:
        """Cross-entropy in nats a character for each language, and the number of characters."""
        code = codes(text)
        n = len(code)
        if not n or not self.languages:
            return None, n
        order = len(self.keys)
        total = np.zeros(len(self.languages))
        padded = np.concatenate([np.full(order - 1, 32, np.uint32), code[1:]])
        for start in range(0, n - 1, _SLICE):
            part = padded[start : start + _SLICE + order - 1]
            todo = np.arange(len(part) - order + 1)  # by the first position of the longest n-gram
            for k in range(order, 0, -1):
                own = hashes(part, k)[todo + order - k]
                at = _find(self.keys[k - 1], own)
                hit = at >= 0
                total += self.log_p[k - 1][at[hit]].sum(axis=0, dtype=np.float64)
                todo = todo[~hit]
                if not len(todo):
                    break
                if k == 1:
                    total += len(todo) * self.unknown
                    break
                context = _find(self.contexts[k - 1], hashes(part, k - 1)[todo + order - k])
                total += self.log_backoff[k - 1][context[context >= 0]].sum(axis=0, dtype=np.float64)
        return -total / (n - 1), n - 1

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, cross-entropy and whether it is rejected."""
        h, n = self.entropies(text)
        if h is None:
            return "und", 0.0, 0.0, not n
        best = int(np.argmin(h))
        weights = np.exp(-self.temperature * (h - h[best]))
        return self.languages[best], float(1 / weights.sum()), float(h[best]), bool(h[best] > self.limit + 4 / np.sqrt(n))


def _sums(group: np.ndarray, size: int, weights: np.ndarray) -> np.ndarray:
    return np.bincount(group, weights=weights, minlength=size)


def _levels(grams: np.ndarray, count: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams and counts of each order, order 1 first; below the highest, the number of characters before."""
    out = [(grams, count)]
    for _ in range(order - 1):
        _, first, count = np.unique(_rows(grams[:, 1:]), return_index=True, return_counts=True)
        grams = grams[first, 1:]
        out.append((grams, count))
    return out[::-1]


def _cap(sizes: np.ndarray, room: int) -> int:
    """The largest number of n-grams a language with which all languages fit into ``room``."""
    for i, size in enumerate(ordered := np.sort(sizes).tolist()):
        if size * (len(ordered) - i) > room:
            return room // (len(ordered) - i)
        room -= size
    return ordered[-1]


def fit(counts: Mapping[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, max_grams: int = MAX_GRAMS) -> Model:
    """A model from each language's distinct n-grams of the highest order (rows of codes) and their counts.

    ``counts`` is read a language at a time, up to three times; what is held is bounded by ``max_grams``.
    """
    languages = sorted(counts)
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    sizes = np.zeros((order, len(languages)), int)
    seen: set[int] = set()
    for k, lang in enumerate(languages):
        levels = _levels(*counts[lang], order)
        sizes[:, k] = [len(grams) for grams, _ in levels]
        seen.update(levels[0][0][:, 0].tolist())
        if sizes[-1].sum() <= 2 * max_grams:
            held[lang] = levels
    caps = [_cap(own, max_grams) for own in sizes]
    if not min(caps):
        raise ValueError(f"{max_grams} n-grams are too few for {len(languages)} languages")

    def of(lang: str) -> list[tuple[np.ndarray, np.ndarray]]:
        return held.get(lang) or _levels(*counts[lang], order)

    chosen: list[list[np.ndarray]] = [[] for _ in range(order)]
    for lang in languages:
        needed = np.zeros(0, np.uint64)  # the suffixes of what is kept; caps do not fall with shorter n-grams
        for n, (grams, count) in reversed(list(enumerate(of(lang), 1))):
            if len(grams) > caps[n - 1]:
                own = _rows(grams)
                grams = grams[np.lexsort((own, -count, ~np.isin(own, needed)))[: caps[n - 1]]]
            chosen[n - 1].append(grams)
            needed = _rows(grams[:, 1:])
    uniform = 1.0 / (len(seen) + 1)
    keys: list[np.ndarray] = []
    probs: list[np.ndarray] = []
    contexts: list[np.ndarray] = []
    backoffs: list[np.ndarray] = []
    places: list[tuple[np.ndarray, np.ndarray]] = []  # of each n-gram: its suffix in the order below, its context
    for n in range(1, order + 1):
        every = np.concatenate(chosen[n - 1])
        key, first = np.unique(_rows(every), return_index=True)
        gram, chosen[n - 1] = every[first], []
        before = np.unique(_rows(gram[:, :-1])) if n > 1 else key[:0]
        places.append((_find(keys[-1], _rows(gram[:, 1:])), _find(before, _rows(gram[:, :-1]))) if n > 1 else (key[:0], key[:0]))
        keys.append(key)
        contexts.append(before)
        probs.append(np.zeros((len(key), len(languages))))
        backoffs.append(np.ones((len(before), len(languages))))
    unknown = np.full(len(languages), uniform)
    for k, lang in enumerate(languages):
        for n, (grams, count) in enumerate(of(lang), 1):
            p, back, before, (suffix, prefix) = probs[n - 1][:, k], backoffs[n - 1][:, k], contexts[n - 1], places[n - 1]
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 else 0.75
            _, context = np.unique(_rows(grams[:, :-1]), return_inverse=True) if n > 1 else (0, np.zeros(len(grams), int))
            size = context.max() + 1 if len(context) else 0
            mass = _sums(context, size, count)
            share = discount * _sums(context, size, np.ones(len(count))) / mass
            at = _find(keys[n - 1], _rows(grams))
            hit = at >= 0
            direct = np.maximum(count - discount, 0) / mass[context]
            p[at[hit]] = direct[hit]
            if n == 1:
                p += share[0] * uniform
                unknown[k] = share[0] * uniform if share[0] else uniform * 1e-3
                if not hit.all():
                    unknown[k] = max(1 - p.sum(), 1e-9) / (len(seen) + 1 - len(p))
            else:
                place = _find(before, _rows(grams[:, :-1]))
                back[place[place >= 0]] = np.maximum(share[context[place >= 0]], 1e-9)
                below = probs[n - 2][suffix, k]
                p += back[prefix] * below
                if not hit.all():  # what was left out of a context gets its mass by back-off
                    partly = np.unique(place[(place >= 0) & ~hit])
                    left, lower = (1 - _sums(prefix, len(before), x)[partly] for x in (p, below))
                    back[partly] = np.maximum(left, 1e-9) / np.maximum(lower, 1e-9)
            np.maximum(p, 1e-12, out=p)
    return Model(
        languages,
        keys,
        [np.log(p).astype(np.float32) for p in probs],
        contexts,
        [np.log(b).astype(np.float32) for b in backoffs],
        np.log(np.maximum(unknown, 1e-12)),
    )


def calibrate(model: Model, measured: list[tuple[list[float], int, str]]) -> None:
    """Set the temperature of scores and the limit of rejection from (entropies, characters, language)."""
    found = [(h, n, model.languages.index(lang)) for h, n, lang in measured if lang in model.languages]
    if not found:
        return
    h, truth = np.array([x[0] for x in found]), np.array([x[2] for x in found])
    size = np.array([x[1] for x in found])

    def loss(t: float) -> float:
        z = -t * (h - h.min(axis=1, keepdims=True))
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]))

    model.temperature = min((1.0, 2.0, 5.0, 10.0, 20.0, 50.0), key=loss)
    excess = h[np.arange(len(h)), truth] - 4 / np.sqrt(size)
    model.limit = float(np.quantile(excess, 0.999) + max(0.5, 3 * np.std(excess)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def learn(
    docs: DataFrame,
    trainable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    fit_docs: int = FIT_DOCS,
    calibration_docs: int = CALIBRATION_DOCS,
    order: int = ORDER,
) -> Model:
    """Fit and calibrate on a bounded sample, by hash, of each language's trainable documents."""
    rows = docs.where(trainable & docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(
        docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang")
    )
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], [], [], [], [], np.zeros(0))
    scale = 1_000_000
    place = F.pmod(F.xxhash64(F.lit("langid"), F.col("id"), F.length("text")), F.lit(scale))
    share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit((fit_docs + calibration_docs) * scale / v))])
    part = F.lit(fit_docs / (fit_docs + calibration_docs))
    upto = F.least(F.element_at(share, F.col("lang")), F.lit(float(scale)))
    sampled = cut(rows.withColumns({"place": place, "upto": upto}).where("place < upto").dropDuplicates(["id", "text", "lang"]))
    fitting = sampled.where(F.col("place") < F.col("upto") * part).select("text", "lang")
    rest = sampled.where(F.col("place") >= F.col("upto") * part).select("text", "lang")

    def make():
        def step(c: dict[str, list]) -> dict[str, list]:
            texts: dict[str, list[np.ndarray]] = {}
            pad = np.full(order - 1, 32, np.uint32)
            for text, lang in zip(c["text"], c["lang"], strict=True):
                if len(code := codes(text)):
                    texts.setdefault(lang, []).append(np.concatenate([pad, code[1:]]))
            out: dict[str, list] = {"lang": [], "gram": [], "n": []}
            for lang, parts in texts.items():
                code = np.concatenate(parts)
                inside = np.concatenate([np.arange(len(p)) < len(p) - order + 1 for p in parts])
                at = np.flatnonzero(inside[: len(code) - order + 1])
                _, first, n = np.unique(hashes(code, order)[at], return_index=True, return_counts=True)
                grams = code[at[first][:, None] + np.arange(order)]
                raw = np.ascontiguousarray(grams, "<u4").tobytes()
                out["gram"] += [raw[i : i + 4 * order] for i in range(0, len(raw), 4 * order)]
                out["n"] += n.tolist()
                out["lang"] += [lang] * len(n)
            return out

        return step

    def count(some: DataFrame) -> DataFrame:
        return cut(map_batches(some, make, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))

    counted = count(fitting)
    for another in (True, False):
        found = {r["lang"] for r in counted.select("lang").distinct().collect()}
        lost = sorted(set(sizes) - found)
        if lost and another:
            counted = counted.unionByName(count(rest.where(F.col("lang").isin(lost))))
        elif lost:
            warnings.warn(f"languages without letters are not modelled: {lost}", stacklevel=2)
        if not lost:
            break
    if not found:
        return Model([], [], [], [], [], np.zeros(0))
    model = fit(_Counts(counted, sorted(found), order), order, MAX_GRAMS)
    calibrate(model, _entropies(rest, model))
    return model


class _Counts(Mapping):
    """n-grams and counts by language, read when asked for: the driver holds one language beside the models."""

    def __init__(self, counted: DataFrame, languages: list[str], order: int):
        self.counted, self.languages, self.order = counted, languages, order

    def __getitem__(self, lang: str) -> tuple[np.ndarray, np.ndarray]:
        own = self.counted.where(F.col("lang") == lang).select("gram", "n").toArrow()
        raw = b"".join(b"".join(c.to_pylist()) for c in own["gram"].chunks)
        return np.frombuffer(raw, "<u4").reshape(-1, self.order), own["n"].to_numpy().astype(np.int64)

    def __iter__(self) -> Iterator[str]:
        return iter(self.languages)

    def __len__(self) -> int:
        return len(self.languages)


def _entropies(rest: DataFrame, model: Model) -> list[tuple[list[float], int, str]]:
    """Entropies, characters and language of the calibration documents; their number is bounded by the sample's."""
    shared = rest.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def step(c: dict[str, list]) -> dict[str, list]:
            found = [own.entropies(t) for t in c["text"]]
            return {"h": [h.tolist() if h is not None else None for h, _ in found], "n": [n for _, n in found], "lang": c["lang"]}

        return step

    found = map_batches(rest.select("text", "lang"), make, "h array<double>, n long, lang string").where("h is not null").collect()
    return sorted((list(r["h"]), r["n"], r["lang"]) for r in found)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) for each row."""
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def step(c: dict[str, list]) -> dict[str, list]:
            found = [own.predict(t) for t in c["text"]]
            return {"doc_id": c["doc_id"]} | {
                name: [x[i] for x in found] for i, name in enumerate(("lang_pred", "score", "cross_entropy", "rejected"))
            }

        return step

    return map_batches(
        narrow, make, f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean"
    )


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def make():
        own = shared.value

        def step(c: dict[str, list]) -> dict[str, list]:
            keep = [i for i, t in enumerate(c[text_col]) if not own.predict(t)[3]]
            return {n: [c[n][i] for i in keep] for n in names}

        return step

    return map_batches(docs, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
