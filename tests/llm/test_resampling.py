import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np

from cartolith.llm import resampling as R
from cartolith.llm import words as W

from .helpers import documents, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def grams(text):
    w = TERM.findall((text or "").translate(LOWER))
    return len(w), w + [" ".join(p) for p in zip(w, w[1:])]


def brute(docs, target, percent=25, least=20, seed=7):
    """Rows (doc_id, n_features, weight, score, rank) by plain loops over strings."""
    bucket = lambda f: crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, t in docs for f in grams(t)[1])
    t = Counter(bucket(f) for x in target for f in grams(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    found = []
    for d, text in docs:
        n, fs = grams(text)
        weight = math.floor(sum(gain(bucket(f)) for f in fs) / len(fs)) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        found.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    able = sorted((x for x in found if x[5]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for k, x in enumerate(able[: percent * len(able) // 100], 1):
        x[4] = k
    return [tuple(x[:5]) for x in found]


def given():
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abçdeF9ß") for _ in range(r.randint(1, 4)))
    sep = lambda: r.choice([" ", ", ", "\n", "-", "_", "\x7f"])
    texts = ["".join(word() + sep() for _ in range(r.randint(0, 60))) for _ in range(80)]
    odd = [None, "", " \n", "one", "A " * 20, "a " * 19, "x　y z " * 9, "q" * 300, "Ünder_Score 12ab " * 12]
    return [(i, t) for i, t in enumerate([*texts, *odd, *texts[:3]])] + [(5, texts[5]), (5, texts[5]), (5, texts[6]), (None, texts[7]), (None, texts[8])]


def ordered(found):
    return sorted(found, key=repr)


def test_like_brute_force_with_ties_nulls_and_repeats(spark):
    docs, target = given(), [t for _, t in given()[:9]] + [None, ""]
    for percent in (25, 100, 0):
        got = R.resample(documents(spark, docs), spark.createDataFrame([(0, t) for t in target], "item_id int, text string"), percent)
        assert ordered(tuple(r) for r in got.collect()) == ordered(brute(docs, target, percent))
    assert [t for _, t in got.dtypes] == ["bigint"] * 5


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = given()
    assert rows(R.resample(none, documents(spark, docs[:3]))) == []
    assert ordered(tuple(r) for r in R.resample(documents(spark, docs), none).collect()) == ordered(brute(docs, []))


def test_pieces_cut_no_word_and_lose_no_pair(monkeypatch):
    text = ("Añb 12,c" * 50 + " " + "x" * 40 + " ") * 7
    whole = R.features(text.encode())
    table = W.byte_table(digits=True)
    assert [w.decode() for p in W.pieces(text.encode(), table, 16) for w in p] == TERM.findall(text.translate(LOWER))
    monkeypatch.setattr(R, "pieces", lambda t, table: W.pieces(t, table, 16))
    cut = R.features(text.encode())
    assert cut[0] == whole[0] and np.array_equal(np.sort(np.concatenate(cut[1])), np.sort(np.concatenate(whole[1])))
    assert Counter(np.concatenate(whole[1]).tolist()) == Counter(crc32(f.encode()) % 10_000 for f in grams(text)[1])
