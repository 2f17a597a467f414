import random
import re
from collections import Counter
from itertools import combinations

import numpy as np

from cartolith.llm import quality as Q

from .helpers import WORD, documents, rows


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(2, 8)))
    good = [". ".join(" ".join(word() for _ in range(r.randint(5, 15))) for _ in range(r.randint(3, 12))) for _ in range(300)]
    junk = [" ".join(word() + r.choice(["###", "$$$", "|", "%%%"]) for _ in range(80)) for _ in range(40)]
    odd = [None, "", " \n\t", "a", "x y\nx y\n\n \nx y ", "a b c d e f g h " * 30, "a a a a a a a a a a", "w\x1cv \x85 z\u3000q", "p " * 50_000]
    return good, junk, odd


def test_statistics_like_brute_force(spark):
    good, junk, odd = texts()
    every = [*odd, *good[:30], *junk[:5]]
    for t in every:
        assert (*Q.statistics(t)[:5], Q.base_failed(Q.statistics(t))) == brute(t)
    found = Q.judge(Q.measure(documents(spark, every)), None)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert rows(found, *names) == [(i, *(b := brute(t)), not b[5]) for i, t in enumerate(every)]


def test_forest_drops_junk_and_keeps_good(spark):
    good, junk, odd = texts()
    docs = Q.measure(documents(spark, [*good, *junk, *odd]))
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 340, 2)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["kept"] for r in Q.judge(docs, Q.learn(docs, labels)).collect()}
    passed = [i for i, t in enumerate(good) if not brute(t)[5]]
    assert all(found[i] for i in passed) and not any(found[i] for i in range(300, 340))
    nothing = Q.measure(documents(spark, []))
    assert Q.learn(nothing, labels) is None and rows(Q.judge(nothing, None)) == []
    free = Q.learn(docs, labels.limit(0))
    assert free.threshold == np.inf


def test_scores_follow_paths():
    r = np.random.default_rng(1)
    x = r.uniform(0.0, 0.05, (300, 6)) * Q.HIGH
    far = np.array([[0.9, 0, 0, 19.0, 0.8, 0]])
    forest = Q.fit(x)
    assert forest.score(far)[0] > forest.score(x).max()


def test_repeated_documents_and_labels_count_once(spark):
    good, junk, _ = texts()
    many = [(i, t) for i, t in enumerate([*good, *junk])] + [(2, good[2])] * 200 + [(301, junk[1])] * 200
    labels = [(i, int(i < 300)) for i in range(0, 340, 2)] + [(2, 1), (302, 1), (302, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    once = Q.learn(Q.measure(documents(spark, [*good, *junk])), table)
    measured = Q.measure(documents(spark, many))
    again = Q.learn(measured, table)
    assert again.threshold == once.threshold and (again.split == once.split).all()
    verdicts = rows(Q.judge(measured, again), "doc_id", "kept")
    assert len(verdicts) == len(many) and verdicts.count((301, False)) == 201


def paths_by_draws(x, forest, size):
    """Mean path of each row over every draw of ``size`` rows, by walks down the trees."""
    total = np.zeros(len(x))
    draws = list(combinations(range(len(x)), size))
    for tree in range(len(forest.feature)):
        for drawn in draws:
            for i, row in enumerate(x):
                at, level, part = 0, 0, x[list(drawn)]
                while len(part) > 1 and at < forest.feature.shape[1]:
                    f, s = forest.feature[tree, at], forest.split[tree, at]
                    part = part[(part[:, f] < s) == (row[f] < s)]
                    at, level = 2 * at + (1 if row[f] < s else 2), level + 1
                total[i] += level + Q.average_path(len(part))
    return total / len(draws) / len(forest.feature)


def test_paths_are_means_over_all_draws():
    r = np.random.default_rng(3)
    x = r.uniform(0.0, 0.2, (7, 6)) * Q.HIGH
    x[1] = x[0]
    for size in (3, 7):
        forest = Q.fit(x, trees=4, subsample=size)
        want = 2.0 ** (-paths_by_draws(x, forest, size) / Q.average_path(size))
        assert np.allclose(forest.score(x), want)


def test_every_labelled_row_counts(spark):
    n, bad = 30_000, 300
    r = np.random.default_rng(4)
    x = np.concatenate([r.uniform(0.0, 0.05, (n, 6)), r.uniform(0.0, 0.4, (bad, 6))]) * Q.HIGH
    measured = spark.createDataFrame([(i, False, f) for i, f in enumerate(x.tolist())], "doc_id long, base_failed boolean, features array<double>")
    labels = spark.range(n + bad).selectExpr("id as doc_id", f"int(id < {n}) as quality")
    found, want = Q.learn(measured, labels), Q.fit(x[:n])
    assert (found.path == want.path).all()
    scores = want.score(x)
    least = np.sort(scores[:n])[::-1][int(Q.MAX_GOOD_LOSS * n)]
    above = scores[n:][scores[n:] > least]
    assert len(above) and found.threshold == (least + above.min()) / 2
    tied = spark.createDataFrame([(0.5, True)] * 5 + [(0.25, True), (0.5, False), (0.75, False)], "anomaly double, good boolean")
    assert Q.threshold(tied, 0.5) == 0.625 and Q.threshold(tied, 0.9) == 0.375 and Q.threshold(tied.where("good")) == np.inf
