import random

import numpy as np
import pytest

from cartolith.llm import mixing as M

from .helpers import WORD, documents, rows


def brute_targets(sizes):
    """Share and reshare until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = 1.5 * sum(sizes.values()), [s for s in names if sizes[s]]
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - 2 * sizes[s]) for s in open_)
        for s in open_:
            target[s] = min(target[s], 2 * sizes[s])
        open_ = [s for s in open_ if target[s] < 2 * sizes[s]]
    return target


def test_targets_totals_and_reruns(spark):
    r = random.Random(2)
    sources = [r.choice(["a", "b", "b", "b", "c", "d", "é", None]) for _ in range(600)]
    texts = [" ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 60))) for _ in sources]
    docs = documents(spark, texts, sources)
    for block in (4096, 16):
        found = M.mix(docs, block=block).collect()
        sizes = {}
        for t, s in zip(texts, sources, strict=True):
            sizes[s] = sizes.get(s, 0) + len(WORD.findall(t))
        want = brute_targets(sizes)
        assert len(found) == len(texts)
        taken = {}
        for x in found:
            assert x["size"] == len(WORD.findall(texts[x["doc_id"]])) and x["taken"] in (0, x["size"], 2 * x["size"])
            assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(want[x["source"]])
            taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
        for s in sizes:
            assert abs(taken[s] - want[s]) <= 30
        again = M.mix(docs.repartition(7), block=block)
        assert rows(again, "doc_id", "taken") == sorted((x["doc_id"], x["taken"]) for x in found)


def test_edges(spark):
    assert rows(M.mix(documents(spark, []))) == []
    empty = M.mix(documents(spark, [None, "", (None, " ")], [None, "a", "a"]))
    assert rows(empty, "size", "target", "taken") == [(0, 0.0, 0)] * 3
    same = documents(spark, [(7, "a b"), (7, "a b"), (7, "c"), (None, "d"), (None, "d")])
    mixed = M.mix(same)
    assert sum(x["taken"] for x in mixed.collect()) in (10, 11, 12, 13)
    assert M.repeat_documents(same, mixed).count() == sum(x["copies"] for x in mixed.collect())
    assert M.repeat_documents(same, mixed).columns == same.columns


def test_walk_keeps_totals():
    r = random.Random(1)
    units = [(i, float(r.randint(1, 9)), r.random()) for i in range(500)]
    walk = M.Walk(("t",))
    decided = dict(x for u in units for x in walk.add(*u))
    live = {u[0]: u[2] for u in walk.live}
    share = {**decided, **live}
    assert len(live) <= 2 and sum(share.values()) == pytest.approx(sum(u[2] for u in units))
    assert sum(share[u[0]] * u[1] for u in units) == pytest.approx(sum(u[1] * u[2] for u in units))
    drawn = [sum(dict(x for u in [(0, 2.0, 0.3), (1, 3.0, 0.6), (2, 7.0, 0.5)] for x in w.add(*u)).get(0, w.live[0][2] if w.live and w.live[0][0] == 0 else 0) for w in [M.Walk((k,))]) for k in range(2000)]
    assert sum(drawn) / 2000 == pytest.approx(0.3, abs=0.04)


def test_landing_keeps_probabilities_and_stays_near():
    r = np.random.default_rng(3)
    size, p = r.integers(5, 400, 9).astype(float), r.random(9)
    grid = (np.arange(20_000) + 0.5) / 20_000
    drawn = np.array([M.land(size, p, u) for u in grid])
    assert np.abs(drawn.mean(axis=0) - p).max() < 1e-3
    assert np.abs(drawn @ size - size @ p).mean() < size.mean()
    assert M.land(np.zeros(0), np.zeros(0), 0.3).tolist() == []
    assert M.land(np.array([3.0, 4.0]), np.array([0.0, 1.0]), 0.9).tolist() == [False, True]


def test_running_sums_over_ranges(spark):
    items = [(i * 7 % 50, float(i)) for i in range(50)]
    found = M.running(spark.createDataFrame(items, "k long, v double"), ["k"], {"s": "v"})
    total = 0.0
    for k, v in sorted(items):
        assert [x["s"] for x in found.where(f"k = {k}").collect()] == [total]
        total += v
        if k > 4:
            break


def test_many_equal_rows_and_long_texts(spark):
    docs = documents(spark, [(3, "a b c")] * 300 + [(4, "w " * 40_000)], ["x"] * 300 + ["y"])
    found = M.mix(docs, block=16).collect()
    assert len(found) == 301 and {x["size"] for x in found} == {3, 40_000}
    assert sum(x["taken"] for x in found if x["source"] == "x") == pytest.approx(found[0]["target"] if found[0]["source"] == "x" else found[-1]["target"], abs=6)
