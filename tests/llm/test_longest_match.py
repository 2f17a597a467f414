import random

import numpy as np
import pytest

from cartolith.llm import longest_match as M
from cartolith.llm import suffixes as S

from .helpers import documents, rows, sha

BIG = (1 << 63) - 1


def brute(docs, length):
    """Rows (doc_id, n_bytes, n_removed, n_spans, sha of what is kept) by a dictionary of all strings."""
    first = {}
    for d, t in docs:
        data = (t or "").encode()
        for i in range(len(data) - length + 1):
            own = (BIG if d is None else d, i)
            first[data[i : i + length]] = min(first.get(data[i : i + length], own), own)
    out = []
    for d, t in docs:
        data = (t or "").encode()
        away = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < (BIG if d is None else d, i):
                away[i : i + length] = True
        spans = int(away[:1].sum()) + int((away[1:] & ~away[:-1]).sum())
        out.append((d, len(data), int(away.sum()), spans, sha(np.frombuffer(data, np.uint8)[~away].tobytes())))
    return sorted(out, key=repr)


def found(docs, length, gram):
    got = M.remove_repeats(docs, length=length, gram=gram).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in got), key=repr)


def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(20) for _ in range(5)]
    texts = [f"{prose(r.randint(0, 40))} {r.choice(passages)} {prose(r.randint(0, 40))}" for _ in range(40)]
    copies = [texts[3], texts[3], texts[7][:90], texts[9] + " tail", "x" + texts[9]]
    odd = [None, "", "a", "ab" * 300, "ab" * 300 + "c", "z" * 70, "yx" * 33, prose(30) * 6, passages[0]]
    return [*texts, *copies, *odd, *[f"{prose(3)}|{passages[1]}|{prose(3)}" for _ in range(60)]]


@pytest.mark.parametrize(("length", "gram"), [(40, 12), (16, 16), (33, 1)])
def test_like_brute_force(spark, length, gram):
    docs = list(enumerate(corpus()))
    random.Random(1).shuffle(docs)
    assert found(documents(spark, docs), length, gram) == brute(docs, length)


def test_repeated_and_null_ids_and_empty_table(spark):
    texts = corpus()
    docs = [(i % 9 if i % 4 else None, t) for i, t in enumerate(texts[:60])] + [(2, texts[5])] * 4
    assert found(documents(spark, docs), 40, 12) == brute(docs, 40)
    assert found(documents(spark, []), 40, 12) == []


def test_hot_keys_and_keys_of_many_kinds_change_nothing(spark, monkeypatch):
    docs = list(enumerate(corpus()))
    frame, exact = documents(spark, docs), brute(docs, 40)
    hot = M.hot_keys(M.named_texts(frame)[1], 40, 12, share=0.2)
    assert len(hot) and len(M.hot_keys(M.named_texts(frame)[1], 40, 12, share=1.0)) == 0
    monkeypatch.setattr(M, "hot_keys", lambda *_: hot)
    assert found(frame, 40, 12) == exact
    monkeypatch.setattr(M, "hot_keys", lambda *_: np.zeros(0, np.int64))
    runs = M.runs(M.named_texts(frame)[1], np.zeros(0, np.int64), 40, 12)
    assert runs.where("n < 0").count()
    for most in (2, 5):
        monkeypatch.setattr(M, "HOT", most)
        assert found(frame, 40, 12) == exact


def test_slices_of_long_texts(spark, monkeypatch):
    r = random.Random(2)
    passage = "".join(r.choice("abcdefgh ") for _ in range(700))
    text = "".join(r.choice("abcdefgh ") for _ in range(4000))
    docs = [(0, text + passage), (1, passage[100:] + text[:2000]), (2, "q" * 600 + passage)]
    batches = [{"doc": [d for d, _ in docs], "twin": [0, 0, 0], "data": [t.encode() for _, t in docs]}]
    as_arrow = [{k: M.pa.array(v) for k, v in b.items()} for b in batches]
    monkeypatch.setattr(M, "SLICE", 256)
    seen = {}
    for data, edges, doc, _, offset in M._sliced(iter(as_arrow), 40):
        key, first, n = M.keyed_runs(np.frombuffer(data, np.uint8), edges, 40, 12)
        of = np.searchsorted(edges, first, side="right")
        assert n.max() <= 40 - 12 + 1
        for i, k in enumerate(of.tolist()):
            begin = int(first[i] - (edges[k - 1] if k else 0) + offset[k])
            for j in range(int(n[i])):
                assert (int(doc[k]), begin + j) not in seen
                seen[int(doc[k]), begin + j] = int(key[i])
    assert len(seen) == sum(len(t) - 39 for _, t in docs)
    by_string = {}
    for (d, i), key in seen.items():
        assert by_string.setdefault(docs[d][1][i : i + 40], key) == key


def test_longest_previous_factors_of_any_length():
    r = np.random.default_rng(5)
    for letters, n in ((1, 60), (2, 200), (3, 300), (26, 100)):
        data = r.integers(97, 97 + letters, n).astype(np.uint8)
        length = 24
        at = np.arange(n - length)
        levels = S.ranks(data, length)
        order = S.suffix_order(levels, at, at, length)
        text = data.tobytes()
        cut = [text[i : i + length] for i in at]
        assert [cut[i] for i in order] == sorted(cut)
        common = lambda a, b: next((k for k in range(length) if cut[a][k] != cut[b][k]), length)
        shared = S.common_prefix(levels, at[order][:-1], at[order][1:], length)
        assert shared.tolist() == [common(a, b) for a, b in zip(order, order[1:])]
        lpf = np.zeros(len(at), int)
        lpf[order] = S.longest_previous(at[order], np.concatenate([[0], shared]))
        assert lpf.tolist() == [max((common(i, j) for j in range(i)), default=0) for i in at]


def test_digests(spark):
    got = M.digests(documents(spark, [(1, "a" * 150), (2, "b" * 99)]))
    assert rows(got) == [(1, 150, 149, 1, sha(b"a")), (2, 99, 0, 0, sha(b"b" * 99))]
    assert [t for _, t in got.dtypes] == ["bigint"] * 4 + ["string"]
