import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cartolith.llm import langid as L

from .helpers import documents, rows


def kneser_ney(texts, order, alphabet):
    """A plain interpolated Kneser-Ney model: a function of (context, character)."""
    top = Counter()
    for t in texts:
        padded = " " * (order - 1) + t[1:]
        top.update(padded[i : i + order] for i in range(len(padded) - order + 1))
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount = {}
    for n, c in counts.items():
        n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
        discount[n] = n1 / (n1 + 2 * n2) if n1 else 0.75

    def p(context, ch, n):
        if n == 0:
            return 1 / (alphabet + 1)
        context = context[len(context) - n + 1 :]
        follow = {g: v for g, v in counts[n].items() if g[:-1] == context}
        total = sum(follow.values())
        if not total:
            return p(context, ch, n - 1)
        return max(follow.get(context + ch, 0) - discount[n], 0) / total + discount[n] * len(follow) / total * p(context, ch, n - 1)

    return p


def test_model_is_interpolated_kneser_ney():
    order = 3
    data = {"x": [" abra cadabra ", " bar cab "], "y": [" zyx abz zzy ", " xyz "]}
    counts = {}
    for lang, texts in data.items():
        c = Counter()
        for t in texts:
            padded = " " * (order - 1) + t[1:]
            c.update(padded[i : i + order] for i in range(len(padded) - order + 1))
        grams = sorted(c)
        counts[lang] = (np.array([[ord(x) for x in g] for g in grams], np.uint32), np.array([c[g] for g in grams]))
    model = L.fit(counts, order)
    alphabet = len({ch for texts in data.values() for t in texts for ch in t})
    for text in ("abra", "zab cad", "qq"):
        h, n = model.entropies(text)
        padded = " " * (order - 1) + text + " "
        for k, lang in enumerate(("x", "y")):
            p = kneser_ney(data[lang], order, alphabet)
            want = 0.0
            for i in range(order - 1, len(padded)):
                if padded[i] == "q":
                    continue
                want -= np.log(p(padded[i - order + 1 : i], padded[i], order))
            if "q" not in text:
                assert h[k] * n == pytest.approx(want, rel=1e-4)


def corpus(n=400):
    r = random.Random(3)
    stems = {"en": "the and ing tion er th wh of".split(), "fr": "le eau oi que ment é tre des".split(), "de": "sch ung ein keit der ß ü und".split()}
    texts, langs = [], []
    for _ in range(n):
        lang = r.choice(sorted(stems))
        texts.append(" ".join("".join(r.choices(stems[lang], k=r.randint(1, 3))) for _ in range(r.randint(5, 60))))
        langs.append(lang)
    return texts, langs


def test_held_out_accuracy(spark):
    texts, langs = corpus()
    docs = documents(spark, [*texts, None, "", "123 !!", "E" * 300_000], None, [*langs, "en", None, "de", None])
    model = L.learn(docs, ~L.held_out(docs["doc_id"]))
    found = {r["doc_id"]: r for r in L.identify(docs, model).collect()}
    out = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(found[i]["lang_pred"] == langs[i] for i in out) >= 0.98 * len(out)
    assert not any(found[i]["rejected"] for i in range(len(texts)))
    for i in range(len(texts), len(texts) + 3):
        assert (found[i]["lang_pred"], found[i]["score"], found[i]["rejected"]) == ("und", 0.0, True)
    assert found[len(texts) + 3]["rejected"] and all(0 <= r["score"] <= 1 for r in found.values())
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(texts)
    assert rows(docs.select("doc_id", L.held_out(docs["doc_id"]).alias("h")).where("h"), "doc_id") == [(i,) for i in range(404) if zlib.crc32(str(i).encode()) % 3 == 1]


def test_edges(spark):
    nothing = documents(spark, [])
    model = L.learn(nothing, ~L.held_out(nothing["doc_id"]))
    assert rows(L.identify(nothing, model)) == []
    assert rows(L.identify(documents(spark, ["abc", "1"]), model), "lang_pred", "rejected") == [("und", False), ("und", True)]


def top_counts(texts, order):
    c = Counter()
    for t in texts:
        padded = " " * (order - 1) + t[1:]
        c.update(padded[i : i + order] for i in range(len(padded) - order + 1))
    grams = sorted(c)
    return np.array([[ord(x) for x in g] for g in grams], np.uint32), np.array([c[g] for g in grams])


def test_pruned_model_keeps_statistics_and_sums_to_one():
    order, r = 3, random.Random(4)
    words = lambda stems, n: " " + " ".join("".join(r.choices(stems, k=3)) for _ in range(n)) + " "
    counts = {"big": top_counts([words("abcdefgh", 400)], order), "small": top_counts([words("ghij", 6)], order)}
    whole = L.fit(counts, order)
    pruned = L.fit(counts, order, 60)
    assert all(len(k) <= 60 for k in pruned.keys) and len(whole.keys[2]) > 200
    for n in range(order):  # what is kept has the probability of the whole model
        at = L._find(whole.keys[n], pruned.keys[n])
        assert (at >= 0).all() and np.allclose(pruned.log_p[n], whole.log_p[n][at], atol=1e-5)
    small = L._rows(counts["small"][0])
    assert (L._find(pruned.keys[2], small) >= 0).sum() >= min(30, len(small))
    alphabet = [ord(c) for c in " abcdefghij?"]  # "?" stands for any unknown one
    for context in ("ab", "gh", "ij", "hj", "  ", "ag"):
        for k in range(2):
            total = 0.0
            for ch in alphabet:
                code, log = np.array([*map(ord, context), ch], np.uint32), 0.0
                for n in range(order, 0, -1):
                    at = L._find(pruned.keys[n - 1], L.hashes(code[-n:], n))[0]
                    if at >= 0:
                        log += pruned.log_p[n - 1][at, k]
                        break
                    if n == 1:
                        log += pruned.unknown[k]
                        break
                    place = L._find(pruned.contexts[n - 1], L.hashes(code[-n:-1], n - 1))[0]
                    log += pruned.log_backoff[n - 1][place, k] if place >= 0 else 0.0
                total += np.exp(log)
            assert total == pytest.approx(1, abs=1e-3)
    with pytest.raises(ValueError, match="too few"):
        L.fit(counts, order, 1)


def test_no_language_is_lost(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_GRAMS", 400)
    texts, langs = corpus(150)
    texts += ["žluť kůň", "čeř ďáb", "ŵyth llŷn", "12", "34"]
    docs = documents(spark, texts, None, [*langs, "cs", "cs", "cy", "zz", "zz"])
    with pytest.warns(UserWarning, match="zz"):
        model = L.learn(docs, docs["doc_id"].isNotNull())
    assert model.languages == ["cs", "cy", "de", "en", "fr"] and all(len(k) <= 400 for k in model.keys)
    found = {r["doc_id"]: r["lang_pred"] for r in L.identify(docs, model).collect()}
    assert [found[i] for i in range(150, 153)] == ["cs", "cs", "cy"]
    assert sum(found[i] == langs[i] for i in range(150)) >= 145
