import random
import re
from collections import Counter

import numpy as np
import pytest

from cartolith.llm import divergence as D

from .helpers import documents

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, top=200, least=3):
    """Rows of both parts by plain dictionaries; docs are (text, lang, source)."""
    docs = [tuple(x or "" for x in d) for d in docs]
    out = []
    for lang in {d[1] for d in docs}:
        own = [(TERM.findall(t.translate(LOWER)), s) for t, la, s in docs if la == lang]
        df = Counter(x for w, _ in own for x in set(w))
        kept = sorted(x for x, n in df.items() if n >= least)
        v = len(kept)
        groups = {s: Counter() for _, s in own}
        for w, s in own:
            groups[s].update(w)
        total = Counter(x for w, _ in own for x in w)

        def shares(c):
            n = sum(c[x] for x in kept)
            return {x: 1 + 10**9 * (c[x] + 1) // (n + v) for x in kept}

        f = lambda p, q: (p - q) ** 2 // q
        p, q = {s: shares(c) for s, c in groups.items()}, shares(total)
        for s in groups:
            pairs = sorted(((-sum(f(p[s][x], p[o][x]) for x in kept), o) for o in groups if o != s), key=lambda x: (x[0], x[1].encode()))
            out += [(lang, s, "pair", o, -y, r) for r, (y, o) in enumerate(pairs, 1)]
            terms = sorted(((-f(p[s][x], q[x]), x) for x in kept if groups[s][x] and p[s][x] > q[x]), key=lambda x: (x[0], x[1].encode()))
            out += [(lang, s, "term", x, -y, r) for r, (y, x) in enumerate(terms[:top], 1)]
    return sorted(out)


def given():
    r = random.Random(8)
    words = ["".join(r.choice("abcß") for _ in range(r.randint(1, 4))) for _ in range(60)]
    sources = ["a", "b", "Ü", "", None, "c", "d", "e", "lone"]
    docs = []
    for i in range(150):
        s = r.choice(sources[:8])
        text = " ".join(r.choice(words[hash(str(s)) % 7 :] if i % 2 else words) for _ in range(r.randint(0, 30)))
        docs.append((r.choice([text, text.upper(), text.replace(" ", "_9-")]), r.choice(["en", "en", "de", None]), s))
    odd = [(None, "en", "silent"), ("", "fr", "x"), ("once upon", "fr", "y"), ("one", "it", "only"), (" ", None, None)]
    return [*docs, *odd, docs[0], docs[0]]


@pytest.mark.parametrize(("seats", "top"), [(64, 200), (2, 3), (3, 200), (1, 5)])
def test_like_brute_force(spark, seats, top):
    docs = given()
    frame = documents(spark, [t for t, _, _ in docs], [s for _, _, s in docs], [la for _, la, _ in docs])
    got = D.audit(frame, seats=seats, top=top)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, top)
    assert [t for _, t in got.dtypes] == ["string"] * 4 + ["bigint", "int"]


def test_empty_table_and_no_terms(spark):
    assert D.audit(documents(spark, [])).collect() == []
    docs = [("a b", "en", "x"), ("c", "en", "y"), (None, "en", "z")]
    frame = documents(spark, [t for t, _, _ in docs], [s for _, _, s in docs], [la for _, la, _ in docs])
    assert sorted(tuple(r) for r in D.audit(frame).collect()) == brute(docs)
    assert {r[4] for r in brute(docs)} == {0}


def test_shares_are_exact_beyond_products_of_64_bits():
    r = random.Random(1)
    for below in (7, 10**6 + 3, 10**12 + 39, 9 * 10**15):
        count = np.array([0, below // 3, below - 2, *[r.randrange(below - 1) for _ in range(50)]])
        assert D.share(count, below - 5, 5).tolist() == [1 + 10**9 * (c + 1) // below for c in count.tolist()]


def test_counts_are_sent_on_in_parts(spark, monkeypatch):
    docs = given()
    frame = documents(spark, [t for t, _, _ in docs], [s for _, _, s in docs], [la for _, la, _ in docs])
    monkeypatch.setattr(D, "HELD", 40)
    assert any(len(t or "") > 40 for t, _, _ in docs)
    assert sorted(tuple(r) for r in D.audit(frame).collect()) == brute(docs)
