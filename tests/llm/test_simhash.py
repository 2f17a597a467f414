import random

import numpy as np
import xxhash

from cartolith.llm import components, simhash as S

from .helpers import WORD, documents, rows


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, radius=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def texts():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    out = [None, "", " \t\n", "One", "one two", "ONE two three", "é É\x1cx", "a b c d", "A B\nC\tD"]
    for _ in range(25):
        base = [word() for _ in range(r.randint(60, 300))]
        for _ in range(r.randint(1, 4)):
            copy = list(base)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out + out[20:30]


def test_fingerprints_and_components(spark):
    all_texts = texts()
    prints = [brute_print(t) for t in all_texts]
    assert [S.fingerprint(t) for t in all_texts] == prints
    found = S.near_duplicates(documents(spark, all_texts))
    want = [(i, f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, brute_components(prints), strict=True))]
    assert rows(found, "doc_id", "fingerprint", "component_id") == want


def test_edges(spark):
    assert rows(S.near_duplicates(documents(spark, []))) == []
    found = S.near_duplicates(documents(spark, [(None, "x y"), (5, "x y"), (5, "x y"), (9, None), (None, "q")]))
    assert sorted(map(str, rows(found, "doc_id", "component_id"))) == ["(5, 5)", "(5, 5)", "(9, 9)", "(None, 5)", "(None, None)"]
    kept = S.keep_one(documents(spark, [(3, "a"), (2, "a"), (2, "a"), (8, "b"), (None, "a"), (None, "n"), (2, "other"), (9, None), (7, "")]))
    assert rows(kept, "doc_id", "text") == [(None, "n"), (2, "a"), (2, "other"), (7, ""), (8, "b")]
    assert rows(S.keep_one(documents(spark, []))) == []
    long = "w " * 140_000  # more shingles than are hashed at once
    assert S.fingerprint(long) == S.fingerprint("w w w w")


def brute_wide(text, k=5):
    """Words of a wide fingerprint, by plain numbers."""
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    out = []
    for w in range(S.WIDE):
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        if w:
            top = 1 << 64
            hs = [(h + 0x9E3779B97F4A7C15 * w) * int(S._MIX) % top for h in hs]
            hs = [(h ^ h >> 30) * int(S._MIX) % top for h in hs]
            hs = [h ^ h >> 31 for h in hs]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    return out


def test_keep_one_by_wide_fingerprints(spark):
    all_texts = texts()
    wide = [brute_wide(t) for t in all_texts]
    assert [S.wide_fingerprint(t, 5, S.WIDE) for t in all_texts] == wide
    root = list(range(len(wide)))
    for _ in wide:
        for i, a in enumerate(wide):
            for j, b in enumerate(wide):
                if (a[0] ^ b[0]).bit_count() <= S.NEAR_RADIUS and sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True)) <= S.NEAR_BITS:
                    root[i] = root[j] = min(root[i], root[j])
    kept = rows(S.keep_one(documents(spark, all_texts)), "doc_id")
    assert kept == [(i,) for i in sorted(set(root))] and len(kept) < len(all_texts)


def test_index_prunes_by_shared_bits_and_links_dense_groups_whole():
    r = np.random.default_rng(2)
    fp = np.unique(r.integers(0, 1 << 63, 6000, dtype=np.uint64))
    index = S.GrayIndex(np.zeros(len(fp), np.int64), fp)
    label = index.link(4)
    assert index.pruned["bits"] > 0 and index.pruned["compared"] < len(fp) ** 2 / 2
    near = np.bitwise_count(index.fp[:, None] ^ index.fp[None, :]) <= 4
    a, b = np.nonzero(near)
    assert (label[a] == label[b]).all() and len(np.unique(label)) >= len(fp) - (near.sum() - len(fp)) // 2
    dense = np.arange(64, dtype=np.uint64) << np.uint64(3)
    index = S.GrayIndex(np.zeros(64, np.int64), dense)
    assert not index.link(4).any()
    index = S.GrayIndex(np.zeros(32, np.int64), dense[:32])
    index._link_whole(0, np.array([0]), np.array([1]))
    assert not index.label.any()


def test_index_loses_no_link():
    r = np.random.default_rng(6)
    centres = r.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2)
    prints = []
    for c in centres:
        for _ in range(60):
            flips = r.choice(64, r.integers(0, 4), replace=False)
            prints.append(int(c) ^ sum(1 << int(b) for b in flips))
    fp = np.array(sorted(set(prints)), np.uint64)
    group = (np.arange(len(fp)) % 2).astype(np.int64)
    index = S.GrayIndex(group, fp)
    label = index.link(4)
    for g in (0, 1):
        own = index.fp[index.group == g]
        comps = brute_components([int(x) for x in own])
        assert len(set(comps)) == len(set(label[index.group == g].tolist()))
    assert (np.diff(S.gray_rank(np.arange(64, dtype=np.uint64) ^ (np.arange(64, dtype=np.uint64) >> np.uint64(1))).astype(int)) == 1).all()


def test_buckets_meet_every_near_pair():
    r = random.Random(8)
    for count in (10, 1 << 30, 1 << 45):
        masks = S.bucket_masks(count, 4)
        for _ in range(300):
            flips = sum(1 << b for b in r.sample(range(64), 4))
            assert any(not flips & m for m in masks)


def nodes(spark, prints):
    return spark.createDataFrame([(S.signed(p), S.signed(p), None) for p in prints], "node long, fp long, more array<long>")


def test_hot_buckets_are_parted_whole(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 16)
    monkeypatch.setattr(S, "HOT_ROWS", 40)
    r = random.Random(9)
    base = r.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in r.sample(range(12), 3)) for _ in range(150)} | {r.getrandbits(64) for _ in range(50)})
    roots = components.connected_components(S.near_links(nodes(spark, prints)))
    want = brute_components(prints)
    assert len({x["root"] for x in roots.collect()}) == len({c for c in want if want.count(c) > 1})
    dealt = S.parted(nodes(spark, prints), 4)
    assert dealt.select("fp").distinct().count() == len(prints) and dealt.select("t").distinct().count() > 5


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(0, 60) if i != 30] + [(5, 5), (7, 6)]
    found = components.connected_components(spark.createDataFrame(links, "a long, b long"))
    assert rows(found, "node", "root") == [(i, 0 if i <= 30 else 31) for i in range(61)]
    assert rows(components.connected_components(spark.createDataFrame([], "a long, b long"))) == []


def test_small_tables_compare_no_more_than_all_pairs():
    for count in (10, 9_296, 30_000, 100_000, 10**6):
        masks = S.bucket_masks(count, 4)
        each = 1 << max(m.bit_count() for m in masks)
        assert len(masks) * count * (count / each) <= count * count / (1 if masks == [0] else 2)
    assert S.bucket_masks(9_296, 4) == [0] and len(S.bucket_masks(10**6, 4)) == 5


def similar(r, words, share):
    """The words with some replaced, so that about ``share`` of all 5-word shingles agree."""
    out = list(words)
    for i in r.sample(range(len(out)), round(len(out) * (1 - share) / (1 + share) / 4.6)):
        out[i] = f"new{r.random()}"
    return out


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_recall_of_near_copies_through_bands(spark, monkeypatch):
    r = random.Random(12)
    base = [[f"w{r.randint(0, 3000)}" for _ in range(r.randint(150, 400))] for _ in range(400)]
    copies = [similar(r, b, r.uniform(0.82, 0.95)) for b in base]
    near = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in zip(base, copies, strict=True)]
    docs = documents(spark, [" ".join(t) for t in [*base, *copies]])
    for rows_, hot in ((16, 1 << 17), (16, 20), (1 << 15, 1 << 17)):
        monkeypatch.setattr(S, "BAND_ROWS", rows_)
        monkeypatch.setattr(S, "HOT_ROWS", hot)
        kept = {x["doc_id"] for x in S.keep_one(docs).collect()}
        assert kept >= set(range(400))  # no clean document goes
        wanted = [i for i, x in enumerate(near) if x >= 0.8]
        recall = sum(400 + i not in kept for i in wanted) / len(wanted)
        print(f"near copies of similarity 0.8 or more: {len(wanted)}, found {recall:.3f}")
        assert len(wanted) > 300 and recall >= 0.9
    assert all(len(S.bands(n)) <= 21 for n in (10**5, 10**8, 10**10))


def test_helper_columns_do_not_clash(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "x"])
    names = ["text_hash_0", "own_id_0", "__text_hash__", "own_hash_0"]
    for n in names:
        docs = docs.withColumn(n, S.F.lit(n))
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns and {tuple(x[n] for n in names) for x in kept.collect()} == {tuple(names)} and kept.count() == 2


def wide_prints(n=1200, seed=21):
    """Wide fingerprints in groups around centres, some at the very limits, some alike in the first word alone."""
    r = np.random.default_rng(seed)
    out = r.integers(0, 1 << 64, (n, S.WIDE), dtype=np.uint64)
    for i in range(0, n - 3, 4):
        for j, (first, rest) in enumerate(((20, 26), (21, 25), (int(r.integers(0, 21)), int(r.integers(20, 30)))), 1):
            flips = np.concatenate([r.choice(64, first, replace=False), 64 + r.choice(192, rest, replace=False)])
            out[i + j] = out[i]
            for b in flips:
                out[i + j, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return out


def brute_wide_components(prints):
    root = np.arange(len(prints))
    for i in range(len(prints)):
        differ = np.bitwise_count(prints[i] ^ prints).astype(int)
        for j in np.flatnonzero((differ[:, 0] <= S.NEAR_RADIUS) & (differ.sum(axis=1) <= S.NEAR_BITS)):
            root[root == max(root[i], root[j])] = min(root[i], root[j])
    return root.tolist()


def test_wide_search_is_exact_at_any_size(spark, monkeypatch):
    prints = wide_prints()
    want = brute_wide_components(prints)
    assert 300 < len(set(want)) < 1000
    rows_ = [(i, S.signed(int(p[0])), [S.signed(int(x)) for x in p[1:]]) for i, p in enumerate(prints)]
    frame = spark.createDataFrame(rows_, "node long, fp long, more array<long>")
    monkeypatch.setattr(S, "BAND_ROWS", 1)
    for least, most, at_once, held in ((1 << 14, 1 << 20, 1 << 16, 1 << 16), (200, 1 << 20, 100, 1), (50, 100, 1 << 16, 7)):
        for name, value in (("LEAST_BLOCK", least), ("MOST_BLOCK", most), ("WIDE_PAIRS", at_once), ("HELD_LINKS", held)):
            monkeypatch.setattr(S, name, value)
        roots = {x["node"]: x["root"] for x in components.connected_components(S.wide_links(frame)).collect()}
        assert [roots.get(i, i) for i in range(len(prints))] == want


def test_keep_one_does_not_depend_on_other_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAST_BLOCK", 16)
    monkeypatch.setattr(S, "BAND_ROWS", 1)
    r = random.Random(31)
    base = [[f"w{r.randint(0, 3000)}" for _ in range(r.randint(60, 120))] for _ in range(300)]
    copies = [similar(r, b, r.uniform(0.68, 0.76)) for b in base]  # about the limit, where bands miss the most
    all_texts = [" ".join(t) for t in [*base, *copies]]
    prints = np.array([S.wide_fingerprint(t, S.NEAR_SHINGLE, S.WIDE) for t in all_texts], np.uint64)
    want = brute_wide_components(prints)
    assert len(set(want)) < len(want)
    assert rows(S.keep_one(documents(spark, all_texts)), "doc_id") == [(i,) for i in sorted(set(want))]


def test_equal_words_need_no_more_memory_than_a_chunk():
    prints = wide_prints(400, 3)
    prints[:, 1] = 0  # all pairs meet in four parts
    index = S.WideIndex(prints, 150, S.NEAR_RADIUS, S.NEAR_BITS)
    label = index.link()
    differ = np.bitwise_count(prints[:150, None] ^ prints[None, 150:]).astype(int)
    a, b = np.nonzero((differ[..., 0] <= S.NEAR_RADIUS) & (differ.sum(axis=2) <= S.NEAR_BITS))
    assert index.compared >= 4 * 150 * 250 and (label[a] == label[150 + b]).all()


def test_each_pair_of_blocks_is_a_task_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAST_BLOCK", 1200)
    monkeypatch.setattr(S, "MOST_BLOCK", 100)
    r = np.random.default_rng(23)
    prints = np.repeat(r.integers(0, 1 << 64, (1, S.WIDE), dtype=np.uint64), 1200, axis=0)
    for i, w, b in zip(range(1200), r.integers(0, S.WIDE, 1200).tolist(), r.integers(0, 64, 1200).tolist(), strict=True):
        prints[i, w] ^= np.uint64(1) << np.uint64(b)
    rows_ = [(i, S.signed(int(p[0])), [S.signed(int(x)) for x in p[1:]]) for i, p in enumerate(prints)]
    links = S.wide_links(spark.createDataFrame(rows_, "node long, fp long, more array<long>"))
    assert links.select(S.F.spark_partition_id()).distinct().count() == 12 * 13 // 2


def test_a_link_may_lie_in_any_bits(spark, monkeypatch):
    r = np.random.default_rng(17)
    prints = np.repeat(r.integers(0, 1 << 64, (40, S.WIDE), dtype=np.uint64), 2, axis=0)
    for k in range(40):  # 46 bits or 47, all of them in one word for a fourth, 21 and more in the first word for some others
        bits = np.arange(64) + 64 * (k % 4) if k < 20 else np.concatenate([r.permutation(64)[: 21 + k % 20], 64 + r.permutation(192)[:40]])
        for b in bits[: 46 + (k % 5 == 0)]:
            prints[2 * k + 1, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    rows_ = [(i, S.signed(int(p[0])), [S.signed(int(x)) for x in p[1:]]) for i, p in enumerate(prints)]
    frame = spark.createDataFrame(rows_, "node long, fp long, more array<long>")
    want = [(2 * k + 1, 2 * k) for k in range(40) if k % 5]
    for least, most in ((16_384, 1 << 20), (10, 1 << 20), (10, 30), (10, 15)):
        monkeypatch.setattr(S, "LEAST_BLOCK", least)
        monkeypatch.setattr(S, "MOST_BLOCK", most)
        roots = components.connected_components(S.wide_links(frame))
        assert sorted((x["node"], x["root"]) for x in roots.collect() if x["node"] != x["root"]) == want
