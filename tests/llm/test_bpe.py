import random

import public_tokenizers as P

from cartolith.llm import bpe

from .helpers import documents, rows, sha

PATH, PATTERN = P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def test_chunks_encode_like_whole_texts():
    codec = bpe.codec(PATH, PATTERN)
    r = random.Random(1)
    parts = ["a", "b", " ", "\n", "'s", "1", "é", "  ", ".", "中", "\U0001f600", "ab12", "\t", "\u3000", "\x1c", "<|endoftext|>"]
    for _ in range(500):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 200)))
        ids = codec.encode(text, r.randint(1, 40), r.randint(1, 10))
        assert ids == codec.inner.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_long_pretokens():
    codec = bpe.codec(PATH, PATTERN)
    for text in ("a" * 3000, "xyz" * 2000, " " * 5000, " " * 5000 + "a", "\n" * 4000 + " b", "x" * 100_000):
        ids = codec.encode(text)
        assert codec.decode(ids) == text.encode()
        if len(text) < 10_000:
            assert ids == codec.inner.encode_ordinary(text)


def test_tables(spark):
    codec = bpe.codec(PATH, PATTERN)
    texts = [None, "", "Hello  world\n", "Hello  world\n", "naïve " * 9000]
    docs = documents(spark, texts)
    found = rows(bpe.round_trip(docs, PATH, PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in enumerate(texts):
        ids = codec.inner.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert found == want
    decoded = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN)
    assert [bytes(r["bytes"]).decode() for r in decoded.orderBy("doc_id").collect()] == [t or "" for t in texts]
    assert rows(bpe.round_trip(documents(spark, []), PATH, PATTERN)) == []


def test_chunks_as_rows_meet_again(spark):
    """Long texts, dealt out as rows, encode like the library; some have no seam in an overlap."""
    codec = bpe.codec(PATH, PATTERN)
    r = random.Random(4)
    parts = ["word", "b", " ", "\n", "'s", "12", "é", "   ", ".", "中", "\U0001f600", "ab12", "\t", "　", "\x1c", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 400))) for _ in range(60)]
    texts += ["x" * 1000, " " * 700 + "a", "a" * 300 + " word" * 100, None, "", "é " * 500, "é " * 500]
    docs = documents(spark, [(i if i % 9 else None, t) for i, t in enumerate(texts)])
    found = rows(bpe.round_trip(docs, PATH, PATTERN, keep_ids=True, chunk=64, overlap=16), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")
    want = []
    for i, t in enumerate(texts):
        ids = codec.inner.encode_ordinary(t or "")
        want.append((i if i % 9 else None, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()), ids))
    assert sorted(map(str, found)) == sorted(map(str, want))
    again = bpe.encode(docs, PATH, PATTERN, chunk=64, overlap=16)
    assert sorted(str((x["doc_id"], x["ids"])) for x in again.collect()) == sorted(str((w[0], w[4])) for w in want)
