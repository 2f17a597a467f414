import random

import corpus_pipeline
from cartolith.llm import bpe, langid, simhash

from .test_langid import corpus


def test_stages_like_plain_python(spark, tmp_path):
    texts, langs = corpus(150)
    r = random.Random(7)
    secret = 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"'
    texts[3] += " " + secret
    texts += [texts[5], texts[9], None, "", "42 42 42"]
    langs += [langs[5], langs[9], "en", "fr", "de"]
    rows = [(i, t, l, r.choice(["a", "b", None]), len(t or "")) for i, (t, l) in enumerate(zip(texts, langs, strict=True))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
        if k < 4:
            assert docs.columns == before.columns
    assert {x["doc_id"] for x in kept[0]} == set(range(152))
    found = simhash.near_duplicates(spark.read.parquet(f"{tmp_path}/0"))
    assert {x["doc_id"] for x in kept[1]} == {x["component_id"] for x in found.collect()}
    assert len(kept[1]) == len({x["doc_id"] for x in kept[1]}) and not {150, 151} & {x["doc_id"] for x in kept[1]}
    text = {x["doc_id"]: x["text"] for x in kept[2]}
    assert len(kept[2]) == len(kept[1])
    for x in kept[1]:
        assert text[x["doc_id"]] == x["text"].replace(secret, 'token = "[REDACTED:assigned]"')
    codec = bpe.codec(*bpe.default_vocabulary())
    assert sorted(x["doc_id"] for x in kept[3]) == sorted(x["doc_id"] for x in kept[4])
    words = sum(len(x["text"].split()) for x in kept[2])
    assert abs(sum(len(x["text"].split()) for x in kept[3]) - 1.5 * words) < 0.1 * words
    for x in kept[4]:
        assert codec.decode(x["ids"]).decode() == text[x["doc_id"]]
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.count() == len(kept[4]) and [n for n, _ in corpus_pipeline.STAGES][0] == "language_id"
    assert langid.held_out(final["doc_id"]) is not None


def test_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_clashing_columns_repeated_rows_and_a_long_text(spark, tmp_path):
    texts, langs = corpus(120)
    texts[7] = " ".join(texts[k] for k in range(0, len(texts), 4)) * 30  # one language, long
    langs[7] = langs[0]
    rows = [(i, t, la, "s", 1, "h", i, 2.5, i) for i, (t, la) in enumerate(zip(texts, langs, strict=True))]
    rows += [rows[3]] * 3 + [(None, *rows[5][1:])] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long, __text_hash__ string, own_id_0 long, copies_0 double, mark_0 long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        names, docs = docs.columns, stage(spark, docs, str(tmp_path))
        assert docs.columns == names
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    found = docs.collect()
    assert found and all(r["__text_hash__"] == "h" and r["copies_0"] == 2.5 and r["own_id_0"] == r["mark_0"] for r in found)
    assert {len(r["text"]) for r in found if r["doc_id"] == 7} <= {len(texts[7])} and None not in {r["doc_id"] for r in found}
    deduped = [r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/1").collect()]
    assert len(deduped) == len(set(deduped))
