import hashlib
import zlib

from pyspark.sql import functions as F

from cartolith.llm import warc as W

from .helpers import pages, rows


def items():
    big, other = "é" * 600, "y" * 1000
    return [
        (1, "http://www.a.com/x?y#z", big), (4, "http://a.com/", big), (3, "http://b.org/\t\\n", big), (2, "http://a.com/", "small"), (5, "http://a.com/", "small"),
        (6, None, None), (7, "", ""), (8, "u" * 3000, other), (8, "again", other), (9, "z", other), (10, "w", "y" * 999), (11, "v", "y" * 999),
        (None, "n1", "q" * 2000), (None, "n2", "q" * 2000), (12, "line\r\nbreak", "t" * 300_000),
    ]


def test_round_trip_is_exact(spark):
    archive = W.write(pages(spark, items()))
    found = W.find(archive, archive.captures)
    want = []
    named = {}
    for i, _, html in items():
        if i is not None and len((html or "").encode()) >= 1000:
            named[html] = max(i, named.get(html, i))
    seen = set()
    for i, _, html in items():
        raw = (html or "").encode()
        refers = named.get(html) if len(raw) >= 1000 else None
        if refers == i and (i, html) not in seen:
            refers = None
        seen.add((i, html))
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    assert rows(found.drop("url", "payload")) == rows(spark.createDataFrame(want, schema))
    stored = {r["payload_digest"]: bytes(r["payload"]) for r in found.where("record_type = 'response'").collect()}
    assert all(hashlib.sha1(p).hexdigest() == d for d, p in stored.items()) and len(stored) == 7
    assert rows(W.round_trip(pages(spark, []))) == []


def test_lookup(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_LINES", 2)
    monkeypatch.setattr(W, "READ_LINES", 7)
    many = [(i, f"http://h{i % 7}.example.com/p/{i % 50}" if i % 3 else "http://hot.com/", f"<p>{i}</p>") for i in range(300)]
    archive = W.write(pages(spark, many))
    assert archive.files.count() > 1
    directory = W.Directory(archive)
    by_url = {}
    for i, url, html in many:
        by_url.setdefault(url, []).append((i, url, html.encode()))
    for url in ("http://h3.example.com/p/3", "http://h0.example.com/p/49", "http://hot.com/", many[-1][1]):
        assert sorted(r.page_id for r in directory.lookup(url)) == [i for i, _, _ in by_url.get(url, [])]
    assert directory.lookup("http://h3.example.com/p") == []
    some = sorted(by_url)[::3]
    keys = spark.createDataFrame([(W.url_key(u),) for u in [*some, some[0], "http://none/", ""]], "key string")
    found = rows(W.find(archive, keys), "page_id", "url", "payload")
    assert [(i, u, bytes(p)) for i, u, p in found] == sorted(x for u in some for x in by_url[u])
    assert rows(W.find(archive, keys.limit(0))) == []


def test_keys_of_columns(spark):
    urls = [None, "", "no url", "http://www.Ex.com/A?b", "https://a..B./x", "http://É.com#f", "x://", "http://h:80?q://z", "http://" + "l" * 5000 + "/p"]
    found = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").select("i", W.key_column(F.col("url")).alias("key"))
    assert [r["key"] for r in sorted(found.collect())] == [W.url_key(u) for u in urls]
    assert W.url_key("http://www.Ex.com/A?b") == "com,ex,www)/A?b" and W.url_key(None) == ""


def test_equal_rows_have_one_response(spark):
    big = "z" * 1500
    same = [(5, "http://a/", big)] * 4 + [(5, "http://b/", big)] * 2 + [(5, None, big), (3, "http://a/", big), (5, "http://a/", "other " * 300)]
    found = rows(W.round_trip(pages(spark, same)), "page_id", "payload_bytes", "record_type", "refers_to")
    assert len(found) == 9 and [x for x in found if x[1] == 1500 and x[2] == "response"] == [(5, 1500, "response", None)]
    assert sum(x[2:] == ("revisit", 5) for x in found) == 7


def test_members_are_gzip():
    raw = W.record(1, "http://a/", b"x", hashlib.sha1(b"x").hexdigest(), None, 0)
    assert zlib.decompress(raw, 31).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
