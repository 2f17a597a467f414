import pytest

from cartolith.llm import url_filter as U

from .helpers import pages, rows

URLS = [
    "https://www.example.com/en/71?x=/en/", "http://EXAMPLE.com/en/6", "http://notexample.com/en/7", "com/en/", None, "", "http://",
    "http://example.net/de/8", "http://a.b.example.net/de/80#f", "http://net/de", "http://x.net/de/", "ftp://org?/es/", "http://a.org/es/#",
    "http://com:80/en/", "://com/en/a", "http://x://com/en/", "HTTP://ÄÖ.COM/en/é", "http://.com/en/", "http://com./en/", "http://a.com/en/" + "x" * 100_000, "http://" + "s." * 3000 + "org/es/", "a\n://com/en/\nb",
]


def judge(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for verdict, h, p in U.QUERY_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, "allow"))


@pytest.mark.parametrize("map_rules", [0, 1000])
def test_judges_like_brute_force(spark, monkeypatch, map_rules):
    monkeypatch.setattr(U, "MAP_RULES", map_rules)
    items = [(i, u, None) for i, u in enumerate(URLS)] * 2 + [(None, URLS[0], "")]
    found = rows(U.filter_urls(pages(spark, items), U.QUERY_RULES), "page_id", "host", "path", "rule", "verdict")
    assert found == rows(spark.createDataFrame([(i, *judge(u)) for i, u, _ in items], "page_id long, host string, path string, rule string, verdict string"))


def test_empty_tables_and_rules(spark):
    assert rows(U.filter_urls(pages(spark, []), U.QUERY_RULES)) == []
    assert rows(U.filter_urls(pages(spark, [(1, "http://com/en/", "")]), []), "rule", "verdict") == [(None, "allow")]
    both = [("allow", "com", "/a"), ("block", "com", "/a")]
    assert rows(U.filter_urls(pages(spark, [(1, "http://com/ab", "")]), both), "verdict") == [("block",)]


def test_main_path_is_native(spark):
    plan = U.filter_urls(pages(spark, [(1, "http://com/en/", "")]), U.QUERY_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
