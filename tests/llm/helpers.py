"""Small tables for the tests."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def rows(df, *names):
    """Rows as sorted tuples, nulls first."""
    found = [tuple(r[n] for n in (names or df.columns)) for r in df.collect()]
    return sorted(found, key=lambda r: [(x is not None, str(type(x)), x) if x is not None else (False, "", 0) for x in r])


def documents(spark, texts, sources=None, langs=None):
    """documents with clashing column names beside its own; texts may be (doc_id, text)."""
    out = []
    for i, t in enumerate(texts):
        key, text = t if isinstance(t, tuple) else (i, t)
        out.append((key, text, langs[i] if langs else "en", sources[i] if sources else "s", len(text or ""), 1, "x", 2.5, 3))
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, row string, p double, size int"
    return spark.createDataFrame(out, schema)


def pages(spark, items):
    """pages from (page_id, url, html), with clashing column names beside its own."""
    schema = "page_id long, url string, html string, host string, digest string, range int, owned boolean"
    return spark.createDataFrame([(*i, "x", "y", 1, True) for i in items], schema)
