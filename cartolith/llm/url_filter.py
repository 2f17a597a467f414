"""URL filters: host-suffix and path-prefix rules joined on short hash prefixes.

Each URL is expanded into the expressions ``host suffix + path prefix`` that
have the shape (labels of the host, characters of the path) of some rule. The
expressions meet the rules on the first 32 bits of their SHA-256; then the full
digests are compared and the longest rule decides. All of it is DataFrame
functions. Up to ``MAP_RULES`` rules the equi-join is a lookup of each prefix in
a map that the plan holds, so no row is shuffled; beyond, the expressions are
exploded and joined to a table of the rules.

Defined cases: a null URL, or one without ``://``, has an empty host and an
empty path, and no rule fits it. Repeated rows stay repeated. An empty table
gives an empty result. Only the id and URL columns are read, so further
columns of any name do no harm. Of rules with equal host and path, block wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest on which the join runs (32 bits).
PREFIX_HEX = 8
#: Rule sets of at most so many rules are a map in the plan (about 200 bytes each).
MAP_RULES = 1_000
#: Rule sets of at most so many rules are broadcast (about 200 bytes each); larger ones are shuffled.
BROADCAST_RULES = 50_000

Rule = tuple[str, str, str]

#: The rules of query op1 as (verdict, host, path).
QUERY_RULES: list[Rule] = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def rule_table(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rules with digest and rank; the higher rank takes precedence."""
    ordered = sorted(
        {(v, h.translate(str.maketrans(UPPER, LOWER)), p) for v, h, p in rules},
        key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block", r),
    )
    if any(v not in ("allow", "block") or not h for v, h, _ in ordered):
        raise ValueError("a rule is (allow or block, host, path) with a host")
    rows = [(i, v, h + p) for i, (v, h, p) in enumerate(ordered)]
    table = pages.sparkSession.createDataFrame(rows, "rank long, verdict string, rule string")
    digest = F.sha2("rule", 256)
    return table.select("*", digest.alias("rule_digest"), F.substring(digest, 1, PREFIX_HEX).alias("prefix"))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Judge each URL: (id, host, path, rule, verdict), a row for each row of ``pages``."""
    host, path = split_url(pages[url_col])
    urls = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path")).withColumn(
        "row", F.monotonically_increasing_id()
    )
    if not rules:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    shape = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(k).alias("chars")) for n, k in shapes])
    labels = F.size(F.split("host", r"\.", -1))
    fitting = F.filter(shape, lambda s: (s["labels"] <= labels) & (s["chars"] <= F.length("path")))
    expressions = F.transform(
        fitting,
        lambda s: F.concat(
            F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]),
            F.substring(F.col("path"), F.lit(1), s["chars"]),
        ),
    )
    table = rule_table(pages, rules)
    if len(rules) <= MAP_RULES:
        return _by_map(urls, expressions, table.orderBy("rank").collect(), default)
    small = len(rules) <= BROADCAST_RULES
    by_prefix = table.select("prefix", "rule_digest", "rank")
    by_rank = table.select("rank", "rule", "verdict")
    exploded = (
        urls.select("*", F.explode_outer(expressions).alias("expression"))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )
    judged = (
        exploded.join(F.broadcast(by_prefix) if small else by_prefix, "prefix", "left")
        .withColumn("hit", F.when(F.col("digest") == F.col("rule_digest"), F.col("rank")))
        .groupBy("row", "page_id", "host", "path")
        .agg(F.max("hit").alias("rank"))
    )
    return judged.join(F.broadcast(by_rank) if small else by_rank, "rank", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def _by_map(urls: DataFrame, expressions: Column, rules: Sequence, default: str) -> DataFrame:
    """The join by a map from prefixes to the (digest, rank, rule, verdict) of the rules that have them."""
    by_prefix: dict[str, list[Column]] = {}
    for r in rules:
        rule = F.struct(F.lit(r["rank"]).alias("rank"), F.lit(r["rule"]).alias("rule"), F.lit(r["verdict"]).alias("verdict"), F.lit(r["rule_digest"]).alias("digest"))
        by_prefix.setdefault(r["prefix"], []).append(rule)
    table = F.create_map(*[x for prefix, own in by_prefix.items() for x in (F.lit(prefix), F.array(*own))])
    digests = F.transform(expressions, lambda e: F.sha2(e, 256))
    met = F.transform(
        digests,
        lambda d: F.filter(F.element_at(table, F.substring(d, 1, PREFIX_HEX)), lambda rule: rule["digest"] == d),
    )
    best = F.array_max(F.flatten(F.filter(met, lambda x: x.isNotNull())))
    judged = urls.withColumn("best", best)
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: DuckDB SQL of query op1.
ORACLE_SQL = """
WITH u AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT rid, page_id, CASE WHEN strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM u),
h AS (SELECT rid, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
x AS (
  SELECT rid, page_id,
         translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM h
),
rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
),
m AS (
  SELECT x.rid, x.page_id, x.host, x.path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY x.rid ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM x LEFT JOIN rules
    ON (x.host = rhost OR ends_with(x.host, '.' || rhost)) AND starts_with(x.path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
