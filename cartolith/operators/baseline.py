"""Architecture states, their differences, and gates on both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.functions import names as N
from cartolith.plans.graph import Graph

from .deadcode import dead_code
from .health import COMPLEXITY_CRITICAL, COMPLEXITY_WARN, doc_coverage, worst_symbols
from .packages import layer_violations, package_cycles

STATE = "category string, key string, display string, detail string"
CATEGORIES = ("dead_code", "inferred_calls", "layer_violations", "package_cycles", "public_api", "service_deps", "skipped", "subprojects")
#: Categories that count as regressions when something appears or disappears.
WORSE_IF_APPEARED = ("package_cycles", "layer_violations", "inferred_calls", "dead_code")
WORSE_IF_GONE = ("public_api",)


def state(graph: Graph, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(category, key, display, detail): the architecture as one long table of stable keys; only ``categories`` are computed."""

    def part(category: str, df: DataFrame, key, display, detail=None) -> DataFrame:
        return df.select(F.lit(category).alias("category"), key.alias("key"), display.alias("display"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))

    def pairs(category: str, df: DataFrame) -> DataFrame:
        return part(category, df, F.concat_ws("|", "source", "target"), N.pair_text(F.col("source"), F.col("target")))

    def cycles(category: str) -> DataFrame:
        found = package_cycles(graph).groupBy("cycle").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
        return part(category, found, F.array_join("nodes", "|"), F.array_join("nodes", " → "))

    api = graph.nodes_of(*N.API_KINDS).where("visibility = 'public'")
    note = lambda a, b: F.concat(a, F.lit(" ("), b, F.lit(")"))
    parts = {
        "public_api": lambda c: part(c, api, F.col("id"), F.trim(F.concat_ws(" ", "id", "signature")), F.col("signature")),
        "package_cycles": cycles,
        "layer_violations": lambda c: pairs(c, layer_violations(graph).select(F.col("source_package").alias("source"), F.col("target_package").alias("target"))),
        "inferred_calls": lambda c: pairs(c, graph.edges_of("calls").where("certainty = 'inferred'").select("source", "target")),
        "dead_code": lambda c: part(c, dead_code(graph), F.col("node_id"), note(F.col("node_id"), F.col("confidence")), F.col("confidence")),
        "service_deps": lambda c: pairs(c, graph.edges_of("service_dep").select("source", "target")),
        "subprojects": lambda c: part(c, graph.subprojects, F.col("id"), note(F.col("id"), F.col("language")), F.col("language")),
        "skipped": lambda c: part(c, graph.skipped, F.col("path"), F.concat(F.col("path"), F.lit(" — "), F.col("reason")), F.col("reason")),
    }
    return reduce(DataFrame.unionByName, [parts[c](c) for c in parts if c in categories])


def metrics(graph: Graph, critical: int = COMPLEXITY_CRITICAL) -> DataFrame:
    """(name, value): the scalar measures of a state."""
    counts = {
        "files_analyzed": graph.modules.agg(F.count("*").alias("value")),
        "nodes": graph.nodes.agg(F.count("*").alias("value")),
        "edges": graph.edges.agg(F.count("*").alias("value")),
        "doc_coverage": doc_coverage(graph).select(F.col("doc_coverage").alias("value")),
        "critical_symbols": worst_symbols(graph, min(COMPLEXITY_WARN, critical), critical).where("status = 'critical'").agg(F.count("*").alias("value")),
    }
    out = None
    for name, df in counts.items():
        row = df.select(F.lit(name).alias("name"), F.col("value").cast("long").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(category, change, key, display, old_detail, new_detail): what appeared, disappeared or, of the API, changed its signature."""
    a = old.select("category", "key", F.col("display").alias("old_display"), F.col("detail").alias("old_detail"), F.lit(1).alias("in_old"))
    b = new.select("category", "key", F.col("display").alias("new_display"), F.col("detail").alias("new_detail"), F.lit(1).alias("in_new"))
    both = a.join(b, ["category", "key"], "full_outer")
    changed = (F.col("category") == "public_api") & ~F.col("old_detail").eqNullSafe(F.col("new_detail"))
    change = F.when(F.col("in_old").isNull(), "appeared").when(F.col("in_new").isNull(), "disappeared").when(changed, "modified")
    return both.withColumn("change", change).where("change is not null").select(
        "category", "change", "key", F.coalesce("new_display", "old_display").alias("display"), "old_detail", "new_detail"
    )


def compare_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, old, new) of measures that differ; a missing one is 0."""
    both = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), "name", "full_outer").na.fill(0, ["old", "new"])
    return both.where("old <> new").select("name", "old", "new")


def category_order(delta: DataFrame) -> DataFrame:
    """(category, regression): changed categories, regressions first."""
    worse = (F.col("category").isin(*WORSE_IF_APPEARED) & (F.col("change") == "appeared")) | (F.col("category").isin(*WORSE_IF_GONE) & (F.col("change") == "disappeared"))
    return delta.where("change <> 'modified'").groupBy("category").agg(F.max(worse).alias("regression")).orderBy(F.desc("regression"), "category")


CHECK = "name string, threshold long, actual long, passed boolean"


def _check(name: str, threshold: int, counted: DataFrame, passed) -> DataFrame:
    return counted.select(F.lit(name).alias("name"), F.lit(threshold).cast("long").alias("threshold"), F.col("actual").cast("long").alias("actual")).withColumn("passed", passed)


def gate_checks(graph: Graph, max_package_cycles: int = -1, min_doc_coverage: int = -1, max_critical_symbols: int = -1, critical: int = COMPLEXITY_CRITICAL) -> DataFrame:
    """(name, threshold, actual, passed) of the gates that are set (-1: off); a symbol is critical above ``critical``."""
    actual, threshold = F.col("actual"), F.col("threshold")
    parts = []
    if max_package_cycles >= 0:
        parts.append(_check("max-package-cycles", max_package_cycles, package_cycles(graph).agg(F.countDistinct("cycle").alias("actual")), actual <= threshold))
    if min_doc_coverage >= 0:
        parts.append(_check("min-doc-coverage", min_doc_coverage, doc_coverage(graph).select(F.col("doc_coverage").alias("actual")), actual >= threshold))
    if max_critical_symbols >= 0:
        counted = worst_symbols(graph, min(COMPLEXITY_WARN, critical), critical).where("status = 'critical'").agg(F.count("*").alias("actual"))
        parts.append(_check("max-critical-symbols", max_critical_symbols, counted, actual <= threshold))
    out = graph.spark.createDataFrame([], CHECK)
    for p in parts:
        out = out.unionByName(p)
    return out.orderBy("name")


#: Rules on a difference: its name, the category and the change that count.
REGRESSIONS = {
    "fail-on-new-cycles": ("package_cycles", "appeared"),
    "fail-on-new-violations": ("layer_violations", "appeared"),
    "fail-on-new-inferred": ("inferred_calls", "appeared"),
    "fail-on-removed-public-api": ("public_api", "disappeared"),
}


def regression_checks(delta: DataFrame, metric_delta: DataFrame, rules: tuple[str, ...] = tuple(REGRESSIONS), max_doc_coverage_drop: int = -1) -> DataFrame:
    """(name, threshold, actual, passed) of the rules that are on."""
    actual, threshold = F.col("actual"), F.col("threshold")
    out = delta.sparkSession.createDataFrame([], CHECK)
    for name in rules:
        category, change = REGRESSIONS[name]
        counted = delta.agg(F.count_if((F.col("category") == category) & (F.col("change") == change)).alias("actual"))
        out = out.unionByName(_check(name, 0, counted, actual == 0))
    if max_doc_coverage_drop >= 0:
        drop = metric_delta.where("name = 'doc_coverage'").agg(F.coalesce(F.max(F.greatest(F.col("old") - F.col("new"), F.lit(0))), F.lit(0)).alias("actual"))
        out = out.unionByName(_check("max-doc-coverage-drop", max_doc_coverage_drop, drop, actual <= threshold))
    return out.orderBy("name")
