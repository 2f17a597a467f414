"""Module health, worst symbols and documentation coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.functions import names as N
from cartolith.plans.graph import Graph

#: Default thresholds.
COMPLEXITY_WARN, COMPLEXITY_CRITICAL, DOC_COVERAGE_WARN = 10, 20, 60


def _members(graph: Graph) -> DataFrame:
    """Symbols of each module: those of its file, without itself."""
    modules = graph.modules.select(F.col("id").alias("module_id"), "file", F.col("loc").alias("module_loc"))
    members = graph.nodes.select(
        "id", "file", "kind", "complexity",
        N.is_documentable(F.col("name"), F.col("kind"), F.col("visibility")).alias("documentable"),
        F.col("doc").isNotNull().alias("documented"),
    )
    return modules.join(members, "file").where("module_id <> id")


def fan_in_out(graph: Graph) -> DataFrame:
    """(module_id, fan_in, fan_out): distinct import edges of each module, 0 included."""
    ends = graph.edges_of("imports").select(
        F.explode(F.array(F.struct(F.col("source").alias("module_id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                          F.struct(F.col("target").alias("module_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")
    )
    sums = ends.groupBy("e.module_id").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    modules = graph.modules.select(F.col("id").alias("module_id"))
    return modules.join(sums, "module_id", "left").na.fill(0, ["fan_in", "fan_out"])


def module_health(graph: Graph, warn: int = COMPLEXITY_WARN, critical: int = COMPLEXITY_CRITICAL, coverage: int = DOC_COVERAGE_WARN) -> DataFrame:
    """One row a module: size, functions, complexity, coverage, coupling and status."""
    sums = _members(graph).groupBy("module_id").agg(
        F.count_if(F.col("kind").isin(*N.CALLABLES)).alias("functions"),
        F.max("complexity").cast("long").alias("max_complexity"),
        F.count_if("documentable").alias("documentable"),
        F.count_if(F.col("documentable") & F.col("documented")).alias("documented"),
    )
    rows = (
        graph.modules.select(F.col("id").alias("module_id"), F.col("loc").cast("long").alias("loc"))
        .join(sums, "module_id", "left")
        .na.fill(0, ["functions", "max_complexity", "documentable", "documented"])
        .join(fan_in_out(graph), "module_id")
        .withColumn("doc_coverage", N.rounded_percent(F.col("documented"), F.col("documentable")))
    )
    status = N.worst_status(
        N.complexity_status(F.col("max_complexity"), warn, critical), F.when(F.col("doc_coverage") < coverage, "warn").otherwise("ok")
    )
    return rows.select("module_id", "loc", "functions", "max_complexity", "doc_coverage", "fan_in", "fan_out", status.alias("status"))


def worst_symbols(graph: Graph, warn: int = COMPLEXITY_WARN, critical: int = COMPLEXITY_CRITICAL) -> DataFrame:
    """(node_id, name, value, status) of symbols above the thresholds, the most complex first."""
    rows = _members(graph).where(F.col("complexity") > warn)
    status = N.complexity_status(F.col("complexity"), warn, critical)
    out = rows.select(F.col("id").alias("node_id"), F.lit("complexity").alias("name"), F.col("complexity").cast("long").alias("value"), status.alias("status"))
    return out.orderBy(F.desc("value"), "node_id")


def doc_coverage(graph: Graph) -> DataFrame:
    """One row: share of documented symbols over all modules."""
    sums = _members(graph).agg(
        F.count_if("documentable").alias("documentable"), F.count_if(F.col("documentable") & F.col("documented")).alias("documented")
    )
    return sums.select("documentable", "documented", N.rounded_percent(F.col("documented"), F.col("documentable")).alias("doc_coverage"))


def subproject_stats(graph: Graph) -> DataFrame:
    """(id, language, modules, symbols, loc) of each subproject, empty ones included."""
    sums = graph.nodes.groupBy(F.col("subproject").alias("id")).agg(
        F.count_if(F.col("kind") == "module").alias("modules"), F.count("*").alias("symbols"),
        F.sum(F.when(F.col("kind") == "module", F.col("loc")).otherwise(0)).alias("loc"),
    )
    return graph.subprojects.select("id", "language").join(sums, "id", "left").na.fill(0, ["modules", "symbols", "loc"])


def run_report(graph: Graph) -> DataFrame:
    """One row of counts over the whole graph."""
    nodes = graph.nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "module").alias("modules"))
    edges = graph.edges.agg(
        F.count("*").alias("edges"), F.count_if(F.col("certainty") == "certain").alias("certain_edges"),
        F.count_if(F.col("certainty") == "inferred").alias("inferred_edges"),
    )
    return nodes.crossJoin(edges).crossJoin(graph.skipped.agg(F.count("*").alias("skipped")))  # single rows
