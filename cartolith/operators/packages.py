"""Package dependencies, cycles, layers and violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.functions import names as N
from cartolith.plans.graph import Graph

from .kernels import strong_components


def module_imports(graph: Graph) -> DataFrame:
    """Import edges between modules, with both ends' qualname and package."""
    ends = graph.modules.select("id", "qualname", N.package_of(F.col("qualname")).alias("package"))
    source = ends.select(*[F.col(c).alias(f"source_{c}") for c in ends.columns])
    target = ends.select(*[F.col(c).alias(f"target_{c}") for c in ends.columns])
    edges = graph.edges_of("imports").select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), "certainty")
    return edges.join(source, "source_id").join(target, "target_id")


def package_dependencies(graph: Graph) -> DataFrame:
    """(source, target): distinct packages of which one imports the other."""
    pairs = module_imports(graph).where("source_package <> target_package")
    return pairs.select(F.col("source_package").alias("source"), F.col("target_package").alias("target")).distinct()


def package_cycles(graph: Graph) -> DataFrame:
    """(cycle, node): strong components of packages with over one member, named by the least."""
    return strong_components(package_dependencies(graph))


def package_layers(graph: Graph) -> DataFrame:
    """(package, layer, level) of each package that names a layer."""
    packages = graph.modules.select(N.package_of(F.col("qualname")).alias("package")).distinct()
    layer = N.layer_of(F.col("package"))
    return packages.select("package", layer.alias("l")).where("l is not null").select("package", F.col("l.name").alias("layer"), F.col("l.level").alias("level"))


def layers(graph: Graph) -> DataFrame:
    """(name, level, packages), the highest level first."""
    grouped = package_layers(graph).groupBy(F.col("layer").alias("name"), "level")
    return grouped.agg(F.array_sort(F.collect_set("package")).alias("packages")).orderBy(F.desc("level"))


def layer_violations(graph: Graph) -> DataFrame:
    """(source_package, target_package, evidence): dependencies on a higher layer, with the imports behind them."""
    known = package_layers(graph)
    low = known.select(F.col("package").alias("source_package"), F.col("level").alias("from_level"))
    high = known.select(F.col("package").alias("target_package"), F.col("level").alias("to_level"))
    upward = module_imports(graph).join(low, "source_package").join(high, "target_package").where("from_level < to_level")
    evidence = N.pair_text(F.col("source_qualname"), F.col("target_qualname"))
    return (
        upward.groupBy("source_package", "target_package")
        .agg(F.array_sort(F.collect_list(evidence)).alias("evidence"))
        .orderBy("source_package", "target_package")
    )
