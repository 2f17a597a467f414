"""Functions that nothing reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.functions import names as N
from cartolith.plans.graph import Graph

from .entrypoints import entry_roots
from .kernels import closure

#: The reason given, and what is added for public symbols.
REASON = "non atteignable depuis les points d'entrée et jamais référencé"
PUBLIC_NOTE = " (mais public : usage externe possible)"


def _report(nodes: DataFrame) -> DataFrame:
    private = F.col("visibility") == "private"
    return nodes.select(
        F.col("id").alias("node_id"),
        F.when(private, "high").otherwise("medium").alias("confidence"),
        F.when(private, REASON).otherwise(REASON + PUBLIC_NOTE).alias("reason"),
    )


def _candidates(graph: Graph) -> DataFrame:
    return graph.nodes_of(*N.CALLABLES).where(~N.is_dunder(F.col("name")))


def dead_code(graph: Graph) -> DataFrame:
    """(node_id, confidence, reason).

    Whatever is reached from an entry point is an entry point or is called; so
    neither called nor an entry point says it without a traversal.
    """
    called = graph.edges_of("calls", "references").select(F.col("target").alias("id"))
    return _report(_candidates(graph).join(called.unionByName(entry_roots(graph)).distinct(), "id", "left_anti"))


def dead_code_by_closure(graph: Graph) -> DataFrame:
    """The same by reachability, as a check of the short form."""
    alive = closure(graph.edges_of("calls"), entry_roots(graph))
    called = graph.edges_of("calls", "references").select(F.col("target").alias("id")).distinct()
    return _report(_candidates(graph).join(alive, "id", "left_anti").join(called, "id", "left_anti"))
