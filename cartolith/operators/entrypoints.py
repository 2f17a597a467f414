"""Entry points by what modifiers say: main guards, routes and commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.plans.graph import Graph

#: The forms of modifiers.
ROUTE = r"""^decorator:(\w+)\.(get|post|put|delete|patch|route)\(\s*['"]([^'"]*)['"]"""
COMMAND = r"^decorator:([\w.]+)\.command\("
MAPPING = r"""^decorator:(Get|Post|Put|Delete|Patch|Request)Mapping(?:\(\s*"([^"]*)")?"""
MODULE_ROUTE = "route:"
REGISTRATION = "enregistrement de route au niveau module (express-like)"
JAVA_MAIN = "public static void main(String[] args)"
PYTHON_MAIN = 'if __name__ == "__main__"'


def _row(framework: Column | str, kind: str, label: Column, evidence: Column | str) -> list[Column]:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return [
        F.col("id").alias("node_id"), as_column(framework).alias("framework"), F.lit(kind).alias("kind"),
        label.alias("label"), as_column(evidence).alias("evidence"),
    ]


def entry_points(graph: Graph) -> DataFrame:
    """(node_id, framework, kind, label, evidence): a row for each modifier that tells of one."""
    m = F.col("modifier")
    source = F.concat(F.lit("@"), F.regexp_replace(m, "^decorator:", ""))
    modules = graph.modules.select("id", "qualname", "modifiers")
    guards = modules.where(F.array_contains("modifiers", "main_guard")).select(
        *_row("python", "main", F.concat(F.lit("python -m "), F.col("qualname")), PYTHON_MAIN)
    )
    registered = modules.select("id", F.explode("modifiers").alias("modifier")).where(m.startswith(MODULE_ROUTE)).select(
        *_row("web", "route", F.substring(m, F.lit(len(MODULE_ROUTE) + 1), F.length(m)), REGISTRATION)
    )
    marked = graph.nodes_of("function", "method").select("id", "qualname", "kind", "name", "modifiers", F.explode("modifiers").alias("modifier"))
    routes = marked.where(m.rlike(ROUTE)).select(
        *_row("web", "route", F.concat_ws(" ", F.upper(F.regexp_extract(m, ROUTE, 2)), F.regexp_extract(m, ROUTE, 3)), source)
    )
    prefix = F.substring_index(F.regexp_extract(m, COMMAND, 1), ".", 1)
    commands = marked.where(~m.rlike(ROUTE) & m.rlike(COMMAND)).select(
        *_row(F.when(prefix.isin("click", "cli"), "click").otherwise("cli-framework"), "cli", F.col("qualname"), source)
    )
    is_main = (F.col("name") == "main") & F.array_contains("modifiers", "static")
    mains = graph.nodes_of("method").where(is_main).select(*_row("java", "main", F.col("qualname"), JAVA_MAIN))
    verb = F.upper(F.regexp_extract(m, MAPPING, 1))
    path = F.regexp_extract(m, MAPPING, 2)
    label = F.concat_ws(" ", F.when(verb == "REQUEST", "ROUTE").otherwise(verb), F.when(path == "", "/").otherwise(path))
    mapped = marked.where((F.col("kind") == "method") & ~is_main & m.rlike(MAPPING)).select(*_row("spring", "route", label, source))
    out = guards
    for part in (registered, routes, commands, mains, mapped):
        out = out.unionByName(part)
    return out


def entry_roots(graph: Graph) -> DataFrame:
    """(id): functions and methods at which calls begin; a module stands for its ``main``."""
    named = graph.nodes.select("id", "kind")
    entries = entry_points(graph).select(F.col("node_id").alias("id")).distinct().join(named, "id")
    own = entries.where(F.col("kind").isin("function", "method")).select("id")
    mains = entries.where("kind = 'module'").select(F.concat("id", F.lit(".main")).alias("id"))
    return own.unionByName(mains.join(named.select("id"), "id", "left_semi")).distinct()


def entry_symbols(graph: Graph) -> DataFrame:
    """(id): the nodes that count as entry points in an impact: roots and entry modules."""
    modules = entry_points(graph).select(F.col("node_id").alias("id")).join(graph.modules.select("id"), "id", "left_semi")
    return entry_roots(graph).unionByName(modules).distinct()
