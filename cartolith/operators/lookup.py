"""Finding symbols: focus resolution, search, module surfaces, owners and excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions import names as N
from cartolith.plans.graph import Graph

SYMBOLS = N.INDEXED_KINDS
#: Rows that searches return, and lines of an excerpt.
TOOL_LIMIT, BROWSER_LIMIT, EXCERPT_LINES = 25, 30, 120


class FocusError(ValueError):
    """A focus names nothing, or several symbols."""


def focus_matches(graph: Graph, focus: str, kinds: tuple[str, ...] = SYMBOLS) -> DataFrame:
    """(id): symbols with this id, qualname or ending; an exact one does not beat others."""
    hit = (F.col("id") == focus) | (F.col("qualname") == focus) | F.col("qualname").endswith(f".{focus}")
    return graph.nodes_of(*kinds).where(hit).select("id")


def resolve_focus(graph: Graph, focus: str, kinds: tuple[str, ...] = SYMBOLS) -> str:
    found = [r["id"] for r in focus_matches(graph, focus, kinds).orderBy("id").limit(11).collect()]
    if len(found) != 1:
        raise FocusError(f"symbole introuvable : {focus}" if not found else f"symbole ambigu : {focus} ({', '.join(found)})")
    return found[0]


def candidates(graph: Graph, query: str, kinds: tuple[str, ...] = SYMBOLS) -> DataFrame:
    """Nodes with this id or qualname; only where there is none, those that end so."""
    exact = (F.col("id") == query) | (F.col("qualname") == query)
    rank = F.when(exact, 0).when(F.col("qualname").endswith(f".{query}"), 1)
    ranked = graph.nodes_of(*kinds).withColumn("rank", rank).where("rank is not null")
    best = ranked.agg(F.min("rank").alias("rank"))
    return ranked.join(F.broadcast(best), "rank").drop("rank")


def search_symbol(graph: Graph, query: str, limit: int = TOOL_LIMIT) -> DataFrame:
    """(position, id, kind, file, line, signature, doc, truncated): candidates, then names that contain the query."""
    first = candidates(graph, query).select("id", F.lit(0).alias("rank"))
    named = graph.nodes_of(*SYMBOLS).where(F.lower("name").contains(query.lower())).select("id", F.lit(1).alias("rank"))
    ranked = first.unionByName(named).groupBy("id").agg(F.min("rank").alias("rank")).orderBy("rank", "id").limit(limit + 1)
    place = F.row_number().over(Window.orderBy("rank", "id"))
    top = ranked.withColumn("position", place).withColumn("truncated", F.count("*").over(Window.partitionBy()) > limit).where(F.col("position") <= limit)
    return top.join(graph.nodes, "id").select("position", *described(), "truncated").orderBy("position")


def described() -> list[Column]:
    return [
        F.col("id"), F.col("kind"), F.col("file"), F.col("location.line").alias("line"), F.col("signature"),
        F.coalesce("doc.summary", F.lit("")).alias("doc"),
    ]


def symbol_search(index: DataFrame, query: str, limit: int = BROWSER_LIMIT) -> DataFrame:
    """The best entries of a search index: exact, prefix, part of the name, part of the qualname."""
    ranked = index.withColumn("rank", N.search_rank(F.col("name"), F.col("qualname"), query)).where("rank is not null")
    return ranked.orderBy("rank", "name", "qualname").limit(limit)


def module_api(graph: Graph, module_id: str) -> DataFrame:
    """(class_id, id, kind, signature, doc) of the public surface of a module; functions have no class."""
    public = graph.nodes.where("visibility = 'public'")
    own = public.where(F.col("parent_id") == module_id)
    types = own.where(F.col("kind").isin("class", "interface", "enum"))
    methods = public.where("kind = 'method'").join(types.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    row = lambda df, owner: df.select(owner.cast("string").alias("class_id"), *[c for c in described() if c is not None])
    parts = row(types, F.col("id")).unionByName(row(methods, F.col("parent_id"))).unionByName(row(own.where("kind = 'function'"), F.lit(None)))
    return parts.select("class_id", "id", "kind", "signature", "doc").orderBy(F.col("class_id").asc_nulls_last(), F.col("kind") == "method", "id")


def dotted_prefixes(name: Column) -> Column:
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def path_prefixes(path: Column) -> Column:
    """The folders above a path, itself and ``.`` included."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def owning_module(graph: Graph) -> DataFrame:
    """(id, module_id): the module with the longest id before a symbol's; by equality on its dotted prefixes."""
    modules = graph.modules.select(F.col("id").alias("module_id"))
    above = graph.nodes.where("kind <> 'module'").select("id", F.explode(dotted_prefixes(F.col("id"))).alias("module_id")).where("id <> module_id")
    return above.join(modules, "module_id").groupBy("id").agg(F.max_by("module_id", F.length("module_id")).alias("module_id"))


def owning_subproject(paths: DataFrame, subprojects: DataFrame) -> DataFrame:
    """(path, subproject): the subproject with the deepest root above a path, the first of equals."""
    roots = subprojects.select(F.col("id").alias("subproject"), F.when(F.col("root").isin("", "."), ".").otherwise(F.col("root")).alias("root"))
    above = paths.select("path").distinct().select("path", F.explode(path_prefixes(F.col("path"))).alias("root"))
    depth = F.when(F.col("root") == ".", 0).otherwise(F.length("root"))
    return above.join(roots, "root").groupBy("path").agg(F.min(F.struct(-depth, F.col("subproject").alias("s")))["s"].alias("subproject"))


def search_index(graph: Graph, include_private: bool = False) -> DataFrame:
    """(name, qualname, kind, signature, module, language, page) of the visible symbols."""
    several = graph.subprojects.agg((F.count("*") > 1).alias("several"))
    nodes = graph.nodes_of(*SYMBOLS)
    if not include_private:
        nodes = nodes.where("visibility = 'public'")
    owners = owning_module(graph).unionByName(graph.modules.select("id", F.col("id").alias("module_id")))
    rows = nodes.join(owners, "id").join(graph.subprojects.select(F.col("id").alias("subproject"), "language"), "subproject", "left")
    page = F.concat(F.lit("modules/"), N.page_slug(F.col("module_id"), F.col("several")), F.lit(".html"))
    parts = F.split("qualname", r"\.")
    mark = F.when(F.col("kind").isin("class", "interface", "enum", "function"), F.col("name")).when(
        F.col("kind") == "method", F.element_at(parts, -2)
    )
    anchored = F.when(mark.isNotNull(), F.concat(page, F.lit("#"), N.anchor(mark))).otherwise(page)
    return rows.crossJoin(F.broadcast(several)).select(  # one row
        "name", "qualname", "kind", "signature", N.qualname(F.col("module_id")).alias("module"), F.coalesce("language", F.lit("")).alias("language"), anchored.alias("page"),
    ).orderBy("name", "qualname")


def excerpts(nodes: DataFrame, files: DataFrame, limit: int = EXCERPT_LINES) -> DataFrame:
    """(id, path, start_line, end_line, code, truncated) from nodes (id, file, line, loc) and ``files(path, lines)``."""
    joined = nodes.join(files.withColumnRenamed("path", "file"), "file")
    count = F.size("lines")
    until = F.least(F.col("line") + F.greatest("loc", F.lit(1)) - 1, count)
    rows = joined.where((F.col("line") >= 1) & (F.col("line") <= count)).withColumn("until", until)
    long = F.col("until") - F.col("line") + 1 > limit
    end = F.when(long, F.col("line") + limit - 1).otherwise(F.col("until"))
    return rows.select(
        "id", F.col("file").alias("path"), F.col("line").alias("start_line"), end.alias("end_line"),
        F.array_join(F.slice("lines", F.col("line"), end - F.col("line") + 1), "\n").alias("code"), long.alias("truncated"),
    )
