"""The property graph: four tables, their schemas and their rules."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.functions import names as N

SUBPROJECTS = "id string, language string, root string, manifest string, name string, declared_deps array<string>"
NODES = (
    "id string, kind string, name string, subproject string, location struct<file: string, line: int>, visibility string, "
    "signature string, doc struct<raw: string, summary: string, format: string>, modifiers array<string>, complexity int, loc int"
)
EDGES = "source string, target string, kind string, certainty string, location struct<file: string, line: int>"
SKIPPED = "path string, reason string"
#: Fixed values of the model.
NODE_KINDS = ("package", "module", "class", "interface", "enum", "function", "method", "attribute")
EDGE_KINDS = ("inherits", "implements", "composes", "aggregates", "associates", "imports", "calls", "references", "service_dep")
CERTAINTIES, VISIBILITIES = ("certain", "inferred"), ("public", "private")
DOC_FORMATS = ("docstring", "jsdoc", "javadoc", "none")
IR_VERSION = 1


class GraphError(ValueError):
    """A rule of the model is broken."""


@dataclass(frozen=True)
class Graph:
    """Tables of a code graph; ``nodes`` has the key columns that joins need."""

    subprojects: DataFrame
    nodes: DataFrame
    edges: DataFrame
    skipped: DataFrame
    root: str = "repository"

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def cache(self) -> Graph:
        return replace(self, nodes=self.nodes.cache(), edges=self.edges.cache(), subprojects=self.subprojects.cache())

    def nodes_of(self, *kinds: str) -> DataFrame:
        return self.nodes.where(F.col("kind").isin(*kinds)) if kinds else self.nodes

    def edges_of(self, *kinds: str) -> DataFrame:
        return self.edges.where(F.col("kind").isin(*kinds))

    @property
    def modules(self) -> DataFrame:
        return self.nodes_of("module")


def with_keys(nodes: DataFrame) -> DataFrame:
    """Add qualname, parent_id and file once, so that joins are equalities of columns."""
    key = F.col("id")
    return nodes.withColumns({"qualname": N.qualname(key), "parent_id": N.parent_id(key), "file": F.col("location.file")})


def first_edges(edges: DataFrame, order: str | None = None) -> DataFrame:
    """One edge of each (source, target, kind, certainty): the first by ``order``, else by place."""
    key = ["source", "target", "kind", "certainty"]
    place = [order] if order else [F.col("location.file").asc_nulls_last(), F.col("location.line").asc_nulls_last()]
    ranked = edges.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*place)))
    return ranked.where("_n = 1").select(*key, "location")


def make(spark: SparkSession, nodes: DataFrame, edges: DataFrame, subprojects: DataFrame, skipped: DataFrame | None = None, root: str = "repository") -> Graph:
    return Graph(subprojects, with_keys(nodes), edges, skipped if skipped is not None else spark.createDataFrame([], SKIPPED), root)


def from_rows(spark: SparkSession, nodes: Iterable = (), edges: Iterable = (), subprojects: Iterable = (), skipped: Iterable = ()) -> Graph:
    """A graph from rows; nodes are dicts that may leave out what is usual."""
    usual = dict(visibility="public", signature="", doc=None, modifiers=[], complexity=None, loc=0)
    rows = []
    for n in nodes:
        n = {**usual, "name": n["id"].replace("/", ".").rsplit(".", 1)[-1], "subproject": n["id"].split("/", 1)[0], "file": n["id"], "line": 1} | n
        rows.append((n["id"], n["kind"], n["name"], n["subproject"], (n["file"], n["line"]), n["visibility"], n["signature"], n["doc"], sorted(set(n["modifiers"])), n["complexity"], n["loc"]))
    links = [(e[0], e[1], e[2], e[3] if len(e) > 3 else "certain", e[4] if len(e) > 4 else None) for e in edges]
    subs = [tuple(s) + ("", "", [])[len(s) - 3 :] if len(s) < 6 else tuple(s) for s in subprojects]
    return make(
        spark,
        spark.createDataFrame(rows, NODES),
        spark.createDataFrame(links, EDGES),
        spark.createDataFrame(subs, SUBPROJECTS),
        spark.createDataFrame(list(skipped), SKIPPED),
    )


def problems(graph: Graph) -> DataFrame:
    """(rule, id): what breaks the model's rules; empty for a sound graph."""
    subs = graph.subprojects.select(F.col("id").alias("known"))
    ids = graph.nodes.select(F.col("id").alias("known"))

    def rule(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("rule"), F.col("id").cast("string").alias("id"))

    ends = graph.edges.select("kind", F.explode(F.array("source", "target")).alias("id"))
    parts = [
        rule("duplicate subproject", graph.subprojects.groupBy("id").count().where("count > 1")),
        rule("duplicate node", graph.nodes.groupBy("id").count().where("count > 1")),
        rule("unknown subproject", graph.nodes.join(subs, F.col("subproject") == F.col("known"), "left_anti")),
        rule("unknown end", ends.where("kind <> 'service_dep'").join(ids, F.col("id") == F.col("known"), "left_anti").distinct()),
        rule("unknown end", ends.where("kind = 'service_dep'").join(subs, F.col("id") == F.col("known"), "left_anti").distinct()),
        rule("unknown kind", graph.nodes.where(~F.col("kind").isin(*NODE_KINDS))),
        rule("unknown kind", graph.edges.where(~F.col("kind").isin(*EDGE_KINDS)).select(F.col("kind").alias("id"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check(graph: Graph) -> Graph:
    """The graph, or a :class:`GraphError` that names a broken rule."""
    found = problems(graph).limit(1).collect()
    if found:
        raise GraphError(f"{found[0]['rule']}: {found[0]['id']}")
    return graph


TABLES = ("subprojects", "nodes", "edges", "skipped")


def save(graph: Graph, path: str) -> None:
    """Write the tables as Parquet; nodes and edges lie in a folder for each subproject."""
    graph.subprojects.write.mode("overwrite").parquet(f"{path}/subprojects")
    graph.nodes.drop("qualname", "parent_id", "file").write.mode("overwrite").partitionBy("subproject").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    graph.skipped.write.mode("overwrite").parquet(f"{path}/skipped")


def load(spark: SparkSession, path: str) -> Graph:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    nodes = read("nodes", NODES)
    names = spark.createDataFrame([], NODES).columns
    return make(spark, nodes.select(*names), read("edges", EDGES), read("subprojects", SUBPROJECTS), read("skipped", SKIPPED))


def create_views(graph: Graph, prefix: str = "") -> None:
    """Offer the tables to SQL."""
    for name in TABLES:
        getattr(graph, name).createOrReplaceTempView(f"{prefix}{name}")
