"""Reading order, module priority and the budgeted map of a repository."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.functions import names as N
from cartolith.plans.graph import Graph
from cartolith.plans.lineage import cut

from .entrypoints import entry_points
from .health import fan_in_out
from .packages import package_layers

#: Reasons of the tour, the least budget, and omitted names shown.
ENTRY, LAYER, OTHER = "point d'entrée", "couche ", "autres"
MIN_BUDGET, DEFAULT_BUDGET, OMITTED_SHOWN = 2000, 24000, 10


def _entry_nodes(graph: Graph) -> DataFrame:
    found = entry_points(graph).select(F.col("node_id").alias("id")).distinct()
    return found.join(graph.nodes.select("id", "kind", "parent_id"), "id")


def reading_tour(graph: Graph) -> DataFrame:
    """(step, module, reason, page): entry modules, then layers from the top, then the rest."""
    owner = F.when(F.col("kind") == "module", F.col("id")).otherwise(F.col("parent_id"))
    entries = _entry_nodes(graph).select(owner.alias("id")).distinct().withColumn("entry", F.lit(True))
    several = graph.subprojects.agg((F.count("*") > 1).alias("several"))
    rows = (
        graph.modules.select("id", N.package_of(F.col("qualname")).alias("package"))
        .join(entries, "id", "left")
        .join(package_layers(graph), "package", "left")
        .crossJoin(F.broadcast(several))  # one row
    )
    group = F.when(F.col("entry"), 0).when(F.col("level").isNotNull(), 1).otherwise(2)
    reason = F.when(F.col("entry"), ENTRY).when(F.col("level").isNotNull(), F.concat(F.lit(LAYER), "layer")).otherwise(OTHER)
    order = Window.orderBy(group, F.when(group == 1, -F.col("level")), "id")  # modules only, a row each
    return rows.select(
        F.row_number().over(order).alias("step"), N.display_name(F.col("id"), F.col("several")).alias("module"), reason.alias("reason"),
        F.concat(F.lit("modules/"), N.page_slug(F.col("id"), F.col("several")), F.lit(".md")).alias("page"),
    ).orderBy("step")


def module_priority(graph: Graph) -> DataFrame:
    """(position, module_id, is_entry, fan_in): modules with entry points, then by how many import them."""
    nodes = _entry_nodes(graph)
    up = N.parent_id(F.col("parent_id"))
    owners = F.when(F.col("kind") == "module", F.array("id")).otherwise(F.array(F.col("parent_id"), F.coalesce(up, F.col("parent_id"))))
    entries = nodes.select(F.explode(owners).alias("module_id")).distinct().withColumn("is_entry", F.lit(True))
    rows = fan_in_out(graph).join(entries, "module_id", "left").select("module_id", F.coalesce("is_entry", F.lit(False)).alias("is_entry"), "fan_in")
    order = Window.orderBy(F.desc("is_entry"), F.desc("fan_in"), "module_id")
    return rows.withColumn("position", F.row_number().over(order)).select("position", "module_id", "is_entry", "fan_in").orderBy("position")


def module_blocks(graph: Graph) -> DataFrame:
    """(module_id, block): the public surface of each module as text."""
    doc = F.when(F.col("doc").isNotNull(), F.concat(F.lit(" — "), "doc.summary")).otherwise("")
    public = graph.nodes.where("visibility = 'public'").select("id", "kind", "name", "signature", "parent_id", doc.alias("d"))
    kinds = F.array(*[F.lit(k) for k in ("class", "interface", "enum")])
    types = public.where(F.col("kind").isin("class", "interface", "enum")).withColumn("rank", F.array_position(kinds, F.col("kind")))
    code = F.concat(F.lit("`"), "name", "signature", F.lit("`"), "d")
    heads = types.select(F.col("parent_id").alias("module_id"), F.struct("rank", F.col("id").alias("a"), F.lit("").alias("b"), F.concat(F.lit("- **"), "name", F.lit("**"), "d").alias("text")).alias("line"))
    owner = types.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("module_id"), "rank")
    methods = public.where("kind = 'method'").join(owner, "parent_id").select("module_id", F.struct("rank", F.col("parent_id").alias("a"), F.col("id").alias("b"), F.concat(F.lit("  - "), code).alias("text")).alias("line"))
    free = public.where("kind = 'function'").select(F.col("parent_id").alias("module_id"), F.struct(F.lit(9).cast("long").alias("rank"), F.col("id").alias("a"), F.lit("").alias("b"), F.concat(F.lit("- "), code).alias("text")).alias("line"))
    lines = heads.unionByName(methods).unionByName(free).groupBy("module_id").agg(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["text"]).alias("lines"))
    top = graph.modules.select(F.col("id").alias("module_id"), F.concat(F.lit("### "), "qualname").alias("title"), "doc.summary")
    text = F.concat_ws("\n", "title", "summary", F.array_join("lines", "\n"))
    return top.join(lines, "module_id", "left").select("module_id", F.concat(text, F.lit("\n")).alias("block"))


#: Blocks of a range that is judged as a whole first.
RANGE_ROWS = 65_536


def _taken(sizes: list[int], used: int, budget: int) -> tuple[list[bool], int]:
    """Which blocks of a list fit, one after the other, and what is used then."""
    out = []
    for size in sizes:
        out.append(used + size <= budget)
        used += size if out[-1] else 0
    return out, used


def within_budget(blocks: DataFrame, budget: int, used: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(position, id, size, included) of ``blocks(position, id, size)``: a block too large is skipped, later ones may still fit.

    What is used depends on each choice before. The blocks are dealt into ranges
    in order, and the driver goes over what these add up to (a row a range): a
    range whose total still fits is taken whole, one whose least block does not is
    skipped whole. Only a range between the two is gone through, by one task, a
    block at a time, before the next one is judged; it takes one block at least,
    so that the budget bounds how many are. A last pass marks all ranges at once.
    """
    narrow = blocks.select("position", "id", F.col("size").cast("long").alias("size"))
    ranges = max(1, -(-narrow.count() // range_rows))
    dealt = cut(narrow.repartitionByRange(ranges, "position", "id").sortWithinPartitions("position", "id").withColumn("range", F.spark_partition_id()), ordered=True)
    begin: dict[int, int | None] = {}  # what is used where a range begins that is gone through; None: skipped

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = used
        for b in batches:
            _, now = _taken(b.column("size").to_pylist(), now, budget)
        yield pa.RecordBatch.from_pydict({"used": [now]})

    for r in dealt.groupBy("range").agg(F.min("size").alias("least"), F.sum("size").alias("total")).orderBy("range").collect():
        begin[r["range"]] = used if used + r["least"] <= budget else None
        if used + r["total"] <= budget:
            used += r["total"]
        elif begin[r["range"]] is not None:
            could = dealt.where((F.col("range") == r["range"]) & (F.col("size") <= budget - used)).select("size")
            used = could.mapInArrow(last, "used long").agg(F.max("used").alias("used")).first()["used"]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, now = None, None
        for b in batches:
            numbers, sizes, out = b.column("range").to_pylist(), b.column("size").to_pylist(), []
            at = 0
            while at < len(numbers):  # a task may hold some ranges, one after the other
                end = bisect_right(numbers, numbers[at], at)
                if numbers[at] != place:
                    place, now = numbers[at], begin[numbers[at]]
                if now is None:
                    out += [False] * (end - at)
                else:
                    took, now = _taken(sizes[at:end], now, budget)
                    out += took
                at = end
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("position", "id", "size")), pa.array(out, pa.bool_())], names=["position", "id", "size", "included"])

    return dealt.mapInArrow(marked, T.StructType([*dealt.drop("range").schema.fields, T.StructField("included", T.BooleanType())]))
