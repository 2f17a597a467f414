"""Keeping a graph up to date: changed paths in, rewritten parts of the tables out.

Nodes and most edges belong to one subproject, so a change rereads the
subprojects that own changed files and keeps the rest; links between
subprojects are made anew. The result equals a cold run. :func:`update` does so
with a graph at hand; a :class:`Workshop` keeps its versions in a
:class:`~cartolith.streaming.store.GraphStore`, which reads the changed files
alone, and is fed by :func:`watch` or any other stream of paths.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.operators.lookup import owning_subproject
from cartolith.plans.graph import Graph
from cartolith.plans.lineage import cut
from cartolith.sources import listing, repository
from cartolith.sources.config import Config
from cartolith.sources.listing import Wanted

from .store import GraphStore, is_structural

#: Folders and endings whose changes do not matter, and the pause that gathers a burst.
NOISE_FOLDERS = (".git", ".cartolith", ".venv", "venv", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache")
NOISE_ENDINGS = ("~", ".swp", ".swx", ".tmp", ".part")
DEBOUNCE = "300 milliseconds"


def is_noise(path: str) -> bool:
    *folders, name = path.split("/")
    return name.endswith(NOISE_ENDINGS) or any(f in NOISE_FOLDERS for f in [*folders, name])


def without_noise(changes: DataFrame) -> DataFrame:
    """The rows of ``changes(path, …)`` that matter."""
    ends = "|".join(re.escape(e) for e in NOISE_ENDINGS)
    return changes.where(~F.col("path").rlike(f"({ends})$") & ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(f) for f in NOISE_FOLDERS])))


def code_extensions() -> tuple[str, ...]:
    return tuple(e for language in repository.LANGUAGES.values() for e in language.extensions)


def affected(graph: Graph, paths: Iterable[str]) -> list[str]:
    """The subprojects that own changed code files."""
    code = [(p,) for p in sorted(set(paths)) if p.endswith(code_extensions())]
    subs = graph.subprojects.collect()
    if len(subs) <= 1 or all(s["root"] == "." for s in subs):
        ends = {s["id"]: repository.LANGUAGES[s["language"]].extensions for s in subs if s["language"] in repository.LANGUAGES}
        return sorted(i for i, e in ends.items() if any(p.endswith(e) for (p,) in code))
    if not code:
        return []
    owners = owning_subproject(graph.spark.createDataFrame(code, "path string"), graph.subprojects)
    language = graph.subprojects.select(F.col("id").alias("subproject"), "language")
    owned = owners.join(language, "subproject").collect()  # a row a changed file
    known = repository.LANGUAGES
    return sorted({r["subproject"] for r in owned if r["language"] in known and r["path"].endswith(known[r["language"]].extensions)})


def update(graph: Graph | None, root: str, changed: Iterable[str] | None, spark: SparkSession, config: Config | None = None) -> Graph:
    """The graph after changes; without a graph or changes, or after structural ones, a cold run."""
    config = config or Config()
    if graph is None or changed is None or any(is_structural(p) for p in changed):
        return repository.analyse(spark, root, config)
    changed = set(changed)
    if not any(p.endswith(code_extensions()) for p in changed):
        return graph
    touched = affected(graph, changed)
    files = repository.list_files(spark, root, config.analysis.exclude)
    subs, units = repository.plan_units(spark, files, config)
    if not touched or {u[0] for u in units} != {r["subproject"] for r in graph.nodes.select("subproject").distinct().collect()}:
        return repository.analyse(spark, root, config, files=files)
    fresh = repository.analyse(spark, root, config, only=touched, files=files)
    sub_of = lambda c: F.substring_index(c, "/", 1)
    stays = ~F.col("subproject").isin(*touched)
    nodes = cut(graph.nodes.where(stays).unionByName(fresh.nodes))
    kept = graph.edges.where((F.col("kind") != "service_dep") & ~sub_of("source").isin(*touched))
    own = kept.unionByName(fresh.edges.where("kind <> 'service_dep'"))
    links = repository.service_links(nodes, fresh.subprojects)
    owners = owning_subproject(graph.skipped, graph.subprojects) if len(subs) > 1 else None
    if owners is None:
        ends = tuple(e for u in units if u[0] in touched for e in repository.LANGUAGES[u[1]].extensions)
        old_skipped = graph.skipped.where(~F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1)).isin(*ends))
    else:
        old_skipped = graph.skipped.join(owners.where(~F.col("subproject").isin(*touched)).select("path"), "path", "left_semi")
    return replace(fresh, nodes=nodes, edges=cut(own.unionByName(links)), skipped=cut(old_skipped.unionByName(fresh.skipped)))


def snapshot(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """(path, digest) of the files that matter, for a watcher that polls."""
    files = repository.list_files(spark, root, (config or Config()).analysis.exclude)
    return files.select("path", F.sha2(F.coalesce("content", F.lit(b"")), 256).alias("digest"))


def changes_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path): files that came, went or have other content."""
    both = old.withColumnRenamed("digest", "before").join(new.withColumnRenamed("digest", "after"), "path", "full_outer")
    return without_noise(both.where(~F.col("before").eqNullSafe(F.col("after"))).select("path"))


class Workshop:
    """Versions of a graph in a store, kept up to date by batches of changed paths."""

    def __init__(self, spark: SparkSession, root: str, store: str, config: Config | None = None, listen: Callable[[str, object], None] | None = None) -> None:
        self.spark, self.root, self.config = spark, root, config or Config()
        self.store = GraphStore(spark, store)
        self.token = (self.store.versions() or [0])[-1]
        self.warned: set[str] = set()
        self.listen = listen or (lambda event, value: None)

    def build(self, changed: Iterable[str] | None = None) -> bool:
        """Bring the store up to date; where that fails, the version before stays."""
        start = time.monotonic()
        try:
            self.token = self.store.update(self.root, changed, self.config)
        except Exception as e:  # a broken state of the sources must not end the session
            self.listen("error", str(e))
            return False
        for r in self.current().skipped.orderBy("path").collect():
            if r["path"] not in self.warned:
                self.warned.add(r["path"])
                self.listen("warning", (r["path"], r["reason"]))
        self.listen("build" if changed is None else "reload", round(time.monotonic() - start, 3))
        return True

    def apply(self, batch: DataFrame, batch_id: int = 0) -> None:
        """One micro-batch of ``path`` rows; each path counts once."""
        paths = {r["path"] for r in without_noise(batch.select("path")).distinct().collect()}
        if paths:
            self.build(paths)

    def current(self) -> Graph:
        return self.store.load()


def follow(changes: DataFrame, workshop: Workshop, checkpoint: str, once: bool = False):
    """Feed a stream of ``path`` rows to a workshop; a trigger gathers what comes in a burst."""
    writer = changes.writeStream.foreachBatch(workshop.apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()


def watch(spark: SparkSession, root: str, state: str, config: Config | None = None, slices: int = 4) -> DataFrame:
    """The stream of changed files below ``root`` that are not noise; ``state`` is a folder that all executors share."""
    wanted = Wanted(patterns=(config or Config()).analysis.exclude, left_out=NOISE_FOLDERS, left_endings=NOISE_ENDINGS)
    return listing.watch(spark, root, state, wanted, slices)
