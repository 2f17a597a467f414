"""From a folder of sources to a graph: files, subprojects, facts, resolution, assembly."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.operators.flow import service_edges
from cartolith.plans import resolve
from cartolith.plans.graph import EDGES, SKIPPED, SUBPROJECTS, Graph, with_keys
from cartolith.plans.lineage import cut, ship_package

from . import braces, python_facts
from .config import Config
from .listing import Wanted, list_tree, open_folder
from .patterns import excluder  # noqa: F401  offered here as well


@dataclass(frozen=True)
class Language:
    """How a language is read: its files, the facts of one, and their resolution."""

    extensions: tuple[str, ...]
    extract: Callable[[str, str, str], list[dict]]
    resolver: type[resolve.PythonResolver]


LANGUAGES: dict[str, Language] = {
    "java": Language((".java",), braces.extract, resolve.JavaResolver),
    "javascript": Language((".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"), braces.extract, resolve.ScriptResolver),
    "python": Language((".py",), python_facts.extract, resolve.PythonResolver),
}
#: Manifests by priority, and extensions that tell a language.
MANIFESTS = (
    ("pyproject.toml", "python"), ("setup.py", "python"), ("package.json", "javascript"), ("pom.xml", "java"),
    ("build.gradle", "java"), ("build.gradle.kts", "java"), ("go.mod", "go"),
)
TELLING = {".py": "python", ".ts": "javascript", ".tsx": "javascript", ".js": "javascript", ".jsx": "javascript", ".java": "java"}
NOT_UTF8 = "encodage non UTF-8"
NAME = re.compile(r"[A-Za-z0-9_.-]+")


class NothingToAnalyse(ValueError):
    """No file of a known language."""


def register_language(name: str, extensions: Iterable[str], extract: Callable[[str, str, str], list[dict]], resolver: type[resolve.PythonResolver] = resolve.PythonResolver) -> None:
    """Add a language: a function of (subproject, path, text) to facts, and the resolver for these."""
    LANGUAGES[name] = Language(tuple(extensions), extract, resolver)


#: Files that a task reads.
FILES_PER_TASK = 256


def wanted_files(patterns: Iterable[str]) -> Wanted:
    """Source files of the known languages, and manifests, but for those that a pattern excludes."""
    known = tuple(e for language in LANGUAGES.values() for e in language.extensions)
    return Wanted(tuple(patterns), known, tuple(name for name, _ in MANIFESTS))


def read_files(paths: DataFrame, root: str) -> DataFrame:
    """(path, content, error) of files below a folder, read by the executors; an unreadable one has an error."""
    ship_package(paths.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_folder(root)
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    with fs.open_input_stream(f"{base.rstrip('/')}/{path}", compression=None) as f:
                        rows.append((path, f.read(), None))
                except OSError as e:
                    rows.append((path, None, f"lecture impossible : {e.strerror or e}"))
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return paths.mapInPandas(run, "path string, content binary, error string")


def list_files(spark: SparkSession, root: str, patterns: Iterable[str]) -> DataFrame:
    """(path, content, error) of the source files and manifests below a folder; excluded folders are not entered.

    Spark's own file sources leave out names that begin with an underscore,
    package files among them, so the listing is by the file system itself.
    """
    paths = list_tree(spark, root, wanted_files(patterns))
    tasks = max(1, -(-paths.count() // FILES_PER_TASK))
    return cut(read_files(paths.repartition(tasks), root))


def sources(files: DataFrame, extensions: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """(path, text) of the files with some extensions, and (path, reason) of those that cannot be read as UTF-8."""
    wanted = files.where(F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1)).isin(*extensions))
    raw = F.col("content").cast("string")
    good = wanted.where("content is not null").where(F.is_valid_utf8(raw)).select("path", F.regexp_replace(raw, "\r\n?", "\n").alias("text"))
    bad = wanted.where(F.col("content").isNull() | ~F.is_valid_utf8(raw)).select("path", F.coalesce("error", F.lit(NOT_UTF8)).alias("reason"))
    return good, bad


def _first_group(pattern: str) -> Callable[[str], str]:
    """A reader of one value: the first group of a pattern, or nothing."""
    return lambda text: next((m[1].strip() for m in re.finditer(pattern, text)), "")


@dataclass(frozen=True)
class ManifestReader:
    """What makes values of a manifest's text, and the paths to the project's name and its dependencies in them."""

    read: Callable[[str], object]
    name: tuple[str, ...] = ()
    needs: tuple[tuple[str, ...], ...] = ()


#: Where manifests keep names and dependencies.
READERS = {
    "package.json": ManifestReader(json.loads, ("name",), (("dependencies",), ("devDependencies",))),
    "pyproject.toml": ManifestReader(tomllib.loads, ("project", "name"), (("project", "dependencies"),)),
    "pom.xml": ManifestReader(_first_group("<artifactId>([^<]+)</artifactId>")),
    "go.mod": ManifestReader(_first_group(r"\A(?:module)?(.*)")),
}


def _at(value: object, path: tuple[str, ...]) -> object:
    for key in path:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def manifest_values(file: str, text: str) -> tuple[str, set[str]]:
    """The project's name and the names it depends on; both empty where the manifest has none or cannot be read."""
    reader = READERS.get(file)
    try:
        data = reader.read(text) if reader else None
    except ValueError:
        data = None
    if data is None:
        return "", set()
    needs: set[str] = set()
    for found in (_at(data, path) for path in reader.needs):
        if isinstance(found, dict):
            needs.update(found)
        elif isinstance(found, list):  # requirements: the name stands before the version
            needs.update(m[0] for x in found if (m := NAME.match(str(x).strip())))
    name = _at(data, reader.name)
    return "" if name is None else str(name), needs


def subprojects_of(manifests: list[tuple[str, str]], roots: tuple[str, ...] = (), languages: dict[str, str] | None = None) -> list[tuple]:
    """Rows of subprojects from (path, text) of manifests; forced ``roots`` bypass discovery."""
    order = {name: (k, language) for k, (name, language) in enumerate(MANIFESTS)}
    best: dict[str, tuple[int, str, str, str]] = {}
    for path, text in sorted(manifests):
        folder, _, file = path.rpartition("/")
        rank, language = order[file]
        folder = folder or "."
        if (not roots or folder in roots) and (folder not in best or rank < best[folder][0]):
            best[folder] = (rank, language, path, text)
    for folder in roots:
        best.setdefault(folder, (99, (languages or {}).get(folder, "unknown"), "", ""))
    ids = {folder: "main" if folder == "." else folder.replace("/", "-") for folder in best}
    told = {folder: manifest_values(path.rpartition("/")[2], text) for folder, (_, _, path, text) in best.items()}
    by_name = {name: ids[folder] for folder, (name, _) in told.items() if name}
    rows = []
    for folder, (_, language, path, _) in best.items():
        name, needs = told[folder]
        wanted = {by_name[d] for d in needs if d in by_name} - {ids[folder]}
        rows.append((ids[folder], language, folder, path, name, sorted(wanted)))
    return sorted(rows)


def dominant_languages(files: DataFrame, roots: tuple[str, ...]) -> dict[str, str]:
    """The language most files below each forced root are in; the first by name of equals."""
    table = F.create_map(*[F.lit(x) for pair in TELLING.items() for x in pair])
    tells = files.select("path", F.element_at(table, F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1))).alias("language")).where("language is not null")
    below = F.explode(F.filter(F.array(*[F.lit(r) for r in roots]), lambda r: (r == ".") | F.col("path").startswith(F.concat(r, F.lit("/")))))
    counted = tells.select("language", below.alias("root")).groupBy("root", "language").count()
    best = counted.groupBy("root").agg(F.min(F.struct(-F.col("count"), F.col("language").alias("l")))["l"].alias("language"))
    return {r["root"]: r["language"] for r in best.collect()}  # a row a root


def plan_units(spark: SparkSession, files: DataFrame, config: Config) -> tuple[list[tuple], list[tuple[str, str, str]]]:
    """Subprojects, and units to analyse as (subproject, language, root)."""
    wanted = lambda language: not config.analysis.languages or language in config.analysis.languages
    subs: list[tuple] = []
    if config.monorepo.detect:
        named = files.where(F.element_at(F.split("path", "/"), -1).isin(*[n for n, _ in MANIFESTS]))
        manifests = [(r["path"], r["text"]) for r in named.select("path", F.col("content").cast("string").alias("text")).collect()]  # a row a manifest
        roots = tuple(config.monorepo.roots)
        subs = subprojects_of(manifests, roots, dominant_languages(files, roots) if roots else None)
    if len(subs) > 1:
        return subs, [(s[0], s[1], s[2]) for s in subs if s[1] in LANGUAGES and wanted(s[1])]
    units, rows = [], []
    for language in sorted(LANGUAGES):
        if wanted(language) and not files.where(F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1)).isin(*LANGUAGES[language].extensions)).isEmpty():
            sub = "main" if not units else f"main-{language}"
            units.append((sub, language, "."))
            rows.append((sub, language, ".", "", "", []))
    return rows, units


def facts_of(texts: DataFrame, language: str) -> DataFrame:
    """Facts of (sub, path, text); one pass a file, all files apart."""
    ship_package(texts.sparkSession)
    extract = LANGUAGES[language].extract

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for sub, path, text in zip(pdf["sub"], pdf["path"], pdf["text"], strict=True) for r in extract(sub, path, text)]
            frame = pd.DataFrame(rows, columns=python_facts.COLUMNS, dtype=object)
            yield frame.where(frame.notna(), None)

    return texts.select("sub", "path", "text").mapInPandas(run, python_facts.FACTS)


def inner_roots(folder: str, roots: Iterable[str]) -> list[str]:
    """Roots of other subprojects below a folder."""
    return [r for r in roots if r != folder and (folder == "." or r.startswith(f"{folder}/"))]


def unit_facts(files: DataFrame, sub: str, language: str, folder: str, roots: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Facts of a unit's files, with paths below its folder, and (path, reason) of those that cannot be read."""
    mine = files if folder == "." else files.where(F.col("path").startswith(f"{folder}/"))
    for r in inner_roots(folder, roots):
        mine = mine.where(~F.col("path").startswith(f"{r}/"))
    good, bad = sources(mine, LANGUAGES[language].extensions)
    cut_at = 1 if folder == "." else len(folder) + 2
    return facts_of(good.select(F.lit(sub).alias("sub"), F.substring("path", F.lit(cut_at), F.length("path")).alias("path"), "text"), language), bad


def resolved(facts: DataFrame, language: str, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and skipped files of a unit, with paths below the repository's root."""
    found = LANGUAGES[language].resolver(facts)
    prefix = F.lit("" if folder == "." else f"{folder}/")
    place = F.when(F.col("location").isNotNull(), F.struct(F.concat(prefix, "location.file").alias("file"), F.col("location.line").alias("line")))
    skipped = resolve.skipped_of(found.facts).select(F.concat(prefix, "path").alias("path"), "reason")
    return found.nodes().withColumn("location", place), found.edges().withColumn("location", place), skipped


def analyse(spark: SparkSession, root: str, config: Config | None = None, only: Iterable[str] | None = None, files: DataFrame | None = None) -> Graph:
    """The graph of the sources below ``root``; ``only``: the subprojects to read, for an update; ``files``: as :func:`list_files` gave them."""
    config = config or Config()
    files = list_files(spark, root, config.analysis.exclude) if files is None else files
    subs, units = plan_units(spark, files, config)
    if not units:
        raise NothingToAnalyse(f"aucun fichier analysable trouvé dans {root}")
    if only is not None:
        units = [u for u in units if u[0] in set(only)]
    nodes, edges, skipped = [], [], []
    for sub, language, folder in units:
        facts, bad = unit_facts(files, sub, language, folder, [s[2] for s in subs])
        own_nodes, own_edges, own_skipped = resolved(facts, language, folder)
        nodes.append(own_nodes)
        edges.append(own_edges)
        skipped += [own_skipped, bad]
    name = root.rstrip("/").rpartition("/")[2]
    return assemble(spark, subs, nodes, edges, skipped, name)


def _union(frames: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = empty
    for f in frames:
        out = out.unionByName(f)
    return out


def service_links(nodes: DataFrame, subprojects: DataFrame) -> DataFrame:
    """Edges between subprojects."""
    place = F.lit(None).cast("struct<file: string, line: int>")
    return service_edges(nodes, subprojects).select(
        "source", "target", F.lit("service_dep").alias("kind"), F.lit("certain").alias("certainty"), place.alias("location")
    )


def between_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose ends are both among the nodes."""
    ids = nodes.select("id")
    own = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return own.select("source", "target", "kind", "certainty", "location")


def assemble(spark: SparkSession, subs: list[tuple], nodes: list[DataFrame], edges: list[DataFrame], skipped: list[DataFrame], root: str) -> Graph:
    """One graph from fragments, with the links between subprojects."""
    table = spark.createDataFrame(subs, SUBPROJECTS)
    every = nodes[0]
    for n in nodes[1:]:
        every = every.unionByName(n)
    every = cut(every)
    own = between_nodes(_union(edges, spark.createDataFrame([], EDGES)), every)
    return Graph(table, with_keys(every), cut(own.unionByName(service_links(every, table))), cut(_union(skipped, spark.createDataFrame([], SKIPPED))), root)
