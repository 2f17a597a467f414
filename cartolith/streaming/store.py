"""A graph as copy-on-write tables with a log of manifests.

A version is one JSON file in ``log``, which names the fragments that make it up;
fragments in ``data`` are written once and never changed, and versions share
them. Each unit (a subproject, or a language of a single project) has

* facts: what its files say, a row a fact. Facts are kept as a log: a change adds
  the facts of the changed files and names the paths they replace, so that only
  these files are read again; beyond ``MOST_PARTS`` parts the log becomes one;
* nodes, edges, skipped files and names of packages used: made anew for a unit
  whose facts have changed, by the same joins as a cold run makes them.

Links between subprojects come from the (small) used names of all units. So what
a change reads and writes grows with the changed files and the units that own
them, whatever the size of the rest; and a version equals a cold run. A version
is there once its manifest is there: readers of another one are not disturbed.
A cold run follows where manifests, the configuration or the set of units change.

The store is a folder that all executors share; there is one writer at a time.
:meth:`GraphStore.vacuum` deletes fragments that no kept version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.plans.graph import EDGES, NODES, SKIPPED, SUBPROJECTS, Graph, with_keys
from cartolith.plans.lineage import cut
from cartolith.sources import python_facts, repository
from cartolith.sources.config import FILE, Config
from cartolith.sources.listing import open_folder
from cartolith.sources.patterns import excluder

STRUCTURAL = frozenset({name for name, _ in repository.MANIFESTS} | {FILE})
#: Parts of a unit's facts beyond which they are written as one.
MOST_PARTS = 8
USED = "kind string, subproject string, modifiers array<string>"
_SCHEMAS = {"nodes": NODES, "edges": EDGES, "skipped": SKIPPED, "used": USED, "facts": python_facts.FACTS}


def is_structural(path: str) -> bool:
    """A manifest or the configuration may change which subprojects there are."""
    return path.rsplit("/", 1)[-1] in STRUCTURAL


def owner(path: str, manifest: dict) -> dict | None:
    """The unit that owns a code file: that of the deepest subproject above it, if it has the file's language."""
    roots = {s[2] for s in manifest["subprojects"]}
    folder = path.rpartition("/")[0]
    while folder and folder not in roots:
        folder = folder.rpartition("/")[0]
    for unit in manifest["units"]:
        if unit["folder"] == (folder or ".") and path.endswith(repository.LANGUAGES[unit["language"]].extensions):
            return unit
    return None


class UnitsChanged(Exception):
    """The set of units is another one."""


class GraphStore:
    """Versions of a graph in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.uri = folder.rstrip("/") if "://" in folder or folder.startswith("file:") else f"file://{Path(folder).resolve()}"

    # the log

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return open_folder(self.uri)

    def versions(self) -> list[int]:
        fs, base = self._fs()
        found = fs.get_file_info(pafs.FileSelector(f"{base}/log", allow_not_found=True))
        return sorted(int(i.base_name.removesuffix(".json")) for i in found if i.base_name.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """What makes up a version (the last one); None if there is none."""
        there = self.versions()
        if version is None and not there:
            return None
        fs, base = self._fs()
        with fs.open_input_stream(f"{base}/log/{there[-1] if version is None else version:08d}.json") as f:
            return json.loads(f.read())

    def _commit(self, manifest: dict) -> int:
        fs, base = self._fs()
        version = (self.versions() or [0])[-1] + 1
        fs.create_dir(f"{base}/log")
        part = f"{base}/log/{version:08d}.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(part) as f:
            f.write(json.dumps(manifest | {"version": version}, ensure_ascii=False, sort_keys=True).encode())
        if fs.get_file_info(f"{base}/log/{version:08d}.json").type != pafs.FileType.NotFound:
            raise FileExistsError(f"version {version} has come from another writer")
        fs.move(part, f"{base}/log/{version:08d}.json")
        return version

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the last versions, and the fragments that these do not name; how many went."""
        fs, base = self._fs()
        there = self.versions()
        named = {p for v in there[-keep:] for p in self._named(self.manifest(v))}
        for v in there[:-keep]:
            fs.delete_file(f"{base}/log/{v:08d}.json")
        old = [i for i in fs.get_file_info(pafs.FileSelector(f"{base}/data", allow_not_found=True)) if f"data/{i.base_name}" not in named]
        for i in old:
            fs.delete_dir(i.path)
        return len(old)

    @staticmethod
    def _named(manifest: dict) -> set[str]:
        parts = {p["path"] for u in manifest["units"] for p in u["facts"]}
        return parts | {u[t] for u in manifest["units"] for t in ("nodes", "edges", "skipped", "used")} | {manifest["links"]}

    # fragments

    def _write(self, df: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.uri}/{name}")
        return name

    def _read(self, table: str, names: Iterable[str]) -> DataFrame:
        names = [f"{self.uri}/{n}" for n in names]
        if not names:
            return self.spark.createDataFrame([], _SCHEMAS[table])
        return self.spark.read.schema(_SCHEMAS[table]).parquet(*names)

    def facts(self, unit: dict) -> DataFrame:
        """The facts of a unit: of each path those of the last part that has it."""
        out, replaced = self._read("facts", []), set()
        for part in reversed(unit["facts"]):
            own = self._read("facts", [part["path"]])
            out = out.unionByName(own.where(~F.col("path").isin(*sorted(replaced))) if replaced else own)
            replaced |= set(part["replaces"])
        return out

    def load(self, version: int | None = None) -> Graph:
        """The graph of a version, the last if none is named."""
        m = self.manifest(version)
        if m is None:
            raise FileNotFoundError(f"no version in {self.uri}")
        read = lambda t: self._read(t, [u[t] for u in m["units"]])
        edges = read("edges").unionByName(self._read("edges", [m["links"]]))
        subs = self.spark.createDataFrame([tuple(s) for s in m["subprojects"]], SUBPROJECTS)
        return Graph(subs, with_keys(read("nodes")), edges, read("skipped"), m["root"])

    # writing

    def _resolved(self, unit: dict) -> dict:
        """The unit with tables made anew from its facts."""
        nodes, edges, skipped = repository.resolved(self.facts(unit), unit["language"], unit["folder"])
        nodes = cut(nodes)
        names = F.filter("modifiers", lambda x: x.startswith("ext-import:"))
        used = nodes.where("kind = 'module'").select("kind", "subproject", F.explode(names).alias("m")).distinct()
        made = {
            "nodes": nodes, "edges": repository.between_nodes(edges, nodes), "skipped": skipped,
            "used": used.select("kind", "subproject", F.array("m").alias("modifiers")),
        }
        return unit | {t: self._write(df) for t, df in made.items()}

    def _with_links(self, manifest: dict) -> dict:
        subs = self.spark.createDataFrame([tuple(s) for s in manifest["subprojects"]], SUBPROJECTS)
        used = self._read("used", [u["used"] for u in manifest["units"]])
        return manifest | {"links": self._write(repository.service_links(used, subs))}

    @staticmethod
    def _as_facts(facts: DataFrame, bad: DataFrame, sub: str, folder: str) -> DataFrame:
        """Facts, with a fact for each file that cannot be read."""
        cut_at = 1 if folder == "." else len(folder) + 2
        rows = bad.select(F.lit("skip").alias("fact"), F.lit(sub).alias("sub"), F.substring("path", F.lit(cut_at), F.length("path")).alias("path"), F.col("reason").alias("text"))
        return facts.unionByName(rows, allowMissingColumns=True)

    def rebuild(self, root: str, config: Config | None = None) -> int:
        """A version from all files below ``root``."""
        config = config or Config()
        files = repository.list_files(self.spark, root, config.analysis.exclude)
        subs, planned = repository.plan_units(self.spark, files, config)
        if not planned:
            raise repository.NothingToAnalyse(f"aucun fichier analysable trouvé dans {root}")
        units = []
        for sub, language, folder in planned:
            found, bad = repository.unit_facts(files, sub, language, folder, [s[2] for s in subs])
            part = {"path": self._write(self._as_facts(found, bad, sub, folder)), "replaces": []}
            units.append(self._resolved({"id": sub, "language": language, "folder": folder, "facts": [part]}))
        name = root.rstrip("/").rpartition("/")[2]
        return self._commit(self._with_links({"root": name, "subprojects": [list(s) for s in subs], "units": units}))

    def update(self, root: str, changed: Iterable[str] | None, config: Config | None = None) -> int:
        """A version after changes to some paths (None: not known which); the last one if they do not matter."""
        config, last = config or Config(), self.manifest()
        if last is None or changed is None or any(map(is_structural, changed)):
            return self.rebuild(root, config)
        try:
            return self._updated(root, set(changed), config, last)
        except UnitsChanged:
            return self.rebuild(root, config)

    def _updated(self, root: str, changed: set[str], config: Config, last: dict) -> int:
        known = {language: x.extensions for language, x in repository.LANGUAGES.items() if not config.analysis.languages or language in config.analysis.languages}
        excluded = excluder(config.analysis.exclude)
        code = sorted(p for p in changed if p.endswith(tuple(e for x in known.values() for e in x)) and not excluded(p))
        several = len(last["subprojects"]) > 1 and any(s[2] != "." for s in last["subprojects"])
        touched: dict[str, list[str]] = {}
        for path in code:
            unit = owner(path, last)
            if unit:
                touched.setdefault(unit["id"], []).append(path)
            elif not several:  # a language that the project had no file of
                raise UnitsChanged
        if not touched:
            return last["version"]
        fs, base = open_folder(root)
        roots = [s[2] for s in last["subprojects"]]
        units = []
        for unit in last["units"]:
            paths = touched.get(unit["id"])
            if not paths:
                units.append(unit)
                continue
            info = fs.get_file_info([f"{base.rstrip('/')}/{p}" for p in paths])
            there = [(p,) for p, i in zip(paths, info, strict=True) if i.type == pafs.FileType.File]
            files = cut(repository.read_files(self.spark.createDataFrame(there, "path string"), root))
            found, bad = repository.unit_facts(files, unit["id"], unit["language"], unit["folder"], roots)
            below = 0 if unit["folder"] == "." else len(unit["folder"]) + 1
            part = {"path": self._write(self._as_facts(found, bad, unit["id"], unit["folder"])), "replaces": [p[below:] for p in paths]}
            unit = unit | {"facts": [*unit["facts"], part]}
            if len(unit["facts"]) > MOST_PARTS:
                unit |= {"facts": [{"path": self._write(self.facts(unit)), "replaces": []}]}
            if not several and not there and self.facts(unit).isEmpty():
                raise UnitsChanged
            units.append(self._resolved(unit))
        return self._commit(self._with_links(last | {"units": units}))
