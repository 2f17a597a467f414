"""Listing a tree of sources by a frontier of folders, and watching it as a stream.

A listing begins on the driver, level by level, until ``FRONTIER`` folders are
open; a small tree ends there. The open folders are dealt to the executors,
each of which walks what lies below, ``FOLDERS_PER_TASK`` folders at most; folders it has not
entered come back as the next frontier, so that one deep folder does not keep a
task. Excluded folders are never entered.

:class:`SourceWatch` is a stream of changed paths (format ``source_watch``). An
offset is a time. The tree is dealt into slices, by the folders ``SHARED_LEVELS``
deep; at each trigger a task lists its slice, writes the listing (path, size,
time of change) once under the offset's name, and compares it with that of the offset before.
A batch that runs again finds its listing written and gives the same rows. So a
stream that starts again from its checkpoint also reports what happened meanwhile.
The first batch only takes the tree in, unless ``initial`` is ``all``. A trigger's interval gathers a burst.
Files that cannot be read any more count as deleted.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from cartolith.plans.lineage import cut, ship_package

from .patterns import excluder

FRONTIER, FOLDERS_PER_TASK = 64, 4096
SHARED_LEVELS = 2
_OPTIONS = ("patterns", "endings", "names", "left_out", "left_endings")
_KEPT = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.int64())])


def open_folder(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


@dataclass(frozen=True)
class Wanted:
    """Files by their endings or names (all, if none are given), but for some patterns, names (of folders too) and endings."""

    patterns: tuple[str, ...] = ()
    endings: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    left_out: tuple[str, ...] = ()
    left_endings: tuple[str, ...] = ()

    def tests(self) -> tuple[Callable[[str], bool], Callable[[str], bool]]:
        """Whether a folder is entered, and whether a file is listed, by relative path."""
        excluded = excluder(self.patterns)

        def enters(path: str) -> bool:
            return path.rpartition("/")[2] not in self.left_out and not excluded(f"{path}/x")

        def lists(path: str) -> bool:
            name = path.rpartition("/")[2]
            known = not (self.endings or self.names) or name.endswith(self.endings) or name in self.names
            return known and name not in self.left_out and not name.endswith(self.left_endings) and not excluded(path)

        return enters, lists


def _level(fs: pafs.FileSystem, base: str, folder: str, enters: Callable[[str], bool], lists: Callable[[str], bool]) -> tuple[list[pafs.FileInfo], list[str]]:
    """The files and the folders to enter of one folder; nothing of one that is gone."""
    files, folders = [], []
    selector = pafs.FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=bool(folder))
    for info in fs.get_file_info(selector):
        path = info.path[len(base) + 1 :]
        if info.type == pafs.FileType.Directory:
            if enters(path):
                folders.append(path)
        elif lists(path):
            files.append(info)
    return files, folders


def walk(root: str, wanted: Wanted, todo: list[str], most: int) -> tuple[list[str], list[str]]:
    """Paths of the files in and below some folders, breadth first, and the folders that are still open after ``most``."""
    fs, base = open_folder(root)
    base, (enters, lists), found, at = base.rstrip("/"), wanted.tests(), [], 0
    todo = list(todo)
    while at < len(todo) and at < most:
        files, folders = _level(fs, base, todo[at], enters, lists)
        found += [f.path[len(base) + 1 :] for f in files]
        todo += folders
        at += 1
    return found, todo[at:]


def list_tree(spark: SparkSession, root: str, wanted: Wanted, below: Iterable[str] = ("",), frontier: int = FRONTIER, most: int = FOLDERS_PER_TASK) -> DataFrame:
    """(path) of the wanted files in and below some folders of ``root``."""
    found: list[str] = []
    todo = list(below)
    while todo and len(todo) < frontier:
        level, todo = list(todo), []
        for folder in level:
            files, inner = walk(root, wanted, [folder], 1)
            found += files
            todo += inner
    out = spark.createDataFrame([(p,) for p in found], "path string")
    if not todo:
        return out
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                files, rest = walk(root, wanted, [folder], most)
                yield pa.RecordBatch.from_pydict({"path": files + rest, "open": [False] * len(files) + [True] * len(rest)})

    open_ = spark.createDataFrame([(p,) for p in todo], "path string").repartition(min(len(todo), frontier))
    while True:
        walked = cut(open_.mapInArrow(run, "path string, open boolean"))
        out = out.unionByName(walked.where("not open").select("path"))
        rest = walked.where("open").select("path")
        count = rest.count()
        if not count:
            return out
        open_ = rest.repartition(min(count, frontier))


@dataclass
class Slice(InputPartition):
    number: int
    start: int
    end: int


class WatchReader(DataSourceStreamReader):
    """Offsets are times; see the module."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.state = options["root"], options["state"]
        self.slices = int(options.get("slices", 4))
        self.all = options.get("initial", "none") == "all"
        self.wanted = Wanted(*[tuple(json.loads(options.get(k, "[]"))) for k in _OPTIONS])

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return [Slice(k, start["at"], end["at"]) for k in range(self.slices)]

    def _name(self, number: int, at: int) -> tuple[pafs.FileSystem, str, str]:
        fs, base = open_folder(self.state)
        return fs, f"{base.rstrip('/')}/{number}", f"{base.rstrip('/')}/{number}/{at:016d}.parquet"

    def _mine(self, path: str, number: int) -> bool:
        top = "/".join(path.split("/")[:-1][:SHARED_LEVELS])
        return zlib.crc32(top.encode()) % self.slices == number

    def _listed(self, number: int) -> dict[str, tuple[int, int]]:
        fs, base = open_folder(self.root)
        base, (enters, lists), found, todo = base.rstrip("/"), self.wanted.tests(), {}, [""]
        while todo:
            files, folders = _level(fs, base, todo.pop(), enters, lists)
            for f in files:
                path = f.path[len(base) + 1 :]
                if self._mine(path, number):
                    found[path] = (f.size, f.mtime_ns or 0)
            todo += [f for f in folders if f.count("/") + 1 < SHARED_LEVELS or self._mine(f"{f}/x", number)]
        return found

    def _snapshot(self, number: int, at: int) -> dict[str, tuple[int, int]] | None:
        """The listing under a name; None if there is none."""
        fs, _, name = self._name(number, at)
        if fs.get_file_info(name).type != pafs.FileType.File:
            return None
        got = pq.read_table(name, filesystem=fs).to_pydict()
        return dict(zip(got["path"], zip(got["size"], got["modified"], strict=True), strict=True))

    def _taken(self, number: int, at: int) -> dict[str, tuple[int, int]]:
        """The listing of a batch: as it was written, or made now and written at once as a whole."""
        there = self._snapshot(number, at)
        if there is not None:
            return there
        found = self._listed(number)
        fs, folder, name = self._name(number, at)
        fs.create_dir(folder)
        columns = [list(found), [s for s, _ in found.values()], [m for _, m in found.values()]]
        part = f"{name}.{time.time_ns()}.part"
        pq.write_table(pa.table(columns, schema=_KEPT), part, filesystem=fs)
        fs.move(part, name)
        return found

    def read(self, partition: Slice) -> Iterator[tuple[str, str, int]]:
        new = self._taken(partition.number, partition.end)
        old = self._snapshot(partition.number, partition.start) if partition.start else None
        if old is None:
            old = {} if self.all or partition.start else new
        for path in sorted({*old, *new}):
            if old.get(path) != new.get(path):
                yield path, "created" if path not in old else "deleted" if path not in new else "modified", partition.end

    def commit(self, end: dict) -> None:
        """Listings before the one that the next batch compares with are not needed any more."""
        for number in range(self.slices):
            fs, folder, last = self._name(number, end["at"])
            for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                if info.path < last:
                    fs.delete_file(info.path)


class SourceWatch(DataSource):
    """(path, change, at) of files below ``root``; ``state`` is a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "source_watch"

    def schema(self) -> str:
        return "path string, change string, at long"

    def streamReader(self, schema: object) -> WatchReader:
        return WatchReader(dict(self.options))


def watch(spark: SparkSession, root: str, state: str, wanted: Wanted = Wanted(), slices: int = 4, initial: str = "none") -> DataFrame:
    """The stream of changes below ``root``: (path, change, at), where change is created, modified or deleted."""
    ship_package(spark)
    spark.dataSource.register(SourceWatch)
    reader = spark.readStream.format("source_watch").option("root", root).option("state", state).option("slices", slices).option("initial", initial)
    for name in _OPTIONS:
        reader = reader.option(name, json.dumps(getattr(wanted, name)))
    return reader.load()
