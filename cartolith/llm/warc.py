"""WARC archives with a two-level capture index.

Writing: each task appends gzip members, one a record, to an archive of its own
in the shared folder and yields a capture line for each (reversed-host URL key,
page id, file, offset, length). Archives have a name no other attempt of a task
uses; only those that the finished job names are ever read, so a lost executor
leaves no half archive in the result. The capture lines are cut off as a table.

Index: capture lines are dealt into ranges and sorted by key; a range becomes an
index file. Each run of ``BLOCK_LINES`` is a zlib block, and the file ends with the
sparse directory of its blocks (last key, offset, length). A lookup finds the
file by its keys (a row a file, as many as shuffle partitions), binary-searches the
file's directory, range-reads a block or more, binary-searches the lines and
reads the records. :func:`find` does so on the executors for a table of keys, each
index file by the task that has its keys; :class:`Directory` for single URLs.
Records stand in an archive by key, so that neighbours are read at once.

Of records with equal payloads of ``REVISIT_BYTES`` at least, that with the
largest page id is the response; the others are revisits that name it. Smaller
payloads are always responses.

Defined cases: a null html is an empty payload, a null URL the target URI
``urn:none`` and the empty key. Rows without an id are responses where no row
of equal payload has one. Of rows repeated with the same id and payload, one is
the response. An empty table gives an empty result. Only the id, URL and html
columns are read.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, map_stream, shared_dir
from .url_filter import LOWER, UPPER

REVISIT_BYTES = 1000
#: Capture lines of an index block.
BLOCK_LINES = 1024
#: Captures whose records a task reads at once, and the bytes of one range read.
READ_LINES, READ_BYTES = 4096, 1 << 20
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
#: Fixed value: WARC-Date of every record, so that reruns write equal bytes.
DATE = "2020-01-01T00:00:00Z"
LEVEL = 3
_CAPTURE = "key string, page_id long, row long, file string, at long, size long"


def url_key(url: str | None) -> str:
    """The URL with its host reversed: ``com,example,www)/path?query``."""
    if not url or "://" not in url:
        return url or ""
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = rest[:end].translate(str.maketrans(UPPER, LOWER))
    return ",".join(reversed(host.split("."))) + ")" + rest[end:]


def key_column(url: Column) -> Column:
    """:func:`url_key` as a column."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.substring(text, at + 3, F.length(text))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    host = F.array_join(F.reverse(F.split(F.translate(raw, UPPER, LOWER), r"\.", -1)), ",")
    return F.when(at > 0, F.concat(host, F.lit(")"), F.substring(rest, F.length(raw) + 1, F.length(rest)))).otherwise(text)


def _fs(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, row: int) -> bytes:
    """A gzip member with one WARC record; a revisit (``refers_to`` given) carries no payload."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{row}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_one_line(url) if url else 'urn:none'}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = b"" if revisit else payload
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _one_line(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


@dataclass
class Record:
    kind: str
    page_id: int | None
    url: str
    digest: str
    payload_bytes: int
    refers_to: int | None
    payload: bytes


def parse(member: bytes) -> Record:
    """The record of a gzip member; its payload's digest is checked for a response."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    payload = rest[: int(field["Content-Length"])]
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = field["WARC-Type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {field['WARC-Record-ID']} does not match its digest")
    refers = field.get("WARC-Refers-To")
    return Record(
        kind,
        int(field["X-Page-ID"]) if field["X-Page-ID"] else None,
        field["WARC-Target-URI"],
        digest,
        int(field["X-Payload-Length"]) if kind == "revisit" else len(payload),
        int(refers.removeprefix("<urn:page:").rstrip(">")) if refers else None,
        payload,
    )


@dataclass
class Archive:
    """Where the archives and their index lie."""

    spark: SparkSession
    folder: str
    captures: DataFrame
    files: DataFrame  # of the index: name, first and last key, place of the directory


def with_roles(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """(page_id, url, payload, digest, named, twin) of each page.

    ``named`` is the id of the response that stands for an equal payload, null
    where there is none; ``twin`` counts, from 0, rows with that same id.
    """
    payload = F.encode(F.coalesce(pages[html_col].cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload")
    ).withColumns({"digest": F.sha1("payload"), "large": F.octet_length("payload") >= least})
    by_id = rows.where("large and page_id is not null").groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    groups = cut(
        by_id.groupBy("digest")
        .agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("rows"))
        .where("rows > 1 or top.n > 1")
        .select("digest", F.col("top.page_id").alias("named"), (F.col("top.n") > 1).alias("several")),
    )
    # small payloads need no group: their key is their own, so that equal ones do not meet in one task
    own = F.when(F.col("large"), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    joined = rows.withColumn("own", own).join(groups.withColumnRenamed("digest", "own"), "own", "left")
    names = ("page_id", "url", "payload", "digest", "named")
    zero = F.lit(0).cast("long").alias("twin")
    if groups.where("several").isEmpty():
        return joined.select(*names, zero)
    same = F.coalesce(F.col("several") & (F.col("page_id") == F.col("named")), F.lit(False))
    equal = joined.where(same).groupBy("digest", "page_id", "url", "named").agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
    place = F.struct(F.col("url").isNotNull(), F.coalesce("url", F.lit("")))
    least = rows.join(groups.where("several"), "digest", "left_semi").groupBy("digest", "page_id").agg(F.min(place).alias("least"))
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    # the first row of the least URL is 0; rows of other URLs are numbered apart from it
    later = F.xxhash64("url").bitwiseAND(F.lit((1 << 40) - 1)) * F.lit(1 << 20) + F.col("number") + 1
    twins = (
        equal.join(least, ["digest", "page_id"])
        .withColumn("number", number)
        .withColumn("twin", F.when(place == F.col("least"), F.col("number")).otherwise(later))
    )
    return joined.where(~same).select(*names, zero).unionByName(twins.select(*names, "twin"))


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> Archive:
    """Write a record for each page, and the index over them."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    columns = ("key", "page_id", "url", "payload", "digest", "named", "twin")
    rows = with_roles(pages, id_col, url_col, html_col, least).withColumn("key", key_column(F.col("url"))).select(*columns)

    def make():
        def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
            fs, base = _fs(folder)
            fs.create_dir(base, recursive=True)
            sink, name, at = None, "", 0
            try:
                for c in batches:
                    out: dict[str, list] = {n: [] for n in ("key", "page_id", "row", "file", "at", "size")}
                    for key, page, url, payload, digest, named, twin in zip(*(c[n] for n in columns), strict=True):
                        if sink is None or at > ARCHIVE_BYTES:
                            if sink is not None:
                                sink.close()
                            name, at = f"records-{uuid.uuid4().hex}.warc.gz", 0
                            sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                        refers = named if named is not None and (page != named or twin) else None
                        raw = record(page, url, payload, digest, refers, twin)
                        sink.write(raw)
                        for column, value in zip(out, (key, page, twin, name, at, len(raw)), strict=True):
                            out[column].append(value)
                        at += len(raw)
                    yield out
            finally:
                if sink is not None:
                    sink.close()

        return run

    captures = cut(map_stream(rows.sortWithinPartitions("key", "page_id"), make, _CAPTURE))
    return Archive(spark, folder, captures, cut(_index(captures, folder)))


def _index(captures: DataFrame, folder: str) -> DataFrame:
    """Index files of compressed blocks of sorted captures, each with the directory of its blocks; a row a file."""
    order = ["key", "page_id", "row", "file", "at"]
    parts = captures.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = captures.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)

    def make():
        def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
            fs, base = _fs(folder)
            name = f"index-{uuid.uuid4().hex}.cdx.z"
            held: list[tuple] = []
            blocks: list[tuple] = []
            sink, at, first = None, 0, None

            def flush() -> None:
                nonlocal sink, at, first
                if sink is None:
                    sink, first = fs.open_output_stream(f"{base}/{name}", compression=None), held[0][0]
                raw = _block(held)
                sink.write(raw)
                blocks.append((held[-1][0], at, len(raw)))
                at += len(raw)
                held.clear()

            for c in batches:
                for line in zip(*(c[n] for n in ("key", "page_id", "row", "file", "at", "size")), strict=True):
                    held.append(line)
                    if len(held) == BLOCK_LINES:
                        flush()
            if held:
                flush()
            names = ("name", "first_key", "last_key", "at", "size")
            if sink is None:
                yield {n: [] for n in names}
                return
            raw = _block(blocks)
            sink.write(raw)
            sink.close()
            yield {n: [v] for n, v in zip(names, (name, first, blocks[-1][0], at, len(raw)), strict=True)}

        return run

    return map_stream(dealt, make, "name string, first_key string, last_key string, at long, size long")


def _block(lines: list[tuple]) -> bytes:
    """A compressed block of lines of fields."""
    text = "".join("\t".join(["\\N" if v is None else _escape(str(v)) for v in x]) + "\n" for x in lines)
    return zlib.compress(text.encode("utf-8", "surrogatepass"), 6)


def _fields(raw: bytes) -> list[list[str]]:
    return [x.split("\t") for x in zlib.decompress(raw).decode("utf-8", "surrogatepass").split("\n")[:-1]]


def _bytes(key: str) -> bytes:
    """Keys are compared by these, as the ranges are."""
    return key.encode("utf-8", "surrogatepass")


def _escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")


def _unescape(s: str) -> str:
    if "\\" not in s:
        return s
    out, i = [], 0
    while i < len(s):
        if s[i] == "\\" and i + 1 < len(s):
            out.append({"t": "\t", "n": "\n", "r": "\r"}.get(s[i + 1], s[i + 1]))
            i += 2
        else:
            out.append(s[i])
            i += 1
    return "".join(out)


class Reader:
    """Range reads of an archive's files; keeps them open."""

    def __init__(self, folder: str) -> None:
        self.fs, self.base = _fs(folder)
        self.open: dict[str, object] = {}

    def read(self, name: str, at: int, size: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(f"{self.base}/{name}")
        return self.open[name].read_at(size, at)

    def directory(self, name: str, at: int, size: int) -> tuple[list[bytes], list[tuple[int, int]]]:
        """Last keys and places of an index file's blocks."""
        lines = _fields(self.read(name, at, size))
        return [_bytes(_unescape(f[0])) for f in lines], [(int(f[1]), int(f[2])) for f in lines]

    def block(self, name: str, at: int, size: int) -> tuple[list[bytes], list[tuple[str, int, int]]]:
        """Keys and places of the captures in an index block."""
        lines = _fields(self.read(name, at, size))
        return [_bytes(_unescape(f[0])) for f in lines], [(f[3], int(f[4]), int(f[5])) for f in lines]

    def captures(self, name: str, directory: tuple[list[bytes], list[tuple[int, int]]], keys: list[bytes]) -> Iterator[tuple[str, int, int]]:
        """Places of the captures that an index file has of sorted keys: binary search of the directory, then of blocks."""
        last, places = directory
        open_, lines, found = -1, [], []
        for key in keys:
            k = bisect.bisect_left(last, key)
            while k < len(last):
                if k != open_:
                    lines, found = self.block(name, *places[k])
                    open_ = k
                i = bisect.bisect_left(lines, key)
                while i < len(lines) and lines[i] == key:
                    yield found[i]
                    i += 1
                if i < len(lines) or last[k] > key:
                    break
                k += 1

    def records(self, places: list[tuple[str, int, int]]) -> Iterator[Record]:
        """The records there; neighbours in a file are read at once."""
        ordered = sorted(places)
        i = 0
        while i < len(ordered):
            name, start, size = ordered[i]
            j, end = i + 1, start + size
            while j < len(ordered) and ordered[j][:2] == (name, end) and end + ordered[j][2] - start <= READ_BYTES:
                end += ordered[j][2]
                j += 1
            raw = self.read(name, start, end - start)
            for _, at, n in ordered[i:j]:
                yield parse(raw[at - start : at - start + n])
            i = j

    def close(self) -> None:
        for f in self.open.values():
            f.close()


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def find(archive: Archive, keys: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record of the distinct ``key`` of ``keys``.

    The driver holds a row for each index file. A key goes to the files that may
    have it, so the captures of a key that fills several files are read by
    several tasks.
    """
    spark, folder = archive.spark, archive.folder
    files = sorted((_bytes(r["first_key"]), _bytes(r["last_key"]), r["name"], r["at"], r["size"]) for r in archive.files.collect())
    shared = spark.sparkContext.broadcast(files)

    def make_routes():
        index = shared.value
        last = [f[1] for f in index]

        def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
            for c in batches:
                out: dict[str, list] = {"file": [], "key": []}
                for key in c["key"]:
                    raw = _bytes(key)
                    k = bisect.bisect_left(last, raw)
                    while k < len(index) and index[k][0] <= raw:
                        out["file"].append(k)
                        out["key"].append(key)
                        k += 1
                yield out

        return run

    routes = map_stream(keys.select("key").distinct(), make_routes, "file int, key string", rows=8192)
    dealt = routes.repartitionById(max(1, len(files)), F.col("file")).sortWithinPartitions("file", "key")

    def make():
        index = shared.value

        def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
            reader = Reader(folder)
            held: list[tuple[str, int, int]] = []
            opened, directory = -1, ([], [])

            def out(places: list[tuple[str, int, int]]) -> Iterator[dict[str, list]]:
                found: list[Record] = []
                size = 0
                for r in reader.records(places):
                    found.append(r)
                    size += len(r.payload)
                    if size > 4 * READ_BYTES:
                        yield _columns(found)
                        found, size = [], 0
                yield _columns(found)

            try:
                for c in batches:
                    for k in sorted(set(c["file"])):
                        if k != opened:
                            opened, directory = k, reader.directory(*index[k][2:])
                        own = [_bytes(key) for key, f in zip(c["key"], c["file"], strict=True) if f == k]
                        for place in reader.captures(index[k][2], directory, own):
                            held.append(place)
                            if len(held) == READ_LINES:
                                yield from out(held)
                                held.clear()
                yield from out(held)
            finally:
                reader.close()

        return run

    return map_stream(dealt, make, _RECORD, rows=8192)


def _columns(found: list[Record]) -> dict[str, list]:
    return {
        "page_id": [r.page_id for r in found],
        "url": [r.url for r in found],
        "payload_bytes": [r.payload_bytes for r in found],
        "payload_digest": [r.digest for r in found],
        "record_type": [r.kind for r in found],
        "refers_to": [r.refers_to for r in found],
        "payload": [r.payload for r in found],
    }


class Directory:
    """Lookups of single URLs from the driver: a row for each index file in memory, directories read when needed."""

    def __init__(self, archive: Archive) -> None:
        rows = archive.files.collect()
        self.files = sorted((_bytes(r["first_key"]), _bytes(r["last_key"]), r["name"], r["at"], r["size"]) for r in rows)
        self.last = [f[1] for f in self.files]
        self.reader = Reader(archive.folder)

    def lookup(self, url: str | None) -> list[Record]:
        """All captures of a URL: binary searches, then range reads."""
        key = _bytes(url_key(url))
        out: list[Record] = []
        for first, _, name, at, size in self.files[bisect.bisect_left(self.last, key) :]:
            if first > key:
                break
            out += self.reader.records(list(self.reader.captures(name, self.reader.directory(name, at, size), [key])))
        return out


def round_trip(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Write, look every URL up again, and return what the archives say of each page."""
    archive = write(pages, url_col=url_col)
    keys = pages.select(key_column(pages[url_col].cast("string")).alias("key"))
    return find(archive, keys).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL of query op9.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS named FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> named THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> named THEN named END AS refers_to
FROM m
"""
