"""Media columns: texts stored as lossless WebP, read back, and features of them.

A text's payload is its UTF-8, padded with zero bytes to a positive multiple of
``UNIT``. It is stored as a lossless WebP image, one pixel a byte (longer ones than
``webp.IMAGE_BYTES`` as several images in a row), with back-references and, where
that is shorter, a palette. The images are written as a table into the shared
folder, and everything reported is computed from the bytes read back from it.

The feature is a difference hash: the payload's samples fall into 65 equal
stretches, and bit i says whether the mean of stretch i+1 exceeds that of
stretch i; 16 hex digits.

Defined cases: a null text is an empty one, whose payload is ``UNIT`` zero
bytes. Equal texts give equal bytes and values. Repeated rows stay repeated; an
empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame

from . import webp
from .runtime import map_batches, shared_dir

UNIT = 64


def payload(text: str | None) -> tuple[bytes, int]:
    """The padded bytes of a text, and how many are its own."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return raw + bytes(size - len(raw)), len(raw)


def feature(data: bytes) -> str:
    """The difference hash of samples."""
    samples = np.frombuffer(data, np.uint8)
    edges = np.arange(66) * len(samples) // 65
    if len(samples) < 65:
        means = np.resize(samples, 65).astype(float)
    else:
        means = np.add.reduceat(samples, edges[:-1], dtype=np.int64) / np.diff(edges)
    return f"{int.from_bytes(np.packbits(means[1:] > means[:-1]).tobytes(), 'big'):016x}"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, media): each text as WebP."""
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def make():
        def step(c: dict[str, list]) -> dict[str, list]:
            found = [payload(t) for t in c["text"]]
            return {
                "doc_id": c["doc_id"],
                "n_bytes": [n for _, n in found],
                "payload_bytes": [len(p) for p, _ in found],
                "media": [webp.encode_bytes(p) for p, _ in found],
            }

        return step

    return map_batches(narrow, make, "doc_id long, n_bytes long, payload_bytes long, media binary")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write :func:`encode`'s table into a folder (by default a new one in the shared folder) and read it again."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/media-{uuid.uuid4().hex}"
    encode(docs, id_col, text_col).write.option("compression", "none").parquet(folder)
    return spark.read.schema("doc_id long, n_bytes long, payload_bytes long, media binary").parquet(folder)


def read_back(stored: DataFrame) -> DataFrame:
    """Decode a stored table and report payload, media and feature of each row."""
    narrow = stored.select("doc_id", "n_bytes", "payload_bytes", "media")

    def make():
        def step(c: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {n: c[n] for n in ("doc_id", "n_bytes")}
            out |= {n: [] for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for media, size in zip(c["media"], c["payload_bytes"], strict=True):
                data = webp.decode_bytes(media, size)
                out["payload_bytes"].append(len(data))
                out["payload_sha256"].append(hashlib.sha256(data).hexdigest())
                out["tail_crc32"].append(zlib.crc32(data[-UNIT:]))
                out["media_bytes"].append(len(media))
                out["media_sha256"].append(hashlib.sha256(media).hexdigest())
                out["feature"].append(feature(data))
            return out

        return step

    return map_batches(
        narrow,
        make,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string",
    )


def pixels(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Each WebP file's width, height and ARGB pixel array (row by row); nulls for what is not a lossless WebP."""
    narrow = media.select(media[media_col].cast("binary").alias("media"))

    def make():
        def one(data: bytes | None) -> tuple:
            try:
                found = webp.decode(data or b"")
            except ValueError:
                return None, None, None
            return found.shape[1], found.shape[0], found.ravel().astype(np.int64).tolist()

        def step(c: dict[str, list]) -> dict[str, list]:
            found = [one(m) for m in c["media"]]
            return {"media": c["media"]} | {n: [x[i] for x in found] for i, n in enumerate(("width", "height", "argb"))}

        return step

    return map_batches(narrow, make, "media binary, width int, height int, argb array<long>")
