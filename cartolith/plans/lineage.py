"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; in local runs without it, a temporary folder."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    path = context.getConf().get("spark.checkpoint.dir") or (known.get() if known.isDefined() else None)
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
    if not known.isDefined():
        context.setCheckpointDir(path)
    return path


#: Rows up to which a table may be broadcast: some MB of ids.
BROADCAST_ROWS = 50_000


def cut(df: DataFrame, ordered: bool = False) -> DataFrame:
    """Compute ``df`` once, as Parquet in the shared folder, and forget how; used once a round in loops.

    A checkpoint would keep the estimated size of its plan. Joins multiply these, so
    in rounds whose table joins itself the digits of that number double each time, and the
    driver spends its time and memory on them. What is read from files has the
    files' size, and scans take the columns they need. The folder ``cut-*`` stays until it is deleted.
    Since files are smaller than their rows in memory, a table of more than ``BROADCAST_ROWS``
    asks for sort-merge joins, so that it is never gathered in the driver for a broadcast.
    Where partitions and their order must stay (``ordered``), it is a checkpoint after all.
    """
    folder = shared_dir(df.sparkSession).rstrip("/")
    if ordered:
        return df.checkpoint(eager=True)
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    return read.hint("merge") if seen.get["rows"] > BROADCAST_ROWS else read


def small(df: DataFrame) -> DataFrame:
    """``df``, broadcast in a join if it has at most ``BROADCAST_ROWS`` rows, counted first."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="package-")  # the driver serves the file as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, source.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
