"""Helpers shared by the operators: tables, Arrow batches and lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cartolith.plans.lineage import shared_dir, ship_package

#: Rows of one Arrow batch; long texts then stay within a worker's memory.
ROWS_PER_BATCH = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and forget its lineage; small partitions are joined by AQE, not here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    return [next(f"{n}_{i}" for i in range(len(taken) + 1) if f"{n}_{i}" not in taken) for n in names]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in a folder ``name-*`` of the shared folder, computed once."""
    folder = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def arrow_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Lower the session's Arrow batch size to ``rows`` if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    schema: str,
) -> DataFrame:
    """Apply to each Arrow batch a function of columns as lists.

    ``make`` runs once a partition, on the executor, and returns the function;
    so what it loads is loaded once.
    """
    ship_package(df.sparkSession)
    arrow_batches(df.sparkSession)
    names = df.columns
    fields = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step({n: batch.column(i).to_pylist() for i, n in enumerate(names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)


def map_stream(
    df: DataFrame,
    make: Callable[[], Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]]],
    schema: str,
    rows: int = ROWS_PER_BATCH,
) -> DataFrame:
    """Like :func:`map_batches`, for functions over a partition's stream of batches."""
    ship_package(df.sparkSession)
    arrow_batches(df.sparkSession, rows)
    names = df.columns
    fields = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ({n: b.column(i).to_pylist() for i, n in enumerate(names)} for b in batches)
        for out in make()(columns):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)


#: Bytes and rows of a batch where rows are narrow, or where texts are cut into pieces by bytes.
BATCH_BYTES, NARROW_ROWS = 4 << 20, 8192


def map_arrays(
    df: DataFrame,
    make: Callable[[], Callable[[Iterator[dict[str, pa.Array]]], Iterator[dict[str, object]]]],
    schema: str,
) -> DataFrame:
    """Like :func:`map_stream`, with columns as Arrow arrays, in batches that are cut by bytes."""
    spark = df.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(NARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    names = df.columns
    fields = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ({n: b.column(i) for i, n in enumerate(names)} for b in batches)
        for out in make()(columns):
            made = [x if isinstance(x := out[f.name], pa.Array) else pa.array(x, type=f.type) for f in fields]
            yield pa.RecordBatch.from_arrays(made, schema=fields)

    return df.mapInArrow(run, schema)
