"""What the operators share: stored intermediate tables and access to Arrow strings."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tarmac
from tarmac.workspace import new_folder


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2_000  # whole texts in one batch between Spark and Python, where the session has not set another number


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it is not installed, and keep batches of texts small."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, BATCH_ROWS)
    root = os.path.dirname(os.path.dirname(os.path.abspath(tarmac.__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table that is read again to the cluster's shared folder; lineage ends there."""
    spark = df.sparkSession
    folder = new_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def in_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """`work` on every Arrow batch of `df`, inside the tasks."""
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null has no bytes."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def spans_of(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row where that row is longer."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def with_value(docs: DataFrame, work: Callable[[pa.Array], pa.Array], kind: T.DataType, out: str = "value") -> DataFrame:
    """Rows of `docs` whole, as `row`, beside what `work` makes of their texts; no join, no shuffle."""
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col("text"))
    schema = T.StructType([rows.schema["row"], T.StructField(out, kind)])

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), work(batch.column(1))], names=["row", out])

    return in_batches(rows, per_batch, schema)
