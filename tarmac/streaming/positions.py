"""Aircraft positions as a stream, and the newest snapshot as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarmac.sources.feeds import parse_state_vectors
from tarmac.sources.tables import table_exists

POLL = "300 seconds"


def position_stream(
    source: DataFrame, payload: str = "payload", time: str = "snapshot_time", max_vectors: int | None = None
) -> DataFrame:
    """Stream of snapshot documents (time, payload) -> stream of positions. Keeps no state."""
    return parse_state_vectors(source, payload, (time,), max_vectors)


def _stored(spark: SparkSession, path: str):
    """(slot, snapshot time, batch) of the newest stored snapshot, or None."""
    if not table_exists(spark, path):
        return None
    table = spark.read.parquet(path)
    newest = table.agg(F.max(F.struct("snapshot_time", "batch", "slot")).alias("m")).first()["m"]
    return None if newest is None else (newest["slot"], newest["snapshot_time"], newest["batch"])


def keep_newest(batch: DataFrame, batch_id: int, path: str, time: str = "snapshot_time") -> None:
    """Replace the stored snapshot by the batch's newest one unless that is older.

    The table has two slots: the new snapshot goes into the slot that does not hold the
    current one, so a failure at any moment leaves a readable snapshot. A repeated batch
    finds its own number stored and does nothing.
    """
    batch = batch.persist()  # read for its newest time and again for its rows
    try:
        newest = batch.agg(F.max(time).alias("t")).first()["t"]
        stored = _stored(batch.sparkSession, path)
        if newest is None or (stored is not None and (newest < stored[1] or batch_id <= stored[2])):
            return
        slot = 0 if stored is None else 1 - stored[0]
        rows = batch.where(F.col(time) == F.lit(newest)).withColumnRenamed(time, "snapshot_time")
        marked = rows.withColumns({"batch": F.lit(batch_id).cast("bigint"), "slot": F.lit(slot)})
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(path)
    finally:
        batch.unpersist()


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.parquet(path)
    newest = table.agg(F.max(F.struct("snapshot_time", "batch", "slot")).alias("m")).select("m.slot").scalar()
    return table.where(F.col("slot") == newest).drop("slot", "batch")


def latest_snapshot(
    positions: DataFrame, path: str, checkpoint: str, time: str = "snapshot_time", once: bool = False
) -> StreamingQuery:
    """Start the query that keeps only the newest snapshot at `path`."""
    writer = positions.writeStream.foreachBatch(lambda df, number: keep_newest(df, number, path, time)).option(
        "checkpointLocation", checkpoint
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)
    return writer.start()
