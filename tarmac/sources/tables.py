"""Flight tables, weather tables, artefact tables and message output."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.sources.schemas import FLIGHT, HOURLY_WEATHER, RAW_FLIGHT, REPORT

CORRUPT = "_corrupt_record"
RUN = "_run"  # names the folder of each appending run


def table_exists(spark: SparkSession, path: str, fmt: str = "parquet") -> bool:
    try:
        spark.read.format(fmt).load(path)
    except AnalysisException:
        return False
    return True


def read_csv_by_name(spark: SparkSession, path: str, schema: T.StructType, keep_corrupt: bool = False) -> DataFrame:
    """A headed CSV read with the schema's types, columns matched by name.

    Columns the file lacks are null, columns the schema lacks are not parsed into a type. All files
    of a folder must have the same header; one that differs fails the read, never shifts columns.
    Unreadable values become null; with `keep_corrupt` the line itself is kept beside them.
    """
    header = spark.read.option("header", True).csv(path).columns
    types = {f.name: f.dataType for f in schema}
    declared = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
    if keep_corrupt:
        declared = declared.add(CORRUPT, T.StringType())
        # With pruning a line's missing columns go unnoticed unless they are selected.
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", "false")
    df = reader.schema(declared).csv(path)
    columns = [F.col(f.name) if f.name in header else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*columns, *([CORRUPT] if keep_corrupt else []))


def read_flights(
    spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType = RAW_FLIGHT, keep_corrupt: bool = False
) -> DataFrame:
    """Raw (or, with the FLIGHT schema, normalised) flight records from CSV, Parquet or ORC."""
    if fmt == "csv":
        return read_csv_by_name(spark, path, schema, keep_corrupt)
    return spark.read.format(fmt).load(path)


def read_weather(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    if fmt == "csv":
        return read_csv_by_name(spark, path, HOURLY_WEATHER)
    return spark.read.format(fmt).load(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Raw station reports (station, valid, metar) from CSV."""
    return read_csv_by_name(spark, path, REPORT)


def write_flights(
    df: DataFrame, path: str, fmt: str = "parquet", partition: Sequence[str] = ("YEAR", "MONTH"), mode: str = "overwrite"
) -> None:
    """Normalised flights, partitioned by date columns.

    The rebalance hint gathers a partition's rows into few files and splits an oversized one.
    """
    writer = df.hint("rebalance", *[F.col(c) for c in partition]).write.mode(mode).partitionBy(*partition)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def read_normalised(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*[f.name for f in FLIGHT])


def missing_rows(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been loaded yet."""
    return df.join(done.select(key), key, "left_anti")


def append_missing(df: DataFrame, path: str, key: str) -> DataFrame:
    """Add the rows of keys the table at `path` lacks; the whole table.

    Every run writes its rows once, to a folder of its own, and then lists (key, run) for the keys
    it finds in what it wrote. Rows count only where they are listed, so a run that died before
    that leaves nothing to be seen, and none of it is in the way of the next. Of a key that
    several runs listed, running at once, the least run counts. Rows without a key are left out.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    keys = f"{path}/keys"
    wanted = df.where(F.col(key).isNotNull())
    if table_exists(spark, keys):
        wanted = missing_rows(wanted, spark.read.parquet(keys), key)
    own = f"{path}/rows/{RUN}={run}"
    wanted.hint("rebalance", F.col(key)).write.partitionBy(key).parquet(own)
    written = spark.read.schema(df.schema).parquet(own).select(key).distinct()
    written.select(key, F.lit(run).alias(RUN)).write.mode("append").parquet(keys)
    return read_appended(spark, path, key, df.schema)


def read_appended(spark: SparkSession, path: str, key: str, schema: T.StructType) -> DataFrame:
    """The listed rows of a table that `append_missing` wrote."""
    listed = spark.read.parquet(f"{path}/keys").groupBy(key).agg(F.min(RUN).alias(RUN))
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(RUN, T.StringType())])).parquet(f"{path}/rows")
    return rows.join(listed, [key, RUN], "left_semi").select(*(f"`{c}`" for c in schema.names))


def save_table(df: DataFrame, path: str) -> DataFrame:
    """Write an artefact table (profile, encoder, calendar) and read it back.

    Read back, its size is known when the next plan is made.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if table_exists(spark, path) else None


def read_profile_json(spark: SparkSession, path: str) -> DataFrame:
    """A weather profile kept as one JSON object per file, as rows (airport, mean_delay)."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,double>")).alias("airport", "mean_delay"))
    return pairs


def to_message(
    flight_id: Column, route: Column, predicted_delay: Column, report: Column, timestamp: Column, late_above: float = 15
) -> Column:
    """One JSON message per scored flight."""
    update = F.struct(
        flight_id.alias("flight_id"),
        route.alias("route"),
        F.round(predicted_delay.cast("double"), 1).alias("predicted_delay"),
        F.when(predicted_delay > late_above, "DELAYED").otherwise("ON TIME").alias("status"),
        report.alias("metar"),
    )
    return F.to_json(
        F.struct(F.lit("STREAM_UPDATE").alias("type"), timestamp.alias("timestamp"), F.array(update).alias("updates")),
        {"ignoreNullFields": "false"},
    )
