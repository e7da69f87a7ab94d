"""First row per key, top rows per key, deterministic samples and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def topk(
    df: DataFrame, partition: Sequence[str], order: Sequence[str | Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first `k` rows per key under a total order, with their rank from 1.

    The rank filter sits directly on the window, so each map task keeps at most `k` rows of a
    key before the shuffle and a hot key costs no more than a rare one.
    """
    window = W.partitionBy(*partition).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def one_per(df: DataFrame, keys: Sequence[str], newest: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first in descending order of those columns of `newest` that exist, ties by the row's hash."""
    order = [F.col(c).desc_nulls_last() for c in newest if c in df.columns]
    return first_by(df, keys, [*order, F.xxhash64(*df.columns)])


def first_by(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row per key under a total order."""
    return topk(df, partition, order, 1, "_first").drop("_first")


def hash_key(columns: Sequence[str], seed: int | str) -> Column:
    """md5 over seed and key columns: the same on every run, whatever the partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 42, tie_break: Sequence[str] = ()) -> DataFrame:
    """At most `n` rows: those first in the order of a seeded hash of the key, in any order.

    65,536 counters tell in which hash cell the n-th row lies. Rows of the cells before it are
    taken as they are; only the rows of that one cell are ranked.
    """
    cell = F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int")
    hashed = df.withColumn("_hash", hash_key(key, seed)).withColumn("_cell", cell)
    counts = hashed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    running = counts.withColumn("_upto", F.sum("_n").over(W.orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)))
    last = running.where(F.col("_upto") >= n).select(F.min(F.struct("_cell", (n - F.col("_upto") + F.col("_n")).alias("_left"))).alias("_last"))
    marked = hashed.withColumn("_last", last.scalar())
    whole = marked.where(F.col("_last").isNull() | (F.col("_cell") < F.col("_last._cell")))
    cut = marked.where(F.col("_cell") == F.col("_last._cell"))
    place = F.row_number().over(W.partitionBy("_cell").orderBy("_hash", *key, *tie_break))
    part = cut.withColumn("_place", place).where(F.col("_place") <= F.col("_last._left")).drop("_place")
    return whole.unionByName(part).drop("_hash", "_cell", "_last")


def held_out(key: Sequence[str], fraction: float = 0.2, seed: int | str = 42) -> Column:
    """True for the rows of the held-out part."""
    number = F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("bigint")
    return number % 100 < int(round(fraction * 100))


def split(
    df: DataFrame, key: Sequence[str], fraction: float = 0.2, seed: int | str = 42
) -> tuple[DataFrame, DataFrame]:
    """(training part, held-out part). Unlike a random split it survives recomputation."""
    test = held_out(key, fraction, seed)
    return df.where(~test), df.where(test)
