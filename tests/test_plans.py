"""Shapes of the physical plans that matter on large tables."""

import pytest
from pyspark.sql import functions as F

from tarmac.operators import aggregates, cleaning, lookups, ordering, timeline
from tarmac.plans.catalogue import QUERIES
from tarmac.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_row_per_key_is_limited_before_the_shuffle(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderdate")
    for limited in (ordering.first_by(df, ["o_custkey"], ["o_orderdate", "o_orderkey"]), ordering.topk(df, ["o_custkey"], ["o_orderkey"], 3)):
        text = plan(limited)
        partial, final = text.find("Partial"), text.find("Final")
        assert "WindowGroupLimit" in text and partial > text.find("Exchange hashpartitioning") > final >= 0


def test_scans_read_only_what_is_needed(spark):
    pruned = tables.read_flights(spark, f"{SF}/orders.parquet", "parquet").select("o_custkey").where("o_custkey > 5")
    text = plan(pruned)
    assert "ReadSchema: struct<o_custkey:bigint>" in text and "PushedFilters: [IsNotNull(o_custkey), GreaterThan(o_custkey,5)]" in text


def test_encoder_reads_the_rows_with_one_grouping(spark):
    df = spark.range(10).select(*[F.col("id").cast("string").alias(c) for c in "abcde"], F.col("id").cast("double").alias("y"))
    text = plan(aggregates.fit_encoder(df, "y", list("abcde")))
    assert text.count("Expand") == 1 and text.count("partial_count") == 1


def test_large_lookups_are_not_forced_to_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(1000).withColumn("k", F.col("id") % 7)
        table = spark.range(100).withColumnRenamed("id", "key").withColumn("v", F.col("key"))
        assert "SortMergeJoin" in plan(lookups.lookup(left, table, "k", "key", "v", "out"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_constant_dimensions_are_broadcast(spark):
    text = plan(lookups.resolve_airport(spark.range(10).select(F.format_string("A%d", "id").alias("c")), "c", ""))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_rolling_mean_never_windows_over_a_whole_key(spark):
    df = spark.read.parquet(f"{SF}/events.parquet")
    for bound in (timeline.BOUND, 20):
        text = plan(timeline.rolling_mean(df, "event_type", "ts", "value", 7200, bound=bound))
        windows = [line for line in text.splitlines() if "Window [" in line]
        assert windows and all("_bucket" in line.split("windowspecdefinition(")[1].split(", specified")[0] for line in windows)
        assert "RangeFrame" not in text
        assert text.count(f"{SF}/events.parquet") == 1  # once more for the points, stored before


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n[0] in "pfdx" or n[:2] in ("j1", "j2", "j3", "j4", "j5", "j6", "j7", "j8", "w2", "w3")))
def test_no_pair_joins_and_no_python_rows(spark, name):
    text = plan(QUERIES[name].run(spark, SF))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert node not in text, node


def test_medians_of_all_columns_take_two_scans(spark, monkeypatch):
    """One pass sketches, one counts; further steps read the stored counts, and none orders more than the bound."""
    seen, ordered = spark.sparkContext.accumulator(0), []

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(40_000).select(F.rand(1).alias("a"), F.floor(F.rand(2) * 3).cast("double").alias("b"), F.when(F.rand(3) < 0.7, F.randn(4) * 1e9).alias("c"))
    whole = cleaning._ordered
    monkeypatch.setattr(cleaning, "_ordered", lambda *args: ordered.extend(whole(*args)) or ordered)
    got = cleaning.exact_medians(df.mapInArrow(count, df.schema), ["a", "b", "c"], band=0.05, cells=10, bound=30)
    assert seen.value == 80_000
    assert max(len(rows) for rows in ordered) <= 30
    want = df.agg(*[F.median(c).alias(c) for c in df.columns]).first()
    assert got == want.asDict()
