"""Time the headline queries over whole tables and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
Each query runs to a sink that discards its rows, so nothing is pruned away.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tarmac.plans.catalogue import QUERIES

HEADLINE = (
    "worst_congestion", "f6_rolling_mean", "f6_rolling_mean_events", "f8_holiday_week", "f9_join_weather",
    "f12_build_features", "p1_normalise", "p5_fill_median", "p8_lookup_flights", "a1_fit_encoder", "a2_weather_profile",
    "m1_encode", "j1_asof_join", "j5_schedule_lookup", "j8_match_position", "w3_cascade", "d4_fuse_weather",
    "s4_parse_state_vectors", "r2_embed", "r3_knn_exact", "r6_knn_blocks", "analyze", "t3_congestion_stream",
    "m5_train_and_evaluate",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tarmac-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scale(sf_dir: str) -> float | str:
    name = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    try:
        return float(name)
    except ValueError:
        return name


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    wanted = sys.argv[1:] or HEADLINE
    spark = session(cpus)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
                "sf": scale(sf_dir), "cpus": int(cpus), "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
