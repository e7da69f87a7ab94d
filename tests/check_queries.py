"""Compare every registered query with its SQL: python tests/check_queries.py [sf_dir] [name part ...]."""

import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests.comparing import connect, difference  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    bad = []
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            outcome = difference(df, con, sql[name]) if name in sql else f"rows {df.count()} (no SQL)"
            failed = name in sql and outcome is not None
        except Exception:
            outcome, failed = traceback.format_exc(limit=-4)[-1800:], True
        print(f"{name:32s} {time.time() - start:6.2f}s {outcome or 'equal'}", flush=True)
        if failed:
            bad.append(name)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
