"""Time-range operators against plain loops over small random tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tarmac.operators import timeline

T0 = dt.datetime(2024, 1, 1)


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


def random_flights(seed, n=400, span=3000):
    rng = random.Random(seed)
    # Two thirds of the rows on one key; many rows share a minute.
    return [
        (i, rng.choice("AAB" if i % 3 else "A"), minutes(rng.randrange(span) // 7 * 7), float(rng.randrange(-30, 200)))
        for i in range(n)
    ]


def loop_mean(rows, key, at, width):
    inside = [v for _, k, t, v in rows if k == key and at - dt.timedelta(seconds=width) <= t < at]
    return sum(inside) / len(inside) if inside else 0.0


@pytest.mark.parametrize("width, pieces", [(7200, 8), (7200, 1), (600, 2), (100_000, 64)])
def test_rolling_mean_equals_loop(spark, width, pieces):
    rows = random_flights(width + pieces)
    df = spark.createDataFrame(rows, "id int, k string, t timestamp_ntz, v double")
    got = {r["id"]: r["rolling_mean"] for r in timeline.rolling_mean(df, "k", "t", "v", width, pieces=pieces).collect()}
    assert got == pytest.approx({i: loop_mean(rows, k, t, width) for i, k, t, _ in rows}, abs=1e-9)


@pytest.mark.parametrize("bound", [1_000_000, 400, 40])
def test_crowded_buckets_are_cut(spark, bound):
    """Most times of a key fall into a few seconds, most of these into one millisecond, at microseconds."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        apart = rng.choice([rng.randrange(10**10), rng.randrange(3_000_000), rng.randrange(2_000)])
        base = T0 + dt.timedelta(seconds=rng.choice([0, 0, 3600, 7200]))
        rows.append((i, "A" if i % 5 else "B", base + dt.timedelta(microseconds=apart), float(rng.randrange(-30, 200))))
    df = spark.createDataFrame(rows, "id int, k string, t timestamp_ntz, v double")
    got = {r["id"]: r["rolling_mean"] for r in timeline.rolling_mean(df, "k", "t", "v", 7200, bound=bound).collect()}
    assert got == pytest.approx({i: loop_mean(rows, k, t, 7200) for i, k, t, _ in rows}, abs=1e-9)
    asked = df.where("id % 3 = 0").select("id", "k", "t")
    some = {r["id"]: r["rolling_mean"] for r in timeline.rolling_mean(asked, "k", "t", "v", 7200, history=df, bound=bound).collect()}
    assert some == pytest.approx({i: m for i, m in got.items() if i % 3 == 0}, abs=1e-9)


def test_no_task_sorts_more_than_the_bound(spark):
    """A bucket of 5,000 points, half of them in two seconds: its cells hold at most the bound."""
    size = 900 * timeline.MICROS
    times = [k * 100_000 for k in range(2500)] + [600_000_000 + k * 701 for k in range(2500)]
    marks = spark.createDataFrame([("A", 0, t) for t in times], "k string, _bucket bigint, _at bigint")
    cells = timeline._in_cells(marks, "k", size, 200).groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("low"), F.max("_at").alias("high")).orderBy("_cell").collect()
    assert sum(r["n"] for r in cells) == 5000 and max(r["n"] for r in cells) <= 200
    assert all(a["high"] < b["low"] for a, b in zip(cells, cells[1:]))


def test_rolling_mean_edges(spark):
    rows = [(1, "A", minutes(0), 10.0), (2, "A", minutes(120), 20.0), (3, "A", minutes(120), 40.0), (4, "A", minutes(241), 5.0), (5, "A", None, 7.0)]
    df = spark.createDataFrame(rows, "id int, k string, t timestamp_ntz, v double")
    got = {r["id"]: r["rolling_mean"] for r in timeline.rolling_mean(df, "k", "t", "v", 7200).collect()}
    # Exactly two hours earlier counts, the same instant does not.
    assert got == {1: 0.0, 2: 10.0, 3: 10.0, 4: 0.0, 5: 0.0}


def test_rolling_mean_over_a_history(spark):
    rows = random_flights(5)
    history = spark.createDataFrame(rows, "id int, k string, t timestamp_ntz, v double")
    asked = [(100, "A", minutes(333)), (101, "B", minutes(1)), (102, "C", minutes(9))]
    df = spark.createDataFrame(asked, "id int, k string, t timestamp_ntz")
    got = {r["id"]: r["rolling_mean"] for r in timeline.rolling_mean(df, "k", "t", "v", 7200, history=history).collect()}
    assert got == pytest.approx({i: loop_mean(rows, k, t, 7200) for i, k, t in asked}, abs=1e-9)


def test_large_values_and_no_numbers_spoil_nothing(spark):
    rows = [(1, 0, float("nan")), (2, 10, 1e17), (3, 100, 0.5), (4, 110, 0.25), (5, 215, 1.0), (6, 216, None), (7, 300, 2.0)]
    df = spark.createDataFrame([(i, "A", minutes(m), v) for i, m, v in rows], "id int, k string, t timestamp_ntz, v double")
    for pieces in (1, 8):
        got = {r["id"]: r["rolling_mean"] for r in timeline.rolling_mean(df, "k", "t", "v", 7200, pieces=pieces).collect()}
        assert got == {1: 0.0, 2: 0.0, 3: 1e17, 4: (1e17 + 0.5) / 2, 5: 0.375, 6: pytest.approx(1.75 / 3), 7: 1.0}


def test_history_is_cut_to_the_asked_ranges(spark, monkeypatch):
    kept, whole = [], timeline.save_table
    monkeypatch.setattr(timeline, "save_table", lambda df, path: kept.append(whole(df, path)) or kept[-1])
    history = spark.range(1000).select(F.lit("A").alias("k"), F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("t"), F.lit(1.0).alias("v"))
    asked = spark.createDataFrame([("A", dt.datetime(1970, 1, 2))], "k string, t timestamp_ntz")
    points = timeline.rolling_points(history, "k", "t", "v", 7200, at=asked)
    assert [(r["k"], r["mean"]) for r in points.collect()] == [("A", 1.0)]
    assert kept[0].count() <= 4  # of 1,000 hours those of two hours and their buckets


def loop_asof(left, right, direction):
    out = {}
    for i, k, t in left:
        same = [(rt, v) for rk, rt, v in right if rk == k]
        back = max([x for x in same if x[0] <= t], default=None)
        ahead = min([x[0] for x in same if x[0] >= t], default=None)
        ahead = max([x for x in same if x[0] == ahead], default=None)
        if direction == "backward":
            best = back
        elif direction == "forward":
            best = ahead
        elif back is None or ahead is None:
            best = back or ahead
        else:
            best = back if t - back[0] <= ahead[0] - t else ahead
        out[i] = None if best is None else best[1]
    return out


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("bucket", [timeline.DAY * timeline.MICROS, 60 * 60 * timeline.MICROS])
def test_asof_equals_loop(spark, direction, bucket):
    rng = random.Random(7)
    left = [(i, rng.choice("AAAB"), minutes(rng.randrange(6000))) for i in range(200)] + [(900, "Z", minutes(5))]
    right = [(rng.choice("AAB"), minutes(rng.randrange(6000)), rng.randrange(1000)) for _ in range(40)]
    df = timeline.asof_join(
        spark.createDataFrame(left, "id int, k string, t timestamp_ntz"),
        spark.createDataFrame(right, "k string, at timestamp_ntz, v int"),
        "t", "at", ["k"], ["v"], direction, bucket,
    )
    assert {r["id"]: r["v"] for r in df.collect()} == loop_asof(left, right, direction)


def test_asof_without_keys_on_dates(spark):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-10')) as d")
    marks = spark.sql("select * from values (date'2024-01-03', 'x'), (date'2024-01-07', 'y') as t(m, name)")
    got = {r["d"].day: r["name"] for r in timeline.asof_join(days, marks, "d", "m", (), ["name"], bucket=2 * 86_400 * 10**6).collect()}
    assert got == {1: None, 2: None, 3: "x", 4: "x", 5: "x", 6: "x", 7: "y", 8: "y", 9: "y", 10: "y"}


def loop_cascade(legs):
    out, delay = {}, None
    for leg in legs:
        carried = 0 if delay is None else max(0, delay - leg["slack"])
        delay = carried + leg["own"]
        out[leg["id"]] = (carried, delay)
    return out


def test_cascade_equals_loop(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for tail in range(4):
        legs = [
            {"id": tail * 1000 + i, "day": i // 9, "leg": i, "own": rng.choice([0, 0, 0, 45, 90]), "slack": rng.randrange(0, 30)}
            for i in range(60)
        ]
        expected |= loop_cascade(legs)
        rows += [(x["id"], tail, x["day"], x["leg"], x["own"], x["slack"]) for x in legs]
    df = spark.createDataFrame(rows, "id int, tail int, day int, leg int, own int, slack int")
    got = timeline.cascade(df, "tail", ["leg"], "own", "slack", "day")
    assert {r["id"]: (r["carried_delay"], r["total_delay"]) for r in got.collect()} == expected


def test_cascade_without_slack_carries_everything(spark):
    df = spark.createDataFrame([(1, 90), (2, 0), (3, 0)], "leg int, own int")
    df = df.withColumns({"tail": F.lit("N1"), "slack": F.lit(0), "day": F.lit(1)})
    rows = timeline.leg_cause(timeline.cascade(df, "tail", ["leg"], "own", "slack", "day"), "tail", ["day", "leg"]).collect()
    got = {r["leg"]: (r["total_delay"], r["leg_cause"]) for r in rows}
    assert got == {1: (90, "Weather"), 2: (90, "Late Aircraft"), 3: (90, "Late Aircraft")}


def test_legs_without_tail_or_day_stay(spark):
    legs = spark.createDataFrame([(1, 1, 10, 30, 0), (None, 1, 11, 20, 5), (1, None, 12, 40, 10), (None, 1, 13, 0, 5)], "tail int, day int, leg int, own int, slack int")
    rows = timeline.leg_cause(timeline.cascade(legs, "tail", ["leg"], "own", "slack", "day"), "tail", ["day", "leg"]).collect()
    assert {r["leg"]: (r["total_delay"], r["leg_cause"]) for r in rows} == {
        12: (40, "Weather"), 10: (70, "Late Aircraft"), 11: (20, "Weather"), 13: (15, "Late Aircraft")
    }
