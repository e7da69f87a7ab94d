import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from tarmac.operators import aggregates, cleaning, holidays, ordering, weather


def test_delay_limits_are_included(spark):
    df = spark.createDataFrame([(-31.0,), (-30.0,), (15.0,), (720.0,), (721.0,), (None,)], "d double")
    assert [r["d"] for r in cleaning.clean_target(df, "d").orderBy("d").collect()] == [-30.0, 15.0, 720.0]
    assert [r["d"] for r in cleaning.delayed(df, "d", 15).orderBy("d").collect()] == [720.0, 721.0]


def test_year_filter_drops_bad_dates(spark):
    df = spark.createDataFrame([("2023-01-01",), ("2023-12-31",), ("2024-01-01",), ("2023-02-30",), ("x",), (None,)], "FL_DATE string")
    kept = [r["FL_DATE"] for r in cleaning.filter_year(df, "FL_DATE", 2023).orderBy("FL_DATE").collect()]
    assert kept == [dt.date(2023, 1, 1), dt.date(2023, 12, 31)]


@pytest.mark.parametrize(
    "values", [[3.0], [1.0, 2.0], [5.0, 1.0, 4.0], [7.0] * 50 + [1.0, 9.0], [float(i * i % 997) for i in range(1000)], []]
)
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    expected = statistics.median(values) if values else None
    assert cleaning.exact_median(df, "v").first()["median"] == expected


@pytest.mark.parametrize("bound, cells", [(50_000, 10_000), (3, 2)])
def test_exact_medians_of_odd_columns(spark, bound, cells):
    nan, inf, top = float("nan"), float("inf"), 1.7e308
    columns = {
        "few": [1.0, None, None, None, None, None, None, 9.0],
        "none": [None] * 8,
        "ends": [-inf, -top, -top, 0.0, 2.0, top, inf, inf],
        "nans": [nan, nan, 1.0, 2.0, 3.0, 4.0, nan, 5.0],
        "same": [7.0] * 8,
        "whole": [float(x) for x in (3, 3, 3, 3, 4, 4, 4, 4)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    got = cleaning.exact_medians(df, list(columns), band=0.4, cells=cells, bound=bound)
    assert got == {"few": 5.0, "none": None, "ends": 1.0, "nans": 4.5, "same": 7.0, "whole": 3.5}


def test_fill_medians_of_several_columns(spark):
    train = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "x double, y double")
    rows = spark.createDataFrame([(None, 4.0), (100.0, None)], "x double, y double")
    got = cleaning.fill_medians(rows, {"x": 0.0, "y": 50.0, "z": 7.0}, train)
    assert sorted(tuple(r) for r in got.collect()) == [(2.0, 4.0, 7.0), (100.0, 50.0, 7.0)]


def test_fill_median_uses_the_reference_rows(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    rows = spark.createDataFrame([(None,), (100.0,)], "x double")
    assert sorted(r["x"] for r in cleaning.fill_median(rows, "x", 0.0, train).collect()) == [2.0, 100.0]
    assert {r["y"] for r in cleaning.fill_median(rows, "y", 500.0).collect()} == {500.0}


def test_samples_and_splits_ignore_partitioning(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    for n in (0, 1, 7, 5_000, 19_999, 20_000, 30_000):
        rows = df.orderBy(ordering.hash_key(["k"], 42)).limit(n).collect()
        assert sorted(ordering.sample_n(df.repartition(13), n, ["k"]).collect()) == sorted(rows)
    assert ordering.sample_n(df.limit(3), 7, ["k"]).count() == 3
    assert ordering.sample_n(df.limit(0), 7, ["k"]).count() == 0
    train, test = ordering.split(df, ["k"])
    other = ordering.split(df.repartition(3), ["k"])[1]
    assert {r["k"] for r in test.collect()} == {r["k"] for r in other.collect()}
    assert train.count() + test.count() == 20_000 and 3_700 < test.count() < 4_300


def test_holiday_rules(spark):
    got = {str(r["holiday_date"]) for r in holidays.us_holidays(spark, 2021, 2022).collect()}
    assert got == {
        "2021-01-01", "2021-01-18", "2021-02-15", "2021-05-31", "2021-06-18", "2021-06-19", "2021-07-04", "2021-07-05",
        "2021-09-06", "2021-10-11", "2021-11-11", "2021-11-25", "2021-12-24", "2021-12-25", "2021-12-31",
        "2022-01-01", "2022-01-17", "2022-02-21", "2022-05-30", "2022-06-19", "2022-06-20", "2022-07-04", "2022-09-05",
        "2022-10-10", "2022-11-11", "2022-11-24", "2022-12-25", "2022-12-26",
    }
    before = {str(r["holiday_date"]) for r in holidays.us_holidays(spark, 2020, 2020).collect()}
    assert "2020-06-19" not in before and "2020-07-03" in before


def test_holiday_distance(spark):
    calendar = spark.sql("select * from values (date'2023-07-04'), (date'2023-07-20') as t(holiday_date)")
    df = spark.sql("select explode(array(date'2023-06-30', date'2023-07-01', date'2023-07-04', date'2023-07-07', date'2023-07-08', date'2023-07-13', date'2023-07-23', date'2023-07-24', null)) as d")
    got = {str(r["d"]): (r["DAYS_TO_NEAREST_HOLIDAY"], r["IS_HOLIDAY_WEEK"]) for r in holidays.holiday_week(df, "d", calendar).collect()}
    assert got == {
        "2023-06-30": (4, 0), "2023-07-01": (3, 1), "2023-07-04": (0, 1), "2023-07-07": (3, 1), "2023-07-08": (4, 0),
        "2023-07-13": (7, 0), "2023-07-23": (3, 1), "2023-07-24": (4, 0), "None": (999, 0),
    }
    none = holidays.holiday_week(df, "d", calendar.where("false"))
    assert {r["DAYS_TO_NEAREST_HOLIDAY"] for r in none.collect()} == {999}


def test_weather_join_fills_zero(spark):
    hourly = spark.sql("select 'ATL' as AIRPORT, 2023 as YEAR, 1 as MONTH, 2 as DAY, 5 as HOUR, 1.5D as precipitation, 30D as wind_speed_10m")
    df = spark.sql("select * from values ('ATL', date'2023-01-02', 5), ('ATL', date'2023-01-02', 24), ('XXX', date'2023-01-02', 5) as t(A, FL_DATE, HOUR)")
    got = {(r["A"], r["HOUR"]): (r["O_PRECIP"], r["O_WIND"]) for r in weather.join_weather(df, hourly, "A", "O").collect()}
    assert got == {("ATL", 5): (1.5, 30.0), ("ATL", 24): (0.0, 0.0), ("XXX", 5): (0.0, 0.0)}


@pytest.mark.parametrize(
    "code, wind, rain, risk",
    [
        (0, 0, 0, "Low"), (61, 0, 0, "High"), (60, 0, 0, "Moderate"), (51, 0, 0, "Moderate"), (50, 25, 5, "Low"),
        (0, 41, 0, "High"), (0, 40, 0, "Moderate"), (0, 0, 20.5, "High"), (0, 0, 20, "Moderate"), (None, None, None, "Low"),
    ],
)
def test_weather_risk(one, code, wind, rain, risk):
    columns = [F.lit(v).cast("double") for v in (code, wind, rain)]
    assert one({}, weather.weather_risk(*columns)) == risk


def test_encoder_and_unseen_category(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("b", 60.0)], "c string, y double")
    table = {(r["column"], r["key"]): r["value"] for r in aggregates.fit_encoder(df, "y", ["c"]).collect()}
    mean = 30.0
    assert table[("c", "a")] == pytest.approx((2 * 15 + 10 * mean) / 12)
    assert table[("c", "b")] == pytest.approx((60 + 10 * mean) / 11)
    assert table[("c", "_GLOBAL_MEAN_")] == mean
    new = spark.createDataFrame([("zz",), (None,)], "c string")
    assert {r["c"] for r in aggregates.encode(new, aggregates.fit_encoder(df, "y", ["c"]), ["c"]).collect()} == {mean}


def test_weather_profile(spark):
    df = spark.createDataFrame([("A", 10.0), ("A", 30.0), ("B", 0.0), ("C", 50.0), (None, 6.0)], "ORIGIN_AIRPORT string, WEATHER_DELAY double")
    got = {r["airport"]: r["mean_delay"] for r in aggregates.weather_profile(df).collect()}
    assert got == {"A": 20.0, "C": 50.0, "_GLOBAL_MEAN_": 24.0}
    empty = aggregates.weather_profile(df.where("false")).collect()
    assert [(r["airport"], r["mean_delay"]) for r in empty] == [("_GLOBAL_MEAN_", 45.0)]


def test_metrics(spark):
    df = spark.createDataFrame([(0.0, 3.0), (10.0, 6.0)], "y double, p double")
    row = aggregates.regression_metrics(df, "y", "p").first()
    assert (row["mae"], row["rmse"]) == (3.5, pytest.approx(12.5**0.5))
    causes = spark.createDataFrame(
        [(5.0, "Severe Weather", ["Snow rules"]), (0.0, "STORM", ["weather"]), (0.0, "Late crew", ["weather"]), (3.0, None, [])],
        "w double, cause string, cited array<string>",
    )
    assert aggregates.cause_accuracy(causes, "w", "cause").first()["accuracy"] == 0.5
    assert aggregates.citation_relevance(causes, "cause", "cited").first()["relevance"] == 0.75


def test_align_features(spark):
    df = spark.createDataFrame([(1, None)], "b int, a double")
    out = cleaning.align_features(df, ["a", "b", "missing"])
    assert out.columns == ["a", "b", "missing"] and tuple(out.first()) == (0.0, 1.0, 0.0)


def test_first_and_top(spark):
    df = spark.createDataFrame([("k", i % 5, i) for i in range(50)], "k string, a int, b int")
    assert tuple(ordering.first_by(df, ["k"], ["a", "b"]).first()) == ("k", 0, 0)
    top = ordering.topk(df, ["k"], [F.desc("a"), "b"], 3).orderBy("rank").collect()
    assert [(r["a"], r["b"], r["rank"]) for r in top] == [(4, 4, 1), (4, 9, 2), (4, 14, 3)]
