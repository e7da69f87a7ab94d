"""US public holidays and the distance to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarmac.functions.clock import weekday_from_monday

NO_HOLIDAY_DISTANCE = 999
HOLIDAY_WEEK_DAYS = 3


def _fixed_date(day: Column) -> Column:
    month, dom = F.month(day), F.dayofmonth(day)
    return (
        ((month == 1) & (dom == 1))
        | ((month == 6) & (dom == 19) & (F.year(day) >= 2021))
        | ((month == 7) & (dom == 4))
        | ((month == 11) & (dom == 11))
        | ((month == 12) & (dom == 25))
    )


def _nth_weekday(day: Column) -> Column:
    month, dom, weekday = F.month(day), F.dayofmonth(day), weekday_from_monday(day)
    monday, thursday = weekday == 1, weekday == 4
    return (
        (monday & (month == 1) & dom.between(15, 21) & (F.year(day) >= 1986))
        | (monday & (month == 2) & dom.between(15, 21))
        | (monday & (month == 5) & (dom >= 25))
        | (monday & (month == 9) & (dom <= 7))
        | (monday & (month == 10) & dom.between(8, 14))
        | (thursday & (month == 11) & dom.between(22, 28))
    )


def is_us_holiday(day: Column) -> Column:
    """True on a US federal holiday or the weekday it is observed on."""
    weekday = weekday_from_monday(day)
    observed_early = (weekday == 5) & _fixed_date(F.date_add(day, 1))
    observed_late = (weekday == 1) & _fixed_date(F.date_sub(day, 1))
    return _fixed_date(day) | _nth_weekday(day) | observed_early | observed_late


def us_holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Calendar of the years given, both included. At most 366 rows per year by construction."""
    days = spark.range(0, 1, 1, 1).select(
        F.explode(F.sequence(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), F.make_date(F.lit(last_year), F.lit(12), F.lit(31)))).alias("holiday_date")
    )
    return days.where(is_us_holiday(F.col("holiday_date")))


def is_holiday(df: DataFrame, date: str, calendar: DataFrame, out: str = "IS_HOLIDAY") -> DataFrame:
    marks = calendar.select(F.col("holiday_date").alias(date)).distinct().withColumn("_holiday", F.lit(1))
    return df.join(marks, date, "left").withColumn(out, F.coalesce("_holiday", F.lit(0))).drop("_holiday")


def holiday_distance_days(calendar: DataFrame) -> DataFrame:
    """One row per day from the first to the last holiday: day, days since, days to, distance.

    A calendar has a few holidays a year, so this table has a few hundred rows a year.
    """
    dates = calendar.select("holiday_date").distinct()
    spans = dates.withColumn("_next", F.lead("holiday_date").over(W.orderBy("holiday_date")))
    upto = F.coalesce(F.date_sub("_next", 1), F.col("holiday_date"))
    day = F.col("day")
    return (
        spans.withColumn("day", F.explode(F.sequence(F.col("holiday_date"), upto)))
        .withColumn("days_since", F.datediff(day, F.col("holiday_date")))
        .withColumn("days_to", F.when(F.col("days_since") == 0, 0).otherwise(F.datediff("_next", day)))
        .select("day", "days_since", "days_to", F.least("days_since", "days_to").alias("distance"))
    )


def holiday_week(
    df: DataFrame,
    date: str,
    calendar: DataFrame,
    distance: str = "DAYS_TO_NEAREST_HOLIDAY",
    out: str = "IS_HOLIDAY_WEEK",
) -> DataFrame:
    """Days to the nearest holiday before or after (999 without any) and the within-3-days flag.

    Days between two holidays come from a day table; before the first and after the last one
    the distance follows from that holiday alone.
    """
    table = holiday_distance_days(calendar).select(F.col("day").alias(date), F.col("distance").alias("_distance"))
    first = calendar.agg(F.min("holiday_date")).scalar()
    last = calendar.agg(F.max("holiday_date")).scalar()
    day = F.col(date)
    outside = F.when(day < first, F.datediff(first, day)).when(day > last, F.datediff(day, last))
    nearest = F.coalesce(F.col("_distance"), outside, F.lit(NO_HOLIDAY_DISTANCE))
    return (
        df.join(table, date, "left")
        .withColumn(distance, nearest)
        .withColumn(out, (F.col(distance) <= HOLIDAY_WEEK_DAYS).cast("int"))
        .drop("_distance")
    )
