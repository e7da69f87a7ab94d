"""Calendar and clock columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUSH_HOURS = (7, 8, 9, 16, 17, 18, 19)


def weekday_from_monday(day: Column) -> Column:
    """1 on Monday to 7 on Sunday."""
    return F.weekday(day) + 1


def calendar_parts(df: DataFrame, date: str) -> DataFrame:
    day = F.col(date)
    return df.withColumns(
        {"MONTH": F.month(day), "DAY": F.dayofmonth(day), "DAY_OF_WEEK": weekday_from_monday(day)}
    )


def hhmm_column(df: DataFrame, clock: str) -> Column:
    """A clock column such as 1435, '1435' or '1435.0' as an integer; null if unreadable."""
    if df.schema[clock].dataType.simpleString() == "int":
        return F.col(clock)
    return F.col(clock).try_cast("double").try_cast("int")


def clock_parts(df: DataFrame, clock: str, on_error: int = 0) -> DataFrame:
    """HOUR, MINUTE and TIME_OF_DAY. 2400 gives hour 24.

    `on_error` is the reading used for a missing or unreadable value: 0 for the history,
    1200 for requests.
    """
    read = df.withColumn("_reading", F.coalesce(hhmm_column(df, clock), F.lit(on_error)))
    hour = F.call_function("div", F.col("_reading"), F.lit(100)).cast("int")
    parts = read.withColumns({"HOUR": hour, "MINUTE": F.col("_reading") % 100})
    return parts.withColumn("TIME_OF_DAY", F.col("HOUR") * 60 + F.col("MINUTE")).drop("_reading")


def cyclic(
    df: DataFrame, column: str, period: float = 1440.0, sin_name: str = "SIN_TIME", cos_name: str = "COS_TIME"
) -> DataFrame:
    angle = F.col(column) * F.lit(2 * math.pi / period)
    return df.withColumns({sin_name: F.sin(angle), cos_name: F.cos(angle)})


def is_rush(hour: Column) -> Column:
    return hour.isin(*RUSH_HOURS).cast("int")


def clock_reading(value: Column) -> Column:
    """Whole HHMM number of a text or decimal clock such as '905' or '905.0'; null if unreadable."""
    number = value.try_cast("double")
    return F.when(number == F.floor(number), number).try_cast("int")


def scheduled_ts(date: Column, reading: Column) -> Column:
    """Zone-free timestamp of a scheduled departure, from an integer clock reading HHMM.

    2400 becomes 00:00 of the same date, an unreadable clock (null, negative or more than four
    digits) 00:00, and four digits that are no time of day (such as 2575) null.
    """
    def minutes(r: Column) -> Column:
        no_time = r.between(2401, 9999) | (r.between(0, 2400) & (r % 100 >= 60))
        return F.when(no_time, None).when(r.between(0, 2399), F.call_function("div", r, F.lit(100)).cast("int") * 60 + r % 100).otherwise(0)

    # The reading stands once in the expression: filters on the time are pushed down with copies of it,
    # and with eight readings in each the scan's code grows beyond what the JVM compiles.
    of_day = F.get(F.transform(F.array(reading), minutes), F.lit(0))
    return date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), of_day)


def epoch_delay(scheduled: Column, actual: Column) -> Column:
    """Whole minutes between two epoch seconds, only when late; otherwise null."""
    minutes = F.call_function("div", actual - scheduled, F.lit(60))
    return F.when((scheduled != 0) & (actual != 0) & (minutes > 0), minutes)


def epoch_hhmm(seconds: Column) -> Column:
    """UTC clock reading HHMM of epoch seconds."""
    minute_of_day = F.call_function("div", F.pmod(seconds, F.lit(86_400)), F.lit(60))
    hour = F.call_function("div", minute_of_day, F.lit(60))
    return F.when(
        seconds.isNotNull() & (seconds != 0),
        F.format_string("%02d%02d", hour.cast("int"), (minute_of_day % 60).cast("int")),
    )


def iso_hhmm(text: Column) -> Column:
    """HHMM of an ISO timestamp text; null without a time part."""
    time = F.split(text, "T").getItem(1)
    return F.when(text.contains("T"), F.substring(F.replace(time, F.lit(":"), F.lit("")), 1, 4))
