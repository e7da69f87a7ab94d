"""The feature row: one plan for training and for requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions.clock import calendar_parts, clock_parts, clock_reading, cyclic, is_rush, scheduled_ts
from tarmac.functions.text import route_key
from tarmac.operators.cleaning import clean_flight_keys, clean_target, parse_date, rename_flight_columns
from tarmac.operators.holidays import holiday_week
from tarmac.operators.timeline import rolling_mean
from tarmac.operators.weather import SENT, hourly_readings, join_weather
from tarmac.sources.fixed_values import FEATURES

CONGESTION_SECONDS = 7200


def with_schedule(df: DataFrame, on_clock_error: int = 0) -> DataFrame:
    clock = F.col("SCHEDULED_DEPARTURE")
    if df.schema["SCHEDULED_DEPARTURE"].dataType.simpleString() not in ("int", "bigint"):
        clock = clock_reading(clock)
    return df.withColumn("SCHEDULED_TS", scheduled_ts(F.col("FL_DATE"), F.coalesce(clock, F.lit(on_clock_error))))


def add_congestion(df: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Mean delay of flights scheduled at the same origin in the two hours before.

    The delays are those finally recorded, also of flights that had not left yet by then.
    """
    return rolling_mean(
        df, "ORIGIN_AIRPORT", "SCHEDULED_TS", "DEPARTURE_DELAY", CONGESTION_SECONDS,
        "CONCURRENT_DELAYS_AT_ORIGIN", history=history,
    )


def add_features(
    df: DataFrame,
    weather: DataFrame,
    calendar: DataFrame,
    history: DataFrame | None = None,
    on_clock_error: int = 0,
) -> DataFrame:
    """All model inputs beside the given columns; categories stay text.

    `df` has FL_DATE (date), AIRLINE, FLIGHT_NUMBER, ORIGIN_AIRPORT, DESTINATION_AIRPORT and
    SCHEDULED_DEPARTURE. `history` (ORIGIN_AIRPORT, FL_DATE, SCHEDULED_DEPARTURE,
    DEPARTURE_DELAY) supplies the congestion for requests; the flights themselves otherwise.
    """
    flights = with_schedule(clean_flight_keys(df), on_clock_error)
    if history is not None:
        history = with_schedule(clean_flight_keys(history)).select("ORIGIN_AIRPORT", "SCHEDULED_TS", "DEPARTURE_DELAY")
    return add_other_features(add_congestion(flights, history), weather, calendar, on_clock_error)


def add_other_features(flights: DataFrame, weather: DataFrame, calendar: DataFrame, on_clock_error: int = 0) -> DataFrame:
    """The model inputs beside congestion, for flights with clean keys and SCHEDULED_TS.

    Both ends read the same readings, reduced once; these are a few for any number of flights, and
    then no flight is shuffled for them.
    """
    weather = hourly_readings(weather)
    few = weather.count() <= SENT
    flights = cyclic(clock_parts(calendar_parts(flights, "FL_DATE"), "SCHEDULED_DEPARTURE", on_clock_error), "TIME_OF_DAY")
    flights = holiday_week(flights, "FL_DATE", calendar)
    flights = flights.withColumns(
        {
            "IS_RUSH_HOUR": is_rush(F.col("HOUR")),
            "IS_HOLIDAY": (F.col("DAYS_TO_NEAREST_HOLIDAY") == 0).cast("int"),
            "ROUTE": route_key(F.col("ORIGIN_AIRPORT"), F.col("DESTINATION_AIRPORT")),
        }
    )
    flights = join_weather(flights, weather, "ORIGIN_AIRPORT", "ORIGIN", few=few)
    return join_weather(flights, weather, "DESTINATION_AIRPORT", "DEST", few=few)


def training_rows(raw: DataFrame) -> DataFrame:
    """Raw flight records with a usable date and delay, under the normalised names."""
    return rename_flight_columns(parse_date(clean_target(raw, "DEP_DELAY"), "FL_DATE"))


def build_features(raw: DataFrame, weather: DataFrame, calendar: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 23 model inputs in order, the target, and columns to keep.

    Distance and planned duration may still be null: their median belongs to the training
    part, so `train_and_evaluate` fills them after the split.
    """
    rows = add_features(training_rows(raw), weather, calendar)
    return rows.select(*FEATURES, "DEPARTURE_DELAY", *keep)
