"""Weather at both ends of a flight."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.operators.ordering import one_per
from tarmac.sources import fixed_values as fixed
from tarmac.sources.tables import save_table
from tarmac.workspace import new_folder

FEATURE_READINGS = {"precipitation": "PRECIP", "wind_speed_10m": "WIND"}


SENT = 100_000  # readings that every task is sent


def hourly_readings(weather: DataFrame, readings: Mapping[str, str] = FEATURE_READINGS) -> DataFrame:
    """The highest readings per airport and hour, stored, so that their number is known and nothing is reduced twice."""
    highest = [F.max(F.col(c).cast("double")).alias(c) for c in readings]
    reduced = weather.groupBy("AIRPORT", "YEAR", "MONTH", "DAY", "HOUR").agg(*highest)
    return save_table(reduced, new_folder(weather.sparkSession, "readings"))


def join_weather(
    df: DataFrame,
    weather: DataFrame,
    airport: str,
    prefix: str,
    readings: Mapping[str, str] = FEATURE_READINGS,
    date: str = "FL_DATE",
    hour: str = "HOUR",
    few: bool = False,
) -> DataFrame:
    """Hourly readings at one end of the flight; 0 where there is no reading.

    Of several readings for an airport and hour the highest counts. Hour 24 matches no row. `few`
    readings are sent to the flights, which then need not be dealt out by airport and hour.
    """
    side = weather.groupBy(
        F.col("AIRPORT").alias(airport), F.make_date("YEAR", "MONTH", "DAY").alias(date), F.col("HOUR").alias(hour)
    ).agg(*[F.max(F.col(c).cast("double")).alias(f"_{c}") for c in readings])
    joined = df.join(F.broadcast(side) if few else side, [airport, date, hour], "left")
    return joined.withColumns(
        {f"{prefix}_{name}": F.coalesce(F.col(f"_{c}"), F.lit(0.0)) for c, name in readings.items()}
    ).drop(*[f"_{c}" for c in readings])


def weather_risk(code: Column, wind: Column, precipitation: Column) -> Column:
    """High, Moderate or Low; an absent reading counts as 0."""
    code, wind, precipitation = (F.coalesce(c, F.lit(0.0)) for c in (code, wind, precipitation))
    return (
        F.when((precipitation > 20) | (wind > 40) | (code >= 61), "High")
        .when((precipitation > 5) | (wind > 25) | (code >= 51), "Moderate")
        .otherwise("Low")
    )


def daily_weather(hourly: DataFrame) -> DataFrame:
    """Per airport and date: highest code, temperature and wind, and the precipitation sum."""
    columns = set(hourly.columns)

    def highest(name: str) -> Column:
        return F.max(F.col(name).cast("double") if name in columns else F.lit(0.0))

    return hourly.groupBy("AIRPORT", F.make_date("YEAR", "MONTH", "DAY").alias("date")).agg(
        highest("weathercode").alias("weathercode"),
        highest("temperature_2m").alias("temperature_2m_max"),
        F.sum(F.col("precipitation").cast("double")).alias("precipitation_sum"),
        F.max(F.col("wind_speed_10m").cast("double")).alias("windspeed_10m_max"),
    )


READINGS = ("code", "temperature", "wind", "precipitation")


def pick_weather(
    df: DataFrame,
    now_weather: DataFrame,
    day_weather: DataFrame,
    today: str,
    airport: str,
    date: str,
    prefix: str,
) -> DataFrame:
    """Current readings for flights of today or without a date, the day's readings otherwise.

    `now_weather` has airport, weather_code, temperature_2m, precipitation, windspeed_10m;
    `day_weather` has airport, date, weathercode, temperature_2m_max, precipitation_sum,
    windspeed_10m_max. Of an airport's documents the newest counts, by a column `time` if there
    is one; an airport without a current one has calm readings. Any other missing reading is 0.
    `date` is a yyyy-MM-dd text.
    """
    now = one_per(now_weather, ["airport"], ("time",)).select(
        F.col("airport").alias(airport),
        F.struct(
            F.col("weather_code").cast("double").alias("code"),
            F.col("temperature_2m").cast("double").alias("temperature"),
            F.col("windspeed_10m").cast("double").alias("wind"),
            F.col("precipitation").cast("double").alias("precipitation"),
        ).alias("_now"),
    )
    day = one_per(day_weather, ["airport", "date"]).select(
        F.col("airport").alias(airport),
        F.date_format("date", "yyyy-MM-dd").alias(date),
        F.struct(
            F.col("weathercode").cast("double").alias("code"),
            F.col("temperature_2m_max").cast("double").alias("temperature"),
            F.col("windspeed_10m_max").cast("double").alias("wind"),
            F.col("precipitation_sum").cast("double").alias("precipitation"),
        ).alias("_day"),
    )
    joined = df.join(now, airport, "left").join(day, [airport, date], "left")
    live = F.coalesce(F.col(date) == today, F.lit(True)) | (F.col(date) == "")
    calm = F.struct(*[F.lit(fixed.CALM_READINGS[r]).cast("double").alias(r) for r in READINGS])
    # One choice for all readings: one for each would make the code longer than the JVM compiles.
    chosen = joined.withColumn("_reading", F.when(live, F.coalesce("_now", calm)).otherwise(F.col("_day")))
    return chosen.withColumns({f"{prefix}_{r}": F.coalesce(F.col(f"_reading.{r}"), F.lit(0.0)) for r in READINGS}).drop("_now", "_day", "_reading")
