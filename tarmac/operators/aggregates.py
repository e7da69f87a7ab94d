"""Encoder and profile tables, metrics and summaries. All combine before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GLOBAL_KEY = "_GLOBAL_MEAN_"
CATEGORIES = ("AIRLINE", "ORIGIN_AIRPORT", "DESTINATION_AIRPORT", "FLIGHT_NUMBER", "ROUTE")


def fit_encoder(
    df: DataFrame, target: str, columns: Sequence[str] = CATEGORIES, smoothing: float = 10.0
) -> DataFrame:
    """Smoothed mean of the target per category of every column, and the global mean.

    Columns: column, key, value; the global mean sits under key `_GLOBAL_MEAN_`.
    One grouping for all columns: the table is unpivoted, not read once per column.
    """
    global_mean = df.agg(F.avg(target)).scalar()
    long = df.select(F.col(target).alias("_y"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        ["_y"], list(columns), "column", "key"
    )
    stats = (
        long.where(F.col("key").isNotNull() & F.col("_y").isNotNull())
        .groupBy("column", "key")
        .agg(F.count("_y").alias("n"), F.avg("_y").alias("mean"))
    )
    value = (F.col("n") * F.col("mean") + F.lit(smoothing) * global_mean) / (F.col("n") + F.lit(smoothing))
    names = df.sparkSession.range(0, 1, 1, 1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    return stats.select("column", "key", value.alias("value")).unionByName(
        names.select("column", F.lit(GLOBAL_KEY).alias("key"), global_mean.alias("value"))
    )


def encode(df: DataFrame, encoder: DataFrame, columns: Sequence[str] = CATEGORIES) -> DataFrame:
    """Categories replaced by their encoder value; an unseen one gets the global mean."""
    for name in columns:
        part = encoder.where(F.col("column") == name)
        fallback = part.where(F.col("key") == GLOBAL_KEY).agg(F.max("value")).scalar()
        values = part.select(F.col("key").alias(name), F.col("value").alias("_value"))
        df = (
            df.withColumn(name, F.col(name).cast("string"))
            .join(values, name, "left")
            .withColumn(name, F.coalesce(F.col("_value"), fallback, F.lit(0.0)))
            .drop("_value")
        )
    return df


def weather_profile(
    df: DataFrame, origin: str = "ORIGIN_AIRPORT", delay: str = "WEATHER_DELAY", fallback: float = 45.0
) -> DataFrame:
    """Mean weather delay per origin over flights that had one, and over all of them.

    Columns: airport, mean_delay. The global row is present in every case.
    """
    hit = df.where(F.col(delay) > 0).select(F.col(origin).alias("airport"), F.col(delay).cast("double").alias("delay"))
    empty = df.sparkSession.range(0, 1, 1, 1).select(F.lit(None).cast("string").alias("airport"), F.lit(None).cast("double").alias("delay"))
    rolled = hit.unionByName(empty).rollup("airport").agg(F.avg("delay").alias("mean_delay"), F.grouping("airport").alias("_all"))
    is_global = F.col("_all") == 1
    return rolled.where(is_global | F.col("airport").isNotNull()).select(
        F.when(is_global, F.lit(GLOBAL_KEY)).otherwise(F.col("airport")).alias("airport"),
        F.when(is_global, F.coalesce("mean_delay", F.lit(fallback))).otherwise(F.col("mean_delay")).alias("mean_delay"),
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean absolute and root mean squared error, always as measured."""
    error = F.col(actual) - F.col(predicted)
    return df.agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.count(error).alias("n")
    )


def names_weather(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("weather|storm|snow"), F.lit(False))


def cause_accuracy(df: DataFrame, weather_minutes: str, cause: str) -> DataFrame:
    """Share of flights whose named cause agrees with the recorded weather delay."""
    actual = F.coalesce(F.col(weather_minutes) > 0, F.lit(False))
    hit = (actual == names_weather(F.col(cause))).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def citation_relevance(df: DataFrame, cause: str, citations: str) -> DataFrame:
    """Share of flights whose citations fit the cause.

    A weather cause needs a weather word in the citations, any other cause needs the word
    weather to be absent.
    """
    text = F.lower(F.coalesce(F.array_join(citations, " "), F.lit("")))
    hit = F.when(names_weather(F.col(cause)), text.rlike("weather|storm|snow")).otherwise(~text.contains("weather"))
    return df.agg(F.avg(hit.cast("double")).alias("relevance"), F.count(F.lit(1)).alias("n"))


def precision_at_k(queries: DataFrame, hits: DataFrame, query: str, rank: str, relevant: Column, k: int) -> DataFrame:
    """Mean over all `queries` of the share of relevant rows among the first k hits; 0 for a query without hits."""
    per_query = hits.where(F.col(rank) <= k).groupBy(query).agg((F.sum(relevant.cast("int")) / F.lit(k)).alias("p"))
    asked = queries.select(query).distinct().join(per_query, query, "left")
    return asked.agg(F.avg(F.coalesce("p", F.lit(0.0))).alias("precision"), F.count(F.lit(1)).alias("queries"))


def snapshot_summary(positions: DataFrame, by: Sequence[str], total: str) -> DataFrame:
    """Per snapshot: vectors received, vectors kept, aircraft landing."""
    return positions.groupBy(*by).agg(
        F.max(total).alias("total"),
        F.count(F.lit(1)).alias("kept"),
        F.count_if("is_landing").alias("landing"),
    )
