"""How good whole analyses are: recorded flights are analysed and held against what happened to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarmac.functions.text import flight_key
from tarmac.operators.aggregates import cause_accuracy, citation_relevance, regression_metrics
from tarmac.operators.cleaning import delayed, flight_date
from tarmac.operators.ordering import first_by, sample_n
from tarmac.sources.tables import save_table
from tarmac.workspace import new_folder


def recorded_flights(history: DataFrame, n: int | None = None, low: float = 15, high: float = 180, seed: int = 42) -> DataFrame:
    """Flights with low < delay < high as requests, with their outcome: request_id, mode, query, actual_delay, weather_minutes.

    `history` holds normalised flights. Of flights with the same id the first in the order of the
    lookup counts. With `n` a seeded sample of so many; request_id then runs from 0 in the order of
    the ids, else it is made from the id.
    """
    query = flight_key(F.trim("AIRLINE"), F.trim("FLIGHT_NUMBER"), flight_date(history))
    late = delayed(history, "DEPARTURE_DELAY", low, high).withColumn("query", query)
    one = first_by(late, ["query"], ["SCHEDULED_DEPARTURE", "ORIGIN_AIRPORT", "DESTINATION_AIRPORT", "DEPARTURE_DELAY", "CANCELLED", "WEATHER_DELAY"])
    flights = one.select(
        F.lit("historical").alias("mode"), "query", F.col("DEPARTURE_DELAY").cast("int").alias("actual_delay"), F.col("WEATHER_DELAY").cast("double").alias("weather_minutes")
    )
    if n is None:
        return flights.withColumn("request_id", F.xxhash64("query"))
    number = F.row_number().over(W.orderBy("query")) - 1  # over `n` rows
    return sample_n(flights, n, ["query"], seed).withColumn("request_id", number.cast("bigint"))


def evaluate(flights: DataFrame, analyse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row: mae, rmse, accuracy of causes, relevance of citations, n.

    `flights` as from `recorded_flights`; `analyse` gives an event for each request. A flight without
    an event counts as predicted on time, without a cause and without citations.
    """
    folder = new_folder(flights.sparkSession, "evaluation")
    flights = save_table(flights, f"{folder}/flights")
    events = analyse(flights.select("request_id", "mode", "query")).select(
        "request_id", F.col("risk.predicted_delay_minutes").alias("predicted"), F.col("root_cause.primary_cause").alias("cause"), F.col("root_cause.faa_citations").alias("citations")
    )
    judged = save_table(flights.join(events, "request_id", "left").withColumn("predicted", F.coalesce("predicted", F.lit(0))), f"{folder}/judged")
    errors = regression_metrics(judged, "actual_delay", "predicted")
    causes = cause_accuracy(judged, "weather_minutes", "cause").select("accuracy")
    cited = citation_relevance(judged, "cause", "citations").select("relevance")
    return errors.select("*", causes.select("accuracy").scalar().alias("accuracy"), cited.select("relevance").scalar().alias("relevance"))
