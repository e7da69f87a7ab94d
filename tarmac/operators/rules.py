"""Decision rules over the event row, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.text import first_int
from tarmac.operators.aggregates import GLOBAL_KEY
from tarmac.operators.weather import weather_risk
from tarmac.sources import dimensions as dims
from tarmac.sources import fixed_values as fixed

__all__ = ["weather_risk"]


def both_low(origin_risk: Column, dest_risk: Column) -> Column:
    return F.coalesce((origin_risk == "Low") & (dest_risk == "Low"), F.lit(False))


def any_risk(level: str, origin_risk: Column, dest_risk: Column) -> Column:
    return F.coalesce(origin_risk == level, F.lit(False)) | F.coalesce(dest_risk == level, F.lit(False))


def baseline(prediction: Column) -> Column:
    """Predicted minutes truncated, never below 0."""
    return F.greatest(F.lit(0).cast("bigint"), prediction.cast("bigint"))


def weather_delay(risk: Column, profile: Column, overall: Column) -> Column:
    """Minutes one end's weather adds: its usual weather delay, at least 60 (High) or 30 (Moderate)."""
    usual = F.coalesce(F.when(profile != 0, profile), overall)
    return (
        F.when(risk == "High", F.greatest(usual, F.lit(60.0)))
        .when(risk == "Moderate", F.greatest(usual * 0.5, F.lit(30.0)))
        .otherwise(F.lit(0.0))
    )


def fuse_weather(
    df: DataFrame,
    profile: DataFrame | None,
    base: str = "baseline",
    out: str = "predicted_delay_minutes",
    origin: str = "origin",
    destination: str = "destination",
) -> DataFrame:
    """The larger of the model's minutes and the worse end's weather delay.

    `profile` (airport, mean_delay) as from `weather_profile`; without one 30 minutes stand
    in for every airport, without its global row 45.
    """
    if profile is None:
        df = df.withColumns({"_po": F.lit(None).cast("double"), "_pd": F.lit(None).cast("double")})
        overall = F.lit(30.0)
    else:
        for column, name in ((origin, "_po"), (destination, "_pd")):
            side = profile.where(F.col("airport") != GLOBAL_KEY).select(F.col("airport").alias(column), F.col("mean_delay").alias(name))
            df = df.join(side, column, "left")
        overall = F.coalesce(profile.where(F.col("airport") == GLOBAL_KEY).agg(F.max("mean_delay")).scalar(), F.lit(45.0))
    worse = F.greatest(
        weather_delay(F.col("dest_risk"), F.col("_pd"), overall), weather_delay(F.col("origin_risk"), F.col("_po"), overall)
    )
    return df.withColumn(out, F.greatest(F.col(base), worse.cast("bigint"))).drop("_po", "_pd")


def is_landing_text(status: Column, marker: str = "About to Land") -> Column:
    return F.coalesce(status.contains(marker), F.lit(False))


def landing_override(
    delay: Column, status: Column, dest_risk: Column, confidence: Column, marker: str = "About to Land"
) -> tuple[Column, Column]:
    """(delay, confidence) with an approaching aircraft's certainty and holding buffer."""
    landing = is_landing_text(status, marker)
    held = F.when(landing & (dest_risk == "High"), F.greatest(delay, F.lit(25).cast("bigint"))).otherwise(delay)
    return held, F.when(landing, F.lit(0.94)).otherwise(confidence)


def heuristic_delay(origin_risk: Column, dest_risk: Column) -> tuple[Column, Column]:
    """(delay, confidence) without a model, by the worse risk."""
    high, moderate = any_risk("High", origin_risk, dest_risk), any_risk("Moderate", origin_risk, dest_risk)
    delay = F.when(high, 90).when(moderate, 30).otherwise(0).cast("bigint")
    return delay, F.when(high, F.lit(0.70)).when(moderate, F.lit(0.60)).otherwise(F.lit(0.80))


def confidence(
    seen_airline: Column, seen_origin: Column, seen_destination: Column, origin_risk: Column, dest_risk: Column
) -> Column:
    """Model confidence before clamping: lower for categories the encoder never saw."""
    score = F.lit(0.85)
    for seen in (seen_airline, seen_origin, seen_destination):
        score = score - F.when(F.coalesce(seen, F.lit(False)), F.lit(0.0)).otherwise(F.lit(0.05))
    shift = (
        F.when(any_risk("High", origin_risk, dest_risk), F.lit(-0.15))
        .when(both_low(origin_risk, dest_risk), F.lit(0.05))
        .otherwise(F.lit(0.0))
    )
    return score + shift


def clamp_confidence(score: Column) -> Column:
    return F.least(F.lit(0.95), F.greatest(F.lit(0.50), score))


def add_accumulated(delay: Column, accumulated: Column) -> Column:
    return delay + F.coalesce(accumulated, F.lit(0)).cast("bigint")


def skips_search(delay: Column, origin_risk: Column, dest_risk: Column) -> Column:
    """Calm and on time: no cause to look for."""
    return (delay < 15) & both_low(origin_risk, dest_risk)


def root_cause(delay: Column, origin_risk: Column, dest_risk: Column, reply: Column | None = None) -> Column:
    """Struct of primary cause, second cause and, where no search is needed, its citation.

    `reply` is a parsed reply of an outside model (`cause_reply`); where it is null the rules
    decide. `citation` is null where the corpus has to be searched.
    """
    calm = both_low(origin_risk, dest_risk)
    inherited = calm & (delay > 15)

    def answer(primary: Column, secondary: Column, citation: Column) -> Column:
        return F.struct(primary.alias("primary_cause"), secondary.alias("secondary_cause"), citation.alias("citation"))

    by_rule = answer(
        F.when(inherited, F.lit("Inherited Ground Delay")).otherwise(F.lit("Weather/Congestion")),
        F.lit("Unknown"),
        F.when(inherited, F.lit(fixed.CITATION_INHERITED)).otherwise(F.lit(fixed.CITATION_NO_CORPUS)),
    )
    result = F.when(
        skips_search(delay, origin_risk, dest_risk),
        answer(F.lit("None"), F.lit("Routine Operations"), F.lit(fixed.CITATION_ROUTINE)),
    )
    if reply is not None:
        searched = answer(reply["primary_cause"], reply["secondary_cause"], F.lit(None).cast("string"))
        result = result.when(reply.isNotNull(), searched)
    return result.otherwise(by_rule)


def atc_constraint(programme: Column, minutes=first_int) -> Column:
    """Programme in force at the destination: stop before delay programme before arrival delay."""
    stop, hold, arrival = (programme.getField(n) for n in ("groundStop", "groundDelay", "arrivalDelay"))

    def state(active: bool, kind: str, message: Column, penalty: Column) -> Column:
        return F.struct(
            F.lit(active).alias("active_notam"), F.lit(kind).alias("notam_type"),
            message.alias("message"), penalty.cast("bigint").alias("delay_penalty_minutes"),
        )

    def in_force(texts: tuple, of: Column, penalty: Column | None = None) -> Column:
        kind, before, after, fixed_minutes = texts
        reason = F.coalesce(of.getField("reason"), F.lit(fixed.UNKNOWN_REASON))
        return state(True, kind, F.concat(F.lit(before), reason, F.lit(after)), F.lit(fixed_minutes) if penalty is None else penalty)

    return (
        F.when(stop.isNotNull(), in_force(fixed.GROUND_STOP, stop))
        .when(hold.isNotNull(), in_force(fixed.GROUND_DELAY, hold, minutes(hold.getField("avgDelay"))))
        .when(arrival.isNotNull(), in_force(fixed.ARRIVAL_DELAY, arrival))
        .otherwise(state(False, fixed.NO_PROGRAMME[0], F.lit(fixed.NO_PROGRAMME_MESSAGE), F.lit(fixed.NO_PROGRAMME[3])))
    )


def situation(active: Column, delay: Column, origin_risk: Column, dest_risk: Column) -> Column:
    """Which of the four recommendations applies."""
    return (
        F.when(F.coalesce(active, F.lit(False)), "programme")
        .when((delay > 15) & both_low(origin_risk, dest_risk), "inherited")
        .when(delay > 15, "at_risk")
        .otherwise("routine")
    )


def recommend(
    df: DataFrame,
    active: Column,
    delay: Column,
    origin_risk: Column,
    dest_risk: Column,
    reply: Column | None = None,
    out: str = "recommendation",
) -> DataFrame:
    """Action and reasoning: a readable reply (`action_reply`) first, else the rules' text."""
    texts = dims.dim_recommendation(df.sparkSession).select(
        F.col("situation").alias("_situation"), F.struct("action", "reasoning").alias("_rule")
    )
    joined = df.withColumn("_situation", situation(active, delay, origin_risk, dest_risk)).join(
        F.broadcast(texts), "_situation", "left"
    )
    chosen = F.col("_rule") if reply is None else F.coalesce(reply, F.col("_rule"))
    return joined.withColumn(out, chosen).drop("_situation", "_rule")


def boost_confidence(score: Column, active: Column) -> Column:
    return F.when(F.coalesce(active, F.lit(False)), F.lit(0.95)).otherwise(score)


def kpi_bands(delay: Column, score: Column) -> dict[str, Column]:
    """Display status, error band in minutes and confidence in percent."""
    return {
        "display_status": F.when(delay > 15, "DELAYED").otherwise("ON TIME"),
        "band_minutes": F.when(score >= 0.90, 5).otherwise(15),
        "confidence_pct": F.round(score * 100, 0).cast("bigint"),
    }


def default_flight(query: Column) -> Column:
    """Flight used when a request cannot be resolved at all."""
    coordinates = {row[0]: row[1:] for row in fixed.AIRPORTS}
    (lat1, lon1), (lat2, lon2) = coordinates["ORD"], coordinates["DFW"]
    zero = F.lit(0).cast("bigint")
    return F.struct(
        F.coalesce(F.when(query != "", query), F.lit("UNK000")).alias("flight_id"),
        F.lit("UNK").alias("carrier"),
        F.lit("ORD").alias("origin"),
        F.lit("DFW").alias("destination"),
        F.lit("LIVE").alias("scheduled_departure"),
        F.lit(lat1).alias("latitude"),
        F.lit(lon1).alias("longitude"),
        F.lit(lat1).alias("origin_latitude"),
        F.lit(lon1).alias("origin_longitude"),
        F.lit(lat2).alias("dest_latitude"),
        F.lit(lon2).alias("dest_longitude"),
        zero.alias("altitude"),
        zero.alias("velocity"),
        F.lit("API Error - Fallback Mode").alias("status"),
        zero.alias("accumulated_delay"),
    )


def default_event(df: DataFrame, flight: str = "flight", query: str = "query") -> DataFrame:
    """Requests whose flight struct is null get the default flight."""
    return df.withColumn(flight, F.coalesce(F.col(flight), default_flight(F.upper(F.trim(F.col(query))))))
