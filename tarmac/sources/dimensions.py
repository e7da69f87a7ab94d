"""Small lookup tables. All are constant lists, so their size is known when planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators.ordering import first_by
from tarmac.sources import fixed_values as fixed


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (tuple, list)):
        return "array(" + ", ".join(sql_literal(v) for v in value) + ")"
    if isinstance(value, float):
        return f"{value!r}e0"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def inline_table(spark: SparkSession, columns: list[str], rows) -> DataFrame:
    """Rows as a literal table: a local relation whose size the planner can see."""
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def dim_airport(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ["code", "latitude", "longitude"], fixed.AIRPORTS)


def dim_carrier(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ["iata", "icao"], fixed.CARRIERS)


def dim_carrier_name(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ["carrier", "carrier_name"], fixed.CARRIER_NAMES)


def dim_hub(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ["carrier", "hubs"], fixed.HUBS)


def dim_city(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ["code", "city"], fixed.CITIES)


def dim_recommendation(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ["situation", "action", "reasoning"], fixed.RECOMMENDATIONS)


def airport_aliases(spark: SparkSession, world: DataFrame | None = None) -> DataFrame:
    """One position per code, whatever form the code has.

    `world` (iata, icao, latitude, longitude) is a fuller airport list if there is one.
    Precedence: its two-letter-country codes, its four-letter codes, a leading K removed,
    then the built-in list.
    """
    local = dim_airport(spark).select("code", "latitude", "longitude", F.lit(3).alias("tier"))
    if world is None:
        return local.drop("tier")
    where = ["latitude", "longitude"]
    iata = F.upper(F.trim("iata"))
    icao = F.upper(F.trim("icao"))
    aliases = (
        world.select(iata.alias("code"), *where, F.lit(0).alias("tier"))
        .unionByName(world.select(icao.alias("code"), *where, F.lit(1).alias("tier")))
        .unionByName(
            world.where(F.length(iata) == 3).select(
                F.concat(F.lit("K"), iata).alias("code"), *where, F.lit(2).alias("tier")
            )
        )
        .unionByName(local)
        .where(F.col("code").isNotNull() & (F.col("code") != ""))
    )
    return first_by(aliases, ["code"], ["tier", "latitude", "longitude"]).drop("tier")
