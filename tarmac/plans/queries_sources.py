"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import lookups
from tarmac.operators.aggregates import weather_profile
from tarmac.operators.cleaning import normalise
from tarmac.plans.registry import query
from tarmac.plans.views import airport, flights, oracle, table, view
from tarmac.sources import dimensions as dims
from tarmac.sources import feeds, tables
from tarmac.workspace import new_folder

FLIGHT_COLUMNS = "FL_DATE, AIRLINE, FL_NUMBER, ORIGIN, DEST, CRS_DEP_TIME, DEP_DELAY, CANCELLED, DELAY_DUE_WEATHER, DISTANCE, CRS_ELAPSED_TIME"


@query(
    "s1_read_flights",
    oracle(
        """select cast(FL_DATE as varchar) as FL_DATE, AIRLINE, cast(FL_NUMBER as bigint) as FL_NUMBER, ORIGIN, DEST,
             CRS_DEP_TIME, DEP_DELAY, CANCELLED, DELAY_DUE_WEATHER, DISTANCE, CRS_ELAPSED_TIME from flights""",
        "flights",
    ),
)
def read_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "flights-csv")
    flights(spark, sf_dir).write.option("header", True).csv(path)
    return tables.read_flights(spark, path).select(*FLIGHT_COLUMNS.split(", "))


@query("s2_pruned_scan", "select o_custkey, count(*) as n from orders group by o_custkey")
def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read_flights(spark, f"{sf_dir}/orders.parquet", "parquet").select("o_custkey")
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s3_explode_hourly",
    oracle(
        """select AIRPORT, YEAR, MONTH, DAY, HOUR,
             case when HOUR%7=0 then 0e0 else precipitation end as precipitation,
             case when HOUR%5=0 then 10e0 else wind_speed_10m end as wind_speed_10m
           from weather_hourly""",
        "weather_hourly",
    ),
)
def explode_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.struct(
        F.format_string("%04d-%02d-%02dT%02d:00", "YEAR", "MONTH", "DAY", "HOUR").alias("time"),
        F.when(F.col("HOUR") % 7 != 0, F.col("precipitation").cast("double")).alias("precipitation"),
        F.when(F.col("HOUR") % 5 != 0, F.col("wind_speed_10m").cast("double")).alias("wind_speed_10m"),
    )
    # One document per airport and day: 24 hours at most.
    documents = (
        view(spark, sf_dir, "weather_hourly")
        .groupBy(F.col("AIRPORT").alias("airport"), "YEAR", "MONTH", "DAY")
        .agg(F.array_sort(F.collect_list(hour)).alias("h"))
        .select(
            "airport",
            F.to_json(
                F.struct(
                    F.struct(
                        F.col("h.time").alias("time"),
                        F.col("h.precipitation").alias("precipitation"),
                        F.col("h.wind_speed_10m").alias("wind_speed_10m"),
                    ).alias("hourly")
                )
            ).alias("payload"),
        )
    )
    return feeds.explode_hourly(documents)


SNAPSHOT_SIZE = 50


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot documents of 50 state vectors each: (snapshot, payload)."""
    text = [F.lit(None).cast("string")] * 14
    readings = {5: "lon", 6: "lat", 7: "alt_m", 8: "on_ground", 9: "vel_mps", 11: "vert_rate"}
    for place, name in readings.items():
        text[place] = F.col(name).cast("string")
    text[1] = F.when(F.col("event_id") % 13 == 0, F.lit("  ")).otherwise(F.concat("callsign", F.lit(" ")))
    vector = F.array(*text)
    vector = F.when(F.col("event_id") % 29 == 0, F.slice(vector, 1, 12)).otherwise(vector)
    return (
        view(spark, sf_dir, "state_vectors")
        .groupBy(F.floor(F.col("event_id") / SNAPSHOT_SIZE).alias("snapshot"))
        .agg(F.array_sort(F.collect_list(F.struct("event_id", vector.alias("v")))).alias("s"))
        .select("snapshot", F.to_json(F.struct(F.col("s.v").alias("states"))).alias("payload"))
    )


POSITIONS_SQL = """
    select event_id // 50 as snapshot, total,
      case when event_id%13=0 then 'UNK' else callsign end as callsign, lon, lat,
      coalesce(cast(round_even(alt_m*3.28084e0, 0) as bigint), 0) as altitude_ft,
      coalesce(cast(round_even(vel_mps*1.94384e0, 0) as bigint), 0) as velocity_kts,
      coalesce(cast(round_even(vert_rate*196.85e0, 0) as bigint), 0) as vertical_rate_fpm,
      on_ground, (not on_ground and coalesce(alt_m < 3048, false) and coalesce(vert_rate < -1, false)) as is_landing
    from (select *, count(*) over (partition by event_id // 50) as total,
            row_number() over (partition by event_id // 50 order by event_id) as place from state_vectors) t
    where event_id%29 <> 0 and lon is not null and lat is not null"""


@query("s4_parse_state_vectors", oracle(POSITIONS_SQL, "state_vectors"))
def parse_state_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.parse_state_vectors(snapshots(spark, sf_dir), keep=("snapshot",))


@query("l2_first_vectors", oracle(POSITIONS_SQL.replace("where event_id", "where place <= 40 and event_id"), "state_vectors"))
def first_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut as a feature of its own: the first 40 of the 50 vectors of a snapshot."""
    return feeds.parse_state_vectors(snapshots(spark, sf_dir), keep=("snapshot",), max_vectors=40)


@query(
    "s5_parse_airport_events",
    oracle(
        """select airport_id, payload->'$.groundStop'->>'$.reason' as stop_reason,
             payload->'$.groundDelay'->>'$.reason' as hold_reason,
             payload->'$.groundDelay'->>'$.avgDelay' as hold_delay,
             payload->'$.arrivalDelay'->>'$.reason' as arrival_reason, n
           from airport_events join (select DEST, count(*) as n from flights group by DEST) f on f.DEST = airport_id""",
        "airport_events",
        "flights",
    ),
)
def parse_airport_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = feeds.parse_airport_events(view(spark, sf_dir, "airport_events"))
    arrivals = flights(spark, sf_dir).groupBy(F.col("DEST").alias("airport_id")).agg(F.count(F.lit(1)).alias("n"))
    return events.join(arrivals, "airport_id").select(
        "airport_id",
        F.col("groundStop.reason").alias("stop_reason"),
        F.col("groundDelay.reason").alias("hold_reason"),
        F.col("groundDelay.avgDelay").alias("hold_delay"),
        F.col("arrivalDelay.reason").alias("arrival_reason"),
        "n",
    )


def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed documents of 20 flights each: a map from key to positional array."""
    ends = [F.expr(airport("user_id%20")), F.expr(airport("(user_id+1+event_id%19)%20"))]
    values = [
        F.lit('"hex"'), F.col("lat").cast("string"), F.col("lon").cast("string"), F.lit("270"),
        F.coalesce(F.col("alt_m").cast("bigint"), F.lit(0)).cast("string"), F.col("vel_mps").cast("bigint").cast("string"),
        F.lit('"sq"'), F.lit('"radar"'), F.lit('"B738"'), F.lit('"reg"'), F.lit("1700000000"),
        F.concat(F.lit('"'), ends[0], F.lit('"')),
        F.when(F.col("event_id") % 17 == 0, F.lit('"N/A"')).otherwise(F.concat(F.lit('"'), ends[1], F.lit('"'))),
        F.concat(F.lit('"dl'), F.col("user_id").cast("string"), F.lit('"')), F.lit("0"), F.lit("0"),
        F.concat(F.lit('" '), F.col("callsign"), F.lit('"')), F.lit("0"),
    ]
    full, short = F.array(*values), F.array(*values[:16])
    body = F.array_join(F.when(F.col("event_id") % 11 == 0, short).otherwise(full), ",", "null")
    entry = F.concat(F.lit('"k'), F.col("event_id").cast("string"), F.lit('":['), body, F.lit("]"))
    vectors = view(spark, sf_dir, "state_vectors").withColumn("user_id", F.substring("callsign", 4, 20).cast("bigint"))
    return (
        vectors.groupBy(F.floor(F.col("event_id") / 20).alias("document"))
        .agg(F.concat_ws(",", F.array_sort(F.collect_list(entry))).alias("body"))
        .select("document", F.concat(F.lit('{"full_count":20,"version":4,'), "body", F.lit("}")).alias("payload"))
    )


@query(
    "s6_parse_flight_feed",
    oracle(
        f"""select concat('k', cast(s.event_id as varchar)) as feed_key, lat as latitude, lon as longitude,
              cast(trunc(coalesce(alt_m, 0)) as bigint) as altitude, cast(vel_mps as bigint) as velocity,
              {airport('user_id%20')} as origin,
              case when s.event_id%17=0 then 'N/A' else {airport('(user_id+1+s.event_id%19)%20')} end as destination,
              concat('DL', cast(user_id as varchar)) as iata_flight, callsign
            from state_vectors s join events e on e.event_id = s.event_id where s.event_id%11 <> 0""",
        "state_vectors",
    ),
)
def parse_flight_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.parse_flight_feed(feed_documents(spark, sf_dir))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reports (station, valid, metar) of weather stations."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("K"), F.expr(airport("user_id%20"))).alias("station"),
        F.col("ts").alias("valid"),
        F.concat(F.lit("METAR "), F.col("event_id").cast("string"), F.lit(" "), F.col("event_type")).alias("metar"),
    )


REPORTS_SQL = f"""select concat('K', {airport('user_id%20')}) as station, ts as valid,
    concat('METAR ', cast(event_id as varchar), ' ', event_type) as metar from events"""


@query(
    "s7_first_report",
    oracle(
        """select station, cast(valid as date) as day, arg_min(metar, valid) as report
           from reports group by station, cast(valid as date)""",
        reports=REPORTS_SQL,
    ),
)
def first_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.first_report(reports(spark, sf_dir), "station", "valid", "metar")


@query(
    "s8_write_flights",
    oracle("select YEAR, MONTH, ORIGIN_AIRPORT, count(*) as n, sum(DEPARTURE_DELAY) as delay from normalised group by YEAR, MONTH, ORIGIN_AIRPORT", "normalised"),
)
def write_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "flights")
    tables.write_flights(normalise(flights(spark, sf_dir)), path)
    stored = tables.read_normalised(spark, path)
    return stored.groupBy("YEAR", "MONTH", "ORIGIN_AIRPORT").agg(
        F.count(F.lit(1)).alias("n"), F.sum("DEPARTURE_DELAY").alias("delay")
    )


@query(
    "s9_append_missing",
    oracle("select AIRPORT, YEAR, MONTH, DAY, HOUR, precipitation, wind_speed_10m from weather_hourly", "weather_hourly"),
)
def append_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "weather")
    columns = ["AIRPORT", "YEAR", "MONTH", "DAY", "HOUR", "precipitation", "wind_speed_10m"]
    weather = view(spark, sf_dir, "weather_hourly").select(*columns)
    # A first load stopped after the airports up to J; the second call adds the others only.
    tables.append_missing(weather.where(F.col("AIRPORT") < "J"), path, "AIRPORT")
    return tables.append_missing(weather, path, "AIRPORT").select(*columns)


@query(
    "s10_profile_table",
    oracle(
        """select coalesce(ORIGIN, '_GLOBAL_MEAN_') as airport, avg(DELAY_DUE_WEATHER) as mean_delay
           from flights where DELAY_DUE_WEATHER > 0 group by rollup(ORIGIN)""",
        "flights",
    ),
)
def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "profile")
    tables.save_table(weather_profile(flights(spark, sf_dir), "ORIGIN", "DELAY_DUE_WEATHER"), path)
    return tables.load_table(spark, path)


@query(
    "s12_to_message",
    oracle(
        """select '{"type":"STREAM_UPDATE","timestamp":"' || cast(FL_DATE as varchar) || '","updates":[{"flight_id":"'
             || AIRLINE || cast(FL_NUMBER as varchar) || '","route":"' || ORIGIN || ' -> ' || DEST
             || '","predicted_delay":' || cast(coalesce(DEP_DELAY, 0e0) as varchar) || ',"status":"'
             || case when DEP_DELAY > 15 then 'DELAYED' else 'ON TIME' end || '","metar":null}]}' as message
           from flights""",
        "flights",
    ),
)
def to_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = flights(spark, sf_dir).withColumn("DEP_DELAY", F.coalesce("DEP_DELAY", F.lit(0.0)))
    return scored.select(
        tables.to_message(
            F.concat("AIRLINE", F.col("FL_NUMBER").cast("string")),
            F.concat("ORIGIN", F.lit(" -> "), "DEST"),
            F.col("DEP_DELAY"),
            F.lit(None).cast("string"),
            F.date_format("FL_DATE", "yyyy-MM-dd"),
        ).alias("message")
    )


@query(
    "s13_dimensions",
    oracle(
        """select f.AIRLINE, f.ORIGIN, f.n, c.icao, cn.carrier_name, a.latitude, a.longitude, ci.city,
             cast(coalesce(len(h.hubs), 7) as int) as hub_count
           from (select AIRLINE, ORIGIN, count(*) as n from flights group by AIRLINE, ORIGIN) f
           left join dim_carrier c on c.iata = f.AIRLINE
           left join dim_carrier_name cn on cn.carrier = f.AIRLINE
           left join dim_airport a on a.code = f.ORIGIN
           left join dim_city ci on ci.code = f.ORIGIN
           left join dim_hub h on h.carrier = f.AIRLINE""",
        "flights", "dim_carrier", "dim_carrier_name", "dim_airport", "dim_city", "dim_hub",
    ),
)
def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = flights(spark, sf_dir).groupBy("AIRLINE", "ORIGIN").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.join(F.broadcast(dims.dim_carrier(spark)).withColumnRenamed("iata", "AIRLINE"), "AIRLINE", "left")
        .join(F.broadcast(dims.dim_carrier_name(spark)).withColumnRenamed("carrier", "AIRLINE"), "AIRLINE", "left")
        .join(F.broadcast(dims.dim_airport(spark)).withColumnRenamed("code", "ORIGIN"), "ORIGIN", "left")
        .join(F.broadcast(dims.dim_city(spark)).withColumnRenamed("code", "ORIGIN"), "ORIGIN", "left")
        .join(F.broadcast(dims.dim_hub(spark)).withColumnRenamed("carrier", "AIRLINE"), "AIRLINE", "left")
        .withColumn("hub_count", F.coalesce(F.size("hubs"), F.lit(7)))
        .drop("hubs")
    )
