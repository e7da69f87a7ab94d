"""JSON documents of outside feeds, landed as rows of text, turned into typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.geo import is_landing_snapshot, si_to_aviation
from tarmac.sources.schemas import (
    AIRPORT_EVENT, CURRENT_DOCUMENT, DAILY_DOCUMENT, FLIGHT_TIMES, HOURLY_DOCUMENT, REPORT_DOCUMENT, ROUTE_LIST, ROUTE_SEARCH,
)

MIN_VECTOR_LENGTH = 13
MIN_FEED_LENGTH = 17


def _zip_arrays(document: str, names: tuple[str, ...]) -> Column:
    """Parallel arrays of a document as rows; an absent array counts as empty."""
    return F.inline(F.arrays_zip(*[F.coalesce(F.col(f"{document}.{n}"), F.array()).alias(n) for n in names]))


def explode_hourly(df: DataFrame, airport: str = "airport", payload: str = "payload") -> DataFrame:
    """One airport document of parallel hourly arrays per row -> one row per hour.

    Missing precipitation is 0 and missing wind 10.
    """
    hourly = df.select(F.col(airport).alias("AIRPORT"), F.from_json(payload, HOURLY_DOCUMENT)["hourly"].alias("h"))
    rows = hourly.select("AIRPORT", _zip_arrays("h", ("time", "precipitation", "wind_speed_10m")))
    time = F.col("time").try_cast("timestamp_ntz")
    return rows.where(F.col("time").isNotNull()).select(
        "AIRPORT",
        F.year(time).alias("YEAR"),
        F.month(time).alias("MONTH"),
        F.dayofmonth(time).alias("DAY"),
        F.hour(time).alias("HOUR"),
        F.coalesce("precipitation", F.lit(0.0)).alias("precipitation"),
        F.coalesce("wind_speed_10m", F.lit(10.0)).alias("wind_speed_10m"),
    )


def parse_current_weather(df: DataFrame, airport: str = "airport", payload: str = "payload") -> DataFrame:
    """Current readings per airport; an absent document gives the calm default readings."""
    calm = {"temperature_2m": 20.0, "precipitation": 0.0, "windspeed_10m": 8.0, "weather_code": 0.0}
    now = F.from_json(payload, CURRENT_DOCUMENT)["current"]
    read = df.select(F.col(airport).alias("airport"), now.alias("now"))
    return read.select(
        "airport", *[F.when(F.col("now").isNull(), F.lit(v)).otherwise(F.coalesce(f"now.{n}", F.lit(0.0))).alias(n) for n, v in calm.items()]
    )


def parse_daily_weather(df: DataFrame, airport: str = "airport", payload: str = "payload") -> DataFrame:
    """Daily documents (parallel arrays, one entry per day) -> one row per airport and day."""
    names = ("time", "weathercode", "temperature_2m_max", "precipitation_sum", "windspeed_10m_max")
    daily = df.select(F.col(airport).alias("airport"), F.from_json(payload, DAILY_DOCUMENT)["daily"].alias("d"))
    rows = daily.select("airport", _zip_arrays("d", names))
    return rows.select("airport", F.col("time").try_cast("date").alias("date"), *names[1:]).where(F.col("date").isNotNull())


def vectors_to_positions(vectors: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Positional arrays of text (`v`) to positions: units, landing flag, call sign UNK if blank.

    Vectors that are too short or have no position are dropped.
    """

    def number(position: int) -> Column:
        return F.get("v", F.lit(position)).try_cast("double")

    named = (
        vectors.where(F.size("v") >= MIN_VECTOR_LENGTH)
        .select(
            *keep,
            F.coalesce(F.trim(F.get("v", F.lit(1))), F.lit("")).alias("sign"),
            number(5).alias("lon"), number(6).alias("lat"), number(7).alias("alt_m"),
            F.get("v", F.lit(8)).try_cast("boolean").alias("ground"),
            number(9).alias("vel_mps"), number(11).alias("vert_rate"),
        )
        .where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    )
    return positions(named, keep, F.when(F.col("sign") != "", F.col("sign")).otherwise("UNK"), "ground")


def positions(named: DataFrame, keep: tuple[str, ...], sign: Column, ground: str) -> DataFrame:
    """Named readings (lon, lat, alt_m, vel_mps, vert_rate) in aviation units."""
    units = si_to_aviation(F.col("alt_m"), F.col("vel_mps"), F.col("vert_rate"))
    return named.select(
        *keep,
        sign.alias("callsign"),
        "lon",
        "lat",
        *[c.alias(n) for n, c in units.items()],
        F.coalesce(F.col(ground), F.lit(False)).alias("on_ground"),
        is_landing_snapshot(F.col(ground), F.col("alt_m"), F.col("vert_rate")).alias("is_landing"),
    )


def parse_state_vectors(
    df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = (), max_vectors: int | None = None
) -> DataFrame:
    """One snapshot document per row -> one row per aircraft; `total` is the size of the snapshot.

    With `max_vectors` only so many vectors are opened, counted before the validity filter.
    """
    states = F.from_json(payload, "states array<array<string>>")["states"]
    opened = df.select(*keep, states.alias("s")).where(F.col("s").isNotNull())
    wanted = F.col("s") if max_vectors is None else F.slice("s", 1, max_vectors)
    vectors = opened.select(*keep, F.size("s").cast("bigint").alias("total"), F.explode(wanted).alias("v"))
    return vectors_to_positions(vectors, (*keep, "total"))


def _programmes(document: Column, members: Column) -> list[Column]:
    """The three programmes of a document; one without any member counts as absent."""
    return [F.when(F.size(members[f.name]) > 0, document[f.name]).alias(f.name) for f in AIRPORT_EVENT]


_MEMBERS = ",".join(f"{f.name}:map<string,string>" for f in AIRPORT_EVENT)


def parse_airport_events(df: DataFrame, airport: str = "airport_id", payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """One programme document per airport and row -> its three optional programmes."""
    document, members = F.from_json(payload, AIRPORT_EVENT), F.from_json(payload, f"struct<{_MEMBERS}>")
    opened = df.select(F.col(airport).alias("airport_id"), *keep, document.alias("e"), members.alias("m"))
    return opened.select("airport_id", *keep, *_programmes(F.col("e"), F.col("m")))


def parse_airport_event_list(df: DataFrame, payload: str = "payload") -> DataFrame:
    """A document that lists all airports' programmes -> one row per listed airport."""
    fields = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in AIRPORT_EVENT)
    documents = F.from_json(payload, f"array<struct<airportId:string,{fields}>>")
    members = F.from_json(payload, f"array<struct<{_MEMBERS}>>")
    listed = df.select(F.posexplode(F.arrays_zip(documents.alias("e"), members.alias("m"))).alias("seq", "x"))
    return listed.select(F.col("x.e.airportId").alias("airport_id"), F.col("seq").cast("bigint").alias("seq"), *_programmes(F.col("x.e"), F.col("x.m")))


def parse_flight_feed(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """A map from feed key to positional array -> one row per flight.

    Counter entries, entries that are no arrays and short arrays are skipped.
    """
    entries = df.select(*keep, F.explode(F.from_json(payload, "map<string,string>")).alias("feed_key", "text"))
    arrays = (
        entries.where(~F.col("feed_key").isin("full_count", "version") & F.col("text").startswith("["))
        .withColumn("v", F.from_json("text", "array<string>"))
        .where(F.size("v") >= MIN_FEED_LENGTH)
    )

    def code(position: int) -> Column:
        return F.upper(F.trim(F.get("v", F.lit(position))))

    return arrays.select(
        *keep,
        "feed_key",
        F.get("v", F.lit(1)).try_cast("double").alias("latitude"),
        F.get("v", F.lit(2)).try_cast("double").alias("longitude"),
        F.get("v", F.lit(4)).try_cast("bigint").alias("altitude"),
        F.get("v", F.lit(5)).try_cast("bigint").alias("velocity"),
        code(11).alias("origin"),
        code(12).alias("destination"),
        code(13).alias("iata_flight"),
        code(16).alias("callsign"),
    )


def parse_reports(df: DataFrame, station: str = "station", payload: str = "payload") -> DataFrame:
    """A station's observation list per row -> its newest raw report; null if it has none."""
    observations = F.from_json(payload, REPORT_DOCUMENT)
    return df.select(F.col(station).alias("station"), F.get(observations, F.lit(0))["rawOb"].alias("report"))


def parse_route_search(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """A search answer per row -> ends of its first hit and the id of that flight's own document; nulls without a hit."""
    hits = F.from_json(payload, ROUTE_SEARCH)["results"]
    opened = df.select(key, F.get(hits, F.lit(0)).alias("hit"))
    return opened.select(
        key,
        F.upper("hit.detail.schd_from").alias("origin"),
        F.upper("hit.detail.schd_to").alias("destination"),
        F.col("hit.id").alias("detail_id"),
    )


def parse_flight_times(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """A flight's own document per row -> scheduled and real departure in seconds; null where absent."""
    times = F.from_json(payload, FLIGHT_TIMES)["time"]
    opened = df.select(key, times.alias("t"))
    return opened.select(key, F.col("t.scheduled.departure").alias("sched_epoch"), F.col("t.real.departure").alias("real_epoch"))


def with_times(rows: DataFrame, times: DataFrame, key: str) -> DataFrame:
    """Route rows with the departure times of the flight document that they name in `key`; of several the greatest."""
    one = times.groupBy(key).agg(F.max(F.struct("sched_epoch", "real_epoch")).alias("_times"))
    return rows.join(one, key, "left").select(*rows.columns, "_times.sched_epoch", "_times.real_epoch")


def parse_route_list(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """A provider's list of flights per row -> the first that is under way, else the first.

    Columns as the second route tier has them. An answer that lists nothing, such as an error,
    gives nulls; a delay that is no number counts as absent.
    """
    flights = F.from_json(payload, ROUTE_LIST)["data"]
    under_way = F.filter(flights, lambda f: f["flight_status"] == "active")
    chosen = F.coalesce(F.get(under_way, F.lit(0)), F.get(flights, F.lit(0)))
    opened = df.select(key, chosen.alias("f"))
    return opened.select(
        key,
        F.col("f.departure.iata").alias("origin"),
        F.col("f.arrival.iata").alias("destination"),
        F.col("f.departure.scheduled").alias("scheduled"),
        F.col("f.departure.delay").alias("delay"),
        F.col("f.flight_status").alias("status"),
        F.col("f.departure.actual").alias("departed"),
        F.col("f.arrival.actual").alias("arrived"),
    )
