"""Lookups of requests against histories, feeds and dimensions.

Every right side is reduced to one row per key before it is joined, so a request never
multiplies and a hot key never meets a hot key. Constant dimensions carry a broadcast hint;
for any other table the join is left to the planner, which broadcasts below its size
threshold and otherwise shuffles, splitting skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.clock import epoch_delay, epoch_hhmm, iso_hhmm
from tarmac.functions.text import clean_key
from tarmac.operators.ordering import first_by, one_per
from tarmac.sources import dimensions as dims
from tarmac.sources import fixed_values as fixed

HISTORY_ORDER = (
    "YEAR", "MONTH", "DAY", "SCHEDULED_DEPARTURE", "AIRLINE", "FLIGHT_NUMBER",
    "ORIGIN_AIRPORT", "DESTINATION_AIRPORT", "DEPARTURE_DELAY", "CANCELLED", "WEATHER_DELAY",
)
NORMALISED = (
    "YEAR", "MONTH", "DAY", "DAY_OF_WEEK", "AIRLINE", "FLIGHT_NUMBER", "ORIGIN_AIRPORT",
    "DESTINATION_AIRPORT", "SCHEDULED_DEPARTURE", "DEPARTURE_DELAY", "CANCELLED", "WEATHER_DELAY",
)


def lookup(
    df: DataFrame, table: DataFrame, key: str, table_key: str, value: str, out: str, default: Column | None = None
) -> DataFrame:
    """Left lookup of one value, with a default. `table` has one row per key."""
    side = table.select(F.col(table_key).alias(key), F.col(value).alias("_value"))
    found = F.col("_value") if default is None else F.coalesce(F.col("_value"), default)
    return df.join(side, key, "left").withColumn(out, found).drop("_value")


def known(df: DataFrame, table: DataFrame, key: str, table_key: str) -> DataFrame:
    """Rows whose key is in the table."""
    return df.join(table.select(F.col(table_key).alias(key)), key, "left_semi")


def pending(df: DataFrame, done: DataFrame, key: str, done_key: str) -> DataFrame:
    """Rows whose key is not in the table yet."""
    return df.join(done.select(F.col(done_key).alias(key)), key, "left_anti")


def all_airports(df: DataFrame, origin: str = "ORIGIN", destination: str = "DEST") -> DataFrame:
    """Distinct airports at either end."""
    ends = df.select(F.explode(F.array(origin, destination)).alias("airport"))
    return ends.where(F.col("airport").isNotNull()).distinct()


def resolve_airport(df: DataFrame, code: str, prefix: str, world: DataFrame | None = None) -> DataFrame:
    """Position of an airport code in any form; the middle of the country if unknown."""
    aliases = dims.airport_aliases(df.sparkSession, world)
    if world is None:
        aliases = F.broadcast(aliases)
    side = aliases.select(F.col("code").alias("_code"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    return (
        df.withColumn("_code", F.upper(F.trim(F.col(code))))
        .join(side, "_code", "left")
        .withColumns(
            {
                f"{prefix}latitude": F.coalesce("_lat", F.lit(fixed.UNKNOWN_LATITUDE)),
                f"{prefix}longitude": F.coalesce("_lon", F.lit(fixed.UNKNOWN_LONGITUDE)),
            }
        )
        .drop("_code", "_lat", "_lon")
    )


def parse_flight_query(df: DataFrame, query: str) -> DataFrame:
    """Number, carrier codes and both call signs of a typed flight such as `DL 123`."""
    carriers = dims.dim_carrier(df.sparkSession)
    by_icao = carriers.select(F.col("icao").alias("_p3"), F.col("iata").alias("_iata3"))
    by_iata = carriers.select(F.col("iata").alias("_p2"), F.col("icao").alias("_icao2"))
    text = F.upper(F.replace(F.trim(F.col(query)), F.lit(" "), F.lit("")))
    digits = F.regexp_extract("query_clean", r"([0-9]+)", 1)
    three = F.col("_iata3").isNotNull()
    two = F.col("_icao2").isNotNull()
    parsed = (
        df.withColumn("query_clean", text)
        .withColumns({"_p3": F.substring("query_clean", 1, 3), "_p2": F.substring("query_clean", 1, 2)})
        .join(F.broadcast(by_icao), "_p3", "left")
        .join(F.broadcast(by_iata), "_p2", "left")
        .withColumns(
            {
                "flight_number": F.when(digits != "", digits).otherwise(F.col("query_clean")),
                "carrier_iata": F.when(three, F.col("_iata3")).when(two, F.col("_p2")).otherwise(F.lit("DL")),
                "carrier_icao": F.when(three, F.col("_p3")).when(two, F.col("_icao2")).otherwise(F.lit("DAL")),
            }
        )
    )
    return parsed.withColumns(
        {
            "icao_callsign": F.concat("carrier_icao", "flight_number"),
            "iata_flight": F.concat("carrier_iata", "flight_number"),
        }
    ).drop("_p2", "_p3", "_iata3", "_icao2")


def keyed_history(history: DataFrame) -> DataFrame:
    """Normalised flights with cleaned lookup keys."""
    return history.withColumns(
        {
            "_airline": F.upper(F.trim("AIRLINE")),
            "_number": clean_key(F.col("FLIGHT_NUMBER")),
            "ORIGIN_AIRPORT": F.trim("ORIGIN_AIRPORT"),
            "DESTINATION_AIRPORT": F.trim("DESTINATION_AIRPORT"),
        }
    )


def lookup_flights(requests: DataFrame, history: DataFrame, query: str = "query") -> DataFrame:
    """A flight per request.

    `AIRLINE|NUMBER|YYYY-MM-DD` finds the first such flight, or else the first flight of the
    history. A request without such an id gets the first flight delayed by more than 30
    minutes, or else the first flight. "First" means in date, clock and key order.
    The flight's columns are added to the request; `matched` tells how it was found.
    """
    flights = keyed_history(history)
    order = list(HISTORY_ORDER)
    parts = F.split(F.upper(F.trim(F.col(query))), r"\|")
    date = F.split(F.get(parts, F.lit(2)), "-")
    # A date without three whole-number parts matches nothing, as a bad date does.
    ymd = [F.when(F.size(date) == 3, F.get(date, F.lit(i)).try_cast("int")) for i in range(3)]
    asked = requests.withColumns(
        {
            "_has_id": F.coalesce(F.col(query).contains("|"), F.lit(False)),
            "_airline": F.get(parts, F.lit(0)),
            "_number": F.trim(F.replace(F.get(parts, F.lit(1)), F.lit(".0"), F.lit(""))),
            "_y": ymd[0], "_m": ymd[1], "_d": ymd[2],
        }
    )
    keys = ["_airline", "_number", "_y", "_m", "_d"]
    dated = flights.withColumns({"_y": F.col("YEAR"), "_m": F.col("MONTH"), "_d": F.col("DAY")})
    wanted = asked.where("_has_id").select(*keys).distinct()
    # The least row of a key: the join has sorted the keys already, and nothing is sorted again.
    row = F.struct(*order, "DAY_OF_WEEK")
    least = dated.join(wanted, keys, "left_semi").groupBy(*keys).agg(F.min(row).alias("_row"))
    found = least.select(*keys, F.struct(*[F.col(f"_row.{c}").alias(c) for c in NORMALISED]).alias("_found"))

    # Both opening rows from one pass: the least row in HISTORY_ORDER, of all and of the late.
    opening = flights.agg(F.min(row).alias("first"), F.min(F.when(F.col("DEPARTURE_DELAY") > 30, row)).alias("late"))

    def opened(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.struct(*[F.col(f"{name}.{c}").alias(c) for c in NORMALISED]))

    # Put together once, beside the aggregate; a request's row only takes one or the other.
    opening = opening.select(F.struct(opened("first").alias("first"), F.coalesce(opened("late"), opened("first")).alias("late"))).scalar()
    first_row, first_late = opening.getField("first"), opening.getField("late")
    chosen = asked.join(found, keys, "left").withColumns(
        {
            "matched": F.when(~F.col("_has_id"), "none_asked").when(F.col("_found").isNull(), "first_row").otherwise("id"),
            "_flight": F.when(F.col("_has_id"), F.coalesce(F.col("_found"), first_row)).otherwise(first_late),
        }
    )
    return chosen.select(*requests.columns, "matched", *[F.col(f"_flight.{c}").alias(c) for c in NORMALISED])


def schedule_routes(history: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """First known origin and destination per carrier and flight number.

    With `wanted` (_airline, _number) only those flights are kept before anything is sorted.
    """
    flights = keyed_history(history)
    if wanted is not None:
        flights = flights.join(wanted, ["_airline", "_number"], "left_semi")
    firsts = flights.groupBy("_airline", "_number").agg(F.min(F.struct(*HISTORY_ORDER)).alias("_row"))
    route = F.struct(F.col("_row.ORIGIN_AIRPORT").alias("origin"), F.col("_row.DESTINATION_AIRPORT").alias("destination"))
    return firsts.select("_airline", "_number", route.alias("_schedule"))


def schedule_lookup(
    df: DataFrame, history: DataFrame, carrier: str = "carrier_iata", number: str = "flight_number"
) -> DataFrame:
    """Adds schedule_origin and schedule_destination; null where the history has no such flight."""
    asked = df.withColumns({"_airline": F.col(carrier), "_number": F.trim(F.replace(F.col(number), F.lit(".0"), F.lit("")))})
    routes = schedule_routes(history, asked.select("_airline", "_number").distinct())
    return (
        asked.join(routes, ["_airline", "_number"], "left")
        .withColumns({"schedule_origin": F.col("_schedule.origin"), "schedule_destination": F.col("_schedule.destination")})
        .drop("_airline", "_number", "_schedule")
    )


def _code(value: Column, *not_codes: str) -> Column:
    text = F.upper(F.trim(value))
    return F.when((text != "") & ~text.isin(*not_codes, ""), text)


def resolve_route(
    requests: DataFrame,
    search: DataFrame,
    feed: DataFrame,
    second: DataFrame,
    schedule: DataFrame,
    key: str = "iata_flight",
) -> DataFrame:
    """Route, scheduled clock and delay per request from four tiers; of a key's rows the newest counts.

    Tables (first column `key`): search (origin, destination, sched_epoch, real_epoch),
    feed (origin, destination, sched_epoch, real_epoch), second (origin, destination,
    scheduled, delay, status, departed, arrived), schedule (origin, destination).
    Ends are filled one by one; a later tier's delay overwrites an earlier one; the schedule
    replaces both ends when one is missing. Without any tier both ends stay null.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        one = one_per(df, [key], ("sched_epoch", "scheduled", "real_epoch"))
        return one.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))

    joined = requests
    for name, table in (("_s", search), ("_f", feed), ("_a", second), ("_t", schedule)):
        joined = joined.join(side(table, name), key, "left")

    def ends(end: str) -> Column:
        return F.coalesce(
            _code(F.col(f"_s.{end}")), _code(F.col(f"_f.{end}"), "N/A", "NONE"), _code(F.col(f"_a.{end}"), "N/A")
        )

    filled = joined.withColumns({"_o": ends("origin"), "_d": ends("destination")})
    missing = F.col("_o").isNull() | F.col("_d").isNull()
    delay = F.coalesce(
        F.col("_a.delay").cast("bigint"),
        epoch_delay(F.col("_f.sched_epoch"), F.col("_f.real_epoch")),
        epoch_delay(F.col("_s.sched_epoch"), F.col("_s.real_epoch")),
        F.lit(0).cast("bigint"),
    )
    under_way = F.col("_a.departed").isNotNull() & F.col("_a.arrived").isNull()
    return filled.withColumns(
        {
            "origin": F.when(missing, F.coalesce(F.col("_t.origin"), F.col("_o"))).otherwise(F.col("_o")),
            "destination": F.when(missing, F.coalesce(F.col("_t.destination"), F.col("_d"))).otherwise(F.col("_d")),
            "scheduled_departure": F.coalesce(
                iso_hhmm(F.col("_a.scheduled")), epoch_hhmm(F.col("_s.sched_epoch")), F.lit("LIVE")
            ),
            "accumulated_delay": delay,
            "active": F.coalesce((F.col("_a.status") == "active") | under_way, F.lit(False)),
        }
    ).drop("_s", "_f", "_a", "_t", "_o", "_d")


def hub_indices(call_sign: Column, hubs: Column) -> tuple[Column, Column]:
    """Two different positions in a hub list from the md5 of a call sign.

    The 128-bit hash is reduced modulo n * n in four 32-bit steps; the remainder's low and
    high digit to base n are the two positions.
    """
    count = F.size(hubs).cast("bigint")
    modulus = count * count
    words = F.transform(F.array(*[F.lit(s) for s in (1, 9, 17, 25)]), lambda start: F.conv(F.substring(F.md5(call_sign), start, F.lit(8)), 16, 10).cast("bigint"))
    rest = F.aggregate(words, F.lit(0).cast("bigint"), lambda r, part: (r * F.lit(4_294_967_296) + part) % modulus)
    first = rest % count
    second = F.floor(rest / count)
    second = F.when(first == second, (second + 1) % count).otherwise(second)
    return first.cast("int"), second.cast("int")


def hub_fallback(
    df: DataFrame, carrier: str = "carrier_iata", call_sign: str = "icao_callsign",
    origin: str = "origin", destination: str = "destination",
) -> DataFrame:
    """Rows lacking an end get two of their carrier's hubs, the same ones on every run."""
    hubs = dims.dim_hub(df.sparkSession)
    other = fixed.HUBS[-1][1]
    side = hubs.where(F.col("carrier") != "*").select(F.col("carrier").alias(carrier), "hubs")
    joined = df.join(F.broadcast(side), carrier, "left").withColumn(
        "hubs", F.coalesce("hubs", F.array(*[F.lit(h) for h in other]))
    )
    first, second = hub_indices(F.col(call_sign), F.col("hubs"))
    if origin not in df.columns:
        joined = joined.withColumns({origin: F.lit(None).cast("string"), destination: F.lit(None).cast("string")})
    missing = F.col(origin).isNull() | F.col(destination).isNull()
    return joined.withColumns(
        {
            origin: F.when(missing, F.get("hubs", first)).otherwise(F.col(origin)),
            destination: F.when(missing, F.get("hubs", second)).otherwise(F.col(destination)),
        }
    ).drop("hubs")


def match_position(
    requests: DataFrame,
    positions: DataFrame,
    order: Sequence[str],
    values: Sequence[str],
    exact: Sequence[str] = ("icao_callsign", "iata_flight", "query_clean"),
    prefix: str = "icao_callsign",
) -> DataFrame:
    """The first position whose call sign is one of the request's forms or starts with `prefix`.

    `positions` has `callsign`; `order` is its total order. A call sign is turned into its
    (at most a few) leading parts, the first position per part is kept, and requests look
    the parts up by equality, so no request is compared with every position of a carrier.
    """
    call_sign = F.upper(F.trim(F.col("callsign")))
    ordered = [F.col(c).alias(f"_order{i}") for i, c in enumerate(order)]
    row = F.struct(*ordered, call_sign.alias("callsign"), *values)
    named = positions.where(F.col("callsign").isNotNull() & (F.trim("callsign") != "")).select(
        call_sign.alias("_sign"), row.alias("_row")
    )
    whole = named.groupBy("_sign").agg(F.min("_row").alias("_row"))
    parts = (
        whole.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("_sign")), lambda n: F.substring(F.col("_sign"), F.lit(1), n))).alias("_part"), "_row")
        .groupBy("_part")
        .agg(F.min("_row").alias("_row"))
    )
    joined = requests.join(parts.select(F.col("_part").alias(prefix), F.col("_row").alias("_hit0")), prefix, "left")
    hits = ["_hit0"]
    for form in exact:
        if form == prefix:
            continue
        hits.append(f"_hit{len(hits)}")
        joined = joined.join(whole.select(F.col("_sign").alias(form), F.col("_row").alias(hits[-1])), form, "left")
    best = F.least(*hits) if len(hits) > 1 else F.col(hits[0])
    return (
        joined.withColumn("_best", best)
        .withColumns({f"live_{c}": F.col(f"_best.{c}") for c in ["callsign", *values]})
        .drop("_best", *hits)
    )


def join_events(df: DataFrame, events: DataFrame, airport: str = "destination") -> DataFrame:
    """The destination's programme document; null structs where there is none.

    Of an airport's documents the first counts, by a column `seq` if there is one.
    """
    order = [F.col("seq").asc_nulls_last()] if "seq" in events.columns else []
    one = first_by(events, ["airport_id"], [*order, F.xxhash64(*events.columns)])
    side = one.select(F.col("airport_id").alias("_airport"), F.struct("groundStop", "groundDelay", "arrivalDelay").alias("programme"))
    return df.withColumn("_airport", F.upper(F.col(airport))).join(side, "_airport", "left").drop("_airport")


def station(code: Column) -> Column:
    """Weather station of an airport: four letters as they are, else K in front."""
    text = F.upper(F.trim(code))
    return F.when(F.length(text) == 4, text).otherwise(F.concat(F.lit("K"), text))


def resolve_report(df: DataFrame, airport: str, tiers: Sequence[DataFrame], out: str) -> DataFrame:
    """Raw report per airport from the first tier that has one, else a routine text.

    A tier is a table (station, report); of a station's reports that say something the newest
    counts, by a column `valid` if there is one.
    """
    df = df.withColumn("_station", station(F.col(airport)))
    found = []
    for i, tier in enumerate(tiers):
        found.append(f"_report{i}")
        one = one_per(tier.where(F.trim("report") != ""), ["station"], ("valid",))
        df = df.join(one.select(F.col("station").alias("_station"), F.col("report").alias(found[-1])), "_station", "left")
    routine = F.concat("_station", F.lit(" " + fixed.ROUTINE_REPORT))
    filled = [F.when(F.trim(c) != "", F.col(c)) for c in found]
    return df.withColumn(out, F.coalesce(*filled, routine)).drop("_station", *found)


def resolve_day_report(
    df: DataFrame, airport: str, date: str, day_reports: DataFrame, tiers: Sequence[DataFrame], out: str
) -> DataFrame:
    """The station's first report of the flight's day, else as `resolve_report`.

    `day_reports` (station, day, report) has one row per station and day; `date` is a text.
    """
    day = one_per(day_reports, ["station", "day"]).select(
        F.col("station").alias("_of"), F.date_format("day", "yyyy-MM-dd").alias(date), F.col("report").alias("_day_report")
    )
    current = resolve_report(df, airport, tiers, out).withColumn("_of", station(F.col(airport)))
    return current.join(day, ["_of", date], "left").withColumn(out, F.coalesce("_day_report", out)).drop("_of", "_day_report")


def first_report(reports: DataFrame, station_column: str, valid: str, text: str) -> DataFrame:
    """Per station and day the earliest report. Columns: station, day, report.

    A minimum over (time, text): combined before the shuffle, whatever a station's share.
    """
    earliest = F.min(F.struct(F.col(valid).alias("valid"), F.col(text).alias("report")))
    return (
        reports.where(F.col(text).isNotNull())
        .groupBy(F.col(station_column).alias("station"), F.to_date(valid).alias("day"))
        .agg(earliest.alias("_r"))
        .select("station", "day", F.col("_r.report").alias("report"))
    )

