"""Queries over scalar rules and decision rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions import clock, geo, text
from tarmac.operators import lookups, rules, weather
from tarmac.operators.aggregates import weather_profile
from tarmac.plans.registry import query
from tarmac.plans.views import airport, flights, oracle, table, view
from tarmac.sources import fixed_values as fixed
from tarmac.sources import feeds

DISTANCE = "2*3440.065e0*atan2(sqrt(h), sqrt(1-h))"
CHORD = """pow(sin(radians({b}-{a})/2), 2) + cos(radians({a}))*cos(radians({b}))*pow(sin(radians({d}-{c})/2), 2)"""


@query(
    "x1_haversine_nmi",
    oracle(
        f"""select ORIGIN, DEST, n, round({DISTANCE}, 6) as distance_nmi from (
              select f.*, {CHORD.format(a='o.latitude', b='d.latitude', c='o.longitude', d='d.longitude')} as h
              from (select ORIGIN, DEST, count(*) as n from flights group by ORIGIN, DEST) f
              join dim_airport o on o.code = ORIGIN join dim_airport d on d.code = DEST) t""",
        "flights",
        "dim_airport",
    ),
)
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = flights(spark, sf_dir).groupBy("ORIGIN", "DEST").agg(F.count(F.lit(1)).alias("n"))
    placed = lookups.resolve_airport(lookups.resolve_airport(routes, "ORIGIN", "o_"), "DEST", "d_")
    distance = geo.haversine_nmi(F.col("o_latitude"), F.col("o_longitude"), F.col("d_latitude"), F.col("d_longitude"))
    return placed.select("ORIGIN", "DEST", "n", F.round(distance, 6).alias("distance_nmi"))


@query(
    "x2_si_to_aviation",
    oracle(
        """select event_id, coalesce(cast(round_even(alt_m*3.28084e0, 0) as bigint), 0) as altitude_ft,
             coalesce(cast(round_even(vel_mps*1.94384e0, 0) as bigint), 0) as velocity_kts,
             coalesce(cast(round_even(vert_rate*196.85e0, 0) as bigint), 0) as vertical_rate_fpm from state_vectors""",
        "state_vectors",
    ),
)
def si_to_aviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = geo.si_to_aviation(F.col("alt_m"), F.col("vel_mps"), F.col("vert_rate"))
    return view(spark, sf_dir, "state_vectors").select("event_id", *[c.alias(n) for n, c in units.items()])


@query(
    "x3_is_landing_snapshot",
    oracle(
        "select event_id, (not on_ground and alt_m is not null and alt_m < 3048 and vert_rate < -1) as landing from state_vectors",
        "state_vectors",
    ),
)
def is_landing_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = geo.is_landing_snapshot(F.col("on_ground"), F.col("alt_m"), F.col("vert_rate"))
    return view(spark, sf_dir, "state_vectors").select("event_id", landing.alias("landing"))


APPROACH = {
    "placed": f"""select event_id, event_id%2 = 0 as active, lat, lon, cast(round_even(alt_m*3.28084e0, 0) as bigint) as alt,
        cast(round_even(vel_mps*1.94384e0, 0) as bigint) as spd, {airport('event_id%20')} as origin, {airport('(event_id*7+3)%20')} as destination
      from state_vectors""",
    "filled": """select p.*, o.latitude as o_lat, o.longitude as o_lon, d.latitude as d_lat, d.longitude as d_lon,
        lat is not null and lon is not null as known,
        case when lat is not null and lon is not null then lat when active then (o.latitude+d.latitude)/2 else o.latitude end as latitude,
        case when lat is not null and lon is not null then lon when active then (o.longitude+d.longitude)/2 else o.longitude end as longitude,
        case when (lat is null or lon is null) and active then 35000 else coalesce(alt, 0) end as altitude,
        case when (lat is null or lon is null) and active then 450 else coalesce(spd, 0) end as velocity
      from placed p join dim_airport o on o.code = origin join dim_airport d on d.code = destination""",
    "measured": f"""select *, {DISTANCE} as dist from (select *, {CHORD.format(a='latitude', b='d_lat', c='longitude', d='d_lon')} as h from filled) t""",
    "phased": """select *, (altitude < 10000 and dist < 50 and velocity > 30) as landing,
        case when velocity > 50 then cast(round_even(dist/velocity*60, 0) as bigint) else 15 end as eta from measured""",
}


def approaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every position with a made-up route, the position to show and its distance."""
    units = geo.si_to_aviation(F.col("alt_m"), F.col("vel_mps"), F.col("vert_rate"))
    placed = view(spark, sf_dir, "state_vectors").select(
        "event_id", (F.col("event_id") % 2 == 0).alias("active"), "lat", "lon",
        units["altitude_ft"].alias("alt"), units["velocity_kts"].alias("spd"),
        F.expr(airport("event_id%20")).alias("origin"), F.expr(airport("(event_id*7+3)%20")).alias("destination"),
    )
    placed = lookups.resolve_airport(lookups.resolve_airport(placed, "origin", "o_"), "destination", "d_")
    live = {"latitude": F.col("lat"), "longitude": F.col("lon"), "altitude": F.col("alt"), "velocity": F.col("spd")}
    ends = [{a: F.col(f"{e}_{a}") for a in ("latitude", "longitude")} for e in ("o", "d")]
    filled = placed.withColumns(geo.fill_position(live, F.col("active"), *ends))
    distance = geo.haversine_nmi(F.col("latitude"), F.col("longitude"), F.col("d_latitude"), F.col("d_longitude"))
    return filled.withColumn("dist", distance)


@query(
    "x4_is_landing_route",
    oracle("select event_id, landing from phased", "state_vectors", "dim_airport", **APPROACH),
)
def is_landing_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = geo.is_landing_route(F.col("altitude"), F.col("dist"), F.col("velocity"))
    return approaches(spark, sf_dir).select("event_id", landing.alias("landing"))


@query("x5_eta_minutes", oracle("select event_id, eta from phased", "state_vectors", "dim_airport", **APPROACH))
def eta_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approaches(spark, sf_dir).select("event_id", geo.eta_minutes(F.col("dist"), F.col("velocity")).alias("eta"))


@query(
    "x6_flight_status",
    oracle(
        """select event_id, case when landing then 'Live - Landing Approach (' || cast(eta as varchar) || 'm to touchdown)'
             when velocity > 50 then 'Live Airborne Radar (' || cast(cast(round_even(dist, 0) as bigint) as varchar) || ' nmi to dest)'
             else (case when known then 'Live Tracking' when active then 'Live Airborne Radar' else 'Scheduled' end)
               || ' (Route: ' || origin || ' -> ' || destination || ')' end as status from phased""",
        "state_vectors", "dim_airport", **APPROACH,
    ),
)
def flight_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    speed, distance = F.col("velocity"), F.col("dist")
    status = geo.flight_status(
        geo.is_landing_route(F.col("altitude"), distance, speed), geo.eta_minutes(distance, speed), speed, distance,
        F.col("base_status"), F.col("origin"), F.col("destination"),
    )
    return approaches(spark, sf_dir).select("event_id", status.alias("status"))


@query(
    "x7_fill_position",
    oracle(
        "select event_id, latitude, longitude, cast(altitude as bigint) as altitude, cast(velocity as bigint) as velocity from filled",
        "state_vectors", "dim_airport", placed=APPROACH["placed"], filled=APPROACH["filled"],
    ),
)
def fill_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approaches(spark, sf_dir).select("event_id", "latitude", "longitude", "altitude", "velocity")


@query(
    "x8_epoch_delay",
    """select o_orderkey, case when o_orderkey%13 <> 0 and trunc((o_custkey-700)*7/60) > 0 then cast(trunc((o_custkey-700)*7/60) as bigint) end as delay,
         strftime(o_orderdate + to_seconds(o_orderkey*61), '%H%M') as hhmm from orders""",
)
def epoch_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 61
    actual = F.when(F.col("o_orderkey") % 13 != 0, planned + (F.col("o_custkey") - 700) * 7)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", clock.epoch_delay(planned, actual).alias("delay"), clock.epoch_hhmm(planned).alias("hhmm")
    )


@query(
    "x9_iso_hhmm",
    "select event_id, case when event_id%9 = 0 then null else strftime(ts, '%H%M') end as hhmm from events",
)
def iso_hhmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.when(F.col("event_id") % 9 == 0, F.lit("unknown")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    return table(spark, sf_dir, "events").select("event_id", clock.iso_hhmm(written).alias("hhmm"))


@query(
    "x10_first_int",
    """select event_id, cast(case event_id%4 when 0 then trunc(value) when 1 then event_id%300 when 2 then 1 else 45 end as bigint) as minutes,
         cast(case event_id%4 when 0 then trunc(value) when 1 then event_id%300 when 2 then 60 + event_id%60 else 45 end as bigint) as duration from events""",
)
def first_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("event_id").cast("string")
    kind = F.col("event_id") % 4
    written = (
        F.when(kind == 0, F.col("value").cast("string"))
        .when(kind == 1, F.concat((F.col("event_id") % 300).cast("string"), F.lit(" minutes")))
        .when(kind == 2, F.concat(F.lit("1 hours "), (F.col("event_id") % 60).cast("string"), F.lit(" minutes")))
        .when(number.endswith("3"), F.lit("unknown"))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", text.first_int(written).alias("minutes"), text.duration_minutes(written).alias("duration")
    )


@query(
    "x11_parse_response",
    """select event_id, case event_id%6 when 0 then null when 5 then null when 1 then 'Unknown' else event_type end as primary_cause,
         case event_id%6 when 0 then null when 5 then null when 2 then 'None' else 'user ' || cast(user_id as varchar) end as secondary_cause,
         case event_id%6 when 0 then null when 5 then null when 1 then 'find ' || event_type when 2 then event_type else 'find ' || event_type end as search_query,
         case when event_id%6 in (0, 5) or user_id%2 = 1 then null when event_id%6 = 3 then 'HOLD' when event_id%6 = 4 then 'DIVERT' else 'PROCEED NORMALLY' end as action
       from events""",
)
def parse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 6

    def member(when, key: str, value):
        return F.when(when, F.struct(F.lit(key).alias("key"), value.alias("value")))

    members = F.map_from_entries(
        F.filter(
            F.array(
                member(kind != 1, "primary_cause", F.col("event_type")),
                member(kind != 2, "secondary_cause", F.concat(F.lit("user "), F.col("user_id").cast("string"))),
                member(kind != 2, "search_query", F.concat(F.lit("find "), F.col("event_type"))),
                member(kind == 3, "Action", F.lit("HOLD")),
                member(kind == 4, "action", F.lit("DIVERT")),
            ),
            lambda entry: entry.isNotNull(),
        )
    )
    reply = (
        F.when(kind == 0, F.lit("I cannot tell."))
        .when(kind == 5, F.lit('{"primary_cause": "cut off'))
        .when(F.col("user_id") % 2 == 0, F.to_json(members))
        .otherwise(F.concat(F.lit("Here you are:\n```json\n"), F.to_json(members), F.lit("\n```")))
    )
    cause = text.cause_reply(F.col("reply"))
    action = text.action_reply(F.col("reply"), fixed.DEFAULT_ACTION, fixed.DEFAULT_REASONING)
    return (
        table(spark, sf_dir, "events")
        .select("event_id", reply.alias("reply"))
        .select("event_id", cause.alias("c"), action.alias("a"))
        .select("event_id", "c.primary_cause", "c.secondary_cause", "c.search_query", "a.action")
    )


RISK = """case when {p} > 20 or {w} > 40 or {c} >= 61 then 'High' when {p} > 5 or {w} > 25 or {c} >= 51 then 'Moderate' else 'Low' end"""


def risk_sql(code: str, wind: str, precipitation: str) -> str:
    return RISK.format(c=f"coalesce({code}, 0)", w=f"coalesce({wind}, 0)", p=f"coalesce({precipitation}, 0)")


@query(
    "d1_weather_risk",
    oracle(f"select AIRPORT, YEAR, MONTH, DAY, HOUR, {risk_sql('weathercode', 'wind_speed_10m', 'precipitation')} as risk from weather_hourly", "weather_hourly"),
)
def weather_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = weather.weather_risk(F.col("weathercode"), F.col("wind_speed_10m"), F.col("precipitation"))
    return view(spark, sf_dir, "weather_hourly").select("AIRPORT", "YEAR", "MONTH", "DAY", "HOUR", risk.alias("risk"))


TODAY = "2024-01-20"
WEATHER_STEPS = {
    "day_weather": """select AIRPORT as airport, make_date(YEAR, MONTH, DAY) as date, cast(max(weathercode) as double) as weathercode,
        0e0 as temperature_2m_max, sum(precipitation) as precipitation_sum, max(wind_speed_10m) as windspeed_10m_max
      from weather_hourly group by all""",
    "now_weather": f"""select AIRPORT as airport, cast(arg_max(weathercode, HOUR) as double) as weather_code, 10e0 as temperature_2m,
        arg_max(precipitation, HOUR) as precipitation, arg_max(wind_speed_10m, HOUR) as windspeed_10m
      from weather_hourly where make_date(YEAR, MONTH, DAY) = date '{TODAY}' group by all""",
}


def day_and_now(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(current, daily) weather tables from the hourly one; the newest hour of `TODAY` is now."""
    hourly = view(spark, sf_dir, "weather_hourly")
    day = weather.daily_weather(hourly).withColumnRenamed("AIRPORT", "airport")
    newest = hourly.where(F.make_date("YEAR", "MONTH", "DAY") == F.lit(TODAY).cast("date"))
    now = newest.groupBy(F.col("AIRPORT").alias("airport")).agg(
        F.max_by(F.col("weathercode").cast("double"), "HOUR").alias("weather_code"),
        F.max(F.lit(10.0)).alias("temperature_2m"),
        F.max_by("precipitation", "HOUR").alias("precipitation"),
        F.max_by("wind_speed_10m", "HOUR").alias("windspeed_10m"),
    )
    return now, day


PICK_SQL = """select o as origin, d as timestamp, n,
    coalesce(case when live then nw.weather_code else dw.weathercode end, 0) as o_code,
    coalesce(case when live and nw.airport is null then 20e0 when live then nw.temperature_2m else dw.temperature_2m_max end, 0) as o_temperature,
    coalesce(case when live and nw.airport is null then 8e0 when live then nw.windspeed_10m else dw.windspeed_10m_max end, 0) as o_wind,
    coalesce(case when live then nw.precipitation else dw.precipitation_sum end, 0) as o_precipitation
  from (select *, d = '2024-01-20' or d = '' as live from (
      select case when FL_NUMBER%97=0 then 'XXX' else ORIGIN end as o, case when FL_NUMBER%40=0 then '' else strftime(FL_DATE, '%Y-%m-%d') end as d, count(*) as n from flights group by all) a) f
  left join now_weather nw on nw.airport = o left join day_weather dw on dw.airport = o and strftime(dw.date, '%Y-%m-%d') = d"""


@query("d2_pick_weather", oracle(PICK_SQL, "flights", "weather_hourly", **WEATHER_STEPS))
def pick_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("FL_NUMBER") % 40 == 0, "").otherwise(F.date_format("FL_DATE", "yyyy-MM-dd"))
    origin = F.when(F.col("FL_NUMBER") % 97 == 0, "XXX").otherwise(F.col("ORIGIN"))  # an airport without weather
    asked = flights(spark, sf_dir).groupBy(origin.alias("origin"), day.alias("timestamp")).agg(F.count(F.lit(1)).alias("n"))
    return weather.pick_weather(asked, *day_and_now(spark, sf_dir), TODAY, "origin", "timestamp", "o")


@query(
    "d3_baseline",
    oracle("select DEP_DELAY, cast(greatest(0, trunc(DEP_DELAY*1.37e0)) as bigint) as baseline, count(*) as n from flights where DEP_DELAY is not null group by DEP_DELAY", "flights"),
)
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flights(spark, sf_dir).where(F.col("DEP_DELAY").isNotNull()).groupBy("DEP_DELAY").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("DEP_DELAY", rules.baseline(F.col("DEP_DELAY") * 1.37).alias("baseline"), "n")


# Flights with a made-up weather risk per end and a prediction, the input of the rules below.
RISKY = """
    select FL_DATE, AIRLINE, FL_NUMBER, case when FL_NUMBER%97=0 then 'XXX' else ORIGIN end as origin, DEST as destination, DEP_DELAY as prediction,
      cast(greatest(0, trunc(coalesce(DEP_DELAY, 0))) as bigint) as baseline,
      case FL_NUMBER%5 when 0 then 'High' when 1 then 'Moderate' else 'Low' end as origin_risk,
      case CRS_DEP_TIME%7 when 0 then 'High' when 1 then 'Moderate' else 'Low' end as dest_risk,
      case when FL_NUMBER%11 = 0 then 'Live - About to Land (4m)' else 'Scheduled' end as status,
      FL_NUMBER%6 = 0 as active
    from flights"""


def risky(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flights(spark, sf_dir)
    return rows.select(
        "FL_DATE", "AIRLINE", "FL_NUMBER", F.expr("case when FL_NUMBER%97=0 then 'XXX' else ORIGIN end").alias("origin"), F.col("DEST").alias("destination"),
        F.col("DEP_DELAY").alias("prediction"), rules.baseline(F.coalesce("DEP_DELAY", F.lit(0.0))).alias("baseline"),
        F.expr("case FL_NUMBER%5 when 0 then 'High' when 1 then 'Moderate' else 'Low' end").alias("origin_risk"),
        F.expr("case CRS_DEP_TIME%7 when 0 then 'High' when 1 then 'Moderate' else 'Low' end").alias("dest_risk"),
        F.expr("case when FL_NUMBER%11 = 0 then 'Live - About to Land (4m)' else 'Scheduled' end").alias("status"),
        (F.col("FL_NUMBER") % 6 == 0).alias("active"),
    )


PROFILE = """select * from (select ORIGIN as airport, case when ORIGIN = 'BOS' then 0e0 else avg(DELAY_DUE_WEATHER) end as mean_delay
      from flights where DELAY_DUE_WEATHER > 0 group by ORIGIN)
    union all select '_GLOBAL_MEAN_', avg(DELAY_DUE_WEATHER) from flights where DELAY_DUE_WEATHER > 0"""
FUSED = """
    select FL_DATE, AIRLINE, FL_NUMBER, origin, destination, origin_risk, dest_risk, status, baseline,
      greatest(baseline, cast(trunc(greatest(
        case dest_risk when 'High' then greatest(pd, 60e0) when 'Moderate' then greatest(pd*0.5e0, 30e0) else 0e0 end,
        case origin_risk when 'High' then greatest(po, 60e0) when 'Moderate' then greatest(po*0.5e0, 30e0) else 0e0 end)) as bigint)) as delay
    from (select r.*, coalesce(nullif(o.mean_delay, 0), g.mean_delay) as po, coalesce(nullif(d.mean_delay, 0), g.mean_delay) as pd
      from risky r left join profile o on o.airport = r.origin left join profile d on d.airport = r.destination,
      (select mean_delay from profile where airport = '_GLOBAL_MEAN_') g) t"""


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = weather_profile(flights(spark, sf_dir), "ORIGIN", "DELAY_DUE_WEATHER")
    return table.withColumn("mean_delay", F.when(F.col("airport") == "BOS", 0.0).otherwise(F.col("mean_delay")))


@query(
    "d4_fuse_weather",
    oracle("select FL_DATE, AIRLINE, FL_NUMBER, origin_risk, dest_risk, baseline, delay from fused", "flights", risky=RISKY, profile=PROFILE, fused=FUSED),
)
def fuse_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = rules.fuse_weather(risky(spark, sf_dir), profile(spark, sf_dir), "baseline", "delay")
    return fused.select("FL_DATE", "AIRLINE", "FL_NUMBER", "origin_risk", "dest_risk", "baseline", "delay")


@query(
    "d5_landing_override",
    oracle(
        """select FL_NUMBER, dest_risk, baseline, case when contains(status, 'About to Land') and dest_risk = 'High' then greatest(baseline, 25) else baseline end as delay,
             case when contains(status, 'About to Land') then 0.94e0 else 0.85e0 end as confidence from risky""",
        "flights",
        risky=RISKY,
    ),
)
def landing_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    delay, sure = rules.landing_override(F.col("baseline"), F.col("status"), F.col("dest_risk"), F.lit(0.85))
    return risky(spark, sf_dir).select("FL_NUMBER", "dest_risk", "baseline", delay.alias("delay"), sure.alias("confidence"))


@query(
    "d6_heuristic_delay",
    oracle(
        """select origin_risk, dest_risk, cast(max(case when 'High' in (origin_risk, dest_risk) then 90 when 'Moderate' in (origin_risk, dest_risk) then 30 else 0 end) as bigint) as delay,
             max(case when 'High' in (origin_risk, dest_risk) then 0.70e0 when 'Moderate' in (origin_risk, dest_risk) then 0.60e0 else 0.80e0 end) as confidence, count(*) as n
           from risky group by origin_risk, dest_risk""",
        "flights",
        risky=RISKY,
    ),
)
def heuristic_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    delay, sure = rules.heuristic_delay(F.col("origin_risk"), F.col("dest_risk"))
    return risky(spark, sf_dir).groupBy("origin_risk", "dest_risk").agg(
        F.max(delay).alias("delay"), F.max(sure).alias("confidence"), F.count(F.lit(1)).alias("n")
    )


@query(
    "d7_confidence",
    oracle(
        """select FL_DATE, FL_NUMBER, origin_risk, dest_risk, baseline + FL_NUMBER%4 as delay, round(least(0.95e0, greatest(0.50e0,
             0.85e0 - case when AIRLINE in ('DL','AA','UA','WN','B6') then 0e0 else 0.05e0 end - case when origin < 'M' then 0e0 else 0.05e0 end
             - case when destination < 'M' then 0e0 else 0.05e0 end
             + case when 'High' in (origin_risk, dest_risk) then -0.15e0 when origin_risk = 'Low' and dest_risk = 'Low' then 0.05e0 else 0e0 end)), 6) as confidence
           from risky""",
        "flights",
        risky=RISKY,
    ),
)
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = [F.col("AIRLINE").isin("DL", "AA", "UA", "WN", "B6"), F.col("origin") < "M", F.col("destination") < "M"]
    score = rules.clamp_confidence(rules.confidence(*seen, F.col("origin_risk"), F.col("dest_risk")))
    delay = rules.add_accumulated(F.col("baseline"), F.col("FL_NUMBER") % 4)
    return risky(spark, sf_dir).select("FL_DATE", "FL_NUMBER", "origin_risk", "dest_risk", delay.alias("delay"), F.round(score, 6).alias("confidence"))


LOW = "(origin_risk = 'Low' and dest_risk = 'Low')"


def _quoted(text_value: str) -> str:
    return "'" + text_value.replace("'", "''") + "'"


@query(
    "d8_root_cause",
    oracle(
        f"""select FL_NUMBER, baseline, origin_risk, dest_risk,
              case when baseline < 15 and {LOW} then 'None' when FL_NUMBER%3 = 0 then 'Crew rest' when {LOW} and baseline > 15 then 'Inherited Ground Delay' else 'Weather/Congestion' end as primary_cause,
              case when baseline < 15 and {LOW} then 'Routine Operations' when FL_NUMBER%3 = 0 then 'None' else 'Unknown' end as secondary_cause,
              case when baseline < 15 and {LOW} then {_quoted(fixed.CITATION_ROUTINE)} when FL_NUMBER%3 = 0 then null
                when {LOW} and baseline > 15 then {_quoted(fixed.CITATION_INHERITED)} else {_quoted(fixed.CITATION_NO_CORPUS)} end as citation
            from risky""",
        "flights",
        risky=RISKY,
    ),
)
def root_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = text.cause_reply(F.when(F.col("FL_NUMBER") % 3 == 0, F.lit('{"primary_cause":"Crew rest"}')))
    cause = rules.root_cause(F.col("baseline"), F.col("origin_risk"), F.col("dest_risk"), reply)
    return risky(spark, sf_dir).select("FL_NUMBER", "baseline", "origin_risk", "dest_risk", cause.alias("c")).select(
        "FL_NUMBER", "baseline", "origin_risk", "dest_risk", "c.primary_cause", "c.secondary_cause", "c.citation"
    )


PROGRAMME_SQL = f"""
    select destination, active_notam, notam_type, message, cast(penalty as bigint) as delay_penalty_minutes, n from (
      select DEST as destination, count(*) as n, any_value(payload) as p from flights left join (select * from airport_events qualify row_number() over (partition by airport_id order by seq) = 1) e on airport_id = DEST group by DEST) f,
      lateral (select coalesce(nullif(p->'$.groundStop', '{{}}'), nullif(p->'$.groundDelay', '{{}}'), nullif(p->'$.arrivalDelay', '{{}}')) is not null as active_notam,
        case when nullif(p->'$.groundStop', '{{}}') is not null then 'FAA GROUND STOP' when nullif(p->'$.groundDelay', '{{}}') is not null then 'GROUND DELAY PROGRAM'
          when nullif(p->'$.arrivalDelay', '{{}}') is not null then 'ATC ARRIVAL DELAY' else 'None' end as notam_type,
        case when nullif(p->'$.groundStop', '{{}}') is not null then 'ATC GROUND STOP IN EFFECT: ' || ((p->'$.groundStop')->>'$.reason') || '. All inbound flights held at origin.'
          when nullif(p->'$.groundDelay', '{{}}') is not null then 'FAA GDP IN EFFECT: ' || ((p->'$.groundDelay')->>'$.reason') || '. Arrival capacity reduced.'
          when nullif(p->'$.arrivalDelay', '{{}}') is not null then 'FAA METERING DELAY: ' || ((p->'$.arrivalDelay')->>'$.reason') || '.' else {_quoted(fixed.NO_PROGRAMME_MESSAGE)} end as message,
        case when nullif(p->'$.groundStop', '{{}}') is not null then 120 when nullif(p->'$.groundDelay', '{{}}') is not null then 1 when nullif(p->'$.arrivalDelay', '{{}}') is not null then 30 else 0 end as penalty) x"""


@query("d9_atc_constraint", oracle(PROGRAMME_SQL, "flights", "airport_events"))
def atc_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = feeds.parse_airport_events(view(spark, sf_dir, "airport_events"), keep=("seq",))
    arrivals = flights(spark, sf_dir).groupBy(F.col("DEST").alias("destination")).agg(F.count(F.lit(1)).alias("n"))
    joined = lookups.join_events(arrivals, events)
    return joined.select("destination", "n", rules.atc_constraint(F.col("programme")).alias("p")).select("destination", "n", "p.*")


@query(
    "d10_recommend",
    oracle(
        f"""select FL_NUMBER, baseline, origin_risk, dest_risk, active, action, reasoning from risky
            join dim_recommendation on situation = case when active then 'programme' when baseline > 15 and {LOW} then 'inherited' when baseline > 15 then 'at_risk' else 'routine' end""",
        "flights",
        "dim_recommendation",
        risky=RISKY,
    ),
)
def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    advised = rules.recommend(risky(spark, sf_dir), F.col("active"), F.col("baseline"), F.col("origin_risk"), F.col("dest_risk"))
    return advised.select("FL_NUMBER", "baseline", "origin_risk", "dest_risk", "active", "recommendation.action", "recommendation.reasoning")


@query(
    "d11_boost_confidence",
    oracle("select active, status, max(case when active then 0.95e0 else 0.8e0 end) as confidence, count(*) as n from risky group by active, status", "flights", risky=RISKY),
)
def boost_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = rules.boost_confidence(F.lit(0.8), F.col("active"))
    return risky(spark, sf_dir).groupBy("active", "status").agg(F.max(sure).alias("confidence"), F.count(F.lit(1)).alias("n"))


@query(
    "d12_kpi_bands",
    oracle(
        """select FL_NUMBER, baseline, case when baseline > 15 then 'DELAYED' else 'ON TIME' end as display_status,
             cast(case when FL_NUMBER%100/100e0 >= 0.9e0 then 5 else 15 end as int) as band_minutes, cast(FL_NUMBER%100 as bigint) as confidence_pct from risky""",
        "flights",
        risky=RISKY,
    ),
)
def kpi_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = rules.kpi_bands(F.col("baseline"), (F.col("FL_NUMBER") % 100) / F.lit(100.0))
    return risky(spark, sf_dir).select("FL_NUMBER", "baseline", *[c.alias(n) for n, c in bands.items()])


@query(
    "d13_default_event",
    oracle(
        """select request_id, case when request_id%3 = 0 then case when query = '' then 'UNK000' else upper(trim(query)) end else 'DL1' end as flight_id,
             case when request_id%3 = 0 then 'UNK' else 'DL' end as carrier, case when request_id%3 = 0 then 'ORD' else 'ATL' end as origin,
             case when request_id%3 = 0 then 41.9742e0 else 1e0 end as latitude, case when request_id%3 = 0 then 'API Error - Fallback Mode' else 'ok' end as status
           from requests""",
        "requests",
    ),
)
def default_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {"flight_id": "DL1", "carrier": "DL", "origin": "ATL", "destination": "JFK", "scheduled_departure": "0900", "status": "ok"}
    fields = (
        "flight_id", "carrier", "origin", "destination", "scheduled_departure", "latitude", "longitude", "origin_latitude",
        "origin_longitude", "dest_latitude", "dest_longitude", "altitude", "velocity", "status", "accumulated_delay",
    )
    whole = ("altitude", "velocity", "accumulated_delay")
    known = F.struct(
        *[(F.lit(given[n]) if n in given else F.lit(0).cast("bigint") if n in whole else F.lit(1.0)).alias(n) for n in fields]
    )
    asked = view(spark, sf_dir, "requests").withColumn("flight", F.when(F.col("request_id") % 3 != 0, known))
    return rules.default_event(asked).select(
        "request_id", "flight.flight_id", "flight.carrier", "flight.origin", "flight.latitude", "flight.status"
    )

