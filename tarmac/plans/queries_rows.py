"""Queries over row shaping, calendar and flight features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions import clock, text
from tarmac.operators import cleaning, holidays, ordering, timeline, weather
from tarmac.operators.lookups import lookup_flights
from tarmac.plans.features import CONGESTION_SECONDS, build_features, training_rows, with_schedule
from tarmac.plans.registry import query
from tarmac.plans.views import flights, oracle, table, view

NORMALISED = "YEAR, MONTH, DAY, DAY_OF_WEEK, AIRLINE, FLIGHT_NUMBER, ORIGIN_AIRPORT, DESTINATION_AIRPORT, SCHEDULED_DEPARTURE, DEPARTURE_DELAY, CANCELLED, WEATHER_DELAY"


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.normalise(flights(spark, sf_dir))


@query("p1_normalise", oracle(f"select {NORMALISED} from normalised", "normalised"))
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(spark, sf_dir)


@query(
    "p2_clean_target",
    oracle("select FL_DATE, AIRLINE, FL_NUMBER, DEP_DELAY from flights where DEP_DELAY >= -30 and DEP_DELAY <= 720", "flights"),
)
def clean_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_target(flights(spark, sf_dir), "DEP_DELAY").select("FL_DATE", "AIRLINE", "FL_NUMBER", "DEP_DELAY")


@query(
    "p3_filter_year",
    oracle("select FL_DATE, AIRLINE, FL_NUMBER from flights where year(FL_DATE) = 2023 and FL_NUMBER % 89 <> 0", "flights"),
)
def filter_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.when(F.col("FL_NUMBER") % 89 == 0, F.lit("not a date")).otherwise(F.date_format("FL_DATE", "yyyy-MM-dd"))
    raw = flights(spark, sf_dir).withColumn("FL_DATE", written)
    return cleaning.filter_year(raw, "FL_DATE", 2023).select("FL_DATE", "AIRLINE", "FL_NUMBER")


@query(
    "p4_fill_const",
    oracle(
        """select AIRLINE, FL_NUMBER, coalesce(DEP_DELAY, 0) as DEP_DELAY, coalesce(DISTANCE, 500) as DISTANCE,
             0e0 as ORIGIN_PRECIP from flights""",
        "flights",
    ),
)
def fill_const(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = cleaning.fill_const(flights(spark, sf_dir), {"DEP_DELAY": 0.0, "DISTANCE": 500.0, "ORIGIN_PRECIP": 0.0})
    return filled.select("AIRLINE", "FL_NUMBER", "DEP_DELAY", "DISTANCE", "ORIGIN_PRECIP")


@query(
    "p5_fill_median",
    oracle(
        """select AIRLINE, FL_NUMBER, coalesce(DISTANCE, (select median(DISTANCE) from flights)) as DISTANCE,
             coalesce(CRS_ELAPSED_TIME, (select median(CRS_ELAPSED_TIME) from flights)) as CRS_ELAPSED_TIME,
             120e0 as BLOCK_TIME from flights""",
        "flights",
    ),
)
def fill_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaning.fill_medians(flights(spark, sf_dir), {"DISTANCE": 500.0, "CRS_ELAPSED_TIME": 120.0, "BLOCK_TIME": 120.0})
    return rows.select("AIRLINE", "FL_NUMBER", "DISTANCE", "CRS_ELAPSED_TIME", "BLOCK_TIME")


@query(
    "p6_clean_key",
    oracle(
        "select AIRLINE as airline, cast(FL_NUMBER as varchar) as number, count(*) as n from flights group by AIRLINE, FL_NUMBER",
        "flights",
    ),
)
def clean_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    untidy = flights(spark, sf_dir).select(
        F.concat(F.lit(" "), F.lower("AIRLINE"), F.lit(" ")).alias("a"), F.col("FL_NUMBER").cast("double").alias("f")
    )
    tidy = untidy.select(text.clean_key(F.col("a"), upper=True).alias("airline"), text.clean_key(F.col("f")).alias("number"))
    return tidy.groupBy("airline", "number").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p7_delayed",
    oracle(
        f"""select 'at_origin' as rule, {NORMALISED} from normalised where ORIGIN_AIRPORT = 'JFK' and DEPARTURE_DELAY > 15
            union all select 'late', {NORMALISED} from normalised where DEPARTURE_DELAY > 30
            union all select 'usual', {NORMALISED} from normalised where DEPARTURE_DELAY > 15 and DEPARTURE_DELAY < 180""",
        "normalised",
    ),
)
def delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalised(spark, sf_dir)
    at_origin = cleaning.delayed(rows, "DEPARTURE_DELAY", 15, ORIGIN_AIRPORT=" jfk")
    late = cleaning.delayed(rows, "DEPARTURE_DELAY", 30)
    usual = cleaning.delayed(rows, "DEPARTURE_DELAY", 15, 180)
    parts = [df.withColumn("rule", F.lit(name)) for name, df in (("at_origin", at_origin), ("late", late), ("usual", usual))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


HISTORY_ORDER = "YEAR, MONTH, DAY, SCHEDULED_DEPARTURE, AIRLINE, FLIGHT_NUMBER, ORIGIN_AIRPORT, DESTINATION_AIRPORT, DEPARTURE_DELAY, CANCELLED, WEATHER_DELAY"

LOOKUP_STEPS = {
    "asked": """
        select request_id, query, contains(query, '|') as has_id, split_part(query, '|', 1) as a,
          replace(split_part(query, '|', 2), '.0', '') as f, split_part(query, '|', 3) as d
        from requests where mode = 'historical'""",
    "firsts": f"""
        select *, concat(cast(YEAR as varchar), '-', lpad(cast(MONTH as varchar), 2, '0'), '-', lpad(cast(DAY as varchar), 2, '0')) as d
        from normalised
        qualify row_number() over (partition by AIRLINE, FLIGHT_NUMBER, YEAR, MONTH, DAY order by {HISTORY_ORDER}) = 1""",
    "opening": f"select * from normalised order by {HISTORY_ORDER} limit 1",
    "opening_late": f"select * from normalised where DEPARTURE_DELAY > 30 order by {HISTORY_ORDER} limit 1",
}
LOOKUP_SQL = " union all ".join(
    [
        f"""select request_id, query, 'id' as matched, {NORMALISED} from asked
            join firsts on AIRLINE = a and FLIGHT_NUMBER = f and firsts.d = asked.d where has_id""",
        f"""select request_id, query, 'first_row' as matched, {NORMALISED} from asked, opening where has_id
            and not exists (select 1 from firsts where AIRLINE = a and FLIGHT_NUMBER = f and firsts.d = asked.d)""",
        f"select request_id, query, 'none_asked' as matched, {NORMALISED} from asked, opening_late where not has_id",
    ]
)


@query("p8_lookup_flights", oracle(LOOKUP_SQL, "normalised", "requests", **LOOKUP_STEPS))
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = view(spark, sf_dir, "requests").where(F.col("mode") == "historical").select("request_id", "query")
    return lookup_flights(requests, normalised(spark, sf_dir))


@query(
    "p9_sample_n",
    """select o_orderkey, o_custkey from orders order by md5('42|' || cast(o_orderkey as varchar)), o_orderkey limit 11000""",
)
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    # More rows than the direct limit, so the counting pass is used.
    return ordering.sample_n(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 11_000, ["o_orderkey"])


@query(
    "p10_split",
    """select o_orderkey, (('0x' || substr(md5('42|' || cast(o_orderkey as varchar)), 1, 8))::bigint) % 100 < 20 as held_out from orders""",
)
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = ordering.split(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    return train.withColumn("held_out", F.lit(False)).unionByName(test.withColumn("held_out", F.lit(True)))


@query(
    "p11_flight_label",
    oracle(
        """select AIRLINE || '|' || FLIGHT_NUMBER || '|' || d as id,
             AIRLINE || FLIGHT_NUMBER || ' to ' || DESTINATION_AIRPORT || ' (' || cast(cast(trunc(DEPARTURE_DELAY) as int) as varchar)
               || ' min delay on ' || d || ')' as display,
             cast(trunc(DEPARTURE_DELAY) as int) as delay
           from (select *, strftime(make_date(YEAR, MONTH, DAY), '%Y-%m-%d') as d from normalised) n""",
        "normalised",
    ),
)
def flight_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.flight_label(normalised(spark, sf_dir))


@query(
    "p12_align_features",
    oracle(
        """select coalesce(DISTANCE, 0) as DISTANCE, 0e0 as ORIGIN_WIND, cast(CRS_DEP_TIME as double) as CRS_DEP_TIME,
             coalesce(CRS_ELAPSED_TIME, 0) as CRS_ELAPSED_TIME from flights""",
        "flights",
    ),
)
def align_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.align_features(flights(spark, sf_dir), ["DISTANCE", "ORIGIN_WIND", "CRS_DEP_TIME", "CRS_ELAPSED_TIME"])


@query(
    "p13_ground_truth",
    oracle(
        """select AIRLINE, FL_NUMBER, cast(coalesce(trunc(DEP_DELAY), 0) as bigint) as actual_delay_minutes,
             case when CANCELLED = 1 then 'CANCELLED' else 'DEPARTED LATE' end as actual_action_taken from flights""",
        "flights",
    ),
)
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = cleaning.ground_truth(F.col("DEP_DELAY"), F.col("CANCELLED"))
    return flights(spark, sf_dir).select("AIRLINE", "FL_NUMBER", *[c.alias(n) for n, c in truth.items()])


@query(
    "f1_calendar_parts",
    "select o_orderkey, cast(month(o_orderdate) as int) as MONTH, cast(day(o_orderdate) as int) as DAY, cast(isodow(o_orderdate) as int) as DAY_OF_WEEK from orders",
)
def calendar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clock.calendar_parts(table(spark, sf_dir, "orders"), "o_orderdate").select("o_orderkey", "MONTH", "DAY", "DAY_OF_WEEK")


@query(
    "f2_clock_parts",
    oracle(
        """select FL_DATE, FL_NUMBER, CRS_DEP_TIME, HOUR, MINUTE, cast(HOUR*60+MINUTE as int) as TIME_OF_DAY from (
             select FL_DATE, FL_NUMBER, CRS_DEP_TIME, cast(t // 100 as int) as HOUR, cast(t % 100 as int) as MINUTE from (
               select *, case when FL_NUMBER % 61 = 0 then 1200 else CRS_DEP_TIME end as t from flights) a) b""",
        "flights",
    ),
)
def clock_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flights(spark, sf_dir).withColumn(
        "written", F.when(F.col("FL_NUMBER") % 61 == 0, F.lit("LIVE")).otherwise(F.concat(F.col("CRS_DEP_TIME").cast("string"), F.lit(".0")))
    )
    return clock.clock_parts(rows, "written", on_error=1200).select("FL_DATE", "FL_NUMBER", "CRS_DEP_TIME", "HOUR", "MINUTE", "TIME_OF_DAY")


@query(
    "f3_cyclic",
    oracle(
        """select t, n, round(sin(t*2e0*pi()/1440e0), 6) + 0e0 as SIN_TIME, round(cos(t*2e0*pi()/1440e0), 6) + 0e0 as COS_TIME from (
             select CRS_DEP_TIME // 100 * 60 + CRS_DEP_TIME % 100 as t, count(*) as n from flights group by 1) a""",
        "flights",
    ),
)
def cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = clock.clock_parts(flights(spark, sf_dir), "CRS_DEP_TIME").groupBy(F.col("TIME_OF_DAY").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    both = clock.cyclic(times, "t")
    return both.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("SIN_TIME", "COS_TIME")})


@query(
    "f4_is_rush",
    oracle(
        "select CRS_DEP_TIME // 100 as hour, cast(max(case when CRS_DEP_TIME // 100 in (7,8,9,16,17,18,19) then 1 else 0 end) as int) as rush, count(*) as n from flights group by 1",
        "flights",
    ),
)
def is_rush(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = clock.clock_parts(flights(spark, sf_dir), "CRS_DEP_TIME")
    return hours.groupBy(F.col("HOUR").alias("hour")).agg(F.max(clock.is_rush(F.col("HOUR"))).alias("rush"), F.count(F.lit(1)).alias("n"))


SCHEDULED = "cast(FL_DATE as timestamp) + to_minutes(case when CRS_DEP_TIME = 2400 then 0 else CRS_DEP_TIME // 100 * 60 + CRS_DEP_TIME % 100 end)"


@query(
    "f5_scheduled_ts",
    oracle(f"select FL_NUMBER, CRS_DEP_TIME, {SCHEDULED} as scheduled_ts from flights", "flights"),
)
def scheduled_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flights(spark, sf_dir).select(
        "FL_NUMBER", "CRS_DEP_TIME", clock.scheduled_ts(F.col("FL_DATE"), F.col("CRS_DEP_TIME")).alias("scheduled_ts")
    )


TRAINING = "select *, " + SCHEDULED + " as ts from flights where DEP_DELAY between -30 and 720"
ROLLING = """select ORIGIN, ts, sum(s) over w / nullif(sum(n) over w, 0) as congestion
    from (select ORIGIN, ts, sum(DEP_DELAY) as s, count(*) as n from training group by ORIGIN, ts) p
    window w as (partition by ORIGIN order by ts range between interval 2 hours preceding and interval 1 microsecond preceding)"""


@query(
    "f6_rolling_mean",
    oracle(
        """select ORIGIN as ORIGIN_AIRPORT, FL_NUMBER as FLIGHT_NUMBER, ts as SCHEDULED_TS, DEP_DELAY as DEPARTURE_DELAY,
             coalesce(avg(DEP_DELAY) over (partition by ORIGIN order by ts
               range between interval 2 hours preceding and interval 1 microsecond preceding), 0) as congestion
           from training""",
        "flights",
        training=TRAINING,
    ),
)
def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_schedule(training_rows(flights(spark, sf_dir)))
    return timeline.rolling_mean(
        rows, "ORIGIN_AIRPORT", "SCHEDULED_TS", "DEPARTURE_DELAY", CONGESTION_SECONDS, "congestion"
    ).select("ORIGIN_AIRPORT", "FLIGHT_NUMBER", "SCHEDULED_TS", "DEPARTURE_DELAY", "congestion")


@query(
    "f6_rolling_mean_events",
    """select event_id, event_type, round(coalesce(avg(value) over (partition by event_type order by ts
         range between interval 2 hours preceding and interval 1 microsecond preceding), 0), 6) as mean_value from events""",
)
def rolling_mean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline.rolling_mean(table(spark, sf_dir, "events"), "event_type", "ts", "value", 7200, "mean_value")
    return rows.select("event_id", "event_type", F.round("mean_value", 6).alias("mean_value"))


# Values of very different size, some of them no numbers.
MIXED = "case when event_id%50=0 then cast('nan' as double) when event_id%97=0 then 1e15 else 0.25e0 end"


@query(
    "f6_rolling_mean_mixed",
    f"""select a.event_id, coalesce(sum(b.v) / nullif(count(b.v), 0), 0) as mean_value
        from events a left join (select event_type, ts, case when event_id%50<>0 then {MIXED} end as v from events) b
          on a.event_type = b.event_type and b.ts >= a.ts - interval 2 hours and b.ts < a.ts group by a.event_id""",
)
def rolling_mean_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("mixed", F.expr(MIXED))
    return timeline.rolling_mean(events, "event_type", "ts", "mixed", 7200, "mean_value").select("event_id", "mean_value")


@query(
    "f7_is_holiday",
    oracle(
        """select FL_DATE, cast(max(case when holiday_date is null then 0 else 1 end) as int) as IS_HOLIDAY, count(*) as n
           from flights left join holidays on holiday_date = FL_DATE group by FL_DATE""",
        "flights",
        "holidays",
    ),
)
def is_holiday(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = holidays.is_holiday(flights(spark, sf_dir), "FL_DATE", holidays.us_holidays(spark, 2023, 2024))
    return marked.groupBy("FL_DATE").agg(F.max("IS_HOLIDAY").alias("IS_HOLIDAY"), F.count(F.lit(1)).alias("n"))


@query(
    "f8_holiday_week",
    oracle(
        """select o_orderkey, cast(distance as int) as DAYS_TO_NEAREST_HOLIDAY, cast(case when distance <= 3 then 1 else 0 end as int) as IS_HOLIDAY_WEEK
           from orders join (
             select d, min(abs(date_diff('day', holiday_date, d))) as distance
             from (select distinct cast(o_orderdate as date) + interval 9000 day as d0, cast(cast(o_orderdate as date) + interval 9000 day as date) as d from orders) days, holidays
             group by d) x on x.d = cast(cast(o_orderdate as date) + interval 9000 day as date)""",
        "holidays",
    ),
)
def holiday_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Order dates moved forward by 9,000 days lie before, within and after the calendar.
    rows = table(spark, sf_dir, "orders").withColumn("day", F.date_add(F.col("o_orderdate").cast("date"), 9000))
    return holidays.holiday_week(rows, "day", holidays.us_holidays(spark, 2023, 2024)).select(
        "o_orderkey", "DAYS_TO_NEAREST_HOLIDAY", "IS_HOLIDAY_WEEK"
    )


WEATHER_JOIN = """select f.FL_DATE, f.FL_NUMBER, f.ORIGIN as ORIGIN_AIRPORT, f.DEST as DESTINATION_AIRPORT, cast(f.CRS_DEP_TIME // 100 as int) as HOUR,
     coalesce(o.precipitation, 0) as ORIGIN_PRECIP, coalesce(o.wind_speed_10m, 0) as ORIGIN_WIND,
     coalesce(d.precipitation, 0) as DEST_PRECIP, coalesce(d.wind_speed_10m, 0) as DEST_WIND
   from flights f
   left join weather_hourly o on o.AIRPORT = f.ORIGIN and make_date(o.YEAR, o.MONTH, o.DAY) = f.FL_DATE and o.HOUR = f.CRS_DEP_TIME // 100
   left join weather_hourly d on d.AIRPORT = f.DEST and make_date(d.YEAR, d.MONTH, d.DAY) = f.FL_DATE and d.HOUR = f.CRS_DEP_TIME // 100"""


@query("f9_join_weather", oracle(WEATHER_JOIN, "flights", "weather_hourly"))
def join_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = view(spark, sf_dir, "weather_hourly")
    rows = clock.clock_parts(cleaning.rename_flight_columns(flights(spark, sf_dir)), "SCHEDULED_DEPARTURE")
    rows = weather.join_weather(rows, hourly, "ORIGIN_AIRPORT", "ORIGIN")
    rows = weather.join_weather(rows, hourly, "DESTINATION_AIRPORT", "DEST")
    return rows.select(
        "FL_DATE", F.col("FLIGHT_NUMBER").alias("FL_NUMBER"), "ORIGIN_AIRPORT", "DESTINATION_AIRPORT", "HOUR",
        "ORIGIN_PRECIP", "ORIGIN_WIND", "DEST_PRECIP", "DEST_WIND",
    )


@query("f10_route_key", oracle("select ORIGIN || '_' || DEST as route, count(*) as n from flights group by 1", "flights"))
def route_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = flights(spark, sf_dir).select(text.route_key(F.col("ORIGIN"), F.col("DEST")).alias("route"))
    return keyed.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f11_us_holidays",
    oracle(
        """select d as holiday_date, n from holiday_days
           join (select cast(o_orderdate as date) as od, count(*) as n from orders group by 1) o on od = d""",
        days="""select cast(g as date) as d, cast(year(g) as int) as y, month(g) as m, day(g) as dd, isodow(g) as w
                from (select unnest(generate_series(timestamp '1989-12-01', timestamp '2012-01-31', interval 1 day)) as g) t""",
        dated="""select d, w from days where (m = 1 and dd = 1) or (m = 7 and dd = 4) or (m = 11 and dd = 11)
                 or (m = 12 and dd = 25) or (m = 6 and dd = 19 and y >= 2021)""",
        holiday_days="""select distinct d from (
            select d from dated
            union all select cast(d - interval 1 day as date) from dated where w = 6
            union all select cast(d + interval 1 day as date) from dated where w = 7
            union all select d from days where w = 1 and ((m = 1 and (dd + 6) // 7 = 3) or (m = 2 and (dd + 6) // 7 = 3)
              or (m = 9 and (dd + 6) // 7 = 1) or (m = 10 and (dd + 6) // 7 = 2) or (m = 5 and dd + 7 > 31))
            union all select d from days where w = 4 and m = 11 and (dd + 6) // 7 = 4) u where year(d) between 1990 and 2011""",
    ),
)
def us_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_day = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("holiday_date")).agg(F.count(F.lit(1)).alias("n"))
    return holidays.us_holidays(spark, 1990, 2011).join(per_day, "holiday_date")


FEATURE_SQL = """
    select cast(month(f.FL_DATE) as int) as MONTH, cast(day(f.FL_DATE) as int) as DAY, cast(isodow(f.FL_DATE) as int) as DAY_OF_WEEK,
      f.hh as HOUR, f.mm as MINUTE, cast(f.hh*60+f.mm as int) as TIME_OF_DAY,
      round(sin((f.hh*60+f.mm)*2e0*pi()/1440e0), 6) + 0e0 as SIN_TIME, round(cos((f.hh*60+f.mm)*2e0*pi()/1440e0), 6) + 0e0 as COS_TIME,
      cast(case when f.hh in (7,8,9,16,17,18,19) then 1 else 0 end as int) as IS_RUSH_HOUR,
      coalesce(r.congestion, 0) as CONCURRENT_DELAYS_AT_ORIGIN,
      cast(case when h.distance = 0 then 1 else 0 end as int) as IS_HOLIDAY,
      cast(case when h.distance <= 3 then 1 else 0 end as int) as IS_HOLIDAY_WEEK,
      coalesce(o.precipitation, 0) as ORIGIN_PRECIP, coalesce(o.wind_speed_10m, 0) as ORIGIN_WIND,
      coalesce(d.precipitation, 0) as DEST_PRECIP, coalesce(d.wind_speed_10m, 0) as DEST_WIND,
      f.DISTANCE, f.CRS_ELAPSED_TIME, f.AIRLINE, f.ORIGIN as ORIGIN_AIRPORT, f.DEST as DESTINATION_AIRPORT,
      cast(f.FL_NUMBER as varchar) as FLIGHT_NUMBER, f.ORIGIN || '_' || f.DEST as ROUTE, f.DEP_DELAY as DEPARTURE_DELAY
    from (select *, cast(CRS_DEP_TIME // 100 as int) as hh, cast(CRS_DEP_TIME % 100 as int) as mm from training) f
    left join rolling r on r.ORIGIN = f.ORIGIN and r.ts = f.ts
    left join (select FL_DATE, min(abs(date_diff('day', holiday_date, FL_DATE))) as distance
               from (select distinct FL_DATE from flights) fd, holidays group by FL_DATE) h on h.FL_DATE = f.FL_DATE
    left join weather_hourly o on o.AIRPORT = f.ORIGIN and make_date(o.YEAR, o.MONTH, o.DAY) = f.FL_DATE and o.HOUR = f.hh
    left join weather_hourly d on d.AIRPORT = f.DEST and make_date(d.YEAR, d.MONTH, d.DAY) = f.FL_DATE and d.HOUR = f.hh"""


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    calendar = holidays.us_holidays(spark, 2023, 2024)
    return build_features(flights(spark, sf_dir), view(spark, sf_dir, "weather_hourly"), calendar)


@query("f12_build_features", oracle(FEATURE_SQL, "flights", "weather_hourly", "holidays", training=TRAINING, rolling=ROLLING))
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_rows(spark, sf_dir).withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("SIN_TIME", "COS_TIME")})


@query(
    "worst_congestion",
    oracle(
        """select ORIGIN as ORIGIN_AIRPORT, cast(hour(ts) as int) as HOUR, round(avg(coalesce(congestion, 0)), 6) as congestion, count(*) as flights
           from training join rolling using (ORIGIN, ts) group by 1, 2 order by 3 desc, 1, 2 limit 20""",
        "flights",
        training=TRAINING,
        rolling=ROLLING,
    ),
)
def worst_congestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 (origin, hour) pairs whose flights meet the longest recent delays."""
    rows = with_schedule(training_rows(flights(spark, sf_dir)))
    rolled = timeline.rolling_mean(rows, "ORIGIN_AIRPORT", "SCHEDULED_TS", "DEPARTURE_DELAY", CONGESTION_SECONDS, "congestion")
    return (
        rolled.groupBy("ORIGIN_AIRPORT", F.hour("SCHEDULED_TS").alias("HOUR"))
        .agg(F.round(F.avg("congestion"), 6).alias("congestion"), F.count(F.lit(1)).alias("flights"))
        .orderBy(F.desc("congestion"), "ORIGIN_AIRPORT", "HOUR")
        .limit(20)
    )
