"""Queries over the further documents and files that outside sources deliver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import cleaning, lookups, retrieval
from tarmac.operators.aggregates import weather_profile
from tarmac.plans.analyze import feed_routes
from tarmac.plans.queries_rules import WEATHER_STEPS, day_and_now
from tarmac.plans.queries_search import SEARCH, centroids, corpus
from tarmac.plans.queries_sources import REPORTS_SQL, feed_documents, reports
from tarmac.plans.registry import query
from tarmac.plans.views import airport, flights, oracle, table, view
from tarmac.sources import feeds, tables
from tarmac.sources import fixed_values as fixed
from tarmac.workspace import new_folder


@query(
    "s3_current_weather",
    oracle(
        """select airport, temperature_2m, case when airport < 'D' then 0e0 else precipitation end as precipitation, windspeed_10m, weather_code from now_weather
           union all select 'XXX', 20e0, 0e0, 8e0, 0e0""",
        "weather_hourly", now_weather=WEATHER_STEPS["now_weather"],
    ),
)
def current_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current documents, some without their precipitation, one that says nothing."""
    now, _ = day_and_now(spark, sf_dir)
    rain = F.when(F.col("airport") >= "D", F.col("precipitation")).alias("precipitation")
    document = F.to_json(F.struct(F.struct("temperature_2m", rain, "windspeed_10m", "weather_code").alias("current")))
    none = spark.range(1).select(F.lit("XXX").alias("airport"), F.lit("{}").alias("payload"))
    return feeds.parse_current_weather(now.select("airport", document.alias("payload")).unionByName(none))


@query(
    "s3_daily_weather",
    oracle("select airport, date, weathercode, temperature_2m_max, precipitation_sum, windspeed_10m_max from day_weather", "weather_hourly", day_weather=WEATHER_STEPS["day_weather"]),
)
def daily_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per airport and month: parallel arrays, an entry a day."""
    _, day = day_and_now(spark, sf_dir)
    names = ("weathercode", "temperature_2m_max", "precipitation_sum", "windspeed_10m_max")
    entry = F.struct(F.date_format("date", "yyyy-MM-dd").alias("time"), *(F.col(n).cast("double").alias(n) for n in names))
    months = day.groupBy("airport", F.trunc("date", "month").alias("month")).agg(F.array_sort(F.collect_list(entry)).alias("d"))
    document = F.to_json(F.struct(F.struct(*(F.col(f"d.{n}").alias(n) for n in ("time", *names))).alias("daily")))
    return feeds.parse_daily_weather(months.select("airport", document.alias("payload")))


@query(
    "s3_read_weather",
    oracle("select AIRPORT, YEAR, MONTH, DAY, HOUR, precipitation, wind_speed_10m from weather_hourly", "weather_hourly"),
)
def read_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather from files whose columns stand in another order, beside one that nobody asked for."""
    path = new_folder(spark, "weather-csv")
    hourly = view(spark, sf_dir, "weather_hourly")
    hourly.select("wind_speed_10m", "weathercode", "HOUR", "DAY", "MONTH", "YEAR", "precipitation", "AIRPORT").write.option("header", True).csv(path)
    return tables.read_weather(spark, path)


@query(
    "s5_parse_event_list",
    oracle(
        """select airport_id, cast(seq as bigint) as seq, payload->'$.groundStop'->>'$.reason' as stop_reason, payload->'$.groundDelay'->>'$.avgDelay' as hold_delay,
             payload->'$.arrivalDelay'->>'$.reason' as arrival_reason, coalesce(json_extract_string(payload, '$.groundStop') <> '{}', false) as stopped
           from airport_events""",
        "airport_events",
    ),
)
def parse_event_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document that lists the programmes of all airports."""
    members = F.expr("substring(payload, 2, length(payload) - 2)")
    entry = F.concat(F.lit('{"airportId":"'), "airport_id", F.lit('"'), F.when(members != "", F.concat(F.lit(","), members)).otherwise(""), F.lit("}"))
    listed = view(spark, sf_dir, "airport_events").agg(F.array_sort(F.collect_list(F.struct("seq", entry.alias("e")))).alias("l"))
    document = listed.select(F.concat(F.lit("["), F.array_join("l.e", ","), F.lit("]")).alias("payload"))
    return feeds.parse_airport_event_list(document).select(
        "airport_id", "seq", F.col("groundStop.reason").alias("stop_reason"), F.col("groundDelay.avgDelay").alias("hold_delay"),
        F.col("arrivalDelay.reason").alias("arrival_reason"), F.col("groundStop").isNotNull().alias("stopped"),
    )


@query(
    "s7_read_reports",
    oracle("select station, valid, metar from reports", reports=REPORTS_SQL),
)
def read_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "reports-csv")
    reports(spark, sf_dir).withColumn("valid", F.date_format("valid", "yyyy-MM-dd HH:mm:ss.SSSSSS")).write.option("header", True).csv(path)
    read = tables.read_reports(spark, path)
    return read.withColumn("valid", F.col("valid").cast("timestamp_ntz"))


@query(
    "s7_parse_reports",
    oracle(
        """select station || strftime(valid, '%Y%m%d') as station, arg_max(metar, valid) as report from reports group by 1
           union all select 'KXXX', null""",
        reports=REPORTS_SQL,
    ),
)
def parse_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of observations per station and day, the newest first; one station has none."""
    of_day = F.concat("station", F.date_format("valid", "yyyyMMdd")).alias("station")
    days = reports(spark, sf_dir).groupBy(of_day).agg(F.sort_array(F.collect_list(F.struct("valid", F.col("metar").alias("rawOb"))), asc=False).alias("o"))
    documents = days.select("station", F.to_json(F.transform("o", lambda x: F.struct(x["rawOb"].alias("rawOb")))).alias("payload"))
    none = spark.range(1).select(F.lit("KXXX").alias("station"), F.lit("[]").alias("payload"))
    return feeds.parse_reports(documents.unionByName(none))


@query(
    "s10_profile_json",
    oracle("select ORIGIN as airport, avg(DELAY_DUE_WEATHER) as mean_delay from flights where DELAY_DUE_WEATHER > 0 group by ORIGIN union all select '_GLOBAL_MEAN_', avg(DELAY_DUE_WEATHER) from flights where DELAY_DUE_WEATHER > 0", "flights"),
)
def profile_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile kept as one JSON object."""
    path = new_folder(spark, "profile-json")
    profile = weather_profile(flights(spark, sf_dir), "ORIGIN", "DELAY_DUE_WEATHER")
    profile.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("airport", "mean_delay")))).alias("value")).write.text(path)  # an entry per airport
    return tables.read_profile_json(spark, path)


@query(
    "j11_resolve_day_report",
    oracle(
        f"""select code, f.day, n, coalesce(d.report, c.report, 'K' || code || ' {fixed.ROUTINE_REPORT}') as report
            from (select ORIGIN as code, strftime(FL_DATE, '%Y-%m-%d') as day, count(*) as n from flights group by all) f
            left join daily d on d.station = 'K' || code and d.day = f.day left join newest c on c.station = 'K' || code""",
        "flights", reports=REPORTS_SQL,
        daily="select station, strftime(valid, '%Y-%m-%d') as day, arg_min(metar, valid) as report from reports group by all",
        newest="select station, arg_max(metar, valid) as report from reports where metar like '%1%' group by station",
    ),
)
def resolve_day_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's first report of each flight's station, else the newest of one collection, else the routine text."""
    asked = flights(spark, sf_dir).groupBy(F.col("ORIGIN").alias("code"), F.date_format("FL_DATE", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    every = reports(spark, sf_dir)
    day = lookups.first_report(every, "station", "valid", "metar")
    return lookups.resolve_day_report(asked, "code", "day", day, [every.where("metar like '%1%'").withColumnRenamed("metar", "report")], "report")


FEED_SQL = f"""select concat('k', cast(s.event_id as varchar)) as feed_key, lat as latitude, lon as longitude, {airport('user_id%20')} as origin,
    case when s.event_id%17=0 then 'N/A' else {airport('(user_id+1+s.event_id%19)%20')} end as destination, concat('DL', cast(user_id as varchar)) as iata_flight, callsign
  from state_vectors s join events e on e.event_id = s.event_id where s.event_id%11 <> 0"""


@query(
    "j6_feed_routes",
    oracle(
        """select a.iata_flight, f.feed_key, f.latitude, f.longitude, f.origin, f.destination
           from (select distinct 'DL' || cast(c_custkey as varchar) as iata_flight, 'DAL' || cast(c_custkey * 2 as varchar) as sign from customer) a
           join feed f on f.feed_key = (select min(x.feed_key) from feed x where x.callsign in (a.sign, a.iata_flight) or x.iata_flight = a.iata_flight)""",
        "state_vectors", feed=FEED_SQL,
    ),
)
def route_of_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's entry of each flight asked for, by call sign or flight number; of several the first key."""
    number = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("DL"), number.cast("string")).alias("iata_flight"), F.concat(F.lit("DAL"), (number * 2).cast("string")).alias("icao_callsign"))
    found = feed_routes(asked, feeds.parse_flight_feed(feed_documents(spark, sf_dir)))
    return found.select("iata_flight", "feed_key", "latitude", "longitude", "origin", "destination")


@query(
    "r4_retrieve_of_route",
    oracle(
        f"""select query_id, doc_id, round(distance, 6) as distance, icao, cast(place as int) as rank from (
              select *, row_number() over (partition by query_id order by distance, doc_id) as place from (
                select p.*, icao, row_number() over (partition by query_id order by distance, doc_id) as near from pairs p join regulatory_docs r on r.id = p.doc_id
                where icao in ('ALL', {airport('query_id')}, {airport('(query_id+1)%20')})) w where near <= 10 and distance < 1.5e0) t where place <= 2""",
        "regulatory_docs", **{k: SEARCH[k] for k in ("parts", "centroids", "pairs")},
    ),
)
def retrieve_of_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route's documents alone are ranked, in place of ranking all and filtering then."""
    asked, documents = centroids(spark, sf_dir), corpus(spark, sf_dir)
    found = retrieval.retrieve(retrieval.knn_exact(asked, documents, general="ALL"), asked, documents)
    return found.select("query_id", "doc_id", F.round("distance", 6).alias("distance"), "icao", "rank")


@query(
    "a8_approximate_median",
    "select count(l_extendedprice) as n, true as near from lineitem",
)
def approximate_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch's median has a rank within a hundredth of the middle."""
    prices = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    median = cleaning.approximate_median(prices, "l_extendedprice").scalar()
    counted = prices.agg(F.count("l_extendedprice").alias("n"), F.count_if(F.col("l_extendedprice") < median).alias("under"), F.count_if(F.col("l_extendedprice") <= median).alias("upto"))
    return counted.select("n", ((F.col("under") <= 0.51 * F.col("n")) & (F.col("upto") >= 0.49 * F.col("n"))).alias("near"))


@query(
    "a8_medians_of_columns",
    "select median(l_quantity) as l_quantity, median(l_extendedprice) as l_extendedprice, median(l_discount) as l_discount, median(l_tax) as l_tax, median(l_partkey)::double as l_partkey from lineitem",
)
def medians_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five exact medians from two passes."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]
    medians = cleaning.exact_medians(table(spark, sf_dir, "lineitem"), columns)
    return spark.range(1).select(*[F.lit(medians[c]).alias(c) for c in columns])
