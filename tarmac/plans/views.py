"""Airline-shaped views over the given tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tarmac.sources import fixed_values as fixed

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Codes of 20 airports and 17 carriers, one after the other, for views in SQL that both engines run.
_A = "'" + "".join(code for code, *_ in fixed.AIRPORTS[:20]) + "'"
_C = "'" + "".join(code for code, *_ in fixed.CARRIER_NAMES[:17]) + "'"


def airport(index: str) -> str:
    return f"substring({_A}, cast(({index})*3+1 as int), 3)"


def carrier(index: str) -> str:
    return f"substring({_C}, cast(({index})*2+1 as int), 2)"


_SPARK_DAY = "date_add(DATE'2023-11-01', cast(dd as int))"
_DUCK_DAY = "DATE '2023-11-01' + cast(dd as int)"

_VIEWS = {
    "flights": f"""
        select DAY_EXPR as FL_DATE,
          {carrier('l_suppkey%17')} as AIRLINE,
          cast(l_orderkey%900+100 as int) as FL_NUMBER,
          {airport('l_suppkey%20')} as ORIGIN,
          {airport('(l_suppkey+1+l_partkey%19)%20')} as DEST,
          cast(floor(mins/60)*100+mins%60 as int) as CRS_DEP_TIME,
          case when l_orderkey%97=0 then null
               else cast(floor(l_discount*l_quantity*l_quantity*3.2-12-l_tax*300+0.5) as double) end as DEP_DELAY,
          case when l_orderkey%97=0 then 1e0 else 0e0 end as CANCELLED,
          case when l_returnflag='R' and l_discount>0.05 then l_quantity else 0e0 end as DELAY_DUE_WEATHER,
          case when l_partkey%50=0 then null else cast(200+l_partkey%2500 as double) end as DISTANCE,
          case when l_partkey%50=1 then null else cast(60+l_partkey%300 as double) end as CRS_ELAPSED_TIME
        from (select l.*, (l_orderkey*131+l_partkey*17+l_linenumber*7)%1441 as mins,
                     (l_orderkey*7+l_partkey)%120 as dd from lineitem l) b""",
    "weather_hourly": f"""
        select AIRPORT, YEAR, MONTH, DAY, HOUR, cast(max(floor(value/10)) as double) as precipitation,
          cast(max(floor(value/4)) as double) as wind_speed_10m, max(event_id%80) as weathercode
        from (select {airport('user_id%20')} as AIRPORT, cast(year(ts) as int) as YEAR,
                cast(month(ts) as int) as MONTH, cast(day(ts) as int) as DAY,
                cast(hour(ts) as int) as HOUR, value, event_id from events) e
        group by AIRPORT, YEAR, MONTH, DAY, HOUR""",
    "state_vectors": """
        select event_id, ts, concat('DAL', cast(user_id as varchar(20))) as callsign,
          case when event_id%101=0 then null else -125e0+cast((event_id*37)%5800 as double)/100 end as lon,
          case when event_id%103=0 then null else 25e0+cast((event_id*53)%2400 as double)/100 end as lat,
          case when event_id%107=0 then null else cast((event_id*71)%12000 as double) end as alt_m,
          event_type='error' as on_ground,
          cast((event_id*13)%260 as double) as vel_mps,
          cast(event_id%21-12 as double) as vert_rate
        from events""",
    "airport_events": f"""
        select {airport('n_nationkey%20')} as airport_id, n_nationkey as seq,
          case n_nationkey%4 when 0 then '{{"groundStop":{{"reason":"thunderstorms"}}}}'
            when 1 then '{{"groundDelay":{{"reason":"wind","avgDelay":"1 hours 15 minutes"}}}}'
            when 2 then '{{"arrivalDelay":{{"reason":"volume"}}}}'
            else case when n_nationkey%8=3 then '{{"groundStop":{{}}}}' else '{{}}' end end as payload
        from nation""",
    "legs": """
        select case when o_orderkey%41=0 then null else o_custkey%50 end as tail,
          case when o_orderkey%37=0 then null else o_orderkey%40 end as fl_day, o_orderkey as leg,
          case when o_orderkey%5<2 then (o_orderkey*11)%60 else 0 end as own_delay,
          (o_orderkey*13)%30 as slack
        from orders""",
    "regulatory_docs": f"""
        select e.vec_id as id, concat('doc ', cast(e.vec_id as varchar(20))) as title, e.embedding, d.text as content,
          case when e.label=0 then 'ALL' else {airport('e.label-1')} end as icao
        from embeddings e left join documents d on d.doc_id = e.vec_id""",
    # One flight id per order; every fourth request is live, some ids match no flight.
    "requests": f"""
        select l_orderkey as request_id,
          case when l_orderkey%4=3 then 'live' else 'historical' end as mode,
          case l_orderkey%4
            when 0 then min(concat({carrier('l_suppkey%17')}, '|', cast(l_orderkey%900+100 as varchar(20)), '.0|', cast(DAY_EXPR as varchar(20))))
            when 1 then min(concat({carrier('l_suppkey%17')}, '|', cast(l_orderkey%900+100 as varchar(20)), '|', cast(DAY_EXPR as varchar(20))))
            when 2 then case when l_orderkey%3=0 then '' else concat('DL|', cast(l_orderkey as varchar(20)), '|2023-13-45') end
            else case l_orderkey%7 when 0 then concat('dal ', cast(l_orderkey%900+100 as varchar(20)))
                 when 1 then concat('UA', cast(l_orderkey%900+100 as varchar(20)))
                 when 2 then concat('SWA', cast(l_orderkey%900+100 as varchar(20)))
                 when 3 then concat('B6', cast(l_orderkey%900+100 as varchar(20)))
                 when 4 then concat('N', cast(l_orderkey%900+100 as varchar(20)), 'Q')
                 when 5 then 'charter' else concat('AS ', cast(l_orderkey%900+100 as varchar(20))) end
          end as query
        from (select l.*, (l_orderkey*7+l_partkey)%120 as dd from lineitem l) b
        group by l_orderkey""",
}

_NORMALISED = """
    select cast(year(FL_DATE) as int) as YEAR, cast(month(FL_DATE) as int) as MONTH,
      cast(day(FL_DATE) as int) as DAY, cast(isodow(FL_DATE) as int) as DAY_OF_WEEK, AIRLINE,
      cast(FL_NUMBER as varchar(20)) as FLIGHT_NUMBER, ORIGIN as ORIGIN_AIRPORT,
      DEST as DESTINATION_AIRPORT, CRS_DEP_TIME as SCHEDULED_DEPARTURE,
      coalesce(DEP_DELAY, 0e0) as DEPARTURE_DELAY, CANCELLED, DELAY_DUE_WEATHER as WEATHER_DELAY
    from flights"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the Parquet files."""
    text = _VIEWS[name].replace("DAY_EXPR", _SPARK_DAY)
    names = "|".join(TABLES)
    text = re.sub(rf"\b(from|join) ({names})\b", rf"\1 parquet.`{sf_dir}/\2.parquet`", text)
    return spark.sql(text)


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "flights")


def flights_over(lineitem: DataFrame, *more: str) -> DataFrame:
    """The flights view over a given, possibly streaming, line item table, with more of its columns."""
    text = _VIEWS["flights"].replace("DAY_EXPR", ", ".join([*more, _SPARK_DAY])).replace("from lineitem l", "from {lineitem} l")
    return lineitem.sparkSession.sql(text, lineitem=lineitem)


def _values(rows) -> str:
    def literal(value) -> str:
        if isinstance(value, float):
            return f"{value!r}e0"
        if isinstance(value, (tuple, list)):
            return "[" + ", ".join(literal(v) for v in value) + "]"
        return "'" + str(value).replace("'", "''") + "'"

    return "(values " + ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows) + ")"


# The holidays and observed days of 2023 and 2024, for the checking SQL.
HOLIDAYS = (
    "2023-01-01", "2023-01-02", "2023-01-16", "2023-02-20", "2023-05-29", "2023-06-19",
    "2023-07-04", "2023-09-04", "2023-10-09", "2023-11-10", "2023-11-11", "2023-11-23",
    "2023-12-25", "2024-01-01", "2024-01-15", "2024-02-19", "2024-05-27", "2024-06-19",
    "2024-07-04", "2024-09-02", "2024-10-14", "2024-11-11", "2024-11-28", "2024-12-25",
)

_DIMENSIONS = {
    "dim_airport": f"select * from {_values(fixed.AIRPORTS)} t(code, latitude, longitude)",
    "dim_carrier": f"select * from {_values(fixed.CARRIERS)} t(iata, icao)",
    "dim_carrier_name": f"select * from {_values(fixed.CARRIER_NAMES)} t(carrier, carrier_name)",
    "dim_hub": f"select * from {_values(fixed.HUBS)} t(carrier, hubs)",
    "dim_city": f"select * from {_values(fixed.CITIES)} t(code, city)",
    "dim_recommendation": f"select * from {_values(fixed.RECOMMENDATIONS)} t(situation, action, reasoning)",
    "holidays": f"select cast(d as date) as holiday_date from {_values([(d,) for d in HOLIDAYS])} t(d)",
}

_NEEDS = {"normalised": ("flights",)}


def oracle(sql: str, *names: str, **extra: str) -> str:
    """DuckDB text: the named views and extra steps as a WITH list in front of the query."""
    steps: dict[str, str] = {}

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, ()):
            add(needed)
        if name == "normalised":
            steps[name] = _NORMALISED
        elif name in _DIMENSIONS:
            steps[name] = _DIMENSIONS[name]
        else:
            steps[name] = _VIEWS[name].replace("DAY_EXPR", _DUCK_DAY)

    for name in names:
        add(name)
    steps.update(extra)
    if not steps:
        return sql
    return "with " + ",\n".join(f"{n} as ({t})" for n, t in steps.items()) + "\n" + sql
