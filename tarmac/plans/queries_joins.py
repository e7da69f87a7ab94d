"""Queries over joins, lookups, aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import aggregates, cleaning, lookups, ordering, timeline
from tarmac.plans.queries_rows import normalised
from tarmac.plans.queries_sources import REPORTS_SQL, reports, snapshots
from tarmac.plans.registry import query
from tarmac.plans.views import airport, flights, flights_over, oracle, table, view
from tarmac.sources import dimensions as dims
from tarmac.sources import feeds, tables
from tarmac.workspace import new_folder


def _asof(direction: str) -> str:
    test = {"backward": ">=", "forward": "<="}[direction]
    return f"""select l.event_id, r.event_id as match_id, r.ts as match_ts from events l
        asof left join (select * from events where event_type = 'error') r on l.user_id = r.user_id and l.ts {test} r.ts"""


@query(
    "j1_asof_join",
    oracle(
        """select 'backward' as direction, event_id, match_id from back union all select 'forward', event_id, match_id from ahead
           union all select 'nearest', event_id, case when a.match_ts is null then b.match_id when b.match_ts is null then a.match_id
               when e.ts - b.match_ts <= a.match_ts - e.ts then b.match_id else a.match_id end
             from events e join back b using (event_id) join ahead a using (event_id)""",
        back=_asof("backward"),
        ahead=_asof("forward"),
    ),
)
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    errors = events.where(F.col("event_type") == "error").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("match_id"))
    parts = [
        timeline.asof_join(events.select("event_id", "user_id", "ts"), errors, "ts", "at", ["user_id"], ["match_id"], d).select(
            F.lit(d).alias("direction"), "event_id", "match_id"
        )
        for d in ("backward", "forward", "nearest")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "j2_lookup",
    oracle(
        """select coalesce(carrier_name, AIRLINE) as airline_name, count(*) as n from flights
           left join dim_carrier_name on carrier = AIRLINE group by 1""",
        "flights",
        "dim_carrier_name",
    ),
)
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.broadcast(dims.dim_carrier_name(spark))
    named = lookups.lookup(flights(spark, sf_dir), names, "AIRLINE", "carrier", "carrier_name", "airline_name", F.col("AIRLINE"))
    return named.groupBy("airline_name").agg(F.count(F.lit(1)).alias("n"))


CODES = f"""case l_linenumber%5 when 0 then lpad(cast(l_suppkey as varchar(20)), 3, '0')
    when 1 then concat('x', lpad(cast(l_suppkey as varchar(20)), 3, '0')) when 2 then concat(' K', lpad(cast(l_suppkey as varchar(20)), 3, '0'))
    when 3 then lower({airport('l_suppkey%20')}) else 'ZZZZ' end"""


@query(
    "j3_resolve_airport",
    oracle(
        """select c.code, n, coalesce(i.lat, x.lat, k.lat, a.latitude, 39.82e0) as latitude, coalesce(i.lon, x.lon, k.lon, a.longitude, -98.57e0) as longitude
           from codes c left join world i on i.iata = upper(trim(c.code)) left join world x on x.icao = upper(trim(c.code))
           left join world k on 'K' || k.iata = upper(trim(c.code)) and len(upper(trim(c.code))) = 4
           left join dim_airport a on a.code = upper(trim(c.code))""",
        "dim_airport",
        codes=f"select {CODES} as code, count(*) as n from lineitem group by 1",
        world="""select lpad(cast(s_suppkey as varchar), 3, '0') as iata, 'X' || lpad(cast(s_suppkey as varchar), 3, '0') as icao,
                   cast(s_suppkey%90 as double) as lat, cast(-(s_suppkey%180) as double) as lon from supplier""",
    ),
)
def resolve_airport(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "lineitem").groupBy(F.expr(CODES).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    number = F.lpad(F.col("s_suppkey").cast("string"), 3, "0")
    world = table(spark, sf_dir, "supplier").select(
        number.alias("iata"),
        F.concat(F.lit("X"), number).alias("icao"),
        (F.col("s_suppkey") % 90).cast("double").alias("latitude"),
        (-(F.col("s_suppkey") % 180)).cast("double").alias("longitude"),
    )
    return lookups.resolve_airport(codes, "code", "", world)


PARSED = """
    select request_id, query, q as query_clean, case when digits <> '' then digits else q end as flight_number,
      case when a.icao is not null then a.iata when b.iata is not null then b.iata else 'DL' end as carrier_iata,
      case when a.icao is not null then a.icao when b.iata is not null then b.icao else 'DAL' end as carrier_icao
    from (select *, regexp_extract(q, '[0-9]+', 0) as digits from (select *, upper(replace(trim(query), ' ', '')) as q from requests where mode = 'live') r0) r
    left join dim_carrier a on a.icao = substr(q, 1, 3) left join dim_carrier b on b.iata = substr(q, 1, 2)"""


def parsed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = view(spark, sf_dir, "requests").where(F.col("mode") == "live").select("request_id", "query")
    return lookups.parse_flight_query(live, "query")


@query(
    "j4_parse_flight_query",
    oracle("select *, carrier_icao || flight_number as icao_callsign, carrier_iata || flight_number as iata_flight from parsed", "requests", "dim_carrier", parsed=PARSED),
)
def parse_flight_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_requests(spark, sf_dir)


SCHEDULE = """select AIRLINE, FLIGHT_NUMBER, ORIGIN_AIRPORT, DESTINATION_AIRPORT from normalised
    qualify row_number() over (partition by AIRLINE, FLIGHT_NUMBER order by YEAR, MONTH, DAY, SCHEDULED_DEPARTURE, ORIGIN_AIRPORT,
      DESTINATION_AIRPORT, DEPARTURE_DELAY, CANCELLED, WEATHER_DELAY) = 1"""


@query(
    "j5_schedule_lookup",
    oracle(
        """select request_id, carrier_iata, parsed.flight_number, ORIGIN_AIRPORT as schedule_origin, DESTINATION_AIRPORT as schedule_destination
           from parsed left join schedule on AIRLINE = carrier_iata and schedule.FLIGHT_NUMBER = parsed.flight_number""",
        "normalised", "requests", "dim_carrier", parsed=PARSED, schedule=SCHEDULE,
    ),
)
def schedule_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookups.schedule_lookup(parsed_requests(spark, sf_dir), normalised(spark, sf_dir))
    return found.select("request_id", "carrier_iata", "flight_number", "schedule_origin", "schedule_destination")


TIERS = {
    "asked": "select c_custkey, concat('DL', cast(c_custkey as varchar(20))) as iata_flight from customer",
    "search": f"""select concat('DL', cast(c_custkey as varchar(20))) as iata_flight, lower({airport('c_custkey%20')}) as origin,
        case when c_custkey%2=0 then lower({airport('(c_custkey+3)%20')}) end as destination,
        case when c_custkey%9<>0 then 1700000000+c_custkey*60 end as sched_epoch,
        case when c_custkey%4<>0 then 1700000000+c_custkey*60+(c_custkey%100-30)*45 end as real_epoch
      from customer where c_custkey%3=0""",
    "feed": f"""select concat('DL', cast(c_custkey as varchar(20))) as iata_flight,
        case c_custkey%8 when 0 then 'N/A' when 4 then 'none' else {airport('(c_custkey+1)%20')} end as origin,
        case when c_custkey%12=0 then '' else {airport('(c_custkey+5)%20')} end as destination,
        1700000000+c_custkey as sched_epoch, 1700000000+c_custkey+(c_custkey%50-20)*61 as real_epoch
      from customer where c_custkey%4=0""",
    "second": f"""select concat('DL', cast(c_custkey as varchar(20))) as iata_flight, {airport('(c_custkey+7)%20')} as origin,
        case when c_custkey%10=0 then 'N/A' else lower({airport('(c_custkey+9)%20')}) end as destination,
        case when c_custkey%15=0 then 'unknown' else concat('2024-01-15T0', cast(c_custkey%10 as varchar(20)), ':30:00+00:00') end as scheduled,
        case when c_custkey%20=0 then null else cast(c_custkey%60 as double) + 0.5e0 end as delay,
        case when c_custkey%25=0 then 'active' else 'scheduled' end as status,
        case when c_custkey%2=0 then '2024-01-15T10:00' end as departed, case when c_custkey%4=0 then '2024-01-15T12:00' end as arrived
      from customer where c_custkey%5=0""",
    "timetable": f"""select concat('DL', cast(c_custkey as varchar(20))) as iata_flight, {airport('(c_custkey+2)%20')} as origin,
        {airport('(c_custkey+4)%20')} as destination from customer where c_custkey%7=0""",
}
ROUTE_SQL = """
    select c_custkey, iata_flight, case when o is null or d is null then coalesce(t_o, o) else o end as origin,
      case when o is null or d is null then coalesce(t_d, d) else d end as destination,
      coalesce(case when contains(scheduled, 'T') then substr(replace(split_part(scheduled, 'T', 2), ':', ''), 1, 4) end,
        strftime(make_timestamp(s_sched*1000000), '%H%M'), 'LIVE') as scheduled_departure,
      cast(coalesce(trunc(a_delay), case when trunc((f_real-f_sched)/60) > 0 then trunc((f_real-f_sched)/60) end,
        case when trunc((s_real-s_sched)/60) > 0 then trunc((s_real-s_sched)/60) end, 0) as bigint) as accumulated_delay,
      coalesce(status = 'active' or (departed is not null and arrived is null), false) as active
    from (select q.c_custkey, q.iata_flight, coalesce(upper(s.origin), case when upper(f.origin) not in ('N/A','NONE','') then upper(f.origin) end, upper(a.origin)) as o,
        coalesce(upper(s.destination), case when upper(f.destination) not in ('N/A','NONE','') then upper(f.destination) end,
          case when a.destination <> 'N/A' then upper(a.destination) end) as d,
        t.origin as t_o, t.destination as t_d, a.scheduled, a.delay as a_delay, a.status, a.departed, a.arrived,
        s.sched_epoch as s_sched, s.real_epoch as s_real, f.sched_epoch as f_sched, f.real_epoch as f_real
      from asked q left join search s using (iata_flight) left join feed f using (iata_flight)
      left join second a using (iata_flight) left join timetable t using (iata_flight)) j"""


def _tier(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(TIERS[name].replace("from customer", f"from parquet.`{sf_dir}/customer.parquet`"))


@query("j6_resolve_route", oracle(ROUTE_SQL, **TIERS))
def resolve_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, *tiers = [_tier(spark, sf_dir, n) for n in TIERS]
    return lookups.resolve_route(asked, *tiers)


def _array_of(*entries: Column) -> Column:
    """The JSON texts that are not null, as one JSON array."""
    return F.concat(F.lit("["), F.concat_ws(", ", *entries), F.lit("]"))


def _provider_entry(*, status, iata, scheduled, delay, actual, to, arrived) -> Column:
    """One flight of a provider's answer; absent members are left out."""
    departure = F.struct(iata.alias("iata"), scheduled.alias("scheduled"), delay.alias("delay"), actual.alias("actual"))
    return F.to_json(F.struct(status.alias("flight_status"), departure.alias("departure"), F.struct(to.alias("iata"), arrived.alias("actual")).alias("arrival")))


def route_documents(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tiers' rows as the documents that hold them: hits with others behind them, lists in which
    the flight under way comes second or twice, errors, empty lists, absent members."""
    asked = _tier(spark, sf_dir, "asked")
    number = F.col("c_custkey")
    search = asked.join(_tier(spark, sf_dir, "search"), "iata_flight", "left")
    hit = F.to_json(F.struct(F.concat(F.lit("x"), number.cast("string")).alias("id"), F.struct(F.col("origin").alias("schd_from"), F.col("destination").alias("schd_to")).alias("detail")))
    other = F.lit('{"id": "other", "detail": {"schd_from": "ZZZ", "schd_to": "YYY"}}')
    answer = F.when(F.col("origin").isNotNull(), F.concat(F.lit('{"results": '), _array_of(hit, F.when(number % 2 == 0, other)), F.lit("}")))
    answer = F.coalesce(answer, F.when(number % 2 == 0, '{"results": []}').when(number % 5 == 0, "no json"), F.lit("{}"))
    times = F.to_json(F.struct(F.struct(F.struct(F.col("sched_epoch").alias("departure")).alias("scheduled"), F.struct(F.col("real_epoch").alias("departure")).alias("real")).alias("time")))
    second = asked.join(_tier(spark, sf_dir, "second"), "iata_flight", "left")
    none = F.lit(None).cast("string")
    entry = _provider_entry(
        status=F.col("status"), iata=F.col("origin"), scheduled=F.col("scheduled"), delay=F.col("delay"), actual=F.col("departed"), to=F.col("destination"), arrived=F.col("arrived")
    )
    decoy = lambda status: _provider_entry(status=F.lit(status), iata=F.lit("ZZZ"), scheduled=F.lit("2024-01-15T23:59"), delay=F.lit(999.0), actual=none, to=F.lit("YYY"), arrived=none)
    active = F.col("status") == "active"
    listed = _array_of(F.when(active, decoy("landed")), entry, F.when(active, decoy("active")), F.when(~active & (number % 3 == 0), decoy("landed")))
    provider = F.when(F.col("status").isNotNull(), F.concat(F.lit('{"pagination": {"count": 1}, "data": '), listed, F.lit("}")))
    provider = F.coalesce(provider, F.when(number % 2 == 0, '{"error": {"code": "limit", "info": ["x"]}}').when(number % 3 == 0, '{"data": []}'), F.lit('{"data": null}'))
    return {
        "search": search.select("iata_flight", answer.alias("payload")),
        "times": search.where(F.col("origin").isNotNull()).select(F.concat(F.lit("x"), number.cast("string")).alias("detail_id"), times.alias("payload")),
        "second": second.select("iata_flight", provider.alias("payload")),
    }


@query("j6_route_documents", oracle(ROUTE_SQL, **TIERS))
def resolve_route_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same routes from the nested documents of the outer tiers."""
    documents = route_documents(spark, sf_dir)
    times = feeds.parse_flight_times(documents["times"], "detail_id")
    search = feeds.with_times(feeds.parse_route_search(documents["search"], "iata_flight"), times, "detail_id").drop("detail_id")
    second = feeds.parse_route_list(documents["second"], "iata_flight")
    return lookups.resolve_route(_tier(spark, sf_dir, "asked"), search, _tier(spark, sf_dir, "feed"), second, _tier(spark, sf_dir, "timetable"))


HUB_SQL = """
    select request_id, icao_callsign, hubs[cast(i1 + 1 as int)] as origin,
      hubs[cast(case when i1 = i2 then (i2 + 1) % len(hubs) else i2 end + 1 as int)] as destination
    from (select request_id, icao_callsign, hubs, cast(h % n as int) as i1, cast((h // n) % n as int) as i2
      from (select request_id, carrier_icao || flight_number as icao_callsign, cast(len(coalesce(b.hubs, o.hubs)) as uhugeint) as n, cast('0x' || md5(carrier_icao || flight_number) as uhugeint) as h,
              coalesce(b.hubs, o.hubs) as hubs
            from parsed left join dim_hub b on b.carrier = carrier_iata, (select hubs from dim_hub where carrier = '*') o) x) y"""


@query("j7_hub_fallback", oracle(HUB_SQL, "requests", "dim_carrier", "dim_hub", parsed=PARSED))
def hub_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.hub_fallback(parsed_requests(spark, sf_dir)).select("request_id", "icao_callsign", "origin", "destination")


POSITION_ASKED = """select c_custkey, concat('DAL', cast(c_custkey%200 as varchar(20))) as icao_callsign,
    concat('DL', cast(c_custkey%200 as varchar(20))) as iata_flight, concat('DAL', cast((c_custkey*7)%150 as varchar(20))) as query_clean from customer"""


@query(
    "j8_match_position",
    oracle(
        """select a.c_custkey, f.event_id as live_event_id, s.callsign as live_callsign, s.lat as live_lat
           from asked a left join (
             select c_custkey, min(event_id) as event_id from asked join (select callsign, min(event_id) as event_id from state_vectors group by callsign) p
               on callsign in (icao_callsign, iata_flight, query_clean) or starts_with(callsign, icao_callsign) group by c_custkey) f using (c_custkey)
           left join state_vectors s on s.event_id = f.event_id""",
        "state_vectors",
        asked=POSITION_ASKED,
    ),
)
def match_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.sql(POSITION_ASKED.replace("from customer", f"from parquet.`{sf_dir}/customer.parquet`"))
    vectors = view(spark, sf_dir, "state_vectors")
    return lookups.match_position(asked, vectors, ["event_id"], ["event_id", "lat"]).select(
        "c_custkey", "live_event_id", "live_callsign", "live_lat"
    )


@query(
    "j9_join_events",
    oracle(
        """select DEST as destination, count(*) as n, coalesce(max(payload->'$.groundStop'->>'$.reason'), '-') as stop_reason,
             coalesce(max(payload->'$.groundDelay'->>'$.reason'), '-') as hold_reason,
             coalesce(max(payload->'$.arrivalDelay'->>'$.reason'), '-') as arrival_reason
           from flights left join (select * from airport_events qualify row_number() over (partition by airport_id order by seq) = 1) e on airport_id = DEST group by DEST""",
        "flights",
        "airport_events",
    ),
)
def join_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = feeds.parse_airport_events(view(spark, sf_dir, "airport_events"), keep=("seq",))
    arrivals = flights(spark, sf_dir).groupBy(F.lower("DEST").alias("destination")).agg(F.count(F.lit(1)).alias("n"))
    joined = lookups.join_events(arrivals, events)
    return joined.select(
        F.upper("destination").alias("destination"),
        "n",
        *[F.coalesce(f"programme.{p}.reason", F.lit("-")).alias(a) for p, a in (("groundStop", "stop_reason"), ("groundDelay", "hold_reason"), ("arrivalDelay", "arrival_reason"))],
    )


@query(
    "j10_known_and_pending",
    oracle(
        """select 'known' as state, o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0)
           union all select 'pending', o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)"""
    ),
)
def known_and_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    funded = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0)
    known = lookups.known(orders, funded, "o_custkey", "c_custkey").select(F.lit("known").alias("state"), "o_orderkey")
    pending = lookups.pending(orders, funded, "o_custkey", "c_custkey").select(F.lit("pending").alias("state"), "o_orderkey")
    return known.unionByName(pending)


@query(
    "j11_resolve_report",
    oracle(
        """select code, n, coalesce(r.report, case when len(code) = 4 then upper(code) else 'K' || upper(code) end
               || ' AUTO 10SM CLR 22/15 A3000 RMK AO2 ROUTINE OPERATIONAL METAR') as report
           from (select case when FL_NUMBER%10 = 0 then 'PANC' when FL_NUMBER%10 = 1 then lower(ORIGIN) else ORIGIN end as code, count(*) as n from flights group by 1) f
           left join newest r on r.station = case when len(code) = 4 then upper(code) else 'K' || upper(code) end""",
        "flights",
        reports=REPORTS_SQL,
        newest="select station, arg_max(metar, valid) as report from reports group by station",
    ),
)
def resolve_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.when(F.col("FL_NUMBER") % 10 == 0, "PANC").when(F.col("FL_NUMBER") % 10 == 1, F.lower("ORIGIN")).otherwise(F.col("ORIGIN"))
    codes = flights(spark, sf_dir).groupBy(mixed.alias("code")).agg(F.count(F.lit(1)).alias("n"))
    every = reports(spark, sf_dir).withColumnRenamed("metar", "report")
    nothing = every.select("station", F.lit("").alias("report"))
    return lookups.resolve_report(codes, "code", [nothing, every], "report")


ENCODER_COLUMNS = ("AIRLINE", "ORIGIN", "DEST", "FL_NUMBER", "ROUTE")
ENCODER_SQL = {
    "rows": "select AIRLINE, ORIGIN, DEST, cast(FL_NUMBER as varchar) as FL_NUMBER, ORIGIN || '_' || DEST as ROUTE, DEP_DELAY as y from flights where DEP_DELAY between -30 and 720",
    "encoder": "select * from ("
    + " union all ".join(
        f"""select '{c}' as "column", {c} as key, (count(*)*avg(y) + 10e0*(select avg(y) from rows)) / (count(*) + 10e0) as value from rows group by {c}
            union all select '{c}', '_GLOBAL_MEAN_', avg(y) from rows"""
        for c in ENCODER_COLUMNS
    )
    + ")",
}


def encoder_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaning.clean_target(flights(spark, sf_dir), "DEP_DELAY")
    return rows.withColumns({"ROUTE": F.concat("ORIGIN", F.lit("_"), "DEST"), "FL_NUMBER": F.col("FL_NUMBER").cast("string")})


@query("a1_fit_encoder", oracle("select * from encoder", "flights", **ENCODER_SQL))
def fit_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.fit_encoder(encoder_rows(spark, sf_dir), "DEP_DELAY", ENCODER_COLUMNS)


@query(
    "a2_weather_profile",
    oracle(
        """select coalesce(ORIGIN_AIRPORT, '_GLOBAL_MEAN_') as airport, avg(WEATHER_DELAY) as mean_delay
           from normalised where WEATHER_DELAY > 0 group by rollup(ORIGIN_AIRPORT)""",
        "normalised",
    ),
)
def weather_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.weather_profile(normalised(spark, sf_dir))


@query(
    "a3_regression_metrics",
    oracle(
        """select round(avg(abs(DEP_DELAY - CRS_ELAPSED_TIME)), 6) as mae, round(sqrt(avg((DEP_DELAY - CRS_ELAPSED_TIME)*(DEP_DELAY - CRS_ELAPSED_TIME))), 6) as rmse,
             count(DEP_DELAY - CRS_ELAPSED_TIME) as n from flights""",
        "flights",
    ),
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = aggregates.regression_metrics(flights(spark, sf_dir), "DEP_DELAY", "CRS_ELAPSED_TIME")
    return measured.withColumns({c: F.round(c, 6) for c in ("mae", "rmse")})


CAUSES = """case FL_NUMBER%5 when 0 then 'Severe Weather at Destination' when 1 then 'Snow and ice' when 2 then 'Late aircraft'
    when 3 then null else 'Thunderstorm' end"""


@query(
    "a4_cause_accuracy",
    oracle(
        f"""select avg(case when (DELAY_DUE_WEATHER > 0) = (coalesce(regexp_matches(lower({CAUSES}), 'weather|storm|snow'), false)) then 1e0 else 0e0 end) as accuracy,
              count(*) as n from flights""",
        "flights",
    ),
)
def cause_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = flights(spark, sf_dir).withColumn("cause", F.expr(CAUSES))
    return aggregates.cause_accuracy(named, "DELAY_DUE_WEATHER", "cause")


CITED = "case FL_NUMBER%3 when 0 then 'Guidance on Winter STORM operations' when 1 then 'Weather services' else 'Ground stop procedures' end"


@query(
    "a5_citation_relevance",
    oracle(
        f"""select avg(case when coalesce(regexp_matches(lower({CAUSES}), 'weather|storm|snow'), false)
                then case when regexp_matches(lower({CITED}), 'weather|storm|snow') then 1e0 else 0e0 end
                else case when contains(lower({CITED}), 'weather') then 0e0 else 1e0 end end) as relevance, count(*) as n from flights""",
        "flights",
    ),
)
def citation_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = flights(spark, sf_dir).withColumns({"cause": F.expr(CAUSES), "citations": F.array(F.lit("[1]"), F.expr(CITED))})
    return aggregates.citation_relevance(cited, "cause", "citations")


@query(
    "a7_snapshot_summary",
    oracle(
        """select snapshot, max(total) as total, count(*) as kept, count(*) filter (where is_landing) as landing from (
             select event_id // 50 as snapshot, count(*) over (partition by event_id // 50) as total, event_id, lon, lat,
               (not on_ground and coalesce(alt_m < 3048, false) and coalesce(vert_rate < -1, false)) as is_landing from state_vectors) t
           where event_id%29 <> 0 and lon is not null and lat is not null group by snapshot""",
        "state_vectors",
    ),
)
def snapshot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = feeds.parse_state_vectors(snapshots(spark, sf_dir), keep=("snapshot",))
    return aggregates.snapshot_summary(kept, ["snapshot"], "total")


@query(
    "a8_exact_median",
    oracle(
        "select 'DISTANCE' as column_name, median(DISTANCE) as median from flights union all select 'DEP_DELAY', median(DEP_DELAY) from flights union all select 'price', median(l_extendedprice) from lineitem",
        "flights",
    ),
)
def exact_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flights_over(table(spark, sf_dir, "lineitem"), "l_extendedprice as price")
    medians = cleaning.exact_medians(rows, ["DISTANCE", "DEP_DELAY", "price"])
    return dims.inline_table(spark, ["column_name", "median"], list(medians.items()))


@query(
    "w2_first_by",
    "select o_custkey, o_orderkey, o_orderdate from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1",
)
def first_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return ordering.first_by(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    "w3_cascade",
    oracle(
        """select tail, fl_day, leg, own_delay, slack, cast(s - least(0, min(s) over w) as bigint) as carried_delay,
             cast(s - least(0, min(s) over w) + own_delay as bigint) as total_delay
           from (select *, sum(own_delay - slack) over w - own_delay as s from legs window w as (partition by tail order by fl_day nulls first, leg)) t
           window w as (partition by tail order by fl_day nulls first, leg)""",
        "legs",
    ),
)
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.cascade(view(spark, sf_dir, "legs"), "tail", ["leg"], "own_delay", "slack", "fl_day")


@query(
    "w4_leg_cause",
    oracle(
        """select tail, fl_day, leg, case when row_number() over (partition by tail order by fl_day nulls first, leg) = 1 then 'Weather' else 'Late Aircraft' end as leg_cause from legs""",
        "legs",
    ),
)
def leg_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.leg_cause(view(spark, sf_dir, "legs"), "tail", ["fl_day", "leg"]).select("tail", "fl_day", "leg", "leg_cause")


@query(
    "w5_topk",
    """select o_custkey, o_orderkey, o_totalprice, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as int) as rank from orders
       qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3""",
)
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ordering.topk(orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)


@query(
    "l2_historical_flights",
    oracle(
        """select AIRLINE || '|' || FLIGHT_NUMBER || '|' || strftime(make_date(YEAR, MONTH, DAY), '%Y-%m-%d') as id,
             cast(trunc(DEPARTURE_DELAY) as int) as delay
           from normalised where ORIGIN_AIRPORT = 'ATL' and DEPARTURE_DELAY > 15
           order by md5(concat_ws('|', '42', AIRLINE, FLIGHT_NUMBER, cast(YEAR as varchar), cast(MONTH as varchar), cast(DAY as varchar))),
             AIRLINE, FLIGHT_NUMBER, YEAR, MONTH, DAY, SCHEDULED_DEPARTURE, DESTINATION_AIRPORT, DEPARTURE_DELAY limit 5""",
        "normalised",
    ),
)
def historical_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five delayed flights of an airport, as offered for a closer look."""
    late = cleaning.delayed(normalised(spark, sf_dir), "DEPARTURE_DELAY", 15, ORIGIN_AIRPORT="ATL")
    few = ordering.sample_n(
        late, 5, ["AIRLINE", "FLIGHT_NUMBER", "YEAR", "MONTH", "DAY"],
        tie_break=["SCHEDULED_DEPARTURE", "DESTINATION_AIRPORT", "DEPARTURE_DELAY"],
    )
    return cleaning.flight_label(few).select("id", "delay")


@query("u1_all_airports", oracle("select ORIGIN as airport from flights union select DEST from flights", "flights"))
def all_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.all_airports(flights(spark, sf_dir))


@query(
    "m1_encode",
    oracle(
        """select f.FL_DATE, """
        + ", ".join(f"coalesce(e{i}.value, g.value) as {c}" for i, c in enumerate(ENCODER_COLUMNS))
        + " from (select FL_DATE, case when FL_NUMBER%50=0 then 'ZZ' else AIRLINE end as AIRLINE, ORIGIN, DEST, cast(FL_NUMBER as varchar) as FL_NUMBER, ORIGIN || '_' || DEST as ROUTE from flights) f "
        + " ".join(f"""left join encoder e{i} on e{i}."column" = '{c}' and e{i}.key = f.{c}""" for i, c in enumerate(ENCODER_COLUMNS))
        + ", (select max(value) as value from encoder where key = '_GLOBAL_MEAN_') g",
        "flights",
        **ENCODER_SQL,
    ),
)
def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flights(spark, sf_dir).select(
        "FL_DATE", F.when(F.col("FL_NUMBER") % 50 == 0, "ZZ").otherwise(F.col("AIRLINE")).alias("AIRLINE"), "ORIGIN", "DEST",
        "FL_NUMBER", F.concat("ORIGIN", F.lit("_"), "DEST").alias("ROUTE"),
    )
    # Read once per column, so it is stored first.
    encoder = tables.save_table(fit_encoder(spark, sf_dir), new_folder(spark, "encoder"))
    return aggregates.encode(rows, encoder, ENCODER_COLUMNS)


