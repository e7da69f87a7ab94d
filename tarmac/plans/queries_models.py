"""Queries over delay models and whole analyses.

All trees have the library's own settings. What is fitted on a table is fitted once per session:
its encoder, encoded rows and models are stored and read again. The SQL of the model queries
checks what must hold whatever the trees are: which rows are held out, what each was scored with,
that predictions are numbers, that a stored model scores like the one in memory.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import aggregates, holidays, lookups, models, retrieval
from tarmac.operators.cleaning import normalise
from tarmac.plans.analyze import Sources, analyze, prompt_text
from tarmac.plans.evaluate import evaluate, recorded_flights
from tarmac.plans.queries_joins import PARSED, SCHEDULE
from tarmac.plans.queries_rows import LOOKUP_SQL, LOOKUP_STEPS, TRAINING, feature_rows
from tarmac.plans.queries_rules import LOW, PROGRAMME_SQL, TODAY, WEATHER_STEPS, _quoted, day_and_now, risk_sql
from tarmac.plans.queries_search import corpus
from tarmac.plans.queries_sources import REPORTS_SQL, reports, snapshots
from tarmac.plans.registry import query
from tarmac.plans.views import flights, oracle, table, view
from tarmac.sources import dimensions as dims
from tarmac.sources import feeds, tables
from tarmac.sources import fixed_values as fixed
from tarmac.workspace import new_folder

KEY = ("AIRLINE", "FLIGHT_NUMBER", "MONTH", "DAY", "TIME_OF_DAY", "ROUTE")
_made: dict[tuple[str, str, str], str] = {}


def named_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows with full airline names."""
    names = F.broadcast(dims.dim_carrier_name(spark))
    return lookups.lookup(feature_rows(spark, sf_dir), names, "AIRLINE", "carrier", "carrier_name", "AIRLINE", F.col("AIRLINE"))


def _once(spark: SparkSession, sf_dir: str, what: str, make) -> str:
    """The folder that `make` has filled, once per session and table."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _made:
        folder = new_folder(spark, what)
        make(folder)
        _made[key] = folder
    return _made[key]


def training_folder(spark: SparkSession, sf_dir: str) -> str:
    return _once(spark, sf_dir, "training", lambda f: models.training_table(named_rows(spark, sf_dir), KEY, folder=f))


def prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(encoder, encoded rows) of the whole table."""
    folder = training_folder(spark, sf_dir)
    return spark.read.parquet(f"{folder}/encoder"), spark.read.parquet(f"{folder}/prepared")


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Encoded rows to learn from, in bounded shares, and those held out."""
    rows = models.read_shares(spark, f"{training_folder(spark, sf_dir)}/prepared")
    return rows.where(~F.col("_test")), prepared(spark, sf_dir)[1].where(F.col("_test"))


def delay_model(spark: SparkSession, sf_dir: str) -> PipelineModel:
    train, _ = parts(spark, sf_dir)
    folder = _once(spark, sf_dir, "model", lambda f: models.save_model(models.fit_delay(train, valid="_valid"), f))
    return models.load_model(spark, folder)


def two_models(spark: SparkSession, sf_dir: str) -> tuple[PipelineModel, PipelineModel]:
    def make(folder: str) -> None:
        for model, name in zip(models.fit_two_stage(parts(spark, sf_dir)[0], valid="_valid"), ("late", "minutes")):
            models.save_model(model, f"{folder}/{name}")

    folder = _once(spark, sf_dir, "two_stage", make)
    return models.load_model(spark, f"{folder}/late"), models.load_model(spark, f"{folder}/minutes")


# The held-out rows: key and recorded delay of every training row whose hash falls into the fifth.
HELD_OUT = {
    "keyed": """select coalesce(carrier_name, AIRLINE) || '|' || cast(FL_NUMBER as varchar) || '|' || cast(month(FL_DATE) as varchar) || '|' || cast(day(FL_DATE) as varchar)
          || '|' || cast(CRS_DEP_TIME // 100 * 60 + CRS_DEP_TIME % 100 as varchar) || '|' || ORIGIN || '_' || DEST as flight, DEP_DELAY as delay
        from training left join dim_carrier_name on carrier = AIRLINE""",
    "held": "select * from keyed where cast('0x' || substring(md5('42|' || flight), 1, 8) as bigint) % 100 < 20",
    "learnt": "select * from keyed where cast('0x' || substring(md5('42|' || flight), 1, 8) as bigint) % 100 >= 20",
}


def held_out_sql(text: str) -> str:
    return oracle(text, "flights", "dim_carrier_name", training=TRAINING, **HELD_OUT)


def is_number(column: str) -> Column:
    return (F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) < 1e6)).alias(column)


# A model is held against the constant that is best for absolute errors, the median of the rows learnt from.
CONSTANT = """cast(count(*) as bigint) as rows, avg(abs(delay - (select median(delay) from learnt))) as constant_mae"""


def against_constant(train: DataFrame, test: DataFrame, model: PipelineModel) -> DataFrame:
    """Held-out rows, the absolute error of the constant there, and whether the model's errors are what they may be:
    under the constant's on the rows learnt from, at most a quarter above it on the others.
    """
    constant = F.lit(train.agg(F.median(models.TARGET)).first()[0])
    miss = F.avg(F.abs(F.col(models.TARGET) - constant))
    learnt, held = (aggregates.regression_metrics(models.score(df, model), models.TARGET, "prediction").first() for df in (train, test))
    before = train.agg(miss).first()[0]
    base = test.agg(F.count(F.lit(1)).alias("rows"), miss.alias("constant_mae"))
    return base.select(
        "rows", "constant_mae", F.lit(learnt["mae"] < before).alias("learns"), (F.lit(held["mae"]) <= 1.25 * F.col("constant_mae")).alias("near_constant"), F.lit(held["rmse"] >= held["mae"]).alias("ordered")
    )


@query("m2_fit_delay", held_out_sql(f"select {CONSTANT}, true as learns, true as near_constant, true as ordered from held"))
def fit_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors on the held-out rows, beside those of the training part's median."""
    return against_constant(*parts(spark, sf_dir), delay_model(spark, sf_dir))


@query("m2_fit_delay_linear", held_out_sql(f"select {CONSTANT}, true as ordered from held"))
def fit_delay_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = parts(spark, sf_dir)
    return against_constant(train, test, models.fit_delay_linear(train)).select("rows", "constant_mae", "ordered")


@query("m3_score_two_stage", held_out_sql("select flight, delay, true as prediction, true as late_or_none from held"))
def score_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows; a prediction is 0 or what a flight late by over 15 minutes is given."""
    scored = models.score_two_stage(parts(spark, sf_dir)[1], *two_models(spark, sf_dir))
    return scored.select(F.col("_key").alias("flight"), F.col(models.TARGET).alias("delay"), is_number("prediction"), ((F.col("prediction") == 0) | (F.col("prediction") > 0)).alias("late_or_none"))


@query(
    "m3_two_stage_rule",
    "select l_orderkey, l_linenumber, round(case when l_discount*5 >= 0.38e0 then exp(l_tax*20)-1 else 0e0 end, 6) as minutes from lineitem",
)
def two_stage_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = models.two_stage(F.col("l_discount") * 5, F.col("l_tax") * 20)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(minutes, 6).alias("minutes"))


@query("m4_score", held_out_sql("select flight, delay, true as predicted_delay from held"))
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = models.score(parts(spark, sf_dir)[1], delay_model(spark, sf_dir), "predicted_delay")
    return scored.select(F.col("_key").alias("flight"), F.col(models.TARGET).alias("delay"), is_number("predicted_delay"))


@query("m5_train_and_evaluate", held_out_sql(f"select {CONSTANT}, true as learns, true as near_constant, true as ordered from held"))
def train_and_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run, from raw flights to errors on the held-out part."""
    folder = new_folder(spark, "run")
    report = models.train_and_evaluate(named_rows(spark, sf_dir), KEY, folder=folder)
    rows = models.read_shares(spark, f"{folder}/prepared")
    return against_constant(rows.where(~F.col("_test")), rows.where(F.col("_test")), report.model)


@query("m6_score_scenarios", f"select unnest([{', '.join(_quoted(row[0]) for row in fixed.SCENARIOS)}]) as name, true as prediction")
def score_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder, _ = prepared(spark, sf_dir)
    return models.score_scenarios(models.scenarios(spark), encoder, delay_model(spark, sf_dir)).select("name", is_number("prediction"))


@query("s11_save_and_load_model", held_out_sql("select flight, delay, true as same from held"))
def save_and_load_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows, and whether the stored model scores each like the one in memory."""
    model, path = delay_model(spark, sf_dir), new_folder(spark, "model")
    models.save_model(model, path)
    test = parts(spark, sf_dir)[1]
    both = models.score(models.score(test, model, "first"), models.load_model(spark, path), "second")
    return both.select(F.col("_key").alias("flight"), F.col(models.TARGET).alias("delay"), (F.col("first") == F.col("second")).alias("same"))


def newest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).groupBy("station").agg(F.max_by("metar", "valid").alias("report"))


def basic_sources(spark: SparkSession, sf_dir: str, **more) -> Sources:
    now, day = day_and_now(spark, sf_dir)
    return Sources(
        history=normalise(flights(spark, sf_dir)),
        hourly=view(spark, sf_dir, "weather_hourly"),
        calendar=holidays.us_holidays(spark, 2023, 2024),
        now_weather=now,
        day_weather=day,
        programmes=feeds.parse_airport_events(view(spark, sf_dir, "airport_events"), keep=("seq",)),
        today=TODAY,
        current_reports=[newest_reports(spark, sf_dir)],
        **more,
    )


HUBS = """select t.*, hubs[cast(h % n as int) + 1] as hub1,
    hubs[cast(case when (h // n) % n = h % n then ((h // n) + 1) % n else (h // n) % n end as int) + 1] as hub2
  from (select p.*, coalesce(b.hubs, o.hubs) as hubs, cast(len(coalesce(b.hubs, o.hubs)) as uhugeint) as n,
          cast('0x' || md5(carrier_icao || p.flight_number) as uhugeint) as h
        from parsed p left join dim_hub b on b.carrier = carrier_iata, (select hubs from dim_hub where carrier = '*') o) t"""
ANALYZE_STEPS = {
    **LOOKUP_STEPS,
    "looked_up": LOOKUP_SQL,
    "parsed": PARSED,
    "schedule": SCHEDULE,
    "hubs": HUBS,
    **WEATHER_STEPS,
    "reports": REPORTS_SQL,
    "newest": "select station, arg_max(metar, valid) as report from reports group by station",
    "programmes": PROGRAMME_SQL,
    "found": f"""
        select request_id, 'historical' as mode, strftime(make_date(YEAR, MONTH, DAY), '%Y-%m-%d') as timestamp, AIRLINE || FLIGHT_NUMBER as flight_id,
          AIRLINE as carrier, ORIGIN_AIRPORT as origin, DESTINATION_AIRPORT as destination, cast(SCHEDULED_DEPARTURE as varchar) as scheduled_departure,
          'Delayed ' || cast(DEPARTURE_DELAY as varchar) || ' mins' as status, cast(trunc(DEPARTURE_DELAY) as bigint) as actual_delay_minutes from looked_up
        union all
        select request_id, 'live', '{TODAY}', carrier_icao || hubs.flight_number, carrier_iata, coalesce(ORIGIN_AIRPORT, hub1), coalesce(DESTINATION_AIRPORT, hub2),
          'LIVE', 'Scheduled (Route: ' || coalesce(ORIGIN_AIRPORT, hub1) || ' -> ' || coalesce(DESTINATION_AIRPORT, hub2) || ')', null
        from hubs left join schedule on AIRLINE = carrier_iata and schedule.FLIGHT_NUMBER = hubs.flight_number""",
    "weathered": f"""
        select f.*, {risk_sql("case when live then no.weather_code else xo.weathercode end", "case when live and no.airport is null then 8 when live then no.windspeed_10m else xo.windspeed_10m_max end",
                              "case when live then no.precipitation else xo.precipitation_sum end")} as origin_risk,
          {risk_sql("case when live then nd.weather_code else xd.weathercode end", "case when live and nd.airport is null then 8 when live then nd.windspeed_10m else xd.windspeed_10m_max end",
                    "case when live then nd.precipitation else xd.precipitation_sum end")} as dest_risk
        from (select *, timestamp = '{TODAY}' as live from found) f
        left join now_weather no on no.airport = f.origin left join now_weather nd on nd.airport = f.destination
        left join day_weather xo on xo.airport = f.origin and strftime(xo.date, '%Y-%m-%d') = f.timestamp
        left join day_weather xd on xd.airport = f.destination and strftime(xd.date, '%Y-%m-%d') = f.timestamp""",
    "judged": """select w.*, cast(case when 'High' in (origin_risk, dest_risk) then 90 when 'Moderate' in (origin_risk, dest_risk) then 30 else 0 end as bigint) as delay,
        case when 'High' in (origin_risk, dest_risk) then 0.70e0 when 'Moderate' in (origin_risk, dest_risk) then 0.60e0 else 0.80e0 end as base_confidence from weathered w""",
    "advised": f"""select j.*, coalesce(p.active_notam, false) as active, coalesce(p.notam_type, 'None') as notam_type,
        cast(coalesce(p.delay_penalty_minutes, 0) as bigint) as penalty,
        case when coalesce(p.active_notam, false) then 'programme' when delay > 15 and {LOW} then 'inherited' when delay > 15 then 'at_risk' else 'routine' end as s
      from judged j left join programmes p on p.destination = j.destination""",
}
ANALYZE_SQL = f"""
    select request_id, mode, timestamp, flight_id, carrier, origin, destination, scheduled_departure, status, origin_risk, dest_risk,
      coalesce(ro.report, 'K' || origin || ' {fixed.ROUTINE_REPORT}') as raw_origin, coalesce(rd.report, 'K' || destination || ' {fixed.ROUTINE_REPORT}') as raw_dest,
      delay, case when active then 0.95e0 else base_confidence end as confidence,
      case when delay < 15 and {LOW} then 'None' when delay > 15 and {LOW} then 'Inherited Ground Delay' else 'Weather/Congestion' end as primary_cause,
      case when delay < 15 and {LOW} then {_quoted(fixed.CITATION_ROUTINE)} when delay > 15 and {LOW} then {_quoted(fixed.CITATION_INHERITED)}
        else {_quoted(fixed.CITATION_NO_CORPUS)} end as citation,
      notam_type, penalty, action, actual_delay_minutes
    from advised join dim_recommendation on situation = s
    left join newest ro on ro.station = 'K' || origin left join newest rd on rd.station = 'K' || destination"""


def flat_event(events: DataFrame) -> DataFrame:
    return events.select(
        "request_id", "mode", "timestamp", "flight.flight_id", "flight.carrier", "flight.origin", "flight.destination",
        "flight.scheduled_departure", "flight.status", "weather.origin_risk", "weather.dest_risk", "metar.raw_origin", "metar.raw_dest",
        F.col("risk.predicted_delay_minutes").alias("delay"), F.col("risk.confidence_score").alias("confidence"),
        "root_cause.primary_cause", F.col("root_cause.faa_citations")[0].alias("citation"),
        "notam.notam_type", F.col("notam.delay_penalty_minutes").alias("penalty"), "recommendation.action",
        "ground_truth.actual_delay_minutes",
    )


@query(
    "analyze",
    oracle(ANALYZE_SQL, "normalised", "requests", "dim_carrier", "dim_hub", "weather_hourly", "airport_events", "dim_recommendation", **ANALYZE_STEPS),
)
def analyze_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request analysed without a model, by the rules alone."""
    return flat_event(analyze(view(spark, sf_dir, "requests"), basic_sources(spark, sf_dir)))


def full_sources(spark: SparkSession, sf_dir: str, two_stage: bool = False) -> tuple[DataFrame, Sources]:
    """Requests and sources with a model (or the two-stage pair), positions, a searchable corpus and replies."""
    requests = view(spark, sf_dir, "requests")
    encoder, _ = prepared(spark, sf_dir)
    fitted: dict[str, PipelineModel] = {}
    if two_stage:
        fitted["classifier"], fitted["late_model"] = two_models(spark, sf_dir)
    else:
        fitted["model"] = delay_model(spark, sf_dir)
    documents = corpus(spark, sf_dir).drop("vector")
    text = documents.withColumn("text", retrieval.corpus_text(F.col("title"), F.col("content")))
    embedder = retrieval.fit_text_embedder(text, "text")
    documents = tables.save_table(retrieval.embed(text, "text", embedder, "vector").drop("text"), new_folder(spark, "corpus"))
    # A reply for two requests in three; its search text is a document's own text.
    searched = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = requests.where(F.col("request_id") % 3 != 0).select("request_id", (F.col("request_id") % searched.select(F.max("doc_id") + 1).scalar()).alias("doc_id"))
    wanted = asked.join(searched, "doc_id", "left")
    replies = wanted.select(
        "request_id",
        F.to_json(F.struct(F.lit("Storm over the field").alias("primary_cause"), F.lit("Congestion").alias("secondary_cause"), F.col("text").alias("search_query"))).alias("cause_text"),
        F.when(F.col("request_id") % 5 == 0, F.lit('{"Action": "REROUTE"}')).alias("action_text"),
    )
    day = lookups.first_report(reports(spark, sf_dir), "station", "valid", "metar")
    positions = feeds.parse_state_vectors(snapshots(spark, sf_dir), keep=("snapshot",))
    profile = aggregates.weather_profile(flights(spark, sf_dir), "ORIGIN", "DELAY_DUE_WEATHER")
    sources = basic_sources(
        spark, sf_dir, **fitted, encoder=encoder, profile=profile, positions=positions,
        position_order=("snapshot", "callsign", "lat", "lon"), corpus=documents, embedder=embedder,
        replies=replies, day_reports=day,
    )
    return requests, sources


# What does not depend on the trees: who is asked about, the weather, the programme, the outcome.
WITH_MODEL_SQL = f"""
    select request_id, mode, timestamp, carrier, origin, destination, scheduled_departure, origin_risk, dest_risk, notam_type, penalty, actual_delay_minutes,
      true as delay, true as confidence, true as explained from ({ANALYZE_SQL}) a"""
MODEL_ORACLE = oracle(WITH_MODEL_SQL, "normalised", "requests", "dim_carrier", "dim_hub", "weather_hourly", "airport_events", "dim_recommendation", **ANALYZE_STEPS)


def checked_event(events: DataFrame) -> DataFrame:
    """An event's facts, and whether delay, confidence, cause and action are what they may be."""
    flat = flat_event(events)
    return flat.select(
        "request_id", "mode", "timestamp", "carrier", "origin", "destination", "scheduled_departure", "origin_risk", "dest_risk", "notam_type", "penalty", "actual_delay_minutes",
        F.coalesce(F.col("delay") >= 0, F.lit(False)).alias("delay"),
        F.coalesce(F.col("confidence").between(0.5, 0.95), F.lit(False)).alias("confidence"),
        F.coalesce((F.length("primary_cause") > 0) & (F.length("citation") > 0) & (F.length("action") > 0), F.lit(False)).alias("explained"),
    )


@query("analyze_with_model", MODEL_ORACLE)
def analyze_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked_event(analyze(*full_sources(spark, sf_dir)))


@query("analyze_two_stage", MODEL_ORACLE)
def analyze_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late or not first, then minutes of the late."""
    return checked_event(analyze(*full_sources(spark, sf_dir, two_stage=True)))


SAMPLED = 500
RECORDED = """select AIRLINE || '|' || FLIGHT_NUMBER || '|' || strftime(make_date(YEAR, MONTH, DAY), '%Y-%m-%d') as query, DEPARTURE_DELAY, WEATHER_DELAY
    from normalised where DEPARTURE_DELAY > 15 and DEPARTURE_DELAY < 180
    qualify row_number() over (partition by AIRLINE, FLIGHT_NUMBER, YEAR, MONTH, DAY
      order by SCHEDULED_DEPARTURE, ORIGIN_AIRPORT, DESTINATION_AIRPORT, DEPARTURE_DELAY, CANCELLED, WEATHER_DELAY) = 1"""
EVALUATE_STEPS = {
    "recorded": RECORDED,
    "drawn": f"select * from recorded order by md5('42|' || query), query limit {SAMPLED}",
    "requests": "select row_number() over (order by query) - 1 as request_id, 'historical' as mode, * from drawn",
}
# The rules' analysis of the sample against what was recorded.
EVALUATE_SQL = f"""
    select avg(abs(actual - delay)) as mae, sqrt(avg((actual - delay) * (actual - delay))) as rmse, count(*) as n,
      avg(case when (minutes > 0) = weather then 1e0 else 0e0 end) as accuracy,
      avg(case when case when weather then regexp_matches(cited, 'weather|storm|snow') else not contains(cited, 'weather') end then 1e0 else 0e0 end) as relevance
    from (select cast(trunc(r.DEPARTURE_DELAY) as int) as actual, coalesce(r.WEATHER_DELAY, 0) as minutes, a.delay,
        regexp_matches(lower(a.primary_cause), 'weather|storm|snow') as weather, lower(a.citation) as cited
      from requests r join ({ANALYZE_SQL}) a using (request_id)) j"""


@query(
    "a3_evaluate_analysis",
    oracle(
        EVALUATE_SQL, "normalised", "dim_carrier", "dim_hub", "weather_hourly", "airport_events", "dim_recommendation",
        **EVALUATE_STEPS, **{k: v for k, v in ANALYZE_STEPS.items()},
    ),
)
def evaluate_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of recorded flights, analysed from end to end by the rules: delay, cause and citations judged."""
    sampled = recorded_flights(normalise(flights(spark, sf_dir)), SAMPLED)
    return evaluate(sampled, lambda requests: analyze(requests, basic_sources(spark, sf_dir)))


# Without positions every flight has altitude and speed 0.
PROMPT_SQL = f"""
    select request_id, concat_ws(chr(10), 'Explain and decide the following flight event. Weather risks are given facts.',
      'Flight: ' || carrier || ' ' || flight_id || ' from ' || origin || ' to ' || a.destination, 'Status: ' || coalesce(status, 'unknown'),
      'Altitude (ft): 0', 'Speed (kt): 0', 'Predicted delay (min): ' || delay, 'Origin weather risk: ' || origin_risk, 'Destination weather risk: ' || dest_risk,
      'Origin report: ' || raw_origin, 'Destination report: ' || raw_dest, 'Airport programme: ' || a.notam_type,
      'Programme message: ' || coalesce(p.message, {_quoted(fixed.NO_PROGRAMME_MESSAGE)}), 'Programme delay (min): ' || penalty, 'Cause: ' || primary_cause,
      'Guideline: ' || citation, 'A programme overrides the predicted delay. Below 15 minutes with low risks, proceed normally.',
      'Reply with one JSON object: "primary_cause", "secondary_cause", "search_query", "action", "reasoning".') as prompt
    from ({ANALYZE_SQL}) a left join programmes p on p.destination = a.destination"""


@query(
    "x12_prompt_text",
    oracle(PROMPT_SQL, "normalised", "requests", "dim_carrier", "dim_hub", "weather_hourly", "airport_events", "dim_recommendation", **ANALYZE_STEPS),
)
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = analyze(view(spark, sf_dir, "requests"), basic_sources(spark, sf_dir))
    return prompt_text(events).select("request_id", "prompt")
