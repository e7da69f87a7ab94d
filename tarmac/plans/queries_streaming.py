"""Queries that run a stream over the tables until nothing is left and return what it stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import holidays, models
from tarmac.operators.cleaning import clean_flight_keys, flight_label, normalise
from tarmac.operators.weather import hourly_readings
from tarmac.plans.features import add_features, add_other_features, training_rows, with_schedule
from tarmac.plans.queries_models import delay_model, prepared
from tarmac.plans.queries_rows import TRAINING
from tarmac.plans.queries_sources import POSITIONS_SQL, snapshots
from tarmac.plans.registry import query
from tarmac.plans.views import flights, flights_over, oracle, table, view
from tarmac.sources import tables
from tarmac.streaming import congestion, jobs, positions
from tarmac.workspace import new_folder


def snapshot_files(spark: SparkSession, sf_dir: str) -> str:
    """Snapshot documents with their time, in files as a collector would leave them."""
    path = new_folder(spark, "snapshots")
    timed = snapshots(spark, sf_dir).withColumn("snapshot_time", F.timestamp_seconds(F.col("snapshot") * 300 + 1_704_067_200))
    timed.select("snapshot_time", "payload").write.parquet(path)
    return path


def position_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = snapshot_files(spark, sf_dir)
    return jobs.file_stream(spark, path, spark.read.parquet(path).schema)


@query(
    "t1_position_stream",
    oracle(f"select cast(snapshot as bigint) as snapshot, * exclude (snapshot) from ({POSITIONS_SQL}) p", "state_vectors"),
)
def position_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, checkpoint = new_folder(spark, "positions"), new_folder(spark, "checkpoint")
    stream = positions.position_stream(position_source(spark, sf_dir))
    jobs.append_stream(stream, out, checkpoint, once=True).awaitTermination()
    snapshot = ((F.unix_seconds("snapshot_time") - 1_704_067_200) / 300).cast("bigint")
    return spark.read.parquet(out).withColumn("snapshot", snapshot).drop("snapshot_time")


@query(
    "t2_latest_snapshot",
    oracle(
        f"""select * exclude (snapshot) from ({POSITIONS_SQL}) p
            where snapshot = (select max(event_id) // 50 from state_vectors)""",
        "state_vectors",
    ),
)
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, checkpoint = new_folder(spark, "newest"), new_folder(spark, "checkpoint")
    stream = positions.position_stream(position_source(spark, sf_dir))
    positions.latest_snapshot(stream, out, checkpoint, once=True).awaitTermination()
    return positions.read_newest(spark, out).drop("snapshot_time")


# A flight is sent once the watermark, one hour behind the newest flight, has reached its time.
CLOSED = """select ORIGIN as ORIGIN_AIRPORT, FL_NUMBER as FLIGHT_NUMBER, ts as SCHEDULED_TS, DEP_DELAY as DEPARTURE_DELAY,
      coalesce(avg(DEP_DELAY) over (partition by ORIGIN order by ts
        range between interval 2 hours preceding and interval 1 microsecond preceding), 0) as CONCURRENT_DELAYS_AT_ORIGIN
    from training qualify ts <= (select max(ts) - interval 1 hour from training)"""


@query("t3_congestion_stream", oracle(CLOSED, "flights", training=TRAINING))
def congestion_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per flight that the watermark has reached."""
    out, state, checkpoint = (new_folder(spark, n) for n in ("congestion", "state", "checkpoint"))
    lines = jobs.file_stream(spark, sf_dir, table(spark, sf_dir, "lineitem").schema, names="lineitem.parquet")
    running = congestion.Congestion(state, keep=("FLIGHT_NUMBER",))
    jobs.run_batches(with_schedule(training_rows(flights_over(lines))), running.step, out, checkpoint, once=True).awaitTermination()
    return spark.read.parquet(out).drop("batch")


# Every flight with a time gets one message; its text is that of the batch form.
MESSAGES = """select AIRLINE || cast(FL_NUMBER as varchar) as flight_id, ORIGIN || ' -> ' || DEST as route, strftime(FL_DATE, '%Y-%m-%d') as timestamp,
      'STREAM_UPDATE' as type, true as status_fits, true as as_batch
    from training where ts is not null"""


@query("t4_score_stream", oracle(MESSAGES, "flights", training=TRAINING))
def score_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history replayed by its dates, scored with what earlier batches left behind, and stored as JSON messages."""
    encoder, _ = prepared(spark, sf_dir)
    model = delay_model(spark, sf_dir)
    stored, out, state, checkpoint = (new_folder(spark, n) for n in ("history", "messages", "state", "checkpoint"))
    day = F.col("FL_DATE")
    dated = training_rows(flights(spark, sf_dir)).withColumns({"YEAR": F.year(day), "MONTH": F.month(day), "DAY": F.dayofmonth(day)})
    tables.write_flights(dated, stored)
    history = spark.read.parquet(stored)
    # Every batch needs the readings, so they are taken from the events once.
    hourly, calendar = hourly_readings(view(spark, sf_dir, "weather_hourly")), holidays.us_holidays(spark, 2023, 2024)

    def messages(features: DataFrame) -> DataFrame:
        keep = ("flight_id", "shown_route", "flight_day")
        labelled = features.withColumns(
            {
                "flight_id": F.concat("AIRLINE", "FLIGHT_NUMBER"),
                "shown_route": F.concat("ORIGIN_AIRPORT", F.lit(" -> "), "DESTINATION_AIRPORT"),
                "flight_day": F.date_format("FL_DATE", "yyyy-MM-dd"),
            }
        )
        scored = models.score(models.prepare(labelled, encoder, keep=keep), model)
        message = tables.to_message(
            F.col("flight_id"), F.col("shown_route"), F.col("prediction"), F.lit(None).cast("string"), F.col("flight_day")
        )
        return scored.select("flight_id", message.alias("message"))

    running = congestion.Congestion(state, delay=0)

    def step(batch: DataFrame, number: int) -> DataFrame:
        due = running.step(with_schedule(clean_flight_keys(batch)), number)
        return messages(add_other_features(due, hourly, calendar))

    jobs.replay(history, step, out, checkpoint, days=40)
    sent = spark.read.parquet(out)
    whole = messages(add_features(history, hourly, calendar).where("SCHEDULED_TS is not null"))
    # How often each message is sent and made, told apart by digests; the texts themselves stay where they are.
    digest = F.unhex(F.md5("message")).alias("digest")
    counted = sent.select(digest, F.lit(1).alias("sent"), F.lit(0).alias("made")).unionAll(whole.select(digest, F.lit(0), F.lit(1)))
    same = counted.groupBy("digest").agg((F.sum("sent") == F.sum("made")).alias("as_batch"))
    update = F.from_json("message", "type string, timestamp string, updates array<struct<flight_id:string, route:string, predicted_delay:double, status:string>>")
    opened = sent.select("flight_id", update.alias("m"), digest)
    one = F.col("m.updates")[0]
    fits = (one["flight_id"] == F.col("flight_id")) & F.when(one["predicted_delay"] == 15, one["status"].isin("DELAYED", "ON TIME")).otherwise(one["status"] == F.when(one["predicted_delay"] > 15, "DELAYED").otherwise("ON TIME"))
    read = opened.select("flight_id", one["route"].alias("route"), "m.timestamp", "m.type", fits.alias("status_fits"), "digest")
    return read.join(same, "digest").drop("digest")


REPLAYED = """select AIRLINE || '|' || FLIGHT_NUMBER || '|' || d as id,
      AIRLINE || FLIGHT_NUMBER || ' to ' || DESTINATION_AIRPORT || ' (' || cast(cast(trunc(DEPARTURE_DELAY) as int) as varchar)
        || ' min delay on ' || d || ')' as display, cast(trunc(DEPARTURE_DELAY) as int) as delay, batch
    from (select *, strftime(make_date(YEAR, MONTH, DAY), '%Y-%m-%d') as d,
        cast((dense_rank() over (order by YEAR, MONTH, DAY) - 1) // 7 as int) as batch from normalised) n"""


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history in batches of seven dates each, stopped after five batches and started again."""
    stored, out, checkpoint = (new_folder(spark, n) for n in ("history", "replayed", "checkpoint"))
    tables.write_flights(normalise(flights(spark, sf_dir)), stored)
    label = lambda batch, _: flight_label(batch)
    jobs.replay(spark.read.parquet(stored), label, out, checkpoint, days=7, batches=5)
    jobs.replay(spark.read.parquet(stored), label, out, checkpoint, days=7)
    return spark.read.parquet(out)


@query("t5_replay", oracle(REPLAYED, "normalised"))
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the number of the batch that brought it."""
    return replayed(spark, sf_dir).select("id", "display", "delay", "batch")


@query(
    "t5_replay_order",
    oracle(f"select batch, min(split_part(id, '|', 3)) as low, max(split_part(id, '|', 3)) as high, count(*) as n from ({REPLAYED}) r group by batch", "normalised"),
)
def replay_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last date of every batch: the dates follow the batches."""
    day = F.split_part("id", F.lit("|"), F.lit(3))
    return replayed(spark, sf_dir).groupBy("batch").agg(F.min(day).alias("low"), F.max(day).alias("high"), F.count(F.lit(1)).alias("n"))
