"""What must not grow with the tables: a learner's part, a search's work for equal texts, a scan's code."""

import numpy as np
from pyspark.sql import functions as F

from tarmac.functions.clock import scheduled_ts
from tarmac.operators import retrieval
from tarmac.operators.lookups import hub_indices
from tarmac.operators.models import read_shares, save_shares


def test_a_part_to_learn_from_is_bounded_in_rows(spark, tmp_path):
    rows = spark.range(600_000, numPartitions=2).select("id", *[F.xxhash64("id", F.lit(k)).cast("double").alias(f"x{k}") for k in range(8)])
    shares = save_shares(rows, f"{tmp_path}/rows")
    sizes = shares.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.sum() == 600_000 and sizes.max() <= 250_000
    assert spark.read.parquet(f"{tmp_path}/rows").exceptAll(shares.sparkSession.read.parquet(f"{tmp_path}/rows")).count() == 0


def test_parts_are_read_with_the_settings_of_the_session(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    save_shares(spark.range(10).toDF("id"), f"{tmp_path}/rows")
    read = read_shares(spark, f"{tmp_path}/rows")
    assert read.sparkSession.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_a_scheduled_time_names_its_reading_once(spark):
    df = spark.sql("select date'2024-01-05' + cast(id as int) as day, cast(id * 7 % 2500 as int) as clock_here from range(10)")
    assert df.select(scheduled_ts(F.col("day"), F.col("clock_here")).alias("t"))._jdf.queryExecution().analyzed().toString().split("\n")[0].count("clock_here") == 1


def test_hubs_name_their_call_sign_a_few_times(spark):
    df = spark.sql("select 'DAL12' as sign_here, array('A', 'B', 'C') as hubs")
    text = df.select(*[c.alias(n) for c, n in zip(hub_indices(F.col("sign_here"), F.col("hubs")), "ab")])._jdf.queryExecution().analyzed().toString().split("\n")[0]
    assert text.count("sign_here") <= 6


def plain(queries, matrix, ids, n):
    out = []
    for k, q in enumerate(queries):
        with np.errstate(all="ignore"):
            distances = ((q - matrix) ** 2).sum(axis=1)
        order = [i for i in np.lexsort((ids, distances)) if np.isfinite(distances[i])][:n]
        out += [(k, int(ids[i]), float(distances[i])) for i in order]
    return out


def test_nearest_equals_the_plain_sums(monkeypatch):
    draw = np.random.default_rng(5)
    matrix = draw.normal(size=(60, 12))
    matrix[10:20] = matrix[0]  # ties
    matrix[20] += 1e-9
    matrix[30, 0], matrix[31, 1] = np.nan, np.inf
    queries = np.vstack([draw.normal(size=(30, 12)), matrix[:3], np.zeros((1, 12))])
    queries[4, 2] = np.nan
    ids = draw.permutation(60)
    for scale in (1.0, 1e-170, 1e154, 1e160):
        for n in (1, 5, 100):
            q, m = queries * scale, matrix * scale
            assert list(zip(*retrieval._nearest(np.arange(len(q)), q, ids, m, None, n))) == plain(q, m, ids, n)


def test_equal_texts_are_searched_once(spark, monkeypatch, tmp_path):
    from tarmac.plans import analyze as plan

    asked = spark.sql("""select id as request_id, 'ATL' as origin, 'JFK' as destination, 30 as delay, 'High' as origin_risk, 'Low' as dest_risk from range(40)""")
    replies = spark.sql("""select id as request_id, concat('{"primary_cause": "Storm", "search_query": "storm ', id % 3, '"}') as cause_text, cast(null as string) as action_text from range(40)""")
    documents = spark.sql("select id, cast(id as string) as name, concat('doc ', id) as title, concat('storm ', id) as content, 'ALL' as icao from range(5)")
    documents = documents.withColumn("text", F.col("content"))
    embedder = retrieval.fit_text_embedder(documents, "text", 16)
    corpus = retrieval.embed(documents, "text", embedder, "vector").drop("text")
    searched, search = [], retrieval.knn_exact
    monkeypatch.setattr(plan.retrieval, "knn_exact", lambda q, d, *a, **k: searched.append(q.count()) or search(q, d, *a, **k))
    none = spark.createDataFrame([], "x int")
    sources = plan.Sources(none, none, none, none, none, none, "2024-01-20", corpus=corpus, embedder=embedder, replies=replies)
    rows = plan.explain(asked, sources, str(tmp_path)).select("request_id", "citations").collect()
    assert searched == [3] and len(rows) == 40
    for r in rows:
        assert r["citations"] == rows[[x["request_id"] % 3 for x in rows].index(r["request_id"] % 3)]["citations"]
        assert r["citations"][0].startswith(f"[{r['request_id'] % 3}]")


def test_equal_answers_are_spelled_out_once(spark, monkeypatch, tmp_path):
    """Requests carry digests: no reply's text is stored per request, and equal lists of documents are put into words once."""
    from tarmac.plans import analyze as plan

    asked = spark.sql("select id as request_id, if(id % 2 = 0, 'ATL', 'DFW') as origin, 'JFK' as destination, 30 as delay, 'High' as origin_risk, 'Low' as dest_risk from range(40)")
    nobody = asked.where("request_id = 1").withColumn("request_id", F.lit(None).cast("bigint"))
    asked = asked.where("request_id <> 7").unionByName(asked.where("request_id = 9")).unionByName(nobody)
    replies = spark.sql("""select id as request_id, concat('{"primary_cause": "Storm", "search_query": "storm ', id % 3, '"}') as cause_text, cast(null as string) as action_text from range(40) where id <> 5""")
    documents = spark.sql("select id, cast(id as string) as name, concat('doc ', id) as title, concat('storm ', id) as content, 'ALL' as icao from range(5)").withColumn("text", F.col("content"))
    embedder = retrieval.fit_text_embedder(documents, "text", 16)
    corpus = retrieval.embed(documents, "text", embedder, "vector").drop("text")
    spelled, cite = [], retrieval.citations
    monkeypatch.setattr(plan.retrieval, "citations", lambda q, *a, **k: spelled.append(q.count()) or cite(q, *a, **k))
    none = spark.createDataFrame([], "x int")
    sources = plan.Sources(none, none, none, none, none, none, "2024-01-20", corpus=corpus, embedder=embedder, replies=replies)
    got = {}
    for r in plan.explain(asked, sources, str(tmp_path)).select("request_id", "citations").collect():
        got.setdefault(r["request_id"], []).append(r["citations"])
    # Three texts; a request that is there twice meets its answers twice, as any join by its id would.
    assert spelled[0] <= 4
    assert {k: len(v) for k, v in got.items()} == {**{k: 1 for k in range(40) if k not in (7, 9)}, 9: 4, None: 1}
    no_corpus = [[plan.fixed.CITATION_NO_CORPUS]]
    assert got[5] == no_corpus and got[None] == no_corpus
    assert all(v[0][0].startswith(f"[{k % 3}]") for k, v in got.items() if k not in (None, 5))
    assert "_text" not in spark.read.parquet(f"{tmp_path}/judged").columns


def test_no_flight_is_shuffled_for_a_few_readings(spark):
    from tarmac.plans import features

    flights = spark.sql("select 'ATL' as ORIGIN_AIRPORT, 'JFK' as DESTINATION_AIRPORT, 'DL' as AIRLINE, '1' as FLIGHT_NUMBER, date'2024-01-05' as FL_DATE, cast(id as int) as SCHEDULED_DEPARTURE, timestamp'2024-01-05 00:00:00' as SCHEDULED_TS from range(30)")
    hourly = spark.sql("select if(id % 2 = 0, 'ATL', 'JFK') as AIRPORT, 2024 as YEAR, 1 as MONTH, 5 as DAY, 0 as HOUR, cast(id as double) as precipitation, cast(null as double) as wind_speed_10m from range(40)")
    calendar = spark.sql("select date'2024-01-01' as holiday_date")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = features.add_other_features(flights, hourly, calendar)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        got = {tuple(r) for r in rows.select("ORIGIN_PRECIP", "ORIGIN_WIND", "DEST_PRECIP", "DEST_WIND").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(38.0, 0.0, 39.0, 0.0)} and "SortMergeJoin" not in plan
