import json

import pytest
from pyspark.sql import functions as F

from tarmac.operators.cleaning import normalise
from tarmac.sources import feeds, tables
from tarmac.sources.schemas import FLIGHT


def test_csv_is_read_by_name(spark, tmp_path):
    # Other column order, an unknown column, a missing column, a bad number and a short line.
    (tmp_path / "f.csv").write_text(
        "AIRLINE,FL_DATE,EXTRA,FL_NUMBER,ORIGIN,DEST,CRS_DEP_TIME,DEP_DELAY,CANCELLED\n"
        "Delta,2023-01-05,x,12,ATL,JFK,905,-3.0,0.0\n"
        "Delta,nonsense,x,13,ATL,JFK,905,,1.0\n"
        "Delta,2023-01-06,x,fourteen,ATL,JFK,905,1.5,0.0\n"
        "Delta,2023-01-07\n"
    )
    df = tables.read_flights(spark, str(tmp_path / "f.csv"), keep_corrupt=True)
    rows = df.select("FL_DATE", "AIRLINE", "FL_NUMBER", "DEP_DELAY", "DISTANCE", tables.CORRUPT).collect()
    got = {r["FL_DATE"]: r for r in rows}
    assert got["2023-01-05"]["FL_NUMBER"] == 12 and got["2023-01-05"]["DEP_DELAY"] == -3.0
    assert got["2023-01-05"]["DISTANCE"] is None and got["2023-01-05"][tables.CORRUPT] is None
    assert got["2023-01-06"]["FL_NUMBER"] is None and "fourteen" in got["2023-01-06"][tables.CORRUPT]
    assert got["2023-01-07"][tables.CORRUPT] is not None
    normal = normalise(tables.read_flights(spark, str(tmp_path / "f.csv")))
    assert [(f.name, f.dataType) for f in normal.schema] == [(f.name, f.dataType) for f in FLIGHT]
    # The row without a date is gone, the missing delay became 0.
    assert sorted(r["DEPARTURE_DELAY"] for r in normal.collect()) == [-3.0, 0.0, 1.5]


def test_written_flights_prune_by_partition(spark, tmp_path):
    raw = spark.sql("select explode(sequence(date'2023-01-01', date'2023-03-31')) as FL_DATE").selectExpr(
        "FL_DATE", "'DL' AIRLINE", "1L FL_NUMBER", "'ATL' ORIGIN", "'JFK' DEST", "900 CRS_DEP_TIME", "1D DEP_DELAY", "0D CANCELLED", "0D DELAY_DUE_WEATHER"
    )
    path = str(tmp_path / "flights")
    tables.write_flights(normalise(raw), path)
    february = tables.read_normalised(spark, path).where("YEAR = 2023 and MONTH = 2")
    assert february.count() == 28
    assert {r["f"].split("/")[-2] for r in february.select(F.input_file_name().alias("f")).distinct().collect()} == {"MONTH=2"}
    plan = february._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(YEAR" in plan


def test_append_only_missing_keys(spark, tmp_path):
    path = str(tmp_path / "w")
    first = spark.createDataFrame([("A", 1), ("A", 2)], "AIRPORT string, v int")
    second = spark.createDataFrame([("A", 9), ("B", 3)], "AIRPORT string, v int")
    tables.append_missing(first, path, "AIRPORT")
    got = tables.append_missing(second, path, "AIRPORT")
    assert sorted((r["AIRPORT"], r["v"]) for r in got.collect()) == [("A", 1), ("A", 2), ("B", 3)]
    assert tables.append_missing(second, path, "AIRPORT").count() == 3


def test_artefact_tables(spark, tmp_path):
    assert tables.load_table(spark, str(tmp_path / "none")) is None
    saved = tables.save_table(spark.range(3), str(tmp_path / "t"))
    assert saved.count() == tables.load_table(spark, str(tmp_path / "t")).count() == 3
    (tmp_path / "p.json").write_text(json.dumps({"ATL": 5.5, "_GLOBAL_MEAN_": 7.0}, indent=2))
    got = {r["airport"]: r["mean_delay"] for r in tables.read_profile_json(spark, str(tmp_path / "p.json")).collect()}
    assert got == {"ATL": 5.5, "_GLOBAL_MEAN_": 7.0}


def test_hourly_document(spark):
    document = {"hourly": {"time": ["2023-01-01T00:00", "2023-01-01T23:00"], "precipitation": [None, 1.5], "wind_speed_10m": [3.0]}}
    df = spark.createDataFrame([("ATL", json.dumps(document)), ("JFK", "{}"), ("LAX", "broken")], "airport string, payload string")
    rows = sorted(tuple(r) for r in feeds.explode_hourly(df).collect())
    assert rows == [("ATL", 2023, 1, 1, 0, 0.0, 3.0), ("ATL", 2023, 1, 1, 23, 1.5, 10.0)]


def vector(sign, lon=1.0, lat=2.0, alt=1000.0, ground=False, speed=100.0, climb=-5.0):
    return ["hex", sign, "US", 1, 2, lon, lat, alt, ground, speed, 90.0, climb, None, alt]


def test_state_vectors(spark):
    states = [vector(" AA1 "), vector(None), vector("NOPOS", lon=None), vector("SHORT")[:12], None, vector("CUT")]
    document = json.dumps({"time": 5, "states": states})
    df = spark.createDataFrame([(document,), ('{"time":6,"states":null}',), ("broken",)], "payload string")
    rows = feeds.parse_state_vectors(df, max_vectors=5).collect()
    # The cut comes before the checks, so the sixth vector is not looked at.
    assert sorted(r["callsign"] for r in rows) == ["AA1", "UNK"]
    row = rows[0]
    assert (row["total"], row["altitude_ft"], row["velocity_kts"], row["vertical_rate_fpm"]) == (6, 3281, 194, -984)
    assert (row["on_ground"], row["is_landing"]) == (False, True)
    assert len(feeds.parse_state_vectors(df).collect()) == 3


def test_flight_feed(spark):
    full = ["h", 1.5, -2.5, 270, 30000, 450, "", "", "", "", 0, "atl", "N/A", "dl1", 0, 0, " DAL1 ", 0]
    document = json.dumps({"full_count": 9, "version": 4, "k1": full, "k2": full[:16], "stats": {"total": 1}})
    rows = feeds.parse_flight_feed(spark.createDataFrame([(document,)], "payload string")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["feed_key"], r["latitude"], r["altitude"], r["velocity"], r["origin"], r["destination"], r["iata_flight"], r["callsign"]) == (
        "k1", 1.5, 30000, 450, "ATL", "N/A", "DL1", "DAL1",
    )


def test_report_lists(spark):
    df = spark.createDataFrame([("KATL", '[{"rawOb":"KATL 1"},{"rawOb":"KATL 0"}]'), ("KJFK", "[]")], "station string, payload string")
    assert {r["station"]: r["report"] for r in feeds.parse_reports(df).collect()} == {"KATL": "KATL 1", "KJFK": None}


def test_message(spark):
    df = spark.createDataFrame([("DL1", 15.04, None)], "f string, d double, r string")
    text = df.select(tables.to_message(F.col("f"), F.lit("A -> B"), F.col("d"), F.col("r"), F.lit("t"))).first()[0]
    update = {"flight_id": "DL1", "route": "A -> B", "predicted_delay": 15.0, "status": "DELAYED", "metar": None}
    assert json.loads(text) == {"type": "STREAM_UPDATE", "timestamp": "t", "updates": [update]}


def test_shared_folder(spark):
    from tarmac import workspace

    class Conf:
        def __init__(self, folder):
            self.folder = folder

        def get(self, key, default=None):
            assert key == "spark.checkpoint.dir"
            return self.folder

    class Session:
        def __init__(self, folder, master):
            self.conf = Conf(folder)
            self.sparkContext = type("C", (), {"master": master})

    assert workspace.shared_folder(Session("hdfs://x/y", "yarn")) == "hdfs://x/y"
    with pytest.raises(ValueError):
        workspace.shared_folder(Session(None, "yarn"))
    assert workspace.shared_folder(Session(None, "local[2]"))


def test_a_run_that_dies_leaves_a_readable_table(spark, tmp_path, monkeypatch):
    """One run dies after it wrote its rows, before it listed its keys."""
    path = str(tmp_path / "w")
    first = spark.createDataFrame([("007", 1), ("1e5", 4), (None, 9)], "AIRPORT string, v int")
    full = spark.createDataFrame([("007", 1), ("007", 2), ("B", 3), ("1e5", 5)], "AIRPORT string, v int")
    tables.append_missing(first.where("AIRPORT = '1e5' or AIRPORT is null"), path, "AIRPORT")

    def die(*_):
        raise RuntimeError

    with monkeypatch.context() as patched, pytest.raises(RuntimeError):
        patched.setattr(type(first), "distinct", die)
        tables.append_missing(first, path, "AIRPORT")
    got = tables.read_appended(spark, path, "AIRPORT", full.schema)
    assert sorted(tuple(r) for r in got.collect()) == [("1e5", 4)]
    got = tables.append_missing(full, path, "AIRPORT")
    assert sorted(tuple(r) for r in got.collect()) == [("007", 1), ("007", 2), ("1e5", 4), ("B", 3)]
    assert tables.append_missing(full, path, "AIRPORT").count() == 4


def test_two_runs_at_once_store_a_key_once(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = spark.createDataFrame([("A", 1), ("A", 2)], "AIRPORT string, v int")
    tables.append_missing(rows, path, "AIRPORT")
    # Another run that had looked before the first was done.
    rows.write.partitionBy("AIRPORT").parquet(f"{path}/rows/{tables.RUN}=ffff")
    spark.createDataFrame([("A", "ffff")], f"AIRPORT string, {tables.RUN} string").write.mode("append").parquet(f"{path}/keys")
    assert sorted(tuple(r) for r in tables.read_appended(spark, path, "AIRPORT", rows.schema).collect()) == [("A", 1), ("A", 2)]


def test_appended_rows_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(f"K{k % 7}", k) for k in range(100)], "AIRPORT string, v int")
    assert tables.append_missing(rows.mapInArrow(count, rows.schema), str(tmp_path / "w"), "AIRPORT").count() == 100
    assert seen.value == 100


def test_weather_documents(spark):
    now = json.dumps({"current": {"temperature_2m": 1.5, "weather_code": 61}})
    day = json.dumps({"daily": {"time": ["2023-05-01", "bad"], "weathercode": [3, 4], "precipitation_sum": [None, 1.0], "windspeed_10m_max": [7.5]}})
    df = spark.createDataFrame([("ATL", now, day), ("JFK", "broken", "{}")], "airport string, now string, day string")
    got = {r["airport"]: tuple(r)[1:] for r in feeds.parse_current_weather(df, payload="now").collect()}
    assert got == {"ATL": (1.5, 0.0, 0.0, 61.0), "JFK": (20.0, 0.0, 8.0, 0.0)}
    rows = feeds.parse_daily_weather(df, payload="day").collect()
    assert [(r["airport"], str(r["date"]), *tuple(r)[2:]) for r in rows] == [("ATL", "2023-05-01", 3.0, None, None, 7.5)]


def test_report_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text("station,valid,metar\nKATL,2023-05-01 05:52,KATL 010552Z\nKATL,2023-05-01 04:52,KATL 010452Z\n")
    from tarmac.operators.lookups import first_report

    rows = first_report(tables.read_reports(spark, str(tmp_path / "r.csv")), "station", "valid", "metar").collect()
    assert [(r["station"], str(r["day"]), r["report"]) for r in rows] == [("KATL", "2023-05-01", "KATL 010452Z")]


def test_files_with_another_column_order_fail(spark, tmp_path):
    """Two extracts whose columns stand in a different order are never read by position."""
    (tmp_path / "a.csv").write_text("FL_DATE,ORIGIN,DEST\n2023-01-01,ORD,LAX\n")
    (tmp_path / "b.csv").write_text("FL_DATE,DEST,ORIGIN\n2023-01-02,LAX,ORD\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_flights(spark, str(tmp_path)).select("ORIGIN", "DEST").collect()
    assert tables.read_flights(spark, str(tmp_path / "b.csv")).select("ORIGIN", "DEST").first() == ("ORD", "LAX")


def test_folders_are_removed(spark, tmp_path):
    from tarmac.workspace import remove_folder

    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    remove_folder(spark, path)
    assert not (tmp_path / "t").exists()


def test_nested_route_documents(spark):
    """None, one and several flights under way; errors, absent members, wrong types."""
    def entry(status, iata, **more):
        return {"flight_status": status, "departure": {"iata": iata, **more}, "arrival": {"iata": "JFK"}}

    documents = {
        "none": {"data": [entry("landed", "AAA", delay=7, actual="2024-01-01T00:00"), entry("scheduled", "BBB")]},
        "one": {"data": [entry("landed", "AAA"), entry("active", "BBB", delay=12.9, scheduled="2024-01-15T10:30:00+00:00")]},
        "several": {"data": [entry("active", "AAA"), entry("active", "BBB")]},
        "error": {"error": {"code": "limit"}},
        "empty": {"data": []},
        "absent": {"data": [{"flight_status": "active"}]},
        "text": {"data": [entry("active", "AAA", delay="late")]},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in documents.items()] + [("broken", "x")], "k string, payload string")
    got = {r["k"]: (r["origin"], r["destination"], r["delay"], r["status"], r["departed"], r["scheduled"]) for r in feeds.parse_route_list(df, "k").collect()}
    nothing = (None,) * 6
    assert got == {
        "none": ("AAA", "JFK", 7.0, "landed", "2024-01-01T00:00", None), "one": ("BBB", "JFK", 12.9, "active", None, "2024-01-15T10:30:00+00:00"), "several": ("AAA", "JFK", None, "active", None, None),
        "error": nothing, "empty": nothing, "broken": nothing, "absent": (None, None, None, "active", None, None), "text": ("AAA", "JFK", None, "active", None, None),
    }
    hits = [("a", {"results": [{"id": "x1", "detail": {"schd_from": "atl"}}, {"id": "x2"}]}), ("b", {"results": []}), ("c", {})]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in hits], "k string, payload string")
    found = feeds.parse_route_search(df, "k")
    assert sorted(tuple(r) for r in found.collect()) == [("a", "ATL", None, "x1"), ("b", None, None, None), ("c", None, None, None)]
    times = [("x1", {"time": {"scheduled": {"departure": 60}, "real": {"departure": None}}}), ("x1", {"time": {}}), ("x9", {})]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in times], "detail_id string, payload string")
    timed = feeds.with_times(found, feeds.parse_flight_times(df, "detail_id"), "detail_id")
    assert {r["k"]: (r["sched_epoch"], r["real_epoch"]) for r in timed.collect()} == {"a": (60, None), "b": (None, None), "c": (None, None)}
