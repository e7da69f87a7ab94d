import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tarmac.operators import lookups
from tarmac.sources import dimensions as dims
from tarmac.sources import fixed_values as fixed

HISTORY = "YEAR int, MONTH int, DAY int, DAY_OF_WEEK int, AIRLINE string, FLIGHT_NUMBER string, ORIGIN_AIRPORT string, DESTINATION_AIRPORT string, SCHEDULED_DEPARTURE int, DEPARTURE_DELAY double, CANCELLED double, WEATHER_DELAY double"


@pytest.fixture
def history(spark):
    rows = [
        (2023, 5, 1, 1, "DL", "10.0", "ATL", "JFK", 900, 5.0, 0.0, 0.0),
        (2023, 5, 1, 1, "DL", "10", "LAX", "SFO", 1200, 80.0, 0.0, 0.0),
        (2023, 5, 2, 2, "AA", "7", "DFW ", "ORD", 600, 31.0, 0.0, 0.0),
        (2023, 4, 9, 7, " ua", "5", "DEN", "IAH", 700, 0.0, 1.0, 0.0),
    ]
    return spark.createDataFrame(rows, HISTORY)


def test_lookup_flights(spark, history):
    queries = ["DL|10|2023-05-01", "dl|10.0|2023-05-01", "DL|11|2023-05-01", "UA|5|2023-04-09", "DL|10|2023-13-99", "DL|10", "", None]
    requests = spark.createDataFrame(list(enumerate(queries)), "id int, query string")
    got = {r["id"]: (r["matched"], r["AIRLINE"].strip(), r["SCHEDULED_DEPARTURE"]) for r in lookups.lookup_flights(requests, history).collect()}
    first_row, first_late = (" ua".strip(), 700), ("DL", 1200)
    assert got == {
        0: ("id", "DL", 900), 1: ("id", "DL", 900), 2: ("first_row", *first_row), 3: ("id", "ua", 700),
        4: ("first_row", *first_row), 5: ("first_row", *first_row), 6: ("none_asked", *first_late), 7: ("none_asked", *first_late),
    }
    calm = lookups.lookup_flights(requests.where("id = 6"), history.where("DEPARTURE_DELAY <= 30")).first()
    assert (calm["AIRLINE"], calm["matched"]) == (" ua", "none_asked")


def test_resolve_airport(spark):
    world = spark.sql("select * from values ('HOU', 'KHOU', 1D, 2D), ('ATL', 'KATL', 3D, 4D), ('XYZ', 'ATLX', 5D, 6D) as t(iata, icao, latitude, longitude)")
    codes = spark.createDataFrame([(c,) for c in [" hou ", "KHOU", "KXYZ", "ATL", "JFK", "????", None]], "code string")
    got = {r["code"]: (r["latitude"], r["longitude"]) for r in lookups.resolve_airport(codes, "code", "", world).collect()}
    unknown = (39.82, -98.57)
    assert got == {
        " hou ": (1.0, 2.0), "KHOU": (1.0, 2.0), "KXYZ": (5.0, 6.0), "ATL": (3.0, 4.0), "JFK": (40.6413, -73.7781),
        "????": unknown, None: unknown,
    }


@pytest.mark.parametrize(
    "query, number, iata, icao",
    [
        ("DAL 123", "123", "DL", "DAL"), ("ua55", "55", "UA", "UAL"), ("B61010", "61010", "B6", "JBU"),
        ("6E200", "6", "6E", "IGO"), ("charter", "CHARTER", "DL", "DAL"), ("99", "99", "DL", "DAL"), ("", "", "DL", "DAL"),
    ],
)
def test_parse_flight_query(spark, query, number, iata, icao):
    row = lookups.parse_flight_query(spark.createDataFrame([(query,)], "q string"), "q").first()
    assert (row["flight_number"], row["carrier_iata"], row["carrier_icao"]) == (number, iata, icao)
    assert (row["icao_callsign"], row["iata_flight"]) == (icao + number, iata + number)


def test_schedule_lookup(spark, history):
    asked = spark.createDataFrame([("DL", "10"), ("UA", "5"), ("DL", "99")], "carrier_iata string, flight_number string")
    rows = lookups.schedule_lookup(asked, history).collect()
    got = {(r["carrier_iata"], r["flight_number"]): (r["schedule_origin"], r["schedule_destination"]) for r in rows}
    assert got == {("DL", "10"): ("ATL", "JFK"), ("UA", "5"): ("DEN", "IAH"), ("DL", "99"): (None, None)}


def test_hub_choice_equals_python(spark):
    signs = [(c, f"{c}{n}") for c, _ in fixed.HUBS for n in range(60)]
    df = lookups.hub_fallback(spark.createDataFrame(signs, "carrier_iata string, icao_callsign string"))
    hubs = dict(fixed.HUBS)
    collisions = 0
    for r in df.collect():
        own = hubs.get(r["carrier_iata"], hubs["*"])
        number = int(hashlib.md5(r["icao_callsign"].encode()).hexdigest(), 16)
        i, j = number % len(own), number // len(own) % len(own)
        collisions += i == j
        j = (j + 1) % len(own) if i == j else j
        assert (r["origin"], r["destination"]) == (own[i], own[j])
        assert r["origin"] != r["destination"]
    assert collisions


def test_hub_keeps_a_known_route(spark):
    df = spark.createDataFrame([("DL", "DAL1", "AAA", "BBB"), ("DL", "DAL1", "AAA", None)], "carrier_iata string, icao_callsign string, origin string, destination string")
    routes = {(r["origin"], r["destination"]) for r in lookups.hub_fallback(df).collect()}
    assert ("AAA", "BBB") in routes and len(routes) == 2 and all("AAA" not in r or r == ("AAA", "BBB") for r in routes)


def test_match_position_prefers_the_first(spark):
    asked = spark.createDataFrame(
        [(1, "DAL135", "DL135", "DAL135"), (2, "UAL9", "UA9", "X77"), (3, "AAL1", "AA1", "AA1"), (4, "SWA5", "WN5", "WN5")],
        "id int, icao_callsign string, iata_flight string, query_clean string",
    )
    seen = [(5, "DAL135 ", 1.0), (3, "DAL1351", 2.0), (9, "X77", 3.0), (8, "UAL9Z", 4.0), (2, "AA12", 5.0), (1, " ", 6.0), (4, None, 7.0), (7, "WN5", 8.0)]
    positions = spark.createDataFrame(seen, "place int, callsign string, lat double")
    got = {r["id"]: (r["live_callsign"], r["live_lat"]) for r in lookups.match_position(asked, positions, ["place"], ["lat"]).collect()}
    # The longer call sign of another flight wins when it comes first; AA12 is no form of AA1.
    assert got == {1: ("DAL1351", 2.0), 2: ("UAL9Z", 4.0), 3: (None, None), 4: ("WN5", 8.0)}


def test_report_tiers(spark):
    df = spark.createDataFrame([("atl",), ("PANC",), ("JFK",)], "a string")
    first = spark.createDataFrame([("KATL", " "), ("PANC", "one")], "station string, report string")
    second = spark.createDataFrame([("KATL", "two"), ("PANC", "three")], "station string, report string")
    got = {r["a"]: r["r"] for r in lookups.resolve_report(df, "a", [first, second], "r").collect()}
    assert got == {"atl": "two", "PANC": "one", "JFK": "KJFK " + fixed.ROUTINE_REPORT}


def test_first_report_of_a_day(spark):
    at = dt.datetime(2024, 1, 1, 5)
    rows = [("K1", at, "b"), ("K1", at - dt.timedelta(hours=1), "a"), ("K1", at - dt.timedelta(hours=9), "z"), ("K1", at, None)]
    df = spark.createDataFrame(rows, "s string, v timestamp_ntz, m string")
    got = {(str(r["day"]), r["report"]) for r in lookups.first_report(df, "s", "v", "m").collect()}
    assert got == {("2024-01-01", "a"), ("2023-12-31", "z")}


def test_membership(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    done = spark.createDataFrame([("a",), ("a",)], "d string")
    assert [r["k"] for r in lookups.known(df, done, "k", "d").collect()] == ["a"]
    assert [r["k"] for r in lookups.pending(df, done, "k", "d").collect()] == ["b"]
    ends = spark.createDataFrame([("x", "y"), ("y", None)], "ORIGIN string, DEST string")
    assert {r["airport"] for r in lookups.all_airports(ends).collect()} == {"x", "y"}


def test_dimensions(spark):
    assert dims.dim_airport(spark).count() == 114
    assert dims.dim_carrier(spark).select("icao").distinct().count() == 50
    assert dims.dim_carrier_name(spark).count() == 17
    assert {r["carrier"]: len(r["hubs"]) for r in dims.dim_hub(spark).collect()} == {"DL": 7, "AA": 7, "UA": 7, "WN": 7, "B6": 5, "AS": 5, "*": 7}
    reasons = {r["situation"]: r["reasoning"] for r in dims.dim_recommendation(spark).collect()}
    assert reasons == {s: text for s, _, text in fixed.RECOMMENDATIONS}
    quoted = dims.inline_table(spark, ["a"], [("O'Hare \\ \n\"x\"",)]).first()["a"]
    assert quoted == "O'Hare \\ \n\"x\""
    assert dims.dim_city(spark).where(F.col("code") == "ATL").first()["city"] == "Atlanta"


def test_repeated_documents_never_multiply_requests(spark):
    """Two rows for a key on every right side: one row per request, from the newest or first."""
    asked = spark.createDataFrame([("DL1", "ord"), ("DL2", "jfk")], "iata_flight string, destination string")
    events = spark.createDataFrame(
        [("ORD", 2, None, ("second", "1")), ("ORD", 1, None, ("first", "2"))],
        "airport_id string, seq int, groundStop struct<reason:string>, groundDelay struct<reason:string,avgDelay:string>",
    ).withColumn("arrivalDelay", F.lit(None).cast("struct<reason:string>"))
    rows = lookups.join_events(asked, events).select("destination", "programme.groundDelay.reason").collect()
    assert sorted((r[0], r[1]) for r in rows) == [("jfk", None), ("ord", "first")]
    reports = spark.createDataFrame([("KORD", 1, "old"), ("KORD", 2, "new"), ("KORD", 3, " ")], "station string, valid int, report string")
    rows = lookups.resolve_report(asked, "destination", [reports], "r").collect()
    assert sorted(r["r"][:9] for r in rows) == ["KJFK AUTO", "new"]
    feed = "iata_flight string, origin string, destination string, sched_epoch bigint, real_epoch bigint"
    search = spark.createDataFrame([("DL1", "AAA", "BBB", 100, None), ("DL1", "CCC", "DDD", 200, None)], feed)
    none = spark.createDataFrame([], feed)
    second = spark.createDataFrame([], "iata_flight string, origin string, destination string, scheduled string, delay double, status string, departed string, arrived string")
    rows = lookups.resolve_route(asked.select("iata_flight"), search, none, second, none.select("iata_flight", "origin", "destination")).collect()
    assert sorted((r["iata_flight"], r["origin"]) for r in rows) == [("DL1", "CCC"), ("DL2", None)]
