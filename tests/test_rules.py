import pytest
from pyspark.sql import functions as F

from tarmac.operators import lookups, rules
from tarmac.sources import fixed_values as fixed
from tarmac.sources.feeds import parse_airport_event_list, parse_airport_events


def low(value):
    return F.lit(value)


@pytest.mark.parametrize("prediction, expected", [(-5.2, 0), (0.9, 0), (15.99, 15), (700.0, 700)])
def test_baseline(one, prediction, expected):
    assert one({}, rules.baseline(F.lit(prediction))) == expected


@pytest.mark.parametrize(
    "origin, destination, base, expected",
    [
        ("Low", "Low", 12, 12), ("High", "Low", 0, 80), ("Low", "High", 0, 60), ("Moderate", "Low", 0, 40),
        ("Low", "Moderate", 0, 30), ("High", "High", 90, 90), ("High", "Moderate", 0, 80),
    ],
)
def test_fuse_weather(spark, origin, destination, base, expected):
    profile = spark.createDataFrame([("AAA", 80.9), ("BBB", 20.0), ("_GLOBAL_MEAN_", 50.0)], "airport string, mean_delay double")
    df = spark.createDataFrame([("AAA", "BBB", origin, destination, base)], "origin string, destination string, origin_risk string, dest_risk string, baseline bigint")
    assert rules.fuse_weather(df, profile).first()["predicted_delay_minutes"] == expected


def test_fuse_weather_defaults(spark):
    df = spark.createDataFrame([("ZZZ", "AAA", "High", "Low", 0)], "origin string, destination string, origin_risk string, dest_risk string, baseline bigint")
    zero = spark.createDataFrame([("ZZZ", 0.0), ("_GLOBAL_MEAN_", 70.0)], "airport string, mean_delay double")
    bare = spark.createDataFrame([("QQQ", 1.0)], "airport string, mean_delay double")
    moderate = df.withColumn("origin_risk", F.lit("Moderate"))
    assert rules.fuse_weather(df, zero).first()["predicted_delay_minutes"] == 70
    assert rules.fuse_weather(df, bare).first()["predicted_delay_minutes"] == 60
    assert rules.fuse_weather(df, None).first()["predicted_delay_minutes"] == 60
    assert rules.fuse_weather(moderate, zero).first()["predicted_delay_minutes"] == 35
    assert rules.fuse_weather(moderate, bare).first()["predicted_delay_minutes"] == 30


@pytest.mark.parametrize(
    "origin, destination, delay, sure",
    [("Low", "Low", 0, 0.8), ("Moderate", "Low", 30, 0.6), ("Low", "High", 90, 0.7), ("High", "Moderate", 90, 0.7), (None, "Low", 0, 0.8)],
)
def test_heuristic(one, origin, destination, delay, sure):
    columns = [F.lit(v).cast("string") for v in (origin, destination)]
    assert one({}, *rules.heuristic_delay(*columns)) == (delay, sure)


def test_confidence(one):
    def sure(a, b, c, o, d):
        score = rules.confidence(F.lit(a).cast("boolean"), F.lit(b), F.lit(c), F.lit(o), F.lit(d))
        return round(one({}, rules.clamp_confidence(score)), 6)

    assert sure(True, True, True, "Low", "Low") == 0.9
    assert sure(True, True, True, "Moderate", "Low") == 0.85
    assert sure(None, False, False, "High", "Low") == 0.55
    assert sure(True, True, True, "High", "High") == 0.7
    assert one({}, rules.clamp_confidence(F.lit(0.2)), rules.clamp_confidence(F.lit(0.99))) == (0.5, 0.95)


def test_landing_override(one):
    def held(delay, status, risk):
        return one({}, *rules.landing_override(F.lit(delay).cast("bigint"), F.lit(status), F.lit(risk), F.lit(0.5)))

    assert held(5, "Live - About to Land", "High") == (25, 0.94)
    assert held(90, "Live - About to Land", "High") == (90, 0.94)
    assert held(5, "Live - About to Land", "Low") == (5, 0.94)
    assert held(5, "Scheduled", "High") == (5, 0.5)


@pytest.mark.parametrize(
    "delay, origin, destination, primary, citation",
    [
        (14, "Low", "Low", "None", fixed.CITATION_ROUTINE), (15, "Low", "Low", "Weather/Congestion", fixed.CITATION_NO_CORPUS),
        (16, "Low", "Low", "Inherited Ground Delay", fixed.CITATION_INHERITED), (3, "High", "Low", "Weather/Congestion", fixed.CITATION_NO_CORPUS),
    ],
)
def test_root_cause(one, delay, origin, destination, primary, citation):
    row = one({}, rules.root_cause(F.lit(delay), F.lit(origin), F.lit(destination)))
    assert (row["primary_cause"], row["citation"]) == (primary, citation)


@pytest.mark.parametrize(
    "active, delay, origin, destination, expected",
    [
        (True, 0, "Low", "Low", "ENFORCE ATC DELAY"), (False, 16, "Low", "Low", "MONITOR SCHEDULE"),
        (False, 16, "High", "Low", "IMPLEMENT DELAY"), (False, 15, "High", "High", "PROCEED NORMALLY"), (None, 0, "Low", "Low", "PROCEED NORMALLY"),
    ],
)
def test_recommendation(spark, active, delay, origin, destination, expected):
    df = spark.createDataFrame([(active, delay, origin, destination)], "a boolean, d int, o string, t string")
    row = rules.recommend(df, F.col("a"), F.col("d"), F.col("o"), F.col("t")).first()["recommendation"]
    assert row["action"] == expected and row["reasoning"].startswith("Option A")


def test_programmes(spark):
    payloads = {
        "A": '{"groundDelay":{"reason":"wind","avgDelay":37},"groundStop":{"reason":"storm"}}',
        "B": '{"groundDelay":{"avgDelay":"1 hours 15 minutes"},"arrivalDelay":{"reason":"x"}}',
        "C": '{"arrivalDelay":{"reason":"volume"}}',
        "D": "{}",
        "E": '{"groundDelay":{"reason":"fog","avgDelay":"soon"}}',
        "F": '{"groundDelay":{"reason":"fog","avgDelay":62}}',
    }
    events = parse_airport_events(spark.createDataFrame(list(payloads.items()), "airport_id string, payload string"))
    flights = spark.createDataFrame([(c,) for c in "abcdefz"], "destination string")
    rows = lookups.join_events(flights, events).select("destination", rules.atc_constraint(F.col("programme")).alias("p")).collect()
    got = {r["destination"]: (r["p"]["active_notam"], r["p"]["notam_type"], r["p"]["delay_penalty_minutes"]) for r in rows}
    assert got == {
        "a": (True, "FAA GROUND STOP", 120), "b": (True, "GROUND DELAY PROGRAM", 1), "c": (True, "ATC ARRIVAL DELAY", 30),
        "d": (False, "None", 0), "e": (True, "GROUND DELAY PROGRAM", 45), "f": (True, "GROUND DELAY PROGRAM", 62), "z": (False, "None", 0),
    }
    messages = {r["destination"]: r["p"]["message"] for r in rows}
    assert messages["b"] == "FAA GDP IN EFFECT: Unknown. Arrival capacity reduced."
    assert messages["z"] == fixed.NO_PROGRAMME_MESSAGE


def test_programme_list(spark):
    text = '[{"airportId":"ATL","groundStop":{"reason":"storm"}},{"airportId":"JFK","groundDelay":{"reason":"wind","avgDelay":45}}]'
    rows = parse_airport_event_list(spark.createDataFrame([(text,)], "payload string")).collect()
    assert {(r["airport_id"], r["groundDelay"] and r["groundDelay"]["avgDelay"]) for r in rows} == {("ATL", None), ("JFK", "45")}


def test_display_bands(one):
    def bands(delay, score):
        return one({}, *rules.kpi_bands(F.lit(delay), F.lit(score)).values())

    assert bands(15, 0.9) == ("ON TIME", 5, 90)
    assert bands(16, 0.89) == ("DELAYED", 15, 89)


def test_default_event(spark):
    df = spark.createDataFrame([("dl1 ",), ("",)], "query string").withColumn("flight", F.lit(None).cast(rules_flight_type()))
    rows = {r["query"]: r["flight"] for r in rules.default_event(df).collect()}
    assert rows["dl1 "]["flight_id"] == "DL1" and rows[""]["flight_id"] == "UNK000"
    assert (rows[""]["origin"], rows[""]["destination"], rows[""]["dest_latitude"]) == ("ORD", "DFW", 32.8998)


def rules_flight_type():
    from tarmac.sources.schemas import EVENT

    return EVENT["flight"].dataType


def test_programme_without_members_is_not_active(spark):
    rows = [("ORD", '{"groundStop":{}}'), ("JFK", '{"groundStop":{},"arrivalDelay":{"reason":"volume"}}'), ("LAX", '{"groundStop":{"other":1}}')]
    events = parse_airport_events(spark.createDataFrame(rows, "airport_id string, payload string"))
    flights = spark.createDataFrame([(r[0],) for r in rows], "destination string")
    got = lookups.join_events(flights, events).select("destination", rules.atc_constraint(F.col("programme")).alias("p")).collect()
    assert {r["destination"]: r["p"]["notam_type"] for r in got} == {"ORD": "None", "JFK": "ATC ARRIVAL DELAY", "LAX": "FAA GROUND STOP"}
    listed = spark.createDataFrame([('[{"airportId":"ORD","groundStop":{}},{"airportId":"JFK","groundDelay":{"reason":"wind"}}]',)], "payload string")
    assert {r["airport_id"]: (r["seq"], r["groundStop"], r["groundDelay"] and r["groundDelay"]["reason"]) for r in parse_airport_event_list(listed).collect()} == {
        "ORD": (0, None, None), "JFK": (1, None, "wind")
    }
