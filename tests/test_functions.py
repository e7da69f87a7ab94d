import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tarmac.functions import clock, geo, text


@pytest.mark.parametrize(
    "reading, expected",
    [
        (0, dt.datetime(2023, 11, 5, 0, 0)),
        (5, dt.datetime(2023, 11, 5, 0, 5)),
        (930, dt.datetime(2023, 11, 5, 9, 30)),
        (2359, dt.datetime(2023, 11, 5, 23, 59)),
        (2400, dt.datetime(2023, 11, 5, 0, 0)),
        (2575, None),
        (1260, None),
        (12345, dt.datetime(2023, 11, 5, 0, 0)),
        (-5, dt.datetime(2023, 11, 5, 0, 0)),
        (None, dt.datetime(2023, 11, 5, 0, 0)),
    ],
)
def test_scheduled_ts(one, reading, expected):
    assert one({}, clock.scheduled_ts(F.lit("2023-11-05").cast("date"), F.lit(reading).cast("int"))) == expected


@pytest.mark.parametrize("written, expected", [("905", 905), ("905.0", 905), ("9x5", None), ("905.5", None), (None, None)])
def test_clock_reading(one, written, expected):
    assert one({}, clock.clock_reading(F.lit(written).cast("string"))) == expected


def test_clock_parts(spark):
    rows = [("2400",), ("1435.0",), ("LIVE",), (None,), ("7",)]
    df = spark.createDataFrame(rows, "t string")
    got = {r["t"]: (r["HOUR"], r["MINUTE"], r["TIME_OF_DAY"]) for r in clock.clock_parts(df, "t", 1200).collect()}
    assert got == {"2400": (24, 0, 1440), "1435.0": (14, 35, 875), "LIVE": (12, 0, 720), None: (12, 0, 720), "7": (0, 7, 7)}
    numbers = spark.createDataFrame([(None,), (1905,)], "t int")
    assert sorted(r["HOUR"] for r in clock.clock_parts(numbers, "t").collect()) == [0, 19]


def test_weekday_starts_on_monday(one):
    monday, sunday = F.lit("2023-11-06").cast("date"), F.lit("2023-11-05").cast("date")
    assert one({}, clock.weekday_from_monday(monday), clock.weekday_from_monday(sunday)) == (1, 7)


def test_rush_hours(spark):
    rush = [r["id"] for r in spark.range(25).where(clock.is_rush(F.col("id")) == 1).collect()]
    assert sorted(rush) == [7, 8, 9, 16, 17, 18, 19]


@pytest.mark.parametrize("seconds, expected", [(59, None), (60, 1), (-60, None), (0, None), (4 * 60 + 59, 4)])
def test_epoch_delay(one, seconds, expected):
    assert one({}, clock.epoch_delay(F.lit(1_700_000_000), F.lit(1_700_000_000 + seconds))) == expected


def test_epoch_and_iso_hhmm(one):
    assert one({}, clock.epoch_hhmm(F.lit(1_700_000_000))) == "2213"
    assert one({}, clock.iso_hhmm(F.lit("2024-01-15T07:45:00+00:00"))) == "0745"
    assert one({}, clock.iso_hhmm(F.lit("tomorrow"))) is None


@pytest.mark.parametrize(
    "value, upper, expected",
    [(" dl ", True, "DL"), ("123.0", False, "123"), ("10.05", False, "10.05"), ("1000", False, "1000"), (None, False, None)],
)
def test_clean_key(one, value, upper, expected):
    assert one({}, text.clean_key(F.lit(value).cast("string"), upper)) == expected


@pytest.mark.parametrize(
    "written, minutes, duration",
    [
        ("45", 45, 45), ("37.9", 37, 37), ("20 minutes", 20, 20), ("1 hours 15 minutes", 1, 75),
        ("unknown", 45, 45), ("", 45, 45), (None, 45, 45), ("2 hours", 2, 120),
    ],
)
def test_programme_minutes(one, written, minutes, duration):
    value = F.lit(written).cast("string")
    assert one({}, text.first_int(value), text.duration_minutes(value)) == (minutes, duration)


def test_replies(one):
    reply = F.lit('Sure!\n{"primary_cause": "Fog", "search_query": "low visibility"}\nDone.')
    assert tuple(one({}, text.cause_reply(reply))) == ("Fog", "None", "low visibility")
    assert tuple(one({}, text.cause_reply(F.lit("{}")))) == ("Unknown", "None", "Unknown")
    assert one({}, text.cause_reply(F.lit("no idea"))) is None
    assert one({}, text.cause_reply(F.lit('{"primary_cause": "Fo'))) is None
    assert one({}, text.cause_reply(F.lit("{'primary_cause': 'Fog'}"))) is None
    action = one({}, text.action_reply(F.lit('{"Action": "HOLD", "action": ""}'), "GO", "why"))
    assert tuple(action) == ("HOLD", "why")


def test_haversine(one):
    def by_hand(a, b, c, d):
        p, q = math.radians(a), math.radians(c)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 3440.065 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    for a, b, c, d in [(40.6, -73.8, 33.9, -118.4), (0.0, 0.0, 0.0, 0.0), (10.0, 179.0, 10.0, -179.0)]:
        got = one({}, geo.haversine_nmi(*[F.lit(x) for x in (a, b, c, d)]))
        assert got == pytest.approx(by_hand(a, b, c, d), abs=1e-9)


def test_units_round_half_to_even(one):
    assert one({}, geo.half_even(F.lit(0.5)), geo.half_even(F.lit(1.5)), geo.half_even(F.lit(2.5))) == (0, 2, 2)
    none = F.lit(None).cast("double")
    assert one({}, *geo.si_to_aviation(none, none, none).values()) == (0, 0, 0)
    assert one({}, *geo.si_to_aviation(F.lit(3048.0), F.lit(100.0), F.lit(-2.0)).values()) == (10000, 194, -394)


def test_landing_limits(one):
    def snapshot(ground, altitude, climb):
        return one({}, geo.is_landing_snapshot(F.lit(ground), F.lit(altitude).cast("double"), F.lit(climb).cast("double")))

    assert snapshot(False, 3047.9, -1.1) is True
    assert snapshot(False, 3048.0, -1.1) is False
    assert snapshot(False, 100.0, -1.0) is False
    assert snapshot(True, 100.0, -5.0) is False
    assert snapshot(False, None, -5.0) is False
    assert snapshot(False, 100.0, None) is False

    def route(altitude, distance, speed):
        return one({}, geo.is_landing_route(F.lit(altitude), F.lit(distance), F.lit(speed)))

    assert route(9_999, 49.9, 31) is True
    assert route(10_000, 49.9, 31) is False
    assert route(9_999, 50.0, 31) is False
    assert route(9_999, 49.9, 30) is False


def test_eta(one):
    assert one({}, geo.eta_minutes(F.lit(100.0), F.lit(400))) == 15
    assert one({}, geo.eta_minutes(F.lit(90.0), F.lit(60))) == 90
    assert one({}, geo.eta_minutes(F.lit(90.0), F.lit(50))) == 15
    assert one({}, geo.eta_minutes(F.lit(90.0), F.lit(0))) == 15


def test_position_falls_back(one):
    ends = [{"latitude": F.lit(10.0), "longitude": F.lit(20.0)}, {"latitude": F.lit(30.0), "longitude": F.lit(40.0)}]

    def place(lat, active):
        live = {
            "latitude": F.lit(lat).cast("double"), "longitude": F.lit(5.0),
            "altitude": F.lit(7).cast("bigint"), "velocity": F.lit(8).cast("bigint"),
        }
        return one({}, *geo.fill_position(live, F.lit(active), *ends).values())

    assert place(1.0, True) == (1.0, 5.0, 7, 8, "Live Tracking")
    assert place(None, True) == (20.0, 30.0, 35_000, 450, "Live Airborne Radar")
    assert place(None, False) == (10.0, 20.0, 7, 8, "Scheduled")
