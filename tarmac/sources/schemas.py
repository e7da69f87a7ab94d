"""Explicit schemas: nothing is inferred when a table is read."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
}


def _struct(text: str = "", **nested: T.DataType) -> T.StructType:
    """Fields written as `name type, name type`, then nested ones."""
    fields = [field.split() for field in text.split(",") if field.strip()]
    flat = [T.StructField(name, _TYPES[kind]) for name, kind in fields]
    return T.StructType(flat + [T.StructField(name, kind) for name, kind in nested.items()])


# Raw flight record. FL_DATE stays a string here: bad dates are dropped later, not at parse.
RAW_FLIGHT = _struct(
    """
    FL_DATE string, AIRLINE string, AIRLINE_CODE string, DOT_CODE bigint, FL_NUMBER bigint,
    ORIGIN string, ORIGIN_CITY string, DEST string, DEST_CITY string,
    CRS_DEP_TIME int, DEP_TIME double, DEP_DELAY double, TAXI_OUT double,
    WHEELS_OFF double, WHEELS_ON double, TAXI_IN double,
    CRS_ARR_TIME int, ARR_TIME double, ARR_DELAY double,
    CANCELLED double, CANCELLATION_CODE string, DIVERTED double,
    CRS_ELAPSED_TIME double, ELAPSED_TIME double, AIR_TIME double, DISTANCE double,
    DELAY_DUE_CARRIER double, DELAY_DUE_WEATHER double, DELAY_DUE_NAS double,
    DELAY_DUE_SECURITY double, DELAY_DUE_LATE_AIRCRAFT double
    """
)

# Normalised flight record, in this column order.
FLIGHT = _struct(
    """
    YEAR int, MONTH int, DAY int, DAY_OF_WEEK int, AIRLINE string, FLIGHT_NUMBER string,
    ORIGIN_AIRPORT string, DESTINATION_AIRPORT string, SCHEDULED_DEPARTURE int,
    DEPARTURE_DELAY double, CANCELLED double, WEATHER_DELAY double
    """
)

# Hourly weather, one row per airport and hour.
HOURLY_WEATHER = _struct(
    """
    AIRPORT string, YEAR int, MONTH int, DAY int, HOUR int,
    precipitation double, wind_speed_10m double
    """
)

# One airport's hourly document: parallel arrays.
HOURLY_DOCUMENT = _struct(
    hourly=_struct(
        time=T.ArrayType(T.StringType()),
        precipitation=T.ArrayType(T.DoubleType()),
        wind_speed_10m=T.ArrayType(T.DoubleType()),
    )
)

# Current weather of an airport, and its daily document of one-element arrays.
CURRENT_DOCUMENT = _struct(
    current=_struct("temperature_2m double, precipitation double, windspeed_10m double, weather_code double")
)
DAILY_DOCUMENT = _struct(
    daily=_struct(
        time=T.ArrayType(T.StringType()),
        weathercode=T.ArrayType(T.DoubleType()),
        temperature_2m_max=T.ArrayType(T.DoubleType()),
        precipitation_sum=T.ArrayType(T.DoubleType()),
        windspeed_10m_max=T.ArrayType(T.DoubleType()),
    )
)

# Raw reports of weather stations.
REPORT = T.StructType(
    [T.StructField("station", T.StringType()), T.StructField("valid", T.TimestampNTZType()), T.StructField("metar", T.StringType())]
)

# One airport's programme document; avgDelay may be a number or a text, so it is a text here.
AIRPORT_EVENT = _struct(
    groundStop=_struct("reason string"),
    groundDelay=_struct("reason string, avgDelay string"),
    arrivalDelay=_struct("reason string"),
)

# One observation document list of a station.
REPORT_DOCUMENT = T.ArrayType(_struct("rawOb string"))

# The event record: one row per flight and date, every field nullable.
EVENT = _struct(
    "mode string, query string, timestamp string",
    flight=_struct(
        """
        flight_id string, carrier string, origin string, destination string,
        scheduled_departure string, latitude double, longitude double,
        origin_latitude double, origin_longitude double,
        dest_latitude double, dest_longitude double,
        altitude bigint, velocity bigint, status string, accumulated_delay bigint
        """
    ),
    weather=_struct(
        "origin_risk string, dest_risk string",
        conditions=_struct(
            """
            temperature double, windSpeed double, precipitation double,
            visibility string, cloudLayers string
            """
        ),
    ),
    metar=_struct("raw_origin string, raw_dest string"),
    risk=_struct("predicted_delay_minutes bigint, confidence_score double"),
    root_cause=_struct(
        "primary_cause string, secondary_cause string", faa_citations=T.ArrayType(T.StringType())
    ),
    notam=_struct(
        "active_notam boolean, notam_type string, message string, delay_penalty_minutes bigint"
    ),
    recommendation=_struct("action string, reasoning string"),
    ground_truth=_struct("actual_delay_minutes bigint, actual_action_taken string"),
)

# Answers of the outer route tiers: a search, a flight's own document, a provider's list.
ROUTE_SEARCH = _struct(results=T.ArrayType(_struct("id string", detail=_struct("schd_from string, schd_to string"))))
FLIGHT_TIMES = _struct(time=_struct(scheduled=_struct("departure bigint"), real=_struct("departure bigint")))
ROUTE_LIST = _struct(
    data=T.ArrayType(
        _struct(
            "flight_status string",
            departure=_struct("iata string, scheduled string, delay double, actual string"),
            arrival=_struct("iata string, actual string"),
        )
    )
)
