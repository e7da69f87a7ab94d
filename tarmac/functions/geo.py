"""Distances, units and flight-phase columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_NMI = 3440.065
FEET_PER_METRE = 3.28084
KNOTS_PER_METRE_PER_SECOND = 1.94384
FEET_PER_MINUTE_PER_METRE_PER_SECOND = 196.85


def haversine_nmi(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in nautical miles."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.atan2(F.sqrt(chord), F.sqrt(1 - chord)) * (2 * EARTH_RADIUS_NMI)


def half_even(value: Column) -> Column:
    return F.bround(value, 0).cast("bigint")


def si_to_aviation(altitude_m: Column, speed_mps: Column, climb_mps: Column) -> dict[str, Column]:
    """Feet, knots and feet per minute; an absent reading is 0."""
    zero = F.lit(0).cast("bigint")
    return {
        "altitude_ft": F.coalesce(half_even(altitude_m * FEET_PER_METRE), zero),
        "velocity_kts": F.coalesce(half_even(speed_mps * KNOTS_PER_METRE_PER_SECOND), zero),
        "vertical_rate_fpm": F.coalesce(half_even(climb_mps * FEET_PER_MINUTE_PER_METRE_PER_SECOND), zero),
    }


def is_landing_snapshot(on_ground: Column, altitude_m: Column, climb_mps: Column) -> Column:
    """Airborne, below 3,048 m and sinking faster than 1 m/s; an absent reading is no landing."""
    airborne = ~F.coalesce(on_ground, F.lit(False))
    low = F.coalesce(altitude_m < 3048, F.lit(False))
    sinking = F.coalesce(climb_mps < -1.0, F.lit(False))
    return airborne & low & sinking


def is_landing_route(altitude_ft: Column, distance_nmi: Column, speed_kts: Column) -> Column:
    return (altitude_ft < 10_000) & (distance_nmi < 50) & (speed_kts > 30)


def eta_minutes(distance_nmi: Column, speed_kts: Column) -> Column:
    """Minutes to the destination; 15 when the aircraft is too slow to tell."""
    moving = F.when(speed_kts > 50, speed_kts)
    return F.when(moving.isNotNull(), half_even((distance_nmi / moving) * 60)).otherwise(F.lit(15).cast("bigint"))


def flight_status(
    landing: Column, eta: Column, speed_kts: Column, distance_nmi: Column, base: Column, origin: Column, destination: Column
) -> Column:
    return (
        F.when(landing, F.concat(F.lit("Live - Landing Approach ("), eta.cast("string"), F.lit("m to touchdown)")))
        .when(
            speed_kts > 50,
            F.concat(F.lit("Live Airborne Radar ("), half_even(distance_nmi).cast("string"), F.lit(" nmi to dest)")),
        )
        .otherwise(F.concat(base, F.lit(" (Route: "), origin, F.lit(" -> "), destination, F.lit(")")))
    )


def fill_position(
    live: dict[str, Column], active: Column, origin: dict[str, Column], destination: dict[str, Column]
) -> dict[str, Column]:
    """Position to show: the live one, else mid-route for an active flight, else the origin.

    `live` has latitude, longitude, altitude and velocity; the ends have latitude, longitude.
    """
    known = live["latitude"].isNotNull() & live["longitude"].isNotNull()
    active = F.coalesce(active, F.lit(False))
    zero = F.lit(0).cast("bigint")

    def choose(on_live: Column, on_active: Column, on_ground: Column) -> Column:
        return F.when(known, on_live).when(active, on_active).otherwise(on_ground)

    def middle(axis: str) -> Column:
        return (origin[axis] + destination[axis]) / 2

    return {
        "latitude": choose(live["latitude"], middle("latitude"), origin["latitude"]),
        "longitude": choose(live["longitude"], middle("longitude"), origin["longitude"]),
        "altitude": choose(F.coalesce(live["altitude"], zero), F.lit(35_000).cast("bigint"), F.coalesce(live["altitude"], zero)),
        "velocity": choose(F.coalesce(live["velocity"], zero), F.lit(450).cast("bigint"), F.coalesce(live["velocity"], zero)),
        "base_status": choose(F.lit("Live Tracking"), F.lit("Live Airborne Radar"), F.lit("Scheduled")),
    }
