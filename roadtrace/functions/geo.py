"""Geodesy and angles as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Metres in a degree of latitude in the flat-earth conversions.
METRES_PER_DEGREE = 111_320.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def to_enu(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """East and north metres of a point from a reference point."""
    lat, lon, lat0, lon0 = map(_c, (lat, lon, lat0, lon0))
    return F.radians(lon - lon0) * EARTH_RADIUS_M * F.cos(F.radians(lat0)), F.radians(lat - lat0) * EARTH_RADIUS_M


def from_enu(east, north, lat0, lon0) -> tuple[Column, Column]:
    """Inverse of ``to_enu``: latitude and longitude."""
    east, north, lat0, lon0 = map(_c, (east, north, lat0, lon0))
    return lat0 + F.degrees(north / EARTH_RADIUS_M), lon0 + F.degrees(east / (EARTH_RADIUS_M * F.cos(F.radians(lat0))))


def to_ned(lat, lon, alt, lat0, lon0, alt0) -> tuple[Column, Column, Column]:
    """North, east and down metres on a flat earth."""
    lat, lon, alt, lat0, lon0, alt0 = map(_c, (lat, lon, alt, lat0, lon0, alt0))
    return (lat - lat0) * METRES_PER_DEGREE, (lon - lon0) * METRES_PER_DEGREE * F.cos(F.radians(lat0)), alt0 - alt


def from_ned(north, east, down, lat0, lon0, alt0) -> tuple[Column, Column, Column]:
    north, east, down, lat0, lon0, alt0 = map(_c, (north, east, down, lat0, lon0, alt0))
    return lat0 + north / METRES_PER_DEGREE, lon0 + east / (METRES_PER_DEGREE * F.cos(F.radians(lat0))), alt0 - down


def wrap_pi(angle) -> Column:
    """Angle in radians to (-pi, pi]."""
    angle = _c(angle)
    return F.atan2(F.sin(angle), F.cos(angle))


def wrap_deg(angle) -> Column:
    """Angle in degrees to [0, 360)."""
    return F.pmod(_c(angle), F.lit(360.0))


def ang_diff(a, b) -> Column:
    """Absolute difference of two angles in radians, 0 to pi."""
    return F.abs(wrap_pi(_c(a) - _c(b)))


def bearing(east, north) -> Column:
    """Clockwise from north, in radians."""
    return F.atan2(_c(east), _c(north))


def project_to_segment(px, py, ax, ay, bx, by) -> dict[str, Column]:
    """Foot point, distance, place along and share of the segment a-b that is nearest to p."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide((px - ax) * dx + (py - ay) * dy, square)))).otherwise(0.0)
    fx, fy = ax + t * dx, ay + t * dy
    return {"foot_e": fx, "foot_n": fy, "distance": F.sqrt((px - fx) ** 2 + (py - fy) ** 2), "along": t * F.sqrt(square), "t": t}


TWO_PI = 2 * math.pi
