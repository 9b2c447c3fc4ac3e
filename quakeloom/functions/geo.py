"""Distances, boxes and areas on a sphere, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the two Earth radii in use (catalog and grid; places)
EARTH_KM = 6371.0088
PLACES_EARTH_KM = 6371.0


def _col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    """Great-circle distance; null in, null out."""
    p1, p2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    half_lat, half_lon = (p2 - p1) / 2.0, (F.radians(_col(lon2)) - F.radians(_col(lon1))) / 2.0
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(p1) * F.cos(p2) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def box(lat, lon, radius_km, earth_km: float = EARTH_KM) -> tuple[Column, Column, Column, Column]:
    """(south, north, west, east) that hold a circle, by a hair more than it needs; any longitude where it
    reaches a pole. Longitudes are not wrapped."""
    lat, lon = _col(lat), _col(lon)
    angle = _col(radius_km) / earth_km
    dlat = F.degrees(angle) + 1e-9
    dlon = F.when(F.abs(lat) + dlat < 90, F.degrees(F.asin(F.sin(angle) / F.cos(F.radians(lat)))) + 1e-9).otherwise(F.lit(360.0))
    return lat - dlat, lat + dlat, lon - dlon, lon + dlon


def cell_area_km2(south, north, width_degrees: float) -> Column:
    """Area of a latitude-longitude quadrilateral."""
    return F.lit(EARTH_KM**2) * F.radians(F.lit(float(width_degrees))) * F.abs(F.sin(F.radians(_col(north))) - F.sin(F.radians(_col(south))))


def flat_area_km2(south, north, west, east) -> Column:
    """Area of a region as a rectangle as wide as it is at its middle latitude."""
    height = F.radians(_col(north) - _col(south)) * EARTH_KM
    width = F.radians(_col(east) - _col(west)) * EARTH_KM * F.cos(F.radians((_col(south) + _col(north)) / 2))
    return F.abs(height * width)


def wrap_longitude(lon) -> Column:
    lon = _col(lon)
    return F.when(lon > 180, lon - 360).otherwise(lon)


def circular_mean(weight, degrees) -> Column:
    """Aggregate: weighted mean of directions in [0, 360); null where they cancel out."""
    x, y = F.sum(_col(weight) * F.cos(F.radians(_col(degrees)))), F.sum(_col(weight) * F.sin(F.radians(_col(degrees))))
    angle = F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))
    return F.when(F.hypot(x, y) > 1e-12, F.when(angle >= 360.0, 0.0).otherwise(angle))


def unit_vector(lat, lon) -> tuple[Column, Column, Column]:
    """A point of the sphere as (x, y, z); any longitude will do, wrapped or not."""
    p, l = F.radians(_col(lat)), F.radians(_col(lon))
    return F.cos(p) * F.cos(l), F.cos(p) * F.sin(l), F.sin(p)


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _angle(a: list[Column], b: list[Column]) -> Column:
    chord = F.sqrt(_dot([u - v for u, v in zip(a, b, strict=True)], [u - v for u, v in zip(a, b, strict=True)]))
    return 2 * F.asin(F.least(F.lit(1.0), chord / 2))


def arc_distance(p: list[Column], a: list[Column], b: list[Column]) -> Column:
    """Angle between a point and the shorter arc from ``a`` to ``b``, all unit vectors.

    Where the foot of the point on the great circle lies between the ends it is the angle to the circle,
    else that to the nearer end."""
    n = _cross(a, b)
    size = F.sqrt(_dot(n, n))
    between = (size > 1e-12) & (_dot(_cross(n, a), p) >= 0) & (_dot(_cross(b, n), p) >= 0)
    across = F.asin(F.least(F.lit(1.0), F.abs(_dot(n, p)) / size))
    return F.when(between, across).otherwise(F.least(_angle(p, a), _angle(p, b)))
