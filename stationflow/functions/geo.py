"""Distances and grid projection as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0  # fixed value: radius every distance is based on


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def distance_m(lat_a, lon_a, lat_b, lon_b) -> Column:
    """Great-circle metres (haversine), NULL when a coordinate is NULL."""
    lat_a, lon_a, lat_b, lon_b = map(as_column, (lat_a, lon_a, lat_b, lon_b))
    half_lat = F.sin(F.radians(lat_b - lat_a) / 2)
    half_lon = F.sin(F.radians(lon_b - lon_a) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half_lon * half_lon
    # least() skips NULL, so the NULL case is stated; rounding may push the chord just over 1
    safe = F.when(chord.isNotNull(), F.least(F.lit(1.0), chord))
    return F.asin(F.sqrt(safe)) * (2 * EARTH_RADIUS_M)


def whole_metres(metres: Column) -> Column:
    return F.round(metres).cast("int")


@dataclass(frozen=True)
class Frame:
    """Map extent as columns of one row."""

    min_lat: Column
    max_lat: Column
    min_lon: Column
    max_lon: Column

    def x(self, lon: Column, width: int) -> Column:
        return (lon - self.min_lon) / (self.max_lon - self.min_lon) * (width - 1)

    def y(self, lat: Column, height: int) -> Column:
        return (self.max_lat - lat) / (self.max_lat - self.min_lat) * (height - 1)

    def cell(self, lat: Column, lon: Column, width: int, height: int) -> tuple[Column, Column]:
        """Nearest cell, halves to the even cell, clamped to the grid."""
        x = F.bround(self.x(lon, width)).cast("int")
        y = F.bround(self.y(lat, height)).cast("int")
        return (
            F.least(F.lit(width - 1), F.greatest(F.lit(0), x)),
            F.least(F.lit(height - 1), F.greatest(F.lit(0), y)),
        )


def bounding_degrees(lat: float, radius_m: float) -> tuple[float, float]:
    """Half height and half width, in degrees, of a box that surely holds the circle."""
    from math import cos, degrees, radians

    half_lat = degrees(radius_m / EARTH_RADIUS_M) * 1.001
    shrink = cos(radians(min(89.9, abs(lat) + half_lat)))
    return half_lat, min(180.0, half_lat / shrink)
