"""Distances on a sphere of radius 6371 km, fixed-point coordinates and bounding boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
_SCALE = 10_000_000


def fixed(degrees: Column) -> Column:
    """Units of 1e-7 degrees, cut towards zero."""
    return (degrees * F.lit(float(_SCALE))).cast("int")


def fixed_number(degrees: float) -> int:
    return int(degrees * _SCALE)


def check(latitude: float | None, longitude: float | None) -> None:
    """Both or neither null; finite; at most 90 and 180 degrees."""
    if (latitude is None) != (longitude is None):
        raise ValueError("latitude and longitude are null together or not at all")
    if latitude is not None and not (math.isfinite(latitude) and math.isfinite(longitude) and abs(latitude) <= 90 and abs(longitude) <= 180):
        raise ValueError("coordinates out of range")


def invalid(latitude: Column, longitude: Column) -> Column:
    """True for coordinates that ``check`` refuses."""
    lone = latitude.isNull() != longitude.isNull()
    far = F.isnan(latitude) | F.isnan(longitude) | (F.abs(latitude) > 90) | (F.abs(longitude) > 180)
    return lone | F.coalesce(far, F.lit(False))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km; null if a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(EARTH_KM * 2) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def box(latitude: float, longitude: float, km: float) -> tuple[float, float, float | None, float | None]:
    """South, north, west, east of a box around a circle; no west and east next to a pole, where all longitudes are near."""
    check(latitude, longitude)
    if not km >= 0:
        raise ValueError("a radius can't be negative")
    reach = math.degrees(km / EARTH_KM)
    south, north = max(-90.0, latitude - reach), min(90.0, latitude + reach)
    if abs(latitude) > 89.9 or reach / math.cos(math.radians(latitude)) >= 180:
        return south, north, None, None
    side = reach / math.cos(math.radians(latitude))
    west, east = longitude - side, longitude + side
    return south, north, west + 360 if west < -180 else west, east - 360 if east > 180 else east
