"""Distances and boxes on the globe."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X


def _chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    return half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = _chord(lat1, lon1, lat2, lon2)
    return F.lit(2 * X.EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.lit(2 * X.EARTH_M) * F.asin(F.least(F.sqrt(_chord(lat1, lon1, lat2, lon2)), F.lit(1.0)))


def box_around(lat: float, lng: float, radius_km: float) -> tuple[float, float, float, float]:
    """Least and greatest latitude and longitude of a box that holds the circle."""
    dlat = radius_km / X.KM_PER_DEGREE
    dlng = radius_km / (X.KM_PER_DEGREE * max(math.cos(math.radians(lat)), 1e-6))
    return lat - dlat, lat + dlat, lng - dlng, lng + dlng


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[1]) & lng.between(box[2], box[3])


def cells(lat: Column, lng: Column, lat_step: float, lng_step: float) -> tuple[Column, Column]:
    return F.floor(lat / lat_step).cast("long"), F.floor(lng / lng_step).cast("long")
