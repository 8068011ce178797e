"""Geography on latitude and longitude in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2) / 1000


def within_radius(lat: Column, lon: Column, lat0: float, lon0: float, metres: float) -> Column:
    return haversine_m(lat, lon, F.lit(lat0), F.lit(lon0)) <= metres


def within_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)
