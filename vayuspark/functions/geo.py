"""Coordinates: distances, hashes, boxes, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vayuspark.vocab import COUNTRY_BOX, GRID_BOX

EARTH_KM = 6371.0
DEGREE_KM = 111.32


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def equirect_km(lat0: Column, lon0: Column, lat: Column, lon: Column) -> Column:
    """Flat distance seen from (lat0, lon0); good enough for the nearest of close nodes."""
    east = (lon - lon0) * F.cos(F.radians(lat0))
    return F.lit(DEGREE_KM) * F.sqrt(F.pow(lat - lat0, 2) + F.pow(east, 2))


def location_hash(lat: Column, lon: Column, digits: int = 3) -> Column:
    text = F.concat_ws(",", F.round(lat, digits).cast("string"), F.round(lon, digits).cast("string"))
    return F.substring(F.md5(text), 1, 8)


def in_box(lat: Column, lon: Column, box: tuple = COUNTRY_BOX) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def unit_coordinates(lat: Column, lon: Column, box: tuple = GRID_BOX) -> tuple[Column, Column]:
    return (lat - box[0]) / (box[1] - box[0]), (lon - box[2]) / (box[3] - box[2])


def grid_label(lat: Column, lon: Column, near: Column) -> Column:
    return F.format_string("Grid %.2fN %.2fE (near %s)", lat, lon, near)
