"""Distances on the sphere and grids, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
SEMICIRCLE = 180.0 / 2**31


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    # degrees are subtracted first: nearby ones without an error, where radians have lost digits that ranks rest on
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # null stays null


def degrees_of(semicircles: Column) -> Column:
    return semicircles * F.lit(SEMICIRCLE)


def flat_offset(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Squared degrees on the plane that touches at (lat0, lon0): orders neighbours by nearness."""
    return F.pow(lat - lat0, 2) + F.pow((lon - lon0) * F.cos(F.radians(lat0)), 2)


def os_grid_label(east: Column, north: Column) -> Column:
    """The 10 km label (two letters, two digits) of a National Grid position in metres."""
    e, n = F.floor(east / 100_000).cast("int"), F.floor(north / 100_000).cast("int")
    first = (19 - n) - (19 - n) % 5 + F.floor((e + 10) / 5).cast("int")
    second = ((19 - n) * 5) % 25 + e % 5
    # 25 letters: I is left out
    letter = lambda i: F.substring(F.lit("ABCDEFGHJKLMNOPQRSTUVWXYZ"), i + 1, F.lit(1))
    return F.concat(letter(first), letter(second), F.floor(east % 100_000 / 10_000).cast("int").cast("string"), F.floor(north % 100_000 / 10_000).cast("int").cast("string"))
