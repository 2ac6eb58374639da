"""Names and keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def route_slug(path: Column) -> Column:
    """The last part of a file's name after '_', as at most three words of a-z and 0-9 with hyphens; 'ride' if empty."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.gpx$", "")
    last = F.lower(F.element_at(F.split(stem, "_"), -1))
    tidy = F.regexp_replace(F.regexp_replace(F.replace(last, F.lit(" "), F.lit("-")), "[^a-z0-9-]", ""), "-+", "-")
    slug = F.regexp_replace(F.array_join(F.slice(F.split(tidy, "-"), 1, 3), "-"), "-+$", "")
    return F.when(slug == "", "ride").otherwise(slug)


def date_prefix(path: Column) -> Column:
    """The date that opens a file's name, else null."""
    d = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(d != "", d.try_cast("date"))


def track_key(points: Column) -> Column:
    """Sixteen hexadecimal digits that tell a track (array of structs lat, lon) to six decimals."""
    pairs = F.transform(points, lambda p: F.format_string("[%.6f, %.6f]", p["lat"], p["lon"]))
    return F.substring(F.sha2(F.concat(F.lit("["), F.array_join(pairs, ", "), F.lit("]")), 256), 1, 16)
