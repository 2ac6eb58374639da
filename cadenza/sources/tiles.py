"""The catalogue of elevation tiles: what file names tell, which tiles a route wants, what is missing and what to do about it.

Downloads themselves are left to a tool outside of the engine; these are its decisions as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.projection import conic

# fixed values: patterns of tile and archive names
BRITISH_TILE, FRENCH_TILE, FRENCH_ARCHIVE = r"^([A-Z]{2}\d{2}[a-z]{0,2})_", r"_(\d{4})_(\d{4})_MNT_LAMB93", r"RGEALTI_2-0_1M_ASC_LAMB93-IGN69_(D\w{3})_(\d{4}-\d{2}-\d{2})"
#: Fixed value: megabytes of a tile where nothing is known of it.
TILE_MB = 50


def leaf(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def british_tiles(files: DataFrame) -> DataFrame:
    """path, subtile, tile (its 10 km square) of terrain models; of other grids nothing, of names that do not fit nulls."""
    name = leaf(F.col("path"))
    sub = F.nullif(F.regexp_extract(name, BRITISH_TILE, 1), F.lit(""))
    return files.where(F.lower(name).endswith(".tif") & name.contains("_DTM_")).select("path", sub.alias("subtile"), F.substring(sub, 1, 4).alias("tile"))


def french_tiles(files: DataFrame) -> DataFrame:
    """path, e_km, n_km of the grids whose names tell their corner."""
    part = lambda k: F.regexp_extract(leaf(F.col("path")), FRENCH_TILE, k)
    return files.where(part(1) != "").select("path", part(1).cast("int").alias("e_km"), part(2).cast("int").alias("n_km"))


def wanted_french_tiles(files: DataFrame, keys: DataFrame) -> DataFrame:
    """The tiles among ``files`` whose corner is among ``keys`` (e_km, n_km)."""
    return french_tiles(files).join(keys.select("e_km", "n_km"), ["e_km", "n_km"], "left_semi")


def french_keys(boxes: DataFrame, key: str = "ride") -> DataFrame:
    """key, e_km, n_km: corners of the one-kilometre tiles that may touch a box (min_lon, min_lat, max_lon, max_lat).

    The box's four corners are put on the French grid and what lies around them is covered.  A tile is named by its north
    western corner, so one more row of tiles in the north belongs to it.
    """
    corner = lambda x, y: conic(F.col(y), F.col(x))
    four = [corner(x, y) for y in ("min_lat", "max_lat") for x in ("min_lon", "max_lon")]
    km = lambda c: F.floor(c.cast("long") / 1000).cast("int")
    b = boxes.select(key, *[c[a].alias(f"_{a}{i}") for i, c in enumerate(four) for a in "xy"])
    of = lambda pick, a: km(pick(*[F.col(f"_{a}{i}") for i in range(4)]))
    b = b.select(key, of(F.least, "x").alias("_e0"), of(F.greatest, "x").alias("_e1"), of(F.least, "y").alias("_n0"), of(F.greatest, "y").alias("_n1"))
    return b.select(key, F.explode(F.sequence("_e0", "_e1")).alias("e_km"), "_n0", "_n1").select(key, "e_km", F.explode(F.sequence(F.col("_n0"), F.col("_n1") + 1)).alias("n_km"))


def newest_archives(listings: DataFrame) -> DataFrame:
    """dept, archive: the newest archive of each department in texts of a listing (column ``text``)."""
    whole = F.explode(F.regexp_extract_all("text", F.lit(f"({FRENCH_ARCHIVE})"), F.lit(1)))
    found = listings.select(whole.alias("archive")).select(F.regexp_extract("archive", FRENCH_ARCHIVE, 1).alias("dept"), "archive")
    return found.groupBy("dept").agg(F.max("archive").alias("archive"))  # dates are written so that the last in order is the newest


def with_coverage(catalogue: DataFrame, new: DataFrame) -> DataFrame:
    """region, tile of both tables, each once; rows without a tile are none."""
    return catalogue.select("region", "tile").union(new.select("region", "tile")).where("tile IS NOT NULL").distinct()


def missing_tiles(wanted: DataFrame, catalogue: DataFrame, key: str = "ride") -> DataFrame:
    """key, n_missing, missing (in order), mb: tiles that a route wants and the catalogue has not.  Routes with none have no row."""
    left = wanted.select(key, "region", "tile").distinct().join(catalogue.select("region", "tile"), ["region", "tile"], "left_anti")
    return left.groupBy(key).agg(F.count(F.lit(1)).alias("n_missing"), F.sort_array(F.collect_list("tile")).alias("missing")).withColumn("mb", F.col("n_missing") * F.lit(TILE_MB))


def coverage_policy(flag: Column, interactive: Column, has_key: Column) -> Column:
    """What is done about a gap: what the flag says, else ask where someone can answer, else the service with a key, else skip."""
    return F.coalesce(flag, F.when(interactive, "prompt").when(has_key, "api").otherwise("skip"))


#: Answers to the question about a gap.
ANSWERS = {"": "download", "d": "download", "download": "download", "a": "api", "api": "api", "s": "skip", "skip": "skip", "q": "quit", "quit": "quit"}


def policy_of_answer(answer: str) -> str | None:
    """The policy that an answer names; None: ask again."""
    return ANSWERS.get(answer.strip().lower())
