"""Readers of route, raster and profile files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_POINT = "lat double, lon double, ele double"


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """route, name, seq, lat, lon, e, cum_m of the track points of GPX files; gaps in ``ele`` are interpolated.

    Files without points give no rows.  Segments and tracks of a file are laid end to end.
    """
    from cadenza.operators.windows import interpolate_gaps, track_distance

    pt = "struct<_lat:double,_lon:double,ele:double>"
    schema = f"trk array<struct<name:string,trkseg:array<struct<trkpt:array<{pt}>>>>>, metadata struct<name:string>"
    raw = spark.read.format("xml").option("rowTag", "gpx").schema(schema).load(path).select(F.input_file_name().alias("route"), F.coalesce("metadata.name", F.col("trk")[0]["name"]).alias("name"), F.flatten(F.transform("trk", lambda t: F.flatten(F.transform(t["trkseg"], lambda s: F.coalesce(s["trkpt"], F.array().cast(f"array<{pt}>")))))).alias("p"))
    pts = raw.select("route", "name", F.posexplode("p").alias("seq", "p")).select("route", "name", F.col("seq").cast("long").alias("seq"), F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.col("p.ele").alias("_ele"))
    return track_distance(interpolate_gaps(pts, "_ele", "e", ["route"]), by=["route"]).drop("_ele")


def read_waypoints(spark: SparkSession, path: str) -> DataFrame:
    """route, idx (from 1), lat, lon, name, sym, desc of the waypoints of GPX files; missing texts are ''."""
    w = "array<struct<_lat:double,_lon:double,name:string,sym:string,desc:string>>"
    raw = spark.read.format("xml").option("rowTag", "gpx").schema(f"wpt {w}").load(path).select(F.input_file_name().alias("route"), F.posexplode("wpt").alias("i", "w"))
    text = lambda c: F.coalesce(F.col(f"w.{c}"), F.lit("")).alias(c)
    return raw.select("route", (F.col("i") + 1).alias("idx"), F.col("w._lat").alias("lat"), F.col("w._lon").alias("lon"), text("name"), text("sym"), text("desc"))


def read_ascii_grids(spark: SparkSession, path: str) -> DataFrame:
    """Raster tiles from ESRI ASCII grids: one row a file, in path order, nodata as null."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("tile_id"), "value")
    head = lambda k: F.regexp_extract("value", rf"(?im)^\s*{k}\s+(\S+)", 1).cast("double")
    t = t.withColumns({"w": head("ncols").cast("int"), "h": head("nrows").cast("int"), "px": head("cellsize"), "x0": head("xllcorner"), "_y": head("yllcorner"), "_nd": head("NODATA_value")})
    cells = F.filter(F.split(F.regexp_replace("value", r"(?m)^\s*[A-Za-z].*$", ""), r"\s+"), lambda s: s != "")
    t = t.withColumn("data", F.transform(cells, lambda s: F.when(s.cast("double") == F.coalesce("_nd", F.lit(float("inf"))), None).otherwise(s.cast("float"))))
    # only the names are put in order
    ranks = t.select("tile_id").withColumn("path_rank", F.row_number().over(Window.orderBy("tile_id")))
    return t.join(ranks, "tile_id").select("tile_id", "path_rank", "x0", (F.col("_y") + F.col("h") * F.col("px")).alias("y0"), "px", F.col("px").alias("py"), "h", "w", "data")


_FRONT = re.compile(r"\A\s*---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\Z)", re.S)


def front_matter(text: str) -> dict:
    """The YAML block that opens a markdown text, after an HTML comment if there is one; {} if absent or broken.

    Values that hold a colon and a space are quoted if the block does not parse as it stands.
    """
    import yaml

    text = re.sub(r"\A\s*<!--.*?-->", "", text, count=1, flags=re.S)
    m = _FRONT.match(text)
    if not m:
        return {}
    for body in (m[1], quote_colons(m[1])):
        try:
            found = yaml.safe_load(body)
        except yaml.YAMLError:
            continue
        return found if isinstance(found, dict) else {}
    return {}


def quote_colons(body: str) -> str:
    """Quotes plain values that hold ': ' or end in ':'; block, flow and quoted values and comments stay."""
    out, block = [], None
    for line in body.split("\n"):
        depth = len(line) - len(line.lstrip(" "))
        if block is not None and (not line.strip() or depth > block):
            out.append(line)
            continue
        block = None
        key, colon, value = line.partition(":")
        plain = value.strip()
        if not (colon and key.strip() and not key.lstrip().startswith("#") and value[:1] in (" ", "\t") and plain):
            out.append(line)
            continue
        bare, mark, note = re.match(r"(.*?)(\s#)?((?<=\s#).*)?$", plain, re.S).groups()
        if plain[0] in "|>":
            block = depth
        elif plain[0] not in "\"'[{&*!#" and re.search(r":(\s|$)", bare):
            line = f'{key}: "' + bare.rstrip().replace("\\", "\\\\").replace('"', '\\"') + '"' + (f"{mark}{note or ''}" if mark else "")
        out.append(line)
    return "\n".join(out)


def merged_profile(defaults: dict, own: dict) -> dict:
    """Sections merge key by key, own values win; anything else is taken over whole."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in defaults.items()}
    for k, v in own.items():
        out[k] = {**out[k], **v} if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def bike_table(spark: SparkSession, profile: dict) -> DataFrame:
    """One row a bike of a profile; assists of either layout, malformed ones as null."""
    rows = []
    for slug, b in (profile.get("bikes") or {}).items():
        b = b or {}
        a = b.get("assist")
        assist = None
        if isinstance(a, dict):
            try:
                shares = a.get("level_share") or {k: v["share"] for k, v in (a.get("levels") or {}).items()}
                assist = {"rated_w": float(a["rated_w"]), "cutoff_kph": float(a.get("cutoff_kph", a.get("legal_cutoff_kph"))), "level_share": {str(k): float(v) for k, v in shares.items()}}
            except (KeyError, TypeError, ValueError):
                assist = None
        gears = b.get("gearing") or None
        rows.append((slug, b.get("name", slug), b.get("system_weight_kg_default"), b.get("cda"), b.get("drivetrain_efficiency"), b.get("wheel_circ_m"), bool(b.get("has_power_meter")), b.get("crr") or b.get("crr_by_surface") or {}, list((b.get("crr") or b.get("crr_by_surface") or {})), b.get("fr_split"), gears, assist))
    return spark.createDataFrame(rows, "slug string, name string, system_weight_kg double, cda double, efficiency double, wheel_circ_m double, has_power_meter boolean, crr_by_surface map<string,double>, surfaces array<string>, fr_split string, gearing struct<chainrings_t:array<int>,cassette_t:array<int>>, assist struct<rated_w:double,cutoff_kph:double,level_share:map<string,double>>")


def peers(profile: dict) -> dict:
    """Sections named peer_<name>, by name."""
    return {k.removeprefix("peer_"): v for k, v in profile.items() if k.startswith("peer_")}
