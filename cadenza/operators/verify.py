"""Elevation rasters against routes: densified tracks, bilinear samples, verified climbs, stitched profiles.

``tiles``: tile_id, path_rank int (the smallest wins), x0, y0 (upper left corner), px, py (pixel sizes, py > 0 downwards), h, w
int, data array<float> row-major with null for holes; coordinates in degrees, or in those of ``epsg`` (int) where tiles
have that column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import projection
from cadenza.functions.geo import haversine_m
from cadenza.operators.joins import not_overlapping, tagged
from cadenza.operators.runs import rising_stretches
from cadenza.operators.windows import Keys, interpolate_gaps, ordered, span_grade, track_distance, values_at
from cadenza.sources.external import Services

#: Degrees or metres of a cell of the grid that brings points and blocks of tiles together.
CELL = {projection.EPSG_WGS84: 0.05, projection.EPSG_OSGB: 512.0, projection.EPSG_LAMBERT_93: 512.0}
#: Pixels of a side of the blocks that tiles are cut into before they are joined.
BLOCK = 256


def densify(points: DataFrame, stride_m: float, by: Keys = ("ride",), seq: str = "seq") -> DataFrame:
    """by, seq (numbered anew from 0), lat, lon: points at most ``stride_m`` apart on straight lines, all old ones kept."""
    w = ordered(by, seq)
    p = points.select(*by, seq, "lat", "lon", F.lead("lat").over(w).alias("_la"), F.lead("lon").over(w).alias("_lo"))
    n = F.greatest(F.lit(1), F.ceil(haversine_m(F.col("lat"), F.col("lon"), F.col("_la"), F.col("_lo")) / F.lit(stride_m)).cast("int"))
    p = p.withColumn("_n", F.when(F.col("_la").isNull(), 1).otherwise(n)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    share = F.col("_k") / F.col("_n")
    on = lambda a, b: F.when(F.col("_k") == 0, F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * share)
    return p.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy(seq, "_k")) - 1).cast("long").alias("seq"), on("lat", "_la").alias("lat"), on("lon", "_lo").alias("lon"))


def bilinear(row: Column, col: Column, h: Column, w: Column, data: Column, cut: tuple[Column, Column, Column] | None = None) -> Column:
    """Value between pixel centres; at the edge the nearest pixel; with holes the mean of the pixels there; else null.

    ``cut``: first row, first column and width of the block of the tile that ``data`` is.
    """
    r, c = row - 0.5, col - 0.5
    top, left, width = cut or (F.lit(0), F.lit(0), w)
    r0, c0 = F.floor(r).cast("int"), F.floor(c).cast("int")
    at = lambda i, j: F.nanvl(F.get(data, ((i - top) * width + j - left).cast("int")).cast("double"), F.lit(None).cast("double"))
    clip = lambda x, n: F.greatest(F.lit(0), F.least(n - 1, x))
    q = [at(r0, c0), at(r0, c0 + 1), at(r0 + 1, c0), at(r0 + 1, c0 + 1)]
    dr, dc = r - r0, c - c0
    full = q[0] * (1 - dr) * (1 - dc) + q[1] * (1 - dr) * dc + q[2] * dr * (1 - dc) + q[3] * dr * dc
    seen = F.array_compact(F.array(*q))
    mean = F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda s, x: s + x) / F.size(seen))
    edge = (r0 < 0) | (c0 < 0) | (r0 + 1 >= h) | (c0 + 1 >= w)
    return F.when(edge, at(clip(r0, h), clip(c0, w))).when(F.size(seen) == 4, full).otherwise(mean)


def tile_blocks(tiles: DataFrame, size: int = BLOCK) -> DataFrame:
    """Tiles cut into blocks of ``size`` pixels a side and one more all around: what goes through a join is a block, not a tile.

    Adds top, left (first row and column), bh, bw, and the block's own corners bx0, by0, bx1, by1.
    """
    starts = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0)), F.lit(size))
    t = tiles.withColumn("_r", F.explode(starts("h"))).withColumn("_c", F.explode(starts("w")))
    t = t.withColumns({"top": F.greatest(F.col("_r") - 1, F.lit(0)), "left": F.greatest(F.col("_c") - 1, F.lit(0))})
    t = t.withColumns({"bh": F.least(F.col("_r") + size + 1, F.col("h")) - F.col("top"), "bw": F.least(F.col("_c") + size + 1, F.col("w")) - F.col("left")})
    rows = F.transform(F.sequence(F.col("top"), F.col("top") + F.col("bh") - 1), lambda r: F.slice("data", r * F.col("w") + F.col("left") + 1, F.col("bw")))
    return t.withColumns({
        "data": F.flatten(rows),
        "bx0": F.col("x0") + F.col("_c") * F.col("px"), "bx1": F.col("x0") + F.least(F.col("_c") + size, F.col("w")) * F.col("px"),
        "by0": F.col("y0") - F.col("_r") * F.col("py"), "by1": F.col("y0") - F.least(F.col("_r") + size, F.col("h")) * F.col("py"),
    }).drop("_r", "_c")


def sample_tiles(points: DataFrame, tiles: DataFrame, by: Keys = ("ride",), out: str = "z", nodata: float | None = None) -> DataFrame:
    """Points with the elevation of the first tile in path order that covers them; null outside all and on holes.

    Points and blocks of tiles meet on grid cells, so a point is only tried against blocks near it.  Tiles with an
    ``epsg`` column are read in their own systems.
    """
    if nodata is not None:
        tiles = tiles.withColumn("data", F.transform("data", lambda v: F.when(v != nodata, v)))
    hits = None
    for epsg in CELL if "epsg" in tiles.columns else [projection.EPSG_WGS84]:
        own = tiles.where(F.coalesce("epsg", F.lit(projection.EPSG_WGS84)) == epsg) if "epsg" in tiles.columns else tiles
        cell = lambda c: F.floor(c / F.lit(CELL[epsg])).cast("int")  # noqa: B023, E731
        t = tile_blocks(own)
        t = t.withColumn("_cx", F.explode(F.sequence(cell(F.col("bx0")), cell(F.col("bx1"))))).withColumn("_cy", F.explode(F.sequence(cell(F.col("by1")), cell(F.col("by0")))))
        p = points.select(*by, "seq", projection.projected(F.col("lat"), F.col("lon"), epsg).alias("_p")).select(*by, "seq", F.col("_p.x").alias("_x"), F.col("_p.y").alias("_y"))
        p = p.withColumns({"_cx": cell(F.col("_x")), "_cy": cell(F.col("_y"))})
        t = t.select("_cx", "_cy", "path_rank", "x0", "y0", "bx0", "bx1", "by0", "by1", "px", "py", "h", "w", "top", "left", "bw", "data")
        hit = p.join(t, ["_cx", "_cy"]).where(F.col("_x").between(F.col("bx0"), F.col("bx1")) & F.col("_y").between(F.col("by1"), F.col("by0")))
        z = bilinear((F.col("y0") - F.col("_y")) / F.col("py"), (F.col("_x") - F.col("x0")) / F.col("px"), F.col("h"), F.col("w"), F.col("data"), (F.col("top"), F.col("left"), F.col("bw")))
        hit = hit.select(*by, "seq", "path_rank", z.alias("_z"))
        hits = hit if hits is None else hits.unionByName(hit)
    first = hits.groupBy(*by, "seq").agg(F.min_by("_z", "path_rank").alias("_z"))
    return points.join(first, [*by, "seq"], "left").withColumn(out, F.col("_z")).drop("_z")


def sampled_route(points: DataFrame, tiles: DataFrame, stride_m: float = 25.0, by: Keys = ("ride",), services: Services | None = None) -> DataFrame:
    """by, seq, lat, lon, cum_m, z (raw), e (gaps filled): a route densified and read from the raster.

    With ``services`` also asked: z stays the raster's own, and gaps take the service's elevations first.
    """
    dense = sample_tiles(densify(points, stride_m, by), tiles, by)
    if services:
        dense = services.filled(dense.withColumn("_own", F.col("z")), by)
        dense = interpolate_gaps(dense, "z", "e", by).withColumn("z", F.col("_own")).drop("_own")
        return track_distance(dense, by=by)
    return track_distance(interpolate_gaps(dense, "z", "e", by), by=by)


#: Grades of 30 m at which a climb's longest stretch is measured; windows of its mean-max curve; a wall's grade over 15 m and length.
ABOVE, SPANS_M, WALL_PCT, WALL_M = (8, 10, 12, 14), (25, 100, 500, 1000), 10.0, 30.0


def fine_profiles(points: DataFrame, climbs: DataFrame, tiles: DataFrame, by: Keys = ("ride",), key: str = "climb_no", stride_m: float = 5.0, services: Services | None = None) -> DataFrame:
    """by, key, seq, cum_m (from the climb's start), z, e, asked: the climbs' roads densified and read from the raster.

    ``services`` may snap the points to roads first, and are asked for places that no tile covers.  Climbs with fewer
    than two points, or without any elevation, have no rows.
    """
    keyed = [*by, key]
    spans = climbs.select(*keyed, (F.col("start_km") * 1000).alias("_s"), (F.col("end_km") * 1000).alias("_e"))
    inside = tagged(points.select(*by, "seq", "lat", "lon", "cum_m"), spans, "cum_m", "_s", "_e", by, [key])
    inside = services.snapped(inside, keyed) if services else inside
    dense = sample_tiles(densify(inside, stride_m, keyed), tiles, keyed)
    dense = services.filled(dense, keyed) if services else dense.withColumn("asked", F.lit(False))
    prof = track_distance(interpolate_gaps(dense, "z", "e", keyed), by=keyed)
    part = Window.partitionBy(*keyed)
    return prof.withColumns({"_any": F.count("z").over(part), "_rows": F.count(F.lit(1)).over(part)}).where("_any > 0 AND _rows > 1").drop("_any", "_rows")


def verify_climbs(points: DataFrame, climbs: DataFrame, tiles: DataFrame, by: Keys = ("ride",), key: str = "climb_no", stride_m: float = 5.0, services: Services | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """Climbs (start_km, end_km, max_grade_pct; points with cum_m) with what the raster says of them.

    verified_peak_pct over 30 m, delta_pp, length_above_8/10/12/14, mean-max grades over 25, 100, 500 and 1000 m, walls,
    length and gain, fallback_used.  Climbs with fewer than two points or without raster are unverified: null peak.
    ``profiles``: what ``fine_profiles`` gave, if it is there already.
    """
    keyed = [*by, key]
    prof = fine_profiles(points, climbs, tiles, by, key, stride_m, services) if profiles is None else profiles
    part = ", ".join(f"`{k}`" for k in keyed)
    g = span_grade(span_grade(prof, "cum_m", "e", 30.0, "_g30", keyed), "cum_m", "e", 15.0, "_g15", keyed)
    ahead = {f"_p{m}": F.expr(f"min_by(struct(cum_m AS d, e), seq) OVER (PARTITION BY {part} ORDER BY -cum_m RANGE BETWEEN UNBOUNDED PRECEDING AND {float(m)}D PRECEDING)") for m in SPANS_M}
    past = ordered(keyed).rowsBetween(Window.unboundedPreceding, 0)
    whole = ordered(keyed).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # where the last sample below a grade lies: what has risen since then is the stretch that ends here
    below = {f"_b{t}": F.last(F.when(F.col("_g30") < t, F.col("cum_m")), ignorenulls=True).over(past) for t in ABOVE}
    steep = F.col("_g15") >= WALL_PCT
    turn = F.when(steep != F.lag(steep).over(ordered(keyed)), 1).otherwise(0)
    g = g.withColumns(ahead | below | {"_d0": F.first("cum_m").over(whole), "_d1": F.last("cum_m").over(whole), "_turn": turn}).withColumn("_run", F.sum("_turn").over(past))
    stretch = lambda t: F.max(F.when(F.col("_g30") >= t, F.col("cum_m") - F.coalesce(f"_b{t}", "_d0")))
    rise = lambda m: F.max(F.when(F.col(f"_p{m}.d") > F.col("cum_m"), 100.0 * (F.col(f"_p{m}.e") - F.col("e")) / (F.col(f"_p{m}.d") - F.col("cum_m"))))
    # one row for each stretch of steep or other road, then one for each climb
    parts = g.groupBy(*keyed, "_run").agg(
        F.max("_g30").alias("_peak"), F.min(F.struct("seq", "e")).alias("_from"), F.max(F.struct("seq", "e")).alias("_to"), F.min("cum_m").alias("_s"), F.max("cum_m").alias("_t"), F.max("_g15").alias("_g"),
        F.first("_d0").alias("_d0"), F.first("_d1").alias("_d1"), F.bool_or("asked").alias("_asked"), *[stretch(t).alias(f"_a{t}") for t in ABOVE], *[rise(m).alias(f"_m{m}") for m in SPANS_M],
    )
    total = F.col("_d1") - F.col("_d0")
    wall = F.struct((F.col("_s") - F.col("_d0")).alias("offset_m"), (F.col("_t") - F.col("_s")).alias("length_m"), F.col("_g").alias("peak_pct"), F.when(total > 0, 100.0 * (F.col("_s") - F.col("_d0")) / total).otherwise(F.lit(0.0)).alias("pct_in"))
    walls_ = F.sort_array(F.collect_list(F.when((F.col("_g") >= WALL_PCT) & (F.col("_t") - F.col("_s") >= WALL_M), wall)))
    seen = parts.groupBy(*keyed).agg(
        F.max("_peak").alias("verified_peak_pct"), (F.max("_t") - F.min("_s")).alias("verified_m"), (F.max("_to")["e"] - F.min("_from")["e"]).alias("verified_gain_m"),
        *[F.coalesce(F.max(f"_a{t}"), F.lit(0.0)).alias(f"length_above_{t}") for t in ABOVE], F.create_map(*[x for m in SPANS_M for x in (F.lit(f"peak_{m}m"), F.max(f"_m{m}"))]).alias("mean_max"), walls_.alias("walls"), F.bool_or("_asked").alias("fallback_used"),
    )
    out = climbs.join(seen, keyed, "left").withColumn("fallback_used", F.coalesce("fallback_used", F.lit(False)))
    return out.withColumn("delta_pp", F.col("verified_peak_pct") - F.col("max_grade_pct"))


def missed_climbs(points: DataFrame, climbs: DataFrame, tiles: DataFrame, by: Keys = ("ride",), services: Services | None = None, swept: DataFrame | None = None) -> DataFrame:
    """Climbs that only the raster shows: a coarse sweep, without those that overlap declared ones, verified finely.

    ``swept``: the route's own samples every 25 m (by, seq, cum_m, e), if they are there already.
    """
    swept = sampled_route(points, tiles, 25.0, by, services) if swept is None else swept
    sweep = rising_stretches(swept, "cum_m", "e", by=by)
    fresh = not_overlapping(sweep, climbs, by).withColumnRenamed("run", "climb_no").withColumnRenamed("peak_pct", "max_grade_pct")
    return verify_climbs(points, fresh, tiles, by, services=services)


def stitch(route: DataFrame, verified: DataFrame, segments: DataFrame, by: Keys = ("ride",), blend_m: float = 75.0) -> DataFrame:
    """by, d, e, w: a profile whose climbs are replaced by verified samples, with a linear taper ``blend_m`` around.

    ``route``: by, d, e; ``verified``: by, segment, d, e; ``segments``: by, segment, start_m, end_m.  The step between
    the two profiles at a climb's edge fades to nothing over the blend zone; zones of neighbours add up.  Both profiles
    are read at all edges in one sorted pass each.
    """
    keys = list(by)
    edges = segments.select(*keys, "segment", F.explode(F.array(F.struct(F.lit(False).alias("last"), F.col("start_m").alias("d")), F.struct(F.lit(True).alias("last"), F.col("end_m").alias("d")))).alias("_e")).select(*keys, "segment", "_e.last", F.col("_e.d").cast("double").alias("d"))
    fine_at = values_at(verified.select(*keys, "segment", "d", "e"), edges, "d", ["e"], [*keys, "segment"]).withColumnRenamed("e", "_fine")
    both = values_at(route.select(*keys, "d", "e"), fine_at, "d", ["e"], keys).where("_fine IS NOT NULL AND e IS NOT NULL").withColumn("_step", F.col("_fine") - F.col("e"))
    steps = both.groupBy(*keys, "segment").agg(F.max(F.when(~F.col("last"), F.col("_step"))).alias("_dh0"), F.max(F.when(F.col("last"), F.col("_step"))).alias("_dh1"), F.max(F.when(~F.col("last"), F.col("d"))).alias("start_m"), F.max(F.when(F.col("last"), F.col("d"))).alias("end_m"))
    steps = steps.withColumns({"_lo": F.col("start_m") - blend_m, "_hi": F.col("end_m") + blend_m})
    near = tagged(route.select(*keys, "d").distinct(), steps, "d", "_lo", "_hi", by, ["start_m", "end_m", "_dh0", "_dh1"])
    inside = F.col("d").between(F.col("start_m"), F.col("end_m"))
    before = F.col("d") < F.col("start_m")
    w = F.when(before, (F.col("d") - (F.col("start_m") - blend_m)) / F.lit(blend_m)).otherwise((F.col("end_m") + blend_m - F.col("d")) / F.lit(blend_m))
    moved = near.groupBy(*keys, "d").agg(F.bool_or(inside).alias("_in"), F.sum(F.when(~inside, w * F.when(before, F.col("_dh0")).otherwise(F.col("_dh1")))).alias("_add"), F.max(F.when(~inside, w)).alias("_w"))
    base = route.join(moved, [*keys, "d"], "left").where(~F.coalesce("_in", F.lit(False))).select(*keys, "d", (F.col("e") + F.coalesce("_add", F.lit(0.0))).alias("e"), F.coalesce("_w", F.lit(0.0)).alias("w"))
    fine = verified.join(segments, [*keys, "segment"]).where(F.col("d").between(F.col("start_m"), F.col("end_m"))).select(*keys, "d", "e", F.lit(1.0).alias("w"))
    return base.unionByName(fine)


def grid_tiles(boxes: DataFrame, size: float, key: str = "ride") -> DataFrame:
    """key, gx, gy: the grid cells that a box (min_x, min_y, max_x, max_y) touches."""
    span = lambda lo, hi: F.sequence(F.floor(lo / F.lit(size)).cast("long"), F.floor(hi / F.lit(size)).cast("long"))
    return boxes.select(key, F.explode(span(F.col("min_x"), F.col("max_x"))).alias("gx"), "min_y", "max_y").select(key, "gx", F.explode(span(F.col("min_y"), F.col("max_y"))).alias("gy"))


def os_tiles(boxes: DataFrame, key: str = "ride") -> DataFrame:
    """key, label: 10 km National Grid tiles that a box in grid metres touches."""
    from cadenza.functions.geo import os_grid_label

    return grid_tiles(boxes, 10_000.0, key).select(key, os_grid_label(F.col("gx") * 10_000, F.col("gy") * 10_000).alias("label")).distinct()
