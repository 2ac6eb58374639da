"""Joins of rides with rides, segments, places and tiles.

Every range or overlap condition stands beside an equality on the ride, route or grid cell, so plans hash or
sort-merge and never compare all with all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.geo import degrees_of, flat_offset, haversine_m
from cadenza.operators.runs import runs
from cadenza.operators.windows import Keys, ordered


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Closed intervals that share a point."""
    return ~((hi1 < lo2) | (hi2 < lo1))


def tagged(points: DataFrame, spans: DataFrame, pos: str, lo: str, hi: str, by: Keys = ("ride",), carry: Sequence[str] = ()) -> DataFrame:
    """``points`` with the ``carry`` columns of ``spans`` that contain them (lo <= pos <= hi), a row for each; others go.

    One sorted pass of points and ends of spans counts how many spans began and how many ended before a point: as ends
    follow each other like beginnings, those in between are the ones that contain it, told by their place in the ride.
    So a point never meets a span that it is not in.  Spans inside an earlier one break that order and are joined on the
    ride with their range.
    """
    keys = list(by)
    order = Window.partitionBy(*keys).orderBy("_lo", "_hi", *carry)
    own = spans.select(*keys, *carry, F.col(lo).cast("double").alias("_lo"), F.col(hi).cast("double").alias("_hi")).where("_lo <= _hi")
    own = own.withColumn("_far", F.max("_hi").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    nested = F.coalesce(F.col("_hi") < F.col("_far"), F.lit(False))
    row = own.where(~nested).withColumn("_no", F.row_number().over(order))
    at = F.array(F.struct(F.col("_lo").alias("x"), F.lit(0).alias("kind")), F.struct(F.col("_hi").alias("x"), F.lit(2).alias("kind")))
    ends = row.select(*keys, F.explode(at).alias("_at")).select(*keys, F.col("_at.x").alias("_x"), F.col("_at.kind").alias("_kind"))
    rows = points.withColumns({"_x": F.col(pos).cast("double"), "_kind": F.lit(1)}).unionByName(ends, allowMissingColumns=True)
    past = Window.partitionBy(*keys).orderBy("_x", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_begun": F.count_if(F.col("_kind") == 0).over(past), "_ended": F.count_if(F.col("_kind") == 2).over(past)}).where("_kind = 1 AND _begun > _ended")
    rows = rows.withColumn("_no", F.explode(F.sequence((F.col("_ended") + 1).cast("int"), F.col("_begun").cast("int"))))
    out = rows.join(row.select(*keys, "_no", *carry), [*keys, "_no"]).select(*points.columns, *carry)
    inner = own.where(nested).select(*keys, *carry, "_lo", "_hi")
    return out.unionByName(points.join(inner, keys).where(F.col(pos).between(F.col("_lo"), F.col("_hi"))).select(*points.columns, *carry))


def not_overlapping(a: DataFrame, b: DataFrame, by: Keys = ("ride",)) -> DataFrame:
    """Rows of ``a`` (start_km, end_km) that overlap no row of ``b``."""
    x, y = a.alias("x"), b.select(*by, "start_km", "end_km").alias("y")
    on = overlap(F.col("x.start_km"), F.col("x.end_km"), F.col("y.start_km"), F.col("y.end_km"))
    for k in by:
        on = (F.col(f"x.{k}") == F.col(f"y.{k}")) & on
    return x.join(y, on, "left_anti")


def cross_validate(found: DataFrame, verified: DataFrame, by: Keys = ("ride",)) -> DataFrame:
    """by, kind (matched, gap, extra), found_no, verified_no, delta_pp.

    Each found climb takes the first verified climb in list order that overlaps it; found climbs without one are
    gaps in coverage, verified climbs that overlap none are extras.
    """
    f = found.select(*by, F.col("climb_no").alias("found_no"), F.col("start_km").alias("fs"), F.col("end_km").alias("fe"), F.col("max_grade_pct").alias("fg"))
    v = verified.select(*by, F.col("climb_no").alias("verified_no"), F.col("start_km").alias("vs"), F.col("end_km").alias("ve"), F.col("peak_pct").alias("vg"))
    hits = f.join(v, list(by)).where(overlap(F.col("fs"), F.col("fe"), F.col("vs"), F.col("ve")))
    first = hits.groupBy(*by, "found_no").agg(F.min_by(F.struct("verified_no", "vg", "fg"), "verified_no").alias("m"))
    matched = first.select(*by, F.lit("matched").alias("kind"), "found_no", F.col("m.verified_no").alias("verified_no"), (F.col("m.vg") - F.col("m.fg")).alias("delta_pp"))
    none = F.lit(None)
    gaps = f.join(hits.select(*by, "found_no").distinct(), [*by, "found_no"], "left_anti").select(*by, F.lit("gap").alias("kind"), "found_no", none.cast("int").alias("verified_no"), none.cast("double").alias("delta_pp"))
    extras = v.join(hits.select(*by, "verified_no").distinct(), [*by, "verified_no"], "left_anti").select(*by, F.lit("extra").alias("kind"), none.cast("int").alias("found_no"), "verified_no", none.cast("double").alias("delta_pp"))
    return matched.unionByName(gaps).unionByName(extras)


def align_rides(a: DataFrame, b: DataFrame, by: Keys = ()) -> DataFrame:
    """Two riders at common timestamps: the last record of each second, both with a position.

    Records: by, seq, ts, position_lat, position_long (semicircles), enhanced_altitude, altitude, enhanced_speed,
    speed, power, heart_rate, distance.  An altitude or speed of 0 counts as missing.
    """

    def side(r: DataFrame, n: int) -> DataFrame:
        last = r.where("ts IS NOT NULL").groupBy(*by, "ts").agg(F.max_by(F.struct(*[c for c in r.columns if c not in (*by, "ts")]), "seq").alias("r"))
        truthy = lambda x, y: F.coalesce(F.when(F.col(f"r.{x}") != 0, F.col(f"r.{x}")), F.col(f"r.{y}"))
        return last.where("r.position_lat IS NOT NULL AND r.position_long IS NOT NULL").select(
            *by, "ts", degrees_of(F.col("r.position_lat")).alias(f"lat{n}"), degrees_of(F.col("r.position_long")).alias(f"lon{n}"), truthy("enhanced_altitude", "altitude").alias(f"alt{n}"),
            (F.coalesce(truthy("enhanced_speed", "speed"), F.lit(0.0)) * 3.6).alias(f"spd{n}"), F.col("r.power").alias(f"pwr{n}"), F.col("r.heart_rate").alias(f"hr{n}"), F.col("r.distance").alias(f"dist{n}"),
        )

    return side(a, 1).join(side(b, 2), [*by, "ts"])


def proximity_events(rows: DataFrame, by: Keys = ("pair",), close_m: float = 50.0, least_kmh: float = 25.0, most_pct: float = 1.5, least_samples: int = 15, half: int = 15) -> DataFrame:
    """Stretches of at least 15 common samples where both riders are close, fast and not climbing."""
    w = ordered(by, "ts").rowsBetween(-half, half)
    run = F.last("dist1").over(w) - F.first("dist1").over(w)
    r = rows.withColumns({"inter_m": haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), "grade": F.coalesce(F.when(run > 0, (F.last("alt1").over(w) - F.first("alt1").over(w)) / run * 100.0), F.lit(0.0))})
    near = (F.col("inter_m") <= close_m) & (F.col("spd1") >= least_kmh) & (F.col("spd2") >= least_kmh) & (F.col("grade") <= most_pct)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    aggs = [F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), (zero(F.min_by("dist1", "ts")) / 1000).alias("km_start"), (zero(F.max_by("dist1", "ts")) / 1000).alias("km_end"), F.avg("inter_m").alias("avg_inter_m"), F.min("inter_m").alias("min_inter_m"), F.max("inter_m").alias("max_inter_m"), F.avg("grade").alias("avg_grade_pct")]
    for n in (1, 2):
        aggs += [F.avg(f"spd{n}").alias(f"avg_kmh_r{n}"), F.max(f"spd{n}").alias(f"max_kmh_r{n}"), zero(F.avg(f"pwr{n}")).alias(f"avg_pwr_r{n}"), zero(F.max(f"pwr{n}")).alias(f"max_pwr_r{n}"), zero(F.avg(f"hr{n}")).alias(f"avg_hr_r{n}")]
    return runs(r, near, aggs, by, "ts", least_samples)


def chase_episodes(events: DataFrame, by: Keys = ("pair",)) -> DataFrame:
    """Events with spread_m, score and rank: long ones whose gap opens and closes come first."""
    e = events.withColumn("spread_m", F.col("max_inter_m") - F.col("min_inter_m")).withColumn("score", F.col("samples") * 0.5 + F.col("spread_m"))
    return e.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "run")))


def merge_devices(a: DataFrame, b: DataFrame, key: str = "pair") -> DataFrame:
    """Two devices of one ride: whose terrain, heart rate and power to use, and what does not fit together.

    Summaries: key, sport, start_time, distance_km, ascent_m, ascent_stored boolean, auto_pause_s, has_hr, has_power,
    avg_hr, avg_w.
    """
    x = a.select(key, *[F.col(c).alias(f"a_{c}") for c in a.columns if c != key]).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in b.columns if c != key]), key)
    score = lambda s: F.when((F.col(f"{s}_ascent_m") > 0) & F.col(f"{s}_ascent_stored"), 2).otherwise(0) + F.when(F.col(f"{s}_auto_pause_s") > 30, 1).otherwise(0)
    x = x.withColumn("terrain", F.when(score("b") > score("a"), "B").otherwise("A"))
    pick = lambda flag: F.when(F.col("terrain") == "A", F.when(F.col(f"a_{flag}"), "A").when(F.col(f"b_{flag}"), "B")).otherwise(F.when(F.col(f"b_{flag}"), "B").when(F.col(f"a_{flag}"), "A"))
    of = lambda label, c: F.when(F.col(label) == "A", F.col(f"a_{c}")).when(F.col(label) == "B", F.col(f"b_{c}"))
    x = x.withColumns({"hr_source": pick("has_hr"), "power_source": pick("has_power")})
    apart = F.abs(F.unix_seconds(F.col("a_start_time").cast("timestamp")) - F.unix_seconds(F.col("b_start_time").cast("timestamp")))
    off = F.when((F.col("a_distance_km") > 0) & (F.col("b_distance_km") > 0), F.abs(F.col("a_distance_km") - F.col("b_distance_km")) / F.greatest("a_distance_km", "b_distance_km") * 100)
    warn = F.array_compact(F.array(F.when((F.col("a_sport") != "") & (F.col("b_sport") != "") & (F.col("a_sport") != F.col("b_sport")), "sport"), F.when(apart > 1800, "start"), F.when(off > 5, "distance")))
    return x.select(key, "terrain", "hr_source", "power_source", of("terrain", "distance_km").alias("distance_km"), of("terrain", "ascent_m").alias("ascent_m"), of("hr_source", "avg_hr").alias("avg_hr"), of("power_source", "avg_w").alias("avg_w"), F.array_join(warn, ",").alias("warnings"))


#: Degrees of a side of the cells in which a route's points are looked up.
NEAR_CELL = 0.002


def nearest_on_route(places: DataFrame, points: DataFrame, by: Keys = ("ride",), key: str = "idx", cell: float = NEAR_CELL) -> DataFrame:
    """by, key, km, off_m: the route point nearest to each place (lat, lon); ties go to the earlier point.

    A route's points lie in grid cells, each with the box around them.  A place meets the cells of its route first: no
    point of a cell is nearer than its box, and none is needed that is farther than any cell's first point.  Only points
    of cells that may hold the nearest one are looked at.  Points without a position count for nothing.
    """
    keys = list(by)
    at = points.where("lat IS NOT NULL AND lon IS NOT NULL").select(*keys, "seq", "lat", "lon", "cum_m", F.floor(F.col("lat") / F.lit(cell)).alias("_cy"), F.floor(F.col("lon") / F.lit(cell)).alias("_cx"))
    cells = at.groupBy(*keys, "_cy", "_cx").agg(F.min("lat").alias("_s"), F.max("lat").alias("_n"), F.min("lon").alias("_w"), F.max("lon").alias("_e"), F.min_by(F.struct("lat", "lon"), "seq").alias("_first"))
    p = places.select(*keys, key, F.col("lat").alias("_la"), F.col("lon").alias("_lo"))
    la, lo = F.col("_la"), F.col("_lo")
    # the box's point that is nearest to the place
    edge = flat_offset(F.greatest(F.col("_s"), F.least(F.col("_n"), la)), F.greatest(F.col("_w"), F.least(F.col("_e"), lo)), la, lo)
    tried = p.join(cells, keys).withColumns({"_least": edge, "_most": flat_offset(F.col("_first.lat"), F.col("_first.lon"), la, lo)})
    tried = tried.withColumn("_stop", F.min("_most").over(Window.partitionBy(*keys, key))).where(F.col("_least") <= F.col("_stop") * (1 + 1e-9) + 1e-18)
    pairs = tried.select(*keys, key, "_la", "_lo", "_cy", "_cx").join(at, [*keys, "_cy", "_cx"])
    best = pairs.groupBy(*keys, key).agg(F.min_by(F.struct("lat", "lon", "cum_m", "_la", "_lo"), F.struct(flat_offset(F.col("lat"), F.col("lon"), la, lo), F.col("seq"))).alias("n"))
    return best.select(*keys, key, (F.col("n.cum_m") / 1000).alias("km"), haversine_m(F.col("n.lat"), F.col("n.lon"), F.col("n._la"), F.col("n._lo")).alias("off_m"))


def regions_of(boxes: DataFrame, regions: DataFrame, key: str = "ride") -> DataFrame:
    """key, region: regions (region, min_lon, min_lat, max_lon, max_lat) that a bounding box touches, by one-degree cells."""

    def cells(df: DataFrame) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(lo).cast("int"), F.floor(hi).cast("int"))
        return df.withColumn("_x", F.explode(span("min_lon", "max_lon"))).withColumn("_y", F.explode(span("min_lat", "max_lat")))

    a, b = cells(boxes).alias("a"), cells(regions).alias("b")
    on = (F.col("a._x") == F.col("b._x")) & (F.col("a._y") == F.col("b._y"))
    meet = overlap(F.col("a.min_lon"), F.col("a.max_lon"), F.col("b.min_lon"), F.col("b.max_lon")) & overlap(F.col("a.min_lat"), F.col("a.max_lat"), F.col("b.min_lat"), F.col("b.max_lat"))
    return a.join(b, on).where(meet).select(F.col(f"a.{key}").alias(key), F.col("b.region").alias("region")).distinct()


def bike_by_power(bikes: DataFrame, rides: DataFrame) -> DataFrame:
    """ride, bike: the only bike that has (or lacks) a power meter as the ride does; null if there are more or none."""
    one = bikes.groupBy("has_power_meter").agg(F.when(F.count(F.lit(1)) == 1, F.min("slug")).alias("bike"))
    return rides.join(one, rides.has_power == one.has_power_meter, "left").select("ride", "bike")


def resolve_bike(rides: DataFrame) -> DataFrame:
    """bike and how it was chosen: flag, then power, then the word commute in the file name, then the default."""
    commute = F.when(F.lower("file").contains("commute"), F.col("commute_bike"))
    source = F.when(F.col("flag_bike").isNotNull(), "flag").when(F.col("power_bike").isNotNull(), "power").when(commute.isNotNull(), "filename").otherwise("default")
    return rides.select("ride", F.coalesce("flag_bike", "power_bike", commute, "default_bike").alias("bike"), source.alias("source"))


def same_day_file(rides: DataFrame, files: DataFrame, key: str = "ride") -> DataFrame:
    """key, path: the newest file of the ride's date, else the newest of all (rider, path, day)."""
    newest = files.groupBy("rider").agg(F.max("path").alias("_any"))
    daily = files.groupBy("rider", "day").agg(F.max("path").alias("_day"))
    return rides.join(daily, ["rider", "day"], "left").join(newest, "rider", "left").select(key, F.coalesce("_day", "_any").alias("path"))


def all_of(frames: Sequence[DataFrame], names: Sequence[str], column: str = "source") -> DataFrame:
    """Rows of all frames end to end, each with its name."""
    out = frames[0].withColumn(column, F.lit(names[0]))
    for f, n in zip(frames[1:], names[1:], strict=True):
        out = out.unionByName(f.withColumn(column, F.lit(n)))
    return out
