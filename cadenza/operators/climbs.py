"""Sustained climbs of rides and routes: detection, steepest grade, category, selection, predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.physics import RIDER, Rider, predict_power, predict_speed, survival_power, vam
from cadenza.functions.scoring import SIGNIFICANT_INDEX, climb_category, climb_index, climb_points, significance, wall_multiplier
from cadenza.operators.joins import tagged
from cadenza.operators.windows import Keys, median_filter, onto_grid, ordered, smooth

GRID_M, REACH, STEP_M = 50.0, 2, 10.0


def grade_profile(df: DataFrame, d: str = "d", e: str = "e", median: int = 5, by: Keys = ("ride",), seq: str = "seq") -> DataFrame:
    """by, k, x, e, grade: elevation without spikes on a 10 m grid and its grade over 40 m; two cells at each end are 0."""
    flat = median_filter(df.select(*by, seq, d, e), e, median, "_e", by, seq)
    grid = onto_grid(flat, d, ["_e"], STEP_M, by)
    w = Window.partitionBy(*by).orderBy("k")
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    slope = (F.lead("_e", REACH).over(w) - F.lag("_e", REACH).over(w)) / (2 * REACH * STEP_M) * 100
    return grid.withColumns({"grade": F.coalesce(slope, F.lit(0.0)), "cells": n}).select(*by, "k", "x", F.col("_e").alias("e"), "grade", "cells")


def max_grade(df: DataFrame, segments: DataFrame, key: str = "climb_no", d: str = "d", e: str = "e", by: Keys = ("ride",), seq: str = "seq", pad_m: float = 100.0) -> DataFrame:
    """``segments`` with max_grade_pct: the steepest grade inside each segment (start_m, end_m), from samples up to 100 m around.

    0 for segments with fewer than five samples or four grid cells.
    """
    around = tagged(df.select(*by, seq, d, e), segments.withColumns({"_s": F.col("start_m") - pad_m, "_t": F.col("end_m") + pad_m}), d, "_s", "_t", by, [key, "start_m", "end_m"])
    keyed = [*by, key, "start_m", "end_m"]  # the bounds are part of the key, so they need no second join
    around = around.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keyed))).where("_n >= 5")
    prof = grade_profile(around, d, e, 5, keyed, seq).where("cells > 4")
    best = prof.where(F.col("x").between(F.col("start_m"), F.col("end_m"))).groupBy(*by, key).agg(F.max("grade").alias("_g"))
    return segments.join(best, [*by, key], "left").withColumn("max_grade_pct", F.coalesce("_g", F.lit(0.0))).drop("_g")


def find_climbs(df: DataFrame, d: str = "d", e: str = "e", least_m: float = 300.0, least_gain_m: float = 20.0, least_grade: float = 0.015, by: Keys = ("ride",), seq: str = "seq", mode: str = "zero") -> DataFrame:
    """by, climb_no, start_km, end_km, length_m, gain_m, avg_grade_pct, max_grade_pct.

    Smoothed elevation on a 50 m grid from 0; cells whose grade over 200 m exceeds ``least_grade`` make runs, and
    gaps of up to three cells are bridged where the grid goes on.  Rides below 50 samples or 100 m, or with four
    grid cells or fewer, have none.  Runs may end one cell past the grid, so a length may pass the route's end.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    long = df.select(*by, seq, d, e).withColumns({"_n": n, "_end": F.max_by(d, seq).over(Window.partitionBy(*by))}).where("_n >= 50 AND _end >= 100")
    soft = smooth(long, e, 15, "_s", by, seq, mode=mode, shrink=True)
    grid = onto_grid(soft, d, ["_s"], GRID_M, by, start=F.lit(0.0))
    w, part = Window.partitionBy(*by).orderBy("k"), Window.partitionBy(*by)
    g = grid.withColumns({"_cells": F.count(F.lit(1)).over(part), "_grade": F.coalesce((F.lead("_s", 2).over(w) - F.lag("_s", 2).over(w)) / 200.0, F.lit(0.0))}).where("_cells > 4")
    g = g.withColumn("_in", F.col("_grade") > least_grade)
    ahead = F.coalesce(F.lead("_in", 1).over(w), F.lit(False)) | F.coalesce(F.lead("_in", 2).over(w), F.lit(False)) | F.coalesce(F.lead("_in", 3).over(w), F.lit(False))
    g = g.withColumn("_on", F.col("_in") | ((F.col("k") + 4 < F.col("_cells")) & ahead))
    g = g.withColumn("_next", F.coalesce(F.lead("_s").over(w), F.col("_s")))  # where a run's gain ends: one cell on, or the grid's end
    g = g.withColumn("_g", F.col("k") - F.row_number().over(Window.partitionBy(*by, "_on").orderBy("k")))
    found = g.where("_on").groupBy(*by, "_g").agg(F.min(F.when(F.col("_in"), F.col("k"))).alias("i"), (F.max("k") + 1).alias("j"), F.first("_cells").alias("_cells"), F.min_by("_s", F.when(F.col("_in"), F.col("k"))).alias("_zi"), F.max_by("_next", "k").alias("_zj")).where("i IS NOT NULL")
    found = found.withColumn("jj", F.least("j", F.col("_cells") - 1))
    keys = list(by)
    found = found.withColumns({"length_m": (F.col("j") - F.col("i")) * GRID_M, "gain_m": F.col("_zj") - F.col("_zi"), "start_m": F.col("i") * GRID_M, "end_m": F.col("jj") * GRID_M})
    found = found.where((F.col("length_m") >= least_m) & (F.col("gain_m") >= least_gain_m))
    found = found.withColumn("climb_no", F.row_number().over(part.orderBy("i")))
    found = found.select(*keys, "climb_no", "start_m", "end_m", "length_m", "gain_m")
    steep = max_grade(df, found, "climb_no", d, e, by, seq)
    return steep.select(*keys, "climb_no", (F.col("start_m") / 1000).alias("start_km"), (F.col("end_m") / 1000).alias("end_km"), "length_m", "gain_m", (F.col("gain_m") / F.col("length_m") * 100).alias("avg_grade_pct"), "max_grade_pct")


def categorised(climbs: DataFrame) -> DataFrame:
    i = climb_index(F.col("length_m") / 1000, "avg_grade_pct")
    return climbs.withColumns({"index": i, "category": climb_category(i), "points": climb_points(i)})


def climb_totals(climbs: DataFrame, by: Keys = ("ride",)) -> DataFrame:
    """by, climbs, points, hardest: of the climbs worth a category (index 2 or more)."""
    c = categorised(climbs).where("index >= 2")
    return c.groupBy(*by).agg(F.count(F.lit(1)).alias("climbs"), F.sum("points").alias("points"), F.max_by("climb_no", F.struct("index", -F.col("climb_no"))).alias("hardest"))


def select_for_detail(climbs: DataFrame, mode: str | list[int] = "auto", cap: int = 8, by: Keys = ("ride",)) -> DataFrame:
    """The climbs that get a detail page, with ``reason``.

    ``auto``: all of category 3 and harder, and of the other significant ones the ``cap`` steepest over 25 m.
    ``climbs`` may hold peak25_pct and has_wall of a verification (null: unverified).
    """
    for c, t in (("peak25_pct", "double"), ("has_wall", "boolean")):
        if c not in climbs.columns:
            climbs = climbs.withColumn(c, F.lit(None).cast(t))
    c = categorised(climbs).withColumn("reason", significance(F.col("index"), F.col("peak25_pct"), F.col("has_wall"), F.col("max_grade_pct")))
    if mode == "none":
        return c.limit(0)
    if mode == "all":
        return c
    if isinstance(mode, (list, tuple)):
        return c.where(F.col("climb_no").isin(list(mode)))
    c = c.where("reason IS NOT NULL").withColumn("_hard", F.col("index") >= SIGNIFICANT_INDEX)
    place = F.row_number().over(Window.partitionBy(*by, "_hard").orderBy(F.desc(F.coalesce("peak25_pct", "max_grade_pct")), "climb_no"))
    return c.withColumn("_place", place).where(F.col("_hard") | (F.col("_place") <= max(0, cap))).drop("_hard", "_place")


def predict_climbs(climbs: DataFrame, rider: Rider = RIDER, **body) -> DataFrame:
    """Speed, minutes and climbing rate at four efforts, survival power and the intent by minutes at FTP.

    One row for each climb; ``powers`` maps ftp, map, z3 and z2 to watts, km/h and minutes.
    """
    g, km = F.col("avg_grade_pct"), F.col("length_m") / 1000
    efforts = {"ftp": rider.ftp_w, "map": rider.map_w, "z3": round(0.80 * rider.ftp_w), "z2": round(0.65 * rider.ftp_w)}
    pairs = []
    for name, watts in efforts.items():
        v = predict_speed(watts, g, **body)
        pairs += [F.lit(name), F.struct(F.lit(watts).alias("w"), F.bround(v, 2).alias("speed_kmh"), F.when(v > 0, F.bround(km / v * 60, 1)).alias("time_min"))]
    at_ftp = km / predict_speed(rider.ftp_w, g, **body) * 60
    f = rider.ftp_w
    intent = (
        F.when(at_ftp < 3, f"AC zone (sub-3min): up to {rider.ac_w}W")
        .when(at_ftp <= 8, f"MAP zone (3-8min): {f}-{rider.map_w}W")
        .when(at_ftp <= 20, f"Threshold to Sweet Spot (8-20min): {round(0.85 * f)}-{f}W")
        .otherwise(f"Sweet Spot (20+ min): {round(0.85 * f)}-{round(0.94 * f)}W")
    )
    survive = F.when(F.col("max_grade_pct") > 5, F.bround(survival_power(F.col("max_grade_pct"), **body), 0))
    return climbs.withColumns({"powers": F.create_map(*pairs), "vam_ftp": F.bround(vam(f, g, **body), 0), "survival_w": survive, "intent": intent})


def verified_pacing(climbs: DataFrame, rider: Rider = RIDER, endurance_w: float = 130.0) -> DataFrame:
    """Eleven figures of pacing from verified length_m, gain_m and peak_pct."""
    avg = 100.0 * F.col("gain_m") / F.col("length_m")
    c = climbs.where("length_m > 0").withColumn("avg_pct", avg)
    a, km = F.col("avg_pct"), F.col("length_m") / 1000.0
    c = c.withColumns({"speed_ftp_kmh": predict_speed(rider.ftp_w, a), "speed_map_kmh": predict_speed(rider.map_w, a), "speed_z3_kmh": predict_speed(endurance_w, a)})
    minutes = lambda v: F.when(F.col(v) > 0, km / F.col(v) * 60.0).otherwise(F.lit(0.0))
    return c.withColumns({"duration_ftp_min": minutes("speed_ftp_kmh"), "duration_map_min": minutes("speed_map_kmh"), "vam_ftp": vam(rider.ftp_w, a), "survival_w": survival_power("peak_pct")})


def route_load(routes: DataFrame, climbs: DataFrame, by: Keys = ("ride",), rider: Rider = RIDER, target_if: float = 0.65, **body) -> DataFrame:
    """by, hours, tss at three intensities and the ranges of hours and tss, from (by, distance_km) and its climbs.

    Level road at 25 km/h, climbs at 75 % of FTP; climbs longer than the route leave no level road.
    """
    minutes = (F.col("length_m") / 1000) / predict_speed(0.75 * rider.ftp_w, "avg_grade_pct", **body) * 60
    per = climbs.groupBy(*by).agg((F.sum("length_m") / 1000).alias("_km"), F.sum(minutes).alias("_min"))
    r = routes.join(per, list(by), "left").fillna(0.0, ["_km", "_min"])
    hours = (F.greatest(F.lit(0.0), F.col("distance_km") - F.col("_km")) / 25 * 60 + F.col("_min")) / 60
    r = r.withColumn("_h", hours)
    lo, hi = F.bround(F.col("_h") * 0.90, 2), F.bround(F.col("_h") * 1.12, 2)
    tss = lambda i: F.bround(F.col("_h") * i * i * 100, 0)
    return r.select(*by, F.bround("_h", 2).alias("hours"), tss(target_if).alias("tss"), tss(0.70).alias("tss_070"), tss(0.75).alias("tss_075"), lo.alias("hours_lo"), hi.alias("hours_hi"), F.bround(lo * 0.65 * 0.65 * 100, 0).alias("tss_lo"), F.bround(hi * 0.75 * 0.75 * 100, 0).alias("tss_hi"))


def gear_choice(speeds: DataFrame, rings: list[int], cogs: list[int], prefer_rpm: float = 70.0, wheel_circ_m: float = RIDER.wheel_circ_m, key: str = "id", speed: str = "speed_kmh") -> DataFrame:
    """key, ring_t, cog_t, rpm: the gear closest to the preferred cadence, among those of 50 to 110 rpm if any."""
    from cadenza.functions.physics import cadence

    gears = speeds.select(key, speed, F.posexplode(F.array(*[F.lit(x) for x in rings])).alias("_r", "ring_t")).select("*", F.posexplode(F.array(*[F.lit(x) for x in cogs])).alias("_c", "cog_t"))
    gears = gears.withColumn("rpm", cadence(speed, "ring_t", "cog_t", wheel_circ_m))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.when(F.col("rpm").between(50, 110), 0).otherwise(1), F.abs(F.col("rpm") - prefer_rpm), "_r", "_c"))
    return gears.withColumn("_b", best).where("_b = 1").select(key, "ring_t", "cog_t", "rpm")


def terrain_load(loads: DataFrame, density: str = "density", hours: str = "hours") -> DataFrame:
    """Adds multiplier, hours_adj, tss_adj_065/070/075 and the ranges if_lo, if_hi, tss_adj_lo, tss_adj_hi.

    Walls slow a rider down as much as they raise the intensity; a null density (nothing verified) adjusts nothing.
    """
    m = F.coalesce(wall_multiplier(F.col(density)), F.lit(1.0))
    out = loads.withColumn("multiplier", m)
    out = out.withColumn("hours_adj", F.when(F.col("multiplier") > 1.001, F.bround(F.col(hours) * F.col("multiplier"), 2)).otherwise(F.col(hours)))
    tss = lambda i: F.bround(F.col("hours_adj") * i * i * 100, 0)
    out = out.withColumns({"tss_adj_065": tss(0.65), "tss_adj_070": tss(0.70), "tss_adj_075": tss(0.75), "if_lo": F.bround(0.65 * F.col("multiplier"), 2), "if_hi": F.bround(0.75 * F.col("multiplier"), 2)})
    return out.withColumns({"tss_adj_lo": tss(F.col("if_lo")), "tss_adj_hi": tss(F.col("if_hi"))})


def worth_restating(new: Column, old: Column, least: float, share: float = 0.05, whole: bool = True) -> Column:
    """Whether a figure moved by ``least`` or by ``share`` of what it was, whichever is more."""
    part = F.floor(share * old) if whole else share * old
    return F.abs(new - old) >= F.greatest(F.lit(least), part)


def stitched_load(profile: DataFrame, density: DataFrame, rider: Rider = RIDER, by: Keys = ("ride",)) -> DataFrame:
    """The load of routes on their stitched profiles (by, seq, d, e), with ``density`` (by, density).

    Profiles of fewer than 50 points or less than a kilometre have no row.
    """
    size = profile.groupBy(*by).agg((F.max("d") / 1000).alias("distance_km"), F.count(F.lit(1)).alias("_n")).where("_n >= 50 AND distance_km >= 1").drop("_n")
    return terrain_load(route_load(size, find_climbs(profile.join(size.select(*by), list(by), "left_semi"), by=by), by, rider).join(density.select(*by, "density"), list(by), "left"))
