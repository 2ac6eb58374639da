"""Figures of whole rides and of their segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.physics import RIDER, Rider
from cadenza.functions.scoring import COGGAN, KARVONEN, summary_zones, verdict
from cadenza.operators.windows import Keys, median_filter, ordered, rolling_peak, smooth

PEAKS = (1, 5, 15, 30, 60, 120, 300, 600, 1200, 1800, 3600)


def to_samples(records: DataFrame, by: Keys = ("ride",)) -> DataFrame:
    """Device records to samples: seconds from the start, first field present, km/h, 0 for silent sensors.

    ``records``: by, seq, ts, distance, enhanced_altitude, altitude, enhanced_speed, speed, power, heart_rate,
    cadence.  Distance and altitude are interpolated over gaps, sensors are not.
    """
    from cadenza.operators.windows import interpolate_gaps

    w = ordered(by)
    num = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    r = records.withColumns({"_alt": F.coalesce("enhanced_altitude", "altitude"), "_spd": F.coalesce("enhanced_speed", "speed"), "t": (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.first("ts").over(w).cast("timestamp"))) / 1e6})
    r = interpolate_gaps(interpolate_gaps(r, "_alt", "e", by), "distance", "d", by)
    return r.select(*by, "seq", "ts", "t", "d", "e", (num("_spd") * 3.6).alias("spd"), num("power").alias("p"), num("heart_rate").alias("hr"), num("cadence").alias("cad"))


def _rolled(df: DataFrame, p: str, by: Keys, seq: str) -> DataFrame:
    w = ordered(by, seq)
    v = F.coalesce(F.nanvl(F.col(p), F.lit(0.0)), F.lit(0.0))
    return df.withColumns({"_p": v}).withColumn("_r", F.when(F.row_number().over(w) >= 30, F.avg("_p").over(w.rowsBetween(-29, 0))))


def _np() -> Column:
    """Normalised power from _p and _r: fourth root of the mean fourth power of 30-sample means; short rides: the mean."""
    return F.coalesce(F.pow(F.avg(F.pow("_r", F.lit(4.0))), F.lit(0.25)), F.avg("_p"), F.lit(0.0))


def normalized_power(df: DataFrame, p: str = "p", by: Keys = ("ride",), seq: str = "seq") -> DataFrame:
    return _rolled(df, p, by, seq).groupBy(*by).agg(_np().alias("np_w"))


def intensity(df: DataFrame, by: Keys = ("ride",)) -> DataFrame:
    """by, np_w, avg_w, avg_hr, vi, ef; ratios are 0 where their denominator is not positive."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    m = _rolled(df, "p", by, "seq").groupBy(*by).agg(_np().alias("np_w"), F.avg("_p").alias("avg_w"), F.avg(F.when(F.col("hr") > 0, F.col("hr"))).alias("avg_hr"))
    return m.fillna(0.0, ["avg_hr"]).withColumns({"vi": ratio("np_w", "avg_w"), "ef": ratio("np_w", "avg_hr")})


def coggan_shares(df: DataFrame, ftp_w: float, by: Keys = ("ride",)) -> DataFrame:
    """by, zone, percent of the samples with power; rides without power and an FTP of 0 have no rows."""
    p = F.col("p")
    live = df.where(p > 0).where(F.lit(ftp_w > 0))
    shares = live.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if((p > lo * ftp_w) & (p <= hi * ftp_w)).alias(z) for z, lo, hi in COGGAN])
    rows = F.explode(F.array(*[F.struct(F.lit(z).alias("zone"), F.bround(100.0 * F.col(z) / F.col("_n"), 1).alias("percent")) for z, _, _ in COGGAN]))
    return shares.select(*by, rows.alias("_z")).select(*by, "_z.zone", "_z.percent")


def power_zone_seconds(df: DataFrame, rider: Rider = RIDER, by: Keys = ("ride",)) -> DataFrame:
    """by, zone, samples while pedalling.  Zones overlap and leave gaps, so a sample counts in 0, 1 or 2 of them."""
    p = F.col("p")
    zones = summary_zones(rider)
    counts = df.where("cad > 0").groupBy(*by).agg(*[F.count_if(p.between(lo, hi)).alias(z) for z, lo, hi in zones])
    rows = F.explode(F.array(*[F.struct(F.lit(z).alias("zone"), F.col(f"`{z}`").alias("samples")) for z, _, _ in zones]))
    return counts.select(*by, rows.alias("_z")).select(*by, "_z.zone", "_z.samples")


def heart_zone_seconds(df: DataFrame, rider: Rider = RIDER, by: Keys = ("ride",)) -> DataFrame:
    """by, zone, samples of the heart rate reserve's zones and below; the top one reaches 10 above the maximum."""
    h, reserve = F.col("hr"), rider.max_hr_bpm - rider.rest_hr_bpm
    cols = []
    for i, (z, lo, hi) in enumerate(KARVONEN):
        a, b = rider.rest_hr_bpm + reserve * lo, rider.rest_hr_bpm + reserve * hi
        ok = (h < b) if i == 0 else ((h >= a) & (h <= rider.max_hr_bpm + 10)) if i == len(KARVONEN) - 1 else ((h >= a) & (h < b))
        cols.append(F.count_if(ok).alias(z))
    counts = df.where("hr > 0").groupBy(*by).agg(*cols)
    rows = F.explode(F.array(*[F.struct(F.lit(z).alias("zone"), F.col(f"`{z}`").alias("samples")) for z, _, _ in KARVONEN]))
    return counts.select(*by, rows.alias("_z")).select(*by, "_z.zone", "_z.samples")


def ascent(df: DataFrame, method: str = "median45", e: str = "e", by: Keys = ("ride",), seq: str = "seq") -> DataFrame:
    """by, ascent_m, descent_m after smoothing: median45 (devices), zero9 (routes), truncated9 (verified), median5 (charts)."""
    soft = {
        "median45": lambda: median_filter(df, e, 45, "_s", by, seq),
        "median5": lambda: median_filter(df, e, 5, "_s", by, seq),
        "zero9": lambda: smooth(df, e, 9, "_s", by, seq),
        "truncated9": lambda: smooth(df, e, 9, "_s", by, seq, mode="truncated"),
    }[method]()
    step = soft.withColumn("_up", F.col("_s") - F.lag("_s").over(ordered(by, seq)))
    return step.groupBy(*by).agg(F.coalesce(F.sum(F.greatest(F.col("_up"), F.lit(0.0))), F.lit(0.0)).alias("ascent_m"), F.coalesce(F.sum(F.greatest(-F.col("_up"), F.lit(0.0))), F.lit(0.0)).alias("descent_m"))


def moving_time(df: DataFrame, by: Keys = ("ride",), window: int = 5, least_kmh: float = 1.0) -> DataFrame:
    """by, moving_s, samples: seconds whose speed over the last five samples exceeds walking into a standstill."""
    w = ordered(by)
    dt, dd = F.col("t") - F.lag("t", window).over(w), F.col("d") - F.lag("d", window).over(w)
    v = df.withColumn("_v", F.when(dt > 0, dd / dt * 3.6).otherwise(F.lit(0.0)))
    return v.groupBy(*by).agg(F.count_if(F.col("_v") > least_kmh).alias("moving_s"), F.count(F.lit(1)).alias("samples"))


def sensor_presence(df: DataFrame, by: Keys = ("ride",)) -> DataFrame:
    return df.groupBy(*by).agg(F.bool_or(F.col("p") > 0).alias("has_power"), F.bool_or(F.col("cad") > 0).alias("has_cadence"), F.bool_or(F.col("hr") > 0).alias("has_hr"), F.count_if(F.col("hr") > 0).alias("hr_samples"), (100.0 * F.count_if(F.col("hr") > 0) / F.count(F.lit(1))).alias("hr_coverage_pct"))


def in_segments(df: DataFrame, segments: DataFrame, by: Keys = ("ride",), key: str = "segment") -> DataFrame:
    """Samples of each segment (start_km, end_km, ends included), in one sorted pass."""
    from cadenza.operators.joins import tagged

    spans = segments.select(*by, key, "start_km", "end_km", (F.col("start_km") * 1000.0).alias("_s"), (F.col("end_km") * 1000.0).alias("_e"))
    return tagged(df, spans, "d", "_s", "_e", by, [key, "start_km", "end_km"])


def segment_stats(df: DataFrame, segments: DataFrame, by: Keys = ("ride",), key: str = "segment") -> DataFrame:
    """Rounded headline figures: a row is a second; power with zeros, heart above 0, cadence above 30, speed above 0."""
    keyed = [*by, key]
    s = _rolled(in_segments(df, segments, by, key), "p", keyed, "seq")
    over = lambda c, x: F.when(F.col(c) > x, F.col(c))
    return s.groupBy(*keyed).agg(
        F.count(F.lit(1)).alias("duration_s"), F.bround(F.count(F.lit(1)) / 60.0, 1).alias("minutes"), F.bround(F.avg("_p"), 0).alias("avg_w"), F.bround(_np(), 0).alias("np_w"), F.bround(F.max("_p"), 0).alias("max_w"),
        F.bround(F.avg(over("hr", 0)), 0).alias("avg_hr"), F.bround(F.max(over("hr", 0)), 0).alias("max_hr"), F.bround(F.avg(over("cad", 30)), 0).alias("avg_cad"), F.bround(F.avg(over("spd", 0)), 1).alias("avg_kmh"), F.bround(F.max(over("spd", 0)), 1).alias("max_kmh"),
        F.when(F.count(F.lit(1)) > 1, F.bround((F.max_by("d", "seq") - F.min_by("d", "seq")) / 1000.0, 2)).alias("km"),
    )


def flat_summary(stats: DataFrame, by: Keys = ("ride",)) -> DataFrame:
    """Unweighted means of segments' figures; missing ones are left out."""
    return stats.groupBy(*by).agg(F.count(F.lit(1)).alias("segments"), *[F.avg(c).alias(c) for c in ("avg_w", "np_w", "avg_hr", "avg_cad", "avg_kmh")], F.sum("duration_s").alias("duration_s"))


def climb_stats(df: DataFrame, climbs: DataFrame, by: Keys = ("ride",), key: str = "segment") -> DataFrame:
    """Unrounded figures of climbs: seconds by the clock; means over values above 0, NP with zeros, 0 without any."""
    keyed = [*by, key]
    s = _rolled(in_segments(df, climbs, by, key), "p", keyed, "seq")
    mean = lambda c: F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0))
    return s.groupBy(*keyed).agg((F.max("t") - F.min("t")).alias("duration_s"), mean("p").alias("avg_w"), _np().alias("np_w"), F.max("p").alias("max_w"), mean("hr").alias("avg_hr"), F.max("hr").alias("max_hr"), mean("cad").alias("avg_cad"), mean("spd").alias("avg_kmh"))


def ftp_estimates(df: DataFrame, by: Keys = ("ride",), windows: tuple[int, int, int] = (300, 1200, 3600)) -> DataFrame:
    """by, three estimates of FTP from the best 5, 20 and 60 minutes and their weighted consensus; null without the window."""
    peaks = rolling_peak(df, "p", windows, by).groupBy(*by).pivot("window", list(windows)).agg(F.first("peak"))
    a, b, c = (F.when(F.col(f"`{w}`") != 0, F.col(f"`{w}`")) for w in windows)
    return peaks.select(*by, F.bround(a * 0.90, 0).alias("from_5min"), F.bround(b * 0.95, 0).alias("from_20min"), F.bround(c, 0).alias("from_60min"), F.bround(0.6 * a * 0.90 + 0.25 * b * 0.95 + 0.15 * c, 0).alias("consensus"))


def elevation_summary(df: DataFrame, e: str = "e", by: Keys = ("ride",)) -> DataFrame:
    return df.groupBy(*by).agg(F.bround(F.min(e), 0).alias("min_m"), F.bround(F.max(e), 0).alias("max_m"), F.bround((F.max("d") - F.min("d")) / 1000, 2).alias("distance_km"))


def attack_summary(attacks: DataFrame, by: Keys = ("ride",)) -> DataFrame:
    return attacks.groupBy(*by).agg(F.count(F.lit(1)).alias("attacks"), F.max("peak_w").alias("peak_w"), F.max("samples").alias("longest_s"))


def interval_laps(laps: DataFrame, ftp_w: float, by: Keys = ("ride",)) -> DataFrame:
    return laps.groupBy(*by).agg(F.count_if(F.col("avg_power") > 0.95 * ftp_w).alias("intervals"))


def route_verdicts(verified: DataFrame, by: Keys = ("ride",)) -> DataFrame:
    """by, worst_pp, missed, unverified, verdict from (by, source declared/missed, delta_pp)."""
    v = verified.groupBy(*by).agg(F.max(F.when(F.col("source") == "declared", F.col("delta_pp"))).alias("worst_pp"), F.count_if(F.col("source") == "missed").alias("missed"), F.count_if((F.col("source") == "declared") & F.col("delta_pp").isNull()).alias("unverified"))
    return v.withColumn("verdict", verdict("worst_pp", F.col("missed") + F.col("unverified")))


def wall_density(verified: DataFrame, routes: DataFrame, by: Keys = ("ride",)) -> DataFrame:
    """by, density (metres at 8 % and more for each km), multiplier; null without verified climbs."""
    from cadenza.functions.scoring import wall_multiplier

    m = verified.groupBy(*by).agg(F.sum("length_above_8").alias("_m"))
    d = routes.join(m, list(by), "left").withColumn("density", F.col("_m") / F.greatest(F.col("distance_km"), F.lit(1.0)))
    return d.select(*by, "density", F.when(F.col("density").isNotNull(), wall_multiplier("density")).alias("multiplier"))


def coverage(points: DataFrame, e: str = "e", by: Keys = ("ride",)) -> DataFrame:
    return points.groupBy(*by).agg((100.0 * F.avg(F.col(e).isNotNull().cast("int"))).alias("coverage_pct"))


def loops(points: DataFrame, by: Keys = ("ride",), seq: str = "seq", close_m: float = 150.0) -> DataFrame:
    """by, gap_m, is_loop: whether a route ends within 150 m of its start; a single point is no loop."""
    from cadenza.functions.geo import haversine_m

    at = F.struct("lat", "lon")
    p = points.groupBy(*by).agg(F.min_by(at, seq).alias("a"), F.max_by(at, seq).alias("b"), F.count(F.lit(1)).alias("n"))
    gap = haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return p.select(*by, gap.alias("gap_m"), ((gap < close_m) & (F.col("n") >= 2)).alias("is_loop"))


def bounding_box(points: DataFrame, by: Keys = ("ride",)) -> DataFrame:
    return points.groupBy(*by).agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))


def fill_dropouts(df: DataFrame, e: str = "e", by: Keys = ("ride",), out: str = "e_fixed") -> DataFrame:
    """Altitudes of 0 and below are gaps, and gaps are interpolated."""
    from cadenza.operators.windows import interpolate_gaps

    return interpolate_gaps(df.withColumn("_raw", F.when(F.col(e) > 0, F.col(e))), "_raw", out, by).drop("_raw")


def summaries(df: DataFrame, by: Sequence[str] = ("ride",)) -> DataFrame:
    """The rides' figures side by side, for reports: a single pass of windows and one of aggregates each."""
    return intensity(df, by).join(moving_time(df, by), list(by)).join(ascent(df, by=by), list(by)).join(sensor_presence(df, by), list(by))
