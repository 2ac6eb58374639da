"""Verification of whole routes: climbs against rasters and services, the baseline, the stitched profile and the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import climbs, joins, metrics, verify
from cadenza.operators.windows import Keys
from cadenza.sinks.reports import BASELINE_COVERAGE
from cadenza.sources.external import Services
from cadenza.sources.store import staged

#: Metres of road between samples of the sweep over a whole route.
SWEEP_M = 25.0


def baselines(points: DataFrame, swept: DataFrame, by: Keys = ("ride",), least_pct: float = BASELINE_COVERAGE) -> tuple[DataFrame, DataFrame]:
    """(choices, profiles): by, coverage_pct, baseline (``raster`` or ``route``), and by, d, e of the profile that was chosen.

    A route whose samples (``swept``: z of the raster alone, e with gaps filled) the raster covers to ``least_pct`` rests on them;
    others, and routes with fewer than two elevations, rest on their own points (cum_m, e).  The choice is an aggregate of the
    same samples that it chooses from.
    """
    keys = list(by)
    held = swept.groupBy(*keys).agg((100.0 * F.avg(F.col("z").isNotNull().cast("int"))).alias("coverage_pct"), F.count_if(F.col("z").isNotNull() | F.col("asked")).alias("_n"))
    rides = points.select(*keys).distinct().join(held, keys, "left").withColumn("coverage_pct", F.coalesce("coverage_pct", F.lit(0.0)))
    choices = rides.withColumn("baseline", F.when((F.col("coverage_pct") >= least_pct) & (F.col("_n") >= 2), "raster").otherwise("route")).drop("_n")
    both = swept.select(*keys, F.col("cum_m").alias("d"), "e", F.lit("raster").alias("baseline")).unionByName(points.select(*keys, F.col("cum_m").alias("d"), "e", F.lit("route").alias("baseline")))
    return choices, both.join(choices.select(*keys, "baseline"), [*keys, "baseline"]).select(*keys, "d", "e")


def fidelity(points: DataFrame, tiles: DataFrame, by: Keys = ("ride",), services: Services | None = None, declared: DataFrame | None = None, blend_m: float = 75.0) -> dict[str, DataFrame]:
    """Frames of verified routes (points: by, seq, lat, lon, cum_m, e): climbs, missed, routes, profile.

    ``climbs``: declared climbs (by default those of the route's own elevations) with what the raster says; ``missed``: climbs
    that only the raster shows; ``routes``: coverage of the raster before any service, baseline, backend, worst_pp, counts and
    verdict, where a climb without raster counts as missed; ``profile``: by, seq, d, e, the baseline with the verified climbs
    stitched in.  What several frames rest on is written to the shared folder once, so services are asked once.
    """
    keys = list(by)
    climbs_ = climbs.find_climbs(points.withColumn("d", F.col("cum_m")), by=by) if declared is None else declared
    climbs_ = staged(climbs_, "climbs")
    fine = staged(verify.fine_profiles(points, climbs_, tiles, by, services=services), "fine")
    seen = staged(verify.verify_climbs(points, climbs_, tiles, by, profiles=fine), "verified")
    swept = verify.sampled_route(points, tiles, SWEEP_M, by, services)
    swept = staged(swept if services else swept.withColumn("asked", F.lit(False)), "swept")
    missed = staged(verify.missed_climbs(points, climbs_, tiles, by, services, swept), "missed")
    choices, base = baselines(points, swept, by)
    both = joins.all_of([seen.select(*keys, "delta_pp"), missed.select(*keys, "delta_pp")], ["declared", "missed"])
    verdicts = metrics.route_verdicts(both, by)
    asked = seen.groupBy(*keys).agg(F.bool_or("fallback_used").alias("fallback_used"))
    routes = choices.join(verdicts, keys, "left").join(asked, keys, "left").fillna(0, ["missed", "unverified"]).withColumns({"verdict": F.coalesce("verdict", F.lit("safe")), "fallback_used": F.coalesce("fallback_used", F.lit(False))})
    backend = F.concat(F.lit("local-dem"), F.when(F.col("baseline") == "raster", " (full-route baseline)").otherwise(""), F.when(F.col("fallback_used"), " + fallback").otherwise(""))
    segments = seen.where("verified_peak_pct IS NOT NULL").select(*keys, F.col("climb_no").alias("segment"), (F.col("start_km") * 1000).alias("start_m"), (F.col("end_km") * 1000).alias("end_m"))
    verified = fine.withColumnRenamed("climb_no", "segment").join(segments.select(*keys, "segment", "start_m"), [*keys, "segment"]).select(*keys, "segment", (F.col("start_m") + F.col("cum_m")).alias("d"), "e")
    stitched = verify.stitch(base, verified, segments, by, blend_m)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("d", "w", "e")) - 1
    return {"climbs": seen, "missed": missed, "routes": routes.withColumn("backend", backend), "profile": stitched.withColumn("seq", number.cast("long")).select(*keys, "seq", "d", "e")}


def restated_loads(profile: DataFrame, seen: DataFrame, missed: DataFrame, by: Keys = ("ride",)) -> DataFrame:
    """The load of routes on their stitched profiles, with the wall density of their verified and missed climbs."""
    lengths = profile.groupBy(*by).agg((F.max("d") / 1000).alias("distance_km"))
    every = seen.select(*by, "length_above_8").unionByName(missed.select(*by, "length_above_8"))
    return climbs.stitched_load(profile, metrics.wall_density(every, lengths, by), by=by)
