"""Whole reports: from files to the frames and texts that a person reads."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import scoring
from cadenza.functions.geo import degrees_of
from cadenza.functions.physics import RIDER, Rider
from cadenza.operators import climbs, joins, load, metrics, runs, verify, waypoints, windows
from cadenza.plans import fidelity
from cadenza.sinks.fidelity import climb_documents, fidelity_documents
from cadenza.sinks.reports import embed_prediction, gpx_documents, markdown_table
from cadenza.sources import binary, files
from cadenza.sources.external import Services
from cadenza.sources.store import staged


def ride_frames(spark: SparkSession, path: str, rider: Rider = RIDER) -> dict[str, DataFrame]:
    """Frames of FIT activities, one row or more for each ride: stored figures, derived ones, peaks, zones, climbs."""
    samples = staged(metrics.to_samples(binary.read_fit(spark, path)), "samples")  # records are decoded once for all frames
    return {
        "session": binary.read_fit(spark, path, "session").drop("seq"),
        "derived": metrics.summaries(samples),
        "peaks": windows.rolling_peak(samples, "p", metrics.PEAKS, missing="omit"),
        "power_zones": metrics.power_zone_seconds(samples, rider),
        "heart_zones": metrics.heart_zone_seconds(samples, rider),
        "climbs": climbs.categorised(climbs.find_climbs(samples)),
        "intervals": metrics.interval_laps(binary.read_fit(spark, path, "lap"), rider.ftp_w),
    }


def pair_frames(spark: SparkSession, a: str, b: str) -> dict[str, DataFrame]:
    """One ride by two devices: what each stored, and whose figures the ride's report takes."""

    def summary(path: str) -> DataFrame:
        s = binary.read_fit(spark, path, "session").orderBy("seq").limit(1)  # the first session of one file
        pause = F.coalesce(F.col("total_elapsed_time") - F.col("total_timer_time"), F.lit(0.0))
        return s.select(
            F.lit(1).alias("pair"), F.coalesce(F.col("sport").cast("string"), F.lit("")).alias("sport"), "start_time", (F.col("total_distance") / 1000).alias("distance_km"),
            F.coalesce("total_ascent", F.lit(0)).cast("double").alias("ascent_m"), F.col("total_ascent").isNotNull().alias("ascent_stored"), pause.alias("auto_pause_s"),
            (F.coalesce("avg_heart_rate", F.lit(0)) > 0).alias("has_hr"), (F.coalesce("avg_power", F.lit(0)) > 0).alias("has_power"), F.col("avg_heart_rate").cast("double").alias("avg_hr"), F.col("avg_power").cast("double").alias("avg_w"),
        )

    one, two = summary(a), summary(b)
    return {"devices": joins.all_of([one, two], ["A", "B"], "device").drop("pair"), "ride": joins.merge_devices(one, two).drop("pair")}


def route_frames(
    spark: SparkSession, path: str, dem: str | None = None, rider: Rider = RIDER, include: tuple[int, ...] = (), exclude: tuple[int, ...] = (), body: dict[str, float] | None = None, services: Services | None = None
) -> dict[str, DataFrame]:
    """Frames of GPX routes; with a folder of rasters also verified and missed climbs, verdict, wall density and the load restated from the stitched profile.

    ``include`` and ``exclude``: numbers of waypoints to keep or drop whatever their kind.  ``body``: mass, cda, crr and eta of
    the bike, as ``sources.profiles.body_of`` gives them; ``services``: what verification may ask.
    """
    body = body or {}
    pts = files.read_gpx(spark, path).withColumnsRenamed({"route": "ride", "cum_m": "d"})
    found = climbs.find_climbs(pts)
    lengths = pts.groupBy("ride").agg((F.max("d") / 1000).alias("distance_km"))
    out = {
        "summary": metrics.elevation_summary(pts).join(metrics.ascent(pts, "zero9"), "ride").join(metrics.loops(pts), "ride"),
        "climbs": climbs.predict_climbs(found, rider, **body),
        "load": climbs.route_load(lengths, found, rider=rider, **body),
        "waypoints": waypoints.override(waypoints.enumerate_waypoints(files.read_waypoints(spark, path).withColumnRenamed("route", "ride"), pts.withColumn("cum_m", F.col("d"))), include, exclude),
    }
    if dem:
        frames = fidelity.fidelity(pts.withColumn("cum_m", F.col("d")), binary.read_geotiff(spark, dem), services=services, declared=found)
        both = joins.all_of([frames["climbs"].select(*_VERIFIED), frames["missed"].select(*_VERIFIED)], ["declared", "missed"])
        out |= {
            "verified": both, "verdict": frames["routes"], "walls": metrics.wall_density(both, lengths), "coverage": frames["routes"].select("ride", "coverage_pct"), "ascent": metrics.ascent(frames["profile"], "truncated9"),
            "restated": fidelity.restated_loads(frames["profile"], frames["climbs"], frames["missed"]), "report": fidelity_documents(frames),
        }
    return out


_VERIFIED = ("ride", "climb_no", "start_km", "end_km", "max_grade_pct", "verified_peak_pct", "delta_pp", "length_above_8", "length_above_10", "length_above_12", "length_above_14")


def embedded_predictions(predictions: DataFrame, frames: dict[str, DataFrame]) -> DataFrame:
    """ride, text: routes' predictions (ride, text) with their Fidelity Report, and headline figures restated from the stitched profile.

    ``frames``: of ``route_frames`` with rasters.  Predictions of routes that were not verified stay as they are.
    """
    rows = predictions.select("ride", "text").join(frames["report"], "ride", "left").join(frames["verdict"].select("ride", "coverage_pct"), "ride", "left").join(frames["ascent"].select("ride", "ascent_m"), "ride", "left")
    rows = rows.join(frames["restated"].select("ride", F.to_json(F.struct("*")).alias("load")), "ride", "left")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [
                text if report is None else embed_prediction(text, report, None if load is None else {"density": None} | json.loads(load), None if pd.isna(ascent) else ascent, None if pd.isna(cover) else cover)
                for text, report, cover, ascent, load in zip(b["text"], b["report"], b["coverage_pct"], b["ascent_m"], b["load"])
            ]
            yield pd.DataFrame({"ride": b["ride"], "text": texts})

    return rows.mapInPandas(put, "ride string, text string")


def climb_reports(spark: SparkSession, path: str) -> DataFrame:
    """ride, report: categories, points and figures of the climbs of FIT activities."""
    samples = metrics.to_samples(binary.read_fit(spark, path))
    found = climbs.categorised(climbs.find_climbs(samples))
    return climb_documents(found, metrics.climb_stats(samples, found, key="climb_no"))


def validated(spark: SparkSession, fit: str, gpx: str, dem: str) -> DataFrame:
    """Climbs that a ride recorded against those that rasters verify of its route: matched, gaps and extras."""
    rode = climbs.find_climbs(metrics.to_samples(binary.read_fit(spark, fit))).withColumn("ride", F.lit("ride"))
    pts = files.read_gpx(spark, gpx).withColumnRenamed("route", "ride").withColumn("ride", F.lit("ride"))
    seen = verify.verify_climbs(pts, climbs.find_climbs(pts.withColumn("d", F.col("cum_m"))), binary.read_geotiff(spark, dem))
    return joins.cross_validate(rode, seen.where("verified_peak_pct IS NOT NULL").withColumn("peak_pct", F.col("verified_peak_pct")))


def ride_tracks(spark: SparkSession, path: str) -> DataFrame:
    """ride, gpx: FIT activities as GPX documents."""
    rec = binary.read_fit(spark, path)
    at = {"lat": degrees_of(F.col("position_lat")), "lon": degrees_of(F.col("position_long")), "e": F.coalesce("enhanced_altitude", "altitude").cast("double")}
    return gpx_documents(rec.select("ride", "seq", *[c.alias(k) for k, c in at.items()]))


def compare_frames(spark: SparkSession, a: str, b: str, ftp_a: float = RIDER.ftp_w, ftp_b: float = RIDER.ftp_w) -> dict[str, DataFrame]:
    """Two riders' FIT files side by side: peaks, FTP estimates, climbs of the first, attacks, shared stretches."""
    rec = [binary.read_fit(spark, p).withColumn("ride", F.lit(n)) for p, n in ((a, "a"), (b, "b"))]
    both = metrics.to_samples(rec[0]).unionByName(metrics.to_samples(rec[1]))
    spans = climbs.find_climbs(both.where("ride = 'a'")).select(F.col("climb_no").alias("segment"), "start_km", "end_km")
    seg = both.select("ride").distinct().join(spans, F.lit(True))  # two rides
    shared = joins.align_rides(rec[0].withColumn("pair", F.lit(1)).drop("ride"), rec[1].withColumn("pair", F.lit(1)).drop("ride"), ["pair"])
    peaks = windows.rolling_peak(both, "p", (5, 60, 300, 1200, 3600)).groupBy("window").pivot("ride", ["a", "b"]).agg(F.first("peak")).orderBy("window")
    attacks = runs.flat_attacks(both.where("ride = 'a'"), ftp_a).unionByName(runs.flat_attacks(both.where("ride = 'b'"), ftp_b))
    return {"peaks": peaks, "ftp": metrics.ftp_estimates(both), "climbs": metrics.segment_stats(both, seg), "attacks": metrics.attack_summary(attacks), "chase": joins.chase_episodes(joins.proximity_events(shared))}


def load_frame(spark: SparkSession, ctl: float, atl: float, plan: list[float]) -> DataFrame:
    rows = [("plan", i, float(t), float(ctl), float(atl)) for i, t in enumerate(plan)]
    return load.project(spark.createDataFrame(rows, "athlete string, day int, tss double, ctl_start double, atl_start double")).orderBy("day")


def tyre_frame(spark: SparkSession, kg: float = RIDER.system_weight_kg, front_pct: float = scoring.FRONT_PCT) -> DataFrame:
    t = spark.createDataFrame([(k, float(f), float(r)) for k, (f, r) in scoring.TYRES.items()], "surface string, f double, r double")
    front, rear = scoring.tyre_pressure("f", "r", front_pct, kg)
    return t.select("surface", front.alias("front_psi"), rear.alias("rear_psi"))


def as_markdown(frames: dict[str, DataFrame]) -> str:
    return "\n".join(markdown_table(df, name) for name, df in frames.items())
