"""Reports of routes and rides as markdown documents, one row each, put together by executors.

A route's climbs are lines of tables; lines are gathered for each route, never over routes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.climbs import verified_pacing
from cadenza.operators.windows import Keys

# fixed values: what the report says of a verdict, its headings and marks
VERDICTS = {"safe": "Safe to plan — gradients within ±1pp.", "minor": "Minor risk — peak gradient understated by up to 2pp.", "high": "HIGH RISK — peak gradients underestimated and/or climbs missing."}
BEGIN, END, NONE = "<!-- BEGIN FIDELITY -->", "<!-- END FIDELITY -->", "—"


def _lines(df: DataFrame, by: Keys, order: list[str], line: Column, name: str) -> DataFrame:
    """by, and the lines of each key in order, one under the other."""
    rows = df.select(*by, F.struct(*order, line.alias("_line")).alias("_r")).where("_r._line IS NOT NULL")
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["_line"]), "\n").alias(name))


def _table(title: str, head: str, body: str, before: str = "") -> Column:
    columns = head.count("|") - 1
    rule = "|" + "---|" * columns
    return F.when(F.col(body).isNotNull(), F.concat(F.lit(f"\n### {title}\n\n{before}{head}\n{rule}\n"), F.col(body), F.lit("\n"))).otherwise(F.lit(""))


def _signed(c: str) -> Column:
    return F.concat(F.when(F.col(c) >= 0, "+").otherwise(""), F.format_string("%.1fpp", c))


def _percent(c: Column) -> Column:
    return F.coalesce(F.format_string("%.1f%%", c), F.lit(NONE))


def fidelity_documents(frames: dict[str, DataFrame], by: Keys = ("ride",)) -> DataFrame:
    """by, report: the Fidelity Report of each route of ``plans.fidelity.fidelity``.

    Verdict, backend and coverage; climbs before and after; their gradient profile; walls; pacing on verified grades; climbs
    that only the raster shows, with their walls.  Climbs without raster are ``(unverified)``; tables without rows are left out.
    """
    keys = list(by)
    seen, missed, routes = (frames[k] for k in ("climbs", "missed", "routes"))
    known = F.col("verified_peak_pct").isNotNull()
    km = F.format_string("%.2f", "start_km")
    if_known = lambda yes, no: F.when(known, yes).otherwise(no)
    compared = if_known(
        F.concat(F.format_string("| %d | %s | %.1f%% | **%.1f%%** | ", "climb_no", km, "max_grade_pct", "verified_peak_pct"), _signed("delta_pp"), F.format_string(" | %.0fm | %.0fm | %.0fm |", "length_above_12", "length_above_10", "length_above_8")),
        F.format_string(f"| %d | %s | %.1f%% | (unverified) | {NONE} | {NONE} | {NONE} | {NONE} |", "climb_no", km, "max_grade_pct"),
    )
    profile = F.when(known, F.concat(F.format_string("| %d | %s | ", "climb_no", km), F.concat_ws(" | ", *[_percent(F.col("mean_max")[f"peak_{m}m"]) for m in (25, 100, 500, 1000)]), F.lit(" |")))
    walled = seen.select(*keys, "climb_no", "start_km", F.posexplode("walls").alias("_n", "_w"))
    wall = F.format_string("| %.2f | +%.0f m | %.0f m | **%.1f%%** | %.0f%% in |", "start_km", "_w.offset_m", "_w.length_m", "_w.peak_pct", "_w.pct_in")
    paced = verified_pacing(seen.where(known).select(*keys, "climb_no", "start_km", F.col("verified_m").alias("length_m"), F.col("verified_gain_m").alias("gain_m"), F.col("verified_peak_pct").alias("peak_pct")))
    pace = F.format_string("| %d | %s | %.0f | %.0f | %.1f%% | **%.1f%%** | %.1f | %.1f | %.1f | %.1f | %.0f | %.0f |", "climb_no", km, "length_m", "gain_m", "avg_pct", "peak_pct", "speed_ftp_kmh", "speed_map_kmh", "speed_z3_kmh", "duration_ftp_min", "vam_ftp", "survival_w")
    found = if_known(F.concat(F.format_string("| %s | %.1f%% | **%.1f%%** | ", km, "max_grade_pct", "verified_peak_pct"), _signed("delta_pp"), F.lit(" |")), F.format_string(f"| %s | %.1f%% | (unverified) | {NONE} |", km, "max_grade_pct"))
    more_walls = missed.select(*keys, "climb_no", "start_km", F.posexplode("walls").alias("_n", "_w"))
    parts = [
        _lines(seen, keys, ["climb_no"], compared, "_compared"), _lines(seen, keys, ["climb_no"], profile, "_profile"),
        _lines(walled, keys, ["climb_no", "_n"], F.concat(F.format_string("| %d ", "climb_no"), wall), "_walls"), _lines(paced, keys, ["climb_no"], pace, "_pace"),
        _lines(missed, keys, ["climb_no"], found, "_missed"), _lines(more_walls, keys, ["climb_no", "_n"], wall, "_more"),
    ]
    doc = routes
    for p in parts:
        doc = doc.join(p, keys, "left")
    verdict = F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv])[F.col("verdict")]
    asked = F.when(F.col("fallback_used"), "*(Some climbs were sampled by an elevation service.)*  \n").otherwise("")
    head = F.concat(F.lit(f"{BEGIN}\n## Fidelity Report\n\n**Verdict:** "), verdict, F.lit("\n**Backend:** "), "backend", F.format_string("  \n**Coverage:** %.0f%%  \n", "coverage_pct"), asked)
    walls = "| km | Offset | Length | Peak | Position |"
    body = [
        F.concat(F.lit("\n### Per-climb comparison\n\n| # | km | GPX peak | Hi-fi peak | Δ | >12% | >10% | >8% |\n|---|---|---|---|---|---|---|---|\n"), F.coalesce(F.concat("_compared", F.lit("\n")), F.lit(""))),
        _table("Gradient profile (steepest sustained over window)", "| # | km | peak-25m | peak-100m | peak-500m | peak-1km |", "_profile"),
        _table("Walls (≥10% sustained ≥30m)", f"| # {walls}", "_walls"),
        _table("Hi-fi pacing (physics on hi-fidelity gradients)", "| # | km | Len (m) | Gain (m) | Avg | Peak | V@FTP (km/h) | V@MAP (km/h) | V@Z3 (km/h) | t@FTP (min) | VAM (m/h) | Survive (W) |", "_pace"),
        _table("Missed climbs (in DEM, not in GPX)", "| km | Coarse peak | Hi-fi peak | Δ |", "_missed", "Climbs that the route's own elevations flattened, sampled like declared ones.\n\n"),
        F.when(F.col("_more").isNotNull(), F.concat(F.lit(f"\n**Walls inside missed climbs:**\n\n{walls}\n|---|---|---|---|---|\n"), "_more", F.lit("\n"))).otherwise(F.lit("")),
    ]
    return doc.select(*keys, F.concat(head, *body, F.lit(f"\n{END}\n")).alias("report"))


#: Fixed value: index of the climb that others are compared with (1.45 km at 9 %).
REFERENCE_INDEX = 13.05


def climb_documents(climbs: DataFrame, stats: DataFrame, by: Keys = ("ride",)) -> DataFrame:
    """by, report: categories and points, figures of each climb, the hardest against a high Cat 3 climb.

    ``climbs``: of ``operators.climbs.categorised``; ``stats``: of ``operators.metrics.climb_stats`` by climb_no.
    """
    keys = list(by)
    where = F.format_string("| %d | km %.2f | %.0f m | %.0f m | %.1f%% | %.1f%% | %.2f | **%s** | %d |", "climb_no", "start_km", "length_m", "gain_m", "avg_grade_pct", "max_grade_pct", "index", "category", "points")
    clock = F.format_string("%d:%02d", F.floor(F.col("duration_s") / 60), F.floor(F.col("duration_s") % 60))
    rode = F.concat(F.format_string("| %d | ", "climb_no"), clock, F.format_string(" | %.0f | %.0f | %.0f | %.0f | %.1f |", "avg_w", "np_w", "max_hr", "avg_cad", "avg_kmh"))
    day = climbs.groupBy(*keys).agg(F.sum("points").alias("_points"), F.count(F.lit(1)).alias("_n"), F.max_by(F.struct("climb_no", "index"), F.struct("index", -F.col("climb_no"))).alias("_top"))
    doc = day.join(_lines(climbs, keys, ["climb_no"], where, "_where"), keys).join(_lines(stats, keys, ["climb_no"], rode, "_rode"), keys, "left")
    total = F.concat(F.format_string("\n**Day total: %d KOM points** (across %d climb", "_points", "_n"), F.when(F.col("_n") != 1, "s").otherwise(""), F.lit(")\n"))
    top = F.format_string(f"\n## Reference: high Cat 3 benchmark\n\nA climb of 1.45 km at 9 %% has index **{REFERENCE_INDEX:.2f}**.  The hardest climb here (#%d) has index **%.2f**: **%.0f%%** of it.\n", "_top.climb_no", "_top.index", F.col("_top.index") / REFERENCE_INDEX * 100)
    head = "## Categories & KOM points\n\n| # | Where | Length | Gain | Avg % | Max % | Index | Category | Points |\n|---|---|---|---|---|---|---|---|---|\n"
    rode_head = "\n## Per-climb performance\n\n| # | Time | Avg W | NP W | Max HR | Avg cad | Avg km/h |\n|---|---|---|---|---|---|---|\n"
    return doc.select(*keys, F.concat(F.lit(head), "_where", F.lit("\n"), total, F.lit(rode_head), F.coalesce(F.concat("_rode", F.lit("\n")), F.lit("")), top).alias("report"))


def ride_documents(summaries: DataFrame, by: Keys = ("ride",)) -> DataFrame:
    """by, report: a ride's headline figures; rows of sensors that the ride did not carry are left out.

    ``summaries``: distance_km, moving_s, elapsed_s, ascent_m, has_power, has_cadence, has_hr, avg_w, np_w, max_w, avg_hr,
    max_hr, hr_coverage_pct, avg_cad.  Null figures are left out too.
    """
    clock = lambda c: F.format_string("%d:%02d:%02d", F.floor(F.col(c) / 3600), F.floor(F.col(c) % 3600 / 60), F.floor(F.col(c) % 60))
    row = lambda label, text: F.when(text.isNotNull(), F.concat(F.lit(f"| {label} | "), text, F.lit(" |")))
    of = lambda form, c: F.when(F.col(c).isNotNull(), F.format_string(form, c))
    rows = [
        row("Distance", of("%.2f km", "distance_km")), row("Moving time", F.when(F.col("moving_s").isNotNull(), clock("moving_s"))), row("Elapsed time", F.when(F.col("elapsed_s").isNotNull(), clock("elapsed_s"))), row("Ascent", of("%.0f m", "ascent_m")),
        *[F.when(F.col("has_power"), row(label, of("%.0f W", c))) for label, c in (("Average power", "avg_w"), ("Normalised power", "np_w"), ("Maximum power", "max_w"))],
        *[F.when(F.col("has_hr"), row(label, of(form, c))) for label, form, c in (("Average heart rate", "%.0f bpm", "avg_hr"), ("Maximum heart rate", "%.0f bpm", "max_hr"), ("Heart rate recorded", "%.0f%% of the ride", "hr_coverage_pct"))],
        F.when(F.col("has_cadence"), row("Average cadence", of("%.0f rpm", "avg_cad"))),
    ]
    return summaries.select(*by, F.concat(F.lit("## Ride\n\n| | |\n|---|---|\n"), F.array_join(F.array_compact(F.array(*rows)), "\n"), F.lit("\n")).alias("report"))
