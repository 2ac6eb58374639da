"""Zones, categories, bands and verdicts as Column expressions.

The numbers in this module are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.physics import RIDER, Rider, Value, col

#: least index, name, points
CATEGORIES = ((80, "HC", 20), (40, "Cat 1", 10), (16, "Cat 2", 5), (6, "Cat 3", 2), (2, "Cat 4", 1), (0, "uncat", 0))
#: percent below which a colour holds
RIDE_COLOURS = ((3, "#9ED99E"), (6, "#F4C430"), (9, "#E8743B"), (12, "#C8302C"), (15, "#7A1F1F"), (99, "#2D0A0A"))
COGGAN = (("Z1", 0.0, 0.55), ("Z2", 0.55, 0.75), ("Z3", 0.75, 0.90), ("Z4", 0.90, 1.05), ("Z5", 1.05, 1.20), ("Z6", 1.20, 1.50), ("Z7", 1.50, float("inf")))
KARVONEN = (("<Z1 Coast", 0.0, 0.50), ("Z1 Recovery", 0.50, 0.60), ("Z2 Aerobic", 0.60, 0.70), ("Z3 Tempo", 0.70, 0.80), ("Z4 Threshold", 0.80, 0.90), ("Z5 VO2max", 0.90, 1.00))
TSB_BANDS = ((5, "fresh / tapering"), (-5, "balanced"), (-10, "mild productive fatigue"), (-20, "productive fatigue (good adaptation)"), (-25, "high fatigue, monitor"))
SIGNIFICANT_INDEX, STEEP_PCT = 6, 8.0
#: front and rear psi at 90 kg and 48/52
TYRES = {"new": (67.5, 69.5), "worn": (64.0, 65.5), "poor": (58.5, 60.0)}
PSI_PER_PERCENT, FRONT_PCT = 0.67, 48


def zone_bounds(rider: Rider = RIDER) -> list[tuple[str, int, int]]:
    """Eight power zones in watts, ends included; they overlap and leave gaps on purpose."""
    f, m, a, n = rider.ftp_w, rider.map_w, rider.ac_w, rider.nm_w
    share = lambda x: round(f * x)
    return [("Z1 Recovery", 0, share(0.55) - 1), ("Z2 Endurance", share(0.55), share(0.70)), ("Z3 Tempo", share(0.71), share(0.90)), ("Z4 Sweet Spot", share(0.85), share(0.95)), ("Z5 Threshold", share(0.92), f), ("Z6 MAP", f + 1, m), ("Z7 AC", m + 1, a), ("Z8 NM", a + 1, n)]


def summary_zones(rider: Rider = RIDER) -> list[tuple[str, int, int]]:
    """Seven zones of the time summary: sweet spot and threshold are one, the last is open."""
    z = zone_bounds(rider)
    return [*z[:3], ("Z4-Z5 SS/Threshold", z[3][1], z[4][2]), *z[5:7], (z[7][0], z[7][1], 9999)]


def zone_table(spark: SparkSession, rider: Rider = RIDER) -> DataFrame:
    return spark.createDataFrame(summary_zones(rider), "zone string, lo int, hi int")


def zone_for_power(power: Value, bounds: list[tuple[str, int, int]] | None = None) -> Column:
    """The hardest zone that holds the power; below all the first, in any gap or above the last."""
    bounds, p = bounds or zone_bounds(), col(power)
    out = F.when(p < bounds[0][1], bounds[0][0])
    for name, lo, hi in reversed(bounds):
        out = out.when(p.between(lo, hi), name)
    return out.otherwise(bounds[-1][0])


def climb_index(length_km: Value, grade_pct: Value) -> Column:
    return col(length_km) * col(grade_pct)


def _by_index(index: Column, at: int):
    out = F.when(index >= CATEGORIES[0][0], CATEGORIES[0][at])
    for row in CATEGORIES[1:]:
        out = out.when(index >= row[0], row[at])
    return out


def climb_category(index: Column) -> Column:
    return _by_index(index, 1).otherwise("uncat")


def climb_points(index: Column) -> Column:
    return _by_index(index, 2).otherwise(0)


def grade_colour(grade_pct: Value, bands=RIDE_COLOURS) -> Column:
    g = F.abs(col(grade_pct))
    out = F.when(g < bands[0][0], bands[0][1])
    for top, colour in bands[1:]:
        out = out.when(g < top, colour)
    return out.otherwise(bands[-1][1])


def tsb_state(tsb: Value) -> Column:
    t = col(tsb)
    out = F.when(t > 15, "detraining risk (long periods)")
    for least, text in TSB_BANDS:
        out = out.when(t >= least, text)
    return out.otherwise("OVERREACHING — high illness/injury risk")


def week_band(total_tss: Value) -> Column:
    t = col(total_tss)
    return F.when(t > 280, "above").when(t < 200, "below").otherwise("in band")


def verdict(worst_delta: Value, missed: Value) -> Column:
    w = F.coalesce(col(worst_delta), F.lit(0.0))
    return F.when(col(missed) > 0, "high").when(w > 2, "high").when(w > 1, "minor").otherwise("safe")


def wall_multiplier(density: Value) -> Column:
    return F.least(F.lit(1.30), 1.0 + 0.017 * F.greatest(F.lit(0.0), col(density)))


def tyre_pressure(front: Value, rear: Value, front_pct: Value = FRONT_PCT, kg: Value = RIDER.system_weight_kg, base_kg: float = 90.0) -> tuple[Column, Column]:
    """Front and rear psi from the base at 48/52, moved by the split and scaled by the weight."""
    share, ratio = col(front_pct), col(kg) / base_kg
    shift = FRONT_PCT - share
    f = (col(front) - shift * PSI_PER_PERCENT) * (1 + (ratio - 1) * (share / 48.0))
    r = (col(rear) + shift * PSI_PER_PERCENT) * (1 + (ratio - 1) * ((100 - share) / 52.0))
    return F.bround(f, 0), F.bround(r, 0)


def front_share(raw: Column) -> Column:
    """'40/60' -> 40.0; a bare number -> itself; anything else null."""
    pair = F.regexp_extract(raw, r"^\s*(\d+(?:\.\d+)?)\s*/\s*\d+(?:\.\d+)?\s*$", 1)
    return F.coalesce(F.when(pair != "", pair.try_cast("double")), F.trim(raw).try_cast("double"))


def significance(index: Column, peak25: Column, has_wall: Column, gpx_max: Column) -> Column:
    """Why a climb deserves detail, null if it does not; null ``peak25`` and ``has_wall`` mean unverified."""
    steep = lambda label, x: F.format_string(f"steep pitch ({label} %.1f%%)", x)
    verified = has_wall.isNotNull()
    return (
        F.when(index >= SIGNIFICANT_INDEX, F.format_string("Cat 3+ (index %.1f)", index))
        .when(verified & has_wall, "wall >=10% sustained >=30m")
        .when(verified & (peak25 >= STEEP_PCT), steep("peak-25m", peak25))
        .when(~verified & (gpx_max >= STEEP_PCT), steep("GPX max", gpx_max))
    )
