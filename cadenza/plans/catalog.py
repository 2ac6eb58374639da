"""Every registered query of the ride engine, each beside the SQL that checks it.

Doubles are rounded to four digits on both sides, as engines add in different orders.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cadenza.functions import geo, physics, projection, scoring, text
from cadenza.operators import climbs, joins, load, metrics, runs, verify, waypoints, windows
from cadenza.plans import fidelity
from cadenza.sinks import reports, shapes
from cadenza.sources import bikes, external, files, store
from cadenza.sources import tiles as sources_tiles
from cadenza.sources.samples import LONG_SQL, SHORT_SQL, long_rides, read, short_rides

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema.fields])


def _register(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None, digits: int = 4) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(build(spark, sf_dir), digits)
    if sql:
        ORACLE_SQL[name] = sql


def _short(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None, digits: int = 4, with_: str = "WITH") -> None:
    _register(name, lambda s, d: build(short_rides(s, d)), sql and f"{with_} {SHORT_SQL}{sql}", digits)


def _long(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    _register(name, lambda s, d: build(long_rides(s, d)), sql and f"WITH {LONG_SQL}{sql}")


def _peaks_sql(value: str, wins: list[int]) -> str:
    return f""", w AS (SELECT unnest({wins}) AS win), cs AS (SELECT ride, seq, sum({value}) OVER (PARTITION BY ride ORDER BY seq) AS s FROM rec),
    pk AS (SELECT a.ride, win, max((a.s - coalesce(b.s, 0)) / win) AS peak FROM cs a JOIN w ON a.seq >= win - 1 LEFT JOIN cs b ON a.ride = b.ride AND b.seq = a.seq - win GROUP BY 1, 2)
    SELECT r.ride, w.win, round(peak, 4) AS peak FROM (SELECT DISTINCT ride FROM rec) r CROSS JOIN w LEFT JOIN pk ON pk.ride = r.ride AND pk.win = w.win"""


def _win(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("window", "win")


_short("peak_curve", lambda r: _win(windows.rolling_peak(r, "p", [1, 5, 15, 30, 60, 120])), _peaks_sql("p", [1, 5, 15, 30, 60, 120]))
_long("peak_curve_long", lambda r: _win(windows.rolling_peak(r, "p", [1, 30, 300, 600])), _peaks_sql("p", [1, 30, 300, 600]))
_short("speed_curve", lambda r: _win(windows.rolling_peak(r, "spd", [5, 30], missing="omit")), _peaks_sql("spd", [5, 30]) + " WHERE peak IS NOT NULL")

_ROLL = """, r30 AS (SELECT *, CASE WHEN seq >= 29 THEN avg(p) OVER (PARTITION BY ride ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END AS m FROM rec),
np AS (SELECT ride, coalesce(pow(avg(pow(m, 4)), 0.25), avg(p), 0) AS np_w, avg(p) AS avg_w, coalesce(avg(hr) FILTER (hr > 0), 0) AS avg_hr FROM r30 GROUP BY ride)"""
_short("normalized_power", metrics.normalized_power, _ROLL + " SELECT ride, round(np_w, 4) AS np_w FROM np")
_short("intensity", metrics.intensity, _ROLL + " SELECT ride, round(np_w, 4) AS np_w, round(avg_w, 4) AS avg_w, round(avg_hr, 4) AS avg_hr, round(CASE WHEN avg_w > 0 THEN np_w / avg_w ELSE 0 END, 4) AS vi, round(CASE WHEN avg_hr > 0 THEN np_w / avg_hr ELSE 0 END, 4) AS ef FROM np")

_N = ", n AS (SELECT ride, count(*) AS n FROM rec GROUP BY ride)"
_pick = lambda *c: lambda df: df.select("ride", "seq", *c)
_long("median_filter", lambda r: _pick("m")(windows.median_filter(r, "e", 5, "m")), _N + " SELECT ride, seq, round(CASE WHEN n < 5 THEN e ELSE quantile_cont(e, 0.5) OVER (PARTITION BY ride ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 4) AS m FROM rec JOIN n USING (ride)")
_long("smooth_zero_pad", lambda r: _pick("s9", "s4")(windows.smooth(windows.smooth(r, "e", 9, "s9"), "e", 4, "s4")), " SELECT ride, seq, round(sum(e) OVER (PARTITION BY ride ORDER BY seq ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9, 4) AS s9, round(sum(e) OVER (PARTITION BY ride ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4, 4) AS s4 FROM rec")
_long("truncated_mean", lambda r: _pick("m")(windows.smooth(r, "e", 9, "m", mode="truncated")), " SELECT ride, seq, round(avg(e) OVER (PARTITION BY ride ORDER BY seq ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 4) AS m FROM rec")
_long("edge_padded_mean", lambda r: _pick("m")(windows.smooth(r, "e", 11, "m", mode="edge")), """, f AS (SELECT ride, min_by(e, seq) AS a, max_by(e, seq) AS b, max(seq) AS last FROM rec GROUP BY ride)
  SELECT ride, seq, round((sum(e) OVER (PARTITION BY ride ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + greatest(0, 5 - seq) * a + greatest(0, seq + 5 - last) * b) / 11, 4) AS m FROM rec JOIN f USING (ride)""")

_GAPS = ", g AS (SELECT *, CASE WHEN seq % 7 IN (2, 3) OR seq < 2 THEN NULL ELSE e END AS v FROM rec)"
_short("gap_fill", lambda r: _pick("v")(windows.interpolate_gaps(r.withColumn("g", F.when(~((F.col("seq") % 7).isin(2, 3) | (F.col("seq") < 2)), F.col("e"))), "g", "v")), _GAPS + """,
  h AS (SELECT ride, seq, v, max(CASE WHEN v IS NOT NULL THEN seq END) OVER (PARTITION BY ride ORDER BY seq) AS a, min(CASE WHEN v IS NOT NULL THEN seq END) OVER (PARTITION BY ride ORDER BY seq DESC) AS b FROM g)
  SELECT h.ride, h.seq, round(coalesce(h.v, x.v + (y.v - x.v) * (h.seq - h.a) / nullif(h.b - h.a, 0)::DOUBLE, x.v, y.v, 0), 4) AS v FROM h LEFT JOIN g x ON x.ride = h.ride AND x.seq = h.a LEFT JOIN g y ON y.ride = h.ride AND y.seq = h.b""")
_short("dropout_repair", lambda r: _pick("e_fixed")(metrics.fill_dropouts(r.withColumn("z", F.when(F.col("k") % 9 == 0, 0.0).otherwise(F.col("e"))), "z")), """, g AS (SELECT ride, seq, CASE WHEN k % 9 <> 0 AND e > 0 THEN e END AS v FROM rec),
  h AS (SELECT ride, seq, v, max(CASE WHEN v IS NOT NULL THEN seq END) OVER (PARTITION BY ride ORDER BY seq) AS a, min(CASE WHEN v IS NOT NULL THEN seq END) OVER (PARTITION BY ride ORDER BY seq DESC) AS b FROM g)
  SELECT h.ride, h.seq, round(coalesce(h.v, x.v + (y.v - x.v) * (h.seq - h.a) / nullif(h.b - h.a, 0)::DOUBLE, x.v, y.v, 0), 4) AS e_fixed FROM h LEFT JOIN g x ON x.ride = h.ride AND x.seq = h.a LEFT JOIN g y ON y.ride = h.ride AND y.seq = h.b""")


def _records(r: DataFrame) -> DataFrame:
    k = F.col("k")
    return r.select("ride", "seq", "ts", F.when(k % 13 != 0, F.col("d")).alias("distance"), F.when(k % 2 == 0, F.col("e")).alias("enhanced_altitude"), F.when(k % 5 != 0, F.col("e")).alias("altitude"), F.lit(None).cast("double").alias("enhanced_speed"), (F.col("spd") / 3.6).alias("speed"), F.when(k % 3 != 0, F.col("p")).alias("power"), F.col("hr").alias("heart_rate"), F.lit(None).cast("double").alias("cadence"))


_short("to_samples", lambda r: metrics.to_samples(_records(r)).drop("ts"), """, q AS (SELECT ride, seq, ts, CASE WHEN k % 13 <> 0 THEN d END AS x, CASE WHEN k % 2 = 0 OR k % 5 <> 0 THEN e END AS z, spd, CASE WHEN k % 3 <> 0 THEN p ELSE 0 END AS p, hr FROM rec),
  h AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN seq END) OVER u AS xa, min(CASE WHEN x IS NOT NULL THEN seq END) OVER v AS xb, max(CASE WHEN z IS NOT NULL THEN seq END) OVER u AS za, min(CASE WHEN z IS NOT NULL THEN seq END) OVER v AS zb, first_value(ts) OVER u AS t0
    FROM q WINDOW u AS (PARTITION BY ride ORDER BY seq), v AS (PARTITION BY ride ORDER BY seq DESC))
  SELECT h.ride, h.seq, round(date_diff('microseconds', h.t0, h.ts) / 1e6, 6) AS t, round(coalesce(h.x, a.x + (b.x - a.x) * (h.seq - xa) / nullif(xb - xa, 0)::DOUBLE, a.x, b.x, 0), 6) AS d,
    round(coalesce(h.z, c.z + (e.z - c.z) * (h.seq - za) / nullif(zb - za, 0)::DOUBLE, c.z, e.z, 0), 6) AS e, round(h.spd, 6) AS spd, round(h.p, 6) AS p, round(h.hr, 6) AS hr, 0e0 AS cad
  FROM h LEFT JOIN q a ON a.ride = h.ride AND a.seq = xa LEFT JOIN q b ON b.ride = h.ride AND b.seq = xb LEFT JOIN q c ON c.ride = h.ride AND c.seq = za LEFT JOIN q e ON e.ride = h.ride AND e.seq = zb""", digits=6)
_short("sensor_presence", metrics.sensor_presence, " SELECT ride, bool_or(p > 0) AS has_power, bool_or(cad > 0) AS has_cadence, bool_or(hr > 0) AS has_hr, count(*) FILTER (hr > 0) AS hr_samples, round(100.0e0 * count(*) FILTER (hr > 0) / count(*), 4) AS hr_coverage_pct FROM rec GROUP BY ride")

# -- zones ------------------------------------------------------------------------------------------


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else "'Infinity'::DOUBLE" if v == float("inf") else f"{v}" for v in r) + ")" for r in rows)


_R = physics.RIDER
_short("coggan_shares", lambda r: metrics.coggan_shares(r, 60.0), f""", z AS (SELECT * FROM (VALUES {_values([(i, z, lo * 60.0, hi * 60.0) for i, (z, lo, hi) in enumerate(scoring.COGGAN)])}) t(i, zone, lo, hi)), n AS (SELECT ride, count(*) AS n FROM rec WHERE p > 0 GROUP BY ride)
  SELECT n.ride, zone, round(round_even(100.0e0 * count(rec.p) / any_value(n), 1), 4) AS percent FROM n CROSS JOIN z LEFT JOIN rec ON rec.ride = n.ride AND p > 0 AND p > lo AND p <= hi GROUP BY 1, 2""")
_LOW = physics.Rider(ftp_w=60, map_w=80, ac_w=95, nm_w=110)
_short("power_zone_seconds", lambda r: metrics.power_zone_seconds(r, _LOW), f""", z AS (SELECT * FROM (VALUES {_values(scoring.summary_zones(_LOW))}) t(zone, lo, hi)), n AS (SELECT DISTINCT ride FROM rec WHERE cad > 0)
  SELECT n.ride, zone, count(rec.p) AS samples FROM n CROSS JOIN z LEFT JOIN rec ON rec.ride = n.ride AND cad > 0 AND p BETWEEN lo AND hi GROUP BY 1, 2""")
_HZ = [(z, 55 + 135 * lo if i else 0.0, 55 + 135 * hi if i < 5 else 200.0000001) for i, (z, lo, hi) in enumerate(scoring.KARVONEN)]
_short("heart_zone_seconds", metrics.heart_zone_seconds, f""", z AS (SELECT * FROM (VALUES {_values(_HZ)}) t(zone, lo, hi)), n AS (SELECT DISTINCT ride FROM rec WHERE hr > 0)
  SELECT n.ride, zone, count(rec.hr) AS samples FROM n CROSS JOIN z LEFT JOIN rec ON rec.ride = n.ride AND hr > 0 AND hr >= lo AND hr < hi GROUP BY 1, 2""")
_ASC = " SELECT ride, round(coalesce(sum(greatest(u, 0)), 0), 4) AS ascent_m, round(coalesce(sum(greatest(-u, 0)), 0), 4) AS descent_m FROM (SELECT ride, s - lag(s) OVER (PARTITION BY ride ORDER BY seq) AS u FROM x) GROUP BY ride"
_SOFT = {
    "median45": "CASE WHEN n < 45 THEN e ELSE quantile_cont(e, 0.5) OVER (PARTITION BY ride ORDER BY seq ROWS BETWEEN 22 PRECEDING AND 22 FOLLOWING) END",
    "median5": "CASE WHEN n < 5 THEN e ELSE quantile_cont(e, 0.5) OVER (PARTITION BY ride ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END",
    "zero9": "CASE WHEN n < 9 THEN e ELSE sum(e) OVER (PARTITION BY ride ORDER BY seq ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9 END",
    "truncated9": "avg(e) OVER (PARTITION BY ride ORDER BY seq ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)",
}
for _m, _x in _SOFT.items():
    _short(f"ascent_{_m}", lambda r, m=_m: metrics.ascent(r, m), f"{_N}, x AS (SELECT ride, seq, {_x} AS s FROM rec JOIN n USING (ride)){_ASC}")
_short("moving_time", lambda r: metrics.moving_time(r.withColumn("d", F.floor(F.col("d") / 40) * 40)), """, q AS (SELECT ride, seq, t, floor(d / 40) * 40 AS d FROM rec),
  v AS (SELECT ride, CASE WHEN t - lag(t, 5) OVER w > 0 THEN (d - lag(d, 5) OVER w) / (t - lag(t, 5) OVER w) * 3.6e0 ELSE 0 END AS v FROM q WINDOW w AS (PARTITION BY ride ORDER BY seq))
  SELECT ride, count(*) FILTER (v > 1) AS moving_s, count(*) AS samples FROM v GROUP BY ride""")

_SEG_PY = [("a", 0.05, 0.2), ("b", 0.15, 0.3), ("c", 9.0, 9.5)]
_SEG = f", seg AS (SELECT * FROM (VALUES {_values(_SEG_PY)}) t(segment, start_km, end_km)), s AS (SELECT rec.*, segment, row_number() OVER (PARTITION BY ride, segment ORDER BY seq) AS i FROM rec JOIN seg ON d BETWEEN start_km * 1000 AND end_km * 1000), s30 AS (SELECT *, CASE WHEN i >= 30 THEN avg(p) OVER (PARTITION BY ride, segment ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END AS m FROM s)"


def _segments(r: DataFrame) -> DataFrame:
    seg = r.sparkSession.createDataFrame(_SEG_PY, "segment string, start_km double, end_km double")
    return r.select("ride").distinct().crossJoin(F.broadcast(seg))  # three rows


_short("segment_stats", lambda r: metrics.segment_stats(r, _segments(r)), _SEG + """ SELECT ride, segment, count(*) AS duration_s, round_even(count(*) / 60.0e0, 1) AS minutes, round_even(avg(p), 0) AS avg_w, round_even(coalesce(pow(avg(pow(m, 4)), 0.25), avg(p)), 0) AS np_w, round_even(max(p), 0) AS max_w,
  round_even(avg(hr) FILTER (hr > 0), 0) AS avg_hr, round_even(max(hr) FILTER (hr > 0), 0) AS max_hr, round_even(avg(cad) FILTER (cad > 30), 0) AS avg_cad, round_even(avg(spd) FILTER (spd > 0), 1) AS avg_kmh, round_even(max(spd) FILTER (spd > 0), 1) AS max_kmh,
  CASE WHEN count(*) > 1 THEN round_even((max_by(d, seq) - min_by(d, seq)) / 1000, 2) END AS km FROM s30 GROUP BY 1, 2""")
_short("climb_stats", lambda r: metrics.climb_stats(r, _segments(r)), _SEG + """ SELECT ride, segment, round(max(t) - min(t), 6) AS duration_s, round(coalesce(avg(p) FILTER (p > 0), 0), 6) AS avg_w, round(coalesce(pow(avg(pow(m, 4)), 0.25), avg(p), 0), 6) AS np_w, round(max(p), 6) AS max_w,
  round(coalesce(avg(hr) FILTER (hr > 0), 0), 6) AS avg_hr, round(max(hr), 6) AS max_hr, round(coalesce(avg(cad) FILTER (cad > 0), 0), 6) AS avg_cad, round(coalesce(avg(spd) FILTER (spd > 0), 0), 6) AS avg_kmh FROM s30 GROUP BY 1, 2""", digits=6)
_short("flat_summary", lambda r: metrics.flat_summary(metrics.segment_stats(r, _segments(r))), _SEG + """, st AS (SELECT ride, segment, count(*) AS duration_s, round_even(avg(p), 0) AS avg_w, round_even(coalesce(pow(avg(pow(m, 4)), 0.25), avg(p)), 0) AS np_w, round_even(avg(hr) FILTER (hr > 0), 0) AS avg_hr, round_even(avg(cad) FILTER (cad > 30), 0) AS avg_cad, round_even(avg(spd) FILTER (spd > 0), 1) AS avg_kmh FROM s30 GROUP BY 1, 2)
  SELECT ride, count(*) AS segments, round(avg(avg_w), 4) AS avg_w, round(avg(np_w), 4) AS np_w, round(avg(avg_hr), 4) AS avg_hr, round(avg(avg_cad), 4) AS avg_cad, round(avg(avg_kmh), 4) AS avg_kmh, sum(duration_s)::BIGINT AS duration_s FROM st GROUP BY ride""")
_long("ftp_estimates", lambda r: metrics.ftp_estimates(r, windows=(60, 240, 600)), """, cs AS (SELECT ride, seq, sum(p) OVER (PARTITION BY ride ORDER BY seq) AS s FROM rec), w AS (SELECT unnest([60, 240, 600]) AS win),
  pk AS (SELECT a.ride, win, max((a.s - coalesce(b.s, 0)) / win) AS peak FROM cs a JOIN w ON a.seq >= win - 1 LEFT JOIN cs b ON a.ride = b.ride AND b.seq = a.seq - win GROUP BY 1, 2),
  pv AS (SELECT r.ride, max(peak) FILTER (win = 60) AS a, max(peak) FILTER (win = 240) AS b, max(peak) FILTER (win = 600) AS c FROM (SELECT DISTINCT ride FROM rec) r LEFT JOIN pk USING (ride) GROUP BY 1)
  SELECT ride, round_even(a * 0.90e0, 0) AS from_5min, round_even(b * 0.95e0, 0) AS from_20min, round_even(c, 0) AS from_60min, round_even(0.6e0 * a * 0.90e0 + 0.25e0 * b * 0.95e0 + 0.15e0 * c, 0) AS consensus FROM pv""")
_short("elevation_summary", metrics.elevation_summary, " SELECT ride, round_even(min(e), 0) AS min_m, round_even(max(e), 0) AS max_m, round_even((max(d) - min(d)) / 1000, 2) AS distance_km FROM rec GROUP BY ride")

# -- grades and runs --------------------------------------------------------------------------------

_SPAN = """, g AS (SELECT *, coalesce(max_by(struct_pack(d := d, e := e), seq) OVER (PARTITION BY ride ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND {m} PRECEDING), first_value(struct_pack(d := d, e := e)) OVER (PARTITION BY ride ORDER BY seq)) AS a,
  coalesce(min_by(struct_pack(d := d, e := e), seq) OVER (PARTITION BY ride ORDER BY -d RANGE BETWEEN UNBOUNDED PRECEDING AND {m} PRECEDING), last_value(struct_pack(d := d, e := e)) OVER (PARTITION BY ride ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS b FROM rec),
gr AS (SELECT ride, seq, d, e, CASE WHEN b.d - a.d < 5 THEN 0 ELSE 100 * (b.e - a.e) / (b.d - a.d) END AS grade FROM g)"""
_long("distance_grade", lambda r: _pick("grade")(windows.span_grade(r, "d", "e", 30.0, "grade")), _SPAN.format(m=30) + " SELECT ride, seq, round(grade, 4) AS grade FROM gr")
_long("mean_max_grade", lambda r: windows.mean_max_grade(r, "d", "e", [25, 100, 500, 1000, 1e6]), """, w AS (SELECT unnest([25e0, 100e0, 500e0, 1000e0, 1e6]) AS window_m), f AS (SELECT ride, window_m, d, e, (SELECT min_by(struct_pack(d := y.d, e := y.e), y.seq) FROM rec y WHERE y.ride = x.ride AND y.d >= x.d + window_m) AS b FROM rec x CROSS JOIN w)
  SELECT ride, window_m, round(max(CASE WHEN b.d > d THEN 100 * (b.e - e) / (b.d - d) END), 4) AS grade FROM f GROUP BY 1, 2""")
_long("row_grade", lambda r: _pick("grade")(windows.row_grade(r, "d", "e", 25, "grade")), " SELECT ride, seq, round(CASE WHEN last_value(d) OVER w > first_value(d) OVER w THEN (last_value(e) OVER w - first_value(e) OVER w) / (last_value(d) OVER w - first_value(d) OVER w) * 100 ELSE 0 END, 4) AS grade FROM rec WINDOW w AS (PARTITION BY ride ORDER BY seq ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING)")
_long("longest_run", lambda r: runs.longest_run_above(windows.span_grade(r, "d", "e", 30.0, "grade"), "grade", "d", (4.0, 8.0, 99.0)), _SPAN.format(m=30) + """, t AS (SELECT unnest([4e0, 8e0, 99e0]) AS threshold), m AS (SELECT gr.*, threshold, coalesce(lag(d) OVER (PARTITION BY ride, threshold ORDER BY seq), d) AS b, grade >= threshold AS c, seq - row_number() OVER (PARTITION BY ride, threshold, grade >= threshold ORDER BY seq) AS i FROM gr CROSS JOIN t),
  l AS (SELECT ride, threshold, max(d) - min(b) AS x FROM m WHERE c GROUP BY ride, threshold, i) SELECT r.ride, t.threshold, round(coalesce(max(x), 0), 4) AS metres FROM (SELECT DISTINCT ride FROM rec) r CROSS JOIN t LEFT JOIN l ON l.ride = r.ride AND l.threshold = t.threshold GROUP BY 1, 2""")
_long("walls", lambda r: runs.walls(windows.span_grade(r, "d", "e", 15.0, "grade"), "grade", "d"), _SPAN.format(m=15) + """, m AS (SELECT *, min(d) OVER (PARTITION BY ride) AS d0, max(d) OVER (PARTITION BY ride) AS d1, seq - row_number() OVER (PARTITION BY ride, grade >= 10 ORDER BY seq) AS i FROM gr),
  l AS (SELECT ride, row_number() OVER (PARTITION BY ride ORDER BY min(seq))::INTEGER AS run, min(d) AS s, max(d) AS e, max(grade) AS peak, any_value(d0) AS d0, any_value(d1) AS d1 FROM m WHERE grade >= 10 GROUP BY ride, i)
  SELECT ride, run, round(s - d0, 4) AS offset_m, round(e - s, 4) AS length_m, round(peak, 4) AS peak_pct, round(100 * (s - d0) / (d1 - d0), 4) AS pct_in FROM l WHERE e - s >= 30""")
_ROWG = ", gr AS (SELECT *, CASE WHEN last_value(d) OVER w > first_value(d) OVER w THEN (last_value(e) OVER w - first_value(e) OVER w) / (last_value(d) OVER w - first_value(d) OVER w) * 100 ELSE 0 END AS grade, count(*) OVER (PARTITION BY ride) AS n FROM rec WINDOW w AS (PARTITION BY ride ORDER BY seq ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING))"


def _runs_sql(cond: str, aggs: str, least: int) -> str:
    return f""", c AS (SELECT *, coalesce({cond}, false) AS ok FROM gr WHERE n >= 100), i AS (SELECT *, seq - row_number() OVER (PARTITION BY ride, ok ORDER BY seq) AS i FROM c), l AS (SELECT ride, count(*) AS samples, min(seq) AS f, {aggs} FROM i WHERE ok GROUP BY ride, i HAVING count(*) >= {least})
  SELECT * EXCLUDE (f), row_number() OVER (PARTITION BY ride ORDER BY f)::INTEGER AS run FROM l"""


_long("flat_segments", lambda r: runs.flat_segments(r, least_samples=10), _ROWG + _runs_sql("abs(grade) <= 2", "round(min(d) / 1000, 4) AS km_start, round(max(d) / 1000, 4) AS km_end", 10))
_long("flat_attacks", lambda r: runs.flat_attacks(r, 100.0, least_samples=2, most_pct=5.0), _ROWG + _runs_sql("abs(grade) <= 5 AND p > 120", "round(min(d) / 1000, 4) AS km, round(avg(p), 4) AS avg_w, round(max(p), 4) AS peak_w", 2))
_long("attack_summary", lambda r: metrics.attack_summary(runs.flat_attacks(r, 100.0, least_samples=2, most_pct=5.0)), _ROWG + _runs_sql("abs(grade) <= 5 AND p > 120", "max(p) AS peak_w", 2).replace("SELECT * EXCLUDE (f), row_number() OVER (PARTITION BY ride ORDER BY f)::INTEGER AS run FROM l", "SELECT ride, count(*) AS attacks, round(max(peak_w), 4) AS peak_w, max(samples) AS longest_s FROM l GROUP BY ride"))
_long("rising_stretches", lambda r: runs.rising_stretches(r).drop("run"), _SPAN.format(m=100) + """, i AS (SELECT *, seq - row_number() OVER (PARTITION BY ride, grade >= 1.5 ORDER BY seq) AS i FROM gr), l AS (SELECT ride, min(d) AS s, max(d) AS t, max_by(e, seq) - min_by(e, seq) AS gain, max(grade) AS peak FROM i WHERE grade >= 1.5 GROUP BY ride, i)
  SELECT ride, round(s / 1000, 4) AS start_km, round(t / 1000, 4) AS end_km, round(t - s, 4) AS length_m, round(gain, 4) AS gain_m, round(gain / (t - s) * 100, 4) AS avg_pct, round(peak, 4) AS peak_pct FROM l WHERE t - s >= 300 AND gain >= 20""")

# -- climbs -----------------------------------------------------------------------------------------

_CLIMBS = """, n AS (SELECT ride, count(*) AS n, max_by(d, seq) AS dend FROM rec GROUP BY ride HAVING count(*) >= 50 AND max_by(d, seq) >= 100),
sm AS (SELECT ride, seq, d, sum(e) OVER (PARTITION BY ride ORDER BY seq ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 15 AS s FROM rec JOIN n USING (ride)),
gd AS (SELECT ride, k, k * 50e0 AS x FROM (SELECT ride, unnest(range(0, ceil(dend / 50)::BIGINT)) AS k FROM n)),
ga AS (SELECT gd.*, a.d AS ad, a.s AS as_ FROM gd ASOF LEFT JOIN sm a ON a.ride = gd.ride AND gd.x >= a.d),
gb AS (SELECT ga.*, b.d AS bd, b.s AS bs FROM ga ASOF LEFT JOIN sm b ON b.ride = ga.ride AND ga.x < b.d),
cell AS (SELECT ride, k, CASE WHEN ad IS NULL THEN bs WHEN bd IS NULL THEN as_ ELSE as_ + (bs - as_) * (x - ad) / (bd - ad) END AS z, count(*) OVER (PARTITION BY ride) AS cells FROM gb),
cin AS (SELECT *, coalesce((lead(z, 2) OVER w - lag(z, 2) OVER w) / 200, 0) > 0.015 AS c FROM cell WHERE cells > 4 WINDOW w AS (PARTITION BY ride ORDER BY k)),
con AS (SELECT *, c OR (k + 4 < cells AND (coalesce(lead(c, 1) OVER w, false) OR coalesce(lead(c, 2) OVER w, false) OR coalesce(lead(c, 3) OVER w, false))) AS o FROM cin WINDOW w AS (PARTITION BY ride ORDER BY k)),
isl AS (SELECT *, k - row_number() OVER (PARTITION BY ride, o ORDER BY k) AS g FROM con),
cl AS (SELECT ride, min(k) FILTER (c) AS i, max(k) + 1 AS j, any_value(cells) AS cells FROM isl WHERE o GROUP BY ride, g HAVING min(k) FILTER (c) IS NOT NULL),
cg AS (SELECT cl.ride, i, j, least(j, cl.cells - 1) AS jj, (j - i) * 50e0 AS length_m, b.z - a.z AS gain_m FROM cl JOIN cell a ON a.ride = cl.ride AND a.k = i JOIN cell b ON b.ride = cl.ride AND b.k = least(j, cl.cells - 1)),
cn AS (SELECT *, row_number() OVER (PARTITION BY ride ORDER BY i)::INTEGER AS climb_no, i * 50e0 AS start_m, jj * 50e0 AS end_m FROM cg WHERE length_m >= 300 AND gain_m >= 20),
ar AS (SELECT rec.ride, climb_no, seq, d, e, count(*) OVER (PARTITION BY rec.ride, climb_no) AS n FROM rec JOIN cn ON cn.ride = rec.ride AND d BETWEEN start_m - 100 AND end_m + 100),
md AS (SELECT ride, climb_no, seq, d, quantile_cont(e, 0.5) OVER (PARTITION BY ride, climb_no ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM ar WHERE n >= 5),
me AS (SELECT ride, climb_no, min(d) AS lo, max(d) AS hi FROM md GROUP BY 1, 2),
mg AS (SELECT ride, climb_no, k, lo + k * 10e0 AS x FROM (SELECT ride, climb_no, lo, unnest(range(0, ceil((hi - lo) / 10)::BIGINT)) AS k FROM me)),
ma AS (SELECT mg.*, a.d AS ad, a.s AS as_ FROM mg ASOF LEFT JOIN md a ON a.ride = mg.ride AND a.climb_no = mg.climb_no AND mg.x >= a.d),
mb AS (SELECT ma.*, b.d AS bd, b.s AS bs FROM ma ASOF LEFT JOIN md b ON b.ride = ma.ride AND b.climb_no = ma.climb_no AND ma.x < b.d),
mz AS (SELECT ride, climb_no, k, x, CASE WHEN ad IS NULL THEN bs WHEN bd IS NULL THEN as_ ELSE as_ + (bs - as_) * (x - ad) / (bd - ad) END AS z, count(*) OVER (PARTITION BY ride, climb_no) AS cells FROM mb),
mr AS (SELECT *, coalesce((lead(z, 2) OVER w - lag(z, 2) OVER w) / 40 * 100, 0) AS g FROM mz WHERE cells > 4 WINDOW w AS (PARTITION BY ride, climb_no ORDER BY k)),
mx AS (SELECT mr.ride, mr.climb_no, max(g) AS g FROM mr JOIN cn ON cn.ride = mr.ride AND cn.climb_no = mr.climb_no WHERE x BETWEEN start_m AND end_m GROUP BY 1, 2),
climbs AS (SELECT cn.ride, cn.climb_no, start_m / 1000 AS start_km, end_m / 1000 AS end_km, length_m, gain_m, gain_m / length_m * 100 AS avg_grade_pct, coalesce(g, 0) AS max_grade_pct FROM cn LEFT JOIN mx ON mx.ride = cn.ride AND mx.climb_no = cn.climb_no)"""
_ROUND_CLIMB = "ride, climb_no, round(start_km, 4) AS start_km, round(end_km, 4) AS end_km, round(length_m, 4) AS length_m, round(gain_m, 4) AS gain_m, round(avg_grade_pct, 4) AS avg_grade_pct, round(max_grade_pct, 4) AS max_grade_pct"
_long("find_climbs", climbs.find_climbs, _CLIMBS + f" SELECT {_ROUND_CLIMB} FROM climbs")
_INDEX = "length_m / 1000 * avg_grade_pct"


def _case(rows, at: int, last: str, x: str = _INDEX) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {r[0]} THEN {repr(r[at])}" for r in rows) + f" ELSE {last} END"


_long("climb_category", lambda r: climbs.categorised(climbs.find_climbs(r)).select("ride", "climb_no", "index", "category", "points"), _CLIMBS + f" SELECT ride, climb_no, round({_INDEX}, 4) AS index, {_case(scoring.CATEGORIES, 1, repr('uncat'))} AS category, ({_case(scoring.CATEGORIES, 2, '0')})::INTEGER AS points FROM climbs")
_long("climb_totals", lambda r: climbs.climb_totals(climbs.find_climbs(r)), _CLIMBS + f" SELECT ride, count(*) AS climbs, sum({_case(scoring.CATEGORIES, 2, '0')})::BIGINT AS points, (array_agg(climb_no ORDER BY {_INDEX} DESC, climb_no))[1] AS hardest FROM climbs WHERE {_INDEX} >= 2 GROUP BY ride")
_long("select_for_detail", lambda r: climbs.select_for_detail(climbs.find_climbs(r), cap=2).select("ride", "climb_no", "reason"), _CLIMBS + f""", q AS (SELECT *, {_INDEX} AS ix, CASE WHEN {_INDEX} >= 6 THEN printf('Cat 3+ (index %.1f)', {_INDEX}) WHEN max_grade_pct >= 8 THEN printf('steep pitch (GPX max %.1f%%)', max_grade_pct) END AS reason FROM climbs),
  p AS (SELECT *, row_number() OVER (PARTITION BY ride, ix >= 6 ORDER BY max_grade_pct DESC, climb_no) AS place FROM q WHERE reason IS NOT NULL) SELECT ride, climb_no, reason FROM p WHERE ix >= 6 OR place <= 2""")
_long("select_for_detail_whole", lambda r: climbs.select_for_detail(climbs.find_climbs(r)).select("ride", "climb_no", "reason"), ORACLE_SQL["select_for_detail"].partition(LONG_SQL)[2].replace("place <= 2", "place <= 8"))
_long("grade_profile", lambda r: climbs.grade_profile(r).drop("cells"), """, md AS (SELECT ride, seq, d, quantile_cont(e, 0.5) OVER (PARTITION BY ride ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM rec), me AS (SELECT ride, min(d) AS lo, max(d) AS hi FROM md GROUP BY 1),
  mg AS (SELECT ride, k, lo + k * 10e0 AS x FROM (SELECT ride, lo, unnest(range(0, ceil((hi - lo) / 10)::BIGINT)) AS k FROM me)), ma AS (SELECT mg.*, a.d AS ad, a.s AS as_ FROM mg ASOF LEFT JOIN md a ON a.ride = mg.ride AND mg.x >= a.d), mb AS (SELECT ma.*, b.d AS bd, b.s AS bs FROM ma ASOF LEFT JOIN md b ON b.ride = ma.ride AND ma.x < b.d),
  mz AS (SELECT ride, k, x, CASE WHEN ad IS NULL THEN bs WHEN bd IS NULL THEN as_ ELSE as_ + (bs - as_) * (x - ad) / (bd - ad) END AS z FROM mb) SELECT ride, k::INTEGER AS k, round(x, 4) AS x, round(z, 4) AS e, round(coalesce((lead(z, 2) OVER w - lag(z, 2) OVER w) / 40 * 100, 0), 4) AS grade FROM mz WINDOW w AS (PARTITION BY ride ORDER BY k)""")
_long("resample_segment", lambda r: windows.onto_grid(windows.smooth(r, "e", 11, "s", mode="edge"), "d", ["s"], 50.0), """, f AS (SELECT ride, min_by(e, seq) AS a, max_by(e, seq) AS b, max(seq) AS last FROM rec GROUP BY ride), md AS (SELECT ride, seq, d, (sum(e) OVER (PARTITION BY ride ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + greatest(0, 5 - seq) * a + greatest(0, seq + 5 - last) * b) / 11 AS s FROM rec JOIN f USING (ride)),
  me AS (SELECT ride, min(d) AS lo, max(d) AS hi FROM md GROUP BY 1), mg AS (SELECT ride, k, lo + k * 50e0 AS x FROM (SELECT ride, lo, unnest(range(0, ceil((hi - lo) / 50)::BIGINT)) AS k FROM me)), ma AS (SELECT mg.*, a.d AS ad, a.s AS as_ FROM mg ASOF LEFT JOIN md a ON a.ride = mg.ride AND mg.x >= a.d), mb AS (SELECT ma.*, b.d AS bd, b.s AS bs FROM ma ASOF LEFT JOIN md b ON b.ride = ma.ride AND ma.x < b.d)
  SELECT ride, k::INTEGER AS k, round(x, 4) AS x, round(CASE WHEN ad IS NULL THEN bs WHEN bd IS NULL THEN as_ ELSE as_ + (bs - as_) * (x - ad) / (bd - ad) END, 4) AS s FROM mb""")


def _speed_sql(p: str, g: str, mass: float = _R.system_weight_kg) -> str:
    """Newton's method from above, unrolled: converges to the same root as the closed form."""
    b = f"(({_R.crr}e0 + sin(atan(({g}) / 100e0))) * {mass}e0 * {_R.gravity}e0 / {0.5 * _R.air_density * _R.cda}e0)"
    q = f"(({p}) * {_R.efficiency}e0 / {0.5 * _R.air_density * _R.cda}e0)"
    disc = f"({q} * {q} / 4e0 + {b} * {b} * {b} / 27e0)"
    one = f"(cbrt({q} / 2e0 + sqrt(greatest({disc}, 0e0))) + cbrt({q} / 2e0 - sqrt(greatest({disc}, 0e0))))"
    r = f"sqrt(greatest(-{b} / 3e0, 0e0))"
    three = f"(2e0 * {r} * cos(acos(least(1e0, greatest(-1e0, {q} / (2e0 * {r} * {r} * {r})))) / 3e0))"
    return f"(greatest(CASE WHEN {q} = 0 AND {b} < 0 THEN sqrt(greatest(-{b}, 0e0)) WHEN {q} = 0 THEN 0e0 WHEN {disc} >= 0 THEN {one} ELSE {three} END, 0e0) * 3.6e0)"


def _power_sql(v: str, g: str) -> str:
    return f"(({0.5 * _R.air_density * _R.cda}e0 * ({v} / 3.6e0) * ({v} / 3.6e0) + ({_R.crr}e0 + sin(atan(({g}) / 100e0))) * {_R.system_weight_kg}e0 * {_R.gravity}e0) * ({v} / 3.6e0) / {_R.efficiency}e0)"


_PARTS = "SELECT p_partkey AS id, (p_size % 26 - 8)::DOUBLE AS grade, (p_partkey % 7 * 60)::DOUBLE AS watts FROM part"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 26 - 8).cast("double").alias("grade"), (F.col("p_partkey") % 7 * 60).cast("double").alias("watts"))


_register("speed_model", lambda s, d: _parts(s, d).select("id", physics.predict_speed("watts", "grade").alias("kmh"), physics.predict_speed("watts", "grade", cap_kmh=60.0).alias("capped"), physics.vam("watts", "grade").alias("vam"), physics.speed_uncertainty("grade").alias("plus_minus")), f"WITH x AS ({_PARTS}), v AS (SELECT *, {_speed_sql('watts', 'grade')} AS v FROM x) SELECT id, round(v, 4) AS kmh, round(least(v, 60e0), 4) AS capped, round(v * 1000 * grade / 100, 4) AS vam, CASE WHEN grade >= 5 THEN 1.5e0 WHEN grade >= 1 THEN 1.7e0 ELSE 2e0 END AS plus_minus FROM v")
_register("power_model", lambda s, d: _parts(s, d).select("id", physics.predict_power(F.col("watts") / 10, "grade").alias("watts"), physics.survival_power("grade").alias("survival_w"), physics.cadence(F.col("watts") / 10, 39, 17).alias("rpm")), f"WITH x AS ({_PARTS}) SELECT id, round({_power_sql('(watts / 10e0)', 'grade')}, 4) AS watts, round({_power_sql(f'(60e0 * 0.9375e0 * {_R.wheel_circ_m}e0 * 60e0 / 1000e0)', 'grade')}, 4) AS survival_w, round(CASE WHEN watts > 0 THEN (watts / 10e0 * 1000e0 / 60e0) / ({_R.wheel_circ_m}e0 * 39e0 / 17e0) ELSE 0 END, 4) AS rpm FROM x")
_ZB = scoring.zone_bounds()
_register("zone_for_power", lambda s, d: _parts(s, d).select("id", scoring.zone_for_power(F.col("watts") + F.col("grade") * 3).alias("zone")), f"WITH x AS (SELECT id, watts + grade * 3 AS p FROM ({_PARTS})) SELECT id, CASE WHEN p < 0 THEN '{_ZB[0][0]}' " + " ".join(f"WHEN p BETWEEN {lo} AND {hi} THEN '{z}'" for z, lo, hi in reversed(_ZB)) + f" ELSE '{_ZB[-1][0]}' END AS zone FROM x")
_register("gear_choice", lambda s, d: climbs.gear_choice(_parts(s, d).select("id", (F.col("watts") / 9).alias("speed_kmh")), [30, 39, 50], [11, 13, 15, 17, 19, 21, 24, 28, 32]), f"""WITH x AS (SELECT id, watts / 9 AS v FROM ({_PARTS})), g AS (SELECT * FROM (SELECT unnest([30, 39, 50]) AS ring_t) CROSS JOIN (SELECT unnest([11, 13, 15, 17, 19, 21, 24, 28, 32]) AS cog_t)),
  c AS (SELECT id, ring_t, cog_t, CASE WHEN v > 0 THEN (v * 1000 / 60) / ({_R.wheel_circ_m}e0 * ring_t / cog_t) ELSE 0 END AS rpm FROM x CROSS JOIN g), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN rpm BETWEEN 50 AND 110 THEN 0 ELSE 1 END, abs(rpm - 70), ring_t, cog_t) AS n FROM c) SELECT id, ring_t, cog_t, round(rpm, 4) AS rpm FROM r WHERE n = 1""")


def _predictions(r: DataFrame) -> DataFrame:
    p = climbs.predict_climbs(climbs.find_climbs(r))
    return p.select("ride", "climb_no", F.explode("powers").alias("effort", "x"), "vam_ftp", "survival_w", "intent").select("ride", "climb_no", "effort", F.col("x.w").alias("w"), F.col("x.speed_kmh").alias("speed_kmh"), F.col("x.time_min").alias("time_min"), "vam_ftp", "survival_w", "intent")


_G = "avg_grade_pct"
_TF = f"(length_m / 1000 / {_speed_sql('200e0', _G)} * 60)"
_long("predict_climbs", _predictions, _CLIMBS + f""", ef AS (SELECT * FROM (VALUES ('ftp', 200), ('map', 250), ('z3', 160), ('z2', 130)) t(effort, w)), v AS (SELECT climbs.*, effort, w, {_speed_sql('w::DOUBLE', _G)} AS v FROM climbs CROSS JOIN ef)
  SELECT ride, climb_no, effort, w, round_even(v, 2) AS speed_kmh, CASE WHEN v > 0 THEN round_even(length_m / 1000 / v * 60, 1) END AS time_min, round_even({_speed_sql('200e0', _G)} * 1000 * avg_grade_pct / 100, 0) AS vam_ftp,
  CASE WHEN max_grade_pct > 5 THEN round_even({_power_sql(f'(60e0 * 0.9375e0 * {_R.wheel_circ_m}e0 * 60e0 / 1000e0)', 'max_grade_pct')}, 0) END AS survival_w,
  CASE WHEN {_TF} < 3 THEN 'AC zone (sub-3min): up to 350W' WHEN {_TF} <= 8 THEN 'MAP zone (3-8min): 200-250W' WHEN {_TF} <= 20 THEN 'Threshold to Sweet Spot (8-20min): 170-200W' ELSE 'Sweet Spot (20+ min): 170-188W' END AS intent FROM v""")
_long("verified_pacing", lambda r: climbs.verified_pacing(climbs.find_climbs(r).withColumn("peak_pct", F.col("max_grade_pct"))).select("ride", "climb_no", "avg_pct", "speed_ftp_kmh", "speed_map_kmh", "speed_z3_kmh", "duration_ftp_min", "duration_map_min", "vam_ftp", "survival_w"), _CLIMBS + f""", v AS (SELECT *, {_speed_sql('200e0', _G)} AS f, {_speed_sql('250e0', _G)} AS m, {_speed_sql('130e0', _G)} AS z FROM climbs)
  SELECT ride, climb_no, round(avg_grade_pct, 4) AS avg_pct, round(f, 4) AS speed_ftp_kmh, round(m, 4) AS speed_map_kmh, round(z, 4) AS speed_z3_kmh, round(length_m / 1000 / f * 60, 4) AS duration_ftp_min, round(length_m / 1000 / m * 60, 4) AS duration_map_min, round(f * 1000 * avg_grade_pct / 100, 4) AS vam_ftp, round({_power_sql(f'(60e0 * 0.9375e0 * {_R.wheel_circ_m}e0 * 60e0 / 1000e0)', 'max_grade_pct')}, 4) AS survival_w FROM v""")
_long("route_load", lambda r: climbs.route_load(r.groupBy("ride").agg((F.max("d") / 1000).alias("distance_km")), climbs.find_climbs(r)), _CLIMBS + f""", rt AS (SELECT ride, max(d) / 1000 AS km FROM rec GROUP BY ride), m AS (SELECT ride, sum(length_m) / 1000 AS ck, sum(length_m / 1000 / {_speed_sql('150e0', _G)} * 60) AS cm FROM climbs GROUP BY ride),
  h AS (SELECT rt.ride, (greatest(0, km - coalesce(ck, 0)) / 25 * 60 + coalesce(cm, 0)) / 60 AS h FROM rt LEFT JOIN m USING (ride)), o AS (SELECT *, round_even(h * 0.90e0, 2) AS lo, round_even(h * 1.12e0, 2) AS hi FROM h)
  SELECT ride, round_even(h, 2) AS hours, round_even(h * 0.65e0 * 0.65e0 * 100, 0) AS tss, round_even(h * 0.7e0 * 0.7e0 * 100, 0) AS tss_070, round_even(h * 0.75e0 * 0.75e0 * 100, 0) AS tss_075, lo AS hours_lo, hi AS hours_hi, round_even(lo * 0.65e0 * 0.65e0 * 100, 0) AS tss_lo, round_even(hi * 0.75e0 * 0.75e0 * 100, 0) AS tss_hi FROM o""")

# -- scores -----------------------------------------------------------------------------------------

_register("tyre_pressure", lambda s, d: _parts(s, d).select("id", *(c.alias(f"{n}_{e}") for n, (f, r) in scoring.TYRES.items() for e, c in zip(("front", "rear"), scoring.tyre_pressure(f, r, 45 + F.col("id") % 6, 70 + F.col("id") % 30)))), f"WITH x AS (SELECT id, 45e0 + id % 6 AS s, (70e0 + id % 30) / 90e0 AS k FROM ({_PARTS})) SELECT id, " + ", ".join(f"round_even(({f}e0 - (48 - s) * 0.67e0) * (1 + (k - 1) * (s / 48e0)), 0) AS {n}_front, round_even(({r}e0 + (48 - s) * 0.67e0) * (1 + (k - 1) * ((100 - s) / 52e0)), 0) AS {n}_rear" for n, (f, r) in scoring.TYRES.items()) + " FROM x")
_register("tsb_state", lambda s, d: _parts(s, d).select("id", scoring.tsb_state(F.col("grade") * 3).alias("state")), f"SELECT id, CASE WHEN grade * 3 > 15 THEN 'detraining risk (long periods)' " + " ".join(f"WHEN grade * 3 >= {t} THEN '{x}'" for t, x in scoring.TSB_BANDS) + f" ELSE 'OVERREACHING — high illness/injury risk' END AS state FROM ({_PARTS})")
_register("grade_colour", lambda s, d: _parts(s, d).select("id", scoring.grade_colour("grade").alias("colour")), "SELECT id, CASE " + " ".join(f"WHEN abs(grade) < {t} THEN '{c}'" for t, c in scoring.RIDE_COLOURS) + f" ELSE '{scoring.RIDE_COLOURS[-1][1]}' END AS colour FROM ({_PARTS})")
_register("front_share", lambda s, d: _parts(s, d).select("id", scoring.front_share(F.when(F.col("id") % 3 == 0, F.concat(F.col("id") % 60, F.lit(" / 60"))).when(F.col("id") % 3 == 1, F.col("id").cast("string")).otherwise("half")).alias("front")), f"SELECT id, CASE WHEN id % 3 = 0 THEN (id % 60)::DOUBLE WHEN id % 3 = 1 THEN id::DOUBLE END AS front FROM ({_PARTS})")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("athlete"), F.col("o_orderdate").alias("ts"), (F.col("o_orderkey") % 120).cast("double").alias("tss"))
    return load.day_numbers(o).select("athlete", "day", "tss", F.lit(40.0).alias("ctl_start"), F.lit(45.0).alias("atl_start"))


_DAILY = "WITH dd AS (SELECT o_custkey AS athlete, o_orderdate::DATE AS date, sum(o_orderkey % 120)::DOUBLE AS tss FROM orders GROUP BY 1, 2), daily AS (SELECT athlete, date_diff('day', min(date) OVER (PARTITION BY athlete), date) AS day, tss FROM dd), n AS (SELECT *, row_number() OVER (PARTITION BY athlete ORDER BY day) AS i FROM daily)"
_EMA = "(SELECT pow(exp(-1 / {d}e0), n.i) * {s}e0 + sum((1 - exp(-1 / {d}e0)) * m.tss * pow(exp(-1 / {d}e0), n.i - m.i)) FROM n m WHERE m.athlete = n.athlete AND m.i <= n.i)"
_register("ctl_projection", lambda s, d: load.project(_daily(s, d)).drop("state"), _DAILY + f", p AS (SELECT athlete, day, i, tss, {_EMA.format(d=42, s=40)} AS ctl, {_EMA.format(d=7, s=45)} AS atl FROM n) SELECT athlete, day, tss, round(ctl, 4) AS ctl, round(atl, 4) AS atl, round(coalesce(lag(ctl - atl) OVER (PARTITION BY athlete ORDER BY i), -5), 4) AS tsb FROM p")
_register("weekly_load", lambda s, d: load.weekly(_daily(s, d)), _DAILY + ", w AS (SELECT athlete, (day // 7)::BIGINT AS week, sum(tss) AS tss FROM daily GROUP BY 1, 2) SELECT athlete, week, tss, CASE WHEN tss > 280 THEN 'above' WHEN tss < 200 THEN 'below' ELSE 'in band' END AS band FROM w")

# -- geometry and joins -----------------------------------------------------------------------------

_HAV = "(2 * 6371000e0 * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"
_short("track_distance", lambda r: _pick("cum_m")(windows.track_distance(r)), f", s AS (SELECT ride, seq, coalesce({_HAV.format(a='lag(lat) OVER w', b='lat', c='lag(lon) OVER w', d='lon')}, 0) AS x FROM rec WINDOW w AS (PARTITION BY ride ORDER BY seq)) SELECT ride, seq, round(sum(x) OVER (PARTITION BY ride ORDER BY seq), 4) AS cum_m FROM s")
_short("loops", metrics.loops, f", p AS (SELECT ride, min_by(lat, seq) AS a, max_by(lat, seq) AS b, min_by(lon, seq) AS c, max_by(lon, seq) AS d, count(*) AS n FROM rec GROUP BY ride), q AS (SELECT ride, n, {_HAV.format(a='a', b='b', c='c', d='d')} AS g FROM p) SELECT ride, round(g, 4) AS gap_m, g < 150 AND n >= 2 AS is_loop FROM q")
_short("bounding_box", lambda r: metrics.bounding_box(r.withColumns({"lat": F.col("lat") * 1e5, "lon": F.col("lon") * 1e5})), " SELECT ride, round(min(lon * 1e5), 4) AS min_lon, round(min(lat * 1e5), 4) AS min_lat, round(max(lon * 1e5), 4) AS max_lon, round(max(lat * 1e5), 4) AS max_lat FROM rec GROUP BY ride")
_short("densify", lambda r: verify.densify(r, 5.0).withColumns({"lat": F.col("lat") * 1e5, "lon": F.col("lon") * 1e5}), f""", l AS (SELECT ride, seq, lat, lon, lead(lat) OVER w AS la, lead(lon) OVER w AS lo FROM rec WINDOW w AS (PARTITION BY ride ORDER BY seq)), n AS (SELECT *, CASE WHEN la IS NULL THEN 1 ELSE greatest(1, ceil({_HAV.format(a='lat', b='la', c='lon', d='lo')} / 5)::BIGINT) END AS n FROM l), k AS (SELECT *, unnest(range(n)) AS k FROM n)
  SELECT ride, row_number() OVER (PARTITION BY ride ORDER BY seq, k) - 1 AS seq, round((CASE WHEN k = 0 THEN lat ELSE lat + (la - lat) * (k / n::DOUBLE) END) * 1e5, 4) AS lat, round((CASE WHEN k = 0 THEN lon ELSE lon + (lo - lon) * (k / n::DOUBLE) END) * 1e5, 4) AS lon FROM k""")
_short("subsample", lambda r: windows.subsample(r, 10).select("ride", "seq"), ", n AS (SELECT ride, count(*) AS n FROM rec GROUP BY ride) SELECT DISTINCT rec.ride, rec.seq FROM rec JOIN n USING (ride), (SELECT unnest(range(10)) AS pick) WHERE n <= 10 OR seq = round_even(pick * (n - 1) / 9e0, 0)")
_short("drop_repeats", lambda r: windows.drop_repeats(r.withColumn("m", F.col("k") % 3), ["m"]).select("ride", "seq"), " SELECT ride, seq FROM (SELECT ride, seq, k % 3 AS m, lag(k % 3) OVER (PARTITION BY ride ORDER BY seq) AS b FROM rec) WHERE b IS NULL OR m <> b")


def _spans(r: DataFrame, off: int) -> DataFrame:
    return r.where(F.col("seq") % 20 == off).select("ride", (F.floor(F.col("seq") / 20) + 1).cast("int").alias("climb_no"), (F.col("d") / 1000).alias("start_km"), ((F.col("d") + F.col("k")) / 1000).alias("end_km"), F.col("e").alias("max_grade_pct"), F.col("e").alias("peak_pct"))


def _groups(r: DataFrame) -> DataFrame:
    """Climbs of twenty consecutive rows each: every row is in one.  For queries without SQL."""
    g = r.groupBy("ride", (F.floor(F.col("seq") / 20) + 1).cast("int").alias("climb_no"))
    return g.agg((F.min("d") / 1000).alias("start_km"), (F.max("d") / 1000).alias("end_km"), F.max("e").alias("max_grade_pct"))


_SPANS = ", a AS (SELECT ride, (seq // 20 + 1)::INTEGER AS climb_no, d / 1000 AS s, (d + k) / 1000 AS t, e AS g FROM rec WHERE seq % 20 = 0), b AS (SELECT ride, (seq // 20 + 1)::INTEGER AS climb_no, d / 1000 AS s, (d + k) / 1000 AS t, e AS g FROM rec WHERE seq % 20 = 9)"
_short("interval_anti", lambda r: joins.not_overlapping(_spans(r, 0), _spans(r, 9)).select("ride", "climb_no"), _SPANS + " SELECT ride, climb_no FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.ride = a.ride AND a.s <= b.t AND b.s <= a.t)")
_short("cross_validate", lambda r: joins.cross_validate(_spans(r, 0), _spans(r, 9)), _SPANS + """, h AS (SELECT a.ride, a.climb_no AS found_no, b.climb_no AS verified_no, b.g - a.g AS x FROM a JOIN b ON a.ride = b.ride AND a.s <= b.t AND b.s <= a.t)
  SELECT ride, 'matched' AS kind, found_no, min(verified_no) AS verified_no, round(min_by(x, verified_no), 4) AS delta_pp FROM h GROUP BY ride, found_no UNION ALL SELECT ride, 'gap', climb_no, NULL, NULL FROM a WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.ride = a.ride AND h.found_no = a.climb_no) UNION ALL SELECT ride, 'extra', NULL, climb_no, NULL FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.ride = b.ride AND h.verified_no = b.climb_no)""")


def _verified(r: DataFrame) -> DataFrame:
    return _spans(r, 0).withColumns({"source": F.when(F.col("climb_no") == 4, "missed").otherwise("declared"), "delta_pp": F.when(F.col("climb_no") != 2, (F.col("max_grade_pct") - 100) / 20), "length_above_8": (F.col("end_km") - F.col("start_km")) * 300})


_short("route_verdicts", lambda r: metrics.route_verdicts(_verified(r)), _SPANS + ", v AS (SELECT ride, max(CASE WHEN climb_no NOT IN (2, 4) THEN (g - 100) / 20 END) AS w, count(*) FILTER (climb_no = 4) AS missed, count(*) FILTER (climb_no = 2) AS unverified FROM a GROUP BY ride) SELECT ride, round(w, 4) AS worst_pp, missed, unverified, CASE WHEN missed + unverified > 0 OR coalesce(w, 0) > 2 THEN 'high' WHEN coalesce(w, 0) > 1 THEN 'minor' ELSE 'safe' END AS verdict FROM v")
_short("wall_density", lambda r: metrics.wall_density(_verified(r).where("ride % 3 <> 0"), r.groupBy("ride").agg((F.max("d") / 100).alias("distance_km"))), _SPANS + ", m AS (SELECT ride, sum((t - s) * 300) AS m FROM a WHERE ride % 3 <> 0 GROUP BY ride), q AS (SELECT ride, max(d) / 100 AS km FROM rec GROUP BY ride), z AS (SELECT q.ride, m / greatest(km, 1) AS x FROM q LEFT JOIN m USING (ride)) SELECT ride, round(x, 4) AS density, round(CASE WHEN x IS NOT NULL THEN least(1.3e0, 1 + 0.017e0 * greatest(0, x)) END, 4) AS multiplier FROM z")


def _stretches(r: DataFrame, rows: int, last_m: float | None = None) -> DataFrame:
    """Climbs of so many consecutive rows each, whole or only their last metres: every row counts."""
    g = r.groupBy("ride", (F.floor(F.col("seq") / rows) + 1).cast("int").alias("climb_no")).agg(F.min("d").alias("_s"), F.max("d").alias("_t"), F.max("e").alias("_g"))
    low = F.col("_s") if last_m is None else F.col("_t") - last_m
    return g.select("ride", "climb_no", (low / 1000).alias("start_km"), (F.col("_t") / 1000).alias("end_km"), F.col("_g").alias("max_grade_pct"), F.col("_g").alias("peak_pct"))


_STRETCHES = ", a AS (SELECT ride, (seq // 3 + 1)::INTEGER AS climb_no, min(d) / 1000 AS s, max(d) / 1000 AS t, max(e) AS g FROM rec GROUP BY ride, seq // 3), b AS (SELECT ride, (seq // 10 + 1)::INTEGER AS climb_no, (max(d) - 9e0) / 1000 AS s, max(d) / 1000 AS t, max(e) AS g FROM rec GROUP BY ride, seq // 10)"
# the same operators over every row, where the queries above take spans from some
_short("interval_anti_whole", lambda r: joins.not_overlapping(_stretches(r, 3), _stretches(r, 10, 9.0)).select("ride", "climb_no"), _STRETCHES + ORACLE_SQL["interval_anti"].partition(_SPANS)[2])
_short("cross_validate_whole", lambda r: joins.cross_validate(_stretches(r, 3), _stretches(r, 10, 9.0)), _STRETCHES + ORACLE_SQL["cross_validate"].partition(_SPANS)[2])


def _verified_whole(r: DataFrame) -> DataFrame:
    return _stretches(r, 3).withColumns({"source": F.when(F.col("climb_no") == 4, "missed").otherwise("declared"), "delta_pp": F.when(F.col("climb_no") != 2, (F.col("max_grade_pct") - 100) / 20), "length_above_8": (F.col("end_km") - F.col("start_km")) * 300})


_short("route_verdicts_whole", lambda r: metrics.route_verdicts(_verified_whole(r)), _STRETCHES + ORACLE_SQL["route_verdicts"].partition(_SPANS)[2])
_short("wall_density_whole", lambda r: metrics.wall_density(_verified_whole(r), r.groupBy("ride").agg((F.max("d") / 100).alias("distance_km"))), _STRETCHES + ORACLE_SQL["wall_density"].partition(_SPANS)[2].replace(" WHERE ride % 3 <> 0", "").replace("round(x, 4)", "round(x, 6)").replace(", 4) AS multiplier", ", 6) AS multiplier"), digits=6)
_short("coverage", lambda r: metrics.coverage(r.withColumn("z", F.when(F.col("k") % 4 != 0, F.col("e"))), "z"), " SELECT ride, round(100.0e0 * avg(CASE WHEN k % 4 <> 0 THEN 1 ELSE 0 END), 4) AS coverage_pct FROM rec GROUP BY ride")


def _two(r: DataFrame, n: int, pair: str = "ride * 0 + 1") -> DataFrame:
    half = lambda c: F.bround(c / geo.SEMICIRCLE, 0).cast("long")
    return r.select(F.expr(pair).alias("pair"), F.expr("timestamp_seconds(1600000000 + ride * 1000 + seq)").alias("ts"), "seq", F.when(F.col("k") % 50 != 7 + n, half(F.col("lat") + (n * 1e-5) * (F.col("k") % 40))).alias("position_lat"), half(F.col("lon")).alias("position_long"), F.lit(None).cast("double").alias("enhanced_altitude"), F.col("e").alias("altitude"), F.lit(0.0).alias("enhanced_speed"), (F.col("spd") / 1.5).alias("speed"), F.when(F.col("k") % 5 != 0, F.col("p") + n).alias("power"), F.col("hr").alias("heart_rate"), F.col("d").alias("distance"))


_ALIGN = """, s1 AS (SELECT 1::BIGINT AS pair, make_timestamp((1600000000 + ride * 1000 + seq)::BIGINT * 1000000) AS ts, CASE WHEN k % 50 <> 7 THEN round_even(lat / (180e0 / 2147483648), 0) * (180e0 / 2147483648) END AS lat1, CASE WHEN k % 50 <> 8 THEN round_even((lat + 1e-5 * (k % 40)) / (180e0 / 2147483648), 0) * (180e0 / 2147483648) END AS lat2, round_even(lon / (180e0 / 2147483648), 0) * (180e0 / 2147483648) AS lon, e, spd / 1.5e0 * 3.6e0 AS spd, CASE WHEN k % 5 <> 0 THEN p END AS p, hr, d FROM rec), al AS (SELECT * FROM s1 WHERE lat1 IS NOT NULL AND lat2 IS NOT NULL)"""
_short("align_two", lambda r: joins.align_rides(_two(r, 0), _two(r, 1), ["pair"]).select("pair", "ts", "lat1", "lon1", "lat2", "alt1", "spd1", "pwr1", "pwr2", "hr2", "dist2"), _ALIGN + " SELECT pair, ts, round(lat1, 4) AS lat1, round(lon, 4) AS lon1, round(lat2, 4) AS lat2, round(e, 4) AS alt1, round(spd, 4) AS spd1, round(p, 4) AS pwr1, round(p + 1, 4) AS pwr2, hr AS hr2, d AS dist2 FROM al")


def _events(r: DataFrame) -> DataFrame:
    # the ride itself, as its SQL: times of a ride of 1,000 samples and more run into the next one's
    rows = joins.align_rides(_two(r, 0, "ride"), _two(r, 1, "ride"), ["pair"])
    return joins.proximity_events(rows, least_kmh=5.0, most_pct=60.0, least_samples=3)


_PROX = _ALIGN.replace("1::BIGINT AS pair", "ride AS pair") + f""", g AS (SELECT *, {_HAV.format(a='lat1', b='lat2', c='lon', d='lon')} AS im, coalesce(CASE WHEN last_value(d) OVER w > first_value(d) OVER w THEN (last_value(e) OVER w - first_value(e) OVER w) / (last_value(d) OVER w - first_value(d) OVER w) * 100 END, 0) AS gp, row_number() OVER (PARTITION BY pair ORDER BY ts) AS i FROM al WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)),
  o AS (SELECT *, im <= 50 AND spd >= 5 AND gp <= 60 AS ok FROM g), q AS (SELECT *, i - row_number() OVER (PARTITION BY pair, ok ORDER BY ts) AS z FROM o),
  ev_ AS (SELECT pair, count(*) AS samples, min(i) AS f, min(ts) AS start_ts, max(ts) AS end_ts, min_by(d, ts) / 1000 AS km_start, avg(im) AS avg_inter_m, max(im) - min(im) AS spread_m, avg(gp) AS avg_grade_pct, coalesce(avg(p), 0) AS avg_pwr_r1, coalesce(max(p + 1), 0) AS max_pwr_r2, coalesce(avg(hr), 0) AS avg_hr_r1 FROM q WHERE ok GROUP BY pair, z HAVING count(*) >= 3)"""
_short("proximity", lambda r: _events(r).select("pair", "samples", "start_ts", "end_ts", "km_start", "avg_inter_m", "avg_grade_pct", "avg_pwr_r1", "max_pwr_r2", "avg_hr_r1"), _PROX + " SELECT pair, samples, start_ts, end_ts, round(km_start, 4) AS km_start, round(avg_inter_m, 4) AS avg_inter_m, round(avg_grade_pct, 4) AS avg_grade_pct, round(avg_pwr_r1, 4) AS avg_pwr_r1, round(max_pwr_r2, 4) AS max_pwr_r2, round(avg_hr_r1, 4) AS avg_hr_r1 FROM ev_")
_short("chase", lambda r: joins.chase_episodes(_events(r)).where("rank <= 3").select("pair", "rank", "start_ts", "score"), _PROX + " SELECT pair, rank, start_ts, round(score, 4) AS score FROM (SELECT pair, start_ts, samples * 0.5e0 + spread_m AS score, row_number() OVER (PARTITION BY pair ORDER BY samples * 0.5e0 + spread_m DESC, f)::INTEGER AS rank FROM ev_) WHERE rank <= 3")
# every episode, where chase gives the first three of a pair
_short("chase_episodes", lambda r: joins.chase_episodes(_events(r)).select("pair", "rank", "start_ts", "score"), _PROX + " SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY samples * 0.5e0 + spread_m DESC, f)::INTEGER AS rank, start_ts, round(samples * 0.5e0 + spread_m, 4) AS score FROM ev_")


def _devices(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.alias("pair"), F.when((k + n) % 9 == 0, "run").otherwise("ride").alias("sport"), F.expr(f"o_orderdate + make_interval(0, 0, 0, 0, 0, (o_orderkey % 50) * {n}, 0)").alias("start_time"), (10.0 + (k % 40) + n * (k % 3)).alias("distance_km"), ((k % (4 + n)) * 10.0).alias("ascent_m"), (k % (3 + n) == 0).alias("ascent_stored"), ((k % 60) * 1.0 * n).alias("auto_pause_s"), (k % (2 + n) == 0).alias("has_hr"), (k % (5 - n) == 0).alias("has_power"), (100.0 + k % 50 + n).alias("avg_hr"), (150.0 + k % 70 + n).alias("avg_w"))


def _dev_sql(n: int) -> str:
    return f"SELECT o_orderkey AS pair, CASE WHEN (o_orderkey + {n}) % 9 = 0 THEN 'run' ELSE 'ride' END AS sport, (o_orderkey % 50) * {n} AS mins, 10e0 + o_orderkey % 40 + {n} * (o_orderkey % 3) AS km, (o_orderkey % {4 + n}) * 10e0 AS asc_, o_orderkey % {3 + n} = 0 AS st, (o_orderkey % 60) * {n} AS ap, o_orderkey % {2 + n} = 0 AS hh, o_orderkey % {5 - n} = 0 AS hp, 100e0 + o_orderkey % 50 + {n} AS hr, 150e0 + o_orderkey % 70 + {n} AS w FROM orders"


_register("merge_devices", lambda s, d: joins.merge_devices(_devices(s, d, 0), _devices(s, d, 1)), f"""WITH a AS ({_dev_sql(0)}), b AS ({_dev_sql(1)}), j AS (SELECT a.pair, CASE WHEN (CASE WHEN b.asc_ > 0 AND b.st THEN 2 ELSE 0 END + CASE WHEN b.ap > 30 THEN 1 ELSE 0 END) > (CASE WHEN a.asc_ > 0 AND a.st THEN 2 ELSE 0 END + CASE WHEN a.ap > 30 THEN 1 ELSE 0 END) THEN 'B' ELSE 'A' END AS t, a, b FROM a JOIN b ON a.pair = b.pair),
  k AS (SELECT *, CASE WHEN t = 'A' THEN CASE WHEN a.hh THEN 'A' WHEN b.hh THEN 'B' END ELSE CASE WHEN b.hh THEN 'B' WHEN a.hh THEN 'A' END END AS h, CASE WHEN t = 'A' THEN CASE WHEN a.hp THEN 'A' WHEN b.hp THEN 'B' END ELSE CASE WHEN b.hp THEN 'B' WHEN a.hp THEN 'A' END END AS p FROM j)
  SELECT pair, t AS terrain, h AS hr_source, p AS power_source, CASE WHEN t = 'A' THEN a.km ELSE b.km END AS distance_km, CASE WHEN t = 'A' THEN a.asc_ ELSE b.asc_ END AS ascent_m, CASE h WHEN 'A' THEN a.hr WHEN 'B' THEN b.hr END AS avg_hr, CASE p WHEN 'A' THEN a.w WHEN 'B' THEN b.w END AS avg_w,
  array_to_string(list_filter([CASE WHEN a.sport <> b.sport THEN 'sport' END, CASE WHEN b.mins > 30 THEN 'start' END, CASE WHEN abs(a.km - b.km) / greatest(a.km, b.km) * 100 > 5 THEN 'distance' END], lambda x: x IS NOT NULL), ',') AS warnings FROM k""")

_NAMES = ["Town start", "The Red Bar", "Water tap", "Fuel stop", "Castle", "Check this", "Village pub", "Food shop", "nothing"]


def _places(r: DataFrame) -> DataFrame:
    at = F.col("seq") % 9
    return r.where("seq % 4 = 0").select("ride", (F.col("seq") / 4 + 1).cast("int").alias("idx"), (F.col("lat") + 0.0001).alias("lat"), "lon", F.element_at(F.array(*map(F.lit, _NAMES)), (at + 1).cast("int")).alias("name"), F.when(at == 8, "Summit").otherwise("").alias("sym"))


def _every_place(r: DataFrame) -> DataFrame:
    """A place at every row, for queries without SQL."""
    at = F.col("seq") % 9
    return r.select("ride", (F.col("seq") + 1).cast("int").alias("idx"), (F.col("lat") + 0.0001).alias("lat"), "lon", F.element_at(F.array(*map(F.lit, _NAMES)), (at + 1).cast("int")).alias("name"), F.when(at == 8, "Summit").otherwise("").alias("sym"))


def _routed(r: DataFrame) -> DataFrame:
    return windows.track_distance(r)


_NEAR = f""", s AS (SELECT ride, seq, lat, lon, coalesce({_HAV.format(a='lag(lat) OVER w', b='lat', c='lag(lon) OVER w', d='lon')}, 0) AS x FROM rec WINDOW w AS (PARTITION BY ride ORDER BY seq)), c AS (SELECT *, sum(x) OVER (PARTITION BY ride ORDER BY seq) AS cm FROM s),
  pl AS (SELECT ride, (seq // 4 + 1)::INTEGER AS idx, lat + 0.0001e0 AS la, lon AS lo, {_NAMES}[seq % 9 + 1] AS name, CASE WHEN seq % 9 = 8 THEN 'Summit' ELSE '' END AS sym FROM rec WHERE seq % 4 = 0),
  nr AS (SELECT pl.ride, idx, name, sym, la, lo, c.lat, c.lon, cm, row_number() OVER (PARTITION BY pl.ride, idx ORDER BY pow(c.lat - la, 2) + pow((c.lon - lo) * cos(radians(la)), 2), seq) AS n FROM pl JOIN c USING (ride)),
  ne AS (SELECT ride, idx, name, sym, cm / 1000 AS km, {_HAV.format(a='lat', b='la', c='lon', d='lo')} AS off_m FROM nr WHERE n = 1)"""
_short("nearest_point", lambda r: joins.nearest_on_route(_places(r), _routed(r)), _NEAR + " SELECT ride, idx, round(km, 4) AS km, round(off_m, 4) AS off_m FROM ne")
_CLASS = ", cl AS (SELECT *, CASE WHEN upper(name) LIKE '%TO BE CHECKED%' OR upper(name) LIKE 'CHECK %' OR name LIKE '%?%' THEN NULL WHEN km < 0.5 AND upper(name) LIKE '%START%' THEN 'Start' WHEN upper(name) LIKE '%PUB%' OR upper(name) LIKE '%BAR%' THEN 'Pub' WHEN upper(name) LIKE '%WATER%' THEN 'Water' WHEN upper(name) LIKE '%FUEL%' OR upper(name) LIKE '%FOOD%' THEN 'Fuel' WHEN lower(sym) = 'summit' OR upper(name) LIKE '%CASTLE%' THEN 'POI' END AS cat FROM ne)"
_short("waypoint_classify", lambda r: _places(r).join(joins.nearest_on_route(_places(r), _routed(r)), ["ride", "idx"]).select("ride", "idx", waypoints.classify(F.col("name"), F.col("sym"), F.col("km"))["cat"].alias("cat")), _NEAR + _CLASS + " SELECT ride, idx, cat FROM cl")
_NEAR_WHOLE = _NEAR.replace("(seq // 4 + 1)", "(seq + 1)").replace(" FROM rec WHERE seq % 4 = 0)", " FROM rec)")
_short("nearest_point_whole", lambda r: joins.nearest_on_route(_every_place(r), _routed(r)), _NEAR_WHOLE + " SELECT ride, idx, round(km, 4) AS km, round(off_m, 4) AS off_m FROM ne")
_short("waypoint_classify_whole", lambda r: _every_place(r).join(joins.nearest_on_route(_every_place(r), _routed(r)), ["ride", "idx"]).select("ride", "idx", waypoints.classify(F.col("name"), F.col("sym"), F.col("km"))["cat"].alias("cat")), _NEAR_WHOLE + _CLASS + " SELECT ride, idx, cat FROM cl")
_short("waypoint_decisions", lambda r: waypoints.enumerate_waypoints(_every_place(r), _routed(r), within_m=30.0, pub_km=0.05).select("ride", "idx", "cat", "disp", "decision", "reason"), _NEAR_WHOLE + _CLASS + """, it AS (SELECT ride, idx, name, km, cat, CASE WHEN cat IN ('Water', 'Fuel') THEN cat WHEN cat IS NOT NULL THEN name END AS disp FROM cl),
  o AS (SELECT *, row_number() OVER (PARTITION BY ride, cat ORDER BY idx) AS n FROM it WHERE cat IS NOT NULL),
  fo AS (SELECT ride, cat, n, idx AS li, km AS lk, disp AS ld, NULL::INTEGER AS gone, NULL::INTEGER AS dup FROM o WHERE n = 1 UNION ALL
    SELECT o.ride, o.cat, o.n, CASE WHEN x.near AND NOT x.shorter THEN li ELSE o.idx END, CASE WHEN x.near AND NOT x.shorter THEN lk ELSE o.km END, CASE WHEN x.near AND NOT x.shorter THEN ld ELSE o.disp END, CASE WHEN x.shorter THEN li WHEN x.near THEN o.idx END, CASE WHEN x.shorter THEN o.idx WHEN x.near THEN li END
    FROM fo JOIN o ON o.ride = fo.ride AND o.cat = fo.cat AND o.n = fo.n + 1, LATERAL (SELECT abs(o.km - lk) * 1000 < 30 AS near, abs(o.km - lk) * 1000 < 30 AND length(o.disp) < length(ld) AS shorter) x),
  dd AS (SELECT it.*, fo.dup, ot.disp AS od FROM it LEFT JOIN fo ON fo.ride = it.ride AND fo.gone = it.idx LEFT JOIN it ot ON ot.ride = it.ride AND ot.idx = fo.dup),
  pu AS (SELECT a.ride, a.idx, min(b.idx) AS pub FROM dd a JOIN dd b ON a.ride = b.ride AND a.cat = 'Fuel' AND a.dup IS NULL AND b.cat = 'Pub' AND b.dup IS NULL AND abs(a.km - b.km) <= 0.05e0 GROUP BY 1, 2),
  rs AS (SELECT dd.*, CASE WHEN cat IS NULL THEN 'unrecognised / route-flag' WHEN dup IS NOT NULL THEN printf('duplicate of #%d (%s)', dup, od) WHEN pub IS NOT NULL THEN printf('within 0 km of Pub #%d', pub) END AS reason FROM dd LEFT JOIN pu ON pu.ride = dd.ride AND pu.idx = dd.idx)
  SELECT ride, idx, coalesce(cat, '?') AS cat, coalesce(disp, name, '?') AS disp, CASE WHEN reason IS NULL THEN 'KEEP' ELSE 'DROP' END AS decision, coalesce(reason, '') AS reason FROM rs""", with_="WITH RECURSIVE")

# -- rasters ----------------------------------------------------------------------------------------


def _tiles(spark: SparkSession) -> DataFrame:
    """Two overlapping tiles of 400 x 400 pixels of 0.0005 degrees; every 97th pixel of the first is a hole."""
    cells = F.sequence(F.lit(0), F.lit(400 * 400 - 1))
    first = F.transform(cells, lambda i: F.when(i % 97 != 0, 100 + (F.floor(i / 400) + i % 400 * 2) / 10).cast("float"))
    second = F.transform(cells, lambda i: (50 + (i % 400) / 4).cast("float"))
    at = spark.range(2).select(F.concat(F.lit("tile"), "id").alias("tile_id"), (F.col("id") + 1).cast("int").alias("path_rank"), (0.45 + F.col("id") * 0.1).alias("x0"), (51.15 - F.col("id") * 0.1).alias("y0"), F.lit(0.0005).alias("px"), F.lit(0.0005).alias("py"), F.lit(400).alias("h"), F.lit(400).alias("w"), F.when(F.col("id") == 0, first).otherwise(second).alias("data"))
    return at


_BIL = """, tl AS (SELECT * FROM (VALUES (1, 0.45e0, 51.15e0), (2, 0.45e0 + 0.1e0, 51.15e0 - 0.1e0)) t(rank, x0, y0)),
 h AS (SELECT ride, seq, rank, (y0 - lat) / 0.0005e0 - 0.5 AS r, (lon - x0) / 0.0005e0 - 0.5 AS c FROM rec JOIN tl ON lon BETWEEN x0 AND x0 + 400 * 0.0005e0 AND lat BETWEEN y0 - 400 * 0.0005e0 AND y0),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ride, seq ORDER BY rank) AS n FROM h) WHERE n = 1),
 e4 AS (SELECT *, floor(r) < 0 OR floor(c) < 0 OR floor(r) + 1 >= 400 OR floor(c) + 1 >= 400 AS edge FROM f),
 p4 AS (SELECT ride, seq, rank, r, c, edge, dr, dc, CASE WHEN edge THEN greatest(0, least(399, floor(r))) ELSE floor(r) + dr END::BIGINT AS i, CASE WHEN edge THEN greatest(0, least(399, floor(c))) ELSE floor(c) + dc END::BIGINT AS j FROM e4, (SELECT unnest([0, 0, 1, 1]) AS dr, unnest([0, 1, 0, 1]) AS dc)),
 v AS (SELECT *, CASE WHEN rank = 1 THEN CASE WHEN (i * 400 + j) % 97 <> 0 THEN (100 + (i + j * 2) / 10e0)::FLOAT::DOUBLE END ELSE (50 + j / 4e0)::FLOAT::DOUBLE END AS z FROM p4),
 s AS (SELECT ride, seq, CASE WHEN bool_or(edge) THEN any_value(z) WHEN count(z) = 4 THEN sum(z * CASE WHEN dr = 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END * CASE WHEN dc = 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) ELSE avg(z) END AS z FROM v GROUP BY ride, seq)"""
_short("bilinear", lambda r: verify.sample_tiles(r.select("ride", "seq", "lat", "lon"), _tiles(r.sparkSession)).select("ride", "seq", "z"), _BIL + " SELECT rec.ride, rec.seq, round(z, 4) AS z FROM rec LEFT JOIN s ON s.ride = rec.ride AND s.seq = rec.seq")

_short("grid_tiles", lambda r: verify.grid_tiles(r.groupBy("ride").agg(F.min("lon").alias("min_x"), F.min("lat").alias("min_y"), F.max("lon").alias("max_x"), F.max("lat").alias("max_y")), 0.0025), ", b AS (SELECT ride, floor(min(lon) / 0.0025e0)::BIGINT AS a, floor(max(lon) / 0.0025e0)::BIGINT AS b, floor(min(lat) / 0.0025e0)::BIGINT AS c, floor(max(lat) / 0.0025e0)::BIGINT AS d FROM rec GROUP BY ride), x AS (SELECT ride, unnest(range(a, b + 1)) AS gx, c, d FROM b) SELECT ride, gx, unnest(range(c, d + 1)) AS gy FROM x")
_TRACK = f""", tk AS (SELECT ride, seq, lat, lon, coalesce({_HAV.format(a='lag(lat) OVER w', b='lat', c='lag(lon) OVER w', d='lon')}, 0) AS x FROM rec WINDOW w AS (PARTITION BY ride ORDER BY seq)), cu AS (SELECT *, sum(x) OVER (PARTITION BY ride ORDER BY seq) AS cm FROM tk)"""
_GROUPED = ", gr AS (SELECT ride, (seq // 20 + 1)::INTEGER AS climb_no, min(d) / 1000 AS ks, max(d) / 1000 AS ke, max(e) AS mg FROM rec GROUP BY ride, seq // 20)"


def _span_sql(out: str, rows: str, m: float) -> str:
    """Grade between the samples (cum, z) that lie ``m`` metres or more behind and ahead."""
    at, whole = "{'d': cum, 'e': z}", "PARTITION BY ride ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    return f""", {out}0 AS (SELECT *, coalesce(arg_max({at}, seq) OVER (PARTITION BY ride ORDER BY cum RANGE BETWEEN UNBOUNDED PRECEDING AND {m}::DOUBLE PRECEDING), first({at}) OVER ({whole})) AS a,
    coalesce(arg_min({at}, seq) OVER (PARTITION BY ride ORDER BY -cum RANGE BETWEEN UNBOUNDED PRECEDING AND {m}::DOUBLE PRECEDING), last({at}) OVER ({whole})) AS b FROM {rows}),
  {out} AS (SELECT * EXCLUDE (a, b), CASE WHEN b.d - a.d < 5 THEN 0 ELSE 100 * (b.e - a.e) / (b.d - a.d) END AS g FROM {out}0)"""


def _dense_sql(out: str, rows: str, m: float) -> str:
    """``rows`` (ride, seq, lat, lon) with points between, at most ``m`` metres apart, numbered anew."""
    return f""", {out}w AS (SELECT ride, seq, lat, lon, lead(lat) OVER w AS la, lead(lon) OVER w AS lo FROM {rows} WINDOW w AS (PARTITION BY ride ORDER BY seq)),
  {out}c AS (SELECT *, CASE WHEN la IS NULL THEN 1 ELSE greatest(1, ceil({_HAV.format(a='lat', b='la', c='lon', d='lo')} / {m})) END::BIGINT AS n FROM {out}w),
  {out}n AS (SELECT ride, seq AS q, k, CASE WHEN k = 0 THEN lat ELSE lat + (la - lat) * (k / n::DOUBLE) END AS lat, CASE WHEN k = 0 THEN lon ELSE lon + (lo - lon) * (k / n::DOUBLE) END AS lon FROM (SELECT *, unnest(range(n)) AS k FROM {out}c)),
  {out} AS (SELECT ride, row_number() OVER (PARTITION BY ride ORDER BY q, k) - 1 AS seq, lat, lon FROM {out}n)"""


def _swept_sql(out: str, rows: str, bil: str) -> str:
    """``rows`` every 25 m with cum and z, the raster's elevation."""
    return f"""{_dense_sql("de", rows, 25)}{bil.replace("FROM rec JOIN tl", "FROM de JOIN tl")}, {out}x AS (SELECT de.*, s.z, coalesce({_HAV.format(a='lag(lat) OVER w', b='lat', c='lag(lon) OVER w', d='lon')}, 0) AS x FROM de LEFT JOIN s ON s.ride = de.ride AND s.seq = de.seq WINDOW w AS (PARTITION BY de.ride ORDER BY de.seq)),
  {out} AS (SELECT ride, seq, z, sum(x) OVER (PARTITION BY ride ORDER BY seq) AS cum FROM {out}x)"""


def _fine_sql(bil: str) -> str:
    """Climbs ``gr`` on the track ``cu``: roads every five metres, elevations, grades; a climb is told by ride * 100000 + climb_no."""
    return f""", wp AS (SELECT cu.ride * 100000 + climb_no AS ride, seq, lat, lon FROM cu JOIN gr ON cu.ride = gr.ride AND cm BETWEEN ks * 1000 AND ke * 1000){_dense_sql("pt", "wp", 5)}{bil.replace("FROM rec JOIN tl", "FROM pt JOIN tl")},
  st AS (SELECT pt.*, s.z, coalesce({_HAV.format(a='lag(lat) OVER w', b='lat', c='lag(lon) OVER w', d='lon')}, 0) AS x FROM pt LEFT JOIN s USING (ride, seq) WINDOW w AS (PARTITION BY pt.ride ORDER BY pt.seq)),
  lo AS (SELECT ride, seq, z, sum(x) OVER (PARTITION BY ride ORDER BY seq) AS cum, last(CASE WHEN z IS NOT NULL THEN {{'i': seq, 'z': z}} END IGNORE NULLS) OVER (PARTITION BY ride ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
    first(CASE WHEN z IS NOT NULL THEN {{'i': seq, 'z': z}} END IGNORE NULLS) OVER (PARTITION BY ride ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM st QUALIFY count(*) OVER (PARTITION BY ride) > 1 AND count(z) OVER (PARTITION BY ride) > 0),
  cd AS (SELECT ride, seq, cum, coalesce(z, a.z + (b.z - a.z) * (seq - a.i) / (b.i - a.i)::DOUBLE, a.z, b.z) AS z FROM lo){_span_sql("gg", "cd", 30)},
  ru AS (SELECT *, coalesce(lag(cum) OVER w, cum) AS before, row_number() OVER w - row_number() OVER (PARTITION BY ride, g >= 8 ORDER BY seq) AS isl FROM gg WINDOW w AS (PARTITION BY ride ORDER BY seq)),
  r8 AS (SELECT ride, max(m) AS m FROM (SELECT ride, max(cum) - min(before) AS m FROM ru WHERE g >= 8 GROUP BY ride, isl) GROUP BY ride),
  vf AS (SELECT ride, max(g) AS peak, max(cum) - min(cum) AS len, arg_max(z, seq) - arg_min(z, seq) AS gain FROM gg GROUP BY ride)"""


_short("verify_climbs", lambda r: verify.verify_climbs(_routed(r), _groups(r), _tiles(r.sparkSession)).select("ride", "climb_no", "verified_peak_pct", "verified_m", "verified_gain_m", "length_above_8", "delta_pp"), _TRACK + _GROUPED + _fine_sql(_BIL) + " SELECT gr.ride, climb_no, round(peak, 4) + 0e0 AS verified_peak_pct, round(len, 4) AS verified_m, round(gain, 4) + 0e0 AS verified_gain_m, round(CASE WHEN peak IS NOT NULL THEN coalesce(m, 0) END, 4) AS length_above_8, round(peak - mg, 4) + 0e0 AS delta_pp FROM gr LEFT JOIN vf ON vf.ride = gr.ride * 100000 + climb_no LEFT JOIN r8 ON r8.ride = gr.ride * 100000 + climb_no")


def _steep(spark: SparkSession) -> DataFrame:
    """The tiles of _tiles, twenty times as high."""
    return _tiles(spark).withColumn("data", F.transform("data", lambda z: (z * 20).cast("float")))


# the sweep over the whole route; nothing is declared, so all that the raster shows is missed
# Fixed value: the tiles' pixels, twenty times as high
_STEEP_BIL = _BIL.replace("THEN (100 + (i + j * 2) / 10e0)::FLOAT::DOUBLE", "THEN ((100 + (i + j * 2) / 10e0)::FLOAT * 20::FLOAT)::DOUBLE").replace("ELSE (50 + j / 4e0)::FLOAT::DOUBLE", "ELSE ((50 + j / 4e0)::FLOAT * 20::FLOAT)::DOUBLE")
# rising stretches of the swept routes as climbs
_SWEEP = f""", gr AS (WITH a0 AS (SELECT 1){_swept_sql("cd", "rec", _STEEP_BIL)}{_span_sql("sg", "cd", 100)},
  il AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY ride, g >= 1.5e0 ORDER BY seq) AS isl FROM sg WINDOW w AS (PARTITION BY ride ORDER BY seq)),
  st AS (SELECT ride, min(seq) AS f, min(cum) AS lo, max(cum) AS hi, arg_max(z, seq) - arg_min(z, seq) AS gain, max(g) AS mg FROM il WHERE g >= 1.5e0 GROUP BY ride, isl),
  nb AS (SELECT *, row_number() OVER (PARTITION BY ride ORDER BY f)::INTEGER AS climb_no FROM st)
  SELECT ride, climb_no, lo / 1000 AS ks, hi / 1000 AS ke, mg FROM nb WHERE hi - lo >= 300 AND gain >= 20)"""
_short("missed_climbs", lambda r: verify.missed_climbs(_routed(r), _groups(r).where(F.lit(False)), _steep(r.sparkSession)).select("ride", "climb_no", "start_km", "end_km", "verified_peak_pct", "verified_m", "verified_gain_m"), _TRACK + _SWEEP + _fine_sql(_STEEP_BIL) + " SELECT gr.ride, climb_no, round(ks, 4) AS start_km, round(ke, 4) AS end_km, round(peak, 4) AS verified_peak_pct, round(len, 4) AS verified_m, round(gain, 4) AS verified_gain_m FROM gr LEFT JOIN vf ON vf.ride = gr.ride * 100000 + climb_no")

def _moved(r: DataFrame) -> DataFrame:
    """Rides spread over the tiles: whole inside, across an edge, outside."""
    return r.withColumn("lon", F.col("lon") + F.col("ride") % 5 * 0.12475)


def _hill(places: list[tuple[float, float]]) -> list[float]:
    """Stands for an elevation service."""
    return [lat * 10 + lon * 3 for lat, lon in places]


def _snap(track: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Stands for a map matcher: the road runs a little north, and every point comes twice."""
    return [(lat + 0.0001, lon) for lat, lon in track for _ in range(2)]


_MOVED = ", mv AS (SELECT ride, seq, lat, lon + ride % 5 * 0.12475e0 AS lon, d, e FROM rec)"
_MOVED_BIL = _BIL.replace("FROM rec JOIN tl", "FROM mv JOIN tl")
_PLACE_SQL = "round(mv.lat * 100000)::BIGINT AS y, round(mv.lon * 100000)::BIGINT AS x"
_ASKED = f", mp AS (SELECT mv.ride, mv.seq, {_PLACE_SQL}, s.z AS own FROM mv LEFT JOIN s ON s.ride = mv.ride AND s.seq = mv.seq), qq AS (SELECT DISTINCT y, x FROM mp WHERE own IS NULL ORDER BY y, x LIMIT {external.REQUESTS_A_DAY * external.POINTS_A_REQUEST})"


def _filled(r: DataFrame) -> DataFrame:
    seen = verify.sample_tiles(_moved(r).select("ride", "seq", "lat", "lon"), _tiles(r.sparkSession))
    return external.metered_elevations(seen, _hill, external.elevation_answers(store.shared_path(r.sparkSession, "elevations")), "2026-01-01", pause_s=0.0)


_short("elevation_fallback", lambda r: _filled(r).select("ride", "seq", "z", "asked"), _MOVED + _MOVED_BIL + _ASKED + " SELECT ride, seq, round(coalesce(own, CASE WHEN qq.y IS NOT NULL THEN mp.y / 100000e0 * 10 + mp.x / 100000e0 * 3 END), 6) AS z, own IS NULL AND qq.y IS NOT NULL AS asked FROM mp LEFT JOIN qq ON qq.y = mp.y AND qq.x = mp.x", digits=6)
_short("map_match", lambda r: external.remembered_tracks(r.select("ride", "seq", "lat", "lon"), _snap, external.track_answers(store.shared_path(r.sparkSession, "tracks"))), f""", tk AS (SELECT ride, seq, lat, lon, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY ride) AS n FROM rec WINDOW w AS (PARTITION BY ride ORDER BY seq)),
  pk AS (SELECT * FROM tk WHERE n > 1 AND (n <= {external.TRACK_POINTS} OR list_contains(list_transform(range({external.TRACK_POINTS}), lambda k: round_even(k * (n - 1) / {external.TRACK_POINTS - 1}e0, 0)::BIGINT), i)))
  SELECT ride, row_number() OVER (PARTITION BY ride ORDER BY seq) - 1 AS seq, round(lat + 0.0001e0, 6) AS lat, round(lon, 6) AS lon FROM pk UNION ALL SELECT ride, seq, round(lat, 6), round(lon, 6) FROM tk WHERE n = 1""", digits=6)


def _route(r: DataFrame) -> DataFrame:
    return windows.track_distance(_moved(r))


def _baseline(r: DataFrame) -> DataFrame:
    points = _route(r)
    choices, profile = fidelity.baselines(points, verify.sampled_route(points, _tiles(r.sparkSession), 25.0).withColumn("asked", F.lit(False)))
    return profile.join(choices, "ride").select("ride", "d", "e", "baseline", "coverage_pct")


_MOVED_TRACK = _TRACK.replace("FROM rec WINDOW", "FROM mv WINDOW")
_short("route_baseline", _baseline, _MOVED + _MOVED_TRACK + _swept_sql("sw", "mv", _BIL) + """, ga AS (SELECT *, count(*) OVER (PARTITION BY ride) AS n, count(z) OVER (PARTITION BY ride) AS c, last(CASE WHEN z IS NOT NULL THEN {'i': seq, 'z': z} END IGNORE NULLS) OVER (PARTITION BY ride ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
  first(CASE WHEN z IS NOT NULL THEN {'i': seq, 'z': z} END IGNORE NULLS) OVER (PARTITION BY ride ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM sw),
  ch AS (SELECT ride, 100e0 * max(c) / max(n) AS pct, CASE WHEN 100e0 * max(c) / max(n) >= 80 AND max(c) >= 2 THEN 'raster' ELSE 'route' END AS baseline FROM ga GROUP BY ride),
  pr AS (SELECT ride, cum AS d, coalesce(z, a.z + (b.z - a.z) * (seq - a.i) / (b.i - a.i)::DOUBLE, a.z, b.z) AS e, 'raster' AS baseline FROM ga UNION ALL SELECT cu.ride, cm, mv.e, 'route' FROM cu JOIN mv ON mv.ride = cu.ride AND mv.seq = cu.seq)
  SELECT pr.ride, round(d, 4) AS d, round(e, 4) AS e, pr.baseline, round(pct, 4) AS coverage_pct FROM pr JOIN ch ON ch.ride = pr.ride AND ch.baseline = pr.baseline""")
_short("fidelity_routes", lambda r: fidelity.fidelity(_route(r), _tiles(r.sparkSession), declared=_groups(r))["routes"].select("ride", "coverage_pct", "baseline", "backend", "worst_pp", "missed", "unverified", "verdict"), _MOVED + _MOVED_TRACK + _GROUPED + _fine_sql(_BIL) + f""", rv AS (SELECT gr.ride, max(peak - mg) AS w, count(*) FILTER (peak IS NULL) AS u FROM gr LEFT JOIN vf ON vf.ride = gr.ride * 100000 + climb_no GROUP BY gr.ride),
  co AS (WITH a0 AS (SELECT 1){_swept_sql("sw", "mv", _BIL)} SELECT ride, 100e0 * count(z) / count(*) AS pct, count(z) AS c FROM sw GROUP BY ride)
  SELECT co.ride, round(pct, 4) AS coverage_pct, CASE WHEN pct >= 80 AND c >= 2 THEN 'raster' ELSE 'route' END AS baseline, 'local-dem' || CASE WHEN pct >= 80 AND c >= 2 THEN ' (full-route baseline)' ELSE '' END AS backend, round(w, 4) AS worst_pp, 0::BIGINT AS missed, u AS unverified, CASE WHEN u > 0 OR coalesce(w, 0) > 2 THEN 'high' WHEN coalesce(w, 0) > 1 THEN 'minor' ELSE 'safe' END AS verdict FROM co LEFT JOIN rv USING (ride)""")


def _stitched(r: DataFrame) -> DataFrame:
    seg = _groups(r).select("ride", F.col("climb_no").alias("segment"), (F.col("start_km") * 1000).alias("start_m"), (F.col("end_km") * 1000).alias("end_m"))
    fine = windows.onto_grid(r, "d", ["e"], 5.0).select("ride", F.col("x").alias("d"), (F.col("e") + 3).alias("e"))
    fine = fine.join(seg, "ride").where(F.col("d").between(F.col("start_m"), F.col("end_m"))).select("ride", "segment", "d", "e")
    return verify.stitch(r.select("ride", "d", "e"), fine, seg)


def _at_sql(out: str, places: str, rows: str, keys: str) -> str:
    """``places`` (keys, d, ...) with v, the value of ``rows`` (keys, d, e) there."""
    on = lambda t: " AND ".join(f"q.{k} = {t}.{k}" for k in keys.split(", "))
    return f""", {out}a AS (SELECT q.*, a.d AS ad, a.e AS ae FROM {places} q ASOF LEFT JOIN {rows} a ON {on('a')} AND q.d >= a.d), {out}b AS (SELECT q.*, b.d AS bd, b.e AS be FROM {out}a q ASOF LEFT JOIN {rows} b ON {on('b')} AND q.d <= b.d),
  {out} AS (SELECT * EXCLUDE (ad, ae, bd, be), CASE WHEN ad IS NULL THEN be WHEN bd IS NULL OR bd = ad THEN ae ELSE ae + (be - ae) * (d - ad) / (bd - ad) END AS v FROM {out}b)"""


_STITCH = f""", sg AS (SELECT ride, (seq // 20 + 1)::INTEGER AS segment, min(d) / 1000 * 1000 AS lo, max(d) / 1000 * 1000 AS hi FROM rec GROUP BY ride, seq // 20), ro AS (SELECT ride, d, e FROM rec),
  gd AS (SELECT ride, a + unnest(range(0, ceil((b - a) / 5)::BIGINT)) * 5e0 AS d FROM (SELECT ride, min(d) AS a, max(d) AS b FROM rec GROUP BY ride)){_at_sql("gv", "gd", "ro", "ride")},
  fv AS (SELECT gv.ride, segment, d, v + 3 AS e FROM gv JOIN sg ON sg.ride = gv.ride AND d BETWEEN lo AND hi),
  ed AS (SELECT ride, segment, FALSE AS lst, lo AS d FROM sg UNION ALL SELECT ride, segment, TRUE, hi FROM sg){_at_sql("ef", "ed", "fv", "ride, segment")}{_at_sql("er", "(SELECT ride, segment, lst, d, v AS fe FROM ef)", "ro", "ride")},
  ss AS (SELECT ride, segment, max(d) FILTER (NOT lst) AS lo, max(d) FILTER (lst) AS hi, max(fe - v) FILTER (NOT lst) AS h0, max(fe - v) FILTER (lst) AS h1 FROM er WHERE fe IS NOT NULL GROUP BY 1, 2),
  nr AS (SELECT ro.ride, d, bool_or(d BETWEEN lo AND hi) AS inn, sum(CASE WHEN d < lo THEN (d - (lo - 75)) / 75 * h0 WHEN d > hi THEN (hi + 75 - d) / 75 * h1 END) AS ad, max(CASE WHEN d < lo THEN (d - (lo - 75)) / 75 WHEN d > hi THEN (hi + 75 - d) / 75 END) AS w FROM ro JOIN ss ON ss.ride = ro.ride AND d BETWEEN lo - 75 AND hi + 75 GROUP BY 1, 2)
  SELECT ro.ride, ro.d, round(e + coalesce(ad, 0), 4) AS e, round(coalesce(w, 0), 4) AS w FROM ro LEFT JOIN nr ON nr.ride = ro.ride AND nr.d = ro.d WHERE NOT coalesce(inn, FALSE) UNION ALL SELECT ride, d, round(e, 4), 1e0 FROM fv"""
_short("stitch", _stitched, _STITCH)


# -- choices, names and places ----------------------------------------------------------------------

#: Departments and their boxes of longitude and latitude.
DEPARTMENTS = [
    ("D075", 2.22, 48.81, 2.47, 48.91), ("D077", 2.40, 48.10, 3.55, 49.13), ("D078", 1.45, 48.65, 2.20, 49.10), ("D091", 1.93, 48.30, 2.59, 48.78),
    ("D092", 2.07, 48.79, 2.34, 48.95), ("D093", 2.30, 48.81, 2.65, 48.97), ("D094", 2.31, 48.68, 2.62, 48.85), ("D095", 1.94, 48.92, 2.61, 49.24),
]


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = 1.5 + (F.col("p_partkey") % 40) / 20, 48.0 + (F.col("p_partkey") % 33) / 25
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ride"), x.alias("min_lon"), y.alias("min_lat"), (x + F.col("p_size") / 500).alias("max_lon"), (y + F.col("p_size") / 500).alias("max_lat"))


_BOX = "b AS (SELECT p_partkey AS ride, 1.5e0 + (p_partkey % 40) / 20e0 AS x, 48e0 + (p_partkey % 33) / 25e0 AS y, p_size / 500e0 AS s FROM part)"
_register("regions", lambda s, d: joins.regions_of(_boxes(s, d), s.createDataFrame(DEPARTMENTS, "region string, min_lon double, min_lat double, max_lon double, max_lat double")), f"WITH {_BOX}, r AS (SELECT * FROM (VALUES {_values(DEPARTMENTS)}) t(region, a, c, e, f)) SELECT ride, region FROM b JOIN r ON NOT (x + s < a OR e < x OR y + s < c OR f < y)")
_register("os_tiles", lambda s, d: verify.os_tiles(read(s, d, "part").select(F.col("p_partkey").alias("ride"), (F.col("p_partkey") * 137 % 600_000).alias("min_x"), (F.col("p_partkey") * 211 % 900_000).alias("min_y")).withColumns({"max_x": F.col("min_x") + 9_000, "max_y": F.col("min_y") + 12_000})), """WITH b AS (SELECT p_partkey AS ride, p_partkey * 137 % 600000 AS x, p_partkey * 211 % 900000 AS y FROM part), c AS (SELECT ride, unnest(range(x // 10000, (x + 9000) // 10000 + 1)) AS gx, y FROM b), g AS (SELECT ride, gx, unnest(range(y // 10000, (y + 12000) // 10000 + 1)) AS gy FROM c),
  l AS (SELECT ride, gx // 10 AS e, gy // 10 AS n, gx % 10 AS i, gy % 10 AS j FROM g) SELECT DISTINCT ride, substr('ABCDEFGHJKLMNOPQRSTUVWXYZ', (19 - n - (19 - n) % 5 + (e + 10) // 5 + 1)::BIGINT, 1) || substr('ABCDEFGHJKLMNOPQRSTUVWXYZ', ((19 - n) * 5 % 25 + e % 5 + 1)::BIGINT, 1) || i || j AS label FROM l""")


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda m, v: F.when(k % m == 0, v)
    return read(spark, sf_dir, "part").select(k.alias("ride"), F.concat(F.lit("rides/2026-03-01_"), k, F.when(k % 4 == 0, F.lit("_Commute Home #2.gpx")).otherwise(F.lit("_Lost Lane  East & West.gpx"))).alias("file"), pick(7, "flagged").alias("flag_bike"), pick(5, "roadie").alias("power_bike"), F.lit("ebike").alias("commute_bike"), F.lit("tourer").alias("default_bike"), (k % 2 == 0).alias("has_power"), (k % 3).alias("rider"), (k % 11).alias("day"))


_register("resolve_bike", lambda s, d: joins.resolve_bike(_choices(s, d)), "SELECT p_partkey AS ride, CASE WHEN p_partkey % 7 = 0 THEN 'flagged' WHEN p_partkey % 5 = 0 THEN 'roadie' WHEN p_partkey % 4 = 0 THEN 'ebike' ELSE 'tourer' END AS bike, CASE WHEN p_partkey % 7 = 0 THEN 'flag' WHEN p_partkey % 5 = 0 THEN 'power' WHEN p_partkey % 4 = 0 THEN 'filename' ELSE 'default' END AS source FROM part")
_register("bike_by_power", lambda s, d: joins.bike_by_power(s.createDataFrame([("roadie", True), ("ebike", False), ("old", False)], "slug string, has_power_meter boolean"), _choices(s, d)), "SELECT p_partkey AS ride, CASE WHEN p_partkey % 2 = 0 THEN 'roadie' END AS bike FROM part")
_register("same_day_file", lambda s, d: joins.same_day_file(_choices(s, d), _choices(s, d).where("day < 6").select("rider", "day", F.col("file").alias("path"))), "WITH x AS (SELECT p_partkey AS ride, p_partkey % 3 AS rider, p_partkey % 11 AS day, 'rides/2026-03-01_' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '_Commute Home #2.gpx' ELSE '_Lost Lane  East & West.gpx' END AS f FROM part), a AS (SELECT rider, max(f) AS f FROM x WHERE day < 6 GROUP BY 1), b AS (SELECT rider, day, max(f) AS f FROM x WHERE day < 6 GROUP BY 1, 2) SELECT x.ride, coalesce(b.f, a.f) AS path FROM x LEFT JOIN a USING (rider) LEFT JOIN b ON b.rider = x.rider AND b.day = x.day")
_register("file_names", lambda s, d: _choices(s, d).select("ride", text.route_slug(F.col("file")).alias("slug"), text.date_prefix(F.col("file")).cast("string").alias("day")), "SELECT p_partkey AS ride, CASE WHEN p_partkey % 4 = 0 THEN 'commute-home-2' ELSE 'lost-lane-east' END AS slug, '2026-03-01' AS day FROM part")
_short("track_key", lambda r: r.groupBy("ride").agg(text.track_key(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.floor(F.col("lat") * 1e5).alias("lat"), F.floor(F.col("lon") * 1e5).alias("lon")))), lambda p: F.struct(p["lat"].cast("double").alias("lat"), p["lon"].cast("double").alias("lon")))).alias("key")), " SELECT ride, substr(sha256('[' || string_agg('[' || floor(lat * 1e5)::BIGINT || '.000000, ' || floor(lon * 1e5)::BIGINT || '.000000]', ', ' ORDER BY seq) || ']'), 1, 16) AS key FROM rec GROUP BY ride")
_short("interval_laps", lambda r: metrics.interval_laps(r.select("ride", F.col("p").alias("avg_power")), 60.0), " SELECT ride, count(*) FILTER (p > 57.0e0) AS intervals FROM rec GROUP BY ride")
_short("grade_chunks", lambda r: reports.grade_chunks(r, 50.0), """, c AS (SELECT ride, floor(d / 50)::BIGINT AS chunk, min(d) AS s, max(d) AS t, min_by(e, seq) AS a, max_by(e, seq) AS b FROM rec GROUP BY 1, 2), g AS (SELECT ride, chunk, s, CASE WHEN t > s THEN (b - a) / (t - s) * 100 ELSE 0 END AS g FROM c)
  SELECT ride, chunk, s AS start_m, round(g, 4) AS grade, CASE """ + " ".join(f"WHEN abs(g) < {t} THEN '{c}'" for t, c in scoring.RIDE_COLOURS) + f" ELSE '{scoring.RIDE_COLOURS[-1][1]}' END AS colour FROM g")
_short("label_levels", lambda r: waypoints.stagger(r.where("seq % 5 = 0").select("ride", F.col("seq").cast("int").alias("idx"), (F.col("d") / 10).alias("km")), gap_km=3.0), ", l AS (SELECT ride, seq::INTEGER AS idx, d / 10 AS km, CASE WHEN d / 10 - lag(d / 10) OVER w >= 3 OR lag(d) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM rec WHERE seq % 5 = 0 WINDOW w AS (PARTITION BY ride ORDER BY d, seq)), g AS (SELECT *, sum(f) OVER (PARTITION BY ride ORDER BY km, idx) AS g FROM l) SELECT ride, idx, round(km, 4) AS km, (row_number() OVER (PARTITION BY ride, g ORDER BY km, idx) - 1)::INTEGER AS level FROM g")
_short("label_levels_whole", lambda r: waypoints.stagger(r.select("ride", F.col("seq").cast("int").alias("idx"), (F.col("d") / 10).alias("km")), gap_km=0.6), ORACLE_SQL["label_levels"].partition(SHORT_SQL)[2].replace(" WHERE seq % 5 = 0", "").replace(">= 3 OR", ">= 0.6e0 OR"))
_register("assisted_speed", lambda s, d: _parts(s, d).select("id", physics.assisted_speed("watts", "grade", 0.5, 250.0, 25.0).alias("kmh")), f"WITH x AS ({_PARTS}), v AS (SELECT id, {_speed_sql('(watts + least(0.5e0 * watts, 250e0))', 'grade')} AS a, {_speed_sql('watts', 'grade')} AS b FROM x) SELECT id, round(CASE WHEN a > 25 THEN b ELSE a END, 4) AS kmh FROM v")
_register("index_lists", lambda s, d: _parts(s, d).select("id", F.size(waypoints.index_list(F.concat(F.col("id"), F.lit(", "), F.col("id") + 1, F.lit(",")))).alias("n"), F.element_at(waypoints.index_list(F.concat(F.col("id"), F.lit(", "), F.col("id") + 1, F.lit(","))), 2).alias("second")), "SELECT p_partkey AS id, 2 AS n, (p_partkey + 1)::INTEGER AS second FROM part")


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("id"), (44.0 + (k % 700) / 100).alias("lat"), (-6.0 + (k % 900) / 80).alias("lon"))


_PLACES = "p AS (SELECT p_partkey AS id, 44e0 + (p_partkey % 700) / 100e0 AS lat, -6e0 + (p_partkey % 900) / 80e0 AS lon FROM part)"


def _conic_sql() -> str:
    e, n, c, pole = projection.conic_constants()
    q = f"ln(tan(pi() / 4 + radians(lat) / 2)) + {e / 2!r}::DOUBLE * ln((1 - {e!r}::DOUBLE * sin(radians(lat))) / (1 + {e!r}::DOUBLE * sin(radians(lat))))"
    return f"""WITH {_PLACES}, q AS (SELECT id, {c!r}::DOUBLE * exp({-n!r}::DOUBLE * ({q})) AS r, {n!r}::DOUBLE * radians(lon - 3) AS turn FROM p)
  SELECT id, round(700000 + r * sin(turn), 2) AS x, round({pole!r}::DOUBLE - r * cos(turn), 2) AS y FROM q"""


def _british_sql() -> str:
    (a, b), (a2, b2) = projection.WGS84, projection.AIRY
    e2, f2 = 1 - b * b / (a * a), 1 - b2 * b2 / (a2 * a2)
    tx, ty, tz, rx, ry, rz, ppm = projection.OSGB_SHIFT
    rx, ry, rz, k, f0, n = math.radians(rx / 3600), math.radians(ry / 3600), math.radians(rz / 3600), 1 + ppm * 1e-6, 0.9996012717, (a2 - b2) / (a2 + b2)
    d = lambda v: f"({v!r}::DOUBLE)"
    return f"""WITH {_PLACES}, v AS (SELECT id, radians(lat) AS p, radians(lon) AS q, {d(a)} / sqrt(1 - {d(e2)} * pow(sin(radians(lat)), 2)) AS nu FROM p),
  g AS (SELECT id, nu * cos(p) * cos(q) AS x, nu * cos(p) * sin(q) AS y, nu * {d(1 - e2)} * sin(p) AS z FROM v),
  h AS (SELECT id, {d(tx)} + {d(k)} * x - {d(rz)} * y + {d(ry)} * z AS x, {d(ty)} + {d(rz)} * x + {d(k)} * y - {d(rx)} * z AS y, {d(tz)} - {d(ry)} * x + {d(rx)} * y + {d(k)} * z AS z FROM g),
  i AS (SELECT *, sqrt(x * x + y * y) AS r, atan2(z * {d(a2)}, sqrt(x * x + y * y) * {d(b2)}) AS th FROM h),
  j AS (SELECT id, atan2(z + {d(f2 / (1 - f2) * b2)} * pow(sin(th), 3), r - {d(f2 * a2)} * pow(cos(th), 3)) AS p, atan2(y, x) AS q FROM i),
  l AS (SELECT id, p, q - radians(-2) AS l, sin(p) AS s, cos(p) AS c, pow(tan(p), 2) AS t, {d(a2 * f0)} / sqrt(1 - {d(f2)} * pow(sin(p), 2)) AS nu, {d(a2 * f0 * (1 - f2))} / pow(1 - {d(f2)} * pow(sin(p), 2), 1.5) AS rho, p - radians(49) AS dp, p + radians(49) AS sp FROM j),
  m AS (SELECT *, nu / rho - 1 AS eta, {d(b2 * f0)} * ({d(1 + n + 1.25 * n**2 + 1.25 * n**3)} * dp - {d(3 * n + 3 * n**2 + 2.625 * n**3)} * sin(dp) * cos(sp) + {d(1.875 * n**2 + 1.875 * n**3)} * sin(2 * dp) * cos(2 * sp) - {d(35 / 24 * n**3)} * sin(3 * dp) * cos(3 * sp)) AS arc FROM l)
  SELECT id, round(400000 + nu * c * l + nu / 6 * pow(c, 3) * (nu / rho - t) * pow(l, 3) + nu / 120 * pow(c, 5) * (5 - 18 * t + t * t + 14 * eta - 58 * t * eta) * pow(l, 5), 2) AS x,
    round(arc - 100000 + nu / 2 * s * c * pow(l, 2) + nu / 24 * s * pow(c, 3) * (5 - t + 9 * eta) * pow(l, 4) + nu / 720 * s * pow(c, 5) * (61 - 58 * t + t * t) * pow(l, 6), 2) AS y FROM m"""


_grid = lambda epsg: lambda s, d: _positions(s, d).select("id", projection.projected(F.col("lat"), F.col("lon"), epsg).alias("g")).select("id", "g.x", "g.y")
_register("french_grid", _grid(projection.EPSG_LAMBERT_93), _conic_sql(), 2)
_register("french_keys", lambda s, d: sources_tiles.french_keys(_boxes(s, d)), f"""WITH {_BOX}, p AS (SELECT ride AS id, y + s * v AS lat, x + s * u AS lon FROM b, (SELECT unnest([0, 0, 1, 1]) AS u, unnest([0, 1, 0, 1]) AS v)){_conic_sql().replace(f"WITH {_PLACES}", "").replace("round(700000 + r * sin(turn), 2) AS x, round(", "700000 + r * sin(turn) AS x, (").replace("* cos(turn), 2) AS y", "* cos(turn)) AS y").replace("SELECT id,", ", k AS (SELECT id,", 2).replace(", k AS (SELECT id,", "SELECT id,", 1)}),
  m AS (SELECT id, trunc(min(x))::BIGINT // 1000 AS e0, trunc(max(x))::BIGINT // 1000 AS e1, trunc(min(y))::BIGINT // 1000 AS n0, trunc(max(y))::BIGINT // 1000 AS n1 FROM k GROUP BY id), ee AS (SELECT id, unnest(range(e0, e1 + 1))::INTEGER AS e_km, n0, n1 FROM m) SELECT id AS ride, e_km, unnest(range(n0, n1 + 2))::INTEGER AS n_km FROM ee""")
_register("british_grid", _grid(projection.EPSG_OSGB), _british_sql(), 2)


def _tile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    british = F.concat(F.lit("cache/uk/"), F.when(k % 5 == 0, "tq").otherwise("TQ"), k % 90 + 10, F.when(k % 3 == 0, "nw").otherwise(""), F.when(k % 4 == 0, F.lit("_DSM_1m.tif")).otherwise(F.lit("_DTM_1m.TIF")))
    french = F.concat(F.lit("fr/RGEALTI_FXX_"), F.lpad(k % 1000, 4, "0"), F.lit("_"), F.lpad(k % 77 + 6800, 4, "0"), F.lit("_MNT_LAMB93_IGN69.asc"))
    return read(spark, sf_dir, "part").select(F.when(k % 2 == 0, british).otherwise(french).alias("path"))


_FILES = """f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'cache/uk/' || CASE WHEN p_partkey % 5 = 0 THEN 'tq' ELSE 'TQ' END || (p_partkey % 90 + 10) || CASE WHEN p_partkey % 3 = 0 THEN 'nw' ELSE '' END || CASE WHEN p_partkey % 4 = 0 THEN '_DSM_1m.tif' ELSE '_DTM_1m.TIF' END
  ELSE 'fr/RGEALTI_FXX_' || lpad((p_partkey % 1000)::VARCHAR, 4, '0') || '_' || lpad((p_partkey % 77 + 6800)::VARCHAR, 4, '0') || '_MNT_LAMB93_IGN69.asc' END AS path FROM part)"""
_register("british_tiles", lambda s, d: sources_tiles.british_tiles(_tile_files(s, d)), f"WITH {_FILES} SELECT path, CASE WHEN k % 5 <> 0 THEN 'TQ' || (k % 90 + 10) || CASE WHEN k % 3 = 0 THEN 'nw' ELSE '' END END AS subtile, CASE WHEN k % 5 <> 0 THEN 'TQ' || (k % 90 + 10) END AS tile FROM f WHERE k % 2 = 0 AND k % 4 <> 0")
_register("wanted_french_tiles", lambda s, d: sources_tiles.wanted_french_tiles(_tile_files(s, d), read(s, d, "part").select((F.col("p_partkey") % 500).cast("int").alias("e_km"), (F.col("p_partkey") % 77 + 6800).cast("int").alias("n_km"))), f"WITH {_FILES}, w AS (SELECT DISTINCT p_partkey % 500 AS e, p_partkey % 77 + 6800 AS n FROM part) SELECT path, (k % 1000)::INTEGER AS e_km, (k % 77 + 6800)::INTEGER AS n_km FROM f JOIN w ON e = k % 1000 AND n = k % 77 + 6800 WHERE k % 2 = 1")
_register("newest_archives", lambda s, d: sources_tiles.newest_archives(read(s, d, "part").select(F.concat(F.lit("<a>RGEALTI_2-0_1M_ASC_LAMB93-IGN69_D0"), F.col("p_partkey") % 89 + 10, F.lit("_20"), F.col("p_partkey") % 13 + 10, F.lit("-0"), F.col("p_partkey") % 9 + 1, F.lit("-11.7z</a> RGEALTI_2-0_1M_ASC_LAMB93-IGN69_D0"), F.col("p_partkey") % 7 + 10, F.lit("_2001-01-01")).alias("text"))), """WITH a AS (SELECT 'D0' || (p_partkey % 89 + 10) AS dept, '20' || (p_partkey % 13 + 10) || '-0' || (p_partkey % 9 + 1) || '-11' AS day FROM part UNION ALL SELECT 'D0' || (p_partkey % 7 + 10), '2001-01-01' FROM part)
  SELECT dept, 'RGEALTI_2-0_1M_ASC_LAMB93-IGN69_' || dept || '_' || max(day) AS archive FROM a GROUP BY dept""")


def _tile_wants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 997).alias("ride"), F.when(F.col("l_suppkey") % 2 == 0, "uk").otherwise("fr").alias("region"), F.concat(F.lit("T"), F.col("l_partkey") % 40).alias("tile"))


def _tile_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 == 0, "uk").otherwise("fr").alias("region"), F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("T"), F.col("p_partkey") % 23)).alias("tile"))


_STOCK = "h AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'uk' ELSE 'fr' END AS region, 'T' || (p_partkey % 23) AS tile FROM part WHERE p_partkey % 5 <> 0)"
_WANTS = "w AS (SELECT DISTINCT l_orderkey % 997 AS ride, CASE WHEN l_suppkey % 2 = 0 THEN 'uk' ELSE 'fr' END AS region, 'T' || (l_partkey % 40) AS tile FROM lineitem)"
_register("tile_coverage", lambda s, d: sources_tiles.with_coverage(_tile_stock(s, d), _tile_wants(s, d)), f"WITH {_STOCK}, {_WANTS} SELECT region, tile FROM h UNION SELECT region, tile FROM w")
_register("missing_tiles", lambda s, d: sources_tiles.missing_tiles(_tile_wants(s, d), _tile_stock(s, d)).withColumn("missing", F.array_join("missing", ",")), f"WITH {_STOCK}, {_WANTS} SELECT ride, count(*) AS n_missing, string_agg(tile, ',' ORDER BY tile) AS missing, count(*) * 50 AS mb FROM w ANTI JOIN h USING (region, tile) GROUP BY ride")
_register("coverage_policy", lambda s, d: read(s, d, "part").select(F.col("p_partkey").alias("id"), sources_tiles.coverage_policy(F.when(F.col("p_partkey") % 5 == 0, "quit"), F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 2 == 0).alias("policy")), "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'quit' WHEN p_partkey % 3 = 0 THEN 'prompt' WHEN p_partkey % 2 = 0 THEN 'api' ELSE 'skip' END AS policy FROM part")
_BIKES = {"tourer": {"system_weight_kg_default": 95.0, "cda": 0.35, "drivetrain_efficiency": 0.96, "crr_by_surface": {"gravel": 0.009, "tarmac": 0.006}, "gearing": {"chainrings_t": [46, 30], "cassette_t": [11, 34]}}, "roadie": {"system_weight_kg_default": 82.0, "cda": 0.29, "crr_by_surface": {"tarmac": 0.0045}}}
_register("bike_physics", lambda s, d: bikes.bike_physics(read(s, d, "part").select(F.col("p_partkey").alias("ride"), F.when(F.col("p_partkey") % 3 == 0, "tourer").when(F.col("p_partkey") % 3 == 1, "roadie").alias("bike"), F.when(F.col("p_partkey") % 2 == 0, "tarmac").when(F.col("p_partkey") % 5 == 0, "sand").alias("surface")), files.bike_table(s, {"bikes": _BIKES})), """SELECT p_partkey AS ride, CASE p_partkey % 3 WHEN 0 THEN 'tourer' WHEN 1 THEN 'roadie' END AS bike, CASE p_partkey % 3 WHEN 0 THEN 95e0 WHEN 1 THEN 82e0 ELSE 87e0 END AS mass, CASE p_partkey % 3 WHEN 0 THEN 0.35e0 WHEN 1 THEN 0.29e0 ELSE 0.3e0 END AS cda,
  round(CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 0.006e0 ELSE 0.009e0 END WHEN 1 THEN 0.0045e0 ELSE 0.0055e0 END, 4) AS crr, CASE p_partkey % 3 WHEN 0 THEN 0.96e0 ELSE 0.97e0 END AS eta, CASE WHEN p_partkey % 3 = 0 THEN round(30 / 34e0, 4) END AS lowest_ratio FROM part""")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select((k % 200).alias("idx"), k.alias("id"), F.when(k % 3 == 0, "DROP").otherwise("KEEP").alias("decision"), F.when(k % 3 == 0, "unrecognised / route-flag").otherwise("").alias("reason"))


_register("overrides", lambda s, d: waypoints.override(_items(s, d), include=(3, 6, 9, 150), exclude=(4, 9, 33)), """WITH x AS (SELECT p_partkey % 200 AS idx, p_partkey AS id, p_partkey % 3 = 0 AS gone FROM part)
  SELECT idx, id, CASE WHEN idx IN (4, 9, 33) THEN 'DROP' WHEN idx IN (3, 6, 9, 150) THEN 'KEEP' WHEN gone THEN 'DROP' ELSE 'KEEP' END AS decision,
    trim((CASE WHEN gone THEN 'unrecognised / route-flag' ELSE '' END) || CASE WHEN idx IN (3, 6, 9, 150) THEN ' [overridden: --include]' ELSE '' END || CASE WHEN idx IN (4, 9, 33) THEN ' [overridden: --exclude]' ELSE '' END) AS reason FROM x""")
_register("kept_waypoints", lambda s, d: waypoints.kept(waypoints.override(_items(s, d), exclude=(4, 9, 33))), "SELECT p_partkey % 200 AS idx, p_partkey AS id FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 200 NOT IN (4, 9, 33)")
_register("waypoint_lines", lambda s, d: shapes.waypoint_lines(_items(s, d).select("idx", (F.col("id") / 7).alias("km"), "decision", F.lit("Pub").alias("cat"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("The Inn "), "id")).alias("name"), "reason", F.concat(F.lit("Inn "), "id").alias("disp"))), """SELECT p_partkey % 200 AS idx, printf('%2d  %5.1f  %-6s  %-6s  %-32s  %-40s', p_partkey % 200, p_partkey / 7e0, CASE WHEN p_partkey % 3 = 0 THEN '✗ drop' ELSE '✓ keep' END, 'Pub', CASE WHEN p_partkey % 4 = 0 THEN '?' ELSE 'The Inn ' || p_partkey END, CASE WHEN p_partkey % 3 = 0 THEN 'unrecognised / route-flag' ELSE 'shown as: "Inn ' || p_partkey || '"' END) AS line FROM part""")
_register("terrain_load", lambda s, d: climbs.terrain_load(read(s, d, "part").select(F.col("p_partkey").alias("ride"), (F.col("p_partkey") % 50 / 8 + 0.51).alias("hours"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 31 * 0.77 + 0.013).alias("density"))), """WITH a AS (SELECT p_partkey AS ride, p_partkey % 50 / 8e0 + 0.51e0 AS hours, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 31 * 0.77e0 + 0.013e0 END AS density FROM part),
  m AS (SELECT *, coalesce(least(1.3e0, 1 + 0.017e0 * greatest(0, density)), 1e0) AS multiplier FROM a), h AS (SELECT *, CASE WHEN multiplier > 1.001e0 THEN round_even(hours * multiplier, 2) ELSE hours END AS hours_adj, round_even(0.65e0 * multiplier, 2) AS if_lo, round_even(0.75e0 * multiplier, 2) AS if_hi FROM m)
  SELECT ride, hours, round(density, 4) AS density, round(multiplier, 4) AS multiplier, hours_adj, round_even(hours_adj * 0.65e0 * 0.65e0 * 100, 0) AS tss_adj_065, round_even(hours_adj * 0.7e0 * 0.7e0 * 100, 0) AS tss_adj_070, round_even(hours_adj * 0.75e0 * 0.75e0 * 100, 0) AS tss_adj_075, if_lo, if_hi, round_even(hours_adj * if_lo * if_lo * 100, 0) AS tss_adj_lo, round_even(hours_adj * if_hi * if_hi * 100, 0) AS tss_adj_hi FROM h""")
