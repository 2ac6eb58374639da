"""Runs: maximal stretches of consecutive rows for which a condition holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.windows import Keys, ordered, row_grade, span_grade


def runs(df: DataFrame, condition: Column, aggregates: Sequence[Column], by: Keys = ("ride",), seq: str = "seq", least: int = 1) -> DataFrame:
    """by, run (numbered from 1), samples and the aggregates of every run of at least ``least`` rows."""
    w = ordered(by, seq)
    d = df.withColumns({"_i": F.row_number().over(w), "_c": F.coalesce(condition, F.lit(False))})
    d = d.withColumn("_g", F.col("_i") - F.row_number().over(Window.partitionBy(*by, "_c").orderBy(seq)))
    out = d.where("_c").groupBy(*by, "_g").agg(F.count(F.lit(1)).alias("samples"), F.min("_i").alias("_first"), *aggregates).where(F.col("samples") >= least)
    return out.withColumn("run", F.row_number().over(Window.partitionBy(*by).orderBy("_first"))).drop("_g", "_first")


def longest_run_above(df: DataFrame, grade: str, d: str, thresholds: Sequence[float], by: Keys = ("ride",), seq: str = "seq") -> DataFrame:
    """by, threshold, metres: the longest stretch at or above each threshold, measured from the sample before it."""
    w = ordered(by, seq)
    marked = df.select(*by, seq, grade, d, F.coalesce(F.lag(d).over(w), F.col(d)).alias("_before"))  # before the rows are multiplied
    marked = marked.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    keyed = [*by, "threshold"]
    found = runs(marked, F.col(grade) >= F.col("threshold"), [(F.max(d) - F.min("_before")).alias("_m")], keyed, seq)
    every = marked.select(*keyed).distinct()
    return every.join(found.groupBy(*keyed).agg(F.max("_m").alias("_m")), keyed, "left").select(*keyed, F.coalesce("_m", F.lit(0.0)).alias("metres"))


def walls(df: DataFrame, grade: str, d: str, threshold: float = 10.0, least_m: float = 30.0, by: Keys = ("ride",), seq: str = "seq") -> DataFrame:
    """by, run, offset_m, length_m, peak_pct, pct_in: stretches at or above the threshold, at least ``least_m`` long."""
    part = Window.partitionBy(*by)
    marked = df.withColumns({"_d0": F.min(d).over(part), "_d1": F.max(d).over(part)})
    found = runs(marked, F.col(grade) >= threshold, [F.min(d).alias("_s"), F.max(d).alias("_e"), F.max(grade).alias("peak_pct"), F.first("_d0").alias("_d0"), F.first("_d1").alias("_d1")], by, seq)
    total = F.col("_d1") - F.col("_d0")
    found = found.withColumns({"offset_m": F.col("_s") - F.col("_d0"), "length_m": F.col("_e") - F.col("_s")}).where(F.col("length_m") >= least_m)
    return found.select(*by, "run", "offset_m", "length_m", "peak_pct", F.when(total > 0, 100.0 * F.col("offset_m") / total).otherwise(F.lit(0.0)).alias("pct_in"))


def flat_segments(df: DataFrame, least_samples: int = 60, most_pct: float = 2.0, by: Keys = ("ride",)) -> DataFrame:
    """by, run, samples, km_start, km_end: level stretches of at least a minute; none for rides below 100 samples."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    g = row_grade(df.withColumn("_n", n).where("_n >= 100"), "d", "e", 25, "_grade", by)
    return runs(g, F.abs("_grade") <= most_pct, [(F.min("d") / 1000).alias("km_start"), (F.max("d") / 1000).alias("km_end")], by, least=least_samples)


def flat_attacks(df: DataFrame, ftp_w: float, percent: float = 120.0, least_samples: int = 15, most_pct: float = 2.0, by: Keys = ("ride",)) -> DataFrame:
    """by, run, samples, km, avg_w, peak_w: surges above ``percent`` of FTP on level road; none without an FTP."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    g = row_grade(df.withColumn("_n", n).where(F.col("_n") >= 100).where(F.lit(ftp_w > 0)), "d", "e", 25, "_grade", by)
    p = F.coalesce(F.col("p"), F.lit(0.0))
    surge = (F.abs("_grade") <= most_pct) & (p > ftp_w * percent / 100.0)
    return runs(g, surge, [(F.min("d") / 1000).alias("km"), F.avg(p).alias("avg_w"), F.max(p).alias("peak_w")], by, least=least_samples)


def rising_stretches(df: DataFrame, d: str = "d", e: str = "e", window_m: float = 100.0, least_pct: float = 1.5, least_m: float = 300.0, least_gain_m: float = 20.0, by: Keys = ("ride",)) -> DataFrame:
    """by, run, start_km, end_km, length_m, gain_m, avg_pct, peak_pct: the coarse sweep for climbs nobody declared."""
    g = span_grade(df, d, e, window_m, "_grade", by)
    found = runs(g, F.col("_grade") >= least_pct, [F.min(d).alias("_s"), F.max(d).alias("_e"), F.min_by(e, "seq").alias("_e0"), F.max_by(e, "seq").alias("_e1"), F.max("_grade").alias("peak_pct")], by)
    found = found.withColumns({"length_m": F.col("_e") - F.col("_s"), "gain_m": F.col("_e1") - F.col("_e0")}).where((F.col("length_m") >= least_m) & (F.col("gain_m") >= least_gain_m))
    return found.select(*by, "run", (F.col("_s") / 1000).alias("start_km"), (F.col("_e") / 1000).alias("end_km"), "length_m", "gain_m", (F.col("gain_m") / F.col("length_m") * 100).alias("avg_pct"), "peak_pct")
