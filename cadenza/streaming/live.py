"""Extension: ride sessions and zone counts over a stream of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(samples: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """user, start, end, samples, avg_w of sessions that a gap ends; state older than ``late`` is given up."""
    w = samples.withWatermark("ts", late).groupBy("user", F.session_window("ts", gap).alias("s"))
    return w.agg(F.count(F.lit(1)).alias("samples"), F.avg("p").alias("avg_w")).select("user", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "samples", "avg_w")


def minute_power(samples: DataFrame, late: str = "10 minutes") -> DataFrame:
    """user, minute, avg_w, max_w by tumbling minutes."""
    w = samples.withWatermark("ts", late).groupBy("user", F.window("ts", "1 minute").alias("m"))
    return w.agg(F.avg("p").alias("avg_w"), F.max("p").alias("max_w")).select("user", F.col("m.start").alias("minute"), "avg_w", "max_w")
