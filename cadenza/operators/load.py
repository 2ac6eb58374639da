"""Fitness, fatigue and form from daily training stress."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scoring import tsb_state, week_band
from cadenza.operators.windows import Keys

FITNESS_DAYS, FATIGUE_DAYS = 42, 7


def project(daily: DataFrame, by: Keys = ("athlete",), day: str = "day", ctl: str = "ctl_start", atl: str = "atl_start") -> DataFrame:
    """by, day, tss, ctl, atl, tsb, state: two exponential averages and the form with which a day is entered.

    An athlete's days are few, so each athlete's are folded in order in one array: a fold neither overflows nor
    loses digits as the closed form does over long plans.
    """
    kc, ka = 1 - math.exp(-1 / FITNESS_DAYS), 1 - math.exp(-1 / FATIGUE_DAYS)
    days = daily.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(day).alias("day"), F.col("tss").cast("double").alias("tss")))).alias("_d"), F.first(ctl).cast("double").alias("_c"), F.first(atl).cast("double").alias("_a"))
    row = "struct<day:bigint,tss:double,ctl:double,atl:double,tsb:double>"
    start = F.struct(F.array().cast(f"array<{row}>").alias("rows"), F.col("_c").alias("c"), F.col("_a").alias("a"))

    def step(s, x):
        c, a = s["c"] + (x["tss"] - s["c"]) * kc, s["a"] + (x["tss"] - s["a"]) * ka
        new = F.struct(x["day"].cast("long").alias("day"), x["tss"].alias("tss"), c.alias("ctl"), a.alias("atl"), (s["c"] - s["a"]).alias("tsb"))
        return F.struct(F.concat(s["rows"], F.array(new)).alias("rows"), c.alias("c"), a.alias("a"))

    out = days.select(*by, F.explode(F.aggregate("_d", start, step)["rows"]).alias("r")).select(*by, "r.*")
    return out.withColumn("state", tsb_state("tsb"))


def weekly(daily: DataFrame, by: Keys = ("athlete",), day: str = "day") -> DataFrame:
    """by, week, tss, band against 200 to 280 a week."""
    w = daily.groupBy(*by, F.floor(F.col(day) / 7).cast("long").alias("week")).agg(F.sum("tss").alias("tss"))
    return w.withColumn("band", week_band("tss"))


def day_numbers(rides: DataFrame, by: Keys = ("athlete",), ts: str = "ts", tss: str = "tss") -> DataFrame:
    """Daily sums with days numbered from each athlete's first."""
    d = rides.groupBy(*by, F.to_date(ts).alias("date")).agg(F.sum(tss).alias("tss"))
    return d.withColumn("day", F.datediff("date", F.min("date").over(Window.partitionBy(*by))))
