"""Ride tables: what every operator reads, and adapters that make them from the benchmark's tables.

``samples``: ride long, seq long (from 0), ts timestamp, t double (s), d double (m), e double (m), p, hr, cad, spd
doubles (0: no sample), lat, lon doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def short_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ride for each user of ``events``: 1 Hz, three to nine metres a sample."""
    ev = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return ev.select(
        F.col("user_id").alias("ride"),
        (F.row_number().over(w) - 1).cast("long").alias("seq"),
        "ts",
        (F.row_number().over(w) - 1).cast("double").alias("t"),
        F.sum(3 + F.col("k") % 7).over(run).cast("double").alias("d"),
        (100 + 0.2 * F.sum(F.col("k") - 45).over(run)).alias("e"),
        F.col("value").alias("p"),
        F.when(F.col("k") % 11 == 0, 0.0).otherwise(70.0 + F.col("k")).alias("hr"),
        F.when(F.col("k") < 10, 0.0).otherwise(F.col("k").cast("double")).alias("cad"),
        ((3 + F.col("k") % 7) * 3.6).alias("spd"),
        (51.0 + F.sum(F.col("k") - 45).over(run) * 1e-5).alias("lat"),
        (0.5 + F.sum(3 + F.col("k") % 7).over(run) * 1e-5).alias("lon"),
        "k",
    )


SHORT_SQL = """
ev AS (SELECT user_id, ts, event_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
rec AS (SELECT user_id AS ride, row_number() OVER w - 1 AS seq, ts, (row_number() OVER w - 1)::DOUBLE AS t,
  (sum(3 + k % 7) OVER r)::DOUBLE AS d, 100 + 0.2e0 * (sum(k - 45) OVER r)::DOUBLE AS e, value AS p,
  CASE WHEN k % 11 = 0 THEN 0e0 ELSE 70e0 + k END AS hr, CASE WHEN k < 10 THEN 0e0 ELSE k::DOUBLE END AS cad, (3 + k % 7) * 3.6e0 AS spd,
  51e0 + (sum(k - 45) OVER r)::DOUBLE * 1e-5 AS lat, 0.5e0 + (sum(3 + k % 7) OVER r)::DOUBLE * 1e-5 AS lon, k
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


def long_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hilly ride for each supplier of ``lineitem``: hundreds of samples, five to fourteen metres each."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"), "l_discount")
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    base = li.select(
        F.col("l_suppkey").alias("ride"),
        (F.row_number().over(w) - 1).cast("long").alias("seq"),
        F.sum(5 + F.col("q") % 10).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("d"),
        F.col("q").alias("q"),
        F.col("l_discount").alias("x"),
    )
    return base.select("ride", "seq", F.col("seq").cast("double").alias("t"), "d", (200 + 60 * F.sin(F.col("d") / 400) + 10 * F.col("x")).alias("e"), (100.0 + 6 * F.col("q")).alias("p"), (90.0 + F.col("q")).alias("hr"), (40.0 + F.col("q")).alias("cad"), ((5 + F.col("q") % 10) * 3.6).alias("spd"))


LONG_SQL = """
li AS (SELECT l_suppkey AS ride, row_number() OVER w - 1 AS seq, (sum(5 + CAST(l_quantity AS BIGINT) % 10) OVER r)::DOUBLE AS d,
  CAST(l_quantity AS BIGINT) AS q, l_discount AS x FROM lineitem
  WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey),
  r AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rec AS (SELECT ride, seq, seq::DOUBLE AS t, d, 200e0 + 60e0 * sin(d / 400e0) + 10e0 * x AS e, 100e0 + 6 * q AS p, 90e0 + q AS hr, 40e0 + q AS cad, (5 + q % 10) * 3.6e0 AS spd FROM li)
"""
