"""Rides whose times run into the next ride's keep their own episodes."""

import datetime

import duckdb
import pytest

from cadenza.plans import catalog


@pytest.mark.parametrize("query", ["chase", "chase_episodes", "proximity"])
def test_long_rides_stay_apart(spark, tmp_path, query):
    start = datetime.datetime(2024, 1, 1)
    rows = [(ride, ride * 10_000 + i, start + datetime.timedelta(seconds=i), 100.0, f'{{"k": {i * i * 7 % 97 if i // 40 % 2 else 50}}}') for ride, n in ((3, 1100), (4, 200)) for i in range(n)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    columns = "pair, cast(start_ts AS string) AS start_ts, " + ("samples" if query == "proximity" else "rank, score")
    got = catalog.QUERIES[query](spark, str(tmp_path)).selectExpr(*columns.split(", ")).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.execute(f"SELECT {columns.replace('AS string', 'AS varchar')} FROM ({catalog.ORACLE_SQL[query]})").fetchall()
    assert {row[0] for row in want} == {3, 4}
    assert sorted(map(tuple, got)) == sorted(want)
