"""Episodes whose gaps differ in the last digits only have the order of the SQL."""

import datetime

import duckdb
import pytest

from cadenza.plans import catalog

#: A ride with two episodes whose scores are equal in fourteen digits.
K = [16, 45, 45, 22, 10, 7, 53, 67, 5, 17, 50, 90, 24, 6, 54, 66, 46, 20, 11, 84, 66, 86, 3, 93, 62, 84, 79, 73, 81, 67, 9, 69, 43, 81, 43, 92, 62, 53, 30, 70, 98, 92, 75, 63, 50, 34, 72, 18, 73, 78, 22, 14, 40, 53, 68, 23, 95, 31, 56, 22, 89, 65, 9, 31, 95, 83, 90, 27]


def same_as_sql(spark, tmp_path, query):
    start = datetime.datetime(2024, 1, 1)
    rows = [(411, i, start + datetime.timedelta(seconds=i), 100.0, f'{{"k": {k}}}') for i, k in enumerate(K)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES[query](spark, str(tmp_path)).selectExpr("pair", "rank", "cast(start_ts as string) AS start_ts", "score").collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.execute(f"SELECT pair, rank, start_ts::VARCHAR, score FROM ({catalog.ORACLE_SQL[query]})").fetchall()
    assert len(want) > 1 and want[0][1:] != want[1][1:]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("query", ["chase", "chase_episodes"])
def test_equal_scores_rank_as_in_sql(spark, tmp_path, query):
    same_as_sql(spark, tmp_path, query)
