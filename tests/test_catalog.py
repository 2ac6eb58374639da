"""Every registered query of the ride engine builds, and names the columns of its SQL."""

import duckdb
import pytest

from cadenza.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_builds(spark, duck, name):
    columns = catalog.QUERIES[name](spark, SF_DIR).columns
    assert columns and len(set(columns)) == len(columns)
    if name in catalog.ORACLE_SQL:
        assert sorted(columns) == sorted(duck.sql(catalog.ORACLE_SQL[name]).columns)
