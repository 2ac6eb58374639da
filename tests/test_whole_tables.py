"""Queries without SQL read every row; climbs that only the raster shows are found."""

import pytest
from pyspark.sql import functions as F

from cadenza.operators import verify, windows
from cadenza.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


def test_every_row_is_a_place_and_in_a_climb(spark):
    rides = catalog.short_rides(spark, SF_DIR)
    rows = rides.count()
    assert catalog.QUERIES["waypoint_decisions"](spark, SF_DIR).select("ride", "idx").distinct().count() == rows
    groups = catalog._groups(rides)
    assert catalog.QUERIES["verify_climbs"](spark, SF_DIR).count() == groups.count()
    inside = rides.select("ride", "seq", "d").join(groups, "ride").where((F.col("d") / 1000).between(F.col("start_km"), F.col("end_km"))).select("ride", "seq").distinct()
    assert inside.count() == rows
    assert catalog.QUERIES["stitch"](spark, SF_DIR).where("w = 1").select("ride").distinct().count() > 0


@pytest.mark.parametrize(("declared", "found"), [((90.0, 91.0), 1), ((0.2, 0.4), 0)])
def test_missed_climbs(spark, declared, found):
    """Two kilometres eastwards on a tile that rises by five in a hundred."""
    data = [float(c * 0.05 * 55.6) for _ in range(100) for c in range(100)]
    tile = spark.createDataFrame([("t", 1, 1.0, 0.03, 0.0005, 0.0005, 100, 100, data)], "tile_id string, path_rank int, x0 double, y0 double, px double, py double, h int, w int, data array<float>")
    points = windows.track_distance(spark.createDataFrame([(1, i, 0.01, 1.005 + i * 0.0009) for i in range(20)], "ride long, seq long, lat double, lon double"))
    climbs = spark.createDataFrame([(1, 1, *declared, 5.0)], "ride long, climb_no int, start_km double, end_km double, max_grade_pct double")
    got = verify.missed_climbs(points, climbs, tile).collect()
    assert len(got) == found
    assert all(r.verified_m > 1000 and 4 < r.verified_peak_pct < 6 for r in got)


def test_missed_climbs_is_registered(spark):
    assert catalog.QUERIES["missed_climbs"](spark, SF_DIR).columns == ["ride", "climb_no", "start_km", "end_km", "verified_peak_pct", "verified_m", "verified_gain_m"]
