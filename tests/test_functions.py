"""Column functions against numpy and fixed cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import geo, physics, scoring
from cadenza.operators import joins, load, metrics, verify, waypoints


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_speed_solves_the_cubic(spark):
    grid = [(float(p), float(g)) for p in (0, 60, 120, 200, 300, 900) for g in (-12, -5, -1, 0, 3, 6, 9, 16)]
    rows = spark.createDataFrame(grid, "p double, g double").select("p", "g", physics.predict_speed("p", "g").alias("v")).collect()
    for r in rows:
        a, b = 0.5 * 1.225 * 0.30, (0.0055 + np.sin(np.arctan(r.g / 100))) * 87 * 9.81
        roots = [z.real for z in np.roots([a, 0, b, -r.p * 0.97]) if abs(z.imag) < 1e-9 and z.real > 1e-9]
        assert r.v == pytest.approx(min(roots) * 3.6 if roots else 0, abs=1e-4), (r.p, r.g)


def test_power_and_speed_are_inverse(spark):
    rows = spark.createDataFrame([(float(p), float(g)) for p in (120, 200, 300) for g in (-5, 0, 3, 6, 9)], "p double, g double")
    assert all(abs(r.back - r.p) < 1 for r in rows.select("p", physics.predict_power(physics.predict_speed("p", "g"), "g").alias("back")).collect())
    assert one(spark, physics.predict_speed(0, -10, cap_kmh=60)) == 60 and one(spark, physics.predict_speed(F.lit(None).cast("double"), 0)) is None


def test_zones(spark):
    bounds = [("Z1", 0, 99), ("Z3", 100, 180), ("Z4", 170, 190), ("Z5", 184, 200), ("Z8", 201, 400)]
    for watts, zone in ((175, "Z4"), (186, "Z5"), (120, "Z3"), (500, "Z8"), (-10, "Z1")):
        assert one(spark, scoring.zone_for_power(watts, bounds)) == zone


@pytest.mark.parametrize(("worst", "missed", "text"), [(0.5, 0, "safe"), (1.5, 0, "minor"), (3.0, 0, "high"), (0.0, 1, "high")])
def test_verdict(spark, worst, missed, text):
    assert one(spark, scoring.verdict(worst, missed)) == text


def test_multiplier(spark):
    for density, want in ((0, 1.0), (6, 1.102), (12, 1.204), (20, 1.30), (100, 1.30), (-5, 1.0)):
        assert one(spark, scoring.wall_multiplier(density)) == pytest.approx(want)


def test_haversine(spark):
    assert one(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111194.9, abs=1)
    assert one(spark, geo.haversine_m(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0))) is None
    assert one(spark, geo.os_grid_label(F.lit(530000.0), F.lit(180000.0))) == "TQ38"


def test_densify(spark):
    pts = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 0.001)], "ride long, seq long, lat double, lon double")
    got = verify.densify(pts, 5.0).orderBy("seq").collect()
    assert 21 <= len(got) <= 24 and (got[0].lon, got[-1].lon) == (0.0, 0.001)


def test_bilinear(spark):
    tile = spark.createDataFrame([("t", 1, 0.0, 51.0006, 1e-4, 1e-4, 6, 6, [float(10 * r + c) for r in range(6) for c in range(6)])], "tile_id string, path_rank int, x0 double, y0 double, px double, py double, h int, w int, data array<float>")
    at = lambda r, c: (51.0006 - (r + 0.5) * 1e-4, (c + 0.5) * 1e-4)
    cases = [(at(2, 3), 23.0), (at(2.5, 3.5), 28.5), (at(0, 0), 0.0), ((52.0, 0.0), None)]
    pts = spark.createDataFrame([(1, i, *xy) for i, (xy, _) in enumerate(cases)], "ride long, seq long, lat double, lon double")
    for r in verify.sample_tiles(pts, tile).collect():
        want = cases[r.seq][1]
        assert r.z == (None if want is None else pytest.approx(want, abs=1e-4))


def test_stitch(spark):
    d = [float(x) for x in range(0, 1001, 10)]
    route = spark.createDataFrame([("r", x, 10.0) for x in d], "ride string, d double, e double")
    seg = spark.createDataFrame([("r", 1, 400.0, 600.0)], "ride string, segment int, start_m double, end_m double")
    fine = spark.createDataFrame([("r", 1, float(x), 14.0) for x in range(395, 610, 5)], "ride string, segment int, d double, e double")
    got = {r.d: r.e for r in verify.stitch(route, fine, seg).collect()}
    assert got[300.0] == 10 and got[500.0] == 14 and got[700.0] == 10
    line = [got[x] for x in sorted(got)]
    assert max(abs(a - b) for a, b in zip(line, line[1:])) < 1


def test_load(spark):
    days = spark.createDataFrame([("a", i, float(x), 40.0, 45.0) for i, x in enumerate([60, 0, 150, 20])], "athlete string, day int, tss double, ctl_start double, atl_start double")
    c, a = 40.0, 45.0
    for r, x in zip(load.project(days).orderBy("day").collect(), [60, 0, 150, 20]):
        assert r.tsb == pytest.approx(c - a)
        c, a = c + (x - c) * (1 - np.exp(-1 / 42)), a + (x - a) * (1 - np.exp(-1 / 7))
        assert (r.ctl, r.atl) == (pytest.approx(c), pytest.approx(a))


def test_waypoints(spark):
    items = spark.createDataFrame([(1, 1, "Pub", 1.0, "The Old Bar"), (1, 2, "Pub", 1.05, "Bar"), (1, 3, "Pub", 9.0, "Pub"), (1, 4, "Fuel", 9.1, "Fuel")], "ride long, idx int, cat string, km double, disp string")
    got = {r.idx: r.dup_of for r in waypoints.dedupe(items).collect()}
    assert got == {1: 2, 2: None, 3: None, 4: None}
    assert one(spark, waypoints.classify(F.lit("Barn"), F.lit(""), F.lit(3.0))["cat"]) == "Pub"
    assert one(spark, waypoints.classify(F.lit("check it"), F.lit(""), F.lit(3.0))) is None
    assert one(spark, waypoints.index_list(F.lit("1, 4,7"))) == [1, 4, 7]


def test_cross_validation(spark):
    f = spark.createDataFrame([(1, 1, 0.0, 1.0, 5.0), (1, 2, 5.0, 6.0, 5.0)], "ride long, climb_no int, start_km double, end_km double, max_grade_pct double")
    v = spark.createDataFrame([(1, 1, 0.9, 2.0, 7.0), (1, 2, 8.0, 9.0, 7.0)], "ride long, climb_no int, start_km double, end_km double, peak_pct double")
    assert {(r.kind, r.found_no, r.verified_no, r.delta_pp) for r in joins.cross_validate(f, v).collect()} == {("matched", 1, 1, 2.0), ("gap", 2, None, None), ("extra", None, 2, None)}


def test_density_needs_climbs(spark):
    routes = spark.createDataFrame([(1, 30.0), (2, 0.2), (3, 10.0)], "ride long, distance_km double")
    v = spark.createDataFrame([(1, 120.0), (1, 60.0), (2, 50.0)], "ride long, length_above_8 double")
    assert {r.ride: r.density for r in metrics.wall_density(v, routes).collect()} == {1: 6.0, 2: 50.0, 3: None}
