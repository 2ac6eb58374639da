"""Verification of whole routes: services that are metered and remembered, baselines, reports, archives."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import joins, windows
from cadenza.plans import fidelity
from cadenza.sinks import fidelity as documents
from cadenza.sources import archives, binary, external
from cadenza.sources.store import shared_path

POINT = "ride long, seq long, lat double, lon double"


def test_places_are_asked_once_and_within_the_days_requests(spark, tmp_path):
    """Two rides share places; a day has two requests of three places; what was told is not asked again."""
    log = tmp_path / "asked"
    answers = external.elevation_answers(str(tmp_path / "answers"))

    def service(places):
        with log.open("a") as f:
            f.write(json.dumps(places) + "\n")
        return [None if la > 1.00006 else la * 100 for la, _ in places]

    rows = [(r, i, 1.0 + i * 1e-5, 2.0, 7.0 if i == 0 else None) for r in (1, 2) for i in range(10)]
    samples = spark.createDataFrame(rows, POINT + ", z double")
    how = {"batch": 3, "requests": 2, "pause_s": 0.0}
    got = external.metered_elevations(samples, service, answers, "2026-01-01", **how).collect()
    asked = [json.loads(x) for x in log.read_text().splitlines()]
    assert [len(a) for a in asked] == [3, 3] and len({tuple(p) for a in asked for p in a}) == 6
    assert {(r.seq, r.asked) for r in got if r.z is not None} == {(0, False)} | {(i, True) for i in range(1, 7)}
    again = external.metered_elevations(samples, service, answers, "2026-01-01", **how)
    assert again.where("z IS NULL").count() == 6 and len(log.read_text().splitlines()) == 2  # the day's requests are used up
    later = external.metered_elevations(samples, service, answers, "2026-01-02", **how)
    assert later.where("z IS NULL").count() == 6  # the service knows nothing there
    assert len(log.read_text().splitlines()) == 3
    external.metered_elevations(samples, service, answers, "2026-01-03", **how).collect()
    assert len(log.read_text().splitlines()) == 3  # and is not asked again
    assert external.metered_elevations(samples, None, answers, "2026-01-04").where("asked").count() == 12


@pytest.mark.parametrize("bad", [lambda ps: [1.0, 2.0], lambda ps: 1 / 0])
def test_a_service_that_fails_leaves_elevations_open(spark, bad):
    samples = spark.createDataFrame([(1, 0, 1.0, 2.0, None), (1, 1, 1.1, 2.0, 5.0)], POINT + ", z double")
    got = external.metered_elevations(samples, bad, external.elevation_answers(shared_path(spark, "answers")), "2026-01-01", pause_s=0.0)
    assert sorted((r.seq, r.z) for r in got.collect()) == [(0, None), (1, 5.0)]
    assert external.metered_elevations(samples.limit(0), bad, external.elevation_answers(shared_path(spark, "answers")), "2026-01-01").count() == 0


def test_tracks_are_told_by_their_points(spark, tmp_path):
    log = tmp_path / "asked"
    answers = external.track_answers(str(tmp_path / "tracks"))

    def match(track):
        with log.open("a") as f:
            f.write(f"{len(track)}\n")
        if track[0][0] > 5:
            raise OSError("no road")
        return [p for la, lo in track for p in ((la, lo + 1), (la, lo + 1))]

    tracks = {1: 25, 2: 25, 3: 4, 4: 1}
    rows = [(r, i, 1.0 + (r == 3) + i / 100, 2.0) for r, n in tracks.items() for i in range(n)] + [(5, i, 6.0 + i, 2.0) for i in range(3)]
    points = spark.createDataFrame(rows, POINT)
    got = {}
    for r in external.remembered_tracks(points, match, answers).orderBy("ride", "seq").collect():
        got.setdefault(r.ride, []).append((round(r.lat, 4), r.lon))
    assert sorted(map(int, log.read_text().split())) == [3, 4, 10]  # rides 1 and 2 are one track, thinned to ten points
    assert got[1] == got[2] and len(got[1]) == 10 and got[1][0] == (1.0, 3.0) and got[1][-1] == (1.24, 3.0)
    assert len(got[3]) == 4 and got[4] == [(1.0, 2.0)] and got[5] == [(6.0, 2.0), (7.0, 2.0), (8.0, 2.0)]
    external.remembered_tracks(points, match, answers).count()
    assert sorted(map(int, log.read_text().split())) == [3, 3, 4, 10]  # only the failure is asked again


def test_tagged_matches_a_plain_range_join(spark):
    """Spans that touch, overlap, repeat, lie inside others, are empty or of another ride."""
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([(int(r), i, float(x)) for r in (1, 2, 3) for i, x in enumerate(rng.integers(0, 60, 80))], "ride long, seq long, d double")
    ends = [(int(r), k, float(a), float(a + w)) for k, (r, a, w) in enumerate(zip(rng.integers(1, 5, 60), rng.integers(-5, 60, 60), rng.integers(-1, 30, 60)))]
    spans = spark.createDataFrame([*ends, (1, 99, None, 4.0), (1, 98, 5.0, 5.0), (1, 97, 5.0, 5.0)], "ride long, climb long, lo double, hi double")
    got = joins.tagged(points, spans, "d", "lo", "hi", ["ride"], ["climb"]).select("ride", "seq", "climb").collect()
    want = points.join(spans, "ride").where("d BETWEEN lo AND hi").select("ride", "seq", "climb").collect()
    assert len(want) > 500 and sorted(got) == sorted(want)


def test_nearest_point_by_cells(spark):
    rng = np.random.default_rng(4)
    points = [(r, i, float(a), float(b), float(i)) for r in (1, 2) for i, (a, b) in enumerate(rng.uniform(0, 0.02, (300, 2)))] + [(1, 900, None, 1.0, 900.0), (1, 901, *([0.01] * 2), 901.0), (1, 902, *([0.01] * 2), 902.0)]
    places = [(r, i, float(a), float(b)) for r in (1, 2, 3) for i, (a, b) in enumerate(rng.uniform(-0.02, 0.04, (60, 2)))] + [(1, 100, 0.01, 0.01)]
    p, q = spark.createDataFrame(points, POINT + ", cum_m double"), spark.createDataFrame(places, "ride long, idx long, lat double, lon double")
    got = {(r.ride, r.idx): r.km for r in joins.nearest_on_route(q, p).collect()}
    want = {}
    for ride, idx, a, b in places:
        own = [((x - a) ** 2 + ((y - b) * np.cos(np.radians(a))) ** 2, s, m) for r, s, x, y, m in points if r == ride and x is not None]
        if own:
            want[ride, idx] = min(own)[2] / 1000
    assert got == want and got[1, 100] == 0.901


@pytest.fixture(scope="module")
def verified(spark):
    """Two kilometres eastwards up a tile of five in a hundred with a wall; one route leaves the raster, one never meets it."""
    grade = np.full(100, 0.05)
    grade[25:29] = 0.15
    height = np.concatenate([[0], np.cumsum(grade * 55.6)])[:100]
    tile = spark.createDataFrame([("t", 1, 1.0, 0.03, 0.0005, 0.0005, 100, 100, [float(height[c]) for _ in range(100) for c in range(100)])], "tile_id string, path_rank int, x0 double, y0 double, px double, py double, h int, w int, data array<float>")
    rows = [(r, i, 0.01, x0 + i * 0.0009, 5.0) for r, x0 in ((1, 1.005), (2, 1.045), (3, 2.0)) for i in range(20)]
    points = windows.track_distance(spark.createDataFrame(rows, POINT + ", e double"))
    climbs = spark.createDataFrame([(r, 1, 0.2, 1.6, 4.0) for r in (1, 2, 3)], "ride long, climb_no int, start_km double, end_km double, max_grade_pct double")
    services = external.Services(service=lambda ps: [100.0] * len(ps), elevations=external.elevation_answers(shared_path(spark, "e")), match=lambda t: t, tracks=external.track_answers(shared_path(spark, "t")), pause_s=0.0)
    return fidelity.fidelity(points, tile, declared=climbs), fidelity.fidelity(points, tile, declared=climbs, services=services)


def test_baseline_and_verdict(verified):
    plain, asked = verified
    routes = {r.ride: r for r in plain["routes"].collect()}
    assert (routes[1].baseline, routes[2].baseline, routes[3].baseline) == ("raster", "route", "route")
    assert routes[1].coverage_pct == 100 and 0 < routes[2].coverage_pct < 80 and routes[3].coverage_pct == 0
    assert (routes[3].unverified, routes[3].verdict, routes[1].verdict) == (1, "high", "high")
    assert routes[1].backend == "local-dem (full-route baseline)"
    flat = plain["profile"].where("ride = 3").select("e").distinct().collect()
    assert [r.e for r in flat] == [5.0]  # the route's own elevations
    assert plain["profile"].where("ride = 1").agg(F.max("e") - F.min("e")).first()[0] > 80
    more = {r.ride: r for r in asked["routes"].collect()}
    assert more[3].unverified == 0 and more[3].backend == "local-dem + fallback" and more[3].coverage_pct == 0
    assert more[1].backend == "local-dem (full-route baseline)"


def test_fidelity_documents(verified):
    docs = {r.ride: r.report for r in documents.fidelity_documents(verified[0]).collect()}
    assert set(docs) == {1, 2, 3}
    one = docs[1]
    assert one.startswith("<!-- BEGIN FIDELITY -->\n## Fidelity Report\n\n**Verdict:** HIGH RISK") and one.endswith("\n<!-- END FIDELITY -->\n")
    for part in ("**Coverage:** 100%", "### Per-climb comparison", "| 1 | 0.20 | 4.0% | **", "### Gradient profile", "### Walls", "### Hi-fi pacing"):
        assert part in one, part
    walls = [x for x in one.split("\n") if "% in |" in x]
    assert len(walls) == 1 and walls[0].startswith("| 1 | 0.20 | +")
    assert "| 1 | 0.20 | 4.0% | (unverified) | — | — | — | — |" in docs[3] and "### Walls" not in docs[3]
    assert "sampled by an elevation service" in {r.ride: r.report for r in documents.fidelity_documents(verified[1]).collect()}[3]


def test_restated_load_rests_on_the_stitched_profile(verified):
    plain = verified[0]
    got = {r.ride: r for r in fidelity.restated_loads(plain["profile"], plain["climbs"], plain["missed"]).collect()}
    assert got[1].density > 0 and got[1].multiplier > 1 and got[1].hours_adj > got[1].hours


def test_climb_and_ride_documents(spark):
    climbs = spark.createDataFrame([(1, 1, 0.5, 800.0, 40.0, 5.0, 8.0, 4.0, "Cat 4", 1), (1, 2, 3.0, 1500.0, 135.0, 9.0, 12.0, 13.5, "Cat 3", 2)], "ride long, climb_no int, start_km double, length_m double, gain_m double, avg_grade_pct double, max_grade_pct double, index double, category string, points int")
    stats = spark.createDataFrame([(1, 1, 125.0, 200.0, 210.0, 150.0, 70.0, 20.0)], "ride long, climb_no int, duration_s double, avg_w double, np_w double, max_hr double, avg_cad double, avg_kmh double")
    text = documents.climb_documents(climbs, stats).first().report
    assert "| 2 | km 3.00 | 1500 m | 135 m | 9.0% | 12.0% | 13.50 | **Cat 3** | 2 |" in text and "| 1 | 2:05 | 200 | 210 | 150 | 70 | 20.0 |" in text
    assert "**Day total: 3 KOM points** (across 2 climbs)" in text and "(#2) has index **13.50**: **103%** of it" in text
    rides = spark.createDataFrame([(1, 30.0, 3600.0, 4000.0, 200.0, False, False, True, 0.0, 0.0, 0.0, 140.0, 170.0, 99.0, 0.0)], "ride long, distance_km double, moving_s double, elapsed_s double, ascent_m double, has_power boolean, has_cadence boolean, has_hr boolean, avg_w double, np_w double, max_w double, avg_hr double, max_hr double, hr_coverage_pct double, avg_cad double")
    text = documents.ride_documents(rides).first().report
    assert "| Moving time | 1:00:00 |" in text and "140 bpm" in text and "power" not in text and "cadence" not in text


def test_archives_and_geotiff_documents(spark, tmp_path):
    grid = np.arange(300 * 270, dtype=np.float32).reshape(300, 270) / 7
    grid[5, 6] = np.nan
    body = archives.encode_tiff(grid.ravel(), 300, 270, 600_000.0, 6_800_000.0, 1.0, 1.0)
    back = binary.decode_tiff(body)
    assert np.array_equal(back["data"].reshape(300, 270), grid, equal_nan=True)
    assert (back["x0"], back["y0"], back["px"], back["py"], back["epsg"], back["h"], back["w"]) == (600_000, 6_800_000, 1, 1, 2154, 300, 270)
    assert binary.decode_tiff(archives.encode_tiff(grid.ravel(), 300, 270, 1.0, 2.0, 0.1, 0.1, 4326))["epsg"] == 4326
    for name, members in (("lidar_composite_dtm-2022-1-TQ44sw.zip", ("TQ44sw_DTM_1m.tif", "TQ44sw_DSM_1m.tif", "TQ44sw_DTM_1m.tfw", "odd_DTM_1m.tif")), ("national_lidar_programme_dtm-TQ45.zip", ("sub/TQ45ne_DTM_1m.tif",)), ("other.zip", ("TQ46_DTM_1m.tif",))):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for m in members:
                z.writestr(m, body if m.endswith(".tif") and not m.startswith("odd") else b"x")
    (tmp_path / "lidar_composite_dtm-bad.zip").write_bytes(b"no zip")
    known = spark.createDataFrame([("TQ45ne",)], "subtile string")
    members = archives.wanted_members(archives.archive_members(spark, str(tmp_path)), known)
    assert sorted((r.subtile or "", r.what) for r in members.collect()) == [("", "fail"), ("", "fail"), ("TQ44sw", "unpack"), ("TQ45ne", "skip")]
    tiles = archives.read_archived_tiles(spark, str(tmp_path), known).collect()
    assert [t.subtile for t in tiles] == ["TQ44sw"] and tiles[0].data[5 * 270 + 6] is None and tiles[0].data[271] == pytest.approx(271 / 7)
    docs = archives.geotiff_documents(archives.read_archived_tiles(spark, str(tmp_path)))
    out = tmp_path / "out"
    wrote = archives.write_documents(docs.withColumn("name", F.concat(F.substring(F.sha2("tile_id", 256), 1, 8), F.lit(".tif"))), str(out), "name").collect()
    assert len(wrote) == 2 and sorted(p.stat().st_size for p in out.iterdir()) == sorted(r.bytes for r in wrote)
    read = binary.read_geotiff(spark, str(out)).collect()
    assert len(read) == 2 and read[0].epsg == 2154 and read[0].h == 300
    assert io.BytesIO(docs.first().content).read(4) == b"II*\0"
