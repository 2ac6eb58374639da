"""Reports from files, end to end, and the command line."""

import numpy as np

from cadenza import __main__ as cli
from cadenza.plans import reports
from cadenza.sinks.reports import embed_prediction
from tests.test_binary import fit_file, tiff


def test_ride_and_comparison(spark, tmp_path):
    for name, watts in (("a", 150), ("b", 200)):
        (tmp_path / f"{name}.fit").write_bytes(fit_file([(1000 + i, 8 * i, watts + i % 50, 50 + 0.3 * i) for i in range(120)], 952))
    frames = reports.ride_frames(spark, str(tmp_path / "a.fit"))
    assert frames["session"].count() == 1 and frames["derived"].first().has_power
    assert {r.window for r in frames["peaks"].collect()} == {1, 5, 15, 30, 60, 120}
    both = reports.compare_frames(spark, str(tmp_path / "a.fit"), str(tmp_path / "b.fit"))
    assert [(r.a, r.b) for r in both["peaks"].where("window = 5").collect()] == [(197.0, 247.0)]
    assert both["chase"].count() == 0


def test_route(spark, tmp_path):
    pts = "".join(f'<trkpt lat="{51 + i * 1e-4:.6f}" lon="0.0003"><ele>{50 + max(0, i - 60) * 0.8:.2f}</ele></trkpt>' for i in range(200))
    (tmp_path / "r.gpx").write_text(f'<gpx xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="51.01" lon="0.0003"><name>Old Pub</name></wpt><trk><trkseg>{pts}</trkseg></trk></gpx>')
    (tmp_path / "t.tif").write_bytes(tiff(np.add.outer(np.arange(400.0)[::-1] * 2, np.zeros(6)), True))
    frames = reports.route_frames(spark, str(tmp_path / "r.gpx"), str(tmp_path))
    assert frames["climbs"].count() >= 1 and frames["load"].count() == 1
    assert [r.decision for r in frames["waypoints"].collect()] == ["KEEP"]
    assert frames["verdict"].first().verdict in ("safe", "minor", "high") and frames["verified"].count() >= 1


def test_command_line(spark, capsys):
    cli.main(["load", "--ctl", "40", "--atl", "45", "--plan", "60,0"])
    cli.main(["--json", "tyres", "--kg", "90"])
    out = capsys.readouterr().out
    assert "| plan | 0 | 60 |" in out and '{"surface":"new","front_psi":68.0,"rear_psi":70.0}' in out


def test_pairs_and_waypoint_lists(spark, tmp_path, capsys):
    for name, watts in (("a", None), ("b", 200)):
        (tmp_path / f"{name}.fit").write_bytes(fit_file([(1000 + i, 8 * i, watts, 50.0) for i in range(20)], 952))
    frames = reports.pair_frames(spark, str(tmp_path / "a.fit"), str(tmp_path / "b.fit"))
    row = frames["ride"].first()
    assert frames["devices"].count() == 2 and (row.terrain, row.power_source, row.ascent_m) == ("A", None, 77.0)
    pts = "".join(f'<trkpt lat="{51 + i * 1e-3:.6f}" lon="0.0003"><ele>50</ele></trkpt>' for i in range(30))
    (tmp_path / "r.gpx").write_text(f'<gpx xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="51.01" lon="0.0003"><name>Old Pub</name></wpt><wpt lat="51.02" lon="0.0003"><name>zz</name></wpt><trk><trkseg>{pts}</trkseg></trk></gpx>')
    cli.main(["waypoints", str(tmp_path / "r.gpx"), "--include", "2", "--exclude", "1"])
    one, two = capsys.readouterr().out.splitlines()[-2:]
    assert one.startswith(" 1    1.1  ✗ drop") and "--exclude" in one and two.startswith(" 2    2.2  ✓ keep")


PREDICTION = """# A route

## Summary
- **Ascent**: 700 m
- **Total moving time**: ~2.59 h
- **TSS at IF 0.65** (easy): ~109
- **TSS at IF 0.70** (steady): ~127
- **TSS at IF 0.75** (hard): ~146
"""


def test_predictions_are_restated_once():
    """Walls raise hours and stress; small changes, and what was restated before, stay."""
    load = {"density": 12.0, "multiplier": 1.204, "hours_adj": 3.12, "tss_adj_065": 132.0, "tss_adj_070": 153.0, "tss_adj_075": 176.0, "if_lo": 0.78, "if_hi": 0.9, "tss_adj_lo": 190.0, "tss_adj_hi": 253.0}
    once = embed_prediction(PREDICTION, "| climb |", load, 812.0, 91.0)
    assert "- **Ascent**: 812 m (from rasters; GPX: 700 m)" in once and "moving time**: ~3.12 h (from rasters, adjusted to the terrain; GPX: ~2.59 h)" in once
    assert "(easy): ~132 (from rasters, adjusted to the terrain; GPX: ~109)" in once and once.count("**Wall density**: 12.0 m/km") == 1 and "Rasters cover" not in once
    assert embed_prediction(once, "| climb |", load, 812.0, 91.0) == once
    again = embed_prediction(once, "| climb |", {**load, "density": None, "multiplier": 1.0, "hours_adj": 2.65, "tss_adj_065": 112.0}, 812.0, 55.5)
    assert "GPX: ~2.59 h" in again and "not measured" in again and "Rasters cover 55.5 %" in again and again.count("Wall density") == 1
    same = embed_prediction(PREDICTION, "x", {**load, "multiplier": 1.0, "hours_adj": 2.7, "tss_adj_065": 112.0, "tss_adj_070": 130.0, "tss_adj_075": 150.0}, 710.0)
    assert "- **Ascent**: 700 m\n" in same and "~2.59 h\n" in same and "~109\n" in same
