"""Profiles that are found and laid over defaults, and routes from files to reports."""

import numpy as np
import pytest

from cadenza.plans import reports
from cadenza.sinks.reports import embed_prediction
from cadenza.sources import bikes, profiles
from tests.test_binary import fit_file, tiff
from tests.test_reports import PREDICTION

OWN = """---
athlete:
  ftp_w: 260
default_bike: tourer
bikes:
  tourer:
    cda: 0.4
    system_weight_kg_default: 100
    surfaces_supported: [tarmac, gravel]
    crr_by_surface: {tarmac: 0.005, gravel: 0.009}
---
# Me
"""


def test_discovery_goes_from_own_to_example_to_defaults(spark, tmp_path):
    none, origin = profiles.load_profile(spark, [str(tmp_path)])
    assert none["athlete"]["ftp_w"] == 200 and set(origin.values()) == {"default"}
    (tmp_path / "b").mkdir()
    (tmp_path / "USER_PROFILE.example.md").write_text("---\nathlete:\n  ftp_w: 190\n---\n")
    example, origin = profiles.load_profile(spark, [str(tmp_path), str(tmp_path / "b")])
    assert example["athlete"]["ftp_w"] == 190 and origin["athlete.ftp_w"].endswith("example.md") and origin["athlete.map_w"] == "default"
    (tmp_path / "b" / "USER_PROFILE.md").write_text(OWN)
    own, origin = profiles.load_profile(spark, [str(tmp_path), str(tmp_path / "b")])
    assert own["athlete"] == {**none["athlete"], "ftp_w": 260} and origin["bikes.tourer"].endswith("b/USER_PROFILE.md")
    (tmp_path / "b" / "USER_PROFILE.md").write_text("no front matter")
    assert profiles.load_profile(spark, [str(tmp_path / "b")])[0] == none


def test_laid_over_keeps_track_of_origins():
    origin = {"a.x": "base", "a.y": "base", "c": "base"}
    got = profiles.laid_over({"a": {"x": 1, "y": 2}, "c": 3}, {"a": {"y": {"z": 4}, "w": 5}, "c": {"d": 6}, "e": 7}, "own", origin)
    assert got == {"a": {"x": 1, "y": {"z": 4}, "w": 5}, "c": {"d": 6}, "e": 7}
    assert origin == {"a.x": "base", "a.y": "own", "a.w": "own", "c.d": "own", "e": "own"}
    replaced = {"a.x": "base"}
    assert profiles.laid_over({"a": {"x": 1}}, {"a": 2}, "own", replaced) == {"a": 2} and replaced == {"a": "own"}


def test_body_follows_bike_and_surface():
    from cadenza.sources.files import front_matter

    profile = front_matter(OWN)
    assert profiles.body_of(profile) == {"mass": 100.0, "cda": 0.4, "crr": 0.005, "eta": 0.97}
    assert profiles.body_of(profile, surface="gravel")["crr"] == 0.009
    assert profiles.body_of({})["mass"] == 87.0
    with pytest.raises(bikes.UnsupportedSurfaceError):
        profiles.body_of(profile, surface="sand")
    with pytest.raises(bikes.UnknownBikeError):
        profiles.body_of(profile, "racer")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("route")
    pts = "".join(f'<trkpt lat="{51 + i * 1e-4:.6f}" lon="0.0003"><ele>{50 + max(0, i - 60) * 0.8:.2f}</ele></trkpt>' for i in range(200))
    (at / "r.gpx").write_text(f'<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>{pts}</trkseg></trk></gpx>')
    (at / "t.tif").write_bytes(tiff(np.add.outer(np.arange(400.0)[::-1] * 2, np.zeros(6)), True))
    (at / "USER_PROFILE.md").write_text(OWN)
    (at / "a.fit").write_bytes(fit_file([(1000 + i, 8 * i, 150 + i % 50, 50 + 0.6 * max(0, i - 20)) for i in range(200)], 1600))
    return at


def test_route_with_bike_and_rasters(spark, folder):
    body = profiles.body_of(profiles.load_profile(spark, [str(folder)])[0])
    frames = reports.route_frames(spark, str(folder / "r.gpx"), str(folder), body=body)
    light = reports.route_frames(spark, str(folder / "r.gpx"))
    assert frames["load"].first().hours > light["load"].first().hours  # a heavier bike is slower
    report = frames["report"].first()
    assert "## Fidelity Report" in report.report and "### Per-climb comparison" in report.report
    other = spark.createDataFrame([(report.ride, PREDICTION), ("elsewhere", PREDICTION)], "ride string, text string")
    texts = {r.ride: r.text for r in reports.embedded_predictions(other, frames).collect()}
    assert texts["elsewhere"] == PREDICTION and "## Fidelity Report" in texts[report.ride]
    again = spark.createDataFrame([(report.ride, texts[report.ride])], "ride string, text string")
    assert reports.embedded_predictions(again, frames).first().text == texts[report.ride]
    assert embed_prediction(PREDICTION, report.report).startswith("# A route")
