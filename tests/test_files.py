"""Readers, reports, the entry points and the streaming extension."""

import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from cadenza.sinks import reports
from cadenza.sources import files
from cadenza.streaming import live

REPO = Path(__file__).resolve().parent.parent
GPX = """<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="1" lon="2"><name>Pub</name><sym>Bar</sym></wpt>
<trk><name>x</name><trkseg><trkpt lat="0" lon="0"><ele>10</ele></trkpt><trkpt lat="0" lon="0.001"></trkpt></trkseg><trkseg><trkpt lat="0" lon="0.002"><ele>20</ele></trkpt></trkseg></trk></gpx>"""


def test_gpx(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(GPX)
    pts = files.read_gpx(spark, str(tmp_path / "a.gpx")).orderBy("seq").collect()
    assert [p.e for p in pts] == [10, 15, 20] and 200 < pts[-1].cum_m < 230
    (w,) = files.read_waypoints(spark, str(tmp_path / "a.gpx")).collect()
    assert (w.idx, w.lat, w.name, w.desc) == (1, 1.0, "Pub", "")


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "t.asc").write_text("ncols 2\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 5\nNODATA_value -9\n1 2\n-9 4\n")
    (t,) = files.read_ascii_grids(spark, str(tmp_path / "t.asc")).collect()
    assert (t.w, t.h, t.y0, t.data) == (2, 2, 30.0, [1.0, 2.0, None, 4.0])


def test_front_matter():
    text = "<!-- x -->\n---\nfitness:\n  ftp_w: 250\nnote: at 10:30: fine\nbattery: 345  # Derived: x\nlog: |\n  ftp_w: 999\n---\nbody"
    got = files.front_matter(text)
    assert got["fitness"]["ftp_w"] == 250 and got["note"] == "at 10:30: fine" and got["battery"] == 345 and "999" in got["log"]
    assert files.front_matter("no block") == {}
    assert files.merged_profile({"a": {"x": 1, "y": 2}}, {"a": {"x": 3}, "b": 4}) == {"a": {"x": 3, "y": 2}, "b": 4}
    assert files.peers({"peer_bo": {"ftp": 1}, "a": 2}) == {"bo": {"ftp": 1}}


def test_bikes(spark):
    profile = {"bikes": {"r": {"has_power_meter": True, "crr": {"tarmac": 0.005}, "gearing": {"chainrings_t": [30], "cassette_t": [11, 32]}}, "e": {"assist": {"rated_w": 250, "legal_cutoff_kph": 25, "levels": {"eco": {"share": 0.5}}}}, "bad": {"assist": {"rated_w": "x"}}}}
    got = {r.slug: r for r in files.bike_table(spark, profile).collect()}
    assert got["r"].has_power_meter and got["r"].gearing.cassette_t == [11, 32]
    assert got["e"].assist.cutoff_kph == 25 and got["e"].assist.level_share == {"eco": 0.5} and got["bad"].assist is None


def test_reports(spark):
    df = spark.createDataFrame([(1, 2.5, None)], "a int, b double, c string")
    assert "| 1 | 2.5 | — |" in reports.markdown_table(df, "T")
    once = reports.upsert_section("# x\n", "PACING", "hello")
    assert reports.upsert_section(once, "PACING", "hello") == once and "bye" in reports.upsert_section(once, "PACING", "bye")
    pts = spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0), (1, 1, 1.5, None, 3.0)], "ride long, seq long, lat double, lon double, e double")
    assert reports.gpx_documents(pts).first().gpx.count("<trkpt") == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 10:00:00", 100.0), ("a", "2024-01-01 10:05:00", 200.0), ("a", "2024-01-01 12:00:00", 50.0)], "user string, ts string, p double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user string, ts timestamp, p double").parquet(str(tmp_path / "in"))
    q = live.sessions(stream).writeStream.format("memory").queryName("live_sessions").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(r.samples for r in spark.table("live_sessions").collect()) == [1, 2]


def test_entry_without_the_training_data_operators(tmp_path):
    """The entry still imports, and serves the rest, where cadenza/llm and the pipeline are gone."""
    code = f"import sys, importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith('cadenza.llm') or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(name)\nsys.meta_path.insert(0, Gone())\nsys.path.insert(0, {str(REPO)!r})\nimport __spark_entry__ as e\nassert 'peak_curve' in e.queries() and not any(q.startswith('op') for q in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], check=True, cwd=tmp_path)
