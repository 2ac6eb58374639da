"""FIT and GeoTIFF readers on files written here byte by byte."""

import struct
import zlib

import numpy as np
import pytest

from cadenza.operators import metrics, verify
from cadenza.sinks import reports
from cadenza.sources import binary


def fit_file(records, stored):
    body = b"\x40\x00\x00" + struct.pack("<HB", 20, 4) + bytes([253, 4, 0x86, 5, 4, 0x86, 7, 2, 0x84, 78, 4, 0x86])
    for t, d, p, e in records:
        body += b"\x00" + struct.pack("<IIHI", t, d * 100, 0xFFFF if p is None else p, int((e + 500) * 5))
    body += b"\x41\x00\x01" + struct.pack(">HB", 18, 2) + bytes([9, 4, 0x86, 22, 2, 0x84]) + b"\x01" + struct.pack(">IH", stored * 100, 77)
    return struct.pack("<BBHI4sH", 14, 16, 2132, len(body), b".FIT", 0) + body + b"\0\0"


def test_fit(spark, tmp_path):
    (tmp_path / "a.fit").write_bytes(fit_file([(1000, 0, 150, 10.0), (1001, 7, None, 11.0), (1002, 14, 170, 12.0)], 14))
    rec = binary.read_fit(spark, str(tmp_path / "a.fit"))
    got = rec.orderBy("seq").collect()
    assert [r.power for r in got] == [150, None, 170] and [r.distance for r in got] == [0, 7, 14] and got[1].enhanced_altitude == 11.0
    assert (got[1].ts - got[0].ts).total_seconds() == 1
    (s,) = binary.read_fit(spark, str(tmp_path / "a.fit"), "session").collect()
    assert (s.total_distance, s.total_ascent, s.sport) == (14, 77, None)
    samples = metrics.to_samples(rec).orderBy("seq").collect()
    assert [x.p for x in samples] == [150, 0, 170] and [x.t for x in samples] == [0, 1, 2]
    assert reports.gpx_documents(rec.selectExpr("ride", "seq", "position_lat AS lat", "position_long AS lon", "enhanced_altitude AS e")).count() == 0


def tiff(grid, deflate):
    h, w = grid.shape
    raw = grid.astype("<f4").tobytes()
    raw = zlib.compress(raw) if deflate else raw
    tail, at = b"", 8 + 2 + 12 * 11 + 4
    entries = []

    def entry(tag, kind, values, fmt):
        nonlocal tail
        data = struct.pack(f"<{len(values)}{fmt}", *values)
        where = struct.pack("<I", at + len(tail)) if len(data) > 4 else data.ljust(4, b"\0")
        tail += data if len(data) > 4 else b""
        entries.append(struct.pack("<HHI", tag, kind, len(values)) + where)

    for tag, v in ((256, w), (257, h), (258, 32), (259, 8 if deflate else 1)):
        entry(tag, 4, [v], "I")
    entries.append(None)
    for tag, v in ((278, h), (279, len(raw)), (339, 3)):
        entry(tag, 4, [v], "I")
    entry(33550, 12, [1e-4, 1e-4, 0], "d")
    entry(33922, 12, [0, 0, 0, 0.0, 51.0006, 0], "d")
    entries.append(struct.pack("<HHI4s", 42113, 2, 3, b"-9\0\0"))
    entries[4] = struct.pack("<HHII", 273, 4, 1, at + len(tail))
    return b"II*\0" + struct.pack("<IH", 8, len(entries)) + b"".join(entries) + b"\0" * 4 + tail + raw


@pytest.mark.parametrize("deflate", [False, True])
def test_geotiff(spark, tmp_path, deflate):
    grid = np.array([[10 * r + c for c in range(6)] for r in range(6)], float)
    grid[5, 5] = -9
    (tmp_path / "t.tif").write_bytes(tiff(grid, deflate))
    tiles = binary.read_geotiff(spark, str(tmp_path))
    (t,) = tiles.collect()
    assert (t.h, t.w, t.x0, t.y0, t.data[8], t.data[35]) == (6, 6, 0.0, 51.0006, 12.0, None)
    pts = spark.createDataFrame([(1, 0, 51.0006 - 3e-4, 4e-4)], "ride long, seq long, lat double, lon double")
    assert verify.sample_tiles(pts, tiles).first().z == pytest.approx(28.5, abs=1e-3)
