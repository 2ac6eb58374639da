"""Projections, grids in metres, bikes, services outside of the engine, and areas for portals."""

import io
import math
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import projection
from cadenza.operators import verify
from cadenza.sinks import shapes
from cadenza.sources import bikes, binary, external, tiles


def test_projections_at_published_points(spark):
    """The worked example of the British grid, and the origin and a city of the French one."""
    degrees = lambda d, m, s: math.radians(d + m / 60 + s / 3600)
    b = projection.transverse_mercator(F.lit(degrees(52, 39, 27.2531)), F.lit(degrees(1, 43, 4.5177)))
    row = spark.range(1).select(b["x"].alias("x"), b["y"].alias("y"), projection.projected(F.lit(46.5), F.lit(3.0), 2154).alias("o"), projection.projected(F.lit(48.8566), F.lit(2.3522), 2154).alias("p"), projection.projected(F.lit(51.0), F.lit(-1.5), 4326).alias("d")).first()
    assert (row.x, row.y) == pytest.approx((651409.903, 313177.270), abs=1e-3)
    assert tuple(row.o) == pytest.approx((700_000, 6_600_000), abs=1e-3) and tuple(row.p) == pytest.approx((652469, 6862035), abs=1)
    assert tuple(row.d) == (-1.5, 51.0)
    with pytest.raises(ValueError, match="EPSG:3857"):
        projection.projected(F.lit(1.0), F.lit(1.0), 3857)


def test_tiles_in_metres_and_in_blocks(spark):
    """A grid larger than a block, in metres and in degrees, gives what reading its pixels directly gives."""
    h, w = 300, 520
    grid = np.add.outer(np.arange(h) * 3.0, np.arange(w) * 0.5).astype(np.float32)
    grid[100:104, 250:262] = np.nan
    data = [None if np.isnan(v) else float(v) for v in grid.ravel()]
    schema = "tile_id string, path_rank int, x0 double, y0 double, px double, py double, epsg int, h int, w int, data array<float>"
    at = spark.createDataFrame([(51.5, -0.1)], "lat double, lon double").select(projection.projected(F.col("lat"), F.col("lon"), 27700).alias("g")).first().g
    rows = [("a", 1, at.x - 130, at.y + 150, 1.0, 1.0, 27700, h, w, data), ("b", 2, 10.0, 50.0, 1e-4, 1e-4, 4326, h, w, data)]
    rng = np.random.default_rng(1)
    places = [(51.5 + float(a) * 1e-5, -0.1 + float(b) * 1e-5) for a, b in rng.integers(-120, 120, (60, 2))]
    places += [(50.0 - float(r) * 1e-4, 10.0 + float(c) * 1e-4) for r, c in zip(rng.uniform(0, h, 200), rng.uniform(0, w, 200))]
    places += [(50.0 - r * 1e-4, 10.0 + c * 1e-4) for r in (0.2, 255.5, 256.0, 256.4, 299.9) for c in (0.1, 255.6, 256.0, 512.0, 519.8)] + [(50 - 102.3e-4, 10 + 255.7e-4), (0.0, 0.0)]
    points = spark.createDataFrame([(1, i, *p) for i, p in enumerate(places)], "ride long, seq long, lat double, lon double")
    xy = points.select("seq", projection.projected(F.col("lat"), F.col("lon"), 27700).alias("g")).collect()
    metres = {r.seq: (r.g.x, r.g.y) for r in xy}

    def direct(row, col):
        r, c = row - 0.5, col - 0.5
        r0, c0 = math.floor(r), math.floor(c)
        if r0 < 0 or c0 < 0 or r0 + 1 >= h or c0 + 1 >= w:
            return grid[min(max(r0, 0), h - 1), min(max(c0, 0), w - 1)]
        q, (dr, dc) = grid[r0 : r0 + 2, c0 : c0 + 2].astype(float), (r - r0, c - c0)
        if np.isnan(q).any():
            return np.nanmean(q) if not np.isnan(q).all() else math.nan
        return (q * np.outer([1 - dr, dr], [1 - dc, dc])).sum()

    got = {r.seq: r.z for r in verify.sample_tiles(points, spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == len(places)
    for i, (lat, lon) in enumerate(places):
        x, y = metres[i]
        if rows[0][2] <= x <= rows[0][2] + w and rows[0][3] - h <= y <= rows[0][3]:
            want = direct(rows[0][3] - y, x - rows[0][2])
        elif 10 <= lon <= 10 + w * 1e-4 and 50 - h * 1e-4 <= lat <= 50:
            want = direct((50 - lat) / 1e-4, (lon - 10) / 1e-4)
        else:
            want = math.nan
        assert (got[i] is None and math.isnan(want)) or got[i] == pytest.approx(want, abs=1e-3), (i, lat, lon)


def lzw(data):
    """Codes as an encoder that clears its table every 3,000 entries writes them."""
    bits, table, width, last = "", {bytes([i]): i for i in range(256)}, 9, b""
    size, out = 258, [(256, 9)]
    for b in data:
        if last + bytes([b]) in table:
            last += bytes([b])
            continue
        out.append((table[last], width))
        table[last + bytes([b])] = size
        size += 1
        width = max(9, size.bit_length())
        last = bytes([b])
        if size == 3000:
            out += [(table[last], width), (256, width)]
            table, size, width, last = {bytes([i]): i for i in range(256)}, 258, 9, b""
    if last:
        out += [(table[last], width)]
    out.append((257, max(9, (size + 1).bit_length()) if last else width))
    bits = "".join(format(c, f"0{n}b") for c, n in out)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_lzw_and_predictors():
    rng = np.random.default_rng(3)
    for data in (b"", b"a", b"abababab" * 90, rng.integers(0, 4, 9000, dtype=np.uint8).tobytes(), rng.integers(0, 256, 6000, dtype=np.uint8).tobytes()):
        assert binary.unpack_lzw(lzw(data)) == data
    whole = rng.integers(-900, 900, (7, 33)).astype("<i2")
    kept = np.concatenate([whole[:, :1], np.diff(whole, axis=1)], 1).astype("<i2")
    assert (binary.unpredict(kept.tobytes(), np.dtype("<i2"), 33, 2) == whole).all()
    real = rng.normal(size=(5, 17)).astype("<f4")
    planes = real.astype(">f4").view(np.uint8).reshape(5, 17, 4).transpose(0, 2, 1).reshape(5, -1)
    kept = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], 1).astype(np.uint8)
    assert (binary.unpredict(kept.tobytes(), np.dtype("<f4"), 17, 3) == real).all()
    assert binary.epsg_code((1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 27700)) == 27700 and binary.epsg_code(()) == 4326


PROFILE = {"default_bike": "tourer", "bikes": {"tourer": {"name": "T", "cda": "x", "system_weight_kg_default": 95, "fr_split": "40/60", "crr_by_surface": {"gravel": 0.009}, "surfaces_supported": ["gravel"]}, "roadie": {"cda": 0.29}}}


def test_bikes():
    assert bikes.load_bike(PROFILE)["slug"] == "tourer" and bikes.list_bikes(PROFILE) == ["roadie", "tourer"]
    for profile, slug in ((PROFILE, "tandem"), ({}, None), ({"bikes": {"a": {}}}, None)):
        with pytest.raises(bikes.UnknownBikeError):
            bikes.load_bike(profile, slug)
    assert bikes.surface_of(bikes.load_bike(PROFILE)) == "gravel" and bikes.surface_of(bikes.load_bike(PROFILE, "roadie")) is None
    with pytest.raises(bikes.UnsupportedSurfaceError, match="gravel"):
        bikes.surface_of(bikes.load_bike(PROFILE), "sand")
    found = bikes.rider_of(PROFILE)
    assert (found["system_weight_kg"], found["cda"], found["fr_split_front_pct"]) == (95.0, 0.30, 40.0)
    assert bikes.rider_of({"default_bike": "gone", "physics": {"cda": 1}}) == {"cda": 1} and bikes.front_share("48-52") is None


def test_elevations_come_in_batches(spark):
    points = spark.createDataFrame([(1, i, 50.0 + i, 1.0, None if i % 3 else 7.0) for i in range(20)], "ride long, seq long, lat double, lon double, z double").repartition(4)
    service = lambda ps: [len(ps) * 1000 + lat for lat, _ in ps]
    got = {r.seq: r.z for r in external.filled_elevations(points, service, batch=4, pause_s=0.0).collect()}
    assert all(got[i] == 7.0 for i in range(0, 20, 3)) and sum(v >= 1000 for v in got.values()) == 13 and max(v // 1000 for v in got.values()) <= 4
    assert external.filled_elevations(points, None).where("z IS NULL").count() == 13
    with pytest.raises(Exception, match="elevations for"):
        external.elevations(points, lambda ps: [1.0], pause_s=0.0, batch=8).collect()


def test_matched_tracks(spark):
    rows = [(c, i, 50.0 + i * 1e-3, float(c)) for c in (1, 2, 3) for i in range(25)] + [(4, 0, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "climb long, seq long, lat double, lon double").repartition(3)

    def service(track):
        assert len(track) == 10 and track[0][0] == 50.0 and track[-1][0] == pytest.approx(50.024)
        if track[0][1] == 2.0:
            raise OSError("down")
        return [p for p in track for _ in (0, 1)]

    cache = spark.createDataFrame([(3, 0, 9.0, 9.0), (77, 0, 1.0, 1.0)], "climb long, seq int, lat double, lon double")
    got = external.matched_tracks(points, service, cache=cache).collect()
    n = {c: sum(r.climb == c for r in got) for c in (1, 2, 3, 4, 77)}
    assert n == {1: 10, 2: 25, 3: 1, 4: 1, 77: 0}
    assert external.matched_tracks(points, None).count() == len(rows)


def test_areas_for_portals(spark):
    ring = spark.range(1).select(shapes.british_ring(F.lit(-0.2), F.lit(51.4), F.lit(0.0), F.lit(51.6), 100.0).alias("r")).first().r
    ring = [(p.x, p.y) for p in ring]
    assert ring[0] == ring[-1] and len(ring) == 5 and ring[1][1] - ring[0][1] > 22_000
    assert sum((b[0] - a[0]) * (b[1] + a[1]) for a, b in zip(ring, ring[1:])) > 0  # clockwise
    z = zipfile.ZipFile(io.BytesIO(shapes.polygon_zip(ring)))
    assert sorted(z.namelist()) == ["area.dbf", "area.prj", "area.shp", "area.shx"]
    shp, shx, dbf = (z.read(f"area.{k}") for k in ("shp", "shx", "dbf"))
    assert struct.unpack(">i", shp[24:28])[0] * 2 == len(shp) and struct.unpack(">2i", shx[100:108]) == (50, (len(shp) - 108) // 2)
    assert struct.unpack("<i", shp[108:112])[0] == 5 and struct.unpack("<10d", shp[-80:]) == tuple(v for p in ring for v in p)
    assert struct.unpack("<HH", dbf[8:12]) == (65, 5) and dbf[65:70] == b"    1"
    assert tiles.policy_of_answer(" D ") == "download" and tiles.policy_of_answer("x") is None
