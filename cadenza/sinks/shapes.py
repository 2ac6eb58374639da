"""Areas for tile portals as zipped polygon files, and the plain table of a route's waypoints."""

from __future__ import annotations

import io
import struct
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.projection import british_grid

#: Fixed value: the British grid as polygon files name it.
BRITISH_GRID = 'PROJCS["British_National_Grid",GEOGCS["GCS_OSGB_1936",DATUM["D_OSGB_1936",SPHEROID["Airy_1830",6377563.396,299.3249646]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",400000.0],PARAMETER["False_Northing",-100000.0],PARAMETER["Central_Meridian",-2.0],PARAMETER["Scale_Factor",0.9996012717],PARAMETER["Latitude_Of_Origin",49.0],UNIT["Meter",1.0]]'


def british_ring(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, buffer_m: float = 0.0) -> Column:
    """Closed clockwise ring (array of x, y) around the projected corners of a box of degrees, ``buffer_m`` wider all around."""
    corners = F.array(*[british_grid(lat, lon) for lat in (min_lat, max_lat) for lon in (min_lon, max_lon)])
    reach = lambda k: (F.array_min(F.transform(corners, lambda p: p[k])) - buffer_m, F.array_max(F.transform(corners, lambda p: p[k])) + buffer_m)
    (e0, e1), (n0, n1) = reach("x"), reach("y")
    return F.array(*[F.struct(e.alias("x"), n.alias("y")) for e, n in ((e0, n0), (e0, n1), (e1, n1), (e1, n0), (e0, n0))])


def polygon_zip(ring: list[tuple[float, float]], name: str = "area") -> bytes:
    """A zip of the four files of one polygon in the British grid."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    box = struct.pack("<4d", min(xs), min(ys), max(xs), max(ys))
    record = struct.pack("<i", 5) + box + struct.pack("<3i", 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)

    def headed(body: bytes) -> bytes:  # lengths count 16-bit words
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i", 1000, 5) + box + bytes(32) + body

    dbf = struct.pack("<4BIHH20x", 3, 126, 1, 1, 1, 32 + 32 + 1, 1 + 4) + struct.pack("<11sc4xBB14x", b"id", b"N", 4, 0) + b"\r" + b"    1" + b"\x1a"
    parts = {"shp": headed(struct.pack(">2i", 1, len(record) // 2) + record), "shx": headed(struct.pack(">2i", 50, len(record) // 2)), "dbf": dbf, "prj": BRITISH_GRID.encode()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for kind, data in parts.items():
            z.writestr(f"{name}.{kind}", data)
    return out.getvalue()


def waypoint_lines(waypoints: DataFrame) -> DataFrame:
    """idx, line: a route's waypoints (idx, km, decision, cat, name, reason, disp) as the rows of a plain table."""
    keep = F.col("decision") == "KEEP"
    note = F.when(keep, F.format_string('shown as: "%s"', F.coalesce("disp", F.lit("")))).otherwise(F.coalesce("reason", F.lit("")))
    name = F.substring(F.when(F.coalesce("name", F.lit("")) == "", "?").otherwise(F.col("name")), 1, 32)
    return waypoints.select("idx", F.format_string("%2d  %5.1f  %-6s  %-6s  %-32s  %-40s", F.col("idx"), F.col("km").cast("double"), F.when(keep, "✓ keep").otherwise("✗ drop"), "cat", name, note).alias("line"))
