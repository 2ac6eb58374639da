"""Elevation grids inside of archives, and grids as GeoTIFF documents.

A portal's archive is a zip of one grid and its side files.  What is not a terrain model is passed over by its name,
before anything is unpacked, and so are tiles that the catalogue has already.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import projection
from cadenza.sources.binary import decode_tiff
from cadenza.sources.tiles import BRITISH_TILE, leaf

#: Names of the portal's archives of terrain models, and what the name of a grid inside holds.
ARCHIVES, TERRAIN = ("lidar_composite_dtm*.zip", "national_lidar_programme_dtm*.zip"), "_DTM_"
#: Pixels of a side of the tiles that a GeoTIFF document is cut into.
SIDE = 256


def archive_members(spark: SparkSession, path: str, patterns: tuple[str, ...] = ARCHIVES) -> DataFrame:
    """archive, member, bytes of every file in the archives of a folder; of archives that cannot be read one row without member.

    Only the directories at the archives' ends are read, nothing is unpacked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        rows += [(name, m.filename, m.file_size) for m in z.infolist() if not m.is_dir()]
                except zipfile.BadZipFile:
                    rows.append((name, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["archive", "member", "bytes"])

    return _archives(spark, path, patterns).mapInArrow(run, "archive string, member string, bytes long")


def _archives(spark: SparkSession, path: str, patterns: tuple[str, ...]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "{" + ",".join(patterns) + "}").load(path).select("path", "content")


def wanted_members(members: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """members with subtile and tile, and what is done with them: ``unpack``, ``skip`` (the catalogue has the subtile) or ``fail`` (a terrain model whose name does not fit, or an archive that cannot be read).

    Of other files there are no rows.  ``catalogue``: subtile.
    """
    sub = F.nullif(F.regexp_extract(leaf(F.col("member")), BRITISH_TILE, 1), F.lit(""))
    grids = members.where(F.col("member").isNull() | (F.lower("member").endswith(".tif") & leaf(F.col("member")).contains(TERRAIN))).withColumn("subtile", sub)
    grids = grids.withColumn("tile", F.substring("subtile", 1, 4))
    if catalogue is None:
        return grids.withColumn("what", F.when(F.col("subtile").isNull(), "fail").otherwise("unpack"))
    known = catalogue.select("subtile").distinct().withColumn("_known", F.lit(True))
    return grids.join(known, "subtile", "left").withColumn("what", F.when(F.col("subtile").isNull(), "fail").when(F.col("_known"), "skip").otherwise("unpack")).drop("_known")


def read_archived_tiles(spark: SparkSession, path: str, catalogue: DataFrame | None = None, patterns: tuple[str, ...] = ARCHIVES) -> DataFrame:
    """Raster tiles of the wanted members of a folder's archives, as ``sources.binary.read_geotiff`` gives them, with subtile.

    Members are unpacked where their archive is read; each archive is read again for its wanted members only.
    """
    asked = wanted_members(archive_members(spark, path, patterns), catalogue).where("what = 'unpack'").groupBy("archive").agg(F.collect_list(F.struct("member", "subtile")).alias("asked"))
    schema = "tile_id string, subtile string, x0 double, y0 double, px double, py double, epsg int, h int, w int, data array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, members in zip(*(c.to_pylist() for c in batch.columns)):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for m in members:
                        t = decode_tiff(z.read(m["member"]))
                        values = pa.array(t["data"], pa.float32(), mask=np.isnan(t["data"]))
                        yield pa.RecordBatch.from_arrays([pa.array([f"{name}#{m['member']}"]), pa.array([m["subtile"]]), *(pa.array([float(t[k])]) for k in ("x0", "y0", "px", "py")), pa.array([t["epsg"]], pa.int32()), pa.array([t["h"]], pa.int32()), pa.array([t["w"]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)], [f.split()[0] for f in schema.split(", ")])

    return _archives(spark, path, patterns).withColumnRenamed("path", "archive").join(asked, "archive").select("archive", "content", "asked").mapInArrow(run, schema)


def encode_tiff(data: np.ndarray, h: int, w: int, x0: float, y0: float, px: float, py: float, epsg: int = projection.EPSG_LAMBERT_93, nodata: float = -99999.0) -> bytes:
    """A one-band grid of floats as GeoTIFF: tiles of SIDE pixels, bytes sorted by significance and differenced, deflated; no loss.

    NaN is written as ``nodata``.  The keys name a projected system, or a geographic one for codes from 4000 to 4999.
    """
    grid = np.where(np.isnan(data), np.float32(nodata), data).astype(np.float32).reshape(h, w)
    blocks = []
    for r in range(0, h, SIDE):
        for c in range(0, w, SIDE):
            block = np.full((SIDE, SIDE), np.float32(nodata), np.float32)
            part = grid[r : r + SIDE, c : c + SIDE]
            block[: part.shape[0], : part.shape[1]] = part
            planes = block.astype(">f4").view(np.uint8).reshape(SIDE, SIDE, 4).transpose(0, 2, 1).reshape(SIDE, 4 * SIDE)
            blocks.append(zlib.compress(np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()))
    geographic = 4000 <= epsg < 5000
    keys = (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg)
    text = f"{nodata:g}".encode() + b"\0"
    n = len(blocks)
    tags = [
        (256, "I", (w,)), (257, "I", (h,)), (258, "H", (32,)), (259, "H", (8,)), (262, "H", (1,)), (277, "H", (1,)), (317, "H", (3,)), (322, "I", (SIDE,)), (323, "I", (SIDE,)), (324, "I", (0,) * n), (325, "I", tuple(map(len, blocks))),
        (339, "H", (3,)), (33550, "d", (px, py, 0.0)), (33922, "d", (0.0, 0.0, 0.0, x0, y0, 0.0)), (34735, "H", keys), (42113, "s", text),
    ]
    kinds = {"s": 2, "H": 3, "I": 4, "d": 12}
    raw = lambda kind, v: v if kind == "s" else struct.pack(f"<{len(v)}{kind}", *v)
    at = 8 + 2 + 12 * len(tags) + 4
    for _, kind, v in tags:
        at += len(raw(kind, v)) if len(raw(kind, v)) > 4 else 0
    places = np.cumsum([at, *map(len, blocks)])[:-1].tolist()
    tags[9] = (324, "I", tuple(places))
    head, tail, where = [], [], 8 + 2 + 12 * len(tags) + 4
    for tag, kind, v in tags:
        body = raw(kind, v)
        if len(body) > 4:
            head.append(struct.pack("<HHII", tag, kinds[kind], len(v), where))
            tail.append(body)
            where += len(body)
        else:
            head.append(struct.pack("<HHI", tag, kinds[kind], len(v)) + body.ljust(4, b"\0"))
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + b"".join(head) + struct.pack("<I", 0) + b"".join(tail) + b"".join(blocks)


def geotiff_documents(tiles: DataFrame) -> DataFrame:
    """tile_id, content: raster tiles as GeoTIFF documents; without ``epsg`` they are on the French grid, as ASCII grids tell no system."""
    rows = tiles.select("tile_id", "x0", "y0", "px", "py", (F.col("epsg") if "epsg" in tiles.columns else F.lit(projection.EPSG_LAMBERT_93)).alias("epsg"), "h", "w", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tile, x0, y0, px, py, epsg, h, w = (batch.column(i)[k].as_py() for i in range(8))
                data = batch.column(8)[k].values.to_numpy(zero_copy_only=False).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([tile]), pa.array([encode_tiff(data, h, w, x0, y0, px, py, epsg)], pa.binary())], ["tile_id", "content"])

    return rows.mapInArrow(run, "tile_id string, content binary")


def write_documents(documents: DataFrame, folder: str, name: str, content: str = "content") -> DataFrame:
    """name, bytes of the files that executors wrote into ``folder`` (a path or URI that they all share).

    A file is written beside its place and then moved there, so a task that runs twice leaves it whole.  Call an action.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        where.create_dir(root, recursive=True)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for n, body in zip(names, batch.column(1).to_pylist()):
                body = body.encode() if isinstance(body, str) else body
                beside = f"{root}/.{n}-{uuid.uuid4().hex}"
                with where.open_output_stream(beside) as out:
                    out.write(body)
                where.move(beside, f"{root}/{n}")
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return documents.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInArrow(run, "name string, bytes long")
