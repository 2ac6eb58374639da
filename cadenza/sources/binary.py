"""Readers of binary device and raster files: FIT activities and GeoTIFF grids.

Files are listed and read by Spark (``binaryFile``) and decoded where they lie, one file at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values of the FIT format: base type -> struct code, invalid value
_TYPES = {
    0x00: ("B", 0xFF), 0x01: ("b", 0x7F), 0x02: ("B", 0xFF), 0x83: ("h", 0x7FFF), 0x84: ("H", 0xFFFF), 0x85: ("i", 0x7FFFFFFF), 0x86: ("I", 0xFFFFFFFF),
    0x88: ("f", None), 0x89: ("d", None), 0x0A: ("B", 0), 0x8B: ("H", 0), 0x8C: ("I", 0), 0x0D: ("B", 0xFF), 0x8E: ("q", 0x7FFFFFFFFFFFFFFF), 0x8F: ("Q", 0xFFFFFFFFFFFFFFFF), 0x90: ("Q", 0),
}
# message number -> name; field number -> name, scale, offset
_MESSAGES = {
    18: ("session", {253: ("timestamp", 1, 0), 2: ("start_time", 1, 0), 5: ("sport", 1, 0), 6: ("sub_sport", 1, 0), 7: ("total_elapsed_time", 1000, 0), 8: ("total_timer_time", 1000, 0), 9: ("total_distance", 100, 0), 16: ("avg_heart_rate", 1, 0), 17: ("max_heart_rate", 1, 0), 18: ("avg_cadence", 1, 0), 20: ("avg_power", 1, 0), 21: ("max_power", 1, 0), 22: ("total_ascent", 1, 0), 23: ("total_descent", 1, 0), 26: ("num_laps", 1, 0), 34: ("normalized_power", 1, 0), 35: ("training_stress_score", 10, 0), 36: ("intensity_factor", 1000, 0), 45: ("threshold_power", 1, 0), 48: ("total_work", 1, 0)}),
    19: ("lap", {253: ("timestamp", 1, 0), 7: ("total_elapsed_time", 1000, 0), 8: ("total_timer_time", 1000, 0), 9: ("total_distance", 100, 0), 19: ("avg_power", 1, 0)}),
    20: ("record", {253: ("timestamp", 1, 0), 0: ("position_lat", 1, 0), 1: ("position_long", 1, 0), 2: ("altitude", 5, 500), 3: ("heart_rate", 1, 0), 4: ("cadence", 1, 0), 5: ("distance", 100, 0), 6: ("speed", 1000, 0), 7: ("power", 1, 0), 13: ("temperature", 1, 0), 73: ("enhanced_speed", 1000, 0), 78: ("enhanced_altitude", 5, 500)}),
}
#: Seconds from 1970 to the format's own beginning of time.
_EPOCH = 631065600


def decode_fit(data: bytes) -> Iterator[tuple[str, dict[str, float]]]:
    """(message, fields that are present) in file order, for session, lap and record.  Damaged tails end the file."""
    size, at = data[0], data[0]
    end = size + struct.unpack_from("<I", data, 4)[0]
    if data[8:12] != b".FIT":
        raise ValueError("not a FIT file")
    shapes: dict[int, tuple] = {}
    clock = 0
    while at < min(end, len(data)):
        head = data[at]
        at += 1
        if head & 0x80:  # a short header that moves the clock on
            local, offset = head >> 5 & 3, head & 31
            clock = clock - (clock & 31) + offset + (32 if offset < (clock & 31) else 0)
        else:
            local = head & 15
        if not head & 0x80 and head & 0x40:
            order, number, n = "<>"[data[at + 1]], 0, data[at + 4]
            number = struct.unpack_from(order + "H", data, at + 2)[0]
            fields = [tuple(data[at + 5 + 3 * k : at + 8 + 3 * k]) for k in range(n)]
            at += 5 + 3 * n
            extra = 0
            if head & 0x20:
                extra = sum(data[at + 2 + 3 * k] for k in range(data[at]))
                at += 1 + 3 * data[at]
            shapes[local] = (order, number, fields, extra)
            continue
        if local not in shapes:
            return
        order, number, fields, extra = shapes[local]
        name, known = _MESSAGES.get(number, ("", {}))
        found: dict[str, float] = {}
        for field, width, kind in fields:
            code, invalid = _TYPES.get(kind, ("", None))
            if at + width > len(data):
                return
            if code and width == struct.calcsize(code):
                value = struct.unpack_from(order + code, data, at)[0]
                if value != invalid and value == value:
                    if field == 253:
                        clock = value
                    if field in known:
                        key, scale, offset = known[field]
                        found[key] = value / scale - offset if scale != 1 or offset else value
            at += width
        at += extra
        if name:
            if head & 0x80:
                found["timestamp"] = clock
            yield name, found


def read_fit(spark: SparkSession, path: str, message: str = "record") -> DataFrame:
    """ride (the file), seq and every known field of one kind of message; times as timestamps, missing fields null."""
    names = [n for n, _, _ in next(f for m, f in _MESSAGES.values() if m == message).values()]
    schema = "ride string, seq long, " + ", ".join(f"{n} double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ride, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [f for m, f in decode_fit(data) if m == message]
                cols = [pa.array([float(r[n]) if n in r else None for r in rows], pa.float64()) for n in names]
                yield pa.RecordBatch.from_arrays([pa.array([ride] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), *cols], ["ride", "seq", *names])

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
    times = {n: F.timestamp_seconds(F.col(n) + _EPOCH) for n in ("timestamp", "start_time") if n in names}
    return out.withColumns(times).withColumnRenamed("timestamp", "ts")


def decode_tiff(data: bytes) -> dict:
    """Width, height, corner, pixel size, EPSG code and values (NaN for nodata) of a one-band grid: plain, deflated or LZW, with any predictor."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags = {}
    code = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d"}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in code:
            continue
        width = struct.calcsize(code[kind]) * n
        where = at + 10 + 12 * k if width <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        tags[tag] = data[where : where + n] if kind == 2 else struct.unpack_from(f"{order}{n}{code[kind]}", data, where)
    w, h = tags[256][0], tags[257][0]
    form = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]]
    dtype = np.dtype(f"{order}{form}{tags[258][0] // 8}")
    unpack = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress}.get(tags.get(259, (1,))[0])
    if unpack is None:
        raise ValueError(f"compression {tags[259][0]} of a grid is not read")
    predictor = tags.get(317, (1,))[0]
    tw, th = tags.get(322, (w,))[0], tags.get(323, tags.get(278, (h,)))[0]
    offsets, sizes = tags.get(324, tags.get(273)), tags.get(325, tags.get(279))
    grid = np.full((h, w), np.nan, np.float32)
    across = -(-w // tw)
    for k, (o, s) in enumerate(zip(offsets, sizes)):
        r, c = k // across * th, k % across * tw
        part = unpredict(unpack(data[o : o + s]), dtype, tw, predictor)[: h - r, : w - c]
        grid[r : r + len(part), c : c + part.shape[1]] = part
    nodata = tags.get(42113, b"").strip(b"\0 ")
    if nodata:
        grid[grid == np.float32(nodata)] = np.nan
    (sx, sy), (i, j, _, x, y) = tags[33550][:2], tags[33922][:5]
    return {"w": w, "h": h, "px": sx, "py": sy, "x0": x - i * sx, "y0": y + j * sy, "epsg": epsg_code(tags.get(34735, ())), "data": grid.ravel()}


def epsg_code(keys: tuple[int, ...]) -> int:
    """The system that a grid's keys name: the projected one, else the geographic one; without keys degrees."""
    named = {k: v for k, place, _, v in zip(*[iter(keys[4:])] * 4) if place == 0}
    return named.get(3072) or named.get(2048) or 4326


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears the table, 257 ends."""
    out, table, width, held, bits, last = [], [], 9, 0, 0, None
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last is not None:
            table.append(last + entry[:1])
        last = entry
        width = max(9, min(12, (len(table) + 1).bit_length()))
    return b"".join(out)


def unpredict(raw: bytes, dtype: np.dtype, width: int, predictor: int) -> np.ndarray:
    """Rows of ``width`` values; predictor 2 keeps differences along a row, 3 those of a row's bytes by significance."""
    if predictor == 3:
        size = dtype.itemsize
        rows = np.frombuffer(raw, np.uint8)[: len(raw) // (width * size) * width * size].reshape(-1, width * size)
        rows = np.cumsum(rows, 1, dtype=np.uint8).reshape(len(rows), size, width).transpose(0, 2, 1)
        return np.ascontiguousarray(rows).view(dtype.newbyteorder(">")).reshape(len(rows), width)
    part = np.frombuffer(raw, dtype)
    part = part[: len(part) // width * width].reshape(-1, width)
    return np.cumsum(part, 1, dtype=dtype) if predictor == 2 else part


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """Raster tiles in path order, as ``operators.verify`` takes them; holes are null."""
    schema = "tile_id string, x0 double, y0 double, px double, py double, epsg int, h int, w int, data array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = decode_tiff(data)
                values = pa.array(t["data"], pa.float32(), mask=np.isnan(t["data"]))
                yield pa.RecordBatch.from_arrays([pa.array([tile]), *(pa.array([float(t[k])]) for k in ("x0", "y0", "px", "py")), pa.array([t["epsg"]], pa.int32()), pa.array([t["h"]], pa.int32()), pa.array([t["w"]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)], ["tile_id", "x0", "y0", "px", "py", "epsg", "h", "w", "data"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tif").load(path)
    tiles = files.select("path", "content").mapInArrow(run, schema)
    # only the paths are put in order
    return tiles.join(files.select(F.col("path").alias("tile_id"), F.row_number().over(Window.orderBy("path")).alias("path_rank")), "tile_id")
