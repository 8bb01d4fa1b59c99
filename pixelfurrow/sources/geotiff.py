"""GeoTIFF rasters as long pixel tables, and back: little- and big-endian files in strips or tiles, uncompressed or deflated,
band after band or interleaved, with predictor 1 or 2. Anything else is an error."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the TIFF format: field sizes, tags, sample kinds.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, BANDS, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT, PIXEL_SCALE, TIE_POINT, TRANSFORM, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 42113
KINDS = {1: "u", 2: "i", 3: "f"}


@dataclass
class Raster:
    bands: np.ndarray  # band, row, column
    transform: tuple[float, ...]  # x of the corner, by column, by row, y of the corner, by column, by row
    nodata: float | None


def decode(raw: bytes) -> Raster:
    if raw[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("no TIFF file")
    order = "<" if raw[:2] == b"II" else ">"
    at, tags = struct.unpack_from(order + "I", raw, 4)[0], {}
    for k in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
        place = at + 2 + 12 * k + 8
        if SIZES.get(kind, 1) * n > 4:
            place = struct.unpack_from(order + "I", raw, place)[0]
        tags[tag] = raw[place : place + n] if kind in (2, 7) else struct.unpack_from(f"{order}{n}{CODES[kind]}", raw, place) if kind in CODES else None
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, bands, planar = one(WIDTH, 0), one(HEIGHT, 0), one(BANDS, 1), one(PLANAR, 1)
    if not width or not height or not bands:
        raise ValueError("the raster has no pixels or no bands")
    kind = np.dtype(f"{order}{KINDS[one(FORMAT, 1)]}{one(BITS, 1) // 8}")
    compression, predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
    if compression not in (1, 8, 32946) or predictor not in (1, 2):
        raise ValueError(f"compression {compression} with predictor {predictor} is not supported")
    tiled = TILE_OFFSETS in tags
    w, h = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS, height), height))
    across, down, deep = -(-width // w), -(-height // h), bands if planar == 1 else 1
    out = np.zeros((bands, down * h, across * w), kind.newbyteorder("="))
    for k, (start, size) in enumerate(zip(tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS], strict=True)):
        data = raw[start : start + size]
        part = np.frombuffer(data if compression == 1 else zlib.decompress(data), kind)
        part = part.reshape(-1, w, deep).astype(out.dtype)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=out.dtype)
        band, rest = divmod(k, across * down)
        r, c = divmod(rest, across)
        for d in range(deep):
            out[band + d, r * h : r * h + len(part), c * w : (c + 1) * w] = part[:, :, d]
    if TRANSFORM in tags:
        m = tags[TRANSFORM]
        transform = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif PIXEL_SCALE in tags and TIE_POINT in tags:
        (sx, sy, _), (i, j, _, x, y, _) = tags[PIXEL_SCALE], tags[TIE_POINT][:6]
        transform = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    else:
        raise ValueError("the raster has no geotransform")
    if transform[2] or transform[4]:
        raise ValueError("the raster is rotated")
    if not transform[1] or not transform[5]:
        raise ValueError("the geotransform can't be inverted")
    text = tags.get(NODATA)
    return Raster(out[:, :height, :width], transform, float(text.rstrip(b"\0 ")) if text else None)


def encode(raster: Raster, compress: bool = True, predictor: str = "none", rows: int = 64) -> bytes:
    """A little-endian TIFF in strips, band after band. predictor: none, 2, or auto (2 for whole numbers)."""
    bands, height, width = raster.bands.shape
    data = raster.bands.astype(raster.bands.dtype.newbyteorder("<"))
    if predictor not in ("none", "2", "auto"):
        raise ValueError(f"predictor {predictor}")
    two = predictor == "2" or (predictor == "auto" and data.dtype.kind in "iu")
    strips = []
    for band in data:
        for a in range(0, height, rows):
            part = band[a : a + rows]
            part = np.diff(part, axis=1, prepend=part.dtype.type(0)).astype(part.dtype) if two else part
            strips.append(zlib.compress(part.tobytes()) if compress else part.tobytes())
    x, sx, _, y, _, sy = raster.transform
    fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [data.dtype.itemsize * 8] * bands), (COMPRESSION, 3, [8 if compress else 1]), (PHOTOMETRIC, 3, [1]), (OFFSETS, 4, [0] * len(strips)), (BANDS, 3, [bands]), (ROWS, 4, [rows]), (COUNTS, 4, [len(s) for s in strips]), (PLANAR, 3, [2]), (PREDICTOR, 3, [2 if two else 1]), (FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[data.dtype.kind]] * bands), (PIXEL_SCALE, 12, [sx, -sy, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, x, y, 0.0])]
    if raster.nodata is not None:
        fields.append((NODATA, 2, f"{raster.nodata:.17g}".encode() + b"\0"))
    at, heap = 8 + 2 + 12 * len(fields) + 4, b""
    size = sum(n for _, k, v in fields if (n := len(v) * SIZES[k]) > 4)
    starts = (np.cumsum([0, *map(len, strips)])[:-1] + at + size).tolist()
    head = struct.pack("<2sHIH", b"II", 42, 8, len(fields))
    for tag, kind, values in fields:
        values = starts if tag == OFFSETS else values
        body = bytes(values) if kind == 2 else struct.pack(f"<{len(values)}{CODES[kind]}", *values)
        head += struct.pack("<HHI", tag, kind, len(values))
        if len(body) <= 4:
            head += body.ljust(4, b"\0")
        else:
            head, heap = head + struct.pack("<I", at + len(heap)), heap + body
    return head + struct.pack("<I", 0) + heap + b"".join(strips)


def read_rasters(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """path, band, row, col, x, y (of the centre), value (null for NoData and non-finite ones) of the files at path; window: first
    row, first column, rows, columns. A task holds one file at a time."""

    def rows(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raster = decode(raw)
                g, (_, height, width) = raster.transform, raster.bands.shape
                a, b, h, w = window or (0, 0, height, width)
                row, col = np.mgrid[max(a, 0) : min(a + h, height), max(b, 0) : min(b + w, width)].reshape(2, -1)
                for k, band in enumerate(raster.bands, 1):
                    v = band[row, col].astype(float)
                    bad = ~np.isfinite(v) | (v == raster.nodata if raster.nodata is not None else False)
                    n = len(v)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.full(n, k, np.int32)), pa.array(row), pa.array(col), pa.array(g[0] + (col + 0.5) * g[1]), pa.array(g[3] + (row + 0.5) * g[5]), pa.array(v, mask=bad)], ["path", "band", "row", "col", "x", "y", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", F.col("content"))
    return files.mapInArrow(rows, "path string, band int, row long, col long, x double, y double, value double")


def write_tiles(pixels: DataFrame, tile: int, transform: tuple[float, ...], nodata: float = -9999.0) -> DataFrame:
    """Files of tiles: tile_row, tile_col, content (a float32 GeoTIFF); pixels: band, row, col, value. Missing cells hold nodata."""

    def make(rows: pa.Table) -> pa.Table:
        band, row, col = (rows.column(c).to_numpy().astype(int) for c in ("band", "row", "col"))
        value = rows.column("value").to_numpy()
        r, c = rows.column("tile_row")[0].as_py(), rows.column("tile_col")[0].as_py()
        out = np.full((band.max(), tile, tile), nodata, np.float32)
        out[band - 1, row - r * tile, col - c * tile] = np.where(np.isfinite(value), value, nodata)
        g = (transform[0] + c * tile * transform[1], transform[1], 0.0, transform[3] + r * tile * transform[5], 0.0, transform[5])
        return pa.table([pa.array([r], pa.int64()), pa.array([c], pa.int64()), pa.array([encode(Raster(out, g, nodata))], pa.binary())], ["tile_row", "tile_col", "content"])

    keyed = pixels.withColumn("tile_row", F.floor(F.col("row") / tile)).withColumn("tile_col", F.floor(F.col("col") / tile))
    return keyed.groupBy("tile_row", "tile_col").applyInArrow(make, "tile_row long, tile_col long, content binary")
