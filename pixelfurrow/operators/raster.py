"""Zonal statistics to the letter, focal statistics by tiles with a halo, map inference."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelfurrow.operators.spatial import circle_join, nearest_pixel

STATS = ["mean", "median", "std", "min", "max", "p25", "p75"]
TILE = 64


def summaries(v: Column) -> list[Column]:
    """The seven statistics, and the count; all are null where there is no value."""
    n = F.count(v)
    return [F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, 0.25).alias("p25"), F.percentile(v, 0.75).alias("p75"), F.when(n > 0, n).alias("valid_count")]


def zonal_table(points: DataFrame, pixels: DataFrame, radii: list[float], dates: list[str], bands: list[int], height: int, width: int) -> DataFrame:
    """sample_id, date, band, radius and the statistics of each buffer, empty ones too (all null). Radius 0 is the pixel under
    the point. One range join with the largest radius serves all radii."""
    p, reach = points.select("sample_id", "x", "y"), max([r for r in radii if r > 0], default=0.0)
    some, key = pixels.where(F.col("date").isin(dates) & F.col("band").isin(bands)), ["sample_id", "date", "band"]
    parts = []
    if reach:
        square = (F.col("col") + 0.5 - F.col("x")) ** 2 + (F.col("row") + 0.5 - F.col("y")) ** 2
        around = F.filter(F.array(*(F.lit(float(r)) for r in radii if r > 0)), lambda r: square <= r * r)
        parts.append(circle_join(p, some, reach).select(*key, F.explode(around).alias("radius"), "value"))
    if 0 in radii:
        parts.append(nearest_pixel(p, some, height, width).select(*key, F.lit(0.0).alias("radius"), "value"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    found = found.groupBy(*key, "radius").agg(*summaries(F.col("value")))
    each = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    grid = p.select("sample_id", each(dates).alias("date")).withColumn("band", each(bands)).withColumn("radius", each([float(r) for r in radii]))
    return grid.join(found, [*key, "radius"], "left")


def low_counts(zones: DataFrame, least: int) -> DataFrame:
    """Buffers with some pixels but fewer than least, by radius."""
    n = F.col("valid_count")
    return zones.groupBy("radius").agg(F.count_if((n > 0) & (n < least)).alias("low"), F.count_if(n.isNull()).alias("empty"))


def footprint(radius: float, dx: float, dy: float) -> list[tuple[int, int]]:
    """Row and column steps whose metric distance is at most radius; the centre is always one."""
    ky, kx = int(radius / dy), int(radius / dx)
    return [(r, c) for r in range(-ky, ky + 1) for c in range(-kx, kx + 1) if (r * dy) ** 2 + (c * dx) ** 2 <= radius * radius]


def neighbourhoods(grid: np.ndarray, steps: list[tuple[int, int]], halo: int) -> np.ndarray:
    """The statistics and the count of each inner cell of a grid with that halo; NaN is no value."""
    h, w = grid.shape[0] - 2 * halo, grid.shape[1] - 2 * halo
    out = np.empty((8, h, w))
    band = max(1, (4 << 20) // max(1, len(steps) * w))  # rows at once: a large footprint takes few
    for a in range(0, h, band):
        b = min(h, a + band)
        x = np.sort(np.stack([grid[halo + a + r : halo + b + r, halo + c : halo + c + w] for r, c in steps]), axis=0)  # NaN last
        n = np.count_nonzero(~np.isnan(x), axis=0)
        safe, low = np.maximum(n, 1), np.nan_to_num(x)
        mean = low.sum(0) / safe

        def at(q, x=x, safe=safe):
            place = q * (safe - 1)
            i = np.floor(place).astype(int)[None]
            lower, upper = np.take_along_axis(x, i, 0)[0], np.take_along_axis(x, np.minimum(i + 1, safe - 1), 0)[0]
            return lower + (upper - lower) * (place - i[0])

        std = np.sqrt((np.where(np.isnan(x), 0.0, x - mean) ** 2).sum(0) / safe)
        out[:, a:b] = [mean, at(0.5), std, x[0], at(1.0), at(0.25), at(0.75), n]
        out[:7, a:b][:, n == 0] = np.nan
    return out


def focal_table(pixels: DataFrame, radius: float, dx: float = 1.0, dy: float = 1.0, tile: int = TILE, by: tuple[str, ...] = ("date", "band")) -> DataFrame:
    """The statistics and valid_count of the pixels within radius of each cell that has a value within radius, by `by`; cells are
    row, col, from 0 up, and may lie beyond the outermost pixels.

    Pixels go to their tile and to those whose halo they are in, one exchange; a task holds a tile with its halo and a few rows'
    neighbourhoods, so large footprints need no larger shuffle than the halo."""
    steps = footprint(radius, dx, dy)
    halo = max(max(abs(r), abs(c)) for r, c in steps)
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)))
    keyed = pixels.select(*by, "row", "col", F.col("value").cast("double")).withColumn("tile_row", near("row")).withColumn("tile_col", near("col"))

    def make(rows: pa.Table) -> pa.Table:
        r0, c0 = (rows.column(c)[0].as_py() * tile for c in ("tile_row", "tile_col"))
        grid = np.full((tile + 2 * halo, tile + 2 * halo), np.nan)
        grid[rows.column("row").to_numpy() - r0 + halo, rows.column("col").to_numpy() - c0 + halo] = rows.column("value").to_numpy()
        out = neighbourhoods(grid, steps, halo)
        r, c = np.nonzero(out[7])
        keys = [pa.array([rows.column(k)[0].as_py()] * len(r), rows.column(k).type) for k in by]
        return pa.table([*keys, pa.array(r + r0), pa.array(c + c0), *(pa.array(x[r, c]) for x in out[:7]), pa.array(out[7][r, c].astype(np.int64))], [*by, "row", "col", *STATS, "valid_count"])

    kinds = dict(pixels.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), "row long, col long", *(f"{s} double" for s in STATS), "valid_count long"])
    return keyed.groupBy(*by, "tile_row", "tile_col").applyInArrow(make, schema)


def predicted_map(cells: DataFrame, model: DataFrame, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """raw, clipped, supported of each cell (row, col and a column a feature) by a linear model: rows (feature, coefficient,
    least, greatest), the intercept under the feature ''. A cell that lacks a feature has no prediction."""
    if not 0 <= low < high <= 100:
        raise ValueError(f"bounds {low}, {high}")
    features = [c for c in cells.columns if c not in ("row", "col")]
    pick = lambda name, value: F.max(F.when(F.col("feature") == name, F.col(value)))
    one = model.agg(pick("", "coefficient").alias("_b"), *(x for k, f in enumerate(features) for x in (pick(f, "coefficient").alias(f"_c{k}"), pick(f, "least").alias(f"_l{k}"), pick(f, "greatest").alias(f"_g{k}"))))
    raw, inside = F.col("_b"), F.lit(True)
    for k, f in enumerate(features):
        raw, inside = raw + F.col(f"_c{k}") * F.col(f), inside & F.col(f).between(F.col(f"_l{k}"), F.col(f"_g{k}"))
    out = cells.crossJoin(F.broadcast(one)).select("row", "col", raw.alias("raw"), inside.alias("supported"))
    return out.select("row", "col", "raw", F.when(F.col("raw").isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), F.col("raw")))).alias("clipped"), "supported")


def map_counters(cells: DataFrame, low: float = 0.0, high: float = 100.0) -> DataFrame:
    raw = F.col("raw")
    return cells.agg(F.count(raw).alias("raw_pixels"), F.count_if(raw.isNotNull() & F.col("supported")).alias("supported_pixels"), F.count_if((raw < 0) | (raw > 100)).alias("outside"), F.count_if(raw < low).alias("clipped_low"), F.count_if(raw > high).alias("clipped_high"))
