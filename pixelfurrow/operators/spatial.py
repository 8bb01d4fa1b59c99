"""Joins and aggregates over pixels and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelfurrow.functions.expressions import lens_area

BIN = 8


def circle_join(points: DataFrame, pixels: DataFrame, radius: float) -> DataFrame:
    """Points with the pixels whose centres lie within radius, borders included: an equi-join on bins, then the exact test."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / BIN), F.floor((F.col(c) + radius) / BIN)))
    left = points.withColumn("bx", span("x")).withColumn("by", span("y"))
    right = pixels.withColumn("bx", F.floor(F.col("col") / BIN)).withColumn("by", F.floor(F.col("row") / BIN))
    near = (F.col("col") + 0.5 - F.col("x")) ** 2 + (F.col("row") + 0.5 - F.col("y")) ** 2 <= radius * radius
    return left.join(right, ["bx", "by"]).where(near).drop("bx", "by")


def zonal(points: DataFrame, pixels: DataFrame, radius: float) -> DataFrame:
    """mean, median, population std, min, max, quartiles, count by sample, date and band."""
    v = F.col("value")
    return circle_join(points.select("sample_id", "x", "y"), pixels, radius).groupBy("sample_id", "date", "band").agg(
        F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.percentile(v, 0.25).alias("p25"), F.percentile(v, 0.75).alias("p75"), F.count(v).alias("valid_count"),
    )


def nearest_pixel(points: DataFrame, pixels: DataFrame, height: int, width: int) -> DataFrame:
    at = points.withColumn("col", F.greatest(F.lit(0), F.least(F.lit(width - 1), F.floor("x")))).withColumn("row", F.greatest(F.lit(0), F.least(F.lit(height - 1), F.floor("y"))))
    return at.join(pixels, ["row", "col"])


def overlaps(points: DataFrame, radius: float) -> DataFrame:
    """Pairs of points whose circles overlap: i < j, distance, area, share of a circle. A self-join on bins."""
    size = 2 * radius
    p = points.select(F.col("sample_id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi")).withColumn("bx", F.floor(F.col("xi") / size)).withColumn("by", F.floor(F.col("yi") / size))
    around = F.expr("explode(array(-1, 0, 1))")
    q = points.select(F.col("sample_id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj")).withColumn("sx", around).withColumn("sy", around)
    q = q.withColumn("bx", F.floor(F.col("xj") / size) + F.col("sx")).withColumn("by", F.floor(F.col("yj") / size) + F.col("sy"))
    d = F.sqrt((F.col("xi") - F.col("xj")) ** 2 + (F.col("yi") - F.col("yj")) ** 2)
    pairs = p.join(q, ["bx", "by"]).where("i < j").withColumn("distance", d).where(F.col("distance") < size)
    area = lens_area(F.col("distance"), F.lit(float(radius)))
    return pairs.select("i", "j", "distance", area.alias("area"), (area / (F.pi() * radius * radius)).alias("fraction"))


def band_weights(points: DataFrame, reach: float) -> DataFrame:
    """(i, j, weight 1) of points within reach of each other, both ways."""
    near = overlaps(points, reach / 2 + 1e-9).where(F.col("distance") <= reach)
    return near.select("i", "j").union(near.select(F.col("j"), F.col("i")))


def knn_weights(points: DataFrame, k: int, size: float = 8.0) -> DataFrame:
    """(i, j) with j among i's k nearest (ties to the smaller id), made symmetric.

    Points meet in bins of that size and the eight around, where all points nearer than size are found. A point that has k
    of them is done; the others, few where size suits the points, meet all points, which are broadcast then."""
    p = points.select(F.col("sample_id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    q = points.select(F.col("sample_id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    d = (F.col("xi") - F.col("xj")) ** 2 + (F.col("yi") - F.col("yj")) ** 2
    around, bins = F.expr("explode(array(-1, 0, 1))"), lambda t, a, b: t.withColumn("bx", F.floor(F.col(a) / size)).withColumn("by", F.floor(F.col(b) / size))
    spread = bins(q, "xj", "yj").withColumn("sx", around).withColumn("sy", around).withColumn("bx", F.col("bx") + F.col("sx")).withColumn("by", F.col("by") + F.col("sy"))
    close = bins(p, "xi", "yi").join(spread, ["bx", "by"]).where(F.col("i") != F.col("j")).withColumn("d", d).where(F.col("d") < size * size)
    place = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    near = close.withColumn("k", place).where(F.col("k") <= k).select("i", "j")
    done = near.groupBy("i").agg(F.count("*").alias("c")).where(F.col("c") >= k).select("i")
    rest = p.join(done, "i", "left_anti").join(q, F.col("i") != F.col("j")).withColumn("d", d).withColumn("k", place).where(F.col("k") <= k).select("i", "j")
    both = near.join(done, "i", "left_semi").union(rest)
    return both.union(both.select("j", "i")).distinct()


def moran(values: DataFrame, weights: DataFrame) -> DataFrame:
    """Moran's I of values (sample_id, v) under weights (i, j): n, links, moran_i, expected_i."""
    mean = values.agg(F.avg("v").alias("m"), F.count("v").alias("n"), F.var_pop("v").alias("s2"))
    z = values.crossJoin(F.broadcast(mean)).select("sample_id", (F.col("v") - F.col("m")).alias("z"))
    w = weights.join(z.select(F.col("sample_id").alias("i"), F.col("z").alias("zi")), "i").join(z.select(F.col("sample_id").alias("j"), F.col("z").alias("zj")), "j")
    s = w.agg(F.sum(F.col("zi") * F.col("zj")).alias("cross"), F.count("*").alias("links")).crossJoin(mean)
    ok = (F.col("n") >= 3) & (F.col("links") > 0) & (F.col("s2") > 0)
    return s.select("n", "links", F.when(ok, F.col("cross") / F.when(ok, F.col("links") * F.col("s2"))).alias("moran_i"), (-1 / F.when(F.col("n") > 1, F.col("n") - 1)).alias("expected_i"))


def in_polygon(pixels: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Pixels whose centres lie inside the ring, by ray casting over its edges (as many as the polygon has)."""
    x, y, inside = F.col("col") + 0.5, F.col("row") + 0.5, F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            inside = inside != hit
    return pixels.where(inside)
