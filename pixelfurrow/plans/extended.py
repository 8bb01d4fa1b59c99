"""More queries: zonal and focal contracts, validation, audits, rankings, inference, modelling, maps, files."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from pixelfurrow.functions import expressions as X
from pixelfurrow.functions import geodesy as G
from pixelfurrow.operators import ranking as K
from pixelfurrow.operators import raster as R
from pixelfurrow.operators import spatial as S
from pixelfurrow.operators import stats as T
from pixelfurrow.operators import strict as C
from pixelfurrow.plans.registry import HASH, INDEX_SQL, LONG, NUMBERED, ORACLE_SQL, OVERLAP, QUERIES, RANK, numbered, query, rounded, sd, targets_long
from pixelfurrow.sinks import files as sink
from pixelfurrow.sources import files as source
from pixelfurrow.sources.views import feature_long, pixel_long, points, samples, table

DATES, RADII = ["0418", "0510"], [0.0, 1.0, 4.0]


def fixed(names: str, digits: int = 6) -> str:
    """SQL that rounds columns under their own names."""
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names.split())


def stats_sql(v: str) -> str:
    return (
        f"avg({v}) AS mean, median({v}) AS median, stddev_pop({v}) AS std, min({v}) AS min, max({v}) AS max, "
        f"quantile_cont({v}, 0.25) AS p25, quantile_cont({v}, 0.75) AS p75, nullif(count({v}), 0) AS valid_count"
    )


SEVEN = "mean median std min max p25 p75"
ZONES = f"""
, dims AS (SELECT * FROM samples, (SELECT unnest(['0418', '0510']) AS date), (SELECT unnest([1, 2, 3, 4, 5, 6]) AS band))
, zones AS (
  SELECT s.sample_id, s.date, s.band, r.radius, {stats_sql('p.value')}
  FROM dims s CROSS JOIN (SELECT unnest([1.0::DOUBLE, 4.0::DOUBLE]) AS radius) r
  LEFT JOIN pixel_long p ON p.date = s.date AND p.band = s.band
    AND (p.col + 0.5 - s.x) * (p.col + 0.5 - s.x) + (p.row + 0.5 - s.y) * (p.row + 0.5 - s.y) <= r.radius * r.radius
  GROUP BY ALL
  UNION ALL
  SELECT s.sample_id, s.date, s.band, 0.0::DOUBLE, {stats_sql('p.value')}
  FROM dims s LEFT JOIN pixel_long p ON p.date = s.date AND p.band = s.band AND p.col = least(49, floor(s.x)) AND p.row = floor(s.y)
  GROUP BY ALL
) """


def zones(spark, d):
    """Every sample, date, band and radius, empty buffers too."""
    height = 1 << 40  # samples lie inside the raster, so rows need no upper clamp
    return R.zonal_table(points(spark, d), pixel_long(spark, d), RADII, DATES, [1, 2, 3, 4, 5, 6], height, 50)


@query(ZONES + f"SELECT sample_id, date, band, radius, {fixed(SEVEN)}, valid_count FROM zones")
def zonal_table(spark, d):
    return rounded(zones(spark, d))


@query(ZONES + "SELECT radius, count(*) FILTER (WHERE valid_count < 3) AS low, count(*) FILTER (WHERE valid_count IS NULL) AS empty FROM zones GROUP BY 1")
def low_pixel_warnings(spark, d):
    return R.low_counts(zones(spark, d), 3)


def focal_sql(reach: int) -> str:
    return f"""
, size AS (SELECT max(row) AS h, max(col) AS w FROM pixel_long)
, o AS (SELECT dr, dc FROM range(-{reach}, {reach + 1}) a(dr), range(-{reach}, {reach + 1}) b(dc) WHERE dr * dr + dc * dc <= {reach * reach})
, f AS (SELECT date, band, row + dr AS row, col + dc AS col, value FROM pixel_long, o)
SELECT date, band, row, col, {', '.join(f'round({e.split(" AS ")[0]}, 6) AS {e.split(" AS ")[1]}' for e in _parts())}, count(value) AS valid_count
FROM f, size WHERE row BETWEEN 0 AND h AND col BETWEEN 0 AND w GROUP BY date, band, row, col"""


def _parts() -> list[str]:
    return ["avg(value) AS mean", "median(value) AS median", "stddev_pop(value) AS std", "min(value) AS min", "max(value) AS max", "quantile_cont(value, 0.25) AS p25", "quantile_cont(value, 0.75) AS p75"]


@query(focal_sql(2))
def focal_table(spark, d):
    """All eight statistics of each cell of the raster that has a value within two pixels."""
    p = pixel_long(spark, d)
    size = F.broadcast(p.agg(F.max("row").alias("h"), F.max("col").alias("w")))
    inside = (F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") <= F.col("h")) & (F.col("col") <= F.col("w"))
    return rounded(R.focal_table(p, 2.0).crossJoin(size).where(inside).drop("h", "w"))


@query("SELECT date, band, row, col, x, y, back_col, back_row, x BETWEEN 500 AND 512 AS inside FROM (SELECT *, (500 + (col + 0.5) * 0.5)::DOUBLE AS x, (900 - (row + 0.5) * 0.25)::DOUBLE AS y, col AS back_col, row AS back_row FROM pixel_long WHERE band = 1)")
def affine_round_trip(spark, d):
    """Centres by the geotransform (500, 0.5, 0, 900, 0, -0.25), and back."""
    p = pixel_long(spark, d).where("band = 1").select("date", "band", "row", "col", (500 + (F.col("col") + 0.5) * 0.5).alias("x"), (900 - (F.col("row") + 0.5) * 0.25).alias("y"))
    return p.withColumn("back_col", F.floor((F.col("x") - 500) / 0.5)).withColumn("back_row", F.floor((F.col("y") - 900) / -0.25)).withColumn("inside", F.col("x").between(500, 512))


LON, LAT = "(122.9 + x / 1000)", "(41.5 + y / 1000)"
EAST, NORTH = G.to_utm(LON, LAT, 123.0)
BACK_LON, BACK_LAT = G.from_utm("east", "north", 123.0)


@query(f"SELECT sample_id, round(east, 4) AS east, round(north, 4) AS north, round({BACK_LON}, 8) AS lon, round({BACK_LAT}, 8) AS lat FROM (SELECT sample_id, {EAST} AS east, {NORTH} AS north FROM samples)")
def reprojection(spark, d):
    """Degrees to zone 51 north and back."""
    s = samples(spark, d).select("sample_id", F.expr(EAST).alias("east"), F.expr(NORTH).alias("north"))
    return s.select("sample_id", F.round("east", 4).alias("east"), F.round("north", 4).alias("north"), F.round(F.expr(BACK_LON), 8).alias("lon"), F.round(F.expr(BACK_LAT), 8).alias("lat"))


@query(", b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM samples WHERE t_num > 0) SELECT greatest(0, floor(x0 - 8))::BIGINT AS col0, least(50, ceil(x1 + 8))::BIGINT AS col1, greatest(0, floor(y0 - 8))::BIGINT AS row0, least((SELECT count(*) // 50 FROM part), ceil(y1 + 8))::BIGINT AS row1 FROM b")
def map_window(spark, d):
    """The measured samples' box, 8 pixels wider, in whole pixels of the image."""
    s = samples(spark, d).where("t_num > 0").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    height = table(spark, d, "part").agg((F.count("*") / 50).cast("long").alias("h"))
    least, most = lambda c: F.greatest(F.lit(0), F.floor(F.col(c) - 8)), lambda c, m: F.least(m, F.ceil(F.col(c) + 8))
    return s.crossJoin(F.broadcast(height)).select(least("x0").alias("col0"), most("x1", F.lit(50)).alias("col1"), least("y0").alias("row0"), most("y1", F.col("h")).alias("row1"))


WINDOW = "row BETWEEN 1 AND 20 AND col BETWEEN 5 AND 24"


@query(f"SELECT date, row, col, " + ", ".join(f"max(value) FILTER (WHERE band = {b}) AS b{b}" for b in (1, 2, 3)) + f" FROM pixel_long WHERE band <= 3 AND {WINDOW} GROUP BY ALL HAVING b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL")
def windowed_bands(spark, d):
    """A window of the raster; a pixel is valid where every band is."""
    p = pixel_long(spark, d).where(f"band <= 3 and {WINDOW}")
    wide = p.groupBy("date", "row", "col").pivot("band", [1, 2, 3]).agg(F.first("value")).dropna()
    return wide.select("date", "row", "col", *(F.col(str(b)).alias(f"b{b}") for b in (1, 2, 3)))


@query("SELECT date, band, count(*) AS cells, count(*) FILTER (WHERE value <> 25) AS valid, round(avg(CASE WHEN value <> 25 THEN value END), 6) AS mean FROM pixel_long GROUP BY ALL")
def valid_pixels(spark, d):
    """25 is NoData here; NaN and infinities never count."""
    v = X.missing(F.col("value"), 25.0)
    return rounded(pixel_long(spark, d).groupBy("date", "band").agg(F.count("*").alias("cells"), F.count(v).alias("valid"), F.avg(v).alias("mean")))


GRID = "SELECT date, max(row) AS h, max(col) AS w, count(DISTINCT band) AS bands FROM pixel_long GROUP BY 1"


@query(f", m AS ({GRID}) SELECT a.date AS a, b.date AS b, a.h = b.h AS same_rows, a.w = b.w AS same_cols, a.bands = b.bands AS same_bands, concat_ws(', ', CASE WHEN a.h <> b.h THEN 'rows' END, CASE WHEN a.w <> b.w THEN 'cols' END, CASE WHEN a.bands <> b.bands THEN 'bands' END) AS mismatches FROM m a JOIN m b ON a.date < b.date")
def raster_alignment(spark, d):
    """Which properties of two rasters differ."""
    m = pixel_long(spark, d).groupBy("date").agg(F.max("row").alias("h"), F.max("col").alias("w"), F.count_distinct("band").alias("bands"))
    pair = m.select(*(F.col(c).alias(f"{c}_a") for c in m.columns)).join(m.select(*(F.col(c).alias(f"{c}_b") for c in m.columns)), F.col("date_a") < F.col("date_b"))
    same = {"rows": F.col("h_a") == F.col("h_b"), "cols": F.col("w_a") == F.col("w_b"), "bands": F.col("bands_a") == F.col("bands_b")}
    return pair.select(F.col("date_a").alias("a"), F.col("date_b").alias("b"), *(v.alias(f"same_{k}") for k, v in same.items()), F.concat_ws(", ", *(F.when(~v, F.lit(k)) for k, v in same.items())).alias("mismatches"))


@query("SELECT sample_id, x, y, t_num FROM samples WHERE t_num IS NOT NULL AND t_num <= 1e6")
def measured_samples(spark, d):
    """Real zeros stay; a repeated id or a place that is no number would be an error."""
    s = samples(spark, d).where("t_num is not null")
    return source.checked(s, "t_num", **{"sample_id is not unique": source.repeated("sample_id"), "no samples": F.count("*") == 0}).select("sample_id", "x", "y", "t_num")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE t_num <> floor(t_num)) AS not_whole, count(*) FILTER (WHERE t_num NOT BETWEEN 0 AND 30) AS out_of_range, count(*) FILTER (WHERE t_rat NOT BETWEEN 0 AND 100) AS bad_rate, count(*) FILTER (WHERE abs(t_num / 30 * 100 - t_rat) > 0.005) AS disagreeing, count(*) - count(DISTINCT sample_id) AS repeated_ids FROM samples WHERE t_num IS NOT NULL AND t_rat IS NOT NULL")
def count_rate_violations(spark, d):
    s, n, r = samples(spark, d).where("t_num is not null and t_rat is not null"), F.col("t_num"), F.col("t_rat")
    return s.agg(F.count("*").alias("n"), F.count_if(n != F.floor(n)).alias("not_whole"), F.count_if(~n.between(0, 30)).alias("out_of_range"), F.count_if(~r.between(0, 100)).alias("bad_rate"), F.count_if(F.abs(n / 30 * 100 - r) > 0.005).alias("disagreeing"), (F.count("*") - F.count_distinct("sample_id")).alias("repeated_ids"))


@query(", k AS (SELECT feature FROM feature_long GROUP BY 1 HAVING count(DISTINCT value) >= 2) SELECT feature, count(*) AS n, round(avg(value), 6) AS mean FROM feature_long SEMI JOIN k USING (feature) GROUP BY 1")
def eligible_features(spark, d):
    return rounded(source.eligible(feature_long(spark, d)).groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("SELECT s_suppkey AS id, s_name AS name, round(s_acctbal, 2) AS balance FROM supplier")
def csv_round_trip(spark, d):
    """A table written as CSV with two decimals, and read back by its schema."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a shared folder")
        folder = "file:///tmp/pixelfurrow"
    path = f"{folder.rstrip('/')}/csv-{uuid.uuid4().hex}"
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("double").alias("balance"))
    sink.guard(spark, path, [f"{d}/supplier.parquet"], overwrite=False)
    sink.write_csv(rows, path, decimals=2)
    return source.read_csv(spark, path, f"id {dict(rows.dtypes)['id']}, name string, balance double")


def file_inventory(spark, d):
    return source.inventory(spark, d)


QUERIES["file_inventory"] = file_inventory

FOUR = ["mean", "median", "p25", "p75"]
BOTH = ZONES + ", two AS (SELECT a.sample_id, a.band, a.radius, " + ", ".join(f"a.{s} AS {s}_a, m.{s} AS {s}_m" for s in FOUR) + " FROM zones a JOIN zones m ON a.sample_id = m.sample_id AND a.band = m.band AND a.radius = m.radius AND a.date = '0418' AND m.date = '0510') "
CHANGE = ", change AS (" + " UNION ALL ".join(f"SELECT sample_id, band, radius, '{s}' AS stat, {s}_m - {s}_a AS diff, {sd(f'{s}_m', f'{s}_a')} AS ratio, {sd(f'{s}_m - {s}_a', f'{s}_a')} AS rel FROM two" for s in FOUR) + ") "


@query(BOTH + CHANGE + f"SELECT sample_id, band, radius, stat, {fixed('diff ratio rel')} FROM change")
def temporal_change_table(spark, d):
    """Differences, ratios and relative changes of four statistics at every radius."""
    z = zones(spark, d).unpivot(["sample_id", "date", "band", "radius"], FOUR, "stat", "v").groupBy("sample_id", "band", "radius", "stat").pivot("date", DATES).agg(F.first("v"))
    a, m = F.col("0418"), F.col("0510")
    return rounded(z.select("sample_id", "band", "radius", "stat", (m - a).alias("diff"), X.safe_divide(m, a).alias("ratio"), X.safe_divide(m - a, a).alias("rel")))


WIDE6 = ZONES + ", wide AS (SELECT sample_id, date, radius, stat, " + ", ".join(f"max(v) FILTER (WHERE band = {k}) AS b{k}" for k in range(1, 7)) + " FROM (SELECT sample_id, date, radius, band, unnest(['mean', 'median']) AS stat, unnest([mean, median]) AS v FROM zones) GROUP BY ALL) "


def wide(spark, d):
    z = zones(spark, d).unpivot(["sample_id", "date", "band", "radius"], ["mean", "median"], "stat", "v")
    w = z.groupBy("sample_id", "date", "radius", "stat").pivot("band", [1, 2, 3, 4, 5, 6]).agg(F.first("v"))
    return w.select("sample_id", "date", "radius", "stat", *(F.col(str(k)).alias(f"b{k}") for k in range(1, 7)))


_names = list(INDEX_SQL)


@query(WIDE6 + ", long AS (" + " UNION ALL ".join(f"SELECT sample_id, radius, stat, '{n}' AS name, max(CASE WHEN date = '0418' THEN {e} END) AS a, max(CASE WHEN date = '0510' THEN {e} END) AS m FROM wide GROUP BY ALL" for n, e in INDEX_SQL.items()) + f") SELECT sample_id, radius, stat, name, round(m - a, 6) AS diff, round({sd('m', 'a')}, 6) AS ratio, round({sd('m - a', 'a')}, 6) AS rel FROM long")
def index_change(spark, d):
    """The twelve named indices: differences, ratios and relative changes between dates."""
    b = [F.col(f"b{k}") for k in range(1, 7)]
    w = wide(spark, d).select("sample_id", "date", "radius", "stat", *(e.alias(n) for n, e in X.indices(*b).items()))
    long = w.unpivot(["sample_id", "date", "radius", "stat"], _names, "name", "v").groupBy("sample_id", "radius", "stat", "name").pivot("date", DATES).agg(F.first("v"))
    a, m = F.col("0418"), F.col("0510")
    return rounded(long.select("sample_id", "radius", "stat", "name", (m - a).alias("diff"), X.safe_divide(m, a).alias("ratio"), X.safe_divide(m - a, a).alias("rel")))


PAIRS = [(i, j) for i in range(1, 7) for j in range(i + 1, 7)]


@query(WIDE6 + ", nd AS (" + " UNION ALL ".join(f"SELECT sample_id, date, radius, stat, 'ND_B{i}_B{j}' AS name, {sd(f'b{i} - b{j}', f'b{i} + b{j}')} AS v FROM wide" for i, j in PAIRS) + ") SELECT sample_id, radius, stat, name, round(max(v) FILTER (WHERE date = '0418'), 6) AS april, round(max(v) FILTER (WHERE date = '0510'), 6) AS may, round(max(v) FILTER (WHERE date = '0510') - max(v) FILTER (WHERE date = '0418'), 6) AS diff FROM nd GROUP BY ALL")
def pairwise_change(spark, d):
    """All normalised differences of two bands, of both dates, and their difference."""
    w = wide(spark, d)
    nd = w.select("sample_id", "date", "radius", "stat", *(X.safe_divide(F.col(f"b{i}") - F.col(f"b{j}"), F.col(f"b{i}") + F.col(f"b{j}")).alias(f"ND_B{i}_B{j}") for i, j in PAIRS))
    p = nd.unpivot(["sample_id", "date", "radius", "stat"], [f"ND_B{i}_B{j}" for i, j in PAIRS], "name", "v").groupBy("sample_id", "radius", "stat", "name").pivot("date", DATES).agg(F.first("v"))
    return rounded(p.select("sample_id", "radius", "stat", "name", F.col("0418").alias("april"), F.col("0510").alias("may"), (F.col("0510") - F.col("0418")).alias("diff")))


FEATURE_NAMES = "SELECT t || '_r' || s || '_' || c || '_' || k AS name FROM (SELECT unnest(['0418', '0510', 'diff', 'ratio', 'rel']) AS t) CROSS JOIN (SELECT unnest(['pt', '0p172', '0p3', '1']) AS s) CROSS JOIN (SELECT unnest(['B1', 'B6', 'ND_B2_B5', 'NDVI', 'CI_RE1', 'x']) AS c) CROSS JOIN (SELECT unnest(['mean', 'p25', 'valid_count', 'sum']) AS k)"
_part = lambda k: f"nullif(regexp_extract(name, '{K.FEATURE}', {k}), '')"


def feature_names(spark):
    each = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    rows = spark.range(1).select(each(["0418", "0510", "diff", "ratio", "rel"]).alias("t")).withColumn("s", each(["pt", "0p172", "0p3", "1"])).withColumn("c", each(["B1", "B6", "ND_B2_B5", "NDVI", "CI_RE1", "x"])).withColumn("k", each(["mean", "p25", "valid_count", "sum"]))
    return rows.select(F.concat("t", F.lit("_r"), "s", F.lit("_"), "c", F.lit("_"), "k").alias("name"))


PARSED = f"WITH names AS ({FEATURE_NAMES}), parsed AS (SELECT name, {_part(1)} AS temporal, {_part(2)} AS scale, {_part(3)} AS core, {_part(4)} AS stat FROM names), kinds AS (SELECT *, CASE WHEN stat = 'valid_count' THEN 'count' WHEN regexp_matches(core, '^B[1-6]$') THEN 'band' WHEN starts_with(core, 'ND_B') THEN 'pairwise' WHEN core IS NOT NULL THEN 'index' END AS kind FROM parsed) "


@query(PARSED + "SELECT * FROM kinds")
def feature_parser(spark, d):
    return feature_names(spark).select("name", *K.feature_parts(F.col("name")))


@query(PARSED + ", s AS (SELECT temporal, kind, stat, unnest(['0510', '0418', 'change', 'all', 'two_dates_no_change', 'named_indices']) AS \"set\" FROM kinds WHERE kind <> 'count') SELECT \"set\", count(*) AS n FROM s WHERE CASE \"set\" WHEN 'change' THEN temporal IN ('diff', 'ratio', 'rel') WHEN 'all' THEN true WHEN 'two_dates_no_change' THEN temporal IN ('0418', '0510') WHEN 'named_indices' THEN kind = 'index' AND stat IN ('mean', 'median') ELSE temporal = \"set\" END GROUP BY 1")
def feature_sets(spark, d):
    return K.feature_sets(feature_parser(spark, d)).groupBy("set").agg(F.count("*").alias("n"))


@query("SELECT row, col, CAST(trunc(value * -1.7) AS INTEGER) AS whole FROM pixel_long WHERE band = 1 AND date = '0510'")
def cast_truncation(spark, d):
    """A cast to whole numbers goes towards zero."""
    return pixel_long(spark, d).where("band = 1 and date = '0510'").select("row", "col", (F.col("value") * F.lit(-1.7)).cast("int").alias("whole"))


@query(", q AS (SELECT date, band, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM pixel_long WHERE band <= 3 GROUP BY ALL) SELECT p.date, row, col, " + ", ".join(f"coalesce(max(round(CASE WHEN hi > lo THEN least(1, greatest(0, (value - lo) / (hi - lo))) END, 6)) FILTER (WHERE p.band = {b}), 1) AS c{b}" for b in (1, 2, 3)) + " FROM pixel_long p JOIN q ON p.date = q.date AND p.band = q.band GROUP BY ALL")
def rgb_composite(spark, d):
    """Three bands, each stretched from its 2nd to its 98th percentile; what is missing is white."""
    p = pixel_long(spark, d).where("band <= 3")
    q = F.broadcast(p.groupBy("date", "band").agg(F.percentile("value", 0.02).alias("lo"), F.percentile("value", 0.98).alias("hi")))
    v = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")))))
    w = p.join(q, ["date", "band"]).groupBy("date", "row", "col").pivot("band", [1, 2, 3]).agg(F.first(F.round(v, 6)))
    return w.select("date", "row", "col", *(F.coalesce(str(b), F.lit(1.0)).alias(f"c{b}") for b in (1, 2, 3)))


@query(LONG + "SELECT target, count(v) AS valid_n, count(*) - count(v) AS missing_n, round(min(v), 6) AS min, round(max(v), 6) AS max, count(DISTINCT v) AS unique_n, count(v) - count(DISTINCT v) AS duplicate_n, coalesce(array_to_string(list_sort(list_distinct(list(trunc(v)::BIGINT) FILTER (WHERE v IS NOT NULL))), ';'), '') AS whole_values FROM targets GROUP BY 1")
def target_audit(spark, d):
    return rounded(K.target_audit(targets_long(spark, d), "target", "v"))


@query("SELECT date, band, count(*) AS cells, max(row) + 1 AS height, max(col) + 1 AS width, min(value) AS min, round(quantile_cont(value, 0.01), 6) AS p1, round(median(value), 6) AS median, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max FROM pixel_long GROUP BY ALL")
def image_metadata(spark, d):
    q = F.percentile("value", [0.01, 0.5, 0.99])
    m = pixel_long(spark, d).groupBy("date", "band").agg(F.count("*").alias("cells"), (F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"), F.min("value").alias("min"), q.alias("q"), F.max("value").alias("max"))
    return m.select("date", "band", "cells", "height", "width", "min", *(F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(["p1", "median", "p99"])), "max")


@query(OVERLAP + ", touching AS (SELECT i AS s, area FROM overlap UNION ALL SELECT j, area FROM overlap), t AS (SELECT s, count(*) AS neighbours, max(area) / (pi() * 9) AS largest FROM touching GROUP BY 1), a AS (SELECT count(*) AS n FROM samples) SELECT any_value(a.n) AS samples, count(t.s) AS overlapping, round(count(t.s) / any_value(a.n), 6) AS fraction, round(avg(t.largest), 6) AS mean_largest, max(t.neighbours) AS most_neighbours, CASE WHEN count(t.s) / any_value(a.n) > 0.2 THEN 'high' WHEN count(t.s) > 0 THEN 'moderate' ELSE 'low' END AS risk FROM a LEFT JOIN t ON true")
def scale_audit(spark, d):
    """How buffers of radius 3 overlap, and the risk of a random split."""
    o = S.overlaps(points(spark, d), 3.0)
    t = o.select(F.col("i").alias("s"), "fraction").union(o.select("j", "fraction")).groupBy("s").agg(F.count("*").alias("neighbours"), F.max("fraction").alias("largest"))
    n = F.broadcast(table(spark, d, "supplier").agg(F.count("*").alias("samples")))
    a = t.agg(F.count("*").alias("overlapping"), F.avg("largest").alias("mean_largest"), F.max("neighbours").alias("most_neighbours")).crossJoin(n)
    share = F.col("overlapping") / F.col("samples")
    return rounded(a.select("samples", "overlapping", share.alias("fraction"), "mean_largest", "most_neighbours", K.split_risk(F.lit(3.0), share).alias("risk")))


LONGER = ", long AS (SELECT sample, feature, CASE WHEN (sample + feature) % 97 = 0 AND feature % 5 = 1 THEN NULL ELSE value END AS value FROM feature_long UNION ALL SELECT sample, 100 + feature, value FROM feature_long WHERE feature < 2 UNION ALL SELECT sample, 200, 1.0 FROM feature_long WHERE feature = 0 UNION ALL SELECT sample, 201, 2.0 * label FROM feature_long WHERE feature = 0) "


def longer(spark, d):
    """The features with some gaps, two copies, a constant and a leak."""
    f = feature_long(spark, d)
    gaps = F.when(((F.col("sample") + F.col("feature")) % 97 == 0) & (F.col("feature") % 5 == 1), F.lit(None)).otherwise(F.col("value"))
    one = f.where("feature = 0")
    more = f.where("feature < 2").select("sample", (F.col("feature") + 100).alias("feature"), "value").union(one.select("sample", F.lit(200), F.lit(1.0))).union(one.select("sample", F.lit(201), 2.0 * F.col("label")))
    return f.select("sample", "feature", gaps.alias("value")).union(more)


@query(LONGER + ", f AS (SELECT feature, count(value) AS n, count(DISTINCT value) AS k, string_agg(value::VARCHAR, ',' ORDER BY sample) AS p FROM long GROUP BY 1), r AS (SELECT l.feature, corr(l.value, y.label::DOUBLE) AS r FROM long l JOIN (SELECT DISTINCT sample, label FROM feature_long) y USING (sample) GROUP BY 1), t AS (SELECT count(DISTINCT sample) AS s FROM long) SELECT f.feature, n, s - n AS missing, k AS \"distinct\", n = 0 AS all_missing, n < s AS any_missing, k <= 1 AS constant, k <= 2 AS near_constant, row_number() OVER (PARTITION BY p, n ORDER BY f.feature) > 1 AS duplicate, coalesce(abs(CASE WHEN isfinite(r) THEN r END) >= 0.999999, false) AS leakage FROM f JOIN r USING (feature), t")
def feature_audit(spark, d):
    y = feature_long(spark, d).where("feature = 0").select("sample", F.col("label").cast("double").alias("y"))
    return K.feature_audit(longer(spark, d), y)


GROUPS = "(floor(x / 25) * 2 + floor(y / 20) % 2)::BIGINT"


@query(f"SELECT {GROUPS} AS grp, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, round(avg(t_idx), 6) AS mean, round(stddev_samp(t_idx), 6) AS std, round(min(t_idx), 6) AS min, round(max(t_idx), 6) AS max FROM samples GROUP BY 1")
def spatial_group_summary(spark, d):
    g = F.floor(F.col("x") / 25) * 2 + F.floor(F.col("y") / 20) % 2
    return rounded(points(spark, d).groupBy(g.alias("grp")).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("t_idx").alias("mean"), F.stddev_samp("t_idx").alias("std"), F.min("t_idx").alias("min"), F.max("t_idx").alias("max")))


@query(OVERLAP + ", s AS (SELECT i, j, i % 5 <> j % 5 AS across FROM overlap) SELECT count(*) AS pairs, count(*) FILTER (WHERE across) AS across_pairs, (SELECT count(*) FROM (SELECT i FROM s UNION SELECT j FROM s)) AS touched, (SELECT count(*) FROM (SELECT i FROM s WHERE across UNION SELECT j FROM s WHERE across)) AS across_touched FROM s")
def overlap_summary(spark, d):
    o = S.overlaps(points(spark, d), 3.0).withColumn("across", F.col("i") % 5 != F.col("j") % 5)
    ends = o.select("across", F.explode(F.array("i", "j")).alias("s"))
    touched = ends.agg(F.count_distinct("s").alias("touched"), F.count_distinct(F.when(F.col("across"), F.col("s"))).alias("across_touched"))
    return o.agg(F.count("*").alias("pairs"), F.count_if("across").alias("across_pairs")).crossJoin(touched)


CLASS = f", k AS (SELECT feature, value, c, {RANK.format(by='feature', v='value')} AS rx, {RANK.format(by='feature', v='c')} AS ry FROM (SELECT feature, value, (label % 2)::DOUBLE AS c FROM feature_long)), score AS (SELECT feature, CASE WHEN count(*) >= 5 AND isfinite(corr(rx, ry)) THEN coalesce(abs(corr(rx, ry)), 0) ELSE 0 END AS score FROM k GROUP BY 1) "


def class_scores(spark, d):
    return K.class_score(feature_long(spark, d).withColumn("c", (F.col("label") % 2).cast("double")), "value", "c")


@query(CLASS + "SELECT feature, round(score, 6) AS score FROM score")
def class_score(spark, d):
    return rounded(class_scores(spark, d))


@query(CLASS + "SELECT feature, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, feature) AS INTEGER) AS place FROM score WHERE score > 0 QUALIFY place <= 25")
def classifier_features(spark, d):
    """At most 25 features with a score, ties in the order of columns."""
    s = class_scores(spark, d).where("score > 0").withColumn("g", F.lit(1))
    return rounded(T.top_n(s, ["g"], [F.desc(F.round("score", 9)), F.col("feature")], 25).drop("g"))


SETS = ", scan AS (SELECT label AS target, feature % 4 AS dataset, feature, corr(value, sample::DOUBLE) AS r, avg(value) AS m FROM feature_long GROUP BY ALL) "


def result_rows(spark, d):
    """Result rows of several targets and datasets, some without a score."""
    f = feature_long(spark, d)
    return f.groupBy(F.col("label").alias("target"), (F.col("feature") % 4).alias("dataset"), "feature").agg(X.pearson(F.col("value"), F.col("sample").cast("double")).alias("r"), F.avg("value").alias("m"))


@query(SETS + "SELECT target, dataset, feature, round(r, 6) AS r, CAST(row_number() OVER (PARTITION BY target, dataset ORDER BY round(abs(r), 9) DESC, feature) AS INTEGER) AS place FROM scan QUALIFY place <= 5")
def top_by_dataset(spark, d):
    t = T.top_n(result_rows(spark, d), ["target", "dataset"], [F.desc(F.round(F.abs("r"), 9)), F.col("feature")], 5)
    return rounded(t.select("target", "dataset", "feature", "r", "place"))


@query(SETS + "SELECT target, first(feature ORDER BY round(abs(r), 9) DESC, feature) AS feature, first(CASE WHEN feature % 3 = 0 THEN feature END ORDER BY round(abs(r), 9) DESC, feature) FILTER (WHERE feature % 3 = 0) AS third FROM scan GROUP BY 1")
def best_values(spark, d):
    """Each column's first value that is there in the order of scores; they may come from different rows."""
    s = result_rows(spark, d).withColumn("third", F.when(F.col("feature") % 3 == 0, F.col("feature")))
    return T.best_values(s, ["target"], [F.desc(F.round(F.abs("r"), 9)), F.col("feature")], ["feature", "third"])


@query(SETS + ", s AS (SELECT target, dataset, feature, CASE WHEN feature % 7 = 0 THEN 'infinity'::DOUBLE WHEN feature % 5 = 0 THEN 'nan'::DOUBLE WHEN dataset = 3 THEN NULL ELSE round(r, 9) END AS r2 FROM scan) SELECT target, dataset, feature, round(CASE WHEN isfinite(r2) THEN r2 END, 6) AS r2 FROM s QUALIFY row_number() OVER (PARTITION BY target, dataset ORDER BY CASE WHEN isfinite(r2) THEN r2 END DESC NULLS LAST, feature) = 1")
def best_model(spark, d):
    """The best row of each group; where no score is finite, the first."""
    f = F.col("feature")
    r2 = F.when(f % 7 == 0, F.lit(float("inf"))).when(f % 5 == 0, F.lit(float("nan"))).when(F.col("dataset") == 3, F.lit(None)).otherwise(F.round("r", 9))
    s = K.best_model(result_rows(spark, d).select("target", "dataset", "feature", r2.alias("r2")), ["target", "dataset"], "r2", "feature")
    return rounded(s.withColumn("r2", X.missing(F.col("r2"))))


@query(SETS + "SELECT feature, round(max(abs(r)), 6) AS strongest, count(*) AS targets FROM scan GROUP BY 1 ORDER BY round(max(abs(r)), 9) DESC, feature LIMIT 25")
def top_feature_list(spark, d):
    """25 features over all targets, each once."""
    s = result_rows(spark, d).groupBy("feature").agg(F.max(F.abs("r")).alias("strongest"), F.count("*").alias("targets"))
    return rounded(s.orderBy(F.desc(F.round("strongest", 9)), "feature").limit(25))


@query(", n AS (SELECT count(*) AS n, min(t_idx) AS lo, max(t_idx) AS hi FROM samples), k AS (SELECT *, least(12, greatest(4, n // 3)) AS third, least(12, greatest(5, floor(sqrt(n))::BIGINT)) AS root FROM n) SELECT rule, bins, least(bins - 1, floor((t_idx - lo) / (hi - lo) * bins))::BIGINT AS bin, count(*) AS n FROM (SELECT t_idx, lo, hi, unnest(['third', 'root']) AS rule, unnest([third, root]) AS bins FROM samples, k) GROUP BY ALL")
def histogram_rules(spark, d):
    """Equal bins by either rule, the last one closed."""
    s = points(spark, d)
    b = s.agg(F.count("*").alias("c"), F.min("t_idx").alias("lo"), F.max("t_idx").alias("hi"))
    third, root = F.least(F.lit(12), F.greatest(F.lit(4), F.floor(F.col("c") / 3))), F.least(F.lit(12), F.greatest(F.lit(5), F.floor(F.sqrt("c"))))
    rows = s.crossJoin(F.broadcast(b)).select("t_idx", "lo", "hi", F.explode(F.create_map(F.lit("third"), third, F.lit("root"), root)).alias("rule", "bins"))
    return rows.groupBy("rule", "bins", F.least(F.col("bins") - 1, F.floor((F.col("t_idx") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins"))).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN t_rat <= 25 THEN '0-25' WHEN t_rat <= 50 THEN '25-50' WHEN t_rat <= 75 THEN '50-75' ELSE '75-100' END AS rate_class, count(*) AS n, round(100.0 * count(*) / (SELECT count(t_rat) FROM samples), 6) AS share FROM samples WHERE t_rat IS NOT NULL GROUP BY 1")
def rate_class_shares(spark, d):
    c = QUERIES["rate_classes"](spark, d)
    return rounded(c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("total")))).select("rate_class", "n", (100.0 * F.col("n") / F.col("total")).alias("share")))


@query("SELECT lang, count(*) FILTER (WHERE toxic = 1) AS positive, count(*) FILTER (WHERE toxic = 0) AS negative, least(count(*) FILTER (WHERE toxic = 1), count(*) FILTER (WHERE toxic = 0)) >= 3 AS enough FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def class_balance(spark, d):
    p, n = F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(p.alias("positive"), n.alias("negative"), (F.least(p, n) >= 3).alias("enough"))


@query("SELECT (SELECT count(*) FROM (SELECT s_suppkey, s_acctbal FROM supplier EXCEPT ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 9 <> 0)) AS only_a, (SELECT count(*) FROM (SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 9 <> 0 EXCEPT ALL SELECT s_suppkey, s_acctbal FROM supplier)) AS only_b")
def table_equality(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return K.equal_tables(s, s.where("s_suppkey % 9 <> 0"))


@query("SELECT s.sample_id, t_num, CASE sample_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' END AS label FROM samples s")
def left_lookup(spark, d):
    """A left join with a small dictionary; what it lacks is null."""
    words = F.broadcast(spark.createDataFrame([(0, "low"), (1, "mid")], "k long, label string"))
    s = samples(spark, d)
    return s.join(words, s.sample_id % 3 == words.k, "left").select("sample_id", "t_num", "label")


@query(", a AS (SELECT sample_id FROM samples WHERE sample_id % 2 = 0), b AS (SELECT sample_id FROM samples WHERE sample_id % 3 = 0) SELECT 'either' AS kind, sample_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'only_a', sample_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'both', sample_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def id_sets(spark, d):
    s = samples(spark, d).select("sample_id")
    a, b = s.where("sample_id % 2 = 0"), s.where("sample_id % 3 = 0")
    kind = lambda x, name: x.select(F.lit(name).alias("kind"), "sample_id")
    return kind(a.union(b).distinct(), "either").unionByName(kind(a.subtract(b), "only_a")).unionByName(kind(a.intersect(b), "both"))


@query(", s AS (SELECT greatest(coalesce(t_num, 0), coalesce(t_rat, 0), coalesce(t_idx, 0)) AS top, coalesce(t_num, t_rat, t_idx) AS seen, sample_id FROM (SELECT sample_id, t_num, t_rat, CASE WHEN sample_id % 4 = 0 THEN t_idx END AS t_idx FROM samples)) SELECT sample_id, CASE WHEN seen IS NULL THEN NULL WHEN top > 0 THEN 1 ELSE 0 END AS presence FROM s")
def presence_of_three(spark, d):
    s = samples(spark, d).select("sample_id", "t_num", "t_rat", F.when(F.col("sample_id") % 4 == 0, F.col("t_idx")).alias("t_idx"))
    top = F.greatest("t_num", "t_rat", "t_idx")
    return s.select("sample_id", F.when(top > 0, 1).when(top.isNotNull(), 0).alias("presence"))


OOF = ", m AS (SELECT sample, feature, sample % 5 AS fold, value AS x, label::DOUBLE AS y FROM feature_long WHERE feature = 0), fit AS (SELECT f.fold, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM m a JOIN range(0, 5) f(fold) ON a.fold <> f.fold GROUP BY ALL), oof AS (SELECT row_number() OVER (ORDER BY sample) - 1 AS i, y, intercept + slope * x AS p, count(*) OVER () AS n FROM m JOIN fit USING (fold)) "


def out_of_fold(spark, d):
    """The out-of-fold predictions of one feature, with row positions."""
    m = feature_long(spark, d).where("feature = 0").select("feature", "sample", (F.col("sample") % 5).alias("fold"), F.col("value").alias("x"), F.col("label").cast("double").alias("y"))
    p = T.fold_regression(m, ["feature"], "fold", "x", "y")
    return p.select((F.row_number().over(Window.orderBy("sample")) - 1).alias("i"), "y", F.col("predicted").alias("p"), F.count("*").over(Window.partitionBy()).alias("n"))


@query(OOF + f", k AS (SELECT y, p, {RANK.format(by='n', v='y')} AS ry, {RANK.format(by='n', v='p')} AS rp FROM oof) SELECT count(*) AS n, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(corr(y, p), 6) AS pearson_r, round(corr(ry, rp), 6) AS spearman_r, round(regr_slope(y, p), 6) AS slope, round(regr_intercept(y, p), 6) AS intercept FROM k")
def full_metrics(spark, d):
    return rounded(K.full_metrics(out_of_fold(spark, d).withColumn("g", F.lit(1)), ["g"], "y", "p").drop("g"))


@query(OOF + f", d AS (SELECT draw, y, p FROM (SELECT draw, {HASH} % n AS k FROM oof, range(1, 201) t(draw)) JOIN oof ON oof.i = k), c AS (SELECT draw, CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) END AS r2, sqrt(avg((y - p) ** 2)) AS rmse FROM d GROUP BY 1) SELECT count(r2) AS draws, round(quantile_cont(r2, 0.025), 6) AS r2_low, round(quantile_cont(r2, 0.975), 6) AS r2_high, round(quantile_cont(rmse, 0.025), 6) AS rmse_low, round(quantile_cont(rmse, 0.975), 6) AS rmse_high FROM c")
def metric_intervals(spark, d):
    """Intervals of R2 and RMSE over 200 resamplings of (y, prediction)."""
    c = T.regression_metrics(T.bootstrap_rows(out_of_fold(spark, d), 200), ["draw"], "y", "p")
    return rounded(c.agg(F.count("r2").alias("draws"), *(F.percentile(m, q).alias(f"{m}_{n}") for m in ("r2", "rmse") for n, q in (("low", 0.025), ("high", 0.975)))))


PERMUTED = f", g AS (SELECT draw, i, row_number() OVER (PARTITION BY draw ORDER BY {HASH}, i) - 1 AS source FROM r, range(1, 201) t(draw)) "


@query(NUMBERED + PERMUTED + ", m AS (SELECT draw, x.i % 5 AS fold, x.a AS x, y.b AS y FROM g JOIN r x ON x.i = g.i JOIN r y ON y.i = g.source UNION ALL SELECT 0, i % 5, a, b FROM r), fit AS (SELECT draw, f.fold, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM m JOIN range(0, 5) f(fold) ON m.fold <> f.fold GROUP BY ALL), s AS (SELECT draw, 1 - sum((y - intercept - slope * x) ** 2) / (var_pop(y) * count(*)) AS r2 FROM m JOIN fit USING (draw, fold) GROUP BY 1), o AS (SELECT r2 AS o FROM s WHERE draw = 0) SELECT round(any_value(o), 6) AS observed, count(*) FILTER (WHERE r2 >= o - 1e-12) AS exceeding, round((1.0 + count(*) FILTER (WHERE r2 >= o - 1e-12)) / (1 + count(*)), 6) AS p FROM s, o WHERE draw > 0")
def model_permutation(spark, d):
    """The whole cross-validation is run again on 200 permuted targets."""
    r = numbered(spark, d)
    g = T.permutations(r, 200).join(r.select("i", "a"), "i").join(r.select(F.col("i").alias("source"), "b"), "source").select("draw", "i", "a", "b")
    every = g.union(r.select(F.lit(0), "i", "a", "b")).select("draw", (F.col("i") % 5).alias("fold"), F.col("a").alias("x"), F.col("b").alias("y"))
    s = T.regression_metrics(T.fold_regression(every, ["draw"], "fold", "x", "y"), ["draw"], "y", "predicted").select("draw", "r2")
    o = F.broadcast(s.where("draw = 0").select(F.col("r2").alias("o")))
    k = F.count_if(F.col("r2") >= F.col("o") - 1e-12)
    return rounded(s.where("draw > 0").crossJoin(o).agg(F.max("o").alias("observed"), k.alias("exceeding"), ((1 + k) / (1 + F.count("*"))).alias("p")))


@query(NUMBERED.replace("WHERE feature = 0", "WHERE feature = 0") + f", d AS (SELECT draw, i AS k, {HASH} % n AS i FROM r, range(1, 21) t(draw)), f AS (SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY sample) - 1 AS i, value, label::DOUBLE AS y FROM feature_long), b AS (SELECT draw, feature, value, y FROM d JOIN f USING (i)), k AS (SELECT draw, feature, {RANK.format(by='draw, feature', v='value')} AS rx, {RANK.format(by='draw, feature', v='y')} AS ry FROM b), c AS (SELECT draw, feature, round(abs(corr(rx, ry)), 9) AS s FROM k GROUP BY ALL), p AS (SELECT draw, feature, row_number() OVER (PARTITION BY draw ORDER BY s DESC, feature) AS place FROM c) SELECT feature, round(avg((place <= 1)::INT), 6) AS top1, round(avg((place <= 5)::INT), 6) AS top5, round(avg((place <= 10)::INT), 6) AS top10, CASE WHEN avg((place <= 10)::INT) >= 0.5 THEN 'stable' WHEN avg((place <= 5)::INT) >= 0.3 THEN 'moderate' ELSE 'unstable' END AS stability FROM p GROUP BY 1")
def top_k_frequency(spark, d):
    """How often each feature is among the strongest, over 20 resamplings of the samples, and its label."""
    draws = T.bootstrap_rows(numbered(spark, d).select("i", "n"), 20).select("draw", "i")
    f = feature_long(spark, d)
    place = f.where("feature = 0").select("sample", (F.row_number().over(Window.orderBy("sample")) - 1).alias("i"))
    b = draws.join(f.join(place, "sample").select("i", "feature", "value", F.col("label").cast("double").alias("y")), "i")
    c = T.correlations(b, ["draw", "feature"], "value", "y").select("draw", "feature", F.round(F.abs("spearman_r"), 9).alias("s"))
    p = c.withColumn("place", F.row_number().over(Window.partitionBy("draw").orderBy(F.desc("s"), "feature")))
    q = p.groupBy("feature").agg(*(F.avg((F.col("place") <= k).cast("int")).alias(f"top{k}") for k in (1, 5, 10)))
    return rounded(q.withColumn("stability", K.stability(F.col("top10"), F.col("top5"))))


KNN = ", knn AS (SELECT a.sample_id AS i, b.sample_id AS j FROM samples a JOIN samples b ON a.sample_id <> b.sample_id QUALIFY row_number() OVER (PARTITION BY a.sample_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.sample_id) <= 4), w AS (SELECT i, j FROM knn UNION SELECT j, i FROM knn) "


@query(KNN + f", r AS (SELECT row_number() OVER (ORDER BY sample_id) - 1 AS i, sample_id AS id, t_idx - (SELECT avg(t_idx) FROM samples) AS z FROM samples), g AS (SELECT draw, i, row_number() OVER (PARTITION BY draw ORDER BY {HASH}, i) - 1 AS source FROM r, range(1, 100) t(draw)), v AS (SELECT draw, x.id, y.z FROM g JOIN r x ON x.i = g.i JOIN r y ON y.i = g.source UNION ALL SELECT 0, id, z FROM r), s AS (SELECT a.draw, sum(a.z * b.z) / count(*) / (SELECT avg(z * z) FROM r) AS m FROM w JOIN v a ON a.id = w.i JOIN v b ON b.id = w.j AND b.draw = a.draw GROUP BY 1), o AS (SELECT m AS o, -1.0::DOUBLE / ((SELECT count(*) FROM r) - 1) AS e FROM s WHERE draw = 0) SELECT round(any_value(o), 6) AS moran_i, round((1.0 + count(*) FILTER (WHERE m >= o - 1e-12)) / (1 + count(*)), 6) AS p_greater, round((1.0 + count(*) FILTER (WHERE abs(m - e) >= abs(o - e) - 1e-12)) / (1 + count(*)), 6) AS p_two_sided FROM s, o WHERE draw > 0")
def moran_permutation(spark, d):
    """Moran's I of 99 permutations, one-sided and two-sided."""
    s = points(spark, d)
    mean = F.broadcast(s.agg(F.avg("t_idx").alias("m")))
    r = s.crossJoin(mean).select((F.row_number().over(Window.orderBy("sample_id")) - 1).alias("i"), F.col("sample_id").alias("id"), (F.col("t_idx") - F.col("m")).alias("z"))
    g = T.permutations(r, 99).join(r.select("i", "id"), "i").join(r.select(F.col("i").alias("source"), "z"), "source").select("draw", "id", "z").union(r.select(F.lit(0), "id", "z"))
    w = S.knn_weights(s, 4)
    left, right = g.select(F.col("draw"), F.col("id").alias("i"), F.col("z").alias("zi")), g.select(F.col("draw"), F.col("id").alias("j"), F.col("z").alias("zj"))
    spread = F.broadcast(r.agg(F.avg(F.col("z") * F.col("z")).alias("s2"), (-1 / (F.count("*") - 1)).alias("e")))
    m = w.join(left, "i").join(right, ["draw", "j"]).groupBy("draw").agg((F.sum(F.col("zi") * F.col("zj")) / F.count("*")).alias("c")).crossJoin(spread).select("draw", (F.col("c") / F.col("s2")).alias("m"), "e")
    o = F.broadcast(m.where("draw = 0").select(F.col("m").alias("o")))
    share = lambda c: (1 + F.count_if(c)) / (1 + F.count("*"))
    return rounded(m.where("draw > 0").crossJoin(o).agg(F.max("o").alias("moran_i"), share(F.col("m") >= F.col("o") - 1e-12).alias("p_greater"), share(F.abs(F.col("m") - F.col("e")) >= F.abs(F.col("o") - F.col("e")) - 1e-12).alias("p_two_sided")))


BATTERY = ["t_idx", "x", "y"]


@query(KNN + ", band AS (SELECT a.sample_id AS i, b.sample_id AS j FROM samples a JOIN samples b ON a.sample_id <> b.sample_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 5), ws AS (SELECT 'knn' AS weights, * FROM w UNION ALL SELECT 'band', * FROM band), v AS (SELECT sample_id, unnest(['t_idx', 'x', 'y']) AS variable, unnest([t_idx, x, y]) AS v FROM samples), z AS (SELECT variable, sample_id, v - avg(v) OVER (PARTITION BY variable) AS z FROM v), sq AS (SELECT variable, avg(z * z) AS s2, count(*) AS n FROM z GROUP BY 1) SELECT weights, a.variable, any_value(n) AS n, count(*) AS links, round(sum(a.z * b.z) / count(*) / any_value(s2), 6) AS moran_i, round(-1.0 / (any_value(n) - 1), 6) AS expected_i FROM ws JOIN z a ON a.sample_id = i JOIN z b ON b.sample_id = j AND a.variable = b.variable JOIN sq ON sq.variable = a.variable GROUP BY weights, a.variable")
def moran_battery(spark, d):
    """Every variable under both weightings."""
    s, out = points(spark, d), None
    for name, w in (("knn", S.knn_weights(s, 4)), ("band", S.band_weights(s, 5.0))):
        for v in BATTERY:
            one = S.moran(s.select("sample_id", F.col(v).alias("v")), w).select(F.lit(name).alias("weights"), F.lit(v).alias("variable"), "n", "links", "moran_i", "expected_i")
            out = one if out is None else out.unionByName(one)
    return rounded(out)


@query(", m AS (SELECT sample, sample % 5 AS fold, label::DOUBLE AS y FROM feature_long WHERE feature = 0), f AS (SELECT f.fold, avg(y) AS p FROM m JOIN range(0, 5) f(fold) ON m.fold <> f.fold GROUP BY 1) SELECT count(*) AS n, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae FROM m JOIN f USING (fold)")
def dummy_baseline(spark, d):
    """Each fold's prediction is the mean of all others."""
    m = feature_long(spark, d).where("feature = 0").select(F.lit(1).alias("g"), (F.col("sample") % 5).alias("fold"), F.lit(0.0).alias("x"), F.col("label").cast("double").alias("y"))
    return rounded(T.regression_metrics(T.fold_regression(m, ["g"], "fold", "x", "y"), ["g"], "y", "predicted").select("n", "r2", "rmse", "mae"))


@query(", n AS (SELECT sample_id, row_number() OVER (ORDER BY (sample_id * 7919) % 10007, sample_id) - 1 AS pl, count(*) OVER () AS n FROM samples) SELECT sample_id, CASE WHEN n <= 40 THEN pl ELSE pl % 5 END AS fold FROM n")
def cv_folds(spark, d):
    """Every sample alone where there are few, else five shuffled folds."""
    s = points(spark, d).select("sample_id", (F.row_number().over(Window.orderBy((F.col("sample_id") * 7919) % 10007, "sample_id")) - 1).alias("at"), F.count("*").over(Window.partitionBy()).alias("n"))
    return C.folds(s, "at", "n").select("sample_id", "fold")


@query(LONGER + ", m AS (SELECT feature, median(value) AS middle, count(*) FILTER (WHERE value IS NULL) AS filled FROM long GROUP BY 1), z AS (SELECT l.feature, coalesce(value, middle) AS v, filled FROM long l JOIN m USING (feature)) SELECT feature, any_value(filled) AS filled, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM z GROUP BY 1")
def imputed_features(spark, d):
    """Gaps take their feature's median; then mean and population deviation, by which features are scaled."""
    long = longer(spark, d)
    middle = long.groupBy("feature").agg(F.median("value").alias("middle"), F.count_if(F.col("value").isNull()).alias("filled"))
    z = long.join(middle, "feature").withColumn("v", F.coalesce("value", "middle"))
    return rounded(z.groupBy("feature").agg(F.max("filled").alias("filled"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")))


JOBS = [{"name": "dummy", "model": "dummy"}, {"name": "ols", "model": "ols", "k": 3}, {"name": "ridge", "model": "ridge", "k": 10, "params": {"alpha": 10.0}}, {"name": "lasso", "model": "lasso", "params": {"alpha": 0.02}}, {"name": "elastic_net", "model": "elastic_net", "k": 10, "params": {"alpha": 0.02, "l1_ratio": 0.5}}, {"name": "pls", "model": "pls", "k": 10, "params": {"components": 1}}]


def matrix(spark, d):
    f = feature_long(spark, d).groupBy("sample", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "value"))), lambda p: p["value"]).alias("x"))
    return f.select("sample", (F.col("sample") % 5).cast("int").alias("fold"), F.col("label").cast("double").alias("y"), "x")


def strict_jobs(spark, d):
    """Metrics of six models, everything refitted in each fold."""
    p = C.cross_validated(matrix(spark, d), JOBS)
    return rounded(K.full_metrics(p, ["job"], "y", "predicted"))


def fold_log(spark, d):
    """What each fold of each job learned from and chose."""
    return C.cross_validated(matrix(spark, d), JOBS[:3]).where("log is not null").select("job", "fold", "log")


QUERIES["strict_jobs"] = strict_jobs
QUERIES["fold_log"] = fold_log


MAP = """
, train AS (
  SELECT s.sample_id, s.t_idx / 100 AS y, avg(p.value) AS v FROM samples s
  JOIN pixel_long p ON p.date = '0510' AND p.band = 1 AND (p.col + 0.5 - s.x) * (p.col + 0.5 - s.x) + (p.row + 0.5 - s.y) * (p.row + 0.5 - s.y) <= 9 GROUP BY ALL)
, model AS (SELECT regr_slope(y, v) AS c, regr_intercept(y, v) AS b, min(v) AS lo, max(v) AS hi FROM train)
, cells AS (SELECT row, col, b + c * value AS raw, value BETWEEN lo AND hi AS supported FROM pixel_long, model WHERE date = '0510' AND band = 1) """


def inferred(spark, d):
    """A line fitted to the samples' buffers, over all cells of the raster."""
    p = pixel_long(spark, d).where("date = '0510' and band = 1")
    s = points(spark, d)
    train = S.circle_join(s.select("sample_id", "x", "y", "t_idx"), p, 3.0).groupBy("sample_id", "t_idx").agg(F.avg("value").alias("v")).select((F.col("t_idx") / 100).alias("y"), "v")
    fit = train.agg(F.regr_slope("y", "v").alias("c"), F.regr_intercept("y", "v").alias("b"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    none = F.lit(None).cast("double")
    model = fit.select(F.inline(F.array(F.struct(F.lit("").alias("feature"), F.col("b").alias("coefficient"), none.alias("least"), none.alias("greatest")), F.struct(F.lit("value").alias("feature"), F.col("c").alias("coefficient"), F.col("lo").alias("least"), F.col("hi").alias("greatest")))))
    return R.predicted_map(p.select("row", "col", "value"), model)


@query(MAP + "SELECT row, col, round(raw, 6) AS raw, round(least(100, greatest(0, raw)), 6) AS clipped, supported FROM cells")
def map_inference(spark, d):
    return rounded(inferred(spark, d))


@query(MAP + "SELECT count(raw) AS raw_pixels, count(*) FILTER (WHERE supported) AS supported_pixels, count(*) FILTER (WHERE raw < 0 OR raw > 100) AS outside, count(*) FILTER (WHERE raw < 0) AS clipped_low, count(*) FILTER (WHERE raw > 100) AS clipped_high FROM cells")
def map_counters(spark, d):
    return R.map_counters(inferred(spark, d))


__all__ = ["ORACLE_SQL", "QUERIES"]
