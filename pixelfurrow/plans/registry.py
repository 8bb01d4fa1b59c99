"""All queries of the library by name, with their SQL. Rates and coordinates are rounded to 6 digits in both."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelfurrow.functions import expressions as X
from pixelfurrow.operators import models as M
from pixelfurrow.operators import raster as R
from pixelfurrow.operators import spatial as S
from pixelfurrow.operators import stats as T
from pixelfurrow.sources.views import SQL, feature_long, pixel_long, points, samples, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
RING = [(5.0, 1.0), (40.0, 3.0), (45.0, 30.0), (20.0, 18.0), (3.0, 33.0)]
TARGETS = ["t_num", "t_rat", "t_idx"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (SQL + sql) if sql.lstrip().startswith((",", "SELECT")) else sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def targets_long(spark, d) -> DataFrame:
    return samples(spark, d).unpivot(["sample_id", "x", "y"], TARGETS, "target", "v")


LONG = ", targets AS (SELECT sample_id, x, y, target, v FROM (SELECT sample_id, x, y, unnest(['t_num', 't_rat', 't_idx']) AS target, unnest([t_num, t_rat, t_idx]) AS v FROM samples)) "
NEAR = "(col + 0.5 - x) * (col + 0.5 - x) + (row + 0.5 - y) * (row + 0.5 - y) <= 9"
ZONAL = f", zonal AS (SELECT sample_id, date, band, avg(value) AS mean, median(value) AS median, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, count(*) AS valid_count FROM samples JOIN pixel_long ON {NEAR} GROUP BY ALL) "


def sd(a: str, b: str) -> str:
    return f"CASE WHEN abs({b}) > 1e-6 THEN ({a}) / ({b}) END"


@query(ZONAL + "SELECT sample_id, date, band, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, min, max, round(p25, 6) AS p25, round(p75, 6) AS p75, valid_count FROM zonal")
def zonal_statistics(spark, d):
    return rounded(S.zonal(points(spark, d), pixel_long(spark, d), 3.0))


@query("SELECT sample_id, date, band, round(value, 6) AS value FROM samples JOIN pixel_long ON col = least(49, floor(x)) AND row = floor(y)")
def nearest_pixel(spark, d):
    lowest = 1 << 40  # points lie inside the raster, so its height needn't be counted first
    return rounded(S.nearest_pixel(points(spark, d), pixel_long(spark, d), lowest, 50).select("sample_id", "date", "band", "value"))


def bands(spark, d):
    z = S.zonal(points(spark, d), pixel_long(spark, d), 3.0).where("band <= 6")
    return z.groupBy("sample_id", "date").pivot("band", [1, 2, 3, 4, 5, 6]).agg(F.first("median"))


WIDE = ZONAL + ", wide AS (SELECT sample_id, date, " + ", ".join(f"max(CASE WHEN band = {k} THEN median END) AS b{k}" for k in range(1, 7)) + " FROM zonal WHERE band <= 6 GROUP BY ALL) "
INDEX_SQL = {
    "NDVI": sd("b6 - b3", "b6 + b3"), "GNDVI": sd("b6 - b2", "b6 + b2"), "NDRE1": sd("b6 - b4", "b6 + b4"), "NDRE2": sd("b6 - b5", "b6 + b5"), "RENDVI1": sd("b4 - b3", "b4 + b3"), "RENDVI2": sd("b5 - b3", "b5 + b3"),
    "RVI": sd("b6", "b3"), "DVI": "b6 - b3", "SAVI": sd("1.5 * (b6 - b3)", "b6 + b3 + 0.5"), "EVI": sd("2.5 * (b6 - b3)", "b6 + 6 * b3 - 7.5 * b1 + 1"), "CI_RE1": sd("b6", "b4") + " - 1", "CI_RE2": sd("b6", "b5") + " - 1",
}


@query(WIDE + "SELECT sample_id, date, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in INDEX_SQL.items()) + " FROM wide")
def spectral_indices(spark, d):
    b = bands(spark, d)
    return b.select("sample_id", "date", *(F.round(e, 6).alias(n) for n, e in X.indices(*(F.col(str(k)) for k in range(1, 7))).items()))


@query(ZONAL + f", c AS (SELECT a.sample_id, a.band, a.median AS april, m.median AS may FROM zonal a JOIN zonal m ON a.sample_id = m.sample_id AND a.band = m.band AND a.date = '0418' AND m.date = '0510') SELECT sample_id, band, round(may - april, 6) AS diff, round({sd('may', 'april')}, 6) AS ratio, round({sd('may - april', 'april')}, 6) AS rel FROM c")
def temporal_change(spark, d):
    z = S.zonal(points(spark, d), pixel_long(spark, d), 3.0).groupBy("sample_id", "band").pivot("date", ["0418", "0510"]).agg(F.first("median"))
    a, m = F.col("0418"), F.col("0510")
    return rounded(z.where(a.isNotNull() & m.isNotNull()).select("sample_id", "band", (m - a).alias("diff"), X.safe_divide(m, a).alias("ratio"), X.safe_divide(m - a, a).alias("rel")))


@query(ZONAL + f"SELECT i.sample_id, i.date, i.band AS bi, j.band AS bj, round({sd('i.median - j.median', 'i.median + j.median')}, 6) AS nd FROM zonal i JOIN zonal j ON i.sample_id = j.sample_id AND i.date = j.date AND i.band < j.band AND j.band <= 6")
def pairwise_nd(spark, d):
    b = bands(spark, d)
    pairs = F.array(*(F.struct(F.lit(i).alias("bi"), F.lit(j).alias("bj"), F.col(str(i)).alias("a"), F.col(str(j)).alias("b")) for i, j in combinations(range(1, 7), 2)))
    rows = b.select("sample_id", "date", F.inline(pairs)).where("a is not null and b is not null")
    return rounded(rows.select("sample_id", "date", "bi", "bj", X.safe_divide(F.col("a") - F.col("b"), F.col("a") + F.col("b")).alias("nd")))


@query("SELECT event_id, TRY_CAST(regexp_replace(trim(props->>'$.k'), '[%,，\\s]', '', 'g') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS bad FROM (SELECT event_id, props::JSON AS props FROM events)")
def parse_numbers(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", X.parse_number(F.get_json_object("props", "$.k")).alias("k"), X.parse_number(F.lit("1d")).alias("bad"))


RANK = "rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0"
CORR = f", ranked AS (SELECT feature, value, label, {RANK.format(by='feature', v='value')} AS rx, {RANK.format(by='feature', v='label')} AS ry FROM feature_long), scan AS (SELECT feature, count(*) AS n, corr(value, label) AS pearson_r, corr(rx, ry) AS spearman_r FROM ranked GROUP BY 1) "


def scan(spark, d):
    return T.correlations(feature_long(spark, d).withColumn("label", F.col("label").cast("double")), ["feature"], "value", "label")


@query(CORR + "SELECT feature, n, round(pearson_r, 6) AS pearson_r, round(spearman_r, 6) AS spearman_r FROM scan")
def correlation_scan(spark, d):
    return rounded(scan(spark, d))


@query(CORR + "SELECT feature, n, round(spearman_r, 6) AS spearman_r, CAST(row_number() OVER (ORDER BY round(abs(spearman_r), 9) DESC, feature) AS INTEGER) AS place FROM scan QUALIFY place <= 10")
def top_features(spark, d):
    t = T.top_n(scan(spark, d).withColumn("g", F.lit(1)), ["g"], [F.desc(F.round(F.abs("spearman_r"), 9)), F.col("feature")], 10)
    return rounded(t.select("feature", "n", "spearman_r", "place"))


def correlation_p(spark, d):
    """Two-sided p of Spearman r by the t distribution, and its false discovery rate; few rows, one per feature."""
    return rounded(T.fdr(M.with_p(scan(spark, d), "spearman_r", "n"), "p"), 9)


QUERIES["correlation_p"] = correlation_p


@query(", p AS (SELECT l_orderkey, l_linenumber, l_partkey % 7 AS fam, CASE WHEN l_quantity > 3 THEN (l_partkey % 97) / 100.0::DOUBLE END AS p FROM lineitem), a AS (SELECT fam, p, count(*) AS c FROM p WHERE p IS NOT NULL GROUP BY ALL), b AS (SELECT *, sum(c) OVER (PARTITION BY fam) AS m, sum(c) OVER (PARTITION BY fam ORDER BY p) AS i FROM a), q AS (SELECT fam, p, least(1.0, min(p * m / i) OVER (PARTITION BY fam ORDER BY p DESC)) AS q FROM b) SELECT p.fam, p.p, round(q.q, 6) AS q, count(*) AS n FROM p LEFT JOIN q ON p.fam = q.fam AND p.p = q.p GROUP BY ALL")
def false_discovery(spark, d):
    p = table(spark, d, "lineitem").select((F.col("l_partkey") % 7).alias("fam"), F.when(F.col("l_quantity") > 3, (F.col("l_partkey") % 97) / 100.0).alias("p"))
    return T.fdr(p, "p", "fam").groupBy("fam", "p", F.round("q", 6).alias("q")).agg(F.count("*").alias("n"))


@query(LONG + "SELECT target, count(v) AS valid_n, count(*) - count(v) AS missing_n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS max, count(*) FILTER (WHERE v = 0) AS zero_n, count(*) FILTER (WHERE v > 0) AS positive_n FROM targets GROUP BY 1")
def describe_targets(spark, d):
    return rounded(T.describe(targets_long(spark, d), "target", "v"))


@query("SELECT count(*) AS n, round(corr(t_num, t_rat), 6) AS pearson_r, round(max(abs(t_rat - t_num / 30 * 100)), 6) AS max_error, count(*) FILTER (WHERE abs(t_rat - t_num / 30 * 100) <= 0.02) AS matches, round(median(CASE WHEN t_rat > 0 THEN t_num / t_rat * 100 END), 6) AS total FROM samples WHERE t_num IS NOT NULL AND t_rat IS NOT NULL")
def target_relation(spark, d):
    s = samples(spark, d).where("t_num is not null and t_rat is not null")
    e = F.abs(F.col("t_rat") - F.col("t_num") / 30 * 100)
    return rounded(s.agg(F.count("*").alias("n"), X.pearson(F.col("t_num"), F.col("t_rat")).alias("pearson_r"), F.max(e).alias("max_error"), F.count_if(e <= 0.02).alias("matches"), F.median(F.when(F.col("t_rat") > 0, F.col("t_num") / F.when(F.col("t_rat") > 0, F.col("t_rat")) * 100)).alias("total")))


@query(", c AS (SELECT floor(x) AS px, floor(y / 4) AS py, count(*) AS n FROM samples GROUP BY ALL HAVING count(*) > 1) SELECT coalesce(sum(n), 0)::BIGINT AS duplicate_rows, count(*) AS groups FROM c")
def duplicate_coordinates(spark, d):
    g = samples(spark, d).groupBy(F.floor("x").alias("px"), F.floor(F.col("y") / 4).alias("py")).agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"), F.count("*").alias("groups"))


@query(", f AS (SELECT feature, count(value) AS n, count(DISTINCT value) AS k FROM feature_long GROUP BY 1) SELECT count(*) AS features, count(*) FILTER (WHERE n = 0) AS all_missing, count(*) FILTER (WHERE k <= 1) AS constant, count(*) FILTER (WHERE k <= 2) AS near_constant FROM f")
def feature_quality(spark, d):
    f = feature_long(spark, d).groupBy("feature").agg(F.count("value").alias("n"), F.count_distinct("value").alias("k"))
    return f.agg(F.count("*").alias("features"), F.count_if(F.col("n") == 0).alias("all_missing"), F.count_if(F.col("k") <= 1).alias("constant"), F.count_if(F.col("k") <= 2).alias("near_constant"))


@query(", s AS (SELECT feature, label, count(*) AS n, avg(abs(value)) AS m, max(abs(value)) AS x FROM feature_long GROUP BY ALL) SELECT feature, label, n, round(m, 6) AS mean_abs, round(x, 6) AS max_abs FROM s UNION ALL SELECT feature, NULL, count(*), round(avg(abs(value)), 6), round(max(abs(value)), 6) FROM feature_long GROUP BY 1")
def group_summary(spark, d):
    f = feature_long(spark, d)
    agg = [F.count("*").alias("n"), F.avg(F.abs("value")).alias("mean_abs"), F.max(F.abs("value")).alias("max_abs")]
    return rounded(f.groupingSets([["feature", "label"], ["feature"]], "feature", "label").agg(*agg).select("feature", "label", "n", "mean_abs", "max_abs"))


LENS = "2 * 9 * acos(least(d / 6, 1)) - 0.5 * d * sqrt(greatest(36 - d * d, 0))"
OVERLAP = f", pairs AS (SELECT a.sample_id AS i, b.sample_id AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM samples a JOIN samples b ON a.sample_id < b.sample_id), overlap AS (SELECT i, j, d, CASE WHEN d <= 0 THEN pi() * 9 ELSE {LENS} END AS area FROM pairs WHERE d < 6) "


@query(OVERLAP + "SELECT i, j, round(d, 6) AS distance, round(area, 6) AS area, round(area / (pi() * 9), 6) AS fraction FROM overlap")
def overlap_pairs(spark, d):
    return rounded(S.overlaps(points(spark, d), 3.0))


@query(OVERLAP + ", c AS (SELECT i % 5 AS fold, i AS s, area FROM overlap WHERE i % 5 <> j % 5 UNION ALL SELECT j % 5, j, area FROM overlap WHERE i % 5 <> j % 5) SELECT fold, count(*) AS pairs, count(DISTINCT s) AS touched, round(max(area) / (pi() * 9), 6) AS max_fraction, round(avg(area) / (pi() * 9), 6) AS mean_fraction FROM c GROUP BY 1")
def overlap_by_fold(spark, d):
    o = S.overlaps(points(spark, d), 3.0).where(F.col("i") % 5 != F.col("j") % 5)
    c = o.select((F.col("i") % 5).alias("fold"), F.col("i").alias("s"), "fraction").union(o.select(F.col("j") % 5, F.col("j"), "fraction"))
    return rounded(c.groupBy("fold").agg(F.count("*").alias("pairs"), F.count_distinct("s").alias("touched"), F.max("fraction").alias("max_fraction"), F.avg("fraction").alias("mean_fraction")))


MORAN = ", v AS (SELECT sample_id, t_idx AS v FROM samples), z AS (SELECT sample_id, v - (SELECT avg(v) FROM v) AS z FROM v) SELECT (SELECT count(*) FROM v) AS n, count(*) AS links, round(sum(a.z * b.z) / (count(*) * (SELECT var_pop(v) FROM v)), 6) AS moran_i, round(-1.0 / ((SELECT count(*) FROM v) - 1), 6) AS expected_i FROM w JOIN z a ON a.sample_id = i JOIN z b ON b.sample_id = j"


def target_values(spark, d):
    return points(spark, d).select("sample_id", F.col("t_idx").alias("v"))


@query(", n AS (SELECT a.sample_id AS i, b.sample_id AS j FROM samples a JOIN samples b ON a.sample_id <> b.sample_id QUALIFY row_number() OVER (PARTITION BY a.sample_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.sample_id) <= 4), w AS (SELECT i, j FROM n UNION SELECT j, i FROM n)" + MORAN)
def moran_knn(spark, d):
    return rounded(S.moran(target_values(spark, d), S.knn_weights(points(spark, d), 4)))


@query(", w AS (SELECT a.sample_id AS i, b.sample_id AS j FROM samples a JOIN samples b ON a.sample_id <> b.sample_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 5)" + MORAN)
def moran_band(spark, d):
    return rounded(S.moran(target_values(spark, d), S.band_weights(points(spark, d), 5.0)))


FOCAL = ", o AS (SELECT dr, dc FROM range(-1, 2) a(dr), range(-1, 2) b(dc) WHERE dr * dr + dc * dc <= 1), f AS (SELECT date, band, row + dr AS row, col + dc AS col, median(value) AS median, avg(value) AS mean, count(*) AS n FROM pixel_long, o GROUP BY ALL) "


@query(FOCAL + "SELECT f.date, f.band, f.row, f.col, round(f.median, 6) AS median, round(f.mean, 6) AS mean, f.n FROM f SEMI JOIN pixel_long p ON f.date = p.date AND f.band = p.band AND f.row = p.row AND f.col = p.col")
def focal_statistics(spark, d):
    p, at = pixel_long(spark, d), ["date", "band", "row", "col"]
    f = R.focal_table(p, 1.0).select(*at, "median", "mean", F.col("valid_count").alias("n"))
    return rounded(f.join(p.select(*at), at, "left_semi"))


@query(FOCAL + f"SELECT g.date, g.row, g.col, round({sd('g.median - r.median', 'g.median + r.median')}, 6) AS value FROM f g JOIN f r ON g.date = r.date AND g.row = r.row AND g.col = r.col AND g.band = 2 AND r.band = 3 JOIN pixel_long p ON p.date = g.date AND p.row = g.row AND p.col = g.col AND p.band = 2 JOIN pixel_long q ON q.date = g.date AND q.row = g.row AND q.col = g.col AND q.band = 3 SEMI JOIN pixel_long m ON m.date = g.date AND m.row = g.row AND m.col = g.col AND m.band = 7")
def sensitive_index_map(spark, d):
    p = pixel_long(spark, d)
    f = R.focal_table(p.where("band in (2, 3)"), 1.0).groupBy("date", "row", "col").pivot("band", [2, 3]).agg(F.first("median"))
    g, r = F.col("2"), F.col("3")
    every = p.where("band in (2, 3, 7)").groupBy("date", "row", "col").agg(F.count("*").alias("c")).where("c = 3")  # both bands and the mask have the pixel
    f = f.where(g.isNotNull() & r.isNotNull()).join(every, ["date", "row", "col"], "left_semi")
    return rounded(f.select("date", "row", "col", X.safe_divide(g - r, g + r).alias("value")))


PIF = ", j AS (SELECT s.band, s.row, s.col, s.value AS sunny, c.value AS cloudy FROM pixel_long s JOIN pixel_long c ON s.row = c.row AND s.col = c.col AND s.band = c.band AND s.date = '0510' AND c.date = '0418'), st AS (SELECT band, avg(sunny) AS ms, stddev_pop(sunny) AS ss, avg(cloudy) AS mc, stddev_pop(cloudy) AS sc, count(*) AS n FROM j WHERE (row + col) % 3 = 0 GROUP BY 1) "


def pif(spark, d):
    p = pixel_long(spark, d)
    j = p.where("date = '0510'").select("band", "row", "col", F.col("value").alias("sunny")).join(p.where("date = '0418'").select("band", "row", "col", F.col("value").alias("cloudy")), ["band", "row", "col"])
    st = j.where((F.col("row") + F.col("col")) % 3 == 0).groupBy("band").agg(F.avg("sunny").alias("ms"), F.stddev_pop("sunny").alias("ss"), F.avg("cloudy").alias("mc"), F.stddev_pop("cloudy").alias("sc"), F.count("*").alias("n"))
    scale = X.safe_divide(F.col("ss"), F.col("sc"))
    return p, st.withColumn("scale", scale).withColumn("offset", F.col("ms") - scale * F.col("mc"))


@query(PIF + "SELECT band, n, round(ms, 6) AS mean_sunny, round(ss, 6) AS std_sunny, round(mc, 6) AS mean_cloudy, round(sc, 6) AS std_cloudy, round(ss / sc, 6) AS scale, round(ms - ss / sc * mc, 6) AS \"offset\" FROM st WHERE sc > 1e-6")
def pif_statistics(spark, d):
    return rounded(pif(spark, d)[1].where("sc > 1e-6").select("band", "n", F.col("ms").alias("mean_sunny"), F.col("ss").alias("std_sunny"), F.col("mc").alias("mean_cloudy"), F.col("sc").alias("std_cloudy"), "scale", "offset"))


@query(PIF + "SELECT p.band, row, col, round(least(50, greatest(0, value * ss / sc + ms - ss / sc * mc)), 6) AS value FROM pixel_long p JOIN st ON p.band = st.band WHERE date = '0418' AND sc > 1e-6")
def pif_corrected(spark, d):
    p, st = pif(spark, d)
    v = F.least(F.lit(50.0), F.greatest(F.lit(0.0), F.col("value") * F.col("scale") + F.col("offset")))
    return rounded(p.where("date = '0418'").join(F.broadcast(st.where("sc > 1e-6").select("band", "scale", "offset")), "band").select("band", "row", "col", v.alias("value")))


_edges = [(a, b) for a, b in zip(RING, [*RING[1:], RING[0]], strict=True)]
_crossings = " + ".join(f"CASE WHEN ({a[1]} > row + 0.5) <> ({b[1]} > row + 0.5) AND col + 0.5 < ({b[0]} - {a[0]}) * (row + 0.5 - {a[1]}) / ({b[1]} - {a[1]}) + {a[0]} THEN 1 ELSE 0 END" for a, b in _edges)


@query(f"SELECT date, band, count(*) AS n, round(avg(value), 6) AS mean FROM pixel_long WHERE ({_crossings}) % 2 = 1 GROUP BY ALL")
def polygon_mask(spark, d):
    return rounded(S.in_polygon(pixel_long(spark, d), RING).groupBy("date", "band").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


HASH = "(((i + 1) * (draw * 2654435 + 40503) + (i + 1) * (i + 1) * (draw + 11) * 7919) % 1000003)"
NUMBERED = ", r AS (SELECT row_number() OVER (ORDER BY sample) - 1 AS i, value AS a, label::DOUBLE AS b, count(*) OVER () AS n FROM feature_long WHERE feature = 0)"


def numbered(spark, d):
    """One feature and the label by row position: the resampling operators' input."""
    from pyspark.sql import Window

    r = feature_long(spark, d).where("feature = 0")
    return r.select((F.row_number().over(Window.orderBy("sample")) - 1).alias("i"), F.col("value").alias("a"), F.col("label").cast("double").alias("b"), F.count("*").over(Window.partitionBy()).alias("n"))


@query(NUMBERED + f", d AS (SELECT draw, a, b FROM (SELECT draw, {HASH} % n AS k FROM r, range(1, 51) t(draw)) JOIN r ON r.i = k), k AS (SELECT draw, {RANK.format(by='draw', v='a')} AS ra, {RANK.format(by='draw', v='b')} AS rb FROM d), c AS (SELECT draw, corr(ra, rb) AS s FROM k GROUP BY 1) SELECT count(*) AS draws, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high FROM c")
def bootstrap_spearman(spark, d):
    b = T.correlations(T.bootstrap_rows(numbered(spark, d), 50), ["draw"], "a", "b")
    return rounded(b.agg(F.count("*").alias("draws"), F.percentile("spearman_r", 0.025).alias("low"), F.percentile("spearman_r", 0.975).alias("high")))


@query(NUMBERED + f", g AS (SELECT draw, i, row_number() OVER (PARTITION BY draw ORDER BY {HASH}, i) - 1 AS source FROM r, range(1, 101) t(draw)), c AS (SELECT draw, corr(x.a, y.b) AS s FROM g JOIN r x ON x.i = g.i JOIN r y ON y.i = g.source GROUP BY 1), o AS (SELECT corr(a, b) AS s FROM r) SELECT round(any_value(o.s), 6) AS observed, count(*) FILTER (WHERE abs(c.s) >= abs(o.s) - 1e-12) AS exceeding, round((1.0 + count(*) FILTER (WHERE abs(c.s) >= abs(o.s) - 1e-12)) / (1 + count(*)), 6) AS p FROM c, o")
def permutation_test(spark, d):
    r = numbered(spark, d)
    c = T.permuted_correlations(r.select("i", "a", "b"), 100)
    o = r.agg(X.pearson(F.col("a"), F.col("b")).alias("o"))
    k = F.count_if(F.abs("s") >= F.abs("o") - 1e-12)
    return rounded(c.crossJoin(F.broadcast(o)).agg(F.max("o").alias("observed"), k.alias("exceeding"), ((1 + k) / (1 + F.count("*"))).alias("p")))


@query(", n AS (SELECT sample, row_number() OVER (ORDER BY sample) - 1 AS i, label::DOUBLE AS b FROM feature_long WHERE feature = 0)" + f", g AS (SELECT draw, i, row_number() OVER (PARTITION BY draw ORDER BY {HASH}, i) - 1 AS source FROM n, range(1, 1001) t(draw)), c AS (SELECT draw, feature, corr(value, y.b) AS s FROM g JOIN n x ON x.i = g.i JOIN feature_long f ON f.sample = x.sample JOIN n y ON y.i = g.source GROUP BY 1, 2), m AS (SELECT draw, max(abs(s)) AS s FROM c GROUP BY 1), o AS (SELECT max(abs(s)) AS s FROM (SELECT corr(value, label::DOUBLE) AS s FROM feature_long GROUP BY feature)) SELECT round(any_value(o.s), 6) AS observed, count(*) FILTER (WHERE m.s >= o.s - 1e-12) AS exceeding, round((1.0 + count(*) FILTER (WHERE m.s >= o.s - 1e-12)) / (1 + count(*)), 6) AS p FROM m, o")
def max_statistic_permutation(spark, d):
    """All features, 1,000 draws, one p for the scan (R3)."""
    from pyspark.sql import Window

    long = feature_long(spark, d)
    place = long.where("feature = 0").select("sample", (F.row_number().over(Window.orderBy("sample")) - 1).alias("i"))
    return rounded(T.max_statistic(long.join(place, "sample").select("i", "feature", "value", F.col("label").cast("double").alias("label")), 1000))


PRESENCE = ", pr AS (SELECT d.doc_id, lang, toxic AS truth, (d.n_chars % 1000) / 1000.0::DOUBLE AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id), k AS (SELECT *, " + RANK.format(by="lang", v="score") + " AS rk FROM pr), s AS (SELECT lang, count(*) AS n, sum(truth) AS pos, count(*) FILTER (WHERE truth = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE truth = 0 AND score < 0.5) AS tn, count(*) FILTER (WHERE truth = 0 AND score >= 0.5) AS fp, sum(rk) FILTER (WHERE truth = 1) AS ranks FROM k GROUP BY 1) "


@query(PRESENCE + "SELECT lang, n, round((tp + tn) / n, 6) AS accuracy, round(CASE WHEN pos > 0 AND n > pos THEN (tp / pos + tn / (n - pos)) / 2 END, 6) AS balanced_accuracy, round(CASE WHEN tp + fp + pos > 0 THEN 2.0 * tp / (tp + fp + pos) ELSE 0 END, 6) AS f1, round(CASE WHEN pos > 0 AND n > pos THEN (ranks - pos * (pos + 1) / 2) / (pos * (n - pos)) END, 6) AS roc_auc FROM s")
def classification_metrics(spark, d):
    r = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", F.col("toxic").alias("truth"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"))
    return rounded(T.classification(r, ["lang"], "truth", "score", 0.5))


CV = ", m AS (SELECT feature, sample % 5 AS fold, value AS x, label::DOUBLE AS y FROM feature_long), c AS (SELECT m.feature, m.fold, m.x, m.y, (SELECT 0) AS z FROM m), fit AS (SELECT a.feature, f.fold, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM m a JOIN range(0, 5) f(fold) ON a.fold <> f.fold GROUP BY ALL), p AS (SELECT m.feature, y, intercept + slope * x AS p FROM m JOIN fit ON m.feature = fit.feature AND m.fold = fit.fold) "


@query(CV + "SELECT feature, count(*) AS n, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(corr(y, p), 6) AS pearson_r FROM p GROUP BY 1")
def grouped_cross_validation(spark, d):
    m = feature_long(spark, d).select("feature", (F.col("sample") % 5).alias("fold"), F.col("value").alias("x"), F.col("label").cast("double").alias("y"))
    return rounded(T.regression_metrics(T.fold_regression(m, ["feature"], "fold", "x", "y"), ["feature"], "y", "predicted"))


@query(", b AS (SELECT min(t_idx) AS lo, max(t_idx) AS hi FROM samples) SELECT least(9, floor((t_idx - lo) / (hi - lo) * 10))::BIGINT AS bin, count(*) AS n FROM samples, b GROUP BY 1")
def histogram(spark, d):
    s = samples(spark, d)
    b = F.broadcast(s.agg(F.min("t_idx").alias("lo"), F.max("t_idx").alias("hi")))
    return s.crossJoin(b).groupBy(F.least(F.lit(9), F.floor((F.col("t_idx") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10)).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN t_rat <= 25 THEN '0-25' WHEN t_rat <= 50 THEN '25-50' WHEN t_rat <= 75 THEN '50-75' ELSE '75-100' END AS rate_class, count(*) AS n FROM samples WHERE t_rat IS NOT NULL GROUP BY 1")
def rate_classes(spark, d):
    r = F.col("t_rat")
    return samples(spark, d).where(r.isNotNull()).groupBy(F.when(r <= 25, "0-25").when(r <= 50, "25-50").when(r <= 75, "50-75").otherwise("75-100").alias("rate_class")).agg(F.count("*").alias("n"))


@query(", m AS (SELECT row, col, max(CASE WHEN band = 1 THEN value END) AS a, max(CASE WHEN band = 2 THEN value END) AS b FROM pixel_long WHERE date = '0510' GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL), t AS (SELECT max(x) AS hx, min(x) AS lx FROM (SELECT floor(x) AS x FROM samples)) SELECT row, col, round(3 * a - 2 * b + 20, 6) AS raw, round(least(100, greatest(0, 3 * a - 2 * b + 20)), 6) AS clipped, col BETWEEN lx AND hx AS supported FROM m, t")
def linear_map(spark, d):
    m = pixel_long(spark, d).where("date = '0510' and band in (1, 2)").groupBy("row", "col").pivot("band", [1, 2]).agg(F.first("value")).dropna()
    bounds = F.broadcast(samples(spark, d).agg(F.min(F.floor("x")).alias("lo"), F.max(F.floor("x")).alias("hi")))
    raw = 3 * F.col("1") - 2 * F.col("2") + 20
    return rounded(m.crossJoin(bounds).select("row", "col", raw.alias("raw"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)).alias("clipped"), F.col("col").between(F.col("lo"), F.col("hi")).alias("supported")))


@query("SELECT date, count(*) AS n, round(quantile_cont(value, 0.02), 6) AS low, round(quantile_cont(value, 0.98), 6) AS high FROM pixel_long WHERE row % 2 = 0 AND col % 2 = 0 AND band = 1 GROUP BY 1")
def preview_stretch(spark, d):
    p = pixel_long(spark, d).where("row % 2 = 0 and col % 2 = 0 and band = 1")
    return rounded(p.groupBy("date").agg(F.count("*").alias("n"), F.percentile("value", 0.02).alias("low"), F.percentile("value", 0.98).alias("high")))


@query("SELECT doc_id, toxic, CAST((row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels")
def stratified_folds(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "labels").select("doc_id", "toxic", ((F.row_number().over(Window.partitionBy("toxic").orderBy("doc_id")) - 1) % 5).cast("int").alias("fold"))


@query("SELECT sample_id, CASE WHEN t_rat > 0 OR t_num > 0 THEN 1 WHEN coalesce(t_rat, t_num) IS NULL THEN NULL ELSE 0 END AS presence FROM samples")
def presence(spark, d):
    seen = F.greatest("t_num", "t_rat")
    return samples(spark, d).select("sample_id", F.when(seen > 0, 1).when(seen.isNotNull(), 0).alias("presence"))


@query(", z AS (SELECT feature, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS v, label::DOUBLE AS y FROM feature_long WINDOW w AS (PARTITION BY feature)), f AS (SELECT feature, corr(v, y) ** 2 AS r2, count(*) AS n FROM z GROUP BY 1) SELECT feature, round(r2 / (1 - r2) * (n - 2), 6) AS f, CAST(row_number() OVER (ORDER BY round(r2, 10) DESC, feature DESC) AS INTEGER) AS place FROM f QUALIFY place <= 10")
def select_k_best(spark, d):
    return rounded(M.select_k_best(feature_long(spark, d), 10))


QUERIES["ridge"] = M.ridge_query
QUERIES["elastic_net"] = M.elastic_net_query
QUERIES["random_forest"] = M.random_forest_query
QUERIES["logistic"] = M.logistic_query
QUERIES["spatial_folds"] = M.spatial_folds_query
