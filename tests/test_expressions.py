import math

import pandas as pd
from pyspark.sql import functions as F

from pixelfurrow.functions import expressions as X
from pixelfurrow.operators import models as M
from pixelfurrow.operators import stats as T


def test_parse_number(spark):
    raw = [" 83.33% ", "1,234", "1，234", "-", "N/A", "nan", "1d", ".5", "", None, "1e3", "1_000"]
    out = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "raw string").select(X.parse_number(F.col("raw"))).collect()]
    assert out == [83.33, 1234, 1234, None, None, None, None, 0.5, None, None, 1000, None]


def test_safe_divide_and_missing(spark):
    row = spark.range(1).select(X.safe_divide(F.lit(1.0), F.lit(1e-6)), X.safe_divide(F.lit(1.0), F.lit(2e-6)), X.missing(F.lit(float("nan"))), X.missing(F.lit(-9999.0), -9999.0), X.missing(F.lit(2.0), -9999.0)).first()
    assert row[0] is None and abs(row[1] - 5e5) < 1e-3 and row[2:] == (None, None, 2.0)


def test_lens_and_dms(spark):
    row = spark.range(1).select(X.lens_area(F.lit(0.0), F.lit(1.0)), X.lens_area(F.lit(2.0), F.lit(1.0)), X.lens_area(F.lit(1.0), F.lit(1.0)), X.dms(F.lit(59.99999999), 2, "N", "S"), X.dms(F.lit(-1.5), 2, "N", "S")).first()
    assert abs(row[0] - math.pi) < 1e-12 and row[1] == 0 and abs(row[2] - 1.2283696986) < 1e-9
    assert row[3] == "60°00′00.00″N" and row[4] == "1°30′00.00″S"


def test_fdr_vector(spark):
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, None), (4, 0.03)], "i int, p double")
    assert [None if r.q is None else round(r.q, 9) for r in T.fdr(p, "p").orderBy("i").collect()] == [0.03, 0.04, None, 0.04]


def test_spearman_of_ties_missing_and_constants(spark):
    rows = [(f, None if x is None else float(x), float(y)) for f, xs in {"a": [1, 2, 2, 4, None, 6], "c": [5] * 6, "s": [1, 2] + [None] * 4}.items() for x, y in zip(xs, [3, 1, 4, 4, 5, 9], strict=True)]
    out = {r.f: r for r in T.correlations(spark.createDataFrame(rows, "f string, x double, y double"), ["f"], "x", "y").collect()}
    a = pd.DataFrame({"x": [1, 2, 2, 4, 6], "y": [3, 1, 4, 4, 9]}).rank().corr().iloc[0, 1]
    assert abs(out["a"].spearman_r - a) < 1e-12 and out["c"].spearman_r is None and out["s"].pearson_r is None


def test_p_values():
    assert M.correlation_p(None, 9) is None and M.correlation_p(1.0, 9) == 0 and M.correlation_p(0.5, 2) is None
    assert abs(M.correlation_p(0.5, 3) - 2 / 3) < 1e-12  # one degree of freedom: 1 - 2 asin(r) / pi
    assert abs(M.correlation_p(0.0, 30) - 1) < 1e-12


def test_spatial_folds_are_stable():
    points = pd.DataFrame({"sample_id": range(1, 11), "x": [0, 0.1, 0.2, 50, 50.1, 50.2, 99, 99.1, 99.2, 99.3], "y": [0.0] * 10})
    assert M.spatial_folds(points, 3).spatial_group.tolist() == [0] * 3 + [1] * 3 + [2] * 4
