"""Operators against plain NumPy, round trips of files, and errors."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelfurrow.functions import geodesy
from pixelfurrow.operators import raster, ranking, stats, strict
from pixelfurrow.sinks import files as sink
from pixelfurrow.sources import files as source
from pixelfurrow.sources import geotiff


def test_focal_table_is_the_same_for_all_tile_sizes(spark):
    r = np.random.default_rng(1)
    grid = np.where(r.random((13, 17)) < 0.8, r.integers(0, 50, (13, 17)), np.nan)
    rows = [("d", 1, i, j, float(grid[i, j])) for i in range(13) for j in range(17) if not np.isnan(grid[i, j])]
    pixels = spark.createDataFrame(rows, "date string, band int, row long, col long, value double")
    steps = raster.footprint(2.5, 1.0, 0.5)
    expected = {}
    for i in range(-6, 20):
        for j in range(-6, 24):
            v = [grid[i + a, j + b] for a, b in steps if 0 <= i + a < 13 and 0 <= j + b < 17 and not np.isnan(grid[i + a, j + b])]
            if v:
                expected[i, j] = [np.mean(v), np.median(v), np.std(v), min(v), max(v), np.percentile(v, 25), np.percentile(v, 75), len(v)]
    for tile in (4, 64):
        out = {(x.row, x.col): [x[s] for s in (*raster.STATS, "valid_count")] for x in raster.focal_table(pixels, 2.5, 1.0, 0.5, tile).collect()}
        assert out.keys() == expected.keys()
        for k in out:
            assert out[k] == pytest.approx(expected[k])


def test_geotiff_round_trip(spark, tmp_path):
    r = np.random.default_rng(0)
    bands = r.integers(0, 30000, (3, 70, 45)).astype(np.int32)
    made = geotiff.Raster(bands, (500.0, 0.5, 0.0, 900.0, 0.0, -0.25), -9999.0)
    bands[1, 3, 4] = -9999
    for compress in (True, False):
        for predictor in ("none", "2", "auto"):
            back = geotiff.decode(geotiff.encode(made, compress, predictor))
            assert (back.bands == bands).all() and back.transform == made.transform and back.nodata == -9999
    (tmp_path / "a.tif").write_bytes(geotiff.encode(made))
    rows = geotiff.read_rasters(spark, f"{tmp_path}/a.tif", (2, 3, 4, 5)).collect()
    assert len(rows) == 3 * 20
    one = next(x for x in rows if (x.band, x.row, x.col) == (2, 3, 4))
    assert one.value is None and (one.x, one.y) == (500 + 4.5 * 0.5, 900 - 3.5 * 0.25)
    assert {x.value for x in rows if (x.band, x.row, x.col) == (3, 2, 3)} == {float(bands[2, 2, 3])}
    tiles = geotiff.write_tiles(geotiff.read_rasters(spark, f"{tmp_path}/a.tif").where("band = 1"), 32, made.transform).collect()
    assert len(tiles) == 6
    for t in tiles:
        part = geotiff.decode(bytes(t.content))
        a, b = t.tile_row * 32, t.tile_col * 32
        own = bands[0, a : a + 32, b : b + 32]
        assert (part.bands[0, : own.shape[0], : own.shape[1]] == own).all() and part.transform[0] == 500 + b * 0.5
    with pytest.raises(ValueError):
        geotiff.decode(b"no raster")
    with pytest.raises(ValueError):
        geotiff.encode(made, predictor="7")


def test_reprojection_of_known_places(spark):
    e, n = geodesy.to_utm("lon", "lat", 123.0)
    rows = spark.createDataFrame([(123.0, 0.0), (123.0, 45.0), (126.0, 0.0)], "lon double, lat double").select("lon", "lat", F.expr(e).alias("e"), F.expr(n).alias("n"))
    lon, lat = geodesy.from_utm("e", "n", 123.0)
    out = rows.select("lon", "lat", "e", "n", F.expr(lon).alias("lon2"), F.expr(lat).alias("lat2")).collect()
    assert (out[0].e, out[0].n) == pytest.approx((500000, 0), abs=1e-6)
    assert out[1].n == pytest.approx(4982950.400, abs=1e-3)  # the meridian's arc to 45 degrees, times 0.9996
    assert out[2].e == pytest.approx(833978.557, abs=1e-3)
    for x in out:
        assert (x.lon2, x.lat2) == pytest.approx((x.lon, x.lat), abs=1e-9)


def test_pipeline_models_match_closed_forms():
    r = np.random.default_rng(2)
    x, noise = r.normal(size=(40, 6)), r.normal(size=40)
    y = x @ [3.0, 0, -2, 0, 0, 1] + 5 + 0.1 * noise
    z = (x - x.mean(0)) / x.std(0)
    ridge = strict.Pipeline("ridge", alpha=10.0).fit(x, y)
    c = np.linalg.solve(z.T @ z + 10 * np.eye(6), z.T @ (y - y.mean()))
    assert ridge.predict(x) == pytest.approx(z @ c + y.mean())
    columns, slopes, b = strict.Pipeline("ridge", 2, alpha=10.0).fit(x, y).linear()
    assert columns.tolist() == [0, 2] and x[:, columns] @ slopes + b == pytest.approx(strict.Pipeline("ridge", 2, alpha=10.0).fit(x, y).predict(x), rel=1e-10)
    ols = strict.Pipeline("ols").fit(x, y)
    a = np.hstack([x, np.ones((40, 1))])
    assert ols.predict(x) == pytest.approx(a @ np.linalg.lstsq(a, y, rcond=None)[0])
    for model, l1 in (("lasso", 1.0), ("elastic_net", 0.5)):
        c = strict.Pipeline(model, alpha=0.3, **({} if model == "lasso" else {"l1_ratio": l1})).fit(x, y).coefficients
        slope = -z.T @ (y - y.mean() - z @ c) / 40 + 0.3 * (1 - l1) * c  # the gradient is the penalty's where a coefficient isn't 0
        assert np.where(c != 0, slope + 0.3 * l1 * np.sign(c), np.maximum(np.abs(slope) - 0.3 * l1, 0)) == pytest.approx(np.zeros(6), abs=1e-9)
    full = strict.Pipeline("pls", components=5).fit(x[:, :5], y)  # with all components it is the line of least squares
    assert full.predict(x[:, :5]) == pytest.approx(strict.Pipeline("ols").fit(x[:, :5], y).predict(x[:, :5]))
    w = z.T @ (y - y.mean())
    t = z @ w
    assert strict.Pipeline("pls", components=1).fit(x, y).predict(x) == pytest.approx(y.mean() + t * (t @ (y - y.mean())) / (t @ t))
    holes = x.copy()
    holes[3, 1], holes[:, 4] = np.nan, np.nan
    filled = strict.Pipeline("ols").fit(holes, y)
    assert filled.seen.tolist() == [0, 1, 2, 3, 5] and np.isfinite(filled.predict(holes)).all()


def test_cross_validation_refits_everything_in_each_fold(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(25, 5))
    y = 2 * x[:, 1] + r.normal(size=25) * 0.1
    rows = spark.createDataFrame([(i, i % 4, float(y[i]), [float(v) for v in x[i]]) for i in range(25)], "sample long, fold int, y double, x array<double>")
    out = strict.cross_validated(rows, [{"name": "r", "model": "ridge", "k": 1, "params": {"alpha": 1.0}}]).collect()
    assert len(out) == 25
    for row in out:
        train = np.arange(25) % 4 != row.fold
        model = strict.Pipeline("ridge", 1, alpha=1.0).fit(x[train], y[train])
        assert row.predicted == pytest.approx(model.predict(x[[row["sample"]]])[0])
        if row.log:
            log = json.loads(row.log)
            assert log["selected"] == [1] and log["train_n"] == train.sum() and log["test_n"] == 25 - train.sum()
    few = strict.cross_validated(rows.limit(5), [{"name": "r", "model": "ols"}]).collect()
    assert all(x.predicted is None or np.isnan(x.predicted) for x in few) and any("fewer than 8" in (x.log or "") for x in few)


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a,"b"', 1.234), (2, None, 5.0)], "id long, name string, v double")
    path = f"{tmp_path}/t.csv"
    sink.write_csv(rows, path, decimals=2, files=1)
    assert sorted(tuple(x) for x in source.read_csv(spark, path, "id long, name string, v double").collect()) == [(1, 'a,"b"', 1.23), (2, None, 5.0)]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sink.write_csv(rows, path)
    with pytest.raises(FileExistsError):
        sink.guard(spark, path, [], overwrite=False)
    with pytest.raises(ValueError):
        sink.guard(spark, path, [f"file://{path}"], overwrite=True)
    with pytest.raises(FileNotFoundError, match="nowhere"):
        source.require(spark, path, f"{tmp_path}/nowhere")
    sink.write_manifest(spark, f"{tmp_path}/m.json", {"grid": "3x4", "low": 0.5})
    assert source.reusable(spark, f"{tmp_path}/m.json", {"grid": "3x4", "low": "0.5"})
    assert not source.reusable(spark, f"{tmp_path}/m.json", {"grid": "3x5"}) and not source.reusable(spark, f"{tmp_path}/no.json", {}) and not source.reusable(spark, f"{tmp_path}/m.json", {"other": 1})
    assert sink.markdown(spark.createDataFrame([("a|b", 1.23456), (None, None)], "n string, v double")) == "| n | v |\n| --- | --- |\n| a/b | 1.235 |\n|  |  |"
    found = {x.name: (x.status, x.rows) for x in sink.consistency(spark, {"csv": path, "gone": f"{tmp_path}/gone.csv"}).collect()}
    assert found == {"csv": ("ok", 2), "gone": ("error", None)}
    names = {x.name: x.role for x in source.inventory(spark, str(tmp_path)).collect()}
    assert any(r == "table" for r in names.values()) and not any(n.startswith(".tmp") for n in names)
    points = f"{tmp_path}/p.csv"
    sink.write_csv(spark.createDataFrame([(1, 2.0, 3.0, 0.0), (2, 4.0, 5.0, None)], "sample_id long, x double, y double, t double"), points)
    assert source.read_points(spark, points, ["t"]).count() == 2
    with pytest.raises(ValueError, match="lacks q"):
        source.read_points(spark, points, ["q"])


def test_guards(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 40.0), (3, 1.0, 2.0, None)], "sample_id long, x double, y double, t double")
    assert source.measured_samples(points, "t", 2).count() == 2
    for bad, why in ((points.union(points), "not unique"), (points.withColumn("t", F.col("t") * 3), "0 to 100"), (points.withColumn("x", F.lit(float("inf"))), "finite")):
        with pytest.raises(Exception, match=why):
            source.measured_samples(bad, "t").collect()
    with pytest.raises(Exception, match="not 5"):
        source.measured_samples(points, "t", 5).collect()
    assert source.radii("point, 0.5,1.0, 0") == [0.0, 0.5, 1.0, 0.0] and [source.scale_tag(r) for r in (0, 0.5, 1.0, 10.0, 0.172)] == ["pt", "0p5", "1", "10", "0p172"]
    with pytest.raises(ValueError):
        source.radii("-1")
    with pytest.raises(ValueError):
        raster.predicted_map(spark.createDataFrame([], "row long, col long, a double"), None, 50, 20)


def test_labels_and_best_values(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("v")).first().v
    assert [pick(ranking.split_risk(F.lit(r), F.lit(o))) for r, o in ((0, 0.9), (1, 0.3), (1, 0.1), (1, 0.0))] == ["none", "high", "moderate", "low"]
    assert [pick(ranking.stability(F.lit(a), F.lit(b))) for a, b in ((0.5, 0.0), (0.4, 0.3), (0.4, 0.2))] == ["stable", "moderate", "unstable"]
    rows = spark.createDataFrame([("g", 1, None, 5), ("g", 2, 7, None), ("h", 1, None, None)], "k string, o int, a int, b int")
    assert sorted(tuple(x) for x in stats.best_values(rows, ["k"], [F.col("o")], ["a", "b"]).collect()) == [("g", 7, 5), ("h", None, None)]


def test_linear_models_match_closed_forms(spark):
    """Spark's penalised fits against the normal equations and the optimality of the penalty."""
    from pyspark.ml.functions import array_to_vector

    from pixelfurrow.operators import models

    r = np.random.default_rng(5)
    x = r.normal(size=(60, 4))
    x = (x - x.mean(0)) / x.std(0)
    y = x @ [2.0, 0, -1, 0.5] + 3 + r.normal(size=60) * 0.2
    rows = spark.createDataFrame([(float(b), [float(v) for v in a]) for a, b in zip(x, y, strict=True)], "label double, a array<double>").select("label", array_to_vector("a").alias("features"))
    c = models.linear(rows, 10.0, 0.0).coefficients.toArray()
    assert c == pytest.approx(np.linalg.solve(x.T @ x + 10 * np.eye(4), x.T @ (y - y.mean())), abs=1e-6)
    for l1 in (1.0, 0.5):
        assert models.linear(rows, 0.1, l1).coefficients.toArray() == pytest.approx(strict.descent(x, y - y.mean(), 0.1, l1), abs=1e-4)
    p = [models.correlation_p(v, 10) for v in (0.0, 0.6319, 1.0, None)]
    assert p[0] == pytest.approx(1.0) and p[1] == pytest.approx(0.05, abs=1e-4) and p[2] == 0.0 and p[3] is None
