"""Ranks, correlations, false discovery rates, resampling, metrics, folds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelfurrow.functions.expressions import pearson


def average_rank(value: str, *by: str) -> Column:
    """Ranks from 1, ties with their average."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def correlations(long: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """n, pearson_r and spearman_r (of average ranks over complete pairs) of each group."""
    rows = long.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.withColumn("rx", average_rank(x, *by)).withColumn("ry", average_rank(y, *by))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), pearson(F.col(x), F.col(y)).alias("pearson_r"), pearson(F.col("rx"), F.col("ry")).alias("spearman_r"))


def fdr(table: DataFrame, p: str, *by: str) -> DataFrame:
    """Benjamini-Hochberg q; missing p stay missing and don't count. by: families; without any, the table is one family of few rows."""
    n = F.count(p).over(Window.partitionBy(*by))
    rank = F.rank().over(Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last())) + F.count("*").over(Window.partitionBy(*by, p)) - 1
    q = F.min(F.when(F.col(p).isNotNull(), F.col(p) * n / rank)).over(Window.partitionBy(*by).orderBy(F.col(p).desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return table.withColumn("q", F.when(F.col(p).isNotNull(), F.least(q, F.lit(1.0))))


def top_n(table: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return table.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def best_values(table: DataFrame, by: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Each column's first value that is there, in the order, by group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table.select(*by, *(F.first(c, ignorenulls=True).over(w).alias(c) for c in columns)).distinct()


def describe(long: DataFrame, by: str, v: str) -> DataFrame:
    c = F.col(v)
    return long.groupBy(by).agg(F.count(c).alias("valid_n"), F.count_if(c.isNull()).alias("missing_n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.percentile(c, 0.25).alias("p25"), F.median(c).alias("median"), F.percentile(c, 0.75).alias("p75"), F.max(c).alias("max"), F.count_if(c == 0).alias("zero_n"), F.count_if(c > 0).alias("positive_n"))


def mixed_hash(draw: Column, i: Column) -> Column:
    """A deterministic number for row position i of a draw, the same in any SQL engine."""
    draw, i = draw.cast("long"), i.cast("long")
    return ((i + 1) * (draw * 2654435 + 40503) + (i + 1) * (i + 1) * (draw + 11) * 7919) % 1000003


def bootstrap_rows(rows: DataFrame, draws: int) -> DataFrame:
    """rows: i (0..n-1), n and values; each draw takes n rows with replacement."""
    grid = rows.select("i", "n").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).select("draw", (mixed_hash(F.col("draw"), F.col("i")) % F.col("n")).alias("i"))
    return grid.join(rows, "i")


def permutations(rows: DataFrame, draws: int) -> DataFrame:
    """(draw, i, source): in each draw row i takes the value of row source."""
    grid = rows.select("i").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    return grid.select("draw", "i", (F.row_number().over(Window.partitionBy("draw").orderBy(mixed_hash(F.col("draw"), F.col("i")), "i")) - 1).alias("source"))


def permuted_correlations(rows: DataFrame, draws: int, most: int = 2_000_000) -> DataFrame:
    """(draw, s): the correlation of a with the permuted b of each draw; rows: i (0..n-1), a and b. Each task has the columns
    packed and goes through draws of its own; over most rows, draws are spread as rows."""
    if rows.count() > most:
        g = permutations(rows, draws).join(rows.select("i", "a"), "i").join(rows.select(F.col("i").alias("source"), "b"), "source")
        return g.groupBy("draw").agg(pearson(F.col("a"), F.col("b")).alias("s"))
    tasks = max(1, min(draws, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in batch.columns], ["i", "a", "b"])

    def correlate(held: pa.Table) -> pa.Table:
        i, a, b = (held.column(c).combine_chunks().flatten() for c in ("i", "a", "b"))
        i, there = i.to_numpy(), [x.is_valid().to_numpy(zero_copy_only=False) for x in (a, b)]
        order = np.argsort(i)
        (a, b), (has_a, has_b) = ([y[order] for y in x] for x in ([x.fill_null(0.0).to_numpy() for x in (a, b)], there))
        k, m, task, out = (i[order] + 1) % 1000003, 1000003, held.column("task")[0].as_py(), []
        for draw in range(1 + task, draws + 1, tasks):
            mixed = (k * ((draw * 2654435 + 40503) % m) + k * k % m * ((draw + 11) * 7919 % m)) % m  # mixed_hash
            source = np.argsort(mixed, kind="stable")  # the row that comes at place j takes the value of row j
            both = has_a[source] & has_b
            x, y = a[source][both], b[both]
            s = None
            if len(x) >= 3:
                x, y = x - x.mean(), y - y.mean()
                spread = np.sqrt((x * x).mean()) * np.sqrt((y * y).mean())
                s = None if spread <= 1e-12 else float((x * y).mean() / spread)
            out.append((draw, s))
        return pa.table([pa.array([d for d, _ in out], pa.int32()), pa.array([s for _, s in out], pa.float64())], ["draw", "s"])

    sent = rows.select(F.col("i").cast("long"), F.col("a").cast("double"), F.col("b").cast("double")).mapInArrow(packed, "i array<long>, a array<double>, b array<double>")
    sent = sent.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    return sent.groupBy("task").applyInArrow(correlate, "draw int, s double")


def max_statistic(long: DataFrame, draws: int) -> DataFrame:
    """long: i (0..n-1), feature, value, label (one of each i). The largest abs(r) of all features, the number of draws whose
    largest reaches it, and p; a draw permutes the labels once for all features."""
    labels = long.groupBy("i").agg(F.min("label").alias("y"))
    shuffled = permutations(labels, draws).join(labels.select(F.col("i").alias("source"), "y"), "source").select("draw", "i", "y")
    r = shuffled.join(long.select("i", "feature", "value"), "i").groupBy("draw", "feature").agg(pearson(F.col("value"), F.col("y")).alias("r"))
    best = r.groupBy("draw").agg(F.max(F.abs("r")).alias("s"))
    seen = long.groupBy("feature").agg(pearson(F.col("value"), F.col("label")).alias("r")).agg(F.max(F.abs("r")).alias("o"))
    k = F.count_if(F.col("s") >= F.col("o") - 1e-12)
    return best.crossJoin(F.broadcast(seen)).agg(F.max("o").alias("observed"), k.alias("exceeding"), ((1 + k) / (1 + F.count("*"))).alias("p"))


def classification(rows: DataFrame, by: list[str], truth: str, score: str, threshold: float) -> DataFrame:
    """accuracy, balanced accuracy, F1 and ROC AUC by group."""
    r = rows.withColumn("rank", average_rank(score, *by)).withColumn("hit", (F.col(score) >= threshold).cast("int"))
    t, h = F.col(truth), F.col("hit")
    s = r.groupBy(*by).agg(F.count("*").alias("n"), F.sum(t).alias("pos"), F.count_if((t == 1) & (h == 1)).alias("tp"), F.count_if((t == 0) & (h == 0)).alias("tn"), F.count_if((t == 0) & (h == 1)).alias("fp"), F.sum(F.when(t == 1, F.col("rank"))).alias("ranks"))
    neg = F.col("n") - F.col("pos")
    both = (F.col("pos") > 0) & (neg > 0)
    auc = F.when(both, (F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / F.when(both, F.col("pos") * neg))
    balanced = F.when(both, (F.col("tp") / F.when(both, F.col("pos")) + F.col("tn") / F.when(both, neg)) / 2)
    size = F.col("tp") + F.col("fp") + F.col("pos")
    return s.select(*by, "n", ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"), balanced.alias("balanced_accuracy"), F.when(size > 0, 2.0 * F.col("tp") / F.when(size > 0, size)).otherwise(0.0).alias("f1"), auc.alias("roc_auc"))


def fold_regression(rows: DataFrame, by: list[str], fold: str, x: str, y: str) -> DataFrame:
    """Out-of-fold predictions of one-variable regressions: each fold's line is fitted on all other folds' sums."""
    m = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = m.groupBy(*by, fold).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(x) * F.col(x)).alias("sxx"))
    w = Window.partitionBy(*by)
    rest = sums.select(*by, fold, *((F.sum(c).over(w) - F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx")))
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(spread > 1e-12, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.when(spread > 1e-12, spread)).otherwise(0.0)
    fits = rest.where("n > 0").select(*by, fold, slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("intercept"))
    return m.join(fits, [*by, fold]).withColumn("predicted", F.col("intercept") + F.col("slope") * F.col(x))


def regression_metrics(rows: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), pearson(F.col(y), F.col(p)).alias("pearson_r"))
