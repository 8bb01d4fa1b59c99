"""Pixels, samples and features as long tables, derived from the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixel_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, row, col, band, value: one row for each pixel, date and band that has a value."""
    lines = table(spark, sf_dir, "lineitem")
    key = [F.when(F.col("l_linestatus") == "F", "0418").otherwise("0510").alias("date"), F.expr("l_partkey div 50").alias("row"), (F.col("l_partkey") % WIDTH).alias("col"), F.col("l_linenumber").alias("band")]
    return lines.groupBy(*key).agg((F.sum("l_quantity") / F.count("*")).alias("value"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, x, y, t_idx: the field points without the targets that are counted from lines, so that these aren't read."""
    rows = table(spark, sf_dir, "part").agg((F.count("*") / WIDTH).cast("long").alias("n_rows"))
    return table(spark, sf_dir, "supplier").crossJoin(F.broadcast(rows)).select(
        (F.col("s_suppkey") + 1).alias("sample_id"),
        ((F.col("s_suppkey") * 37) % WIDTH + 0.25).alias("x"),
        ((F.col("s_suppkey") * 13) % F.col("n_rows") + 0.75).alias("y"),
        F.col("s_acctbal").alias("t_idx"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, x, y, t_num, t_rat, t_idx: field points with nullable targets."""
    lines = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") + 1).alias("sample_id")).agg(F.count_if(F.col("l_returnflag") == "R").alias("num"), F.count("*").alias("lines"))
    s, odd = points(spark, sf_dir).join(lines, "sample_id", "left"), F.col("sample_id") % 2 == 0
    return s.select("sample_id", "x", "y", F.when(odd, F.coalesce("num", F.lit(0)).cast("double")).alias("t_num"), F.when(odd & (F.col("lines") > 0), 100.0 * F.col("num") / F.col("lines")).alias("t_rat"), "t_idx")


def feature_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, feature, value, label: one row for each component of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), "label", F.posexplode("embedding").alias("feature", "v")).select("sample", "feature", F.col("v").cast("double").alias("value"), "label")


#: The same views for DuckDB, to begin an oracle with.
SQL = """WITH pixel_long AS (
  SELECT CASE WHEN l_linestatus = 'F' THEN '0418' ELSE '0510' END AS date, l_partkey // 50 AS row, l_partkey % 50 AS col, l_linenumber AS band, sum(l_quantity) / count(*) AS value
  FROM lineitem GROUP BY ALL
), supplier_lines AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS num, count(*) AS lines FROM lineitem GROUP BY 1
), samples AS (
  SELECT s_suppkey + 1 AS sample_id, (s_suppkey * 37) % 50 + 0.25::DOUBLE AS x, (s_suppkey * 13) % ((SELECT count(*) FROM part) // 50) + 0.75::DOUBLE AS y,
    CASE WHEN s_suppkey % 2 <> 0 THEN coalesce(num, 0)::DOUBLE END AS t_num, CASE WHEN s_suppkey % 2 <> 0 AND lines > 0 THEN 100.0::DOUBLE * num / lines END AS t_rat, s_acctbal AS t_idx
  FROM supplier LEFT JOIN supplier_lines ON s_suppkey = l_suppkey
), feature_long AS (SELECT vec_id AS sample, i - 1 AS feature, embedding[i]::DOUBLE AS value, label FROM embeddings, range(1, 65) t(i))
"""
