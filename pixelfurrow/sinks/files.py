"""Results as files: CSV, JSON manifests, Markdown tables, and a check that all is there."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelfurrow.sources.files import exists


def guard(spark: SparkSession, path: str, inputs: list[str], overwrite: bool) -> None:
    """An output mustn't be an input, and one that is there is replaced only where asked for."""
    same = lambda p: re.sub("/+", "/", p.split(":", 1)[-1]).rstrip("/")
    if same(path) in map(same, inputs):
        raise ValueError(f"{path} is an input")
    if not overwrite and exists(spark, path):
        raise FileExistsError(path)


def write_csv(rows: DataFrame, path: str, decimals: int | None = None, overwrite: bool = False, files: int | None = None) -> None:
    """A CSV with a header; Spark's commit puts it in place whole or not at all. files: as many, for small tables; else one a partition."""
    if decimals is not None:
        rows = rows.select(*(F.format_string(f"%.{decimals}f", c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))
    (rows if files is None else rows.coalesce(files)).write.csv(path, header=True, mode="overwrite" if overwrite else "errorifexists", escape='"')


def write_manifest(spark: SparkSession, path: str, facts: dict, overwrite: bool = False) -> None:
    """One JSON object: model, metrics, features, range, counters."""
    row = spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1)
    row.write.mode("overwrite" if overwrite else "errorifexists").text(path)


def markdown(rows: DataFrame, digits: int = 4, limit: int = 1000) -> str:
    """A small table as Markdown: numbers to so many significant digits, null as empty, a pipe as a slash."""
    show = lambda x: "" if x is None else f"{x:.{digits}g}" if isinstance(x, float) else str(x).replace("|", "/")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows.limit(limit).collect()])


def consistency(spark: SparkSession, outputs: dict[str, str]) -> DataFrame:
    """name, status, rows of each output (name to path of a CSV or Parquet table): ok, warning where it is empty, error where it can't be read."""
    found = []
    for name, path in outputs.items():
        try:
            n = (spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True)).count()
            found.append((name, "ok" if n else "warning", n))
        except Exception:  # noqa: BLE001 - whatever keeps it from being read is the finding
            found.append((name, "error", None))
    return spark.createDataFrame(found, "name string, status string, rows long")
