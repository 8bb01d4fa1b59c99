"""Files as tables: guards, CSV, points, inventories, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = [(r"\.(tif|tiff)$", "raster"), (r"\.(shp|dbf|shx|prj)$", "points"), (r"\.parquet$", "table"), (r"\.csv$", "table"), (r"\.json$", "manifest"), (r"\.(md|txt)$", "report"), (r"\.(png|pdf)$", "figure"), (r"\.py$", "code")]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def require(spark: SparkSession, *paths: str) -> None:
    """Every input has to be there; the error names all that aren't."""
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, read by a schema; empty fields are null. A field that doesn't fit the schema is an error."""
    require(spark, path)
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", escape='"', multiLine=False)


def checked(rows: DataFrame, column: str, **violations: Column) -> DataFrame:
    """rows, or an error that names the rules that any row breaks; violations: aggregates that are true where a rule is broken.

    One small aggregate is joined, and the error is raised where column is read, so no action runs while the plan is built."""
    said = F.concat_ws(", ", *(F.when(v, F.lit(name)) for name, v in violations.items()))
    bad = rows.agg(said.alias("_bad"))
    out = rows.crossJoin(F.broadcast(bad))
    value = F.when(F.col("_bad") != "", F.raise_error(F.concat(F.lit("broken: "), "_bad")).cast(rows.schema[column].dataType)).otherwise(F.col(column))
    return out.select(*(value.alias(c) if c == column else F.col(c) for c in rows.columns))


def repeated(column: str) -> Column:
    """True where a column isn't unique."""
    return F.count(column) != F.count_distinct(column)


def measured_samples(points: DataFrame, target: str, expected: int | None = None) -> DataFrame:
    """Points with a measured target, real zeros included; ids are unique, targets from 0 to 100, coordinates finite."""
    rows = points.where(F.col(target).isNotNull())
    finite = F.coalesce(F.abs("x") < float("inf"), F.lit(False)) & F.coalesce(F.abs("y") < float("inf"), F.lit(False))
    rules = {"sample_id is not unique": repeated("sample_id"), f"{target} is not in 0 to 100": F.coalesce(F.bool_or(~F.col(target).between(0, 100)), F.lit(False)), "coordinates are not finite": F.coalesce(F.bool_or(~finite), F.lit(False))}
    if expected is not None:
        rules[f"rows are not {expected}"] = F.count("*") != expected
    return checked(rows, target, **rules)


def read_points(spark: SparkSession, path: str, targets: list[str]) -> DataFrame:
    """Field points of a CSV or Parquet table: sample_id, x, y and targets; it mustn't be empty, and every point has an id and a place."""
    require(spark, path)
    rows = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)
    lost = [c for c in ["sample_id", "x", "y", *targets] if c not in rows.columns]
    if lost:
        raise ValueError(f"{path} lacks {', '.join(lost)}")
    rows = rows.select("sample_id", F.col("x").cast("double"), F.col("y").cast("double"), *targets)
    return checked(rows, "x", **{"no points": F.count("*") == 0, "a point has no place": F.coalesce(F.bool_or(F.col("x").isNull() | F.col("y").isNull()), F.lit(False)), "sample_id is not unique": repeated("sample_id")})


def eligible(long: DataFrame) -> DataFrame:
    """The features of a long table (feature, value) that have two or more distinct finite values."""
    v = F.when(F.abs("value") < float("inf"), F.col("value"))
    return long.join(long.groupBy("feature").agg(F.count_distinct(v).alias("k")).where("k >= 2").select("feature"), "feature", "left_semi")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """name, size_mb and role of each file below folder but those in hidden ones; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name, role = F.element_at(F.split("path", "/"), -1), None
    for pattern, r in ROLES:
        hit = F.lower(name).rlike(pattern)
        role = F.when(hit, r) if role is None else role.when(hit, r)
    return rows.where(~F.col("path").rlike(r"/\.[^/]+/")).select(name.alias("name"), (F.col("length") / 1e6).alias("size_mb"), role.otherwise("other").alias("role"))


def digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file, computed where the file is read."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def reusable(spark: SparkSession, manifest: str, wanted: dict[str, str]) -> bool:
    """Whether a manifest is there and says all that is wanted, word for word."""
    if not exists(spark, manifest):
        return False
    said = spark.read.json(manifest, primitivesAsString=True)
    if not set(wanted) <= set(said.columns):
        return False
    return said.where(F.lit(True) if not wanted else F.forall(F.array(*(F.col(k) == F.lit(str(v)) for k, v in wanted.items())), lambda x: x)).limit(1).count() == 1


def radii(raw: str) -> list[float]:
    """Radii from a list with commas; point, pt and 0 are the pixel under a point."""
    out = []
    for part in filter(None, (p.strip().lower() for p in raw.split(","))):
        r = 0.0 if part in ("point", "pt") else float(part)
        if r < 0:
            raise ValueError(f"radius {part} is negative")
        out.append(r)
    return out


def scale_tag(radius: float) -> str:
    return "pt" if radius == 0 else f"{radius:f}".rstrip("0").rstrip(".").replace(".", "p")
