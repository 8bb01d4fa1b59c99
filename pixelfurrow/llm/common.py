"""What several corpus operators share: the shared folder, written tables, folds and bounded samples."""

from __future__ import annotations

import ctypes
import inspect
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def by_value(module: str) -> None:
    """Send this module's functions to Python workers whole, so that executors need no copy of the repository."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset on one machine (tests), one is made and set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="pixelfurrow-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Texts and sets take some KB a row, so Spark's 10,000 rows a batch would be held several times over on either side.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts lineage and survives the loss of executors. The shuffles that made
    it go with the job, as nothing reads them again."""
    spark = df.sparkSession
    path, before = fresh_path(spark, name), {k: spark.conf.get(k) for k in (CLEANUP, BATCH)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, str(BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "written_path", None)
        if path:
            jvm, spark = table.sparkSession._jvm, table.sparkSession
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def column(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")


def parallel(df: DataFrame) -> int:
    """Partitions for work that is spread anew: those that the session sets for shuffles."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def bounded_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """About limit rows at most, chosen by a hash of key, hence the same rows wherever they lie."""
    n = rows.count()
    if n <= limit:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(20)), F.lit(1_000_003)) < int(1_000_003 * limit / n))


def training_labels(labels: DataFrame, label: str, modulus: int, held_out: int, limit: int) -> DataFrame:
    """(doc_id, label) of the learning folds, one row a document; at most about limit rows, so it may be broadcast."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", modulus) != held_out))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return bounded_sample(rows, "doc_id", limit)


class Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def blocks(texts, most: int = 4 << 20):
    """(first, last) row ranges of about most bytes of text; a longer text is a block of its own."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield first, k
            first, size = k, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def sliced(column: pa.Array, most: int):
    """blocks() of a column of texts, by their bytes: (first, last, texts), so that a block's texts alone are Python's at a time."""
    first, size = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if size and size + n > most:
            yield first, k, column.slice(first, k - first).to_pylist()
            first, size = k, 0
        size += n
    if first < len(column):
        yield first, len(column), column.slice(first).to_pylist()


def kept(key, make):
    """make() once for each key in this Python worker, which may run many tasks. Only the latest key stays, as a task uses one."""
    import pyspark

    store = pyspark.__dict__.setdefault("_pixelfurrow_kept", {})
    if key not in store:
        forget()
        store[key] = make()
    return store[key]


def forget() -> None:
    """Drop what earlier stages kept in this Python worker, broadcast values and tables, which a later stage has no use for."""
    import pyspark

    store = pyspark.__dict__.setdefault("_pixelfurrow_kept", {})
    if store:
        store.clear()
        release()


def release() -> None:
    """Give back to the system what this Python worker has freed: workers stay beside the JVM while later stages run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def releasing(f):
    """f, which takes a task's batches or a group's rows, followed by release()."""

    def over_batches(batches):
        try:
            yield from f(batches)
        finally:
            release()

    def over_group(rows):
        try:
            return f(rows)
        finally:
            release()

    return over_batches if inspect.isgeneratorfunction(f) else over_group


def _plain(value) -> tuple:
    """value as classes by value and plain data, which a worker reads from the broadcast's file without holding its bytes too."""
    if isinstance(value, list):
        return "list", None, [_plain(v) for v in value]
    return ("object", cloudpickle.dumps(type(value)), vars(value)) if type(value).__module__.startswith("pixelfurrow") else ("value", None, value)


def _rebuilt(plain: tuple):
    kind, of, state = plain
    if kind == "list":
        return [_rebuilt(v) for v in state]
    if kind == "value":
        return state
    class_ = cloudpickle.loads(of)
    out = class_.__new__(class_)
    out.__dict__.update(state)
    return out


class Shared:
    """A broadcast of a value with the classes it is of, so that executors need no copy of the repository."""

    def __init__(self, spark: SparkSession, value):
        self.key, self.sent = uuid.uuid4().hex, spark.sparkContext.broadcast(_plain(value))

    @property
    def value(self):
        return kept(("shared", self.key), self._load)

    def _load(self):
        out = _rebuilt(self.sent.value)
        self.sent.__dict__.pop("_value", None)  # forget() is to free it
        return out


def isotonic(score: np.ndarray, label: np.ndarray, bins: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over at most bins groups of the sorted scores; the mean score and the smoothed rate of each pool."""
    if not len(score):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(score, kind="stable")
    score, label = score[order], label[order]
    cuts = np.unique(np.linspace(0, len(score), min(bins, len(score)) + 1).astype(int))[:-1]
    starts = np.unique(np.searchsorted(score, score[cuts], "left"))  # ties stay together
    n = np.diff([*starts, len(score)]).astype(float)
    pools: list[list[float]] = []
    for w, s, y in zip(n, np.add.reduceat(score, starts), np.add.reduceat(label.astype(float), starts), strict=True):
        pools.append([w, s, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    rate = label.mean()
    return np.array([s / w for w, s, _ in pools]), np.array([(y + rate) / (w + 1) for w, _, y in pools])


by_value(__name__)
