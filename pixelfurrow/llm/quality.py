"""Quality by random Fourier features.

Each document becomes a vector of statistics (shares of byte classes, word and line statistics, repetition). Random
Fourier features approximate a Gaussian kernel over the standardised vector. Partitions sum the normal equations
X'X and X'y, whose size is fixed by the number of features; the driver solves the ridge system. An isotonic fit turns
ridge outputs into rates.

Defined results: null counts as empty, and empty texts have all statistics 0 and are scored like any other. Ties and
repeated rows get equal results. Without labels every document scores 0.5. Only doc_id and text are read. The learning
sample is bounded by `limit` rows; X'X is summed per partition, then in a few groups, so that the driver gets a fixed size.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelfurrow.llm.common import Shared, by_value, discard, fold, isotonic, training_labels, written

LIMIT, FEATURES, RIDGE, SEED, GROUPS = 40_000, 256, 1.0, 5, 8


def _classes() -> np.ndarray:
    """For each byte value its class: one for each mark, and one each for letters, capitals, digits, spaces, line ends, controls, high bytes."""
    out = np.zeros(256, int)
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    for b in range(256):
        c = chr(b)
        out[b] = 5 if b >= 128 else 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c == " " else 4 if c in "\n\r" else 7 + marks.index(b) if b in marks else 6
    return out


CLASS = _classes()
N_CLASS = int(CLASS.max()) + 1
N_STAT = N_CLASS + 14


def statistics(text: str | None) -> np.ndarray:
    out = np.zeros(N_STAT)
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    if not raw:
        return out
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    out[:N_CLASS] = np.sqrt(np.bincount(CLASS, share, N_CLASS))
    some = share[share > 0]
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, m, count = max(1, len(words)), max(1, len(lines)), Counter(words)
    sizes = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    top = count.most_common(1)[0][1] if count else 0
    out[N_CLASS:] = [
        np.log1p(len(raw)), -(some * np.log2(some)).sum(), np.log1p(len(words)), sizes.mean(), sizes.std(), np.log1p(sizes.max()),
        np.sqrt(len(count) / n), len(count) / n ** 0.8, np.sqrt(top / n), len(set(lines)) / m, np.log1p(len(lines)), np.log1p(len(raw) / m),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / m, np.sqrt(sum(len(w) == 1 for w in words) / n),
    ]
    return out


def statistic_rows(batches):
    for batch in batches:
        rows = np.array([statistics(t) for t in batch.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(rows), pa.list_(pa.float64()))], ["label", "x"])


class Model:
    def __init__(self):
        self.mean, self.sd, self.weights = np.zeros(N_STAT), np.ones(N_STAT), None
        self.x, self.y = np.array([0.0]), np.array([0.5])
        draw = np.random.default_rng(SEED)
        self.w = draw.standard_normal((N_STAT, FEATURES)) / np.sqrt(N_STAT)
        self.b = draw.uniform(0, 2 * np.pi, FEATURES)

    def features(self, x: np.ndarray) -> np.ndarray:
        """Constant, standardised statistics, Fourier features."""
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        return np.hstack([np.ones((len(x), 1)), z, np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b)])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.features(x) @ self.weights, self.x, self.y), 0, 1)


def _sums(table: DataFrame, rows_to_arrays) -> list[np.ndarray]:
    """Sums of arrays over all rows: per partition, then over a few groups, then here; each has a fixed size."""

    def part(batches):
        total = None
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, N_STAT)
            new = rows_to_arrays(x, np.array(batch.column(0).to_pylist(), float))
            total = new if total is None else [a + b for a, b in zip(total, new, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(total[-1].tobytes()) % GROUPS], pa.int32()), pa.array([np.concatenate([a.ravel() for a in total]).tobytes()], pa.binary())], ["g", "v"])

    def group(frame):
        return pd.DataFrame({"v": [np.sum([np.frombuffer(v) for v in frame.v], axis=0).tobytes()]})

    partial = table.mapInArrow(part, "g int, v binary").groupBy("g").applyInPandas(group, "v binary").collect()
    flat = np.sum([np.frombuffer(bytes(r.v)) for r in partial], axis=0)
    out, at = [], 0
    for a in rows_to_arrays(np.zeros((1, N_STAT)), np.zeros(1)):
        out.append(flat[at : at + a.size].reshape(a.shape))
        at += a.size
    return out


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text. labels: doc_id, label of a bounded sample."""
    model = Model()
    sample = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("text", "label")
    table = written(sample.mapInArrow(statistic_rows, "label int, x array<double>"), "quality")
    if table.select("label").distinct().count() == 2:
        n, s, q = _sums(table, lambda x, y: [np.array([float(len(x))]), x.sum(0), (x * x).sum(0)])
        model.mean = s / n
        model.sd = np.sqrt(np.maximum(q / n - model.mean**2, 0))
        model.sd[model.sd < 1e-9] = 1.0

        def equations(x, y):
            f = model.features(x)
            return [f.T @ f, f.T @ y]

        a, b = _sums(table, equations)
        weights = np.linalg.solve(a + RIDGE * np.diag([1e-9, *[1.0] * (len(a) - 1)]), b)

        def predict(batches):
            for batch in batches:
                x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, N_STAT)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.features(x) @ weights)], ["label", "raw"])

        rows = table.mapInArrow(predict, "label int, raw double").toPandas()  # as bounded as the labels
        model.weights = weights
        model.x, model.y = isotonic(rows.raw.to_numpy(), rows.label.to_numpy(), bins=100)
    discard(table)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of docs."""
    shared = Shared(docs.sparkSession, model)

    def score(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, N_STAT)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")


def op5(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, training_labels(labels, "quality", 4, 2, LIMIT))
    return scored(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


by_value(__name__)
