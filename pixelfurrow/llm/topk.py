"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into segments; each has a mean and a deviation. By Cauchy and Schwarz, the inner product of two vectors
is at most the sum over segments of length * (mean * mean + deviation * deviation), which is the lower bound
|q|^2 + |x|^2 - 2 * bound on their squared distance. Coarse segments come first; pairs whose bound stays under the
query's k-th best score drop out, finer segments follow, and exact scores are computed for the survivors alone.

A bounded sample of rows, chosen by a hash of vec_id (SEEDS rows, SEED_BYTES bytes), serves twice. Its second moments give
an orthogonal basis, the components of greatest energy first, in which segments are taken; inner products don't change.
And a query's k-th best score among the sample, which holds candidates only, is the bar it starts from in every block.

Queries and rows meet in blocks of bounded size: each task holds at most about ROWS rows and QUERIES queries, and sends
on k rows a query. A window over those ranks them.

Defined results: scores are integer inner products of floor(scale * x). Vectors that are null, empty, or hold null or
non-finite components take no part, nor do rows with a null vec_id. Rows that repeat a vec_id are candidates each, but
for queries of their own vec_id; where a query's vec_id repeats, its k rows are the best over all its vectors. Only vectors of the query's length are its candidates. Ties go to the smaller vec_id. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelfurrow.llm.common import Shared, by_value

SCALE, K, EVERY, ROWS, QUERIES, SLICE = 64, 20, 20, 4096, 4096, 1024
SEEDS, SEED_BYTES, PAIRS = 4096, 16 << 20, 1 << 14


def levels(d: int) -> list[np.ndarray]:
    """Starts of the segments of each level: 4 segments, 16, then three quarters of the components alone and 4 segments."""
    alone = d * 3 // 4
    fine = np.concatenate([np.arange(alone), np.linspace(alone, d, 5).astype(int)[:-1]])
    return [np.unique(np.linspace(0, d, min(n, d) + 1).astype(int)[:-1]) for n in (4, 16)] + [np.unique(fine)]


def segment_statistics(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each row: sqrt(length) * mean of all segments, then sqrt(length) * deviation of those longer than 1."""
    n = np.diff([*starts, x.shape[1]])
    mean = np.add.reduceat(x, starts, axis=1) / np.sqrt(n)
    square = np.add.reduceat(x * x, starts, axis=1)
    return np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0))[:, n > 1]])


def _best(q: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (highest score, then smallest id) of each query."""
    order = np.lexsort((ids, -s, q))
    q, s, ids = q[order], s[order], ids[order]
    first = np.searchsorted(q, q, "left")
    keep = np.arange(len(q)) - first < k
    return q[keep], s[keep], ids[keep]


def starting_bars(queries: np.ndarray, query_ids: np.ndarray, seeds: np.ndarray, seed_ids: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among the seeds, without its own id; -inf where they are fewer."""
    bars = np.full(len(queries), -np.inf)
    if len(seeds) >= k:
        for a in range(0, len(queries), SLICE):
            score = queries[a : a + SLICE] @ seeds.T
            score[query_ids[a : a + SLICE, None] == seed_ids[None, :]] = -np.inf
            bars[a : a + SLICE] = np.partition(score, len(seeds) - k, axis=1)[:, len(seeds) - k]
    return bars


def survivors(q_levels: list, r_levels: list, a: int, b: int, bar: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of rows a to b whose bounds reach the query's bar at every level. A level leaves out the queries
    and rows that have no pair left."""
    i, j = np.arange(len(bar)), np.arange(a, b)
    alive = np.ones((len(i), len(j)), bool)
    for ql, rl in zip(q_levels, r_levels, strict=True):
        alive &= ql[i] @ rl[j].T >= (bar - slack)[i, None]
        rows, columns = alive.any(1), alive.any(0)
        i, j, alive = i[rows], j[columns], alive[np.ix_(rows, columns)]
    x, y = np.nonzero(alive)
    return i[x], j[y]


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int = K, basis: np.ndarray | None = None, bar: np.ndarray | None = None):
    """Query index, score and row id of each query's k best rows among these that reach its bar, and the share of pairs
    scored exactly."""
    length = np.sqrt((rows * rows).sum(1))
    order = np.lexsort((row_ids, -length))  # long vectors first: good scores come early
    rows, row_ids, length = rows[order], row_ids[order], length[order]
    turned = (queries, rows) if basis is None else (queries @ basis, rows @ basis)
    q_levels, r_levels = ([segment_statistics(x, starts) for starts in levels(x.shape[1])] for x in turned)
    bar = np.full(len(queries), -np.inf) if bar is None else bar.copy()
    slack = np.sqrt((queries * queries).sum(1)) * 1e-9  # rounding of the bounds, for rows of length 1
    q, s, ids = np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64)
    exact, a, size = 0, 0, 64
    while a < len(rows):
        b = min(a + size, len(rows))
        i, j = survivors(q_levels, r_levels, a, b, bar, 1e-6 + slack * length[a])
        exact += len(i)
        score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", queries[i[c : c + PAIRS]], rows[j[c : c + PAIRS]]) for c in range(0, len(i), PAIRS))])
        good = (score >= bar[i]) & (query_ids[i] != row_ids[j])
        i, j, score = i[good], j[good], score[good]
        q, s, ids = _best(np.concatenate([q, i]), np.concatenate([s, score]), np.concatenate([ids, row_ids[j]]), k)
        first = np.searchsorted(q, np.arange(len(queries)))
        full = np.flatnonzero(np.bincount(q, minlength=len(queries)) >= k)
        bar[full] = np.maximum(bar[full], s[first[full] + k - 1])
        a, size = b, min(2 * size, SLICE)
    return q, s, ids, exact / max(1, len(queries) * len(rows))


def _matrix(column) -> np.ndarray:
    return np.floor(SCALE * np.array(column.to_pylist(), np.float64))


class Seeds:
    """By length of vectors: the sampled vectors, their ids, and the basis of their second moments."""

    def __init__(self, rows: pa.Table):
        self.of = {}
        d = np.array(rows.column("d").to_pylist(), np.int64)
        for n in np.unique(d):
            part = rows.filter(pa.array(d == n))
            x = _matrix(part.column("embedding"))
            self.of[int(n)] = x, part.column("vec_id").to_numpy(), np.linalg.eigh(x.T @ x)[1][:, ::-1]


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by every; vectors: vec_id, embedding."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & ok).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    n, m, longest = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("embedding"))).first()
    parts, groups = max(1, -(-n // ROWS)), max(1, -(-m // QUERIES))
    rows = rows.withColumn("d", F.size("embedding"))
    limit = min(SEEDS, SEED_BYTES // (8 * (longest or 1)))
    chosen = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_003)) <= int(1_000_003 * min(1, limit / max(n, 1)))).limit(2 * limit)
    seeds = Shared(vectors.sparkSession, Seeds(chosen.toArrow()))
    block = lambda n: F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n)).cast("int")  # noqa: E731 - rows of one id are dealt, too
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def bars(batches):
        for batch in batches:
            ids, d = batch.column("vec_id").to_numpy(), batch.column("d").to_numpy()
            bar = np.full(len(ids), -np.inf)
            for n in np.unique(d):
                at = np.flatnonzero(d == n)
                if n in seeds.value.of:
                    x, x_ids, _ = seeds.value.of[n]
                    bar[at] = starting_bars(_matrix(batch.column("embedding").take(pa.array(at))), ids[at], x, x_ids, k)
            yield batch.append_column("bar", pa.array(bar))

    def meet(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if queries.num_rows and rows.num_rows:
            q_ids, r_ids = queries.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
            q, r = _matrix(queries.column("embedding")), _matrix(rows.column("embedding"))
            basis = seeds.value.of.get(q.shape[1], (None,) * 3)[2]
            at, s, ids, _ = search(q, q_ids, r, r_ids, k, basis, queries.column("bar").to_numpy())
            found = [q_ids[at], ids, s.astype(np.int64)]
        return pa.table([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    asked = rows.where(F.col("vec_id") % every == 0).withColumn("q", block(groups))
    asked = asked.mapInArrow(bars, T.StructType([*asked.schema.fields, T.StructField("bar", T.DoubleType())]))
    left, right = asked.withColumn("r", each(parts)), rows.select("*", block(parts).alias("r"), each(groups).alias("q"))
    met = left.groupBy("q", "r", "d").cogroup(right.groupBy("q", "r", "d")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_inner_product(q.v::DOUBLE[], r.v::DOUBLE[]) AS BIGINT) AS score
  FROM ok q JOIN ok r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id
), ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

by_value(__name__)
