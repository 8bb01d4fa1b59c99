"""Cross-entropy difference of n-gram models.

Two bigram models, of the target texts and of all texts, share one vocabulary: all words of all texts. Both are smoothed by
Dirichlet priors: p(w|h) = (c(hw) + MU * p(w)) / (c(h) + MU), p(w) = (c(w) + ADD * b(w)) / (c + ADD), where b is the
words' share in all texts, so no word that occurs has probability 0 in either. A token's loss difference is
log2 p_all - log2 p_target; a document's score is its mean, and lower means nearer to the target. Documents are in two
halves by a hash of doc_id; both models of a half count the other half, so that no document is scored by its own counts.

Texts are read once, in blocks. A block counts its distinct words, histories and bigrams, and sends the counts, packed and
sorted by 64-bit hashes, to buckets; a bucket adds up the counts of equal hashes of all blocks, and sends the sums back by
order alone. A very common bigram or word is one key a block at most, each task gathers a bucket or a block,
and no table of the corpus is collected or broadcast.

Defined results: words are lower-cased ASCII letters, digits and bytes over 127. A text's first word follows the empty
word. Null texts and texts without words score null, with 0 tokens. Without target texts all differences are those against
a target that is the words' share. Repeated rows get equal scores. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelfurrow.llm.common import Numbers, by_value, fresh_path, written
from pixelfurrow.llm.exchange import FILE, PARCELS, buckets_of, file_of, file_row, load_table, of_block, opened, parcels, planes, replies, store_table, unplaned
from pixelfurrow.llm.ngram_join import ODD, mixed
from pixelfurrow.llm.toxicity import words

MU, ADD, BLOCK, SMALL = 500.0, 1000.0, 8 << 20, 500_000
WORDS, BIGRAMS = 1, 2
COUNTS = ["n0", "n1", "t0", "t1"]


def _half(doc) -> int:
    return zlib.crc32(str(doc).encode()) >> 7 & 1


def numbered(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' distinct words, after the empty one: hashes, the commonest first; the numbers of all words; how many each text has."""
    numbers = Numbers({b"": 0})
    parts = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in map(words, texts)]
    seq = np.concatenate([*parts, np.zeros(0, np.int64)])
    order = np.concatenate([[0], np.argsort(-np.bincount(seq, minlength=len(numbers))[1:], kind="stable") + 1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))[order]
    return hashes, rank[seq], np.array([len(p) for p in parts], np.int64)


def histories(seq: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The number of the word before each; 0, the empty word's, at texts' beginnings."""
    out = np.concatenate([[0], seq[:-1]]) if len(seq) else seq.copy()
    out[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    return out


def bigrams(hashes: np.ndarray, seq: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, histories and words of the distinct bigrams, and each token's number among them."""
    codes, number = np.unique(before * len(hashes) + seq, return_inverse=True)
    h, w = np.divmod(codes, len(hashes))
    keys = mixed(mixed(hashes[h] + ODD[0]) * ODD[1] + hashes[w])
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return keys[order], h[order], w[order], rank[number]


def counted(at: np.ndarray, n: int, kinds: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.bincount(at[k], minlength=n) for k in kinds]).astype(np.uint32)


def block_rows(folder: str, buckets: int):
    """Of each block its file, the counts of its words and histories, and those of its bigrams. Columns: doc_id, text, target."""

    def rows(batches):
        held, size, seq_no = [], 0, 0
        part = TaskContext.get().partitionId() << 32

        def flush():
            hashes, seq, sizes = numbered([t for _, t, _ in held])
            half = np.repeat(np.array([_half(d) for d, _, _ in held], bool), sizes)
            target = np.repeat(np.array([bool(t) for _, _, t in held]), sizes)
            kinds = [half, ~half, half & target, ~half & target]  # each half has the other's counts
            before = histories(seq, sizes)
            order = np.argsort(hashes, kind="stable")
            counts = np.concatenate([counted(x, len(hashes), kinds) for x in (seq, before)])
            block = part | seq_no
            ids = pa.array([[d for d, _, _ in held]], pa.list_(pa.int64()))
            name = store_table(folder, pa.table({"doc_id": ids, "n": [sizes], "seq": [planes(seq.astype(np.uint32))], "hashes": [planes(hashes)]}))
            held.clear()
            yield file_row(block, name, planes(np.array([k.sum() for k in kinds], np.int64)))
            yield parcels(WORDS, block, hashes[order], counts[:, order], buckets)
            keys, _, _, number = bigrams(hashes, seq, before)
            yield parcels(BIGRAMS, block, keys, counted(number, len(keys), kinds), buckets)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = len(row[1] or "")
                if held and size + new > BLOCK:
                    yield from flush()
                    size, seq_no = 0, seq_no + 1
                held.append(row)
                size += new
        if held:
            yield from flush()

    return rows


def add_up(rows: pa.Table) -> pa.Table:
    """The sums of equal keys' counts, for each key that came."""
    if rows.column("kind")[0].as_py() == FILE:
        return rows.select(["kind", "bucket", "block", "keys", "vals"])
    keys, vals, cuts, _ = opened(rows, np.uint32)
    distinct, at = np.unique(keys, return_inverse=True)
    del keys
    sums = np.stack([np.bincount(at, np.concatenate([v[k] for v in vals]), len(distinct)).astype(np.int64) for k in range(len(vals[0]))])
    return replies(rows, [planes(sums[:, at[a:b]]) for a, b in cuts])


def tallied(batches):
    """The sums of blocks' totals, a row a batch."""
    for batch in batches:
        sums = np.sum([unplaned(v, np.int64) for v in batch.column(0).to_pylist()] + [np.zeros(4, np.int64)], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in sums], COUNTS)


def scored(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, score of each row; docs: doc_id, text; target: its doc_ids."""
    folder = fresh_path(docs.sparkSession, "lm-blocks")
    buckets = buckets_of(docs)
    target = target.select("doc_id").distinct().withColumn("target", F.lit(True))
    target = F.broadcast(target) if target.count() <= SMALL else target  # beyond that the join shuffles the texts
    marked = docs.join(target, "doc_id", "left").select("doc_id", "text", "target")
    sent = marked.mapInArrow(block_rows(folder, buckets), PARCELS)
    table = written(sent.groupBy("kind", "bucket").applyInArrow(add_up, PARCELS), "lm-sums")
    totals = table.where(F.col("kind") == FILE).select("vals").mapInArrow(tallied, ", ".join(f"{c} long" for c in COUNTS))
    totals = [float(x) for x in totals.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in COUNTS)).first()]

    def assemble(rows: pa.Table) -> pa.Table:
        own = load_table(folder, file_of(rows))
        seq, hashes = unplaned(own.column("seq")[0].as_py(), np.uint32).astype(np.int64), unplaned(own.column("hashes")[0].as_py(), np.uint64)
        sizes = own.column("n")[0].values.to_numpy()
        order, sums = np.argsort(hashes, kind="stable"), np.empty((8, len(hashes)))
        sums[:, order] = of_block(rows, WORDS, np.int64, 8)
        before = histories(seq, sizes)
        _, h, w, number = bigrams(hashes, seq, before)
        c = of_block(rows, BIGRAMS, np.int64, 4)
        share = (sums[0] + sums[1]) / max(1.0, totals[0] + totals[1])
        log = [np.log2((c[k] + MU * ((sums[k] + ADD * share) / (totals[k] + ADD))[w]) / (sums[4 + k][h] + MU)) for k in range(4)]
        ids = own.column("doc_id")[0].values
        half = np.repeat(np.array([_half(d) for d in ids.to_pylist()], bool), sizes)
        diff = np.where(half, (log[1] - log[3])[number], (log[0] - log[2])[number])
        some = sizes > 0
        means = np.full(len(sizes), np.nan)
        if some.any():
            means[some] = np.add.reduceat(diff, (np.cumsum(sizes) - sizes)[some]) / sizes[some]
        return pa.table([ids, pa.array(sizes), pa.array(means, mask=~some)], ["doc_id", "n_tokens", "score"])

    return table.repartition(buckets, "block").groupBy("block").applyInArrow(assemble, "doc_id long, n_tokens long, score double")


def op3(spark, sf_dir: str) -> DataFrame:
    """The target: documents that labels.quality marks 1. The background: all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id"))


by_value(__name__)
