"""Toxicity by maximum-scoring segments.

Learning: document counts of tokens (words, and words' beginnings of 5 and 4 bytes, for inflected and derived forms) in
toxic and in clean labelled documents give log-odds with an informative Dirichlet prior (the prior's mass is dealt by
the tokens' frequency in both). Tokens whose log-odds exceed Z standard deviations score their log-odds; a word has the
score of the longest such token, and every other word scores a small negative drift. A linear-time scan over a whole text finds all
maximal scoring segments. Extreme-value statistics calibrate them: lambda solves sum p(s) exp(lambda s) = 1 over the
clean documents' word scores, K comes from their best segments, and a segment counts lambda * S - ln(K * n) where that
is positive. The sum over a document's segments goes through an isotonic fit to a rate.

Defined results: null and empty texts have no segment and get the rate of such documents. Ties and repeated rows get
equal results. Without labels every document scores the neutral 0. Only doc_id and text are read, so other columns may
be there. The learning sample is bounded by `limit` rows, so the lexicon is bounded by that sample. In it near copies of one
label, whose similarity is verified, count once; all other labelled rows count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelfurrow.llm.common import Shared, by_value, discard, fold, isotonic, training_labels, written
from pixelfurrow.llm.ngram_join import grouped

LIMIT, PRIOR, Z, LEAST, DRIFT = 40_000, 0.15, 4.0, 1.5, 0.1
#: Near copies: sequences of so many words, and the least Jaccard similarity of their sets.
NEAR_WORDS, NEAR = 3, (80, 100)
#: ASCII letters in lower case; digits and bytes over 127 as they are; all else parts words.
WORDS = bytes((b | 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split() if text else []


def tokens(word: bytes) -> list[bytes]:
    """The word and its beginnings, which have a space before them; from the longest on."""
    return [word, *(b" " + word[:k] for k in (5, 4) if len(word) > k)]


def count_words(batches):
    """Documents of either label that hold a token."""
    for batch in batches:
        seen: dict[bytes, list[int]] = {}
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in {x for w in set(words(text)) for x in tokens(w)}:
                seen.setdefault(w, [0, 0])[label] += 1
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), *(pa.array([n[k] for n in seen.values()], pa.int64()) for k in (0, 1))], ["word", "clean", "toxic"])


def once(sample: DataFrame) -> DataFrame:
    """text, label of the rows of sample (row, doc_id, text, label) that remain where near copies of one label count once: of
    each component of verified links, and of the texts without words, the least doc_id of either label."""
    near = grouped(sample.select(F.col("row").alias("doc_id"), "text"), NEAR_WORDS, *NEAR)
    near = near.select(F.col("doc_id").alias("row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("copy")).distinct()
    least = sample.select("row", "doc_id", "label").join(near, "row").groupBy("copy", "label").agg(F.min(F.struct("doc_id", "row")).alias("x")).select("x.row")
    return sample.join(F.broadcast(least), "row").dropDuplicates(["row"]).select("text", "label")


def segments(scores: list[float], places: list[int], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first place, last place), where every other place scores -drift; linear time."""
    out: list[list[float]] = []  # left sum, right sum, first, last
    total, before = 0.0, -1
    for s, at in zip(scores, places, strict=True):
        total -= drift * (at - before - 1)
        new = [total, total + s, at, at]
        total, before = total + s, at
        while out:
            k = len(out) - 1
            while k >= 0 and out[k][0] >= new[0]:
                k -= 1
            if k < 0 or out[k][1] >= new[1]:
                break
            new[0], new[2] = out[k][0], out[k][2]
            del out[k:]
        out.append(new)
    return [(b - a, int(i), int(j)) for a, b, i, j in out]


class Model:
    """Lexicon, extreme-value parameters and the isotonic fit."""

    def __init__(self, lexicon: dict[bytes, float]):
        self.lexicon, self.rate, self.k = lexicon, 1.0, 1.0
        self.x, self.y = np.array([0.0]), np.array([0.0])

    def hits(self, text: str | None) -> tuple[int, list[float], list[int]]:
        """Number of words; scores and places of those that have a score of their own."""
        found, own = words(text), {}
        for w in set(found):
            for x in tokens(w):
                if x in self.lexicon:
                    own[w] = self.lexicon[x]
                    break
        places = [i for i, w in enumerate(found) if w in own] if own else []
        return len(found), [own[found[i]] for i in places], places

    def scan(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        n, scores, places = self.hits(text)
        return n, segments(scores, places, DRIFT)

    def significant(self, n: int, found) -> list[tuple[float, int, int]]:
        """The segments with an expected number under 1 in n words, and by how many nats."""
        return [(x, i, j) for s, i, j in found if (x := self.rate * s - math.log(max(self.k * n, 1.0))) > 0]

    def score(self, total) -> np.ndarray:
        return np.clip(np.interp(total, self.x, self.y), 0, 1)


def _lambda(p: dict[float, float]) -> float:
    """The positive root of sum p(s) exp(x s) = 1; if the mean isn't negative, a small value: nothing is significant."""
    if sum(s * q for s, q in p.items()) >= 0 or max(p, default=0) <= 0:
        return 0.01
    f = lambda x: sum(q * math.exp(min(x * s, 700)) for s, q in p.items()) - 1
    low, high = 1e-6, 1.0
    while f(high) < 0:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text. labels: doc_id, label of a bounded sample."""
    spark = docs.sparkSession
    sample = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").where(F.col("text").isNotNull())
    rows = written(sample.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text", "label"), "toxicity")
    sample = written(once(rows), "toxicity-once")
    discard(rows)
    counts = sample.mapInArrow(count_words, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    both = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = both.get(0, 0), both.get(1, 0)
    model = Model({})
    if not n0 or not n1:
        return model
    mass = PRIOR * (n0 + n1)
    prior = F.lit(PRIOR) * (F.col("clean") + F.col("toxic"))

    def logit(y, n):
        return F.log((y + prior) / (n + mass - y - prior))

    odds = counts.where((F.col("toxic") > 0) & (F.col("toxic") * n0 > F.col("clean") * n1)).select(
        "word",
        (logit(F.col("toxic"), n1) - logit(F.col("clean"), n0)).alias("odds"),
        (1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)).alias("var"),
    )
    model.lexicon = {bytes(r.word): round(r.odds, 3) for r in odds.where((F.col("odds") > Z * F.sqrt("var")) & (F.col("odds") > LEAST)).collect()}
    shared = Shared(spark, model)

    def scan(batches):
        for batch in batches:
            found = [shared.value.hits(t) for t in batch.column(0).to_pylist()]
            best = [[s for s, _, _ in segments(scores, places, DRIFT)] for _, scores, places in found]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x[0] for x in found], pa.int64()), pa.array(best, pa.list_(pa.float64())), pa.array([x[1] for x in found], pa.list_(pa.float64()))], ["label", "n", "s", "hits"])

    rows = sample.mapInArrow(scan, "label int, n long, s array<double>, hits array<double>").toPandas()  # as bounded as the labels
    clean = rows[rows.label == 0]
    total, spread = max(1, int(clean.n.sum())), {}
    for hits in clean.hits:
        for s in hits:
            spread[s] = spread.get(s, 0) + 1 / total
    spread[-DRIFT] = 1 - sum(spread.values())
    model.rate = _lambda(spread)
    best = [max(s) for s in clean.s if len(s)]
    level = float(np.median(best)) if best else 0.0
    model.k = max(1e-9, sum(b >= level for b in best) / max(1e-9, float(clean.n.sum()) * math.exp(-model.rate * level))) if best else 1e-3
    sums = np.array([sum(x for x, _, _ in model.significant(n, [(v, 0, 0) for v in s])) for n, s in zip(rows.n, rows.s, strict=True)])
    model.x, model.y = isotonic(sums, rows.label.to_numpy())
    discard(sample)
    return model


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, toxic_sum, score, and the significant passages (nats, first word, last word) of each row of docs."""
    shared = Shared(docs.sparkSession, model)

    def scan(batches):
        model = shared.value
        kind = pa.list_(pa.struct([("nats", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            found = [(n, model.significant(n, s)) for n, s in map(model.scan, batch.column(1).to_pylist())]
            sums = np.array([sum(x for x, _, _ in s) for _, s in found], float)
            spans = [[{"nats": x, "first": i, "last": j} for x, i, j in s] for _, s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(sums), pa.array(model.score(sums)), pa.array(spans, kind)], ["doc_id", "n_words", "toxic_sum", "score", "passages"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, n_words long, toxic_sum double, score double, passages array<struct<nats: double, first: int, last: int>>")


def op2(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, training_labels(labels, "toxic", 5, 0, LIMIT))
    return passages(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"), F.col("passages").cast("string").alias("passages"))


by_value(__name__)
