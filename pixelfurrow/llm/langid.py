"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order, up to order 3, with frozen counts. A byte costs
-log2(count / (total + distinct)) in the longest context that has seen it, plus -log2(distinct / (total + distinct))
for each escape from a longer context that hasn't (escape method C, without exclusions); under the empty context an
unseen byte costs 8 bits more. A document's exact code length is the sum over its bytes, and the language with the
shortest code wins.

Defined results: a null text, or one without a letter, is "und" with score 0. Ties go to the alphabetically first
language. Repeated rows get equal results. With no labelled rows every document is "und". Only doc_id, text and lang
are read, so other columns may be there and may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelfurrow.llm.common import Shared, by_value, fold, forget, releasing, sliced

ORDER, PIECE = 3, 1 << 18
PAD = b"\0" * ORDER


def _joined(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, ORDER zero bytes before each, and where each text's pad begins."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    starts = np.cumsum([0, *(len(x) + ORDER for x in raw)])[:-1]
    return np.frombuffer(PAD + PAD.join(raw), np.uint8), starts


def _grams(data: np.ndarray) -> np.ndarray:
    """For each byte from index ORDER on: it and the ORDER bytes before it, as one number."""
    out = data[ORDER:].astype(np.uint32)
    for k in range(1, ORDER + 1):
        out |= data[ORDER - k : len(data) - k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _keep(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of the grams end on a byte of a text, not on a pad."""
    keep = np.ones(n, bool)
    for k in range(ORDER):
        at = starts + k - ORDER
        keep[at[at >= 0]] = False
    return keep


def count_grams(batches):
    forget()
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for a, b, texts in sliced(batch.column(1), 2 << 20):
            for lang in dict.fromkeys(langs[a:b]):
                data, starts = _joined([t for t, x in zip(texts, langs[a:b], strict=True) if x == lang])
                grams = _grams(data)
                keys, n = np.unique(grams[_keep(len(grams), starts)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


class Trees:
    """The context trees of all languages, and a table from each gram that any has seen to its code lengths."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.orders = [self._tree(*counts[x]) for x in self.langs]
        union = np.unique(np.concatenate([g for g, _ in counts.values()])) if counts else np.zeros(0, np.int64)
        self.grams = union.astype(np.uint32)
        self.bits = np.zeros((len(union) + 1, len(self.langs)), np.float32)  # the last row is of pads
        for k in range(len(self.langs)):
            self.bits[:-1, k] = self.lengths(k, self.grams)
        size = max(10, int(np.ceil(np.log2(4 * len(union) + 1))))
        self.shift = np.uint32(32 - min(size, 24))
        self.slots = np.full(1 << min(size, 24), len(union), np.int32)
        self.slots[self._slot(self.grams)] = np.arange(len(union), dtype=np.int32)
        self.check = np.append(self.grams, np.uint32(0))

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint32(2654435761)) >> self.shift

    @staticmethod
    def _tree(grams: np.ndarray, n: np.ndarray) -> list:
        """For each order: seen grams and their bits, contexts and their escape bits."""
        out = []
        for order in range(ORDER + 1):
            keys, inverse = np.unique(grams & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            c = np.bincount(inverse, n, len(keys))
            contexts, inside = np.unique(keys >> 8, return_inverse=True)
            total, distinct = np.bincount(inside, c), np.bincount(inside)
            out.append((keys, np.log2((total + distinct)[inside] / c), contexts, np.log2((total + distinct) / distinct)))
        return out

    def lengths(self, lang: int, grams: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte after the bytes before it."""
        bits, rest = np.zeros(len(grams)), np.arange(len(grams))
        for order in range(ORDER, -1, -1):
            keys, cost, contexts, escape = self.orders[lang][order]
            g = grams[rest].astype(np.int64) & ((1 << 8 * (order + 1)) - 1)
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            seen = keys[at] == g
            bits[rest[seen]] += cost[at[seen]]
            rest, g = rest[~seen], g[~seen] >> 8
            at = np.minimum(np.searchsorted(contexts, g), len(contexts) - 1)
            known = contexts[at] == g
            bits[rest[known]] += escape[at[known]]
        bits[rest] += 8
        return bits

    def code_lengths(self, texts) -> np.ndarray:
        """Bits of each text under each language."""
        if not len(texts) or not self.langs:
            return np.zeros((len(texts), len(self.langs)))
        data, starts = _joined(texts)
        grams = np.append(np.zeros(ORDER, np.uint32), _grams(data))
        row = self.slots[self._slot(grams)]
        odd = np.flatnonzero((self.check[row] != grams) | (row == len(self.grams)))
        late = None
        if len(odd):  # a lost slot or a gram that no language has seen
            keys, inverse = np.unique(grams[odd], return_inverse=True)
            late = np.stack([self.lengths(k, keys) for k in range(len(self.langs))], 1)
            row = row.astype(np.int64)
            row[odd] = len(self.grams) + 1 + inverse
        bits = self.bits if late is None else np.concatenate([self.bits, late.astype(np.float32)])
        for k in range(ORDER):
            row[starts + k] = len(self.grams)
        return np.add.reduceat(bits[row], starts, axis=0, dtype=np.float64)


def learn(docs: DataFrame, limit: int = 4000) -> Trees:
    """Trees from about limit documents of each language at most (a bound on labelled rows); docs: lang, text, doc_id."""
    counts = {}
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    # counted where it is joined: a table made here from Python rows would leave a second set of Python workers on the executors
    share = rows.groupBy("lang").agg((F.lit(1_000_003) * F.least(F.lit(1.0), F.lit(limit) / F.count("*"))).cast("int").alias("share"))
    some = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_003)) < F.col("share"))
    table = some.select("lang", "text").mapInArrow(releasing(count_grams), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(table.column("lang").to_pylist(), object)
    grams, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    for lang in dict.fromkeys(langs):
        own = langs == lang
        counts[lang] = (grams[own], n[own])
    return Trees(counts)


def identify(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, lang_pred, score (posterior under equal priors) and bits_per_byte of each row of docs."""
    shared = Shared(docs.sparkSession, trees)

    def predict(batches):
        trees = shared.value
        for batch in batches:
            for a, b, part in sliced(batch.column(1), PIECE):
                bits = trees.code_lengths(part)
                letters = np.array([bool(t) and any(map(str.isalpha, t)) for t in part]) & (len(trees.langs) > 0)
                best = bits.argmin(1) if trees.langs else np.zeros(len(part), int)
                low = bits[np.arange(len(part)), best] if trees.langs else np.zeros(len(part))
                with np.errstate(under="ignore"):
                    score = 1 / np.maximum(1, np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)) if trees.langs else low
                size = np.array([max(1, len(t.encode("utf-8", "surrogatepass"))) if t else 1 for t in part])
                names = [trees.langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(low / size)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(predict), "doc_id long, lang_pred string, score double, bits_per_byte double")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = learn(docs.where(fold("doc_id", 4) != 2))
    return identify(docs, trees).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that some learned language compresses: not "und", and under 8 bits a byte.

    Texts are told apart by themselves, so the verdict joins its row without a shuffle of texts: it is computed beside it."""
    trees = learn(docs)
    shared = Shared(spark, trees)
    schema = docs.schema

    def keep(batches):
        trees = shared.value
        for batch in batches:
            for a, b, texts in sliced(batch.column(batch.schema.names.index("text")), PIECE):
                bits, kept = trees.code_lengths(texts), []
                for t, low in zip(texts, bits.min(1) if trees.langs else [0] * (b - a), strict=True):
                    kept.append(bool(t) and bool(trees.langs) and any(map(str.isalpha, t)) and bool(low < 8 * len(t.encode("utf-8", "surrogatepass"))))
                yield batch.slice(a, b - a).filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(releasing(keep), schema)


by_value(__name__)
