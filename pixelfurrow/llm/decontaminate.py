"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared in lower case with white space runs as one space. An item of m characters that occurs in a document with
at most k edits shares at least (m - q + 1) - k * q of its q-grams there, all within k diagonals of each other. So
documents' q-grams are looked up among those of all items; the hits of an item are counted in diagonal bands of width
2k + 2 that overlap by half, so that every k + 1 neighbouring diagonals lie in one band; regions with enough hits are
kept and verified by banded alignment, which also gives the matched stretch. Items for which the bound is below 1 with q have
shorter q-grams, the longest with a bound of 1 or more, in an index of their own.

The benchmark is a given query set. Its items go to the workers in blocks of at most BLOCK characters, one pass over the
documents a block, so that what is sent has a fixed size. Documents are never shuffled, and hot documents, items and
passages are lookups in the same index.

Defined results: null and empty texts, and items, match nothing. Items under q characters match exact text only. Repeated
rows each give their own matches; repeated items too. Columns but doc_id, text and item_id, text aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelfurrow.llm.common import Shared, by_value, releasing

Q, SHARE, BLOCK, PART, HITS = 8, 0.1, 4_000_000, 1 << 19, 1 << 20


def normal(text: str | None) -> str:
    return " ".join(text.split()).lower() if text else ""


def coded(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each index on."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, step, odd = codes.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while step < q:  # a stretch twice as long from two, which may overlap
        more = min(step, q - step)
        h = h[: len(h) - more] * np.uint64(odd) + h[more:]
        h ^= h >> np.uint64(31)
        step, odd = step + more, odd * 0xD6E8FEB86659FD93 % (1 << 64) | 1
    h *= np.uint64(0x94D049BB133111EB)
    return h


def alignment(item: np.ndarray, region: np.ndarray, k: int, low: int | None = None, high: int | None = None) -> tuple[int, int, int]:
    """Least edits of item against any stretch of region along the diagonals from low to high (all), and the stretch; (k + 1, 0, 0)
    if over k.

    Row by row over the item, in the band of those diagonals and k more at either side, with free start and end in the
    region; rows stop when all cells are over k. A cell's start is carried along, so no second pass is needed."""
    n, over = len(region), 1 << 20
    low, high = (-len(item) if low is None else low) - k, (n if high is None else high) + k
    low, high = max(low, -len(item)), min(high, n)
    if low > high:
        return k + 1, 0, 0
    at = np.arange(low, high + 1)
    padded = np.concatenate([np.full(max(0, -low) + 1, 0x110001, np.uint32), region, np.full(len(item) + 1, 0x110001, np.uint32)])[max(0, low) :]
    cost, start = np.where((at >= 0) & (at <= n), 0, over).astype(np.int32), np.clip(at, 0, n)
    steps = np.arange(len(at), dtype=np.int32)
    for i, c in enumerate(item, 1):
        new = cost + (padded[i : i + len(at)] != c)  # the character before column at + i
        up = np.append(cost[1:], np.int32(over)) + 1
        take = new <= up
        new, origin = np.where(take, new, up).astype(np.int32), np.where(take, start, np.append(start[1:], 0))
        column = at + i
        new[(column < 0) | (column > n)] = over
        shifted = new - steps  # runs of insertions by a running minimum
        least = np.minimum.accumulate(shifted)
        last = np.maximum.accumulate(np.where(least < shifted, 0, steps))
        cost, start = least + steps, origin[last]
        cost[column > n] = over
        if cost.min() > k:
            return k + 1, 0, 0
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), int(at[end]) + len(item)


class Index:
    """q-grams of a block of items, for lookup: a bit table first, then a sorted array."""

    def __init__(self, items: list[tuple[int, str]], q: int, share: float):
        self.q, self.share = q, share
        self.ids = [i for i, _ in items]
        self.codes = [coded(normal(t)) for _, t in items]
        grams = [qgrams(c, q) for c in self.codes]
        all_ = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, int)]).astype(np.int64)
        order = np.argsort(all_, kind="stable")
        self.grams, self.item, self.place = all_[order], item[order], place[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(all_ >> np.uint64(42)).astype(np.int64)] = True
        self.edits = np.array([int(len(c) * share) for c in self.codes], np.int64)
        self.need = np.maximum(1, np.array([len(c) for c in self.codes], np.int64) - q + 1 - self.edits * q)
        self.short = [k for k, c in enumerate(self.codes) if 0 < len(c) < q]

    def hits(self, codes: np.ndarray):
        """(place in text, item, place in item) of all shared q-grams, in lists of about HITS: a repeated text has very many."""
        h = qgrams(codes, self.q)
        at = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
        low, high = np.searchsorted(self.grams, h[at], "left"), np.searchsorted(self.grams, h[at], "right")
        n = high - low
        ends = np.cumsum(n)
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + HITS, "right")))
            own = n[a:b]
            rows = np.repeat(low[a:b], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            yield np.repeat(at[a:b], own), self.item[rows], self.place[rows]
            a = b


def tallied(doc, item, band, n):
    """Equal (doc, item, band) as one, with their sum."""
    order = np.lexsort((band, item, doc))
    doc, item, band, n = doc[order], item[order], band[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(band) != 0)])) if len(doc) else np.zeros(0, np.int64)
    return doc[new], item[new], band[new], np.add.reduceat(n, new) if len(new) else n


def candidates(index: Index, starts: np.ndarray, hits):
    """(document of the block, item, first diagonal, last diagonal) of bands with enough hits; starts: of the documents."""
    none = np.zeros(0, np.int64)
    total = none, none, none, none
    for at, item, place in hits:
        doc = np.searchsorted(starts, at, "right") - 1
        band = (at - starts[doc] - place + (1 << 40)) // (index.edits[item] + 1)
        one = np.ones(len(doc), np.int64)
        for half in (0, 1):  # band b holds the diagonals from b * width to (b + 2) * width - 1
            new = tallied(doc, item, band - half, one)
            total = tallied(*(np.concatenate(x) for x in zip(total, new, strict=True)))
    d, i, b, n = total
    keep = n >= index.need[i]
    d, i, b = d[keep], i[keep], b[keep]
    low = b * (index.edits[i] + 1) - (1 << 40)
    return d, i, low, low + 2 * (index.edits[i] + 1) - 1


def matches_in(index: Index, texts: list[str | None]):
    """(text number, item number, edits, first, last) of each verified region, places in the normal text."""
    codes = [coded(normal(t)) for t in texts]
    gap = np.full(index.q, 0x110000, np.uint32)  # no character
    starts = np.cumsum([0, *(len(c) + index.q for c in codes)])[:-1]
    joined = np.concatenate([x for c in codes for x in (c, gap)]) if codes else np.zeros(0, np.uint32)
    found = []
    d, i, low, high = candidates(index, starts, index.hits(joined))
    regions: dict[tuple[int, int], list[list[int]]] = {}
    for doc, item, a, b in zip(d.tolist(), i.tolist(), low.tolist(), high.tolist(), strict=True):
        own = regions.setdefault((doc, item), [])
        if own and a <= own[-1][1]:  # bands that overlap are aligned at once
            own[-1][1] = b
        else:
            own.append([a, b])
    for (doc, item), own in regions.items():
        k, m = int(index.edits[item]), len(index.codes[item])
        for a, b in own:
            first = max(0, a - k)  # of the stretch that the band's columns take
            edits, begin, end = alignment(index.codes[item], codes[doc][first : b + m + k], k, a - first, b - first)
            if edits <= k:
                found.append((doc, item, edits, first + begin, first + end))
    for item in index.short:
        needle = index.codes[item].tobytes()
        for doc, c in enumerate(codes):
            at = c.tobytes().find(needle)
            while at % 4 and at >= 0:
                at = c.tobytes().find(needle, at + 1)
            if at >= 0:
                found.append((doc, item, 0, at // 4, at // 4 + len(index.codes[item])))
    return found


def gram_size(m: int, q: int, share: float) -> int:
    """The longest q-grams, of at most q, of which an item of m characters keeps one through its edits; q for shorter items."""
    return q if m < q else min(q, m // (int(m * share) + 1))


def indexes(items: list[tuple[int, str]], q: int, share: float) -> list[Index]:
    """The items by the size of their q-grams."""
    by_size: dict[int, list[tuple[int, str]]] = {}
    for item in items:
        by_size.setdefault(gram_size(len(coded(normal(item[1]))), q, share), []).append(item)
    return [Index(own, size, share) for size, own in sorted(by_size.items())]


def item_blocks(benchmark: DataFrame):
    """Lists of (item_id, text) of at most about BLOCK characters each, read one partition at a time."""
    block, size = [], 0
    for r in benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def best_matches(found: list[Index], texts: list[str | None]):
    """(number of the text, item_id, edits, first, last) of the best match of each item in each text."""
    for index in found:
        best = {}
        for m in matches_in(index, texts):
            best[m[:2]] = min(best.get(m[:2], m), m)
        yield from ((d, index.ids[i], e, a, b) for d, i, e, a, b in best.values())


def text_blocks(texts: list[str | None]):
    """(first, last) of stretches of about PART characters."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= PART or k + 1 == len(texts):
            yield first, k + 1
            first, size = k + 1, 0


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, edits, first, last: the best match of each item in each row of docs; places in the normal text."""
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, edits int, first long, last long"
    for block in item_blocks(benchmark):
        shared = Shared(spark, indexes(block, q, share))

        def rows(batches, shared=shared):
            own = shared.value
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in text_blocks(texts):
                    found = [(ids[a + d], *rest) for d, *rest in best_matches(own, texts[a:b])]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "edits", "first", "last"])

        new = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(rows), schema)
        out = new if out is None else out.union(new)
    return spark.createDataFrame([], schema) if out is None else out


def op10(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows whose text holds a benchmark item, whatever their doc_id; each row is judged by its own text."""
    names = docs.columns
    for block in item_blocks(spark.read.parquet(f"{sf_dir}/benchmark.parquet")):
        shared = Shared(spark, indexes(block, Q, SHARE))

        def rows(batches, shared=shared):
            own = shared.value
            for batch in batches:
                texts, keep = batch.column(names.index("text")).to_pylist(), np.ones(batch.num_rows, bool)
                for a, b in text_blocks(texts):
                    for d, *_ in best_matches(own, texts[a:b]):
                        keep[a + d] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(releasing(rows), docs.schema)
    return docs


by_value(__name__)
