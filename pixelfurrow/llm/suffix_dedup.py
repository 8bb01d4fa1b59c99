"""Repeated windows by a depth-limited radix sort of suffixes.

Suffixes are told apart through `width` bytes only. A window's most significant digit is its anchor: the GRAM-byte string
in it with the least hash (the leftmost of equals), which equal windows have in common, at the same place. Windows that
follow each other mostly share an anchor, so one row stands for a run of them, and the passes go over rows:

1. Texts in the order of documents are cut into blocks, which are numbered and written. In a first pass rows meet by their
   anchor, which tells the anchors that have runs of more than one content, and by the run's whole content, which tells
   the runs that are wholly repeated: all but the earliest of equal content. Other anchors are done.
2. In the second pass the runs under those anchors that aren't repeated are parted into windows, whose digits now are all
   of their bytes. Equal groups are exactly the repeated windows; all but the earliest of a group are repeated.

Digits are compared as 64-bit hashes and 32 bits of another. A block sends each digit once, packed (see exchange.py), so a
passage or a text that many documents share, and an anchor with many contents, are a row a block at most; what is earliest
follows from the blocks' order, and answers come back by order alone.

Defined results: null is as the empty text. Texts shorter than a window stay whole. Null doc_ids come before all others.
Rows of the same doc_id and text are one document, and each gets its result; where a doc_id or null has several texts,
each is a document, in the order of a hash. Texts of any length are read in pieces. Other columns may have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelfurrow.llm.common import by_value, column, forget, fresh_path, releasing, written
from pixelfurrow.llm.exchange import FILE, NAMES, PARCELS, buckets_of, file_of, file_row, in_order, load_table, of_block, opened, parcels, planes, replies, store_table, unplaned
from pixelfurrow.llm.ngram_join import mixed

WIDTH, GRAM, BLOCK, PIECE, PART, WINDOWS_AT_ONCE = 100, 32, 8 << 20, 1 << 20, 1 << 18, 1 << 19
RUNS, ANCHORS, WINDOWS = 1, 2, 3
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each index on."""
    h, step = data.astype(np.uint64) + np.uint64(1), 1
    odd = 0xC2B2AE3D27D4EB4F
    while step < GRAM:
        h = h[: len(h) - step] * np.uint64(odd) + (h[step:] ^ np.uint64(0x5851F42D4C957F2D))
        h ^= h >> np.uint64(29)
        odd = odd * 0xD6E8FEB86659FD93 % (1 << 64) | 1
        step *= 2
    return mixed(h)


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    step = 1
    while step * 2 <= w:
        x = np.minimum(x[: len(x) - step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (w - step)], x[w - step :]) if w > step else x


class Contents:
    """Hashes of stretches of data by sums of their gram hashes."""

    def __init__(self, grams: np.ndarray):
        power = np.full(len(grams) + 1, BASE, np.uint64)
        power[:1] = 1
        inverse = np.full(len(grams) + 1, INVERSE, np.uint64)
        inverse[:1] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(grams ^ np.uint64(0xA5A5A5A55A5A5A5A)) * np.multiply.accumulate(power)[:-1])])

    def of(self, first: np.ndarray, grams: np.ndarray) -> np.ndarray:
        return mixed((self.sums[first + grams] - self.sums[first]) * self.inverse[first])


def runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int):
    """Of each run of windows with one anchor: its segment, first start there, length, anchor hash and content hash."""
    grams = gram_hashes(data)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_minimum(key, width - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    marks = np.zeros(len(data) + 1, np.int8)
    np.add.at(marks, starts[sizes >= width], 1)
    np.add.at(marks, (starts + sizes - width + 1)[sizes >= width], -1)
    at = np.flatnonzero(np.cumsum(marks[: len(anchor)]))
    if not len(at):
        return None
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (anchor[at[1:]] != anchor[at[:-1]])]))
    first, n = at[new], np.diff([*new, len(at)])
    segment = np.searchsorted(starts, first, "right") - 1
    place = (anchor[first] - first).astype(np.uint64)
    content = mixed(Contents(grams).of(first, n + width - GRAM) + place * BASE + n.astype(np.uint64))
    return segment, first - starts[segment], n, grams[anchor[first]], content


def windows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int):
    """Of each window: its segment, its start there, two hashes."""
    grams = gram_hashes(data)
    n = np.maximum(sizes - width + 1, 0)
    segment = np.repeat(np.arange(len(starts)), n)
    place = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
    at, span = starts[segment] + place, np.full(len(segment), width - GRAM + 1)
    return segment, place, np.ones(len(segment), np.int64), Contents(grams).of(at, span), Contents(mixed(grams ^ BASE)).of(at, span)


def parts(starts: np.ndarray, sizes: np.ndarray, width: int):
    """Lists of (first byte, size) of pieces of the stretches, each list of about PART bytes; pieces of a long stretch overlap
    so that each window lies in one."""
    own, total = [], 0
    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        for at in range(0, max(1, size - width + 1), PIECE):
            n = min(size - at, PIECE + width - 1)
            own.append((start + at, n))
            total += n
            if total >= PART:
                yield own
                own, total = [], 0
    if own:
        yield own


def looked(data: np.ndarray, own: list[tuple[int, int]], width: int, look):
    """look over the pieces of a list: where each row starts in data, and what else look tells."""
    sizes = np.array([n for _, n in own])
    joined = np.concatenate([data[a : a + n] for a, n in own])
    found = look(joined, np.cumsum(sizes) - sizes, sizes, width) if len(joined) >= width else None
    if found is None:
        return None
    segment, place, *rest = found
    return np.array([a for a, _ in own], np.int64)[segment] + place, *rest


def all_runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int):
    """Start, length, anchor hash and content hash of each run of windows."""
    found = [x for own in parts(starts, sizes, width) if (x := looked(data, own, width, runs)) is not None]
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    return [np.concatenate(x) for x in zip(empty, *found, strict=True)]


class Digits:
    """Equal (key, val) of a block's rows, given in the order of the text."""

    def __init__(self, key: np.ndarray, val: np.ndarray):
        self.order = np.lexsort((np.arange(len(key)), val, key))
        key, val = key[self.order], val[self.order]
        self.new = np.concatenate([[True], (key[1:] != key[:-1]) | (val[1:] != val[:-1])]) if len(key) else np.zeros(0, bool)
        self.key, self.val = key[self.new], val[self.new]

    def repeated(self, earlier: np.ndarray) -> np.ndarray:
        """Which rows repeat one before them, here or (earlier) in a block before."""
        out = np.empty(len(self.order), bool)
        again = ~self.new
        again[self.new] = earlier.astype(bool)
        out[self.order] = again
        return out


def low(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class Runs:
    """A block's runs, and their digits."""

    def __init__(self, data, starts, sizes, width):
        self.at, self.n, anchor, content = all_runs(data, starts, sizes, width)
        self.anchor = mixed(anchor)  # the least of many hashes lie in the lowest buckets, most of them in the first
        self.contents = Digits(content, low(self.anchor))
        order = np.lexsort((content, self.anchor))
        a, b = self.anchor[order], content[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        self.anchors = a[first]
        last = np.append(first[1:], len(a))[: len(first)] - 1
        self.seen = low(b[first]).astype(np.uint64) << np.uint64(1) | (b[first] != b[last])  # the last bit: more than one content here


def block_rows(folder: str, width: int, buckets: int):
    """Writes a file of each block's rows and one of its bytes, and sends its runs' digits. Columns: row, doc, own, text; sorted by doc and own."""

    def rows(batches):
        forget()
        held, texts, last, size, block = [], [], None, 0, TaskContext.get().partitionId() << 32

        def flush():
            kept = pa.Table.from_batches([pa.RecordBatch.from_arrays([*x.flatten(), k], [f"c{i}" for i in range(x.type.num_fields)] + ["k"]) for x, k in held])
            sizes = np.array([len(t) for t in texts], np.int64)
            data = np.frombuffer(b"".join(texts), np.uint8)
            name = store_table(folder, kept)
            raw = store_table(folder, pa.table({"sizes": [sizes], "data": [planes(data)]}))
            held.clear()
            texts.clear()
            yield file_row(block, name, raw.encode())
            found = Runs(data, np.cumsum(sizes) - sizes, sizes, width)
            yield parcels(RUNS, block, found.contents.key, found.contents.val, buckets)
            yield parcels(ANCHORS, block, found.anchors, found.seen, buckets)

        for batch in batches:
            row, doc, own = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            numbers, first = [], 0
            for k, text in enumerate(batch.column(3).cast(pa.binary()).to_pylist()):
                new = (doc[k], own[k], text or b"")
                if new != last:
                    if texts and size + len(new[2]) > BLOCK:
                        held.append((row.slice(first, k - first), pa.array(numbers, pa.int32())))
                        yield from flush()
                        numbers, first, size, block = [], k, 0, block + 1
                    texts.append(new[2])
                    last, size = new, size + len(new[2])
                numbers.append(len(texts) - 1)
            held.append((row.slice(first), pa.array(numbers, pa.int32())))
        if texts:
            yield from flush()

    return rows


def first_pass(rows: pa.Table) -> pa.Table:
    """Of a bucket's runs: those whose content an earlier block has; of its anchors: those with more than one content."""
    kind = rows.column("kind")[0].as_py()
    return rows.select(NAMES) if kind == FILE else several(rows) if kind == ANCHORS else earlier(rows)


def earlier(rows: pa.Table) -> pa.Table:
    if rows.column("kind")[0].as_py() == FILE:
        return rows.select(NAMES)
    rows = in_order(rows)
    keys, vals, cuts, row = opened(rows, np.uint32)
    vals = np.concatenate([v[0] for v in vals])
    order = np.lexsort((row, vals, keys))
    again = np.zeros(len(keys), np.uint8)
    again[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (vals[order[1:]] == vals[order[:-1]])
    return replies(rows, [planes(again[a:b]) for a, b in cuts])


def several(rows: pa.Table) -> pa.Table:
    keys, vals, cuts, _ = opened(rows, np.uint64)
    vals = np.concatenate([v[0] for v in vals])
    order = np.lexsort((vals, keys))
    k, v = keys[order], vals[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    ends = np.append(first[1:], len(k))
    more = (v[first] != v[ends - 1]) | (np.bitwise_or.reduceat(v, first) & np.uint64(1)).astype(bool)
    out = np.empty(len(k), np.uint8)
    out[order] = np.repeat(more, ends - first)
    return replies(rows, [planes(out[a:b]) for a, b in cuts])


def bytes_of(folder: str, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's bytes, and where its documents' begin and how many they are."""
    name = next(bytes(v).decode() for k, v in zip(rows.column("kind").to_pylist(), rows.column("vals").to_pylist(), strict=True) if k == FILE)
    own = load_table(folder, name)
    sizes = own.column("sizes")[0].values.to_numpy()
    return unplaned(own.column("data")[0].as_py(), np.uint8), np.cumsum(sizes) - sizes, sizes


def stretches(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows that follow each other made one."""
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + n[:-1]])) if len(at) else np.zeros(0, np.int64)
    return at[new], np.add.reduceat(n, new) if len(new) else n


def window_digits(data: np.ndarray, at: np.ndarray, n: np.ndarray, width: int):
    """Start and two hashes of each window of the stretches, in lists of about WINDOWS_AT_ONCE."""
    held, size = [], 0
    for own in parts(at, n + width - 1, width):
        found = looked(data, own, width, windows)
        if found is not None:
            held.append((found[0], found[2], low(found[3])))
            size += len(found[0])
            if size >= WINDOWS_AT_ONCE:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, size = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def second_pass(folder: str, width: int, buckets: int):
    """Of a block: writes which runs are repeated and which are looked at by window; sends the digits of those windows."""

    def rows(answers: pa.Table) -> pa.Table:
        data, starts, sizes = bytes_of(folder, answers)
        found = Runs(data, starts, sizes, width)
        again = found.contents.repeated(of_block(answers, RUNS, np.uint8, 1)[0])
        more = of_block(answers, ANCHORS, np.uint8, 1)[0].astype(bool)
        look = np.flatnonzero(~again & more[np.searchsorted(found.anchors, found.anchor)]) if len(again) else np.zeros(0, np.int64)
        gone, open_ = stretches(found.at[again], found.n[again]), stretches(found.at[look], found.n[look])
        state = store_table(folder, pa.table({k: [x] for k, x in zip(("at", "n", "open_at", "open_n"), (*gone, *open_), strict=True)}))
        old = answers.filter(pc.equal(answers.column("kind"), FILE)).select(NAMES).slice(0, 1).to_batches()[0]
        block = old.column(2)[0].as_py()
        out = [old, file_row(block, state, b"state")]
        for k, (_, a, b) in enumerate(window_digits(data, *open_, width)):
            digits = Digits(a, b)
            out.append(parcels(WINDOWS + k, block, digits.key, digits.val, buckets))
        return pa.Table.from_batches([x.cast(out[0].schema) for x in out])

    return rows


def cut(docs: DataFrame, width: int, make, schema) -> DataFrame:
    """make(rows, data, starts, sizes, gone) of each block: rows has docs' columns but text, by number, and k, the document's
    number in the block; data, starts and sizes are its documents' bytes, and gone tells which bytes repeated windows cover."""
    folder, buckets = fresh_path(docs.sparkSession, "suffix-blocks"), buckets_of(docs)
    rows = docs.select(F.struct(*(column(n) for n in docs.columns if n != "text")).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"), "text")
    rows = rows.repartitionByRange(buckets, "doc", "own").sortWithinPartitions("doc", "own")
    sent = rows.mapInArrow(releasing(block_rows(folder, width, buckets)), PARCELS)
    found = written(sent.groupBy("kind", "bucket").applyInArrow(releasing(first_pass), PARCELS), "runs")
    sent = found.repartition(buckets, "block").groupBy("block").applyInArrow(releasing(second_pass(folder, width, 4 * buckets)), PARCELS)
    table = written(sent.groupBy("bucket").applyInArrow(releasing(earlier), PARCELS), "windows")

    def finish(answers: pa.Table) -> pa.Table:
        is_state = [k == FILE and v == b"state" for k, v in zip(answers.column("kind").to_pylist(), answers.column("vals").to_pylist(), strict=True)]
        state = load_table(folder, file_of(answers.filter(pa.array(is_state))))
        answers = answers.filter(pa.array([not x for x in is_state]))
        data, starts, sizes = bytes_of(folder, answers)
        at, n, open_at, open_n = (state.column(c)[0].values.to_numpy() for c in ("at", "n", "open_at", "open_n"))
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n + width - 1, -1)
        for k, (place, a, b) in enumerate(window_digits(data, open_at, open_n, width)):
            place = place[Digits(a, b).repeated(of_block(answers, WINDOWS + k, np.uint8, 1)[0])]
            np.add.at(edge, place, 1)
            np.add.at(edge, place + width, -1)
        return make(load_table(folder, file_of(answers)), data, starts, sizes, np.cumsum(edge[:-1], dtype=np.int32) > 0)

    return table.repartition(buckets, "block").groupBy("block").applyInArrow(releasing(finish), schema)


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs."""

    def make(rows, data, starts, sizes, gone):
        begins = gone & ~np.concatenate([[False], gone[:-1]])
        some = starts[sizes > 0]
        begins[some] = gone[some]

        def inside(marks):
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(marks)])
            return sums[starts + sizes] - sums[starts]

        removed, spans = inside(gone), inside(begins)
        digests = [hashlib.sha256(data[a : a + n][~gone[a : a + n]] if m else data[a : a + n]).hexdigest() for a, n, m in zip(starts.tolist(), sizes.tolist(), removed.tolist(), strict=True)]
        k = rows.column("k").to_numpy()
        return pa.table([rows.column("c0"), pa.array(sizes[k]), pa.array(removed[k], pa.int64()), pa.array(spans[k], pa.int64()), pa.array([digests[x] for x in k.tolist()], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7(spark, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated windows out of the texts; characters that would be cut in half go whole. Null texts stay null. n_chars
    follows where it is there and holds whole numbers."""
    names, schema = docs.columns, docs.schema
    counts = "n_chars" in names and isinstance(schema["n_chars"].dataType, T.IntegralType)

    def make(rows, data, starts, sizes, gone):
        texts = []
        for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            raw, own = data[a : a + n], gone[a : a + n]
            if own.any():
                chars = np.cumsum((raw & 0xC0) != 0x80) - 1
                raw = raw[~(np.bincount(chars, own, chars[-1] + 1) > 0)[chars]]
            texts.append(raw.tobytes().decode("utf-8", "replace"))
        k, out, number = rows.column("k").to_pylist(), [], 0
        none = rows.column(f"c{len(names) - 1}").to_pylist()
        new = [None if x else texts[i] for i, x in zip(k, none, strict=True)]
        for name in names:
            if name == "text":
                out.append(pa.array(new, pa.string()))
                continue
            old = rows.column(f"c{number}")
            out.append(pa.array([None if t is None else len(t) for t in new], old.type) if counts and name == "n_chars" else old)
            number += 1
        return pa.table(out, names)

    none = next(x for x in (f"none{k}" for k in range(len(names) + 1)) if x not in names)
    return cut(docs.withColumn(none, F.col("text").isNull()), WIDTH, make, schema)


by_value(__name__)
