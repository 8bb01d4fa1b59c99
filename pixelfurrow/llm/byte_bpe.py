"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

1. Texts are read once, in blocks of bounded size, and split into pre-tokens. A document becomes its pre-tokens' numbers by
   position, which go to a file of the block; the block's distinct pre-tokens go, by hash, to buckets.
2. In a bucket equal pre-tokens of all blocks meet, so that each distinct one of all texts is encoded exactly once; its ids
   go back to the blocks that hold it, by the pre-token's number there.
3. Each block puts its documents together by position, and decodes their ids by the table of token bytes, whose size is the
   vocabulary's.

A pre-token that is common to all texts is thus sent once a block at most, and no task gathers more than a block or a
bucket. Blocks are told apart by their place in the input, whatever they hold; see exchange.py for lost executors.
Defined results: null is as the empty text, with 0 tokens. Repeated rows and repeated doc_ids each give a row of their
own. Only doc_id and text are read. A text longer than a block is a block of its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelfurrow.llm.common import Numbers, by_value, fresh_path, kept, releasing
from pixelfurrow.llm.exchange import FILE, NAMES, PARCELS, buckets_of, file_of, file_row, load_table, packed_keys, planes, store_table, unpacked_keys, unplaned

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BLOCK, MEMO, WORDS = 8 << 20, 300_000, 1


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Splitter:
    """Pre-tokens of texts. A chunk from one space up to the next splits by itself, so distinct chunks are split once; texts
    with white space runs go through the pattern whole. Keys are chunks with a space before them, or (text,) for stretches
    at a text's beginning."""

    def __init__(self, pattern: str):
        # tiktoken's \s is Unicode's White_Space, which Python's isn't
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.runs = regex.compile(r"\p{White_Space}\p{White_Space}|^\p{White_Space}").search
        self.odd = re.compile("[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search  # white space but " "
        self.memo: dict[str, tuple[str, ...]] = {}

    def keys(self, text: str) -> list:
        if "  " in text or text[0] == " " or (self.odd(text) and self.runs(text)):
            return [(text,)]
        parts = text.split(" ")
        parts[0] = (parts[0],)
        return parts

    def of(self, key) -> tuple[str, ...]:
        if type(key) is tuple:
            return tuple(self.find(key[0]))
        word = key.rstrip(".,;:!?|$%&*#")
        if word.isalpha():  # letters, then marks: the pattern parts them there
            return (" " + word,) if len(word) == len(key) else (" " + word, key[len(word) :])
        found = self.memo.get(key)
        if found is None:
            found = tuple(self.find(" " + key))
            if len(self.memo) < MEMO:
                self.memo[key] = found
        return found


def gathered(values: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The stretches of values, which have those sizes one after the other, in the order at."""
    n = sizes[at]
    first = (np.cumsum(sizes) - sizes)[at]
    ends = np.cumsum(n)
    return values[np.repeat(first - (ends - n), n) + np.arange(n.sum())]


def block_of(split: Splitter, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pre-tokens of texts, the commonest first after an empty one; the numbers of all texts' pre-tokens; how many each text has."""
    numbers, parts = Numbers(), []
    for text in texts:
        keys = split.keys(text) if text else []
        parts.append(np.fromiter(map(numbers.__getitem__, keys), np.int64, len(keys)))
    own, flat, sizes = Numbers({"": 0}), [], np.zeros(len(numbers), np.int64)
    for k, key in enumerate(numbers):
        found = split.of(key)
        sizes[k] = len(found)
        flat.extend(map(own.__getitem__, found))
    at = np.concatenate([*parts, np.zeros(0, np.int64)])
    seq = gathered(np.array(flat, np.int64), sizes, at)
    order = np.argsort(-np.bincount(seq, minlength=len(own))[1:], kind="stable") + 1  # low numbers for the commonest pack best
    rank = np.zeros(len(own), np.int64)
    rank[order] = np.arange(1, len(own))
    words = [*own]
    return ["", *map(words.__getitem__, order.tolist())], rank[seq], np.array([sizes[p].sum() for p in parts], np.int64)


def packed_words(words: list[bytes]) -> bytes:
    sizes = planes(np.fromiter(map(len, words), np.uint32, len(words)))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.compress(b"".join(words), 1)


def unpacked_words(raw: bytes) -> list[bytes]:
    cut = 4 + int.from_bytes(raw[:4], "little")
    ends, data = np.cumsum(unplaned(raw[4:cut], np.uint32), dtype=np.int64).tolist(), zstandard.decompress(raw[cut:])
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def block_rows(folder: str, pattern: str, buckets: int):
    """Writes a file of each block: its documents' ids and sizes, and their pre-tokens' numbers; rows are PARCELS."""

    def rows(batches):
        split = kept(("splitter", pattern), lambda: Splitter(pattern))
        held, size, block = [], 0, TaskContext.get().partitionId() << 32

        def flush():
            words, seq, sizes = block_of(split, [t for _, t in held])
            name = store_table(folder, pa.table({"doc_id": pa.array([[d for d, _ in held]], pa.list_(pa.int64())), "n": [sizes], "seq": [planes(seq.astype(np.uint32))]}))
            held.clear()
            yield file_row(block, name)
            raw = [w.encode() for w in words]
            at = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) * buckets >> 32
            order = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.diff(at[order], prepend=-1, append=buckets)).tolist()
            parts = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            keys = [packed_keys(p.astype(np.uint64)) for p in parts]
            vals = [packed_words([raw[k] for k in p.tolist()]) for p in parts]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([WORDS] * n, pa.int32()), pa.array([int(at[p[0]]) for p in parts], pa.int32()), pa.array([block] * n, pa.int64()), pa.array(keys, pa.binary()), pa.array(vals, pa.binary())], NAMES)

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = len(row[1] or "")
                if held and size + new > BLOCK:
                    yield from flush()
                    size, block = 0, block + 1
                held.append(row)
                size += new
        if held:
            yield from flush()

    return rows


class Codes(dict):
    """The ids of words, each encoded when it is first asked for."""

    def __init__(self, core):
        self.core = core

    def __missing__(self, word):
        ids = self[word] = array("I", self.core.encode_single_piece(word) if word else ()).tobytes()
        return ids


def encode_words(vocabulary: str, pattern: str):
    """Of a bucket's rows: the ids of each row's words, by the words' numbers."""

    def encode(rows: pa.Table) -> pa.Table:
        if rows.column("kind")[0].as_py() == FILE:
            return rows.select(NAMES)
        core = kept(("bpe", vocabulary), lambda: tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(vocabulary), special_tokens={}))._core_bpe
        codes, answers = Codes(core), []
        for raw in rows.column("vals").to_pylist():
            ids = [*map(codes.__getitem__, unpacked_words(raw))]
            sizes = planes(np.fromiter(map(len, ids), np.uint32, len(ids)))
            answers.append(len(sizes).to_bytes(4, "little") + sizes + planes(np.frombuffer(b"".join(ids), "<u4")))
        return pa.table([*(rows.column(c) for c in NAMES[:4]), pa.array(answers, pa.binary())], NAMES)

    return encode


OUT = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("ids", T.BinaryType()), ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))])


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, ids: bool = True) -> DataFrame:
    """doc_id, ids (binary, unsigned 32-bit little endian; null if not asked for), n_tokens, ids_sha256 and decoded_sha256 of each row."""
    folder, buckets = fresh_path(docs.sparkSession, "bpe-blocks"), buckets_of(docs)
    sent = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(block_rows(folder, pattern, buckets)), PARCELS)
    back = sent.groupBy("kind", "bucket").applyInArrow(releasing(encode_words(vocabulary, pattern)), PARCELS)

    def assemble(right: pa.Table) -> pa.Table:
        token = kept(("tokens", vocabulary), lambda: {i: b for b, i in ranks(vocabulary).items()})
        left, own, shown = load_table(folder, file_of(right)), {}, {}
        for kind, keys, raw in zip(*(right.column(c).to_pylist() for c in ("kind", "keys", "vals")), strict=True):
            if kind == WORDS:
                cut = 4 + int.from_bytes(raw[:4], "little")
                ends, data = np.cumsum(unplaned(raw[4:cut], np.uint32), dtype=np.int64).tolist(), unplaned(raw[cut:], "<u4").tobytes()
                own.update(zip(unpacked_keys(keys).tolist(), [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        shown = {k: "".join([f"{i}," for i in np.frombuffer(r, "<u4").tolist()]) for k, r in own.items()}
        seq, at = unplaned(left.column("seq")[0].as_py(), np.uint32), 0
        out: list[list] = [[], [], [], []]
        for n in left.column("n")[0].as_py():
            part, at = seq[at : at + n].tolist(), at + n
            raw = b"".join(map(own.__getitem__, part))
            text = "".join(map(shown.__getitem__, part))[:-1]
            back = b"".join(map(token.__getitem__, np.frombuffer(raw, "<u4").tolist()))
            for column, x in zip(out, (raw if ids else None, len(raw) // 4, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(back).hexdigest()), strict=True):
                column.append(x)
        return pa.table([left.column("doc_id")[0].values, *(pa.array(x, k) for x, k in zip(out, (pa.binary(), pa.int64(), pa.string(), pa.string()), strict=True))], OUT.names)

    return back.repartition(buckets, "block").groupBy("block").applyInArrow(releasing(assemble), OUT)


def decoded(encodings: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); bytes that are no UTF-8 become U+FFFD."""

    def decode(batches):
        token = kept(("tokens", vocabulary), lambda: {i: b for b, i in ranks(vocabulary).items()})
        for batch in batches:
            texts = [None if r is None else b"".join(map(token.__getitem__, np.frombuffer(r, np.uint32).tolist())).decode("utf-8", "replace") for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encodings.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def op9(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids and their digests, in place of its text."""
    return encoded(docs)


by_value(__name__)
