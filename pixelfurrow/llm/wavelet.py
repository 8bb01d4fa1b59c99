"""Token ids in wavelet matrices: one compressed file per shard.

A shard holds the ids of consecutive documents. Its wavelet matrix has a bit-plane for each bit of the largest id, from
the highest. A file stores each plane in pieces of 2^19 bits that are compressed one by one, and the plane's rank directory:
the ones in every 512 bits. Its head tells where all of these are. A reader opens a plane's directory and the pieces that a
question touches, so with rank and select on planes the file answers access(i), rank(id, i) and select(id, k) without being
read whole or unpacked to ids.

Texts are dealt by ranges of doc_id and sorted, encoded, and written shard by shard: first under a name of the task
attempt's own. Only the files in the written index of a finished job are read, so lost executors and repeated attempts
leave no trace in results. A shard ends after SHARD ids; a longer document is a shard of its own.

Defined results: null is as the empty text, which has the end id alone. Repeated doc_ids each keep a row, in any order
among themselves. A null doc_id comes first. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pixelfurrow.llm.common import by_value, fresh_path, kept, parallel, written

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID, SHARD, STEP, PIECE, MEMO = 2, 4 << 20, 512, 1 << 16, 600_000
MAGIC = b"WVMX2\n"


class WaveletMatrix:
    """Bit-planes over a sequence of non-negative ids."""

    def __init__(self, n: int, planes: list, ones=None):
        """planes: number of zeros, packed bits; from the highest bit. ones: of each plane, before every STEP-th bit and in all."""
        self.n, self.planes = n, planes
        self.ones = [_ones(bits) for _, bits in planes] if ones is None else ones

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = np.asarray(ids)
        width = max(1, int(ids.max(initial=0)).bit_length())
        ids, planes = ids.astype(np.uint16 if width <= 16 else np.uint32), []
        for level in range(width - 1, -1, -1):
            bit = (ids & ids.dtype.type(1 << level)) != 0
            zeros = ids[~bit]
            planes.append((len(zeros), np.packbits(bit, bitorder="little")))
            if level:
                ids = np.concatenate([zeros, ids[bit]])
        return cls(len(ids) if planes else 0, planes)

    def bit(self, level: int, i: int) -> int:
        return int(self.planes[level][1][i >> 3] >> (i & 7) & 1)

    def rank1(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        block = i // STEP
        raw = self.planes[level][1][block * STEP // 8 : (i + 7) // 8]
        total = int(np.bitwise_count(raw).sum()) if len(raw) else 0
        if i & 7 and len(raw):
            total -= int(raw[-1] >> (i & 7)).bit_count()
        return int(self.ones[level][block]) + total

    def _down(self, level: int, i: int, one: int) -> int:
        ones = self.rank1(level, i)
        return self.planes[level][0] + ones if one else i - ones

    def access(self, i: int) -> int:
        out = 0
        for level in range(len(self.planes)):
            one = self.bit(level, i)
            out, i = out << 1 | one, self._down(level, i, one)
        return out

    def _range(self, id_: int, a: int, b: int) -> tuple[int, int]:
        if id_ >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            one = id_ >> (len(self.planes) - 1 - level) & 1
            a, b = self._down(level, a, one), self._down(level, b, one)
        return a, b

    def rank(self, id_: int, i: int) -> int:
        """How often id_ occurs before position i."""
        a, b = self._range(id_, 0, i)
        return b - a

    def select(self, id_: int, k: int) -> int:
        """Where id_ occurs for the k-th time (from 0); -1 if it doesn't."""
        a, b = self._range(id_, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        i = a + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = id_ >> (len(self.planes) - 1 - level) & 1
            i = self._select(level, one, i - self.planes[level][0] if one else i)
        return i

    def _select(self, level: int, one: int, k: int) -> int:
        """The position of a plane's k-th bit of that value."""
        low, high = 0, self.n
        while low < high:  # the least i with more than k such bits up to and with i
            mid = (low + high) // 2
            ones = self.rank1(level, mid + 1)
            if (ones if one else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def ids(self) -> np.ndarray:
        """All ids, by undoing the planes from the lowest."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level, (zeros, raw) in enumerate(reversed(self.planes)):
            bit = np.unpackbits(raw[:], count=self.n, bitorder="little").view(bool)
            new = np.empty(self.n, kind)
            new[~bit] = out[:zeros]
            new[bit] = out[zeros:] | kind(1 << level)
            out = new
        return out


def _ones(bits: np.ndarray) -> np.ndarray:
    """Ones before every STEP-th bit, and in all."""
    per = np.bitwise_count(np.pad(bits, (0, -len(bits) % (STEP // 8)))).reshape(-1, STEP // 8).sum(1, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(per)])


class Pieces:
    """The bits of a plane in a file, by pieces read when they are asked for; a slice lies in one piece or takes all."""

    def __init__(self, read, at: list[int]):
        self.read, self.at, self.held = read, at, {}

    def piece(self, k: int) -> np.ndarray:
        if k not in self.held:
            self.held[k] = np.frombuffer(zstandard.decompress(self.read(self.at[k], self.at[k + 1] - self.at[k])), np.uint8)
        return self.held[k]

    def __getitem__(self, i):
        if not isinstance(i, slice):
            return self.piece(i // PIECE)[i % PIECE]
        if i.start is None:
            return np.concatenate([np.zeros(0, np.uint8), *(self.piece(k) for k in range(len(self.at) - 1))])
        if i.start >= i.stop:
            return np.zeros(0, np.uint8)
        k = i.start // PIECE
        return self.piece(k)[i.start - k * PIECE : i.stop - k * PIECE]


class Directories:
    """The rank directories of a file's planes, read when they are asked for."""

    def __init__(self, read, at: list[tuple[int, int]]):
        self.read, self.at, self.held = read, at, {}

    def __getitem__(self, level: int) -> np.ndarray:
        if level not in self.held:
            per = np.frombuffer(zstandard.decompress(self.read(*self.at[level])), "<u2")
            self.held[level] = np.concatenate([[0], np.cumsum(per, dtype=np.int64)])
        return self.held[level]


def to_bytes(matrix: WaveletMatrix, docs: dict) -> bytes:
    """docs: doc_id and n_tokens lists."""
    parts, sizes = [], []
    for (_, bits), ones in zip(matrix.planes, matrix.ones, strict=True):
        own = [zstandard.compress(np.diff(ones).astype("<u2").tobytes(), 1), *(zstandard.compress(bits[a : a + PIECE].tobytes(), 1) for a in range(0, len(bits), PIECE))]
        parts += own
        sizes.append([len(x) for x in own])
    head = zstandard.compress(json.dumps(docs | {"n": matrix.n, "zeros": [z for z, _ in matrix.planes], "sizes": sizes}).encode(), 1)
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])


def opened(read) -> tuple[WaveletMatrix, dict]:
    """The matrix of a file; read(at, n) gives its bytes from at on."""
    start = read(0, len(MAGIC) + 4)
    assert start.startswith(MAGIC), "no wavelet file"
    size = struct.unpack("<I", start[len(MAGIC) :])[0]
    docs, at, planes, ones = json.loads(zstandard.decompress(read(len(start), size))), len(start) + size, [], []
    for zeros, sizes in zip(docs["zeros"], docs["sizes"], strict=True):
        ends = (at + np.cumsum([0, *sizes])).tolist()
        ones.append((at, sizes[0]))
        planes.append((zeros, Pieces(read, ends[1:])))
        at = ends[-1]
    return WaveletMatrix(docs["n"], planes, Directories(read, ones)), docs


def from_bytes(raw: bytes) -> tuple[WaveletMatrix, dict]:
    return opened(lambda at, n: raw[at : at + n])


class Encoder:
    """Ids by the tokenizers library, each distinct chunk between spaces once. A chunk of Latin letters with marks after them
    needs no normaliser and splits by sight; others go through the library's normaliser and pre-tokenizer. The library cuts
    texts at its added tokens before all that, so a text that may hold one goes through the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.all = Tokenizer.from_file(path)
        added = self.all.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if not t.normalized]
        self.first = {t[0] for t in self.added}
        self.whole = any(t.normalized for t in added)  # these are looked for in the normal text
        self.chunks = Chunks(self.chunk)
        self.pieces: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 400))
        self.byte = [chr(b) if b in shown else chr(next(rest)) for b in range(256)]
        self.simple = regex.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|$%&*#()\"-]*)").fullmatch

    def piece(self, shown: str) -> bytes:
        """shown: a piece in the library's letters for bytes."""
        found = self.pieces.get(shown)
        if found is None:
            found = np.array([t.id for t in self.all.model.tokenize(shown)], np.uint32).tobytes()
            if len(self.pieces) < MEMO:
                self.pieces[shown] = found
        return found

    def chunk(self, chunk: str) -> bytes:
        if m := self.simple(chunk):
            word = m[1].lower()
            out = self.piece(word if word.isascii() else "".join(map(self.byte.__getitem__, word.encode())))
            return out + self.piece(m[2]) if m[2] else out
        normal = self.all.normalizer.normalize_str(chunk)
        return b"".join(self.piece(p) for p, _ in self.all.pre_tokenizer.pre_tokenize_str(normal))

    def ids(self, text: str | None) -> bytes:
        """Unsigned 32-bit little endian ids."""
        if not text:
            return b""
        if self.whole or (any(c in text for c in self.first) and any(t in text for t in self.added)):
            return np.array(self.all.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        if len(self.chunks) > MEMO:
            self.chunks.clear()
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


class Chunks(dict):
    """The ids of chunks, found when they are first asked for."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, chunk):
        ids = self[chunk] = self.find(chunk) if chunk else b""
        return ids


def write_shards(vocabulary: str, folder: str, shard: int):
    def write(batches):
        from pyspark import TaskContext

        encode = kept(("encoder", vocabulary), lambda: Encoder(vocabulary))
        store, root = pafs.FileSystem.from_uri(folder)
        part, seq, docs, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        end = np.uint32(END_ID).tobytes()

        def flush():
            nonlocal seq, docs, ids, size
            matrix = WaveletMatrix.of(np.frombuffer(b"".join(ids), np.uint32))
            name = f"{part:08d}-{seq:06d}-{uuid.uuid4().hex}.wvm"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(to_bytes(matrix, {"doc_id": docs, "n_tokens": [len(x) // 4 for x in ids]}))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name], "n": pa.array([matrix.n], pa.int64())})
            seq, docs, ids, size = seq + 1, [], [], 0
            return row

        store.create_dir(root, recursive=True)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = encode.ids(text) + end
                if size and size + len(new) > 4 * shard:
                    yield flush()
                docs.append(doc)
                ids.append(new)
                size += len(new)
        if docs:
            yield flush()

    return write


def write(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, shard: int = SHARD) -> tuple[str, DataFrame]:
    """The folder, and the index of its files: part, seq, file, n; the written order is that of part and seq."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "wavelet")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parallel(docs), "doc_id").sortWithinPartitions("doc_id")
    return folder, written(rows.mapInArrow(write_shards(vocabulary, folder, shard), "part int, seq int, file string, n long"), "wavelet-index")


def read_shard(folder: str, name: str) -> tuple[WaveletMatrix, dict]:
    """The whole file at once."""
    store, root = pafs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/{name}") as source:
        return from_bytes(source.read())


def open_shard(folder: str, name: str) -> tuple[WaveletMatrix, dict]:
    """The file, of which only what questions touch is read."""
    store, root = pafs.FileSystem.from_uri(folder)
    source = store.open_input_file(f"{root}/{name}")

    def read(at: int, n: int) -> bytes:
        return source.read_at(n, at)

    return opened(read)


ROWS = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def read(folder: str, index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    spark = index.sparkSession
    sums, total = {}, 0  # one number for each partition, not for each file
    for r in index.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        sums[r.part], total = total, total + r.n
    files = index.join(F.broadcast(spark.createDataFrame([*sums.items()], "part int, base long")), "part")
    files = files.selectExpr("file", "base + sum(n) over (partition by part order by seq) - n as start").repartition(parallel(index), "file")

    def digest(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                matrix, docs = read_shard(folder, name)
                ids, n = matrix.ids().astype("<u4"), np.array(docs["n_tokens"], np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[b - k : b]) for b, k in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs["doc_id"], pa.int64()), pa.array(start + ends - n), pa.array(n), pa.array(crc, pa.int64())], ROWS.names)

    return files.mapInArrow(digest, ROWS)


def op8(spark, sf_dir: str) -> DataFrame:
    folder, index = write(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read(folder, index)


by_value(__name__)
