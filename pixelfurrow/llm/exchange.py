"""Keys of blocks of texts that meet in buckets, packed.

A block sends its sorted 64-bit keys, with values, to buckets by the keys' highest bits: one row a block, kind and bucket
that holds any, with keys as compressed differences and values as compressed planes of bytes. What a bucket finds goes back
by order alone: an array as long as the keys that came. Buckets are as many as BUCKET bytes of text need, so what
a task gathers doesn't grow with the input, and a key that all blocks hold is one key a block in its bucket if blocks send
distinct keys.

Blocks are numbered by partition and place there. Their texts, or what was made of them, are files of a task attempt's own
name in the shared folder; a block's row of kind FILE tells the name. If a lost partition is made again, its blocks are the
same, so it makes no difference which attempt's file is read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelfurrow.llm.common import by_value, parallel

BUCKET, FILE = 8 << 20, 0
NAMES = ["kind", "bucket", "block", "keys", "vals"]
PARCELS = "kind int, bucket int, block long, keys binary, vals binary"


def planes(x: np.ndarray) -> bytes:
    """The bytes of x's items, lowest of all first, compressed."""
    x = np.ascontiguousarray(x).ravel()
    return zstandard.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def unplaned(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unplaned(raw, np.uint64), dtype=np.uint64)


def buckets_of(docs: DataFrame) -> int:
    """How many buckets the texts of docs need."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(parallel(docs), -(-size // BUCKET))


def parcels(kind: int, block: int, keys: np.ndarray, vals: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of sorted keys; vals has a column for each key."""
    starts = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    at = np.concatenate([[0], np.searchsorted(keys, starts), [len(keys)]])
    some = np.flatnonzero(np.diff(at))
    cuts = [(int(at[b]), int(at[b + 1])) for b in some]
    n = len(cuts)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n, pa.int32()), pa.array(some, pa.int32()), pa.array([block] * n, pa.int64()), pa.array([packed_keys(keys[a:b]) for a, b in cuts], pa.binary()), pa.array([planes(vals[..., a:b]) for a, b in cuts], pa.binary())],
        NAMES,
    )


def file_row(block: int, name: str, vals: bytes = b"") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([FILE], pa.int32()), pa.array([-1 - (block & 0x3FFFFFFF)], pa.int32()), pa.array([block], pa.int64()), pa.array([name.encode()], pa.binary()), pa.array([vals], pa.binary())], NAMES)


def opened(rows: pa.Table, kind) -> tuple[np.ndarray, list[np.ndarray], list[tuple[int, int]], np.ndarray]:
    """Of a bucket's rows: all keys, the rows' values, where each row's keys are among all, and each key's row number."""
    keys = [unpacked_keys(x) for x in rows.column("keys").to_pylist()]
    sizes = np.array([len(k) for k in keys])
    ends = np.cumsum(sizes)
    vals = [unplaned(x, kind).reshape(-1, n) for x, n in zip(rows.column("vals").to_pylist(), sizes, strict=True)]
    return np.concatenate(keys), vals, [*zip((ends - sizes).tolist(), ends.tolist(), strict=True)], np.repeat(np.arange(len(sizes)), sizes)


def replies(rows: pa.Table, answers: list[bytes]) -> pa.Table:
    return pa.table([*(rows.column(c) for c in NAMES[:3]), pa.array([b""] * len(answers), pa.binary()), pa.array(answers, pa.binary())], NAMES)


def store_table(folder: str, table: pa.Table) -> str:
    """Writes a file and returns its name."""
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{root}/{name}") as out, pa.ipc.new_stream(out, table.schema) as to:
        to.write_table(table)
    return name


def load_table(folder: str, name: str) -> pa.Table:
    store, root = pafs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/{name}") as source:
        return pa.ipc.open_stream(source.read()).read_all()


def in_order(rows: pa.Table) -> pa.Table:
    """rows by block and kind."""
    return rows.sort_by([("block", "ascending"), ("kind", "ascending")])


def of_block(rows: pa.Table, kind: int, type_, columns: int) -> np.ndarray:
    """A block's answers of a kind, in the order of its keys."""
    own = [(b, v) for k, b, v in zip(*(rows.column(c).to_pylist() for c in ("kind", "bucket", "vals")), strict=True) if k == kind]
    return np.concatenate([np.zeros((columns, 0), type_), *(unplaned(v, type_).reshape(columns, -1) for _, v in sorted(own))], axis=1)


def file_of(rows: pa.Table) -> str:
    return next(bytes(k).decode() for kind, k in zip(rows.column("kind").to_pylist(), rows.column("keys").to_pylist(), strict=True) if kind == FILE)


by_value(__name__)
