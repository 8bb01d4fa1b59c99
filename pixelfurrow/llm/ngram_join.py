"""N-gram Jaccard join by count vectors.

A document is the set of its distinct word shingles, as 64-bit hashes. Two documents link when their Jaccard similarity is
at least num / den. Linked sets of a and b shingles differ in at most d = (den - num) * (a + b) // (den + num) of them.

1. Hash groups. In the scheme of a size band, hashes fall into d + 1 + e groups by their value. Sets that differ in at most
   d hashes have 1 + e equal groups at least. Where e allows it, groups of one hash are left out as well as empty ones: a
   passage that many documents share gives such groups. A set with over e of them keeps them, and one with over e empty
   groups keeps all. Two such sets have a kept group in common in each case. A group's exact content is a key; sets that
   share a key are candidates. Equal sets are one set, and keys of the same sets are one key.
2. Candidates of a key first meet its least set: their count vectors (hashes per group of DIMENSIONS) bound the overlap by
   the sum of coordinate minima, and survivors are verified on the sets. Verified links form components.
3. Where a key still has several components, its sets outside the largest one meet all its sets in R-trees over count
   vectors, in chunks of bounded size; boxes whose summed minima can't reach the overlap are dropped, on vectors folded to
   FOLDED coordinates first, and surviving pairs of different components are verified. So every link between different
   components of a key is found, and no key emits pairs inside a component. Sets carry their LEAST least keys of this kind,
   and a pair that has a smaller one in common is left to that key, which finds it too; so few keys repeat a pair.

Defined results: text without words, and null, gives an empty set, linked with nothing and its own component. Fewer words
than a shingle give the whole sequence as one shingle. Rows that repeat a doc_id are of one component if their sets link.
A null doc_id is greater than all others: a component has one only where all its rows do, and each row without words and id
is a component. Only doc_id and text are read. Sets are told apart by 64-bit sums of mixed hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelfurrow.llm.common import Numbers, blocks, by_value, discard, forget, fresh_path, releasing, written
from pixelfurrow.llm.components import components
from pixelfurrow.llm.exchange import FILE, PARCELS, buckets_of, file_row, load_table, opened, packed_keys, parcels, store_table, unpacked_keys

DIMENSIONS, FOLDED, CHUNK, NODE, SMALL, LEAST, BLOCK = 512, 64, 1024, 16, 500_000, 16, 8 << 20
ODDS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9]
ODD = np.array(ODDS, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; ASCII letters in lower case, words parted by ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(memo) > 200_000:
        memo.clear()
    for w in set(words):
        if w not in memo:
            memo[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, len(h) if len(h) < k else k, np.uint64)
    for j in range(min(k, len(h))):
        out += mixed(h[j : j + n] + np.uint64(ODDS[j % 8] * (1 + j // 8) % (1 << 64))) * ODD[(j + 1) % 8]
    return np.unique(mixed(out))


class Link:
    """When sets of a and b shingles link, and the schemes of size bands."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self._schemes, self._tops = {}, {}

    def differ(self, both: int) -> int:
        return (self.den - self.num) * both // (self.den + self.num)

    def linked(self, a, b, common):
        return self.den * common >= self.num * (a + b - common)

    def scheme(self, top: int) -> tuple[np.ndarray, int, int]:
        """The least hash of each group but the first, e, and the most hashes of a thin group, for sets of at most top."""
        if top not in self._schemes:
            d, part = self.differ(2 * top), self.num / self.den
            found = [self._spare(d, part**power * top, thin) for thin, power in ((1, 2), (1, 1))] if d >= 20 else []
            e, thin = next(((e, 1) for e in found if e <= 0.4 * (d + 1)), (self._spare(d, part * part * top, 0, 1), 0))
            self._schemes[top] = np.array([(g << 64) // (d + 1 + e) for g in range(1, d + 1 + e)], np.uint64), e, thin
        return self._schemes[top]

    @staticmethod
    def _spare(d: int, n: float, thin: int, turns: int = 30) -> int:
        """Groups to add so that sets of n hashes seldom have more thin ones; it may come out too large to be of use."""
        e = 0
        for _ in range(turns):
            mean = n / (d + 1 + e)
            share = (d + 1 + e) * np.exp(-mean) * (1 + thin * mean)
            e = int(np.ceil(share + 4 * np.sqrt(share)))
        return e

    def tops(self, n: int) -> tuple[int, int]:
        """The largest sizes of the schemes that a set of n shingles takes part in: of its own band and of the next."""
        if n not in self._tops:
            top = 1
            while top < n:
                top = -(-top * self.den // self.num)
            self._tops[n] = top, -(-top * self.den // self.num)
        return self._tops[n]

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        out = []
        if self.differ(2 * self.tops(len(hashes))[1]) == 0:
            return np.zeros(0, np.int64)  # only equal sets link
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes))])
        for top in self.tops(len(hashes)):
            cuts, e, thin = self.scheme(top)
            at = np.concatenate([[0], np.searchsorted(hashes, cuts), [len(hashes)]])
            sizes = np.diff(at)
            content = sums[at[1:]] - sums[at[:-1]]
            groups = np.arange(len(sizes))
            for most in range(thin, -1, -1):
                if np.count_nonzero(sizes <= most) <= e:
                    groups = np.flatnonzero(sizes > most)
                    break
            content = content[groups]
            out.append(mixed(content + groups.astype(np.uint64) * ODD[0] + np.uint64(top * ODDS[1] % (1 << 64))))
        return np.concatenate(out).view(np.int64)


def set_id(hashes: np.ndarray) -> int:
    return int(mixed(hashes * ODD[2]).sum(dtype=np.uint64).view(np.int64)) if len(hashes) else 0


def count_vector(hashes: np.ndarray) -> np.ndarray:
    return np.bincount((hashes & np.uint64(DIMENSIONS - 1)).astype(int), minlength=DIMENSIONS).astype(np.uint32)


def packed(counts: np.ndarray) -> bytes:
    """Low bytes of all counts, then the higher ones, compressed."""
    return zstandard.compress(counts.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()


KEYS = 1
SKETCH = "block long, part int, doc_id long, n long, sid long"
FOUND = "kind int, block long, part int, key long, name string"


def packed_set(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes, as differences: two sets of 20,000 agree in one by chance once in a million pairs."""
    return packed_keys(hashes >> np.uint64(16))


def common(a: bytes, b: bytes) -> int:
    """How many hashes two packed sets share."""
    return len(np.intersect1d(unpacked_keys(a), unpacked_keys(b)))


def sketch_rows(folder: str, k: int, link: Link, buckets: int):
    """Writes a file of each block's documents: part (the set's number in the block), doc_id, n, sid; sends the keys of its
    distinct sets with their numbers. A bucket tells keys apart by about 40 bits."""
    lost = np.uint64(max(0, 24 - max(1, buckets).bit_length()))

    def rows(batches):
        forget()
        memo, block, size, held = {}, TaskContext.get().partitionId() << 32, 0, []

        def flush():
            parts, ids, n, keys, own = Numbers(), [], [], [], []
            for _, text in held:
                h = shingles(text, k, memo)
                n.append(len(h))
                ids.append(set_id(h))
                known = len(parts)
                number = parts[ids[-1]]
                if number == known and len(h):
                    keys.append(link.keys(h).view(np.uint64) >> lost << lost)
                    own.append(np.full(len(keys[-1]), number, np.uint32))
            name = store_table(folder, pa.table({"block": pa.array([block] * len(held), pa.int64()), "part": pa.array([parts[x] for x in ids], pa.int32()), "doc_id": pa.array([d for d, _ in held], pa.int64()), "n": pa.array(n, pa.int64()), "sid": pa.array(ids, pa.int64())}))
            held.clear()
            yield file_row(block, name)
            if keys:
                keys, own = np.concatenate(keys), np.concatenate(own)
                order = np.lexsort((own, keys))
                yield parcels(KEYS, block, keys[order], own[order], buckets)

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


def shared_keys(rows: pa.Table) -> pa.Table:
    """FOUND: of a bucket's keys, those that more than one set of a block has, with the sets."""
    if rows.column("kind")[0].as_py() == FILE:
        n, names = rows.num_rows, [bytes(x).decode() for x in rows.column("keys").to_pylist()]
        return pa.table([rows.column("kind"), rows.column("block"), pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int64()), pa.array(names, pa.string())], ["kind", "block", "part", "key", "name"])
    keys, vals, _, row = opened(rows, np.uint32)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(k) else order
    blocks = rows.column("block").to_numpy()[row[order]]
    n = len(order)
    return pa.table([pa.array(np.full(n, KEYS, np.int32)), pa.array(blocks), pa.array(np.concatenate([v[0] for v in vals])[order].astype(np.int32)), pa.array(keys[order].view(np.int64)), pa.nulls(n, pa.string())], ["kind", "block", "part", "key", "name"])


def loaded(folder: str):
    """The rows of the files of that name."""

    def rows(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield from load_table(folder, name).to_batches()

    return rows


def set_rows(k: int):
    def rows(batches):
        memo = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts, 1 << 20):
                sets = [shingles(t, k, memo) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array([packed(count_vector(h)) for h in sets], pa.binary()), pa.array([packed_set(h) for h in sets], pa.binary())], ["sid", "n", "counts", "hashes"])

    return rows


def verify_rows(link: Link):
    """Of rows u, v, counts and hashes of both: those that link, by summed minima first, then on the sets."""

    def rows(batches):
        for batch in batches:
            out = [[], []]
            for first in range(0, batch.num_rows, 64):
                for u, v, packed_u, set_u, packed_v, set_v in zip(*(c.slice(first, 64).to_pylist() for c in batch.columns), strict=True):
                    cu, cv = unpacked(packed_u), unpacked(packed_v)
                    a, b = int(cu.sum()), int(cv.sum())
                    if link.linked(a, b, int(np.minimum(cu, cv).sum())) and link.linked(a, b, common(set_u, set_v)):
                        out[0].append(u)
                        out[1].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["u", "v"])

    return rows


def verified(pairs: DataFrame, sets: DataFrame, link: Link) -> DataFrame:
    def side(x):  # only the sets that stand on that side are sent
        wanted = pairs.select(F.col(x).alias("sid")).distinct()
        return sets.join(wanted, "sid", "left_semi").select(F.col("sid").alias(x), F.col("counts").alias(f"c{x}"), F.col("hashes").alias(f"h{x}"))

    rows = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "cu", "hu", "cv", "hv")
    return rows.mapInArrow(releasing(verify_rows(link)), "u long, v long")


class RTree:
    """Boxes of count vectors, packed by size, NODE children each."""

    def __init__(self, counts: np.ndarray):
        self.order = np.argsort(counts.sum(1), kind="stable")
        counts = counts[self.order]
        folded = counts.reshape(len(counts), FOLDED, -1).sum(2, dtype=np.uint32)
        self.levels = [(counts, counts.sum(1), folded)]  # coordinate maxima, least size and folded maxima of each box
        while len(self.levels[-1][0]) > NODE:
            high, least, folded = self.levels[-1]
            cuts = np.arange(0, len(high), NODE)
            self.levels.append((np.maximum.reduceat(high, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(folded, cuts)))

    def pairs(self, other: RTree, link: Link) -> tuple[np.ndarray, np.ndarray]:
        """Indices of points whose summed minima allow a link."""
        depth = max(len(self.levels), len(other.levels)) - 1
        mine, its = (x.levels[min(depth, len(x.levels) - 1)] for x in (self, other))
        i, j = np.divmod(np.arange(len(mine[0]) * len(its[0])), max(1, len(its[0])))
        for level in range(depth, -1, -1):
            mine, its = (x.levels[min(level, len(x.levels) - 1)] for x in (self, other))
            if level < depth:
                i, j = self._down(i, j, len(mine[0]) if level < len(self.levels) - 1 else 0, len(its[0]) if level < len(other.levels) - 1 else 0)
            keep = np.zeros(len(i), bool)
            for a in range(0, len(i), 8192):
                s = slice(a, a + 8192)
                sizes = mine[1][i[s]].astype(np.int64), its[1][j[s]].astype(np.int64)
                ok = np.flatnonzero(link.linked(*sizes, np.minimum(mine[2][i[s]], its[2][j[s]]).sum(1, dtype=np.int64)))
                common = np.minimum(mine[0][i[s][ok]], its[0][j[s][ok]]).sum(1, dtype=np.int64)
                keep[a + ok] = link.linked(sizes[0][ok], sizes[1][ok], common)
            i, j = i[keep], j[keep]
        return self.order[i], other.order[j]

    @staticmethod
    def _down(i, j, n, m):
        """The pairs of children; n or m is 0 where that side has no finer level here."""
        step = np.arange(NODE)
        if n:
            i, j = (i[:, None] * NODE + step).ravel(), np.repeat(j, NODE)
            i, j = i[i < n], j[i < n]
        if m:
            i, j = np.repeat(i, NODE), (j[:, None] * NODE + step).ravel()
            i, j = i[j < m], j[j < m]
        return i, j


def tree_pairs(link: Link):
    """Of rows sorted by key, p and q: pairs of different components, of a chunk outside the key's largest component and a
    chunk of all its sets, that may link. A chunk pair may end in a later batch."""

    def group(rows: list[tuple]):
        key, _, _, sid, root, whole, counts, least = zip(*rows, strict=True)
        sid, root, whole = np.array(sid), np.array(root), np.array(whole)
        left, right = np.flatnonzero(~whole), np.flatnonzero(whole)
        if not len(left) or not len(right):
            return left, right
        counts = np.array([unpacked(c) for c in counts])
        i, j = RTree(counts[left]).pairs(RTree(counts[right]), link)
        a, b = left[i], right[j]
        a, b = (x[root[a] != root[b]] for x in (a, b))
        least = [frozenset(x) for x in least]
        here = [min(least[x] & least[y], default=key[0]) >= key[0] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        a, b = (sid[x[np.array(here, bool)]] for x in (a, b))
        return np.minimum(a, b), np.maximum(a, b)

    def pairs(batches):
        rest = []
        for batch in batches:
            found = [[], []]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rest and rest[-1][:3] != row[:3]:
                    for out, x in zip(found, group(rest), strict=True):
                        out.extend(x.tolist())
                    rest = []
                rest.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["u", "v"])
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in group(rest)], ["u", "v"])

    return pairs


def grouped(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of the component), set_id and root (a set of the component) of each row."""
    spark, link = docs.sparkSession, Link(num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder, buckets = fresh_path(spark, "sketch"), buckets_of(docs)
    sent = docs.mapInArrow(releasing(sketch_rows(folder, k, link, buckets)), PARCELS)
    found = written(sent.groupBy("kind", "bucket").applyInArrow(releasing(shared_keys), FOUND), "keys")
    sketch = found.where(F.col("kind") == FILE).select("name").mapInArrow(releasing(loaded(folder)), SKETCH)
    sketch = written(sketch, "sketch")
    parts = sketch.where("n > 0").select("block", "part", "sid").distinct()
    keyed = found.where(F.col("kind") == KEYS).join(parts, ["block", "part"]).select("sid", "key")
    keyed = keyed.where("key is not null and sid is not null")  # as joins ask, so that one exchange serves both uses
    keyed = keyed.repartition("key").groupBy("key", "sid").agg(F.lit(1).alias("x"))
    prints = [F.bit_xor(F.xxhash64("sid", F.lit(x))).alias(f"x{x}") for x in (0, 1)]
    keys = keyed.groupBy("key").agg(F.min("sid").alias("u"), F.count("*").alias("c"), *prints).where("c > 1")
    keys = keys.groupBy("c", "x0", "x1").agg(F.min("key").alias("key"), F.min("u").alias("u")).select("key", "u")
    members = keyed.join(keys, "key").select("key", "sid", "u")  # keys of the same sets are one key
    members = written(members, "members")
    discard(found)
    some = members.select("sid").distinct()
    reps = sketch.where("n > 0").select("sid", "doc_id").join(some, "sid").groupBy("sid").agg(F.min("doc_id").alias("doc_id")).select("doc_id").where("doc_id is not null").distinct()
    reps = written(reps, "reps")
    chosen = docs.join(F.broadcast(reps) if reps.count() <= SMALL else reps, "doc_id")
    chosen = chosen.select("doc_id", "text").union(docs.where("doc_id is null").select("doc_id", "text"))  # sets that no row with an id has
    sets = written(chosen.mapInArrow(releasing(set_rows(k)), "sid long, n long, counts binary, hashes binary").dropDuplicates(["sid"]), "sets")
    stars = written(members.where(F.col("sid") != F.col("u")).select("u", F.col("sid").alias("v")).distinct(), "stars")
    links = written(verified(stars, sets, link), "links")
    discard(stars)
    roots = components(links)
    named = members.select("key", "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", F.coalesce("root", "sid").alias("root"))
    per = named.groupBy("key", "root").agg(F.count("*").alias("n"))
    per = per.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("c")).where("c > 1")
    split = per.selectExpr("key", "main.root as main", "cast(ceil(all / {0}) as int) as q".format(CHUNK), "cast(ceil((all - main.n) / {0}) as int) as p".format(CHUNK))
    split = named.join(split, "key").withColumn("h", F.xxhash64("sid"))
    every = split.select("key", "sid", "root", F.lit(True).alias("whole"), F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("p"), F.expr("cast(pmod(h, q) as int)").alias("q"))
    minor = split.where("root != main").select("key", "sid", "root", F.lit(False).alias("whole"), F.expr("cast(pmod(h, p) as int)").alias("p"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("q"))
    least = split.groupBy("sid").agg(F.slice(F.sort_array(F.collect_list("key")), 1, LEAST).alias("least"))  # a set has no more keys than shingles
    met = every.union(minor).join(sets.select("sid", "counts").join(least, "sid"), "sid")
    met = met.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").select("key", "p", "q", "sid", "root", "whole", "counts", "least")
    pairs = written(met.mapInArrow(releasing(tree_pairs(link)), "u long, v long").distinct(), "pairs")
    more = written(verified(pairs, sets, link).union(links), "links")
    final = components(more)
    discard(links, members, sets, reps, pairs)
    ids = sketch.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    ids = ids.join(final.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "doc_id", F.coalesce("root", "sid").alias("root"))
    least = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = ids.join(least, "root").select("sid", "root", "component_id")
    whole = sketch.where("n > 0").select("doc_id", "n", "sid").join(ids, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("sid").alias("set_id"), "root")
    return whole.union(sketch.where("n = 0").select("doc_id", "n", F.col("doc_id"), "sid", "sid"))


def op6(spark, sf_dir: str) -> DataFrame:
    return grouped(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85, 100).select("doc_id", "n_shingles", "component_id")


def with_set(k: int, names: list[str]):
    def rows(batches):
        memo = {}
        for batch in batches:
            ids = [set_id(shingles(t, k, memo)) for t in batch.column(names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], [*names, "_set"])

    return rows


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep each component's row of the least doc_id, null last: five-word shingles, similarity 0.8."""
    k, names = 5, docs.columns
    groups = written(grouped(docs, k, 80, 100), "groups")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_id")).alias("x")
    first = groups.where("n_shingles > 0").groupBy("root").agg(least).select("x.doc_id", "x.set_id")
    kept = written(first.union(groups.where("n_shingles = 0").select("doc_id", "set_id")).distinct(), "kept")
    often = written(groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "often")
    n = often.count()
    often = F.broadcast(often) if n <= SMALL else often
    plain = docs.join(kept.select("doc_id"), "doc_id", "left_semi")
    unclear = docs.where("doc_id is null")  # rows that an id doesn't tell apart
    if n:
        plain, unclear = plain.join(often, "doc_id", "left_anti"), unclear.union(docs.join(often, "doc_id", "left_semi").select(*names))
    unclear = unclear.mapInArrow(releasing(with_set(k, names)), T.StructType([*docs.schema.fields, T.StructField("_set", T.LongType())]))
    alone = F.col("doc_id").isNull() & (F.col("_set") == 0)
    keys = kept.select(F.col("doc_id").alias("_doc"), F.col("set_id").alias("_kept"))
    found = unclear.where(~alone).join(keys, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_set") == F.col("_kept")), "left_semi")
    one = found.groupBy("doc_id", "_set").agg(F.min_by(F.struct(*names), F.coalesce("text", F.lit(""))).alias("x")).select("x.*")
    return plain.select(*names).union(one).union(unclear.where(alone).select(*names))


by_value(__name__)
