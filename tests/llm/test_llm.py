"""Each corpus operator on small fixtures, against brute force, round trips or held-out accuracy."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pyspark
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pixelfurrow.llm import byte_bpe, common, components, decontaminate, langid, lm_score, ngram_join, quality, suffix_dedup, topk, toxicity, wavelet
from pixelfurrow.llm.common import fold, releasing, training_labels

ODD = [(None, "abc " * 40), (1, None), (2, ""), (3, " a  b\n c "), (4, "don't  STOP\n\nnow\x1f \x1cx yÉé é áb 'S"), (5, "it  is  ok  "), (6, "日本語 テキスト"), (7, "x" * 3000), (8, "x" * 3000)]
SCHEMA = "doc_id long, text string"


def frame(spark, rows):
    """With columns whose names clash with those used inside."""
    return spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 as n", "'q' as key", "doc_id as doc", "0 as score").repartition(3)


def prose(r, n, words):
    return " ".join(r.choice(words) for _ in range(n))


def test_topk(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 340)] + [(7, [9.0] * 8), (20, [-9.0] * 8), (500, None), (501, [float("nan")] * 8), (502, [1.0, None] * 4), (503, []), (None, [1.0] * 8), (520, [1.0, 2.0])]
    out = sorted(tuple(x) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    m = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows[:342]]
    expected = []
    for q in range(0, 340, 20):
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for j, v in m if j == q for i, w in m if i != q)[:20]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert out == sorted(expected)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_topk_search_prunes():
    r = np.random.default_rng(0)
    centres = np.cumsum(r.normal(size=(40, 64)), axis=1) * 20  # neighbouring components are alike, as segments suppose
    rows = np.floor(centres[r.integers(0, 40, 8000)] + r.normal(size=(8000, 64)) * 4)
    q, s, ids, share = topk.search(rows[:50], np.arange(50), rows, np.arange(8000), 10)
    full = rows[:50] @ rows.T
    for k in range(50):
        best = sorted((-full[k, i], i) for i in range(8000) if i != k)[:10]
        assert [(-s[j], ids[j]) for j in np.flatnonzero(q == k)] == best
    assert share < 0.9


def test_topk_search_prunes_unrelated_components():
    r = np.random.default_rng(1)
    rows, ids = np.floor(r.normal(size=(6000, 64)) * 64), np.arange(6000)
    seeds = topk.Seeds(pa.table({"vec_id": ids[:2000], "embedding": list(rows[:2000] / 64), "d": np.full(2000, 64)}))
    x, x_ids, basis = seeds.of[64]
    assert (x == rows[:2000]).all()
    bar = topk.starting_bars(rows[:50], ids[:50], x, x_ids, 20)
    q, s, found, share = topk.search(rows[:50], ids[:50], rows, ids, 20, basis, bar)
    full = rows[:50] @ rows.T
    for k in range(50):
        best = sorted((-full[k, i], i) for i in range(6000) if i != k)[:20]
        assert [(-s[j], found[j]) for j in np.flatnonzero(q == k)] == best
    assert share < 0.2


def test_topk_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 50)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "SEEDS", 60)
    r = np.random.default_rng(4)
    x = np.floor(r.normal(size=(400, 6)) * 3)  # many ties
    out = sorted(tuple(v) for v in topk.top_k(spark.createDataFrame([(i, [float(c) / 64 for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect())
    expected = []
    for q in range(0, 400, 20):
        best = sorted((-int(x[q] @ x[i]), i) for i in range(400) if i != q)[:20]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert out == sorted(expected)


def test_toxicity_segments_match_brute_force():
    r = random.Random(2)
    for _ in range(200):
        places = sorted(r.sample(range(30), r.randrange(0, 9)))
        scores = [r.choice([0.5, 1.0, 2.0]) for _ in places]
        full = [-0.25] * 30
        for p, s in zip(places, scores, strict=True):
            full[p] = s
        found = toxicity.segments(scores, places, 0.25)
        best = max((sum(full[a : b + 1]) for a in range(30) for b in range(a, 30)), default=0)
        assert (max(s for s, _, _ in found) == pytest.approx(best)) if places else not found
        for s, a, b in found:
            assert s == pytest.approx(sum(full[a : b + 1]))


def labelled(r, n):
    plain, bad = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(6)) for _ in range(200)], ["vilewort", "grimslag"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = prose(r, 40, plain) + (" " + prose(r, 5, bad) + " " + prose(r, 5, plain) if toxic else "")
        good = i % 3 != 0
        docs.append((i, text if good else " ".join(w + "$$$" for w in text.split())))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def test_toxicity_and_quality_hold_out(spark):
    docs, labels = labelled(random.Random(1), 400)
    labels = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    d = frame(spark, docs + [(1000, None), (1001, "")])
    for module, name, scored in ((toxicity, "toxic", lambda m: toxicity.passages(d, m)), (quality, "quality", lambda m: quality.scored(d, m))):
        out = scored(module.learn(d, training_labels(labels, name, 5, 0, 10_000))).select("doc_id", "score", (fold("doc_id", 5) == 0).alias("held")).toPandas()
        assert len(out) == 402 and out.score.between(0, 1).all()
        truth = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(name).alias("y")).toPandas()
        held = out[out.held].merge(truth, on="doc_id")
        assert ((held.score >= 0.5) == held.y).mean() > 0.95
        empty = module.learn(d.limit(0), training_labels(labels, name, 5, 0, 10_000))
        assert scored(empty).count() == 402


def test_language_id(spark):
    r, words = random.Random(1), {"aa": ["thab", "the", "ing", "and"], "bb": ["über", "schön", "und", "ßen"], "cc": ["être", "où", "ça", "les"]}
    rows = [(i, prose(r, r.randrange(3, 30), words[lang]), lang) for i, lang in ((i, r.choice([*words])) for i in range(300))]
    docs = spark.createDataFrame([*rows, (300, None, "aa"), (301, "12 34 !", "aa"), (302, "", None)], SCHEMA + ", lang string")
    out = {x.doc_id: x for x in langid.identify(docs, langid.learn(docs.where(fold("doc_id", 4) != 2))).collect()}
    assert [out[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert sum(out[i].lang_pred == lang for i, _, lang in held) > 0.97 * len(held)
    kept = {x.doc_id for x in langid.stage(spark, docs, "").collect()}
    assert kept == {i for i, _, _ in rows}
    assert {x.lang_pred for x in langid.identify(docs, langid.learn(docs.limit(0))).collect()} == {"und"}


def test_language_code_lengths_match_plain_trees():
    texts = {"aa": "abracadabra abra", "bb": "bananas and ananas"}
    counts = {k: np.unique(langid._grams(langid._joined([t])[0])[langid.ORDER - 3 :], return_counts=True) for k, t in texts.items()}
    trees = langid.Trees({k: (g.astype(np.int64), n) for k, (g, n) in counts.items()})

    def plain(text, data):
        seen = collections.Counter()
        padded = langid.PAD + text.encode()
        for i in range(3, len(padded)):
            for k in range(4):
                seen[padded[i - k : i], padded[i]] += 1
        total, bits = 0.0, langid.PAD + data.encode()
        for i in range(3, len(bits)):
            for k in range(3, -1, -1):
                own = {s: n for (c, s), n in seen.items() if c == bits[i - k : i] and len(c) == k}
                if own:
                    n, q = sum(own.values()), len(own)
                    if bits[i] in own:
                        total -= np.log2(own[bits[i]] / (n + q))
                        break
                    total -= np.log2(q / (n + q))
            else:
                total += 8
        return total

    got = trees.code_lengths(["banana", "zebra", ""])
    for i, data in enumerate(["banana", "zebra", ""]):
        for k, t in enumerate(texts.values()):
            assert got[i, k] == pytest.approx(plain(t, data), abs=1e-3)


def jaccard_brute(rows, k, num, den):
    sets, parent = {}, {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        parent[d] = d

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_ngram_join(spark, k, num):
    r = random.Random(k)
    words = [f"w{i}" for i in range(60)]
    rows = [x for x in ODD if x[0] is not None]
    for g in range(12):
        base = [r.choice(words) for _ in range(r.randrange(3, 120))]
        for _ in range(r.randrange(1, 9)):
            own = list(base)
            for _ in range(r.randrange(0, 4)):
                own[r.randrange(len(own))] = r.choice(words)
            rows.append((len(rows) + 100, " ".join(own)))
    out = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.grouped(frame(spark, rows), k, num, 100).collect()}
    assert out == jaccard_brute(rows, k, num, 100)
    assert ngram_join.grouped(frame(spark, rows[:1]).limit(0), k, num, 100).count() == 0


def test_rtree_bounds_lose_no_pair():
    r, link = np.random.default_rng(1), ngram_join.Link(85, 100)
    base = r.integers(0, 4, (30, 512))
    counts = np.concatenate([np.maximum(base + r.integers(-1, 2, base.shape) * (r.random(base.shape) < 0.1), 0) for _ in range(12)]).astype(np.uint32)
    i, j = ngram_join.RTree(counts).pairs(ngram_join.RTree(counts[:70]), link)
    n, common = counts.sum(1), np.minimum(counts[:, None], counts[None, :70]).sum(2)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in range(len(counts)) for b in range(70) if link.linked(int(n[a]), int(n[b]), int(common[a, b]))}


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(9, 9), (None, 3)]
    parent = list(range(400))
    for a, b in edges:
        if a is not None:
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    out = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {x: root(x) for x in range(400) if root(x) != x}


def dedup_brute(rows, width=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda x: -(1 << 63) if x[0] is None else x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if b[s : s + width] in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(b[s : s + width])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark):
    r = random.Random(1)
    base = "".join(r.choice("abcdefg h") for _ in range(3000))
    rows = [*ODD, (20, "ab" * 200 + "é" * 200), (19, "é" * 300 + "x" + "ab" * 100), (18, "a" * 99), (17, "a" * 100), (16, "a" * 500)]
    for i in range(30, 80):
        a, b = r.randrange(2000), r.randrange(2000)
        rows.append((i, base[a : a + r.randrange(90, 400)] + "".join(r.choice("xyz ") for _ in range(r.randrange(150))) + base[b : b + r.randrange(90, 300)]))
    out = {x[0]: tuple(x)[1:] for x in suffix_dedup.deduplicated(frame(spark, rows)).collect()}
    assert out == dedup_brute(rows)
    staged = suffix_dedup.stage(spark, frame(spark, rows), "")
    assert staged.columns == frame(spark, rows).columns and staged.count() == len(rows)


def test_suffix_dedup_at_limits(spark, monkeypatch):
    """Blocks, pieces and parts far smaller than the texts, and far larger than usual ones."""
    r = random.Random(12)
    base = "".join(r.choice("abcdefg h") for _ in range(2500))
    rows = [(i, base[a : a + r.randrange(90, 900)] + "é" + base[b : b + r.randrange(90, 900)]) for i in range(40) for a, b in [(r.randrange(1500), r.randrange(1500))]]
    rows += [(100, base * 5), (101, None), (102, "q" * 2000)]
    for limits in ({"BLOCK": 700, "PIECE": 130, "PART": 250, "WINDOWS_AT_ONCE": 60}, {"BLOCK": 10_000, "PIECE": 1000, "PART": 3000}):
        for name, value in limits.items():
            monkeypatch.setattr(suffix_dedup, name, value)
        out = {x[0]: tuple(x)[1:] for x in suffix_dedup.deduplicated(frame(spark, rows)).collect()}
        assert out == dedup_brute(rows)


def test_suffix_dedup_on_real_rows(spark):
    data = "/root/testdata/sf0.01"
    rows = [tuple(x) for x in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    out = {x[0]: tuple(x)[1:] for x in suffix_dedup.op7(spark, data).collect()}
    assert out == dedup_brute(rows)
    odd = spark.createDataFrame([(1, "x" * 300, 7, "a"), (None, None, None, None), (2, "", 0, "b")], "doc_id long, text string, n_chars int, `_spans` string").withColumn("none0", F.lit(1)).withColumn("a.b`", F.lit(2))
    staged = suffix_dedup.stage(spark, odd, "")
    assert staged.schema == odd.schema
    assert sorted([tuple(x) for x in staged.collect()], key=str) == sorted([(1, "x", 1, "a", 1, 2), (None, None, None, None, 1, 2), (2, "", 0, "b", 1, 2)], key=str)
    assert suffix_dedup.stage(spark, odd.limit(0), "").count() == suffix_dedup.deduplicated(odd.limit(0)).count() == 0


def test_wavelet_matrix():
    ids = np.random.default_rng(0).integers(0, 300, 5000)
    m, _ = wavelet.from_bytes(wavelet.to_bytes(wavelet.WaveletMatrix.of(ids), {}))
    assert (m.ids() == ids).all()
    for i in range(0, 5000, 97):
        assert m.access(i) == ids[i]
    for x in range(0, 300, 23):
        at = np.flatnonzero(ids == x)
        assert m.rank(x, 4321) == (at < 4321).sum() and [m.select(x, k) for k in range(len(at))] == at.tolist() and m.select(x, len(at)) == -1
    assert m.rank(1 << 20, 9) == 0


def test_wavelet_file_is_read_in_pieces(tmp_path):
    ids = np.random.default_rng(1).integers(0, 5000, 1_300_000)
    raw = wavelet.to_bytes(wavelet.WaveletMatrix.of(ids), {"doc_id": [1], "n_tokens": [len(ids)]})
    (tmp_path / "a").write_bytes(raw)
    read = 0
    matrix, _ = wavelet.open_shard(f"file://{tmp_path}", "a")
    for i in (0, 511, 512, (1 << 19) - 1, 1 << 19, 1_299_999):
        assert matrix.access(i) == ids[i]
    at = np.flatnonzero(ids == ids[777_777])
    assert matrix.rank(int(ids[777_777]), 900_000) == (at < 900_000).sum() and matrix.select(int(ids[777_777]), 3) == at[3]
    assert (matrix.ids() == ids).all()

    def counted(a, n):
        nonlocal read
        read += n
        return raw[a : a + n]

    assert wavelet.opened(counted)[0].access(5) == ids[5] and read < len(raw) / 2


def test_wavelet_shards(spark):
    library = Tokenizer.from_file(wavelet.VOCABULARY)
    rows = [x for x in ODD if x[0] is not None] + [(20, "ΑΣ İx ¿q? 12 a1b x!?.."), (21, "Plain words, here.")]
    expected, start = [], 0
    for i, t in sorted(rows):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    folder, index = wavelet.write(frame(spark, rows), shard=10)
    assert sorted(tuple(x) for x in wavelet.read(folder, index).collect()) == expected


def test_byte_bpe(spark):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(byte_bpe.VOCABULARY), special_tokens={})
    out = byte_bpe.encoded(frame(spark, ODD))
    digest = lambda b: hashlib.sha256(b).hexdigest()
    expected = sorted((-1 if i is None else i, digest(",".join(map(str, own.encode_ordinary(t or ""))).encode()), digest((t or "").encode())) for i, t in ODD)
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.ids_sha256, x.decoded_sha256) for x in out.collect()) == expected
    assert {x.doc_id: x.text for x in byte_bpe.decoded(out).collect()} == {i: t or "" for i, t in ODD}


def least_edits(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignment_matches_brute_force():
    r = np.random.default_rng(0)
    for _ in range(60):
        a, b = r.integers(0, 4, 12), r.integers(0, 4, 30)
        edits, first, last = decontaminate.alignment(a, b, 12)
        assert edits == least_edits(a.tolist(), b.tolist()) == least_edits(a.tolist(), b[first:last].tolist())


def test_decontamination(spark):
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefghij klmnop") for _ in range(n))
    items = [(i, text(120)) for i in range(20)]
    docs, planted = [(1000, None), (1001, ""), (1002, "short")], set()
    for d in range(60):
        body = text(600)
        if d % 3 == 0:
            item = list(items[d % 20][1])
            for _ in range(d % 11):
                p = r.randrange(len(item))
                item[p : p + 1] = r.choice(["", "zz", "q"])
            body = body[:300] + " " + "".join(item).upper() + " " + body[300:]
            if least_edits(decontaminate.normal(items[d % 20][1]), decontaminate.normal(body)) <= int(len(decontaminate.normal(items[d % 20][1])) * 0.1):
                planted.add((d, d % 20))
        docs.append((d, body))
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    out = {(x.doc_id, x.item_id) for x in decontaminate.leaks(frame(spark, docs), bench).collect()}
    assert out == planted
    assert decontaminate.leaks(frame(spark, docs), bench.limit(0)).count() == 0


def test_lm_score_matches_plain_models(spark):
    r = random.Random(7)
    docs = [(i, prose(r, r.randrange(1, 20), ["a", "b", "c", "dd", "ee"] if i % 2 else ["a", "x", "y"])) for i in range(40)] + [(50, None), (51, "")]
    target = {i for i, _ in docs if i % 2}
    out = {x.doc_id: x for x in lm_score.scored(frame(spark, docs), spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()}
    grams = {i: [(a, b) for a, b in zip([b"", *w], w, strict=False)] for i, t in docs for w in [toxicity.words(t)]}
    base = collections.Counter(b for g in grams.values() for _, b in g)
    total = sum(base.values())
    for i, g in grams.items():
        def p(h, w, use, i=i):
            c = collections.Counter(x for j, y in grams.items() if use(j) and lm_score._half(j) != lm_score._half(i) for x in y)
            uni, of_h = collections.Counter(), {x: n for x, n in c.items() if x[0] == h}
            for x, n in c.items():
                uni[x[1]] += n
            one = (uni[w] + lm_score.ADD * base[w] / total) / (sum(c.values()) + lm_score.ADD)
            return (c[h, w] + lm_score.MU * one) / (sum(of_h.values()) + lm_score.MU)

        if g:
            expected = np.mean([np.log2(p(h, w, lambda j: True)) - np.log2(p(h, w, target.__contains__)) for h, w in g])
            assert out[i].score == pytest.approx(expected, abs=1e-4) and out[i].n_tokens == len(g)
        else:
            assert out[i].score is None and out[i].n_tokens == 0


def test_pipeline(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, data)
        assert new.columns == docs.columns, name
        new.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert 0 < docs.count() <= 200
    out = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert out.count() == docs.count()


def test_topk_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    out = sorted(tuple(x) for x in topk.op1(spark, data).select("query_id", "rank", "vec_id", "score").collect())
    assert out == sorted(con.sql(topk.ORACLE).fetchall())


def test_toxicity_drops_only_verified_copies(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    passage, base = prose(r, 25, words), prose(r, 60, words)
    rows = [(i, f"{prose(r, 30, words)} {passage} {prose(r, 30, words)}", i % 2) for i in range(40)]  # a shared passage is no copy
    rows += [(50, base, 0), (51, base + " end", 0), (52, base, 0), (53, base, 1), (54, "", 0), (55, "", 0)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int").withColumn("row", F.xxhash64("doc_id", "text"))
    expected = [(t, y) for i, t, y in rows if i not in (51, 52, 55)]
    assert sorted((x.text, x.label) for x in toxicity.once(sample).collect()) == sorted(expected)


def test_suffix_dedup_keeps_one_of_repeated_rows(spark):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared, t = text(150), text(400)
    rows = [(5, t), (5, t), (6, text(200) + t[100:300]), (7, shared + text(50))]
    rows += [(8, shared), *((i, t) for i in (9, 9)), (10, text(99))]
    empty = [(None, text(180)), (None, text(120) + shared), (None, "z" + text(130)), (None, None)]
    rows += empty + empty[:1]
    digest = lambda b: hashlib.sha256(b).hexdigest()
    distinct = list({(i, x): None for i, x in rows if i is not None})
    brute = dedup_brute([(-1, empty[1][1]), *distinct])
    expected = [(i, *brute[i]) for i, _ in rows if i is not None] + [(None, len(x or ""), 0, 0, digest((x or "").encode())) for i, x in rows if i is None]
    for parts in (1, 3):
        out = [tuple(x) for x in suffix_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()]
        assert sorted(out, key=str) == sorted(expected, key=str)


def test_wavelet_ids_of_added_tokens(spark):
    library, own = Tokenizer.from_file(wavelet.VOCABULARY), wavelet.Encoder(wavelet.VOCABULARY)
    texts = ["a <|endoftext|> b", "x<|startoftext|>y\n<|endoftext|><|endoftext|>", "<|EndOfText|> <| endoftext|> <|endoftext", "Word's <|startoftext|> é  12?"]
    for t in texts:
        assert np.frombuffer(own.ids(t), np.uint32).tolist() == library.encode(t, add_special_tokens=False).ids
    assert {49406, 49407} <= {x for t in texts for x in np.frombuffer(own.ids(t), np.uint32).tolist()}


def test_decontamination_of_repeated_text_and_rows_without_id(spark, tmp_path):
    item = ("abcdefg hi" * 200)[:2000]
    bench = spark.createDataFrame([(1, item), (2, "the quick brown fox jumps over the lazy dog again and again")], "item_id long, text string")
    rows = [(1, item * 10), (None, "so the quick brown fox jumps over a lazy dog again and again"), (None, "clean"), (3, "abcdefg hi" * 150), (4, None)]
    out = {(x.doc_id, x.item_id, x.edits) for x in decontaminate.leaks(frame(spark, rows), bench).collect()}
    assert out == {(1, 1, 0), (None, 2, 3)}
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = decontaminate.stage(spark, frame(spark, rows), str(tmp_path))
    assert kept.columns == frame(spark, rows).columns
    assert sorted([(x.doc_id, x.text) for x in kept.collect()], key=str) == sorted([(None, "clean"), (3, "abcdefg hi" * 150), (4, None)], key=str)


def test_decontamination_of_short_items(spark):
    item = "abcdefghijklmnopqrst"  # 20 characters; 2 edits leave no 8 of them untouched
    edited = item[:7] + "#" + item[8:14] + "#" + item[15:]
    r = random.Random(6)
    items = [(0, item), *((m, "".join(r.choice("abcdefghijklmnopqrstuvw") for _ in range(m))) for m in range(8, 45))]
    docs, planted = [(1, "1234567890 " + edited + " 0987654321")], {(1, 0)}
    for m, text in items[1:]:
        k = int(m * 0.1)
        for p in range(1, k + 1):
            at = p * m // (k + 1)
            text = text[:at] + "#" + text[at + 1 :]
        docs.append((100 + m, "123 " + text + " 456"))
        planted.add((100 + m, m))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {(x.doc_id, x.item_id) for x in decontaminate.leaks(spark.createDataFrame(docs, SCHEMA), bench).collect()}
    assert planted <= out
    assert {(d, i) for d, i in out if least_edits(dict(items)[i], dict(docs)[d]) > int(len(dict(items)[i]) * 0.1) and d - 100 != i} <= planted


def test_near_duplicates_keep_one_row_of_each_component(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    a, b, c, d = (prose(r, 60, words) for _ in range(4))
    near = lambda t: t + " end"
    rows = [(None, a), (None, a), (None, near(a)), (None, b), (3, near(b)), (5, c), (5, c), (6, near(c)), (None, ""), (None, None), (2, ""), (2, ""), (7, d)]
    out = [(x.doc_id, x.text) for x in ngram_join.stage(spark, frame(spark, rows), "").collect()]
    left = [x for x in out if x[0] is None and x[1] and x[1].startswith(a)]
    assert len(left) == 1
    out.remove(left[0])
    assert sorted(out, key=str) == sorted([(3, near(b)), (5, c), (None, ""), (None, None), (2, ""), (7, d)], key=str)
    w = a.split()  # the middle set, which a null id alone holds, links the outer ones
    far, middle = " ".join([*w, "x", "y", "z", "p", "q", "s"]), " ".join([*w, "x", "y", "z"])
    chain = [(1, " ".join([*w[:-3], *w[-3:]][4:])), (None, " ".join(w)), (2, " ".join(w[: len(w) - 1] + w[-1:] + ["x", "y", "z", "p", "q"]))]
    assert {x.component_id for x in ngram_join.grouped(spark.createDataFrame([*chain, (None, middle), (9, far)], SCHEMA), 5, 80, 100).collect()} == {1}


def test_tasks_give_back_what_they_freed():
    """Python workers stay beside the JVM, so what a task has freed is not to stay with them."""
    kept = []

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4 // 1024

    def rows(batches):
        held = [b"x" * n for n in range(1500, 2500) for _ in range(100)]
        kept.append(b"x" * 100_000)  # above the others in the heap
        kept.append(resident())
        del held
        yield from batches

    assert list(releasing(rows)([1, 2])) == [1, 2] and resident() < kept[1] - 100
    assert releasing(lambda x: x + 1)(1) == 2


def test_anchors_spread_over_buckets():
    """Anchors are least hashes; by their highest bits, the first bucket would gather most of those of all blocks."""
    data = np.random.default_rng(3).integers(97, 123, 400_000).astype(np.uint8)
    found = suffix_dedup.Runs(data, np.array([0]), np.array([len(data)]), 100)
    sizes = np.bincount((found.anchors >> np.uint64(32)).astype(np.int64) * 92 >> 32, minlength=92)
    assert len(found.anchors) > 9000 and sizes.max() < 2 * sizes.mean()


def test_workers_keep_only_what_the_latest_stage_uses():
    for k in range(3):
        assert common.kept(("table", k), lambda k=k: k) == k
    assert [*pyspark.__dict__["_pixelfurrow_kept"]] == [("table", 2)]
    common.forget()
    assert not pyspark.__dict__["_pixelfurrow_kept"]


def test_language_id_makes_no_table_of_python_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "the cat sat on the mat", "en") for i in range(50)], SCHEMA + ", lang string")
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    assert langid.stage(spark, docs, "").count() == 50 and langid.learn(docs, limit=0).langs == []


def test_sliced_texts():
    texts = pa.array(["ab", None, "", "über", "x" * 50, "y"])
    out = [*common.sliced(texts, 6)]
    assert [(a, b) for a, b, _ in out] == [(0, 3), (3, 4), (4, 5), (5, 6)] and sum((t for *_, t in out), []) == texts.to_pylist()
    assert [*common.sliced(texts.slice(0, 0), 6)] == []
