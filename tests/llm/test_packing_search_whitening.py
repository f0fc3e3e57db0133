"""Packing, ranked search and whitening against plain versions."""

import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from test_operators import BIG, SCHEMA, corpus

from textsignal.llm import op11_packing, op12_ranked_search, op13_whitening

CLASHES = ["row", "bucket", "place", "number", "before", "inside", "sequence_id", "offset", "piece", "term", "tf", "n", "item", "rank", "score",
           "x", "len", "v", "vec"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), SCHEMA).repartition(5)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- op11 -----------------------------------------------------------------------------------------------------------

def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(op11_packing.default_tokenizer())


ODD = ["", "Hello, WORLD it's I'm!! 'tis don't", "<|endoftext|> a", "x<|startoftext|>y", "ΑΣ. ΑΣ Σ.Α", "İ H̱ ≠ áb", "éé 12345 ½ ٣٤",
       "\x00a\x01 b\x1cc\x1dd\x85e f g", "!'s '' 's'S 'RE you'LL", "don't!'t", "日本語 テスト😀😀", "a\x0bb\x0cc", "a_b-c.d@e 3'd4", "<|endoftext| >",
       " ́a", "Ａ１", "w" * 3000, "a." * 2000, " 　 x"]


def test_ids_are_the_librarys():
    words, whole = op11_packing.Words(op11_packing.default_tokenizer(), room=40), library()
    r = random.Random(5)
    alphabet = "aBcsStrevmld'  \n.,!-12éÉßŸÿĲŁſŉ×÷́İΣσς<|>\x00\x85 　日½"
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 40))) for _ in range(3000)]
    texts += ["a" + c + "b " + c + "." for c in map(chr, range(0x80, 0x250))] + [c + "s" for c in map(chr, range(0x21, 0x180))]
    for text in texts:
        assert array("I", words.encode(text.encode())).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def check_plan(lengths, size):
    histogram = Counter(lengths)
    places = op11_packing.plan(histogram, size)
    bins = defaultdict(list)
    for length, n in histogram.items():
        rows = places[places[:, 0] == length]
        for number in range(n):
            _, first, each, sequence, offset = rows[rows[:, 1] <= number][-1].tolist()
            times, within = divmod(number - first, each)
            bins[sequence + within].append((offset + times * length, length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def best_fit(lengths, size):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= x]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - x)
        else:
            gaps.append(size - x)
    return len(gaps)


def test_plan_fills_bins():
    r = random.Random(2)
    for trial in range(40):
        size = r.choice([1, 7, 50, 64])
        lengths = [min(size, max(1, int(r.lognormvariate(math.log(size / 3), 1)))) for _ in range(r.randint(1, 300))]
        n = check_plan(lengths, size)
        assert -(-sum(lengths) // size) <= n <= best_fit(lengths, size)
    assert check_plan([1] * 130, 64) == 3
    assert check_plan([40, 14, 10] * 20 + [50, 7, 5, 2] * 10 + [33, 31] * 5, 64) == 35     # triples and pairs fill every bin
    assert op11_packing.plan({}, 64).shape == (0, 5)


def test_packing(docs, empty, monkeypatch):
    monkeypatch.setattr(op11_packing, "RANKED", 3)          # equal lengths are numbered over several buckets
    size, whole = 64, library()
    want = Counter()
    for r in corpus():
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for i, lo in enumerate(range(0, len(ids), size)):
            part = ids[lo:lo + size]
            want[r[0], i, lo, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    out = op11_packing.pack(docs, size).collect()
    assert Counter(tuple(r)[:5] for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        assert [o for o, _ in sorted(pieces)] == [sum(x for _, x in sorted(pieces)[:i]) for i in range(len(pieces))]
        assert sum(x for _, x in pieces) <= size
    assert len(bins) <= best_fit([r.length for r in out], size)
    filled = {r.sequence_id: r for r in op11_packing.sequences(docs, size).collect()}
    assert len(filled) == len(bins) and sum(len(r.ids) for r in filled.values()) == sum(r.length for r in out)
    assert max(len(r.ids) for r in filled.values()) <= size and all(r.offsets[0] == 0 for r in filled.values())
    assert op11_packing.pack(empty).collect() == []
    assert op11_packing.sequences(empty).collect() == []


# --- op12 -----------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(rows, items, k):
    found = [(i, ts) for i, t in rows if (ts := plain_terms(t))]
    n_docs, n_terms = len(found), sum(len(ts) for _, ts in found)
    df = Counter(t for _, ts in found for t in set(ts))
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        for doc, ts in found:
            tf, m = Counter(ts), 100 - 90 + (90 * len(ts) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
                        for t in set(plain_terms(text)) if t in tf)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank + 1, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def items_of(spark):
    texts = [r[1] for r in corpus()]
    r = random.Random(9)
    some = [(i, " ".join((texts[r.randrange(16, 60)] or "x").split()[:30])) for i in range(25)]
    rows = some + [some[0], (30, None), (31, ""), (32, "!!"), (33, "nowhereatall"), (34, texts[0]), (35, texts[16]), (None, texts[0]), (36, "the LINE é")]
    return rows, spark.createDataFrame(rows, "item_id long, text string").withColumn("item", F.lit(1))


@pytest.mark.parametrize("k,bucket,chunk,first,item_bytes", [(10, 2048, 2_000_000, 4096, 4 << 20), (3, 4, 300, 5, 3000)])
def test_ranking(spark, docs, empty, monkeypatch, k, bucket, chunk, first, item_bytes):
    monkeypatch.setattr(op12_ranked_search, "BUCKET", bucket)
    monkeypatch.setattr(op12_ranked_search, "FIRST", first)
    monkeypatch.setattr(op12_ranked_search.chunks, "__defaults__", (chunk,))
    rows, items = items_of(spark)
    got = op12_ranked_search.rank(docs, items, k, item_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_ranking([(r[0], r[1]) for r in corpus()], [x for x in rows if x[1] is not None], k)
    assert op12_ranked_search.rank(empty, items).collect() == []
    assert op12_ranked_search.rank(docs, items.limit(0)).collect() == []


def test_buckets_prune():
    """Short vectors are dropped by the norm alone, and rare terms alone give the candidates inside a bucket."""
    n = op12_ranked_search.BUCKET * 3
    weights = np.array([10, 1000, 1])
    search = op12_ranked_search.Search([np.array([0, 1])], weights, n, n * 5, 2)
    tf = np.concatenate([np.full(10, 50), np.ones(n - 10, np.int64)])
    term = np.concatenate([np.full(10, 1), np.full(n - 10, 0)])
    looked = []
    real = search.bucket
    search.bucket = lambda lo, norm, row, t, x, doc, floors, kept: (looked.append((lo, floors.copy())), real(lo, norm, row, t, x, doc, floors, kept))
    doc = np.stack([np.zeros(n, np.int64), np.arange(n)], axis=1)
    (item, ids, score), = search.best(doc, np.full(n, 5), np.ones(n, np.int64), term, tf, np.zeros(1, np.int64))
    assert item == 0 and ids[:, 1].tolist() == [0, 1] and score[0] == score[1] > 0
    assert looked[1][1][0] == score[1]            # the second bucket starts from the first one's k-th score


# --- op13 -----------------------------------------------------------------------------------------------------------

def plain_whitening(rows, k=16):
    kept = [(i, [math.floor(64 * float(c)) + 1000000 for c in v]) for i, v in rows
            if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    n, exact = len(fit), [sum(int(x) for x in c) for c in fit.T]
    values, vectors = np.linalg.eigh(np.cov((fit - fit.mean(axis=0)).T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    z = (np.array([x for _, x in kept]) - fit.mean(axis=0)) @ vectors[:, :k] / np.sqrt(values[:k])
    dev = [sum((n * c - s) ** 2 for c, s in zip(x, exact)) for _, x in kept]
    return n, [i for i, _ in kept], dev, z, values / values.sum()


def test_whitening(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(300, 20)) * np.linspace(0.2, 3, 20)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(BIG, rows[0][1]), (None, rows[1][1]), (5, rows[5][1])] + [(1000 + i, rows[7][1]) for i in range(150)]
    bad = [(2000, None), (2001, [None] * 20), (2002, [float("nan")] + [1.0] * 19), (2003, [float("inf")] + [1.0] * 19), (2004, []), (2005, [1e300] * 20)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).withColumn("len", F.lit("a"))
    got = op13_whitening.whiten(df.repartition(6)).collect()
    n, ids, dev, z, share = plain_whitening(rows)
    assert Counter(r.vec_id for r in got) == Counter({i: 16 * c for i, c in Counter(ids).items()})
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    want = {i: (d, row) for i, d, row in zip(ids, dev, z)}
    sign = {}
    for r in got:
        d, row = want[r.vec_id]
        x = row[r.component - 1]
        sign.setdefault(r.component, np.sign(x * r.whitened))
        assert r.deviation == d and abs(r.explained / share[r.component - 1] - 1) < 1e-10
        assert abs(r.whitened - sign[r.component] * x) < 1e-8


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    table = lambda rows: op13_whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert table([]) == [] and table([(1, None), (2, [])]) == []
    assert table([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []                     # no variance
    two = table([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0, 1.0, 1.0]), (4, [5.0, 1.0, 1.0])])
    assert [(r.vec_id, r.component, r.n, r.deviation, abs(round(r.whitened, 9)), r.explained) for r in sorted(two)] == [
        (i, 1, 2, d, 1.0, 1.0) for i, d in ((1, 128 ** 2), (2, 128 ** 2), (3, 256 ** 2), (4, 256 ** 2))]
    wide = table([(1, [2.0 ** 39, 0.0]), (2, [-2.0 ** 39, 1.0]), (3, [0.0, 5.0])])
    assert {r.vec_id: r.deviation for r in wide} == {1: None, 2: None, 3: (3 * 320 - 384) ** 2}


def test_eigenvectors_of_clusters():
    r = np.random.default_rng(8)
    q = np.linalg.qr(r.normal(size=(40, 40)))[0]
    values = np.concatenate([[5, 5 * (1 + 1e-9), 5 * (1 + 3e-9)], np.linspace(4, 1, 30), [1e-3, 1e-3 * (1 + 1e-10), 1e-7, 1e-7, 1e-7, 0, 0]])
    a = (q * values) @ q.T
    found, x = op13_whitening.eigen(a)
    assert np.allclose(found, np.sort(values)[::-1], rtol=0, atol=5 * 4e-16 * 10)
    assert np.abs(x.T @ x - np.eye(40)).max() < 1e-14
    assert np.abs(a @ x - x * found).max() < 1e-14 * 5
    parts = op13_whitening.clusters(np.array([3.0, 1.0, 3.0, 2.0]), 1e-6)
    assert [sorted(p.tolist()) for p in parts] == [[0, 2]]
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    assert np.abs(a @ x - x * found).max() < 1e-3 * np.abs(a @ rough - rough * np.diag(rough.T @ a @ rough)).max()
    assert op13_whitening.eigen(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
