"""Whitening, SimHash pivots and ranked search against brute force."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgermart.llm import simhash_pivots as pivots
from ledgermart.llm import term_pipeline as search
from ledgermart.llm import whitening
from ledgermart.llm.catalog import QUERIES

SF = "/root/testdata/sf0.01"


# --- whitening --------------------------------------------------------------

def usable(rows):
    return [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]


def exact_covariance(x):
    """Fractions, centred before multiplying."""
    n, d = len(x), len(x[0])
    s = [sum(v[k] for v in x) for k in range(d)]
    far = [[n * v[k] - s[k] for k in range(d)] for v in x]
    return s, [[Fraction(sum(f[i] * f[j] for f in far), n ** 3) for j in range(d)] for i in range(d)]


def check_whitened(rows, got, d):
    x = usable(rows)
    n = len(x)
    s, v = exact_covariance([v for _, v in x])
    v = np.array([[float(c) for c in row] for row in v])
    values = np.linalg.eigvalsh(v)[::-1]
    want = sorted(((i is None, i or 0), sum((n * c - t) ** 2 for c, t in zip(row, s))) for i, row in x)
    k = min(8, d)
    assert len(got) == n * k
    first = [r for r in got if r["component"] == 1]
    assert sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["deviation"]) for r in first) == want
    for c in range(k):
        mine = [r for r in got if r["component"] == c + 1]
        assert all(r["n"] == n for r in mine)
        assert mine[0]["explained"] == pytest.approx(max(values[c], 0) / np.trace(v), rel=1e-9, abs=1e-12)
        if values[c] <= 1e-12 * np.trace(v):
            assert all(r["whitened"] is None for r in mine)
        else:
            w = np.array([r["whitened"] for r in mine])
            assert abs(w.mean()) < 1e-9 and w.var() == pytest.approx(1, abs=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9


def test_whitening_equals_exact_covariance(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(11, 11))
    rows = [(i, [float(c) for c in (rng.normal(size=11) @ mix + 40).astype(np.float32)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitening.whitened_components(df.repartition(5)).collect()
    check_whitened(rows, got, 11)
    x = np.array([v for _, v in usable(rows)], dtype=float)
    values, u = np.linalg.eigh(np.cov(x.T, bias=True))
    own = {i: (x[k] - x.mean(axis=0)) @ u[:, ::-1] / np.sqrt(values[::-1]) for k, (i, _) in enumerate(rows)}
    for c in range(8):
        mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == c + 1}
        sign = math.copysign(1, mine[0] * own[0][c])
        assert all(mine[i] == pytest.approx(sign * own[i][c], abs=1e-6) for i in mine)


@pytest.mark.parametrize("offset", [0.0, 3e6, -2e12])
def test_whitening_is_exact_far_from_zero(spark, offset):
    """Sums of squares beyond 64 bits, and data far from zero."""
    rng = random.Random(4)
    rows = [(i, [rng.random() * 1e5 + offset, rng.random(), float(i % 7)]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    s, v = exact_covariance(x)
    assert model.sums == s
    rows_of = whitening.usable(df, "vec_id", "embedding", 1024)
    whole = np.array([t // len(x) for t in s])
    squares = whitening._gathered(rows_of, whitening._totals(whitening._add_squares(whole), 3, True, 1024, 100_000))
    got = whitening.covariance(len(x), s, squares)
    assert got.tolist() == [[float(c) for c in row] for row in v]  # each entry rounded once
    far = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(df, model).collect()}
    assert far == {i: sum((len(x) * c - t) ** 2 for c, t in zip(row, s)) for (i, _), row in zip(rows, x)}


def test_whitening_query_on_test_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitened(rows, QUERIES["op11_embedding_whitening"](spark, SF).collect(), 64)


def test_whitening_odd_vectors(spark, odd):
    got = QUERIES["op11_embedding_whitening"](spark, odd).collect()
    assert {r["vec_id"] for r in got} == {1, None, 9} and {r["n"] for r in got} == {4}
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got)  # the last dimension never changes
    same = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = whitening.whitened_components(same).collect()
    assert [(r["explained"], r["whitened"], r["deviation"]) for r in got] == [(0.0, None, 0), (0.0, None, 0)]


# --- SimHash ----------------------------------------------------------------

def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    said = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in said]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_classes(marks, radius=2):
    """{mark: the marks of its component} by comparing all pairs."""
    kinds = sorted(set(marks))
    parent = {m: m for m in kinds}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    return {m: find(m) for m in kinds}


def test_simhash_query_equals_brute_force(spark, odd):
    for folder in (SF, odd):
        docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
        marks = [brute_fingerprint(t) for _, t in docs]
        label, least = brute_classes(marks), {}
        for (i, _), m in zip(docs, marks):
            if i is not None:
                least[label[m]] = min(least.get(label[m], i), i)
        want = Counter((i, f"{m:016x}", least.get(label[m])) for (i, _), m in zip(docs, marks))
        got = QUERIES["op12_simhash_dedup"](spark, folder).collect()
        assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


def test_spark_hash_is_the_shingle_hash(spark):
    text = "one two three"
    assert spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first()["h"] % 2 ** 64 == pivots.shingle_hashes(text.encode()).tolist()[0]


@pytest.mark.parametrize("crowd", [2, 8, 64])
def test_pivot_cells_lose_no_link(spark, crowd):
    """Crowds of near fingerprints, chains and strangers; small cells force all cuts."""
    rng, marks = random.Random(crowd), set()
    for spread in (1, 2, 4, 7):
        origin = rng.getrandbits(64)
        for _ in range(250):
            m = origin
            for _ in range(rng.randrange(spread + 1)):
                m ^= 1 << rng.randrange(64)
            marks.add(m)
    chain = rng.getrandbits(64)
    for k in range(0, 60, 2):
        chain ^= 3 << k
        marks.add(chain)
    marks |= {rng.getrandbits(64) for _ in range(200)} | {0, 1, (1 << 64) - 1}
    signed = [(m - (1 << 64) if m >> 63 else m,) for m in marks]
    links = pivots.linked_marks(spark.createDataFrame(signed, "mark long"), crowd=crowd).collect()
    assert all(((r["a"] ^ r["b"]) & ((1 << 64) - 1)).bit_count() <= 2 for r in links)
    parent = {m: m for (m,) in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for r in links:
        parent[find(r["a"])] = find(r["b"])
    want = brute_classes(marks)
    groups, own = {}, {}
    for (s,) in signed:
        groups.setdefault(want[s % 2 ** 64], set()).add(s)
        own.setdefault(find(s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_last_cells_are_small():
    """What three cuts leave outside a cell: at most five bits, 32 fingerprints."""
    assert max(len(out) for a in range(10) for b in range(10) for _, out in pivots.cuts((a, b))) <= 5
    for way in range(10):
        assert pivots._path_of(1 * 10 + way) == (way,)
    assert pivots._path_of(134) == (3, 4)


def test_pivot_bound_holds():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2 ** 63, 500).astype(np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    apart = np.abs(pivots.distance_table(a) - pivots.distance_table(b)).max(axis=1)
    assert (apart <= np.bitwise_count(a ^ b)).all()


# --- ranked search ----------------------------------------------------------

def brute_search(docs, items, top=50):
    def terms(t):
        lowered = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)
    said = [(i, Counter(terms(t))) for i, t in docs]
    said = [(i, c, sum(c.values())) for i, c in said if c]
    n, length = len(said), sum(s for _, _, s in said)
    df = Counter(t for _, c, _ in said for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in said:
            m = 50 + 50 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if no else i, -s) for k, (s, no, i) in enumerate(sorted(scored)[:top])]
    return Counter(out)


@pytest.mark.parametrize("stages, shard_docs, block_items, block_terms", [(4, 2048, 500, 200_000), (1, 3, 500, 200_000), (7, 100, 2, 200_000), (3, 50, 500, 40)])
def test_ranked_search_equals_brute_force(spark, stages, shard_docs, block_items, block_terms):
    rng = random.Random(stages)
    kinds = [f"w{k}" for k in range(60)] + ["\u00c4x", "\u00e4x", "K9"]
    docs = [(None if k % 17 == 0 else k // 2, " ".join(rng.choice(kinds[:rng.randrange(2, 63)]) for _ in range(rng.randrange(0, 40))))
            for k in range(240)] + [(500, None), (501, "--")] + [(600, "w1 W1, w1\nk9")] * 70
    items = [(1, "w1 W2 k9 k9"), (2, "none of it"), (None, "w5.w6"), (3, None), (1, "w1 W2 k9 k9"), (4, " ".join(kinds))]
    got = search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
                               stages=stages, shard_docs=shard_docs, block_items=block_items, block_terms=block_terms)
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()) == brute_search(docs, items)
