"""Sharding and nearest neighbours."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrel.llm import ann, sharding


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=9), st.integers(1, 6), st.integers(0, 9))
def test_matrix_has_exact_sums(sizes, blocks, seed):
    total = sum(sizes)
    columns = np.array([total // blocks + (i < total % blocks) for i in range(blocks)])
    m = np.array([sharding.matrix_row(np.array(sizes), columns, i, seed) for i in range(len(sizes))])
    assert m.sum(1).tolist() == sizes and m.sum(0).tolist() == columns.tolist() and (m >= 0).all()


def test_draws_beyond_numpy_have_its_law(monkeypatch):
    rng = np.random.default_rng(3)
    want = rng.hypergeometric(30, 70, 20, 40_000)
    monkeypatch.setattr(sharding, "_NUMPY_MAX", 1)
    got = np.array([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(40_000)])
    assert abs(got.mean() - want.mean()) < 0.05 and abs(got.var() - want.var()) < 0.12
    assert np.abs(np.bincount(got, minlength=21) - np.bincount(want, minlength=21)).max() < 500
    far = np.array([sharding.hypergeometric(rng, 3 * 10**10, 7 * 10**10, 2 * 10**10) for _ in range(300)])
    assert abs(far.mean() / 6e9 - 1) < 1e-5
    assert sharding.split(rng, np.array([5, 0, 7]), 12).tolist() == [5, 0, 7]


@pytest.mark.parametrize(("n", "d"), [(0, 7), (5, -5), (999, 3), (10**6, 5000), (2 * 10**6, -1999), (10**9, 777), (10**12, 50), (10**12, -300)])
def test_ratios_of_factorials(n, d):
    want = math.fsum(math.log(n + i) for i in range(1, d + 1)) if d > 0 else -math.fsum(math.log(n - i) for i in range(-d))
    assert abs(sharding.log_ratio(n, d) - want) < 1e-8


@pytest.mark.parametrize(("rows", "block"), [(0, 4), (3, 4), (1000, 1 << 17), (1000, 7)])
def test_shuffle(spark, rows, block):
    docs = spark.range(rows).selectExpr("if(id % 5 = 0, null, id) as doc_id", "repeat('x', cast(id % 3 as int)) as text", "'old' as shard", "1 as __row", "id")
    out = sharding.uniform_shuffle(docs.repartition(6), shards=40, block_rows=block)
    assert out.columns == ["doc_id", "text", "id", "shard", "slot"]
    got = out.toPandas()
    assert sorted(got["id"]) == list(range(rows))
    sizes = got.groupby("shard")["slot"].agg(["count", "min", "max"]).reindex(range(40))
    counts = sizes["count"].fillna(0)
    assert counts.max() - counts.min() <= 1 and counts.is_monotonic_decreasing
    assert ((sizes["max"] + 1 == sizes["count"]) | sizes["count"].isna()).all() and (sizes["min"].fillna(0) == 0).all()


def test_shuffle_is_uniform_and_repeatable(spark):
    docs = spark.range(0, 4000, 1, 4)
    a, b = (sharding.uniform_shuffle(docs, shards=4, seed=1).toPandas().sort_values("id").reset_index(drop=True) for _ in range(2))
    assert a.equals(b)
    per = np.array([[((a["shard"] == s) & (a["id"] // 1000 == p)).sum() for s in range(4)] for p in range(4)])
    assert ((per - 250) ** 2 / 250).sum() < 40  # mean 9
    place = a["shard"] * 1000 + a["slot"]
    assert abs(np.corrcoef(a["id"], place)[0, 1]) < 0.07


def brute(rows, k=20, every=20):
    rows = [(i, v) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows)]
    out = {}
    for q, v in rows:
        if q % every:
            continue
        scores = []
        for i, w in rows:
            if i != q:
                s = 0.0
                for a, b in zip(v, w, strict=True):
                    s += a * b
                scores.append((-s, i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def test_neighbours_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    hot = rng.normal(size=8).tolist()
    rows += [(i, hot) for i in range(300, 420)]
    rows += [rows[5], rows[20]]  # repeated rows count once
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [1.0, None] + [0.0] * 6), (1060, [float("nan")] * 8), (1080, [float("inf")] * 8), (None, hot), (1100, [1.0]), (1120, [])]
    df = spark.createDataFrame([(i, v, "r") for i, v in rows + odd], "vec_id long, embedding array<double>, rank string").repartition(5)
    got = {}
    for r in ann.search(df, rerank=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute(rows)
    assert ann.search(df.limit(0)).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(one).collect()] == [(0, 1, 3, 1.0)]


def made(kind, n, dim, rng):
    x = rng.normal(size=(n, dim))
    if kind == "clusters":
        x = 3 * rng.normal(size=(40, dim))[rng.integers(0, 40, n)] + 0.3 * x
    if kind == "norms":
        x = x * np.exp(rng.normal(size=(n, 1)))
    if kind == "outlier":
        x[7] *= 1000
    return x.astype(np.float32)


@pytest.mark.parametrize("kind", ["even", "clusters", "norms", "outlier"])
def test_recall(spark, kind, monkeypatch):
    monkeypatch.setattr(ann, "INDEX_BLOCK", 2000)
    x = made(kind, 4000, 32, np.random.default_rng(4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = ann.search(df).toPandas()
    x = x.astype(float)
    hits = 0
    for q, g in found.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(g["vec_id"]))
    assert len(found) == 200 * 20 and hits / len(found) >= 0.9


def test_a_hot_vector_is_one_question(spark, monkeypatch):
    from spindrel.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(ann, "INDEX_BLOCK", 64)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(6)
    hot = rng.integers(-3, 4, 6).astype(float).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(1, 1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.search(df, rerank=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute([r for r in rows if any(r[1])])


def test_beam_is_no_worse_than_greedy():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 16)).astype(np.float32)
    books = ann.fit(x, books=4, words=32)
    error = lambda beam: ((x - books[np.arange(4), ann.encode(x, books, beam)].sum(1)) ** 2).sum()
    assert error(8) <= error(1)
