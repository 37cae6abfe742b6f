"""Near-duplicates of the pipeline against all pairs of exact five-word sets."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrel.llm import common, resemblance, simhash
from spindrel.llm.exact_dedup import exact_dedup


def five(text):
    w = (text or "").encode("utf-8", "replace").translate(simhash._LOWER).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows):
    """Ids that stay: the least of each class over pairs of at least 0.8."""
    sets, root = [(i, five(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for at, (i, x) in enumerate(sets):
        for j, y in sets[:at]:
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(i for i in root if root[i] == i)


def made():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = [(1, None), (2, " \n"), (3, ""), (4, "one two"), (5, "ONE  two"), (6, "one two three")]
    for group in range(40):
        base = [word() for _ in range(rng.choice([30, 120, 400]))]
        rows.append((100 * group + 10, " ".join(base)))
        for j in range(rng.choice([1, 3, 12])):
            text = base[:]
            for _ in range(rng.randint(1, max(1, len(base) // 40))):
                text[rng.randrange(len(text))] = word()
            rows.append((100 * group + 11 + j, " ".join(text)))
    return rows


def test_stage_leaves_no_pair_of_five_words(spark, sf):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect()) == plain(rows)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), sf).count() == 0


def test_stage_over_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == plain([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_bound_is_exact(spark):
    rows = []
    for common in (80, 79):
        x = list(range(common + 10))
        rows.append((x, x[:common] + list(range(500, 600 - len(x)))))
    got = spark.createDataFrame([*rows, ([], []), ([-1], [-1])], "x array<long>, y array<long>").select(resemblance.similar(F.col("x"), F.col("y"))).collect()
    assert [len(set(x) | set(y)) for x, y in rows] == [100, 100] and [r[0] for r in got] == [True, False, True, True]


def test_fingerprints_are_those_of_the_sets():
    for text in (None, "a", "a b c d e f g", " ".join(f"w{i}" for i in range(3000))):
        x = resemblance.runs(text)
        want = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in x) > len(x))
        assert bin(resemblance.print_of(x) % (1 << 64)).count("1") == bin(want).count("1")


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_find_every_near_pair_of_different_classes(spark, block):
    rng = np.random.default_rng(block)
    base = rng.integers(0, 1 << 32, 60, dtype=np.uint64)
    sets, c = [], []
    for i in range(40):
        x = base.copy()
        at = rng.choice(60, rng.integers(0, 14), replace=False)
        x[at] = rng.integers(0, 1 << 32, len(at), dtype=np.uint64)
        sets.append(np.unique(x.astype("<u4")))
        c.append(i % 7 if i % 3 else 99)
    rows = [(k, lo, hi, own, c[x], x, sets[x].tobytes()) for k in (5, 6) for x in range(k - 5, 40) for own, lo, hi in blocks(x, block)]
    df = spark.createDataFrame(rows, "k long, lo int, hi int, own int, c long, x long, set binary").repartition(3, "k", "lo", "hi")
    got = {(min(r), max(r)) for r in df.sortWithinPartitions("k", "lo", "hi").mapInPandas(resemblance._compare, "u long, v long").collect()}
    sure = lambda i, j: 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if c[i] != c[j] and sure(i, j)}
    assert want <= got and all(c[i] != c[j] for i, j in got) and len(want) > 20


def blocks(x, size):
    n = -(-40 // size)
    own = x * 7919 % n
    return [(own, min(own, j), max(own, j)) for j in range(n)]


def test_hot_keys_are_joined_where_they_stand(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    scratch = common.Scratch(spark, "t")
    rows = scratch.write(spark.range(3000).selectExpr("id", "if(id % 3 = 0, -1, id % 500) as k"))
    values = scratch.write(spark.range(-1, 400).selectExpr("id as k", "id * 2 as v"))
    got = {(r["id"], r["v"]) for r in common.hot_join(rows, values, "k", scratch).collect()}
    assert got == {(i, 2 * k) for i in range(3000) if (k := -1 if i % 3 == 0 else i % 500) < 400}
    monkeypatch.setattr(common, "HOT_ROWS", 5000)
    assert common.hot_join(rows, values, "k", scratch).count() == len(got)


def test_hot_groups_end_alike(spark, sf, monkeypatch):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    assert sorted(r[0] for r in resemblance.near_dedup(docs).collect()) == plain(rows)
    fps = [simhash.fingerprint(t) for _, t in rows]
    assert {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(docs).collect()} == {i: f"{f:016x}" for (i, _), f in zip(rows, fps, strict=True)}
    kept = exact_dedup(docs).where("kept").collect()
    assert len(kept) == len({"".join((t or "").split()) for _, t in rows})
