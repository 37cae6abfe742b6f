"""Exact and near duplicates, and the codes and components they use."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrel.llm import golomb, simhash
from spindrel.llm.common import Scratch, marked, row_marks
from spindrel.llm.components import components
from spindrel.llm.exact_dedup import exact_dedup, owner_base

ODD = [
    (1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " \x0b\x0c\r"), (None, "ab"), (None, "only null id"), (7, "x" * 300_000),
    (8, "x" * 300_000), (9, "é é"), (10, "éé"), (11, "twice"), (11, "twice"), (12, " "),
]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, (1 << 48) - 1), max_size=200), st.integers(0, 1 << 47))
def test_golomb_round_trip(values, base):
    x = np.array(sorted(v for v in values if v >= base), np.uint64)
    assert golomb.decode(golomb.encode(x, base), base).tolist() == x.tolist()


def test_owner_ranges_cover_all():
    for n in (1, 3, 7, 200):
        assert owner_base(0, n) == 0 and owner_base(n, n) == 1 << 48
        assert all(owner_base(i, n) < owner_base(i + 1, n) for i in range(n))


def plain_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, (doc, text) in enumerate(rows):
        groups.setdefault(norm(text), []).append((-len(text or ""), doc is None, doc or 0, i, doc))
    out = []
    for k, g in groups.items():
        best = min(g)
        out += [(x[4], best[4], len(g), x[3] == best[3], hashlib.sha256(k.encode()).hexdigest()) for x in g]
    return sorted(map(repr, out))


@pytest.mark.parametrize("parts", [1, 5])
def test_exact_dedup_of_odd_rows(spark, parts):
    docs = spark.createDataFrame([(i, t, "own", 5) for i, t in ODD], "doc_id long, text string, kept string, __row int").repartition(parts)
    found = exact_dedup(docs, owners=3)
    assert found.columns == ["doc_id", "text", "keep_id", "group_size", "kept", "text_sha256"]
    rows = [tuple(r) for r in found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    want = plain_exact(ODD)
    same = lambda rows: sorted(re.sub(r"True|False", "", r) for r in rows)  # noqa: E731  which of equal rows stays depends on the order
    assert same(map(repr, rows)) == same(want)
    assert sum(r[3] for r in rows) == len({r[4] for r in rows})


def test_exact_dedup_large_group_and_empty(spark):
    rows = [(i, "copy of one" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    found = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    kept = found.where("kept")
    assert kept.count() == 2001 and found.where("group_size = 1000 and keep_id = 0").count() == 1000
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_marks_in_slices(spark, monkeypatch):
    from spindrel.llm import common

    rows = spark.range(0, 1000, 1, 7).selectExpr("id", "monotonically_increasing_id() as r")
    scratch = Scratch(spark, "t")
    rows = scratch.write(rows)
    marks = scratch.write(row_marks(rows.where("id % 3 = 0"), "r"))
    monkeypatch.setattr(common, "MARKS_BYTES", 200)
    for keep, want in ((True, 334), (False, 666)):
        got = marked(rows, "r", marks, keep)
        assert got.count() == want and got.where(f"(id % 3 = 0) = {str(keep).lower()}").count() == want


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAbÉé \t\n\x0b .", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_fingerprint_is_that_of_the_whole_text():
    text = " ".join(f"w{i % 977}" for i in range(80_000))
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_masks_cover_every_triple():
    rng = random.Random(1)
    for level in (simhash.MASKS, *map(simhash._second, range(15))):
        free = [b for b in range(64) if any(m >> b & 1 for m in level)]
        for _ in range(2000):
            bits = sum(1 << b for b in rng.sample(free, 3))
            assert any(m & bits == 0 for m in level)
    assert max(64 - (simhash.MASKS[i] | m).bit_count() for i in range(15) for m in simhash._second(i)) <= 16


def classes_of(x):
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(x)):
        for j in range(i):
            if (x[i] ^ x[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(x))]


def partition(labels):
    out = {}
    for i, r in enumerate(labels):
        out.setdefault(r, set()).add(i)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("seed", range(4))
def test_bucket_by_keys_equals_by_pairs(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 30, 15, dtype=np.uint64)
    flips = [base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 30, (k, 15), dtype=np.uint64), axis=0) for k in (1, 2, 3) for _ in range(5)]
    x = np.unique(np.concatenate([base, *flips]))
    want = partition(classes_of(x.tolist()))
    for edges in (simhash._by_pairs(x), simhash._by_keys(x, (1 << 30) - 1)):
        assert partition(simhash._roots(len(x), *edges).tolist()) == want


@pytest.mark.parametrize("most", [simhash.BUCKET, 4])
def test_forest_of_dense_fingerprints(spark, most):
    """Also where most buckets go through the finer masks."""
    rng, x = random.Random(5), set()
    for _ in range(4):
        c = rng.getrandbits(64)
        x |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(25)}
    x = sorted(x)
    fps = spark.createDataFrame([(simhash._signed(v),) for v in x], "fp long").repartition(3)
    edges = simhash.forest(fps, Scratch(spark, "t"), most).collect()
    at = {simhash._signed(v): i for i, v in enumerate(x)}
    ends = np.array([(at[r["a"]], at[r["b"]]) for r in edges]).T
    assert partition(simhash._roots(len(x), *ends).tolist()) == partition(classes_of(x))


def drive(reader, rows, size):
    import pyarrow as pa

    rows = sorted(rows)
    cols = lambda part: pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int64()) for i in range(3)], ["t", "k", "x"])
    out = []
    for batch in reader(iter([cols(rows[i : i + size]) for i in range(0, len(rows), size)])):
        out += batch.to_pylist()
    return out


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_reader_hands_large_buckets_on_whole(size):
    """A bucket beyond the limit comes out row by row, whatever batches it is cut into."""
    rows = [(0, 1, i) for i in range(2)] + [(1, 4, 1 << i) for i in range(20)] + [(1, 9, 3), (2, 0, 8)]
    out = drive(simhash._edges(False, 5), rows, size)
    assert sorted(r["a"] for r in out if r["b"] is None) == sorted(1 << i for i in range(20))
    assert all(r["t"] == 1 for r in out if r["b"] is None)
    assert [(r["a"], r["b"]) for r in out if r["b"] is not None] in ([(0, 1)], [(1, 0)])


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (5, 4), (7, 7), (None, 3), (20, 30), (30, 25), (25, 20)]
    edges += [(100 + i, 101 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 60)]
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    got = {r["node"]: r["root"] for r in found.collect()}
    assert got == {2: 1, 3: 1, 4: 1, 5: 1, 11: 10, 25: 20, 30: 20} | {101 + i: 100 for i in range(40)} | {500 + i: 500 for i in range(1, 60)}


def test_near_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 3, "z") for i, t in ODD], "doc_id long, text string, fp int, component_id string").repartition(4)
    rows = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    fps = [simhash.fingerprint(t) for _, t in ODD]
    label = classes_of(fps)
    least = {}
    for (i, _), r in zip(ODD, label, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = [(i, f"{f:016x}", least[r]) for (i, _), f, r in zip(ODD, fps, label, strict=True)]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.near_dedup(docs.limit(0)).count() == 0


def test_near_duplicates_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    label = classes_of([plain_fingerprint(r["text"]) for r in rows])
    least = {}
    for r, k in zip(rows, label, strict=True):
        least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    want = {r["doc_id"]: least[k] for r, k in zip(rows, label, strict=True)}
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == want
