"""Toxicity, quality and mixing."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrel.llm import labelled, mixing, quality, statistics, toxicity
from spindrel.llm.common import Scratch

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa river stone house green quiet".split()


def corpus(n, seed=0):
    """Toxic: an insult together with a group; either alone is harmless.  Low quality: shouting."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(8, 40))]
        insult, group, loud = rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.25
        words += ["grumf"] * insult + ["zorks"] * group
        rng.shuffle(words)
        text = " ".join(words)
        rows.append((i, text.upper() + "!!!" if loud else text))
        labels.append((i, int(not loud), int(insult and group)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus(1500)
    odd = [(None, "null id"), (5000, None), (5001, ""), (5002, "grumf zorks " + "alpha " * 50_000), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t in rows + odd], "doc_id long, text string, source string, score double").repartition(5)
    more = [(None, 1, 1), (7, 0, 1), (7, 1, 0), (6000, None, None), (5001, None, None)]
    return docs, spark.createDataFrame(labels + more, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


def plain_terms(text):
    """Levels of words and beginnings, counted one word at a time."""
    words = re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode())
    met = {}
    for w in set(words):
        buckets = labelled.word_terms(np.frombuffer(w, np.uint8))[1][0]
        for b in {int(b) for b in buckets if b >= 0}:
            met[b] = met.get(b, 0) + 1
    out = {b * 4 + i for b, n in met.items() for i, least in enumerate(labelled.LEVELS) if n >= least}
    return sorted(out | {labelled.size_term(len(words))})


@pytest.mark.parametrize("text", [None, "", "Zorks, zorks zorky ZORKA zorb zor zo", "é èé éèé", "ab " * 50_000, "the end " * 9000 + "x" * 40_000,
    "x" * 200_000, "one " + "xy" * 100_000 + " two " + "ab" * 40_000 + "! end", "z" * 65_536 + " zz", "z" * 65_537 + "z. " + "q" * 131_072,
])
def test_terms_equal_counting(text):
    assert sorted(labelled.terms(text).tolist()) == plain_terms(text)
    chosen = np.array(sorted(set(plain_terms("zorks zorky zorb")) | {labelled.size_term(3)}))
    want = [i for i, c in enumerate(chosen) if c in set(plain_terms(text))]
    assert labelled.Terms(chosen)(text).tolist() == want
    for word in re.findall("[a-z]{60000,}", text or ""):  # two long words are one term only if they are equal
        hashes = [labelled.word_terms(np.frombuffer(w.encode(), np.uint8))[0][0] for w in (word, word, word[:-1] + "p")]
        assert hashes[0] == hashes[1] != hashes[2]


def test_equal_words_hash_alike_wherever_they_stand():
    whole, buckets = labelled.word_terms(np.frombuffer(b"word other longer-word a word", np.uint8))
    assert whole[0] == whole[3] == whole[5] and len(set(whole.tolist())) == 4 and (buckets[0] == buckets[5]).all()


def test_toxicity_learns_a_pair(spark, tables):
    docs, labels, truth = tables
    machine = toxicity.fit(docs, labels)
    out = toxicity.score(docs, machine)
    assert out.columns == ["doc_id", "text", "source", "score", "held_out", "predicted"] and out.count() == docs.count()
    held = [r for r in out.where("held_out and doc_id < 1500").collect()]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    right = np.mean([r["predicted"] == truth[r["doc_id"]][1] for r in held])
    assert right > 0.97
    assert out.where("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0
    assert out.where("doc_id = 5002").first()["score"] > 0.5
    assert out.where("doc_id is null").first()["held_out"] is False
    assert toxicity.score(docs.limit(0), machine).count() == 0


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    x = np.array([0, 2, 5])
    pairs = sum(m.vectors[i] @ m.vectors[j] for a, i in enumerate(x) for j in x[a + 1 :])
    assert m.logit(x) == pytest.approx(0.3 + m.weights[x].sum() + pairs)


def test_quality(spark, tables):
    docs, labels, truth = tables
    model = quality.fit(docs, labels)
    assert 0 < len(model.rules) < 60
    out = quality.score(docs, model)
    held = out.where("held_out and doc_id < 1500").collect()
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == truth[r["doc_id"]][0] for r in held]) > 0.97
    for r in out.select("text", "score").limit(50).collect():  # the column equals plain evaluation
        x = np.array([statistics.measure(r["text"])])
        z = model.bias + sum(w * quality.satisfied(x, rule)[0] for rule, w in zip(model.rules, model.weights, strict=True))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)))
    assert out.where("doc_id in (5000, 5001)").select("score").distinct().count() == 1
    assert quality.score(docs.limit(0), model).count() == 0


def test_sample_is_bounded_and_without_contradictions(spark, tables):
    docs, labels, _ = tables
    rows = labelled.sample(docs, labels, {"toxic": "y"}, 100, F.lit(True), "doc_id", "text")
    assert rows.select("id").distinct().count() == 100
    every = labelled.sample(docs, labels, {"toxic": "y"}, 10_000, F.lit(True), "doc_id", "text")
    assert every.where("id = 7 or id is null or y is null").count() == 0


def test_one_class_or_no_labels(spark, tables):
    docs, labels, _ = tables
    none = labels.limit(0)
    for module in (quality, toxicity):
        out = module.score(docs.limit(20), module.fit(docs, none))
        assert out.where("score between 0 and 1").count() == 20
    only = labels.where("toxic = 0")
    assert toxicity.score(docs, toxicity.fit(docs, only)).where("predicted = 1").count() == 0
    assert mixing.mix(docs.limit(20), none).count() <= 20


def objective(r, t, p, w, pull=1e-5):
    total = t.sum()
    have = (t[:, None] * p).sum(0) / total
    want = w * have[np.argmax(w)] / w.max()
    gap = ((r * t)[:, None] * p).sum(0) / total - want
    return (gap**2 / have).sum() / 2 + pull / 2 * (t * (r - 1) ** 2).sum() / total, gap, have, want


def plain_descent(t, p, w, most, steps=4000, pull=1e-5):
    r = np.ones(len(t))
    for _ in range(steps):
        _, gap, have, _ = objective(r, t, p, w)
        r = np.clip(r - (p @ (gap / have) + pull * (r - 1)) / (1 + pull), 0, most)
    return r


HARD, MIXED, SOFT = (0.02, 0.002, 0.0008), (0.9, 0.3, 0.1), (3.0, 0.6, 0.2)


@pytest.mark.parametrize("kind", [HARD, MIXED, SOFT])
@pytest.mark.parametrize("target", [(0.9, 0.08, 0.02), (0.05, 0.05, 0.9), (0.6, 0.3, 0.1), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)])
@pytest.mark.parametrize("most", [None, 1.0])
def test_descent_reaches_the_minimum(kind, target, most):
    rng = np.random.default_rng(1)
    p, t, w = rng.dirichlet(kind, 2000), rng.integers(0, 500, 2000).astype(float), np.array(target)
    p[: len(p) // 3] = p[0]  # a third of all rows have one posterior

    def totals(at):
        v = 1 + p @ at.steps
        r, s = np.clip(v, 0, most), t[:, None] * p
        free = (v > 0) & (v < (np.inf if most is None else most))
        return r @ s, s[free].T @ p[free], float((t * (r * v - r * r / 2)).sum())

    got = mixing.descend(mixing.Rates(list("abc"), most, np.zeros(3)), totals, w, 200, 1e-3, 1e-5)
    r = got.of(p)
    assert got.converged and r.min() >= 0 and r.max() <= (most or np.inf)
    value, gap, have, want = objective(r, t, p, w)
    assert np.abs(gap + want - got.reached).max() < 1e-9
    near = 0.5 * ((1e-3 * np.maximum(want, 1e-3 * w.max())) ** 2 / have).sum()  # it may end as near as that
    assert value <= objective(plain_descent(t, p, w, most), t, p, w)[0] + near + 1e-9
    if got.feasible:
        assert (np.abs(gap) <= 0.01 * np.maximum(want, 1e-3)).all()
    else:  # nearer is out of reach: no rate within the bounds that moves lowers the difference
        slope = p @ (gap / have) + 1e-5 * (r - 1)
        moves = (slope < 0) & (r < (most or np.inf)) | (slope > 0) & (r > 0)
        assert np.abs(slope[moves] * t[moves] / t.sum()).sum() < 1e-3


@pytest.mark.parametrize("most", [None, 1.0])
def test_rates_over_rows(spark, most):
    rng = np.random.default_rng(0)
    p, t = rng.dirichlet([0.3, 0.3, 0.3], 400), rng.integers(0, 500, 400)
    names = list(mixing.TARGETS)
    rows = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(t, p, strict=True)], "n_words long, " + ", ".join(f"p_{n} double" for n in names))
    rows = Scratch(spark, "t").write(rows.repartition(3))
    target = {"clean": 0.5, "low": 0.3, "toxic": 0.2}
    found = mixing.rates(rows, target, most)
    got = rows.withColumn("r", found.column()).toPandas()
    assert np.abs(got["r"] - found.of(got[[f"p_{n}" for n in names]].to_numpy())).max() < 1e-9
    sums = np.array([(got["r"] * got["n_words"] * got[f"p_{n}"]).sum() for n in names])
    assert np.abs(sums / t.sum() - found.reached).max() < 1e-9
    if most is None:
        assert found.feasible and np.abs(sums / sums.sum() - list(target.values())).max() < 0.002
    none = mixing.rates(rows.limit(0), target, most)
    assert none.feasible and not none.steps.any()


def test_memberships_are_whole(spark, tables):
    docs, labels, _ = tables
    model = mixing.fit(docs, labels)
    out = mixing.memberships(docs.withColumn("n_words", F.lit("own")), model).toPandas()
    assert (np.abs(out[["p_clean", "p_low", "p_toxic"]].sum(axis=1) - 1) < 1e-12).all()
    assert out["n_words"].tolist() == [len((t or "").split()) for t in out["text"]]


def test_mix(spark, tables):
    docs, labels, truth = tables
    docs = docs.withColumn("p_low", F.lit("own")).withColumn("__rate", F.lit(3))
    out = mixing.mix(docs, labels)
    assert out.columns == docs.columns
    ids = [r[0] for r in out.select("doc_id").collect()]
    assert set(ids) <= {r[0] for r in docs.select("doc_id").collect()} and ids.count(0) in (0, 2)
    share = lambda ids, good: np.mean([truth[i] == (1, 0) for i in ids if i in truth])
    assert share(ids, None) > share(list(truth), None) + 0.1
    again = mixing.mix(docs, labels, targets={"clean": 0.1, "low": 0.1, "toxic": 0.8}, most=None)
    more = [truth[r[0]][1] for r in again.select("doc_id").collect() if r[0] in truth]
    assert again.columns == docs.columns and np.mean(more) > np.mean([t for _, t in truth.values()]) + 0.1
    assert mixing.mix(docs.limit(0), labels).count() == 0
