"""Mixing documents to target shares of soft domains.

A classifier learned from a labelled table gives each document a posterior over
domains.  Its tokens belong to each domain by that share.  Projected gradient
least squares then fits a rate of repetition for each document, not negative,
so that the expected tokens of each domain match the targets.

A document's rate is the projection onto its bounds of 1 plus its posterior times
the sum of the steps made, so a step is a number for each domain: one scan of
sizes and whole posteriors gives its sums, and nothing else comes to the driver.
Tokens are words between white space, unless a column of other sizes is named.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, without
from .labelled import chosen_terms, finder, places, sample
from .statistics import NAMES, measure, statistics

#: Labelled texts that are learned from, at most; terms chosen for each label; bounds that cut a statistic.
SAMPLE, TERMS, CUTS = 10_000, 512, 7
#: Domains and their target shares of tokens, as the production run mixes them.
TARGETS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}


def domain(quality: Column, toxic: Column) -> Column:
    """The place of the labelled domain: toxic before low before clean; null if a label that decides is."""
    return F.when(toxic == 1, 2).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 0)


@dataclass
class Classifier:
    cuts: np.ndarray  # (statistics, bounds)
    terms: np.ndarray
    bias: np.ndarray  # (domains,)
    bins: np.ndarray  # (statistics, bounds + 1, domains)
    weights: np.ndarray  # (terms, domains)


def train(stats: np.ndarray, found: list[np.ndarray], y: np.ndarray, domains: int, terms: np.ndarray, penalty: float = 1e-4) -> Classifier:
    """Softmax regression on binned statistics and terms, by accelerated gradients with a quadratic penalty."""
    cuts = np.quantile(stats, np.linspace(0, 1, CUTS + 2)[1:-1], axis=0).T
    at = (stats[:, :, None] > cuts).sum(2)
    n, s = stats.shape
    width = CUTS + 1
    a = np.zeros((n, s * width + len(terms)), np.float32)
    a[np.arange(n)[:, None], np.arange(s) * width + at] = 1
    for i, x in enumerate(found):
        a[i, s * width + x] = 1
    hot = np.eye(domains, dtype=np.float32)[y]
    w = np.zeros((a.shape[1], domains), np.float32)
    b = np.log((hot.sum(0) + 1) / (n + domains)).astype(np.float32)
    u, ub, t = w.copy(), b.copy(), 1.0
    step = 2 / float((a.sum(1) + 1).mean())
    for _ in range(200):
        z = a @ u + ub
        z = np.exp(z - z.max(1, keepdims=True))
        g = (z / z.sum(1, keepdims=True) - hot) / n
        nw, nb = u - step * (a.T @ g + penalty * u), ub - step * g.sum(0)
        t2 = (1 + sqrt(1 + 4 * t * t)) / 2  # no numpy scalar, which would widen the arrays
        u, ub = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    w = w.astype(float)
    return Classifier(cuts, terms, b.astype(float), w[: s * width].reshape(s, width, domains), w[s * width :])


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """A classifier of the labelled domains, learned from at most ``limit`` texts."""
    use = domain(F.col("quality"), F.col("toxic")).isNotNull()
    rows = sample(docs, labels, {"quality": "quality", "toxic": "toxic"}, limit, use, id_col, text_col)
    rows = rows.withColumn("y", domain(F.col("quality"), F.col("toxic"))).where("y is not null")
    rows = Scratch(docs.sparkSession, "mixing").write(rows)
    terms = chosen_terms(rows, ["quality", "toxic"], TERMS)
    got = rows.select(statistics(F.col("text")).alias("s"), F.pandas_udf(places(terms), "array<int>")("text").alias("x"), "y", "id")
    got = got.orderBy(F.xxhash64("id"), "id").limit(limit).select("s.*", "x", "y").toPandas()
    if not len(got):
        got = pd.DataFrame({**dict.fromkeys(NAMES, [0.0]), "x": [[]], "y": [0]})
    found = [np.asarray(x, np.int64) for x in got["x"]]
    return train(got[list(NAMES)].to_numpy(float), found, got["y"].to_numpy(int), len(TARGETS), terms)


def posteriors(model: Classifier, texts) -> tuple[np.ndarray, np.ndarray]:
    """(words, posteriors) of whole texts."""
    find = finder(model.terms)
    stats = np.array([measure(t) for t in texts], float).reshape(-1, len(NAMES))
    found = [find(t) for t in texts]
    at = (stats[:, :, None] > model.cuts).sum(2)
    z = model.bias + model.bins[np.arange(at.shape[1]), at].sum(1)
    of = np.repeat(np.arange(len(found)), [len(f) for f in found])
    if len(of):
        np.add.at(z, of, model.weights[np.concatenate(found)])
    z = np.exp(z - z.max(1, keepdims=True))
    # The statistic is the logarithm of 1 + words, which gives their number back without an error.
    return np.rint(np.expm1(stats[:, NAMES.index("words")])).astype(np.int64), z / z.sum(1, keepdims=True)


def _members(model: Classifier, names: list[str]):
    def run(texts: pd.Series) -> pd.DataFrame:
        words, p = posteriors(model, texts.tolist())
        return pd.DataFrame({"n_words": words, **{n: p[:, i] for i, n in enumerate(names)}})

    return run


def memberships(docs: DataFrame, model: Classifier, text_col: str = "text", domains: tuple[str, ...] = tuple(TARGETS)) -> DataFrame:
    """``docs`` with n_words (runs between white space, of the whole text) and a posterior p_<domain> for each domain.

    Null and empty texts have no words and the posterior of an empty text.
    Columns of those names are replaced, others pass unchanged.
    """
    names = [f"p_{d}" for d in domains]
    base = without(docs, "n_words", *names, "__mix")
    run = F.pandas_udf(_members(model, names), "n_words long, " + ", ".join(f"{n} double" for n in names))
    return base.withColumn("__mix", run(F.col(text_col))).select(*[F.col(f"`{c}`") for c in base.columns], "__mix.*")


@dataclass
class Rates:
    """Rates as a projection onto their bounds: of 1 plus the posterior times the sum of all steps.

    ``want`` and ``reached`` are tokens of each domain as shares of all tokens
    at rate 1.  ``converged``: steps went on until every domain was within the
    tolerance or no step could bring them nearer.  ``feasible``: each domain is
    within 1 % of what is wanted; if not, ``reached`` is the nearest, in the
    sense of ``rates``, that bounds and posteriors allow.
    """

    domains: list[str]
    most: float | None
    steps: np.ndarray  # their sum, a number for each domain
    want: np.ndarray | None = None
    reached: np.ndarray | None = None
    converged: bool = True
    feasible: bool = True

    def of(self, p: np.ndarray) -> np.ndarray:
        """The rates of rows of posteriors."""
        return np.clip(1 + p @ self.steps, 0, self.most)

    def free(self) -> Column:
        """Before the projection."""
        return sum((F.col(f"p_{d}") * float(x) for d, x in zip(self.domains, self.steps, strict=True)), F.lit(1.0))

    def column(self) -> Column:
        above = F.greatest(self.free(), F.lit(0.0))
        return above if self.most is None else F.least(above, F.lit(float(self.most)))


def rates(
    rows: DataFrame, targets: dict[str, float], most: float | None = None, size_col: str = "n_words", limit: int = 200, close: float = 1e-3, pull: float = 1e-5
) -> Rates:
    """Rates for ``rows`` (written, with tokens ``size_col`` and posteriors) that bring domains to ``targets``.

    Minimised over rates >= 0 (and <= ``most``, if given): the squared
    difference between expected and wanted tokens of each domain, over the
    tokens it has, plus ``pull`` times the squared distance of rates from 1,
    weighted by tokens.  The total is such that the domain with the largest
    target keeps its size; without tokens at all every rate is 1.

    A step is the gradient, scaled by the second moments of the posteriors
    whose rates are within their bounds, and halved until it brings rates
    nearer to the minimum.  Steps end when every domain is within ``close`` of
    what is wanted, at the minimum, or after ``limit``, which is told.
    """
    names, n = list(targets), len(targets)
    w = np.array(list(targets.values()), float)
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    p, size = [F.col(f"p_{d}") for d in names], F.col(size_col).cast("double")

    def totals(at: Rates) -> tuple[np.ndarray, np.ndarray, float]:
        """Tokens of each domain at these rates, second moments of rows within their bounds, and the sum of what rates are the slope of."""
        free, rate = at.free(), at.column()
        inner = F.when((free > 0) & (F.lit(True) if most is None else free < most), size)
        sums = [F.sum(size * x * rate) for x in p] + [F.sum(inner * p[i] * p[j]) for i, j in pairs]
        got = rows.agg(*sums, F.sum(size * (rate * free - rate * rate / 2))).first()
        got = np.array([float(x or 0) for x in got])
        moments = np.zeros((n, n))
        for (i, j), x in zip(pairs, got[n:], strict=False):
            moments[i, j] = moments[j, i] = x
        return got[:n], moments, got[-1]

    return descend(Rates(names, most, np.zeros(n)), totals, w / w.sum(), limit, close, pull)


def descend(out: Rates, totals, w: np.ndarray, limit: int, close: float, pull: float) -> Rates:
    """Fits ``out`` to shares ``w``, given a function from rates to sums."""
    have, moments, slope_of = totals(out)
    total = have.sum()
    if not total:
        return out
    scale = np.maximum(have / total, 1e-9)
    want = w * have[np.argmax(w)] / total / w.max()
    near = lambda gap, share: bool((np.abs(gap) <= share * np.maximum(want, close * w.max())).all())
    value = lambda at, slope_of: slope_of / total - want @ at + pull / 2 * (scale * at) @ at
    gap, at, now, tried, done = have / total - want, out.steps, value(out.steps, slope_of), 0, False
    while not (done or near(gap, close)) and tried < limit:
        gradient = gap + pull * scale * at
        step = -np.linalg.solve(moments / total + pull * np.diag(scale), gradient)
        while tried < limit:
            tried += 1
            tokens, moments, slope_of = totals(Rates(out.domains, out.most, at + step))
            new = value(at + step, slope_of)
            if new <= now + 1e-4 * (gradient @ step):
                done = now - new <= 1e-12 * max(1.0, abs(now))
                at, now, gap = at + step, new, tokens / total - want
                break
            if -(gradient @ step) <= 1e-12 * max(1.0, abs(now)):
                done = True
                break
            step = step / 2
    return Rates(out.domains, out.most, at, want, gap + want, done or near(gap, close), near(gap, 0.01))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, most: float | None = 1.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` drawn at their rates: floor(rate) times, and once more with the chance of the rest.

    The draw depends on id, text and seed alone, so rows that repeat are drawn
    alike and a task that runs again draws the same.  With ``most`` = 1 no row
    is repeated.  All columns pass unchanged.
    """
    targets = targets or TARGETS
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    names = ["n_words", *[f"p_{d}" for d in targets], "__mix", "__copies", "__rate"]
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c.lower() in {n.lower() for n in names}}
    rows = Scratch(docs.sparkSession, "mixing").write(
        memberships(docs.withColumnsRenamed(own), model, own.get(text_col, text_col), tuple(targets))
    )
    rate = F.col("__rate")
    ident, text = (F.col(f"`{own.get(c, c)}`") for c in (id_col, text_col))
    chance = F.pmod(F.xxhash64(F.lit(seed), ident, text), F.lit(1 << 52)) / float(1 << 52)
    copies = (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("int")
    drawn = rows.withColumn("__rate", rates(rows, targets, most).column()).withColumn("__copies", copies).where("__copies > 0")
    if most is None or most > 1:
        drawn = drawn.withColumn("__copies", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return drawn.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])
