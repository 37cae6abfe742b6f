"""Quality by a sparse ensemble of rules over text statistics.

Small trees are grown one on what the others leave over.  The path to each of
their nodes is a rule: a conjunction of bounds on statistics.  A lasso logistic
regression leaves a weight to few of them; these are compiled into one Spark
column.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without
from .labelled import fold, sample
from .statistics import NAMES, statistics

#: Labelled texts that are learned from, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, SHRINK = 40, 3, 32, 0.3
THRESHOLD = 0.3

#: A bound: place of the statistic, whether it must be greater, and than what.
Bound = tuple[int, bool, float]
Rule = tuple[Bound, ...]


@dataclass
class Ensemble:
    bias: float
    rules: list[Rule]
    weights: list[float]

    def column(self, stats: str) -> Column:
        """The score over a struct column of statistics, in built-in expressions only."""

        def holds(rule: Rule) -> Column:
            sides = [F.col(f"{stats}.{NAMES[i]}") > b if more else F.col(f"{stats}.{NAMES[i]}") <= b for i, more, b in rule]
            return reduce(Column.__and__, sides)

        z = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(holds(rule), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def satisfied(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, more, b in rule:
        out &= x[:, i] > b if more else x[:, i] <= b
    return out


def grow(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The rules of boosted trees, each rule once, in the order in which they were found."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    z, found = np.full(len(y), np.log(rate / (1 - rate))), {}

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        top = (1e-6, 0, 0)
        gs, hs = g[rows].sum(), h[rows].sum()
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(binned[rows, j], minlength=len(c) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(nl < 10) | (nl > len(rows) - 10)] = 0
            k = int(np.argmax(gain))
            top = max(top, (float(gain[k]), j, k))
        return top if top[0] > 1e-6 else None

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        nodes = [(np.arange(len(y)), ())]
        for _ in range(DEPTH):
            after = []
            for rows, rule in nodes:
                if len(rows) < 20 or (split := best(rows, g, h)) is None:
                    z[rows] += SHRINK * np.clip(g[rows].sum() / (h[rows].sum() + 1), -4, 4)
                    continue
                _, j, k = split
                right = binned[rows, j] > k
                for more in (False, True):
                    path = (*rule, (j, more, float(cuts[j][k])))
                    found.setdefault(path, None)
                    after.append((rows[right == more], path))
            nodes = after
        for rows, _ in nodes:
            if len(rows):
                z[rows] += SHRINK * np.clip(g[rows].sum() / (h[rows].sum() + 1), -4, 4)
    return list(found)


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Logistic weights with an absolute penalty (none on the bias), by accelerated proximal gradients."""
    n, p = a.shape
    w, bias = np.zeros(p, np.float32), float(np.log(np.clip(y.mean(), 1e-3, 1 - 1e-3) / np.clip(1 - y.mean(), 1e-3, 1)))
    u, ub, t = w.copy(), bias, 1.0
    v = np.random.default_rng(0).normal(size=p).astype(np.float32)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (float(v @ (a.T @ (a @ v))) / n / 4 + 0.3)
    for _ in range(steps):
        g = (1 / (1 + np.exp(-(a @ u + ub))) - y).astype(np.float32)
        new = u - step * (a.T @ g) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = ub - step * float(g.mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, ub = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - bias)
        w, bias, t = new, nb, t2
    return bias, w


def learn(x: np.ndarray, y: np.ndarray, penalty: float = 2e-4) -> Ensemble:
    """An ensemble of the rules that keep a weight; of no rows or one class only its rate."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(float(np.log(rate / (1 - rate))), [], [])
    rules = grow(x, y)
    a = np.stack([satisfied(x, r) for r in rules], 1).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    bias, w = lasso(a, y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-3)
    return Ensemble(bias, [rules[i] for i in kept], [float(w[i]) for i in kept])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Ensemble:
    """Learned from at most ``limit`` labelled texts outside the held-out fold (crc32 of the id modulo 5 is 0)."""
    use = F.coalesce(fold(F.col(id_col), 5) != 0, F.lit(False)) & F.col(label).isNotNull()
    rows = sample(docs, labels, {label: "y"}, limit, use, id_col, text_col)
    rows = rows.select(statistics(F.col("text")).alias("s"), "y", "id").orderBy(F.xxhash64("id"), "id", "s").limit(limit)
    got = rows.select("s.*", "y").toPandas()
    return learn(got[list(NAMES)].to_numpy(float), got["y"].to_numpy(float))


def score(docs: DataFrame, model: Ensemble, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 if score >= threshold).

    A score comes from the whole text alone; null and empty texts have
    statistics of 0.  held_out is false for null ids.  Columns of the three
    names are replaced, others pass unchanged.
    """
    base = without(docs, "held_out", "score", "predicted", "__stats")
    scored = base.withColumn("__stats", statistics(F.col(text_col))).withColumn("score", model.column("__stats"))
    return scored.withColumns(
        {
            "held_out": F.coalesce(fold(F.col(id_col), 5) == 0, F.lit(False)),
            "predicted": (F.col("score") >= threshold).cast("int"),
        }
    ).drop("__stats")
