"""Toxicity by a factorization machine over hashed terms.

Terms are words and their beginnings, hashed to buckets, with the number of
words that share them, and the size of the text.  Besides a weight, each chosen
term has a vector; the inner product of two vectors is the weight
of both terms standing in one text, such as an insult and the name of a group,
which weights that only add up can't tell from either alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, without
from .labelled import chosen_terms, finder, fold, places, sample

#: Labelled texts that are learned from, at most; terms that are chosen; length of their vectors.
SAMPLE, TERMS, RANK = 20_000, 2048, 8
THRESHOLD = 0.7


@dataclass
class Machine:
    chosen: np.ndarray  # terms, ascending
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logit(self, places: np.ndarray) -> float:
        v = self.vectors[places]
        total = v.sum(0)
        return float(self.bias + self.weights[places].sum() + (total @ total - (v * v).sum()) / 2)


def train(lists: list[np.ndarray], y: np.ndarray, chosen: np.ndarray, rank: int = RANK, epochs: int = 12, seed: int = 42) -> Machine:
    """Logistic loss with a quadratic penalty, by AdaGrad over small batches."""
    rng, p = np.random.default_rng(seed), len(chosen)
    w, v, bias = np.zeros(p), rng.normal(0, 0.02, (p, rank)), 0.0
    gw, gv, gb, step, penalty = np.full(p, 1e-6), np.full((p, rank), 1e-6), 1e-6, 0.1, 2e-4
    n = np.array([len(x) for x in lists], np.int64)
    for _ in range(epochs):
        order = rng.permutation(len(lists))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            size = n[rows]
            idx = np.concatenate([lists[r] for r in rows]) if size.sum() else np.zeros(0, np.int64)
            of = np.repeat(np.arange(len(rows)), size)
            vi = v[idx]
            total = np.zeros((len(rows), rank))
            np.add.at(total, of, vi)
            z = bias + np.bincount(of, w[idx], len(rows)) + ((total**2).sum(1) - np.bincount(of, (vi**2).sum(1), len(rows))) / 2
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            dw, dv = np.zeros(p), np.zeros((p, rank))
            np.add.at(dw, idx, g[of])
            np.add.at(dv, idx, g[of, None] * (total[of] - vi))
            used = np.unique(idx)
            dw[used] += penalty * w[used]
            dv[used] += penalty * v[used]
            gw += dw**2
            gv += dv**2
            gb += g.sum() ** 2
            w -= step * dw / np.sqrt(gw)
            v -= step * dv / np.sqrt(gv)
            bias -= step * g.sum() / np.sqrt(gb)
    return Machine(chosen, bias, w, v)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """A machine learned from at most ``limit`` labelled texts outside the held-out fold (crc32 of the id modulo 3 is 1)."""
    use = F.coalesce(fold(F.col(id_col), 3) != 1, F.lit(False)) & F.col(label).isNotNull()
    rows = Scratch(docs.sparkSession, "toxicity").write(sample(docs, labels, {label: "y"}, limit, use, id_col, text_col))
    chosen = chosen_terms(rows, ["y"], TERMS)
    got = rows.select(F.pandas_udf(places(chosen), "array<int>")("text").alias("x"), "y", "id").orderBy(F.xxhash64("id"), "id").limit(limit).toPandas()
    return train([np.asarray(x, np.int64) for x in got["x"]], got["y"].to_numpy(float), chosen)


def scores(machine: Machine):
    def run(texts: pd.Series) -> pd.Series:
        find = finder(machine.chosen)
        z = np.array([machine.logit(find(t)) for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return run


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 if score >= threshold).

    A score comes from the whole text alone; null and empty texts get that of
    no term.  held_out is false for null ids.  Columns of the three names are
    replaced, others pass unchanged; repeated rows get equal scores.
    """
    base = without(docs, "held_out", "score", "predicted")
    scored = base.withColumn("score", F.pandas_udf(scores(machine), "double")(F.col(text_col)))
    return scored.withColumns(
        {
            "held_out": F.coalesce(fold(F.col(id_col), 3) == 1, F.lit(False)),
            "predicted": (F.col("score") >= threshold).cast("int"),
        }
    )
