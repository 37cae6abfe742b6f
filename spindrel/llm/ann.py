"""Nearest neighbours by inner product over additively quantised vectors.

A vector is coded as the sum of one word from each of several full-dimensional
codebooks, fitted one after the other on what the former leave over.  A beam
search keeps the best partial sums.  A query scores a vector by adding up table
entries, one for each codebook, corrected by the stored norms; the best of each
block are then scored exactly on the original vectors, and a task keeps the best
of all blocks that it has read for a block of queries.

Every vector is indexed and every query meets every block of the index; only
the codebooks come from a bounded sample.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, hot_join

#: Codebooks, words in each, sums kept by the beam search.
BOOKS, WORDS, BEAM = 16, 256, 4
#: Vectors on which the codebooks are fitted, at most; steps of k-means for each.
SAMPLE, STEPS = 16384, 6
#: Vectors of a block of the index, rows of a block of queries, rows scored at a time.
INDEX_BLOCK, QUERY_BLOCK, AT_ONCE = 1 << 14, 2048, 128
#: Share of a block that is scored exactly.
RERANK = 1 / 64


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 42) -> np.ndarray:
    """Codebooks (books, words, dimension) by k-means on the residuals of the sample."""
    rng, left = np.random.default_rng(seed), sample.astype(np.float32)
    words = min(words, len(left))
    out = []
    for _ in range(books):
        book = left[rng.choice(len(left), words, replace=False)].copy()
        for _ in range(STEPS):
            of = np.argmin((book**2).sum(1) - 2 * left @ book.T, 1)
            n = np.bincount(of, minlength=words)
            order = np.argsort(of, kind="stable")
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            sums = np.add.reduceat(left[order], np.minimum(starts, len(left) - 1), axis=0)
            book[n > 0] = sums[n > 0] / n[n > 0, None]
        left = left - book[np.argmin((book**2).sum(1) - 2 * left @ book.T, 1)]
        out.append(book)
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (n, books) of the sums nearest to each row that the beam search finds."""
    n, words = len(x), books.shape[1]
    left = x.astype(np.float32)[:, None, :]
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in books:
        cost = (left**2).sum(2)[:, :, None] - 2 * left @ book.T + (book**2).sum(1)
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
        of, word = best // words, best % words
        rows = np.arange(n)[:, None]
        left = left[rows, of] - book[word]
        codes = np.concatenate([codes[rows, of], word[:, :, None].astype(np.uint8)], axis=2)
    return codes[np.arange(n), np.argmin((left**2).sum(2), axis=1)]


def _index(books: np.ndarray, kind: str):
    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                x = np.stack(part["vec"].to_numpy()).astype(np.float64)
                codes = encode(x, books)
                near = np.linalg.norm(books[np.arange(len(books)), codes].sum(1), axis=1)
                yield pd.DataFrame(
                    {
                        "h": part["h"].to_numpy(),
                        "raw": [r.tobytes() for r in x.astype(kind)],
                        "code": [c.tobytes() for c in codes],
                        "norms": [r.tobytes() for r in np.stack([np.linalg.norm(x, axis=1), near], 1)],
                        "ids": [np.asarray(i, "<i8").tobytes() for i in part["ids"]],
                    }
                )

    return run


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of ``q`` with rows of ``x[i]``, summed in the order of the dimensions.

    Equal vectors give equal scores to the last bit, wherever they stand.
    """
    out = np.zeros(x.shape[:2])
    for d in range(q.shape[1]):
        out += q[:, d, None].astype(np.float64) * x[:, :, d]
    return out


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row; of equal ones the first."""
    if scores.shape[1] <= k:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    above = scores > least
    level = scores == least
    level &= np.cumsum(level, axis=1) <= k - above.sum(1, keepdims=True)
    return np.nonzero(above | level)[1].reshape(len(scores), k)


class Best:
    """The best entries that one task has met for a block of queries: scores, smallest ids, and places in ``lists``."""

    def __init__(self, keys: np.ndarray, q: np.ndarray, size: int):
        self.keys, self.q, self.size = keys, q, size
        self.score = np.full((len(q), 0), 0.0)
        self.low, self.place = np.zeros((2, len(q), 0), np.int64)
        self.lists: list[bytes] = [b""]  # of the entries with several ids

    def merge(self, rows: slice, score: np.ndarray, low: np.ndarray, place: np.ndarray, out: tuple) -> None:
        """The best of what is held for some queries and of new entries, into ``out``; of equal scores the smaller id first."""
        score, low, place = (np.concatenate([x[rows], y], 1) for x, y in ((self.score, score), (self.low, low), (self.place, place)))
        order = np.lexsort((low, -score), axis=1)[:, : self.size]
        for to, x in zip(out, (score, low, place), strict=True):
            to[rows] = np.take_along_axis(x, order, 1)

    def found(self) -> pd.DataFrame:
        several = self.place > 0
        n = np.ones(self.place.shape, np.int64)
        n[several] = [len(self.lists[p]) // 8 for p in self.place[several]]
        ids = self.low.ravel()
        if several.any():
            ids = np.concatenate([np.frombuffer(self.lists[p], "<i8") if p else [i] for i, p in zip(ids, self.place.ravel(), strict=True)])
        keys = np.repeat(self.keys, self.place.shape[1])
        return pd.DataFrame({"qk": np.repeat(keys, n.ravel()), "vec_id": ids.astype(np.int64), "score": np.repeat(self.score.ravel(), n.ravel())})


def _search(books: np.ndarray, k: int, rerank: float, kind: str):
    dim = books.shape[2]

    def read(best: Best, row) -> None:
        """Merges the best of one block of the index."""
        x = np.frombuffer(b"".join(row.raw), kind).reshape(-1, dim)
        codes = np.frombuffer(b"".join(row.code), np.uint8).reshape(len(x), -1)
        norms = np.frombuffer(b"".join(row.norms), "<f8").reshape(-1, 2)
        right = (norms[:, 0] / np.where(norms[:, 1] > 0, norms[:, 1], 1)).astype(np.float32)
        low = np.array([int.from_bytes(b[:8], "little", signed=True) for b in row.ids], np.int64)
        place = np.zeros(len(x), np.int64)
        for i, b in enumerate(row.ids):
            if len(b) > 8:
                place[i] = len(best.lists)
                best.lists.append(b)
        order = np.argsort(low, kind="stable")  # of equal scores the smaller id comes first
        x, codes, right, low, place = x[order], np.ascontiguousarray(codes[order].T), right[order], low[order], place[order]
        keep = min(len(x), max(4 * k, math.ceil(rerank * len(x))))
        width = min(best.size, best.score.shape[1] + keep)
        out = tuple(np.zeros((len(best.q), width), t) for t in (np.float64, np.int64, np.int64))
        for at in range(0, len(best.q), AT_ONCE):
            rows = slice(at, at + AT_ONCE)
            part = best.q[rows]
            table = np.einsum("qd,mwd->mqw", part.astype(np.float32), books)
            score = np.zeros((len(part), len(x)), np.float32)
            for m in range(len(books)):
                score += np.take(table[m], codes[m], axis=1)
            near = _top(score * right, keep)
            best.merge(rows, exact(part, x[near]), low[near], place[near], out)
        best.score, best.low, best.place = out

    def run(batches):
        best = block = None
        for pdf in batches:
            for row in pdf.itertuples():
                if best is None or row.block != block:
                    if best is not None:
                        yield best.found()
                    q = np.frombuffer(b"".join(row.q_raw), kind).reshape(-1, dim)
                    best, block = Best(np.array(row.qk, np.int64), q, k + 1), row.block
                read(best, row)
        if best is not None:
            yield best.found()

    return run


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, h): rows with an id and a vector of finite components that are not all zero."""
    vec, d = F.col(vec_col), lambda x: x.cast("double")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(d(x)) < float("inf")))
    ok = rows.where(F.col(id_col).isNotNull() & vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0))
    return ok.select(F.col(id_col).cast("long").alias("id"), F.transform(vec, d).alias("vec")).withColumn("h", F.xxhash64("vec"))


def search(
    rows: DataFrame,
    every: int = 20,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    rerank: float = RERANK,
    seed: int = 42,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` vectors found with the largest inner product.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows with another id.  Scores are exact, in double precision; ties go to
    the smaller id.  Rows with a null id, or with a vector that is null, empty,
    all zero or holds a null or a number that isn't finite, take no part, nor
    do those whose length is not the commonest (of equally common the greater).
    Repeated rows count once; an empty table gives an empty result; other
    columns are not read.

    Equal vectors are one entry of the index, with the k + 1 smallest of their
    ids: no query can return more of them; and they are one question, whose
    k + 1 nearest serve all queries that ask it.  An id that has different
    vectors asks once for each and may get fewer than ``k``.  ``rerank`` is the share of
    each block of the index that is scored exactly.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "ann")
    good = scratch.write(usable(rows, id_col, vec_col).distinct())
    size = good.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = good.where(F.size("vec") == size["d"])
    kind = "<f4" if rows.schema[vec_col].dataType.elementType == T.FloatType() else "<f8"
    sample = good.dropDuplicates(["h"]).orderBy(F.xxhash64("h", F.lit(seed)), "h").limit(SAMPLE).select("vec").toPandas()
    books = fit(np.stack(sample["vec"].to_numpy()), seed=seed)

    copies = Window.partitionBy("h", "vec").orderBy("id")
    entries = (
        good.withColumn("n", F.row_number().over(copies))
        .where(F.col("n") <= k + 1)
        .groupBy("h", "vec")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    index = scratch.write(entries.mapInPandas(_index(books, kind), "h long, raw binary, code binary, norms binary, ids binary"))
    queries = good.where(F.col("id") % every == 0).select("id", F.struct("h", "vec").alias("v"))
    asked = scratch.write(queries.select("v").distinct().withColumn("qk", F.monotonically_increasing_id()))
    n, m = index.count(), asked.count()
    lists = lambda *names: [F.collect_list(c).alias(c) for c in names]
    place = lambda c, rows, per: F.pmod(F.xxhash64(c, F.lit(seed + 1)), F.lit(max(1, math.ceil(rows / per)))).alias("block")
    blocks = index.groupBy(place("h", n, INDEX_BLOCK)).agg(*lists("raw", "code", "norms", "ids")).drop("block")
    raw = F.pandas_udf(lambda v: v.map(lambda a: np.asarray(a, kind).tobytes()), "binary")
    questions = asked.select("qk", raw("v.vec").alias("q_raw")).groupBy(place("qk", m, QUERY_BLOCK)).agg(*lists("qk", "q_raw"))
    blocks, questions = scratch.write(blocks.repartition(max(1, math.ceil(n / INDEX_BLOCK)))), scratch.write(questions)
    # The stated queries against all rows, block by block: a row here is a pair of blocks.
    pairs = questions.hint("shuffle_replicate_nl").crossJoin(blocks)
    found = pairs.mapInPandas(_search(books, k, rerank, kind), "qk long, vec_id long, score double")
    best = Window.partitionBy("qk").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    answers = found.groupBy("qk").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))
    answers = scratch.write(asked.join(answers, "qk").select("v", "near"))
    own = hot_join(queries, answers, "v", scratch, queries.select("v"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k)
    each = own.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
