"""A uniform shuffle into shards of exact sizes.

How many rows of each partition go to each block of a shard is a matrix with
the partition sizes as row sums and the block sizes as column sums, drawn as a
uniform permutation of all rows would give it: a multivariate hypergeometric
draw.  Each partition permutes its rows and deals them out by its row of the
matrix; after the exchange each block permutes what it got.  The result is a
uniform permutation, cut into shards.

The matrix is never built.  A node of a binary tree over the partitions splits
the counts of its blocks between its halves, with a random stream of its own,
so each task draws its own row on the way from the root to its leaf and needs
only the partition sizes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import POSITION_BITS, Scratch, without

#: Rows of a block: what one task permutes at a time.
BLOCK_ROWS = 1 << 17
#: numpy draws from populations below this.
_NUMPY_MAX = 10**9


def log_ratio(n: int, d: int) -> float:
    """log((n + d)! / n!), to about 1e-8 also where both factorials' logarithms are near 10^13.

    For large n a difference of Stirling series, term by term.
    """
    m = n + d
    if min(n, m) < 1000 or max(n, m) < 1 << 20:
        return math.lgamma(m + 1) - math.lgamma(n + 1)
    tail = lambda x: 1 / (12 * x) - 1 / (360 * x**3)
    return (m + 0.5) * math.log1p(d / n) + d * (math.log(n) - 1) + tail(m) - tail(n)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` rows drawn from good + bad are good; any population.

    Beyond numpy's range: rejection for log-concave probabilities with a known
    mode, under a flat middle with exponential tails.
    """
    if good + bad < _NUMPY_MAX:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    lg = math.lgamma
    mode = min(high, max(low, (sample + 1) * (good + 1) // (good + bad + 2)))
    at = (mode, good - mode, sample - mode, bad - sample + mode)

    def log_p(k: int) -> float:
        """The logarithm of the probability of ``k`` over that of the mode."""
        d = k - mode
        return -sum(log_ratio(n, x) for n, x in zip(at, (d, -d, -d, d), strict=True))

    total = lg(good + 1) + lg(bad + 1) + lg(sample + 1) + lg(good + bad - sample + 1) - lg(good + bad + 1)
    # Only the proposal depends on this number; a smaller one gives a wider proposal.
    p = math.exp(min(0.0, total - sum(lg(n + 1) for n in at))) * 0.99
    w = 1 + p / 1.98
    while True:
        u, v = rng.random(), rng.random()
        y = v * w / p if u <= w / (1 + w) else (w - math.log(v or 1e-300)) / p
        k = mode + (1 if rng.random() < 0.5 else -1) * round(y)
        if low <= k <= high and math.log(rng.random() or 1e-300) + min(0.0, w - p * y) <= log_p(k):
            return k


def split(rng: np.random.Generator, counts: np.ndarray, sample: int) -> np.ndarray:
    """``sample`` rows drawn without replacement: how many come from each of ``counts``."""
    rest = int(counts.sum())
    if rest < _NUMPY_MAX:
        return rng.multivariate_hypergeometric(counts, sample, method="marginals")
    out = np.zeros_like(counts)
    for i, c in enumerate(counts.tolist()):
        if not sample:
            break
        rest -= c
        out[i] = hypergeometric(rng, c, rest, sample)
        sample -= int(out[i])
    return out


def matrix_row(sizes: np.ndarray, blocks: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row ``part`` of the matrix: how many of its rows go to each block."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    low, high, counts = 0, len(sizes), blocks.astype(np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        left = split(np.random.default_rng([seed, low, high]), counts, int(before[mid] - before[low]))
        low, high, counts = (low, mid, left) if part < mid else (mid, high, counts - left)
    return counts


def shard_blocks(rows: int, shards: int, block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, first slot, size) of each block; shard sizes differ by one at most, block sizes too."""
    out = []
    for s in range(shards):
        n = rows // shards + (s < rows % shards)
        k = max(1, math.ceil(n / block_rows))
        at = 0
        for b in range(k):
            m = n // k + (b < n % k)
            out.append((s, at, m))
            at += m
    return tuple(np.array(out, np.int64).T)


def _dealer(parts: np.ndarray, sizes: np.ndarray, rows: int, shards: int, block_rows: int, seed: int):
    """Gives each row its block, the block's shard and first slot, and a key that permutes the block.

    Tasks form the blocks from their number by themselves.
    """
    layout: list[tuple] = []
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def deal(ids: pd.Series) -> pd.DataFrame:
        if not layout:
            layout.append(shard_blocks(rows, shards, block_rows))
        shard, first, blocks = layout[0]
        ids = ids.to_numpy()
        part, pos = ids >> POSITION_BITS, ids & ((1 << POSITION_BITS) - 1)
        block, key = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64)
        for p in np.unique(part):
            if p not in held:
                held.clear()
                i = int(np.searchsorted(parts, p))
                rng = np.random.default_rng([seed, len(parts), i, 1])
                dealt = np.repeat(np.arange(len(blocks), dtype=np.int32), matrix_row(sizes, blocks, i, seed))
                held[p] = rng.permutation(dealt), rng.integers(0, 1 << 63, len(dealt), dtype=np.int64)
            own = part == p
            block[own], key[own] = (x[pos[own]] for x in held[p])
        return pd.DataFrame({"block": block, "shard": shard[block].astype(np.int32), "first": first[block], "key": key})

    return deal


def uniform_shuffle(rows: DataFrame, shards: int = 40, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... in each shard).

    Shard sizes differ by one at most, the larger ones first; every order of the
    rows is as likely as any other, given the random streams.  Columns named
    shard or slot are replaced; nulls, repeated rows and all other columns pass
    unchanged.  Fewer rows than shards leave the last shards empty; an empty
    table gives an empty result.

    The rows are first written with their partition and position, so that a
    task that is run again deals the same rows the same way.
    """
    scratch = Scratch(rows.sparkSession, "shards")
    rows = without(rows, "shard", "slot", "__row", "__to", "__block")
    rows = scratch.write(rows.withColumn("__row", F.monotonically_increasing_id()))
    found = rows.groupBy(F.shiftright("__row", POSITION_BITS).alias("p")).count().collect()  # a row for each partition
    found = np.array(sorted(tuple(r) for r in found), np.int64).reshape(-1, 2)
    n = int(found[:, 1].sum())
    blocks = sum(max(1, math.ceil((n // shards + (s < n % shards)) / block_rows)) for s in range(shards))
    deal = F.pandas_udf(_dealer(found[:, 0], found[:, 1], n, shards, block_rows, seed), "block int, shard int, first long, key long")
    dealt = rows.withColumn("__to", deal("__row")).withColumn("__block", F.col("__to.block"))
    dealt = dealt.repartitionById(blocks, F.col("__block"))  # one block for each task
    order = Window.partitionBy("__block").orderBy("__to.key", "__row")
    return dealt.withColumns(
        {"shard": F.col("__to.shard"), "slot": (F.col("__to.first") + F.row_number().over(order) - 1).cast("long")}
    ).drop("__row", "__to", "__block")
