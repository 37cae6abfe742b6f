"""SimHash near-duplicates under a bound on resemblance: the share of common runs of five words, at least 0.8.

A node is a distinct set of runs.  The covering hashes of the SimHash operator
give the first candidates: fingerprints over the same runs that differ in 3
bits at most.  Pairs at 0.8 differ in about ten of the 64 bits, and covering
masks for so many would be 2^11 tables, so the pairs beyond that radius come
from MinHash values: nodes that share one of ``BANDS`` keys of ``ROWS`` values.
A pair is linked only if the exact Jaccard similarity of its sets reaches the
bound.  A pair at 0.8 shares no key with probability (1 - 0.8^6)^50, about
2.5e-7; a closer pair less often.

Only keys that nodes share are kept.  After the fingerprints, two rounds compare
one node of each bucket with the others.  Then the members of buckets that still
hold several classes meet in tasks, block by block, and all of different classes
are compared there, so no candidate is left out; only pairs near the bound come
out of the task, to be checked on whole hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back, hot_join, marked, row_marks, without
from .components import components
from .simhash import _LOWER, BITS, SHINGLES_AT_ONCE, forest

SHINGLE, BANDS, ROWS = 5, 50, 6
#: Members of a bucket that meet in a task, at most twice as many.
BLOCK = 2048
#: Least similarity, as a fraction.
LEAST = (4, 5)
RUNS_AT_ONCE = 1 << 10
_DRAWN = np.random.default_rng(42).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint32)
_TIMES, _WITH = (_DRAWN[0] | np.uint32(1))[:, None], _DRAWN[1][:, None]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(text: str | None) -> np.ndarray:
    """The distinct runs of five words of a whole text as sorted 64-bit hashes.

    Words are those of the SimHash fingerprint; fewer than five are one run,
    and no word at all gives none.
    """
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mixed(out * _STEP + each[i : len(each) - size + 1 + i])
    return np.unique(out)


def keys(x: np.ndarray) -> np.ndarray:
    """The bands' keys of a set of runs; an empty set has none."""
    if not len(x):
        return np.zeros(0, np.int64)
    x = x.astype(np.uint32)  # the lower halves give candidates only
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), RUNS_AT_ONCE):
        part = x[None, at : at + RUNS_AT_ONCE] ^ _WITH
        part *= _TIMES
        least = np.minimum(least, part.min(axis=1))
    least = least.astype(np.uint64)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = _mixed(out * _STEP + column)
    return out.view(np.int64)


def print_of(x: np.ndarray) -> int:
    """The SimHash fingerprint of a set of runs, signed: a bit is set if it is in over half of them."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(x), SHINGLES_AT_ONCE):
        votes += np.unpackbits(x[at : at + SHINGLES_AT_ONCE].view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(x)).tobytes(), "big", signed=True)


def _sketch(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        x = runs(t)
        node = xxhash.xxh64_intdigest(x.tobytes(), 42) if len(x) else 0
        rows.append((node - (node >> 63 << 64), print_of(x), len(x), keys(x)))
    return pd.DataFrame(rows, columns=["node", "fp", "n", "keys"])


def _sets(texts: pd.Series) -> pd.Series:
    return pd.Series([runs(t).view(np.int64) for t in texts], dtype=object)


def similar(x: Column, y: Column) -> Column:
    """Whether two sets of runs reach the bound, in whole numbers."""
    common = F.size(F.array_intersect(x, y))
    return common * LEAST[1] >= LEAST[0] * (F.size(x) + F.size(y) - common)


def _sizes(a: Column, b: Column) -> Column:
    """Sets of these sizes can reach the bound."""
    return F.least(a, b) * LEAST[1] >= F.greatest(a, b) * LEAST[0]


def _stars(members: DataFrame, first) -> DataFrame:
    """Pairs of one node of each bucket with those of other classes."""
    lead = first(F.struct("c", "x", "n")).over(Window.partitionBy("k"))
    rows = members.withColumn("lead", lead).where((F.col("c") != F.col("lead.c")) & _sizes(F.col("n"), F.col("lead.n")))
    return rows.select(F.col("lead.x").alias("u"), F.col("x").alias("v"))


def _short(texts: pd.Series) -> pd.Series:
    """The lower halves of the hashes of each set, each once."""
    return pd.Series([np.unique(runs(t).astype("<u4")).tobytes() for t in texts], dtype=object)


def near_pairs(own: np.ndarray, c: np.ndarray, sets: list[np.ndarray], within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of sets (32-bit, each number once) of different classes that may reach the bound.

    ``within``: pairs of one block, else only those between two (``own``).
    Halves of hashes can only be equal more often than wholes, which makes sets
    smaller; the slack allows for several times as often as that is expected.
    """
    sizes = np.array([len(x) for x in sets])
    words, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    kinds, of, many = np.unique(c, return_inverse=True, return_counts=True)
    largest = kinds[np.argmax(many)]
    place, u, v = np.arange(len(sets)), [], []
    held = np.zeros(len(words), bool)
    for i in np.flatnonzero(c != largest):
        mine = inverse[starts[i] : starts[i + 1]]
        held[mine] = True
        common = np.add.reduceat(held[inverse], starts[:-1], dtype=np.int64)
        held[mine] = False
        slack = 9 * (2 + np.maximum(sizes, sizes[i]).astype(float) ** 2 / 2**31)
        near = common * LEAST[1] + slack >= LEAST[0] * (sizes + sizes[i] - common)
        near &= (c != c[i]) & ((c == largest) | (place > i)) & (True if within else own != own[i])
        u.append(np.full(near.sum(), i))
        v.append(np.flatnonzero(near))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (u, v))


def _compare(batches):
    """Reads members sorted by bucket and blocks; gives only the pairs that may reach the bound."""
    held, key = [], None

    def done():
        rows = pd.concat(held, ignore_index=True)
        sets = [np.frombuffer(b, "<u4") for b in rows["set"]]
        u, v = near_pairs(rows["own"].to_numpy(), rows["c"].to_numpy(), sets, key[1] == key[2])
        x = rows["x"].to_numpy()
        return pd.DataFrame({"u": x[u], "v": x[v]})

    for pdf in batches:
        keys = pdf[["k", "lo", "hi"]].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(pdf)], strict=True):
            if a == b:
                continue
            if held and tuple(keys[a]) != key:
                yield done()
                held = []
            key = tuple(keys[a])
            held.append(pdf.iloc[a:b])
    if held:
        yield done()
    held.clear()
    give_back()


def _rest(members: DataFrame, rows: DataFrame, nodes: DataFrame, text_col: str, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Pairs of different classes that share a bucket and may reach the bound.

    The members of a bucket meet in a task, which compares them and gives only
    the pairs that come near; a bucket of over ``block`` members is cut into
    blocks, and a task gets two of them.
    """
    parted = members.groupBy("k").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("m")).where("least <> most")
    left = scratch.write(members.join(parted.select(F.col("k").alias("__k"), "m"), F.col("k") == F.col("__k")).select("k", "x", "c", "m"))
    marks = nodes.join(left.select(F.col("x").alias("u")).distinct(), F.col("node") == F.col("u"), "left_semi").select(F.col("row").alias("__row"))
    texts = marked(rows, "__row", scratch.write(row_marks(marks, "__row")), keep=True)
    sets = texts.select(F.col("__sketch.node").alias("x"), F.pandas_udf(_short, "binary")(F.col(f"`{text_col}`")).alias("set"))
    blocks = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("x"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("lo"), F.greatest(j, F.col("own")).alias("hi")))
    each = left.withColumn("own", own).withColumn("p", F.explode(pairs)).select("k", "p.lo", "p.hi", "own", "c", "x").join(sets, "x")
    return each.repartition("k", "lo", "hi").sortWithinPartitions("k", "lo", "hi").mapInPandas(_compare, "u long, v long")


def _by_fingerprint(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs that the covering hashes find: one node of each fingerprint with the others of it and with that of a near one."""
    of_print = scratch.write(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("least"), F.count("*").alias("many")))
    near = forest(of_print.select("fp"), scratch)
    a, b = (of_print.select(F.col("fp").alias(x), F.col("least").alias(f"l{x}")) for x in "ab")
    far = near.join(a, "a").join(b, "b").where(_sizes(F.col("la.n"), F.col("lb.n")))
    shared = of_print.where("many > 1").select(F.col("fp").alias("f"), "least")
    same = nodes.join(shared, F.col("fp") == F.col("f")).where((F.col("node") != F.col("least.node")) & _sizes(F.col("n"), F.col("least.n")))
    return far.select(F.col("la.node").alias("u"), F.col("lb.node").alias("v")).unionByName(
        same.select(F.col("least.node").alias("u"), F.col("node").alias("v"))
    )


def _linked(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, text_col: str, scratch: Scratch) -> DataFrame:
    """Those of the written ``pairs`` (a, b) that reach the bound; texts of their nodes are read where they stand."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("u")).distinct()
    marks = scratch.write(row_marks(nodes.join(used, F.col("node") == F.col("u"), "left_semi").select(F.col("row").alias("__row")), "__row"))
    texts = marked(rows, "__row", marks, keep=True)
    sets = texts.select(F.col("__sketch.node").alias("u"), F.pandas_udf(_sets, "array<long>")(F.col(f"`{text_col}`")).alias("set"))
    sets = scratch.write(sets)
    with_b = hot_join(pairs, sets.select(F.col("u").alias("b"), F.col("set").alias("right")), "b", scratch)
    both = hot_join(with_b, sets.select(F.col("u").alias("a"), F.col("set").alias("left")), "a", scratch, pairs)
    out = scratch.write(both.where(similar(F.col("left"), F.col("right"))).select("a", "b"))
    scratch.drop(sets)
    scratch.drop(marks)
    return out


def classes(rows: DataFrame, scratch: Scratch, text_col: str) -> DataFrame:
    """(node, root) of each node with a link, over written ``rows`` with ``__row`` and ``__sketch``."""
    first = rows.groupBy(F.col("__sketch.node").alias("node")).agg(F.min("__row").alias("__row"))
    marks = scratch.write(row_marks(first, "__row"))
    # One row of each node, found without a shuffle of keys.
    nodes = marked(rows, "__row", marks, keep=True).select("__sketch.*", F.col("__row").alias("row"))
    each = nodes.select(F.explode("keys").alias("k"), F.col("node").alias("x"), "n")
    shared = each.withColumn("many", F.count("*").over(Window.partitionBy("k"))).where("many > 1").drop("many")
    shared, nodes = scratch.write(shared), scratch.write(nodes.select("node", "row", "n", "fp"))
    seen = edges = stars = None
    for step in range(4):
        members = shared.withColumn("c", F.col("x"))
        if stars is not None:
            members = shared.join(stars, F.col("x") == F.col("node"), "left").select("k", "x", "n", F.coalesce("root", "x").alias("c"))
        if step == 0:
            found = _by_fingerprint(nodes, scratch)
        elif step < 3:
            found = _stars(members, (F.min, F.max)[step - 1])
        else:
            found = scratch.write(_rest(members, rows, nodes, text_col, scratch))
        pairs = found.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = scratch.write(pairs)
        if pairs.isEmpty():
            continue
        new = _linked(pairs, rows, nodes, text_col, scratch)
        seen = pairs if seen is None else seen.unionByName(pairs)
        edges = new if edges is None else edges.unionByName(new)
        if stars is None or not new.isEmpty():
            stars = components(edges, scratch)
    scratch.drop(shared)
    return stars if stars is not None else nodes.select("node", F.col("node").alias("root")).limit(0)


def near_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class (pairs of a
    similarity of at least 0.8, and what they connect) the row of the smallest
    id stays; null ids last; of repeated ids the first row as read.

    Columns pass unchanged.  Texts without a word are one class.
    """
    scratch = Scratch(docs.sparkSession, "resemblance")
    sketch = F.pandas_udf(_sketch, "node long, fp long, n long, keys array<long>")
    rows = without(docs, "__sketch", "__row").withColumn("__sketch", sketch(F.col(f"`{text_col}`")))
    rows = scratch.write(rows.withColumn("__row", F.monotonically_increasing_id()))
    found = classes(rows, scratch, text_col).select(F.col("node").alias("__n"), "root")
    first = F.min(F.struct(F.col(id_col).isNull().alias("x"), F.col(id_col).alias("i"), F.col("__row").alias("r")))
    of_node = rows.groupBy(F.col("__sketch.node").alias("node")).agg(first.alias("b"))
    rooted = of_node.join(found, F.col("node") == F.col("__n"), "left").select(F.coalesce("root", "node").alias("root"), "b")
    kept = rooted.groupBy("root").agg(F.min("b").alias("b")).select(F.col("b.r").alias("__row"))
    return marked(rows, "__row", scratch.write(row_marks(kept, "__row")), keep=True).drop("__sketch", "__row")
