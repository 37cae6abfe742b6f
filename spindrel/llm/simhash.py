"""Near-duplicates by SimHash and covering locality-sensitive hashing.

Fingerprints have 64 bits.  For radius r every bit gets a non-zero vector of
r + 1 bits; for each of the 2^(r+1) - 1 non-zero vectors v, table v keeps the
bits whose vectors have an odd inner product with v.  The vectors of r
differing bits span at most r dimensions, so some v is orthogonal to them all:
in that table the pair is equal.  No pair within the radius is missed, and each
table keeps about half of the bits.

Equal fingerprints are one node from the start.  Each bucket of a table gives
the edges of a spanning forest, never all of its pairs.  In a larger bucket
links are found over shared keys: fingerprints within 2 bits share a key with
one bit flipped, those within 3 have a key with one bit flipped and one with
two in common.  Buckets of over ``BUCKET`` fingerprints are dealt out anew by
covering masks of the bits that are still free, which leaves at most 16 free.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_join, marked, row_marks, without
from .components import components

RADIUS, BITS = 3, 64
#: Up to PAIRS fingerprints of a bucket are compared by pairs in one step; over BUCKET go to finer masks.
PAIRS, BUCKET = 1024, 16384
SHINGLES_AT_ONCE = 1 << 16
#: A-Z and the six characters between words, as bytes.
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACES = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text: 64 bits as an unsigned integer.

    A-Z are lower-cased; words are runs without space and \\t\\n\\v\\f\\r; each
    run of ``shingle`` words, repeats included, counts once.  Fewer words are
    one shingle; no word at all (null, empty or blank) gives 0.
    """
    data = (text or "").encode("utf-8", "replace").translate(_LOWER)
    words = data.split()  # bytes split at just these six characters
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    data = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest, votes, total = xxhash.xxh64_digest, np.zeros(BITS, np.int64), len(starts)
    for at in range(0, total, SHINGLES_AT_ONCE):
        to = at + SHINGLES_AT_ONCE
        hashes = b"".join([digest(data[a:b], 42) for a, b in zip(starts[at:to], ends[at:to], strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, BITS)
        for part in range(0, len(bits), 255):  # sums of 255 bits fit into a byte
            votes += np.add.reduce(bits[part : part + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(votes * 2 > total).tobytes(), "big")


def masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """The covering masks of the given bit positions."""
    vectors = range(1, 1 << (radius + 1))
    of = {bit: vectors[i % len(vectors)] for i, bit in enumerate(bits)}
    return [sum(1 << b for b, x in of.items() if (x & v).bit_count() & 1) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


MASKS = masks([b * 37 % BITS for b in range(BITS)])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position that each of n can reach over the edges (a, b)."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == old).all():
            return root


def _by_pairs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= RADIUS, 1))


def _by_keys(x: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all pairs within 3 bits, in steps linear in len(x)."""
    n, flips = len(x), [np.uint64(1 << b) for b in range(BITS) if free >> b & 1]
    near = np.concatenate([x] + [x ^ f for f in flips])
    who = np.tile(np.arange(n), len(flips) + 1)
    order = np.argsort(near, kind="stable")
    near, who = near[order], who[order]
    same = np.flatnonzero(near[1:] == near[:-1])
    a, b = [who[same]], [who[same + 1]]
    keys, first = np.unique(near, return_index=True)
    for i, f in enumerate(flips):
        for g in flips[i + 1 :]:
            far = x ^ (f | g)
            at = np.minimum(np.searchsorted(keys, far), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == far)
            a.append(hit)
            b.append(who[first[at[hit]]])
    return np.concatenate(a), np.concatenate(b)


def bucket_forest(x: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of distinct fingerprints that differ in ``free`` bits only."""
    a, b = _by_pairs(x) if len(x) <= PAIRS else _by_keys(x, free)
    root = _roots(len(x), a, b)
    child = np.flatnonzero(root != np.arange(len(x)))
    return x[child], x[root[child]]


def _edges(deep: bool, most: int = BUCKET):
    """Reads buckets sorted by key; gives forest edges, and the rows of too large buckets with b null."""

    def bucket(table: int, x: np.ndarray):
        fixed = MASKS[table & 15] if not deep else MASKS[table >> 4] | _second(table >> 4)[table & 15]
        return bucket_forest(x, ~fixed & (1 << BITS) - 1)

    def run(batches):
        held_t = held_k = np.zeros(0, np.int64)
        held_x, over = np.zeros(0, np.uint64), None  # over: the bucket that is being handed on

        def done(t, k, x):
            nonlocal over
            a, b, left, tables = [], [], [], []
            if over is not None and len(t):
                n = int(np.searchsorted((t != over[0]) | (k != over[1]), True))
                left.append(x[:n])
                tables.append(t[:n])
                if n < len(t):
                    over = None
                t, k, x = t[n:], k[n:], x[n:]
            if len(t):
                cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
                starts, sizes = np.r_[0, cut], np.diff(np.r_[0, cut, len(t)])
                pairs = starts[sizes == 2]
                pairs = pairs[np.bitwise_count(x[pairs] ^ x[pairs + 1]) <= RADIUS]
                a.append(x[pairs])
                b.append(x[pairs + 1])
                for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                    if n > most and not deep:
                        left.append(x[s : s + n])
                        tables.append(t[s : s + n])
                        continue
                    u, v = bucket(int(t[s]), x[s : s + n])
                    a.append(u)
                    b.append(v)
            a, b, left = (np.concatenate([np.zeros(0, np.uint64), *p]) for p in (a, b, left))
            m = len(left)
            tables = np.concatenate([np.zeros(0, np.int64), *tables])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[a, left].view(np.int64)),
                    pa.array(np.r_[b, left].view(np.int64), mask=np.r_[np.zeros(len(a), bool), np.ones(m, bool)]),
                    pa.array(np.r_[np.zeros(len(a), np.int64), tables]),
                ],
                ["a", "b", "t"],
            )

        for batch in batches:
            t, k, x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            t, k, x = np.r_[held_t, t], np.r_[held_k, k], np.r_[held_x, x.view(np.uint64)]
            if not len(t):
                continue
            last = len(t) - int(np.searchsorted(((t != t[-1]) | (k != k[-1]))[::-1], True))
            if over is None and len(t) - last > most and not deep:
                yield done(t[:last], k[:last], x[:last])
                over = (t[-1], k[-1])
                t, k, x, last = t[last:], k[last:], x[last:], len(t) - last
            elif over is not None and (t[-1], k[-1]) == over:
                last = len(t)
            yield done(t[:last], k[:last], x[:last])
            held_t, held_k, held_x = t[last:], k[last:], x[last:]
        if len(held_t):
            yield done(held_t, held_k, held_x)

    return run


def _second(table: int) -> list[int]:
    """Covering masks of the bits that a table leaves free."""
    return masks([b for b in range(BITS) if not MASKS[table] >> b & 1])


def _buckets(rows: DataFrame, deep: bool, most: int) -> DataFrame:
    out = rows.repartition("t", "k").sortWithinPartitions("t", "k", "x").select("t", "k", "x")
    return out.mapInArrow(_edges(deep, most), "a long, b long, t long")


def forest(fps: DataFrame, scratch: Scratch, most: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints ``fp`` as all links within the radius do; buckets of over ``most`` go to finer masks."""
    key = lambda m: F.col("fp").bitwiseAND(F.lit(_signed(m)))
    tables = F.array(*[F.struct(F.lit(i).cast("long").alias("t"), key(m).alias("k")) for i, m in enumerate(MASKS)])
    rows = fps.select(F.explode(tables).alias("s"), F.col("fp").alias("x")).select("s.t", "s.k", "x")
    found = scratch.write(_buckets(rows, False, most))
    large = found.where("b is null")
    if large.isEmpty():
        return found.select("a", "b")
    each = [
        F.when(
            F.col("t") == i,
            F.array(*[
                F.struct(F.lit(i * 16 + j).cast("long").alias("t"), F.col("a").bitwiseAND(F.lit(_signed(m | n))).alias("k"))
                for j, n in enumerate(_second(i))
            ]),
        )
        for i, m in enumerate(MASKS)
    ]
    rows = large.select(F.explode(F.coalesce(*each)).alias("s"), F.col("a").alias("x")).select("s.t", "s.k", "x")
    more = scratch.write(_buckets(rows, True, most))
    return found.where("b is not null").select("a", "b").unionByName(more.select("a", "b"))


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([_signed(fingerprint(t)) for t in texts], dtype="int64")


def with_fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("__fp", F.pandas_udf(_fingerprints, "long")(F.col(text_col)))


def classes(rows: DataFrame, scratch: Scratch, id_col: str = "doc_id") -> DataFrame:
    """(fp, root, component_id) of each distinct ``__fp`` in written ``rows``."""
    fps = scratch.write(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min(id_col).alias("low")))
    stars = components(forest(fps, scratch), scratch)
    rooted = fps.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.write(rooted)
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    out = rooted.select("fp", F.col("root").alias("r")).join(least, F.col("r") == F.col("root"))
    return scratch.write(out.select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fingerprint, component_id) of each row of ``docs``.

    fingerprint: 16 hexadecimal digits.  component_id: the smallest id that is
    reached over links of at most 3 differing bits; it is null only if all ids
    of a class are.  Null, empty and blank
    texts have fingerprint 0 and are linked like any other.  Repeated rows are
    repeated in the result; an empty table gives an empty one.  Other columns
    are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    narrow = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))
    rows = scratch.write(with_fingerprint(narrow, "__text").drop("__text"))
    found = classes(rows, scratch, id_col)
    named = found.select(F.col("fp").alias("__fp"), F.col("component_id").alias("__component"))
    joined = hot_join(rows, named, "__fp", scratch)
    return joined.select(id_col, F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.col("__component").alias("component_id"))


def near_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row of the
    smallest id stays (null ids last; of repeated ids the first row as read).

    Columns pass unchanged, whatever their names.  Rows of a class are told
    apart over ids and row numbers alone; texts are not shuffled.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = without(docs, "__fp", "__row")
    rows = scratch.write(with_fingerprint(rows, text_col).withColumn("__row", F.monotonically_increasing_id()))
    narrow = rows.select("__fp", "__row", F.col(id_col).alias("__id"))
    found = classes(narrow, scratch, "__id")
    first = F.min(F.struct(F.col("__id").isNull().alias("x"), F.col("__id").alias("i"), F.col("__row").alias("r")))
    of_fp = narrow.groupBy("__fp").agg(first.alias("b"))  # copies are one row before the join
    kept = of_fp.join(found, F.col("__fp") == F.col("fp")).groupBy("root").agg(F.min("b").alias("b"))
    kept = kept.select(F.col("b.r").alias("__row"))
    return marked(rows, "__row", scratch.write(row_marks(kept, "__row")), keep=True).drop("__fp", "__row")
