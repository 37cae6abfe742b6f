"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Each partition (a *sender*) sorts the fingerprints of its texts and sends them,
as Golomb-coded gaps, to the *owners* of ranges of the fingerprint space.  An
owner answers each sender with a bitmap of the fingerprints that another sender
has too.  Only the rows so marked, and those that met a copy in their own
partition, are shuffled; there the normalised texts themselves are compared.
Texts without a copy never leave their partition.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import golomb
from .common import POSITION_BITS, Scratch, hot_join, marked, shuffle_partitions, without

#: Bits of a fingerprint: a text of 10^10 others meets a false partner once in 28,000 times.
FINGERPRINT_BITS = 48
#: Rows whose fingerprints one owner holds at a time, on average.
OWNER_ROWS = 1 << 22
#: The characters that are deleted before texts are compared.
DELETED = " \t\n\x0b\x0c\r"
OUT = ("keep_id", "group_size", "kept", "text_sha256")
_ADDED = T.StructType(
    [
        T.StructField("__row", T.LongType()),
        T.StructField("__len", T.LongType()),
        T.StructField("__sha", T.StringType()),
        T.StructField("__owner", T.IntegerType()),
        T.StructField("__hashes", T.BinaryType()),
        T.StructField("__order", T.BinaryType()),
    ]
)


def owner_base(owner: int, owners: int) -> int:
    """The least fingerprint of an owner's range."""
    return -(-(owner << FINGERPRINT_BITS) // owners)


def _sender(text_at: int, owners: int, large: bool):
    """Adds digest columns to each batch; after the last, a row for each owner."""
    added = _ADDED.names
    binary = pa.large_binary() if large else pa.binary()
    kinds = [pa.int64(), pa.int64(), pa.large_string() if large else pa.string(), pa.int32(), binary, binary]

    def run(batches):
        part, seen, prints, types = TaskContext.get().partitionId(), 0, [], None
        for batch in batches:
            types = types or pa.schema([f.with_nullable(True) for f in batch.schema] + [pa.field(n, k) for n, k in zip(added, kinds, strict=True)])
            lengths, digests, fps = [], [], []
            for text in batch.column(text_at).to_pylist():
                text = text or ""
                digest = hashlib.sha256(text.encode("utf-8", "replace").translate(None, DELETED.encode()))
                lengths.append(len(text))
                digests.append(digest.hexdigest())
                fps.append(int.from_bytes(digest.digest()[:8], "big") >> (64 - FINGERPRINT_BITS))
            n = len(lengths)
            rows = np.arange(seen, seen + n, dtype=np.int64) + (part << POSITION_BITS)
            seen += n
            prints.append(np.array(fps, np.uint64))
            cols = [pa.array(rows), pa.array(lengths, pa.int64()), pa.array(digests, kinds[2])]
            cols += [pa.nulls(n, k) for k in kinds[3:]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], schema=types)
        if not seen:
            return
        fps = np.concatenate(prints)
        order = np.argsort(fps, kind="stable").astype(np.uint32)
        values, starts, counts = np.unique(fps[order], return_index=True, return_counts=True)
        cuts = np.searchsorted(values, np.array([owner_base(o, owners) for o in range(owners + 1)], np.uint64))
        at = np.append(starts, seen)
        out = {n: [] for n in added}
        for o in np.flatnonzero(np.diff(cuts)):
            lo, hi = cuts[o], cuts[o + 1]
            out["__row"].append(part << POSITION_BITS)
            out["__len"].append(None)
            out["__sha"].append(None)
            out["__owner"].append(int(o))
            out["__hashes"].append(golomb.encode(values[lo:hi], owner_base(int(o), owners)))
            out["__order"].append(counts[lo:hi].astype("<u4").tobytes() + order[at[lo] : at[hi]].astype("<u4").tobytes())
        n = len(out["__owner"])
        cols = [pa.nulls(n, t) for t in types.types[: -len(added)]]
        cols += [pa.array(out[name], k) for name, k in zip(added, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(cols, schema=types)

    return run


def _own(owners: int):
    def run(messages: pd.DataFrame) -> pd.DataFrame:
        base = owner_base(int(messages["__owner"].iloc[0]), owners)
        lists = [golomb.decode(b, base) for b in messages["__hashes"]]
        values, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        found, at, bitmaps = counts[inverse] > 1, 0, []
        for x in lists:
            bitmaps.append(np.packbits(found[at : at + len(x)]).tobytes())
            at += len(x)
        return pd.DataFrame({"part": messages["part"], "owner": messages["__owner"], "bitmap": bitmaps})

    return run


def _suspects(messages: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The marks of one sender's rows."""
    bitmap = dict(zip(answers["owner"], answers["bitmap"], strict=True))
    rows = [np.zeros(0, np.uint32)]
    for owner, blob, hashes in zip(messages["__owner"], messages["__order"], messages["__hashes"], strict=True):
        n = golomb.HEADER.unpack_from(hashes)[0]
        counts = np.frombuffer(blob, "<u4", n)
        far = np.unpackbits(np.frombuffer(bitmap[owner], np.uint8))[:n].astype(bool)
        rows.append(np.frombuffer(blob, "<u4", -1, 4 * n)[np.repeat(far | (counts > 1), counts)])
    rows = np.sort(np.concatenate(rows)).astype(np.int64)
    if not len(messages) or not len(rows):
        return pd.DataFrame({"part": [], "word": [], "bits": []}).astype("int64")
    words, starts = np.unique(rows >> 6, return_index=True)
    bits = np.bitwise_or.reduceat(np.uint64(1) << (rows & 63).astype(np.uint64), starts)
    return pd.DataFrame({"part": np.int64(messages["part"].iloc[0]), "word": words, "bits": bits.view(np.int64)})


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", owners: int | None = None) -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256.

    Texts are equal if they are identical after deleting space, tab, line feed,
    vertical tab, form feed and carriage return; null counts as empty.  Of
    equal texts the row with the most code points stays, then the smallest
    id (null ids last), then the first row as read, so exactly one row of each
    group is kept even if whole rows repeat.  keep_id is the id of that row and
    may be null if its id is.  An empty table gives an empty result.  Columns of
    ``docs`` named as one of the four results are replaced; others pass
    unchanged.

    ``owners``: ranges of the fingerprint space, by default as many as shuffle
    partitions and one for OWNER_ROWS rows at least.  A fingerprint is sent once by each partition, so a text that
    fills a third of all rows gives an owner one entry for each partition.
    """
    spark = docs.sparkSession
    owners = owners or max(shuffle_partitions(spark), -(-docs.count() // OWNER_ROWS))
    scratch = Scratch(spark, "exact")
    docs = without(docs, *OUT, *_ADDED.names)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema] + list(_ADDED))
    large = spark.conf.get("spark.sql.execution.arrow.useLargeVarTypes", "false").lower() == "true"
    staged = scratch.write(docs.mapInArrow(_sender(docs.columns.index(text_col), owners, large), schema))

    rows = staged.where(F.col("__owner").isNull()).drop("__owner", "__hashes", "__order")
    messages = staged.where(F.col("__owner").isNotNull()).select(
        F.shiftright("__row", POSITION_BITS).alias("part"), "__owner", "__hashes", "__order"
    )
    answers = (
        messages.select("part", "__owner", "__hashes")
        .groupBy("__owner")
        .applyInPandas(_own(owners), "part long, owner int, bitmap binary")
    )
    marks = scratch.write(
        messages.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(_suspects, "part long, word long, bits long")
    )

    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), DELETED, "")
    best = F.min(F.struct((-F.col("__len")).alias("n"), F.col(id_col).isNull().alias("x"), F.col(id_col).alias("i"), F.col("__row").alias("r")))
    suspects = marked(rows, "__row", marks, keep=True)
    groups = (
        suspects.groupBy(text.alias("__text"))
        .agg(F.count("*").alias("group_size"), best.alias("b"), F.min("__sha").alias("__sha"))
        .groupBy("__sha")
        .agg(F.first("group_size").alias("group_size"), F.first("b").alias("b"), F.count("*").alias("n"))
        .select(
            "__sha",
            F.when(F.col("n") > 1, F.raise_error(F.lit("two texts have one SHA-256"))).otherwise(F.col("group_size")).alias("group_size"),
            F.col("b.i").alias("keep_id"),
            F.col("b.r").alias("__kept"),
        )
    )
    sizes = suspects.select("__sha")
    of_groups = hot_join(suspects, scratch.write(groups), "__sha", scratch, sizes).withColumn("kept", F.col("__row") == F.col("__kept"))
    alone = marked(rows, "__row", marks, keep=False).select(
        "*", F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    cols = [F.col(f"`{c}`") for c in docs.columns]
    pick = lambda df: df.select(*cols, "keep_id", "group_size", "kept", F.col("__sha").alias("text_sha256"))
    return pick(alone).unionByName(pick(of_groups))
