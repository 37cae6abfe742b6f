"""What the operators share: the shared folder, row marks and column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of row marks that one broadcast may hold, and bytes that one mark takes.
MARKS_BYTES = 64 << 20
MARK_BYTES = 40
#: A row id from monotonically_increasing_id: partition above, position below.
POSITION_BITS = 33


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine (as in tests), a
    temporary folder is set as its checkpoint folder; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spindrel-"))
    return sc.getCheckpointDir()


class Scratch:
    """Written tables in the shared folder; each write cuts the lineage."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/spindrel/{name}-{uuid.uuid4().hex}"
        self.count = 0
        for made in _watching:
            made.append(self)

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that this object wrote and no later plan reads."""
        self._delete(df._scratch_path)

    def clear(self) -> None:
        """Remove all tables that this object wrote."""
        self._delete(self.root)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_watching: list[list[Scratch]] = []


@contextmanager
def cleared() -> Iterator[None]:
    """Removes what operators write within, at its end: what is kept must be written elsewhere by then."""
    made: list[Scratch] = []
    _watching.append(made)
    try:
        yield
    finally:
        _watching.remove(made)
        for scratch in made:
            scratch.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns whose names an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def row_marks(rows: DataFrame, row_id: str) -> DataFrame:
    """Bitmaps (part, word, bits) with one bit set for each row id in ``rows``."""
    pos = F.col(row_id).bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return (
        rows.select(
            F.shiftright(F.col(row_id), POSITION_BITS).alias("part"),
            F.shiftright(pos, 6).alias("word"),
            F.expr(f"shiftleft(1L, cast(`{row_id}` & 63 as int))").alias("bit"),
        )
        .groupBy("part", "word")
        .agg(F.bit_or("bit").alias("bits"))
    )


def _cuts(marks: DataFrame, most: int) -> list[int]:
    """Words that part ``marks`` into slices of ``most`` rows at most.

    Words of a partition are numbers without large gaps, so counts are summed
    over blocks of words: one row of counts for ``most // 8`` words at least.
    """
    word = F.expr(f"shiftleft(part, {POSITION_BITS - 6}) | word")
    block = max(1, most // 8)
    counts = marks.groupBy(F.floor(word / block).cast("long").alias("b")).count().orderBy("b").collect()
    out, held = [], 0
    for b, n in counts:
        if held and held + n > most:
            out.append(b * block)
            held = 0
        held += n
    return out


def marked(rows: DataFrame, row_id: str, marks: DataFrame, keep: bool) -> DataFrame:
    """The rows whose mark is set (``keep``) or not set, without a shuffle of rows.

    ``marks`` is a written table of at most one row for 64 rows.  It is
    counted first; beyond MARKS_BYTES it is broadcast in slices of the words
    (partition and position), cut by their cumulated number, so that each holds
    MARKS_BYTES at most and no broadcast grows with the data.
    """
    most, n = MARKS_BYTES // MARK_BYTES, marks.count()
    cuts = [None, *_cuts(marks, most), None] if n > most else [None, None]
    out = None
    for low, high in zip(cuts, cuts[1:]):  # noqa: B905
        mine, few, word = rows, marks, F.expr(f"shiftleft(part, {POSITION_BITS - 6}) | word")
        if low is not None:
            mine, few = mine.where(F.col(row_id) >= low << 6), few.where(word >= low)
        if high is not None:
            mine, few = mine.where(F.col(row_id) < high << 6), few.where(word < high)
        few = few.select(
            F.expr(f"shiftleft(part, {POSITION_BITS - 6}) | word").alias("__mark_key"),
            F.col("bits").alias("__mark_bits"),
        )
        word = F.shiftright(F.col(row_id), 6)
        found = mine.join(F.broadcast(few), word == F.col("__mark_key"), "inner" if keep else "left")
        bit = F.expr(f"shiftright(__mark_bits, cast(`{row_id}` & 63 as int)) & 1L")
        found = found.where(bit == 1 if keep else F.coalesce(bit, F.lit(0)) == 0)
        found = found.drop("__mark_key", "__mark_bits")
        out = found if out is None else out.unionByName(found)
    return out


#: A key with more rows than this, and with more than one in HOT_KEYS of all rows, is hot.
HOT_ROWS, HOT_KEYS = 1 << 20, 1000


def hot_join(rows: DataFrame, values: DataFrame, key: str, scratch: Scratch, sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to ``values``, which has one row at most for each ``key``.

    Keys with more than 1 in HOT_KEYS of all rows are HOT_KEYS at most: their
    values are written and broadcast, so a key that fills a third of all rows
    is joined where its rows stand.  All others are shuffled.  ``sizes``: a
    written table with the keys of ``rows``, if those aren't written.
    """
    sizes = rows if sizes is None else sizes
    n = sizes.count()
    if n <= HOT_ROWS:
        return rows.join(values, key)
    hot = sizes.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > max(HOT_ROWS, n // HOT_KEYS))
    few = scratch.write(values.join(hot.select(key), key))
    if few.isEmpty():
        return rows.join(values, key)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(rest.join(values, key))


_slot: list = [None, None]


def held(key: tuple, make):
    """What ``make`` gave for ``key`` in this Python worker.

    A worker holds one such object: what an earlier stage of the same worker
    has held is let go first, so that caches of several stages don't add up.
    """
    if _slot[0] != key:
        _slot[:] = [None, None]
        give_back()
        _slot[:] = [key, make()]
    return _slot[1]


def give_back() -> None:
    """Returns to the system what this Python worker no longer uses, where the system's allocator can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
