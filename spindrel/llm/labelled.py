"""Bounded samples of labelled rows, and hashed terms of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held

#: Buckets of hashed terms, as bits; bytes of the word beginnings that are terms as well.
TERM_BITS, PREFIXES = 20, (3, 4, 5, 6, 8)
#: A bucket counts as a term of its own for each of these numbers of different words that it is met in.
LEVELS = (1, 2, 3, 5)
#: Bytes of a text that are hashed at a time; a longer word is a window of its own.
WINDOW = 1 << 16
_BASE, _MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xD6E8FEB86659FD93)


def _series(factor: int) -> np.ndarray:
    out = np.full(WINDOW + 1, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSE = _series(_BASE), _series(pow(_BASE, -1, 1 << 64))
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, wanted: dict[str, str], limit: int, use: Column, id_col: str, text_col: str) -> DataFrame:
    """(id, text, a column for each label) of at most ``limit`` labelled ids for which ``use`` holds.

    ``wanted`` maps label columns to names.  The ids are those that a hash puts
    first, so the sample doesn't depend on how rows are stored.  Ids that are
    null, whose labels are all null or contradict each other, take no part.
    ``limit`` bounds what is broadcast.
    """
    given = labels.where(F.col(id_col).isNotNull() & use).groupBy(F.col(id_col).alias("__id"))
    given = given.agg(*[F.min(c).alias(n) for c, n in wanted.items()], *[F.max(c).alias(f"__{n}") for c, n in wanted.items()])
    given = given.where(F.forall(F.array(*[F.col(n).eqNullSafe(F.col(f"__{n}")) for n in wanted.values()]), lambda x: x))
    given = given.where(F.coalesce(*[F.col(n) for n in wanted.values()]).isNotNull())
    given = given.select("__id", *wanted.values()).orderBy(F.xxhash64("__id", F.lit(7)), "__id").limit(limit)
    texts = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(given), F.col("__key") == F.col("__id")).select(F.col("__id").alias("id"), "text", *wanted.values())


def _bucket(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x ^ np.uint64(kind)) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x >> np.uint64(64 - TERM_BITS)).astype(np.int32)


def windows(text: str | None):
    """The lower-cased text in bytes, cut between words; a window of more than WINDOW bytes is one word."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    at = 0
    while at < len(data):
        to = min(len(data), at + WINDOW)
        if to < len(data):
            gaps = np.flatnonzero(~_LETTER[data[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            while not len(gaps) and to < len(data):  # the word goes on
                gaps = np.flatnonzero(~_LETTER[data[to : to + WINDOW]])
                to += int(gaps[0]) if len(gaps) else len(data[to : to + WINDOW])
        yield data[at:to]
        at = to


def _running(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * _POWERS[: len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def _long_word(data: np.ndarray) -> np.ndarray:
    """The hash of one word of any length, as word_terms forms it."""
    total, power = 0, 1
    for at in range(0, len(data), WINDOW):
        total += power * int(_running(data[at : at + WINDOW])[-1])
        power = power * int(_POWERS[WINDOW]) % (1 << 64)
    return np.array([total % (1 << 64)], np.uint64)


def word_terms(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word (a run of letters) a hash, and the buckets of the word and of its beginnings (-1: it is too short).

    The hash of a word is a difference of running sums, so all words of a
    window are hashed at once.
    """
    n = len(data)
    if n > WINDOW:
        start, end, whole, data, n = np.array([0]), np.array([n]), _long_word(data), data[:8], 8
    else:
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = _LETTER[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        sums = _running(data)
        whole = (sums[end] - sums[start]) * _INVERSE[start]
    size = np.minimum(end - start, 8)
    padded = np.append(data, np.zeros(8, np.uint8))
    first = np.ndarray(n, "<u8", padded, strides=(1,))[start] & _FIRST[size]
    out = np.empty((len(start), len(PREFIXES) + 1), np.int32)
    out[:, 0] = _bucket(whole, 0)
    for i, k in enumerate(PREFIXES, 1):
        out[:, i] = _bucket(first & _FIRST[k], k)
        out[size < k, i] = -1
    return whole, out


def size_term(count: int) -> int:
    """The term that stands for the number of words of a text."""
    return (len(LEVELS) << TERM_BITS) + count.bit_length()


def terms(text: str | None, watched: np.ndarray | None = None) -> np.ndarray:
    """The terms of a whole text, each once: a bucket and a level give ``bucket * len(LEVELS) + level``.

    ``watched``: a flag for each bucket, the last one false; others are left out.
    """
    found, words = [np.zeros(0, np.uint64)], 0
    for data in windows(text):
        whole, buckets = word_terms(data)
        words += len(whole)
        row, col = np.nonzero(buckets >= 0 if watched is None else watched[buckets])
        found.append(buckets[row, col].astype(np.uint64) << np.uint64(64 - TERM_BITS) | whole[row] >> np.uint64(TERM_BITS))
    pairs = np.unique(np.concatenate(found))  # of a bucket and a word
    values, counts = np.unique((pairs >> np.uint64(64 - TERM_BITS)).astype(np.int64), return_counts=True)
    levels = [values[counts >= n] * len(LEVELS) + i for i, n in enumerate(LEVELS)]
    return np.concatenate([*levels, [size_term(words)]])


#: Texts whose terms are counted at a time.
SLICE = 256


def _counts(labels: list[str]):
    """Sums over slices of texts: of each term, the texts that have it and a label, and those where that is 1."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), SLICE):
                part = pdf.iloc[at : at + SLICE]
                found = [terms(text) for text in part["text"]]
                of = np.repeat(np.arange(len(part)), [len(f) for f in found])
                values, place = np.unique(np.concatenate(found), return_inverse=True)
                out = {"b": values}
                for label in labels:
                    y = part[label].to_numpy(float)[of]
                    out[f"n_{label}"] = np.bincount(place, ~np.isnan(y), len(values)).astype(np.int64)
                    out[f"k_{label}"] = np.bincount(place, np.nan_to_num(y), len(values)).astype(np.int64)
                yield pd.DataFrame(out)

    return run


def chosen_terms(rows: DataFrame, labels: list[str], count: int, least: int = 5) -> np.ndarray:
    """For each 0/1 label the ``count`` terms of ``rows`` (a bounded sample) that tell most about it, by chi-squared.

    Terms in fewer than ``least`` texts are left out; those for the size of a
    text are always there.  Sums are formed on the executors; only the chosen
    come to the driver.
    """
    schema = "b long, " + ", ".join(f"n_{c} long, k_{c} long" for c in labels)
    sums = [F.sum(f"{x}_{c}").alias(f"{x}_{c}") for c in labels for x in "nk"]
    per = rows.select("text", *labels).mapInPandas(_counts(labels), schema).groupBy("b").agg(*sums)
    per = Scratch(rows.sparkSession, "terms").write(per)
    total = rows.agg(*[F.count(c).alias(f"n_{c}") for c in labels], *[F.sum(c).alias(f"k_{c}") for c in labels]).first()
    sizes = np.array([size_term((1 << i) - 1) for i in range(24)])
    out = [sizes]
    for c in labels:
        n, k = float(total[f"n_{c}"] or 0), float(total[f"k_{c}"] or 0)
        expected = F.col(f"n_{c}") * (k / max(n, 1.0))
        chi = (F.col(f"k_{c}") - expected) ** 2 / (expected + 1e-9) / F.greatest(1 - F.col(f"n_{c}") / max(n, 1.0), F.lit(1e-9))
        best = per.where(F.col(f"n_{c}") >= least).orderBy(F.desc(chi), "b").limit(count).select("b").toPandas()["b"]
        out.append(best.to_numpy(np.int64))
    return np.unique(np.concatenate(out))


class Terms:
    """Finds in a text the terms that were chosen, as their places in the ascending list of them."""

    def __init__(self, chosen: np.ndarray):
        self.chosen = np.sort(np.asarray(chosen, np.int64))
        self.watched = np.zeros((1 << TERM_BITS) + 1, bool)  # the last one stands for no bucket
        buckets = self.chosen // len(LEVELS)
        self.watched[buckets[buckets < 1 << TERM_BITS]] = True

    def __call__(self, text: str | None) -> np.ndarray:
        found = terms(text, self.watched)
        at = np.minimum(np.searchsorted(self.chosen, found), len(self.chosen) - 1)
        return np.sort(at[self.chosen[at] == found]) if len(self.chosen) else found[:0]


def finder(chosen: np.ndarray) -> Terms:
    """One for each Python worker."""
    return held(("terms", chosen.tobytes()), lambda: Terms(chosen))


def places(chosen: np.ndarray):
    """A function of a series of texts that gives the places of their terms."""
    return lambda texts: pd.Series([finder(chosen)(t).astype(np.int32) for t in texts])
