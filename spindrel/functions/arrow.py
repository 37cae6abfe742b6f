"""Functions that built-in expressions can't express, over Arrow batches."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _replace(patterns: list[str], keep: bool):
    found = re.compile("|".join(patterns), re.DOTALL)

    def one(m: re.Match) -> str:
        for name, value in m.groupdict().items():
            if value and name != "EMPTY":
                return f" {value} {name} " if keep else f" {name} "
        return ""

    return lambda texts: texts.map(lambda t: None if t is None else found.sub(one, t))


def multi_replace(patterns: list[str], text: Column) -> Column:
    """Each match of the patterns ``(?P<NAME>...)`` becomes `` NAME ``; those of EMPTY go."""
    return F.pandas_udf(_replace(patterns, keep=False), "string")(text)


def multi_annotate(patterns: list[str], text: Column) -> Column:
    """Each match becomes `` match NAME ``; those of EMPTY go."""
    return F.pandas_udf(_replace(patterns, keep=True), "string")(text)


def repair_text(text: Column) -> Column:
    """All HTML character references decoded, then NFC."""
    fix = lambda t: None if t is None else unicodedata.normalize("NFC", html.unescape(t))
    return F.pandas_udf(lambda texts: texts.map(fix), "string")(text)


def jaro_similarity(a: str, b: str) -> float:
    """Share of matching characters, less half of those that stand in another order."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def winkler_similarity(a: str, b: str) -> float:
    """Jaro similarity raised by a common beginning of up to four characters, from 0.7 on."""
    s, n = jaro_similarity(a, b), 0
    while n < min(4, len(a), len(b)) and a[n] == b[n]:
        n += 1
    return s + 0.1 * n * (1 - s) if s > 0.7 else s


def _pairs(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def jaro(a: Column, b: Column) -> Column:
    return F.pandas_udf(_pairs(jaro_similarity), "double")(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return F.pandas_udf(_pairs(winkler_similarity), "double")(a, b)
