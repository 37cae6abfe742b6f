"""Statistics of a text, for rules and classifiers."""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SYMBOLS, _DIGITS, _STOPS = b"#$%&*+<=>@^_`{|}~\\/", b"0123456789", b".!?"
_UPPER = bytes(range(65, 91))
#: What is measured, in this order.
NAMES = (
    "log_bytes",  # of the whole text
    "words",  # logarithm of their number
    "word_bytes",  # mean bytes of a word
    "longest_word",  # logarithm of its bytes
    "repeated_next",  # share of words equal to the word before
    "distinct_words",  # share of distinct words
    "repeated_lines",  # share of lines that occurred before
    "words_a_line",
    "symbols",  # shares of bytes
    "pipes",
    "exclamations",
    "upper",
    "digits",
    "stops",
    "commas",
    "spaces",
    "beyond_ascii",
)


def measure(text: str | None) -> tuple[float, ...]:
    """The statistics of a whole text; of a null or empty one all are 0."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n, m = len(data), len(words)
    if not n:
        return (0.0,) * len(NAMES)
    lines = data.split(b"\n")
    w, k = max(1, m), len(lines)
    without = lambda chars: (n - len(data.translate(None, chars))) / n
    return (
        float(np.log1p(n)),
        float(np.log1p(m)),
        sum(map(len, words)) / w,
        float(np.log1p(max(map(len, words), default=0))),
        sum(map(eq, words, words[1:])) / w,
        len(set(words)) / w,
        1 - len(set(lines)) / k,
        m / k,
        without(_SYMBOLS),
        data.count(b"|") / n,
        data.count(b"!") / n,
        without(_UPPER),
        without(_DIGITS),
        without(_STOPS),
        data.count(b",") / n,
        data.count(b" ") / n,
        (n - len(data.translate(None, bytes(range(128, 256))))) / n,
    )


def _frame(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=list(NAMES), dtype="float64")


def statistics(text: Column) -> Column:
    """A struct with a field for each of NAMES."""
    return F.pandas_udf(_frame, ", ".join(f"{n} double" for n in NAMES))(text)
