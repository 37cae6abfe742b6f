"""Text functions as built-in column expressions.

White space means space, tab, line feed, form feed and carriage return; letters
and digits are those of Unicode (the categories L, M, N).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities that are decoded, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: The legal forms that are stripped from a name, in the order in which they are tried.
COMMON = (
    " AB", " Co", " Group", " Holdings", " Bhd", " eG", " AG", " Ltd", " PLC", " Corp", " LP", " Inc", " SA",
    " Investment", " Company", " LLC",
)
WORD = r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*"
TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:[-'][\p{L}\p{M}\p{N}_]+)*|[^ \t\n\f\r\p{L}\p{M}\p{N}_]"
#: References and what they stand for, in the order of escaping; runs of capitalised words.
ESCAPED = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
CAPITALS = r"[A-Z]+[a-z]*(?:[ '-][A-Z]+[a-z]*)*"
PADDING = "NONE"


def fix_text(x: Column) -> Column:
    """Common HTML entities decoded."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, x)


def normalized(x: Column, lowercase: bool = True, fix: bool = True) -> Column:
    """Words with inner hyphens, without punctuation, as an array."""
    x = fix_text(x) if fix else x
    return F.regexp_extract_all(F.lower(x) if lowercase else x, F.lit(WORD), F.lit(0))


def word_tokens(x: Column) -> Column:
    """Words and single punctuation marks, as an array."""
    return F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))


def paragraphs(headline: Column, body: Column, separator: str = "\n") -> Column:
    """The headline, then the parts of the body."""
    return F.concat(F.array(headline), F.split(body, separator))


def sentences(paragraph: Column) -> Column:
    """Parts that end in a full stop, exclamation or question mark before white space; empty ones are left out."""
    parts = F.split(F.regexp_replace(paragraph, "([.!?])[ \t\n\f\r]+", "$1\u0001"), "\u0001")
    return F.filter(parts, lambda s: s != "")


def is_disclaimer(paragraph: Column, prefixes: list[str]) -> Column:
    """Whether a paragraph starts with one of the (non-empty) prefixes."""
    return reduce(Column.__or__, [F.startswith(paragraph, F.lit(p)) for p in prefixes if p], F.lit(False))


def windows(tokens: Column, size: int, padding: str = PADDING) -> Column:
    """The centred window of ``size`` tokens around each token, padded, as an array of arrays."""
    half = (size - 1) // 2
    pad = F.array_repeat(F.lit(padding), half)
    padded = F.concat(pad, tokens, pad)
    return F.transform(tokens, lambda _, i: F.slice(padded, i + 1, size))


def strip_common(x: Column, anchored: bool = False) -> Column:
    """A name without the first of COMMON that it contains, wherever it stands.

    ``anchored``: the longest first, and at the end of the name only.
    """
    trim = lambda c: F.regexp_replace(c, r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", "")
    if anchored:
        forms = sorted(COMMON, key=lambda s: (-len(s), s))
        cases = [(F.endswith(x, F.lit(s)), trim(F.substring(x, F.lit(1), F.length(x) - len(s)))) for s in forms]
    else:
        cases = [(F.contains(x, F.lit(s)), trim(F.replace(x, F.lit(s), F.lit("")))) for s in COMMON]
    first, *rest = cases
    return reduce(lambda c, e: c.when(*e), rest, F.when(*first)).otherwise(x)


def initials(x: Column) -> Column:
    """First letters of the words, in upper case."""
    return F.array_join(F.transform(normalized(x), lambda w: F.upper(F.substring(w, 1, 1))), "")


def capital_phrases(x: Column) -> Column:
    """Runs of capitalised words (ASCII), as an array."""
    return F.regexp_extract_all(x, F.lit(CAPITALS), F.lit(0))


def starts_upper(x: Column) -> Column:
    return F.rlike(x, F.lit(r"^\p{Lu}"))


def mention_label(m: str = "") -> Column:
    """Context and text of a mention as one string with bars."""
    return F.concat_ws("|", *[F.col(m + c) for c in ("previous_word2", "previous_word", "text", "next_word", "next_word2")])


def mention_html(*cols: str) -> Column:
    """Columns as an HTML table of one row with headings; values are escaped, nulls are empty."""
    shown = lambda c: reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), ESCAPED, F.coalesce(F.col(c).cast("string"), F.lit("")))
    heads = "".join(f"<th>{c}</th>" for c in cols)
    cells = [F.concat(F.lit("<td>"), shown(c), F.lit("</td>")) for c in cols]
    return F.concat(F.lit(f"<table><tr>{heads}</tr><tr>"), *cells, F.lit("</tr></table>"))


def as_json(*cols: str) -> Column:
    """The text and its features as sorted JSON."""
    return F.concat(F.col("text"), F.lit(" "), F.to_json(F.struct(*sorted(cols))))
