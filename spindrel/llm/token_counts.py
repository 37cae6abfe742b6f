"""Token counts that follow edits.

A document keeps a tree over its pre-tokens: leaves hold runs of pre-tokens
with their lengths and token counts, inner nodes the sums of both.  The tree is
a column beside the text.  An edit looks its place up by the sums, cuts out the
pre-tokens it touches and a little context on either side, and splits and counts
only that text again.  The new pieces replace the old ones from where both
agree, and the sums on the way to the root are updated; leaves that no edit
touches stay packed as they were, and the tree goes back into its column for
the next edits.

Pre-tokens are those of a byte-level BPE: the pattern's matches cover the text,
and no merge crosses them, so counts of pre-tokens add up.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from itertools import accumulate
from operator import itemgetter
from typing import Sequence

import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, without

#: The pre-tokens of the byte-level vocabulary of 50,257 ids.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts in Latin-1, with the classes written out, which matches faster.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Pre-tokens of a leaf or children of a node, at most; counts that are remembered.
FAN, CACHE = 32, 300_000
#: Pre-tokens before and after an edit whose limits it may move; characters beyond that a match may look at.
CONTEXT, AHEAD = 2, 64
EDITS = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("text", T.StringType())])
)


class Counter(dict):
    """Token counts of pre-tokens; emptied when full."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(PATTERN)
        self.model = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[piece] = n = len(self.model.encode_ordinary(piece))
        return n

    def pieces(self, text: str) -> list[str]:
        return (LATIN if text.isascii() or max(text) <= "\xff" else self.pattern).findall(text)


def counter(path: str) -> Counter:
    """The counter of a file, once for each Python worker."""
    return held(("counts", path), lambda: Counter(path))


#: Of a packed node: kind (inner, leaf of bytes, leaf of 32-bit numbers), items, and the three sums.
_HEAD = struct.Struct("<BHQQQ")
_KINDS = ("", "B", "I")


class Node:
    """A leaf of (length, count) pairs and their text, or an inner node of nodes.

    ``packed``: the pairs of a leaf that were not asked for yet.
    """

    __slots__ = ("leaf", "_items", "packed", "text", "chars", "tokens", "pieces")

    def __init__(self, items: list, leaf: bool, text: str = ""):
        self._items, self.leaf, self.text, self.packed = items, leaf, text, b""
        self.sum()

    @property
    def items(self) -> list:
        if self.packed:
            n = self.pieces
            numbers = struct.unpack(f"<{2 * n}{'I' if len(self.packed) > 2 * n else 'B'}", self.packed)
            self._items, self.packed = list(zip(numbers[:n], numbers[n:], strict=True)), b""
        return self._items

    def sum(self) -> None:
        if self.leaf:
            self.chars, self.tokens, self.pieces = sum(map(itemgetter(0), self.items)), sum(map(itemgetter(1), self.items)), len(self.items)
        else:
            self.chars, self.tokens, self.pieces = (sum(getattr(x, k) for x in self.items) for k in ("chars", "tokens", "pieces"))


def join(nodes: list[Node]) -> Node:
    """The root over nodes of one level."""
    while len(nodes) > 1:
        nodes = [Node(nodes[i : i + FAN], False) for i in range(0, len(nodes), FAN)]
    return nodes[0] if nodes else Node([], True)


def build(pairs: Sequence[tuple[int, int]], text: str = "") -> Node:
    leaves, at = [], 0
    for i in range(0, len(pairs), FAN):
        leaf = Node(list(pairs[i : i + FAN]), True)
        leaf.text = text[at : at + leaf.chars]
        at += leaf.chars
        leaves.append(leaf)
    return join(leaves)


def pack(root: Node) -> bytes:
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if not x.leaf:
            out.append(_HEAD.pack(0, len(x.items), x.chars, x.tokens, x.pieces))
            stack += reversed(x.items)
            continue
        data = x.packed
        if not data:
            numbers = [*map(itemgetter(0), x.items), *map(itemgetter(1), x.items)]
            data = bytes(numbers) if max(numbers, default=0) < 256 else struct.pack(f"<{len(numbers)}I", *numbers)
        out.append(_HEAD.pack(2 if len(data) > 2 * x.pieces else 1, x.pieces, x.chars, x.tokens, x.pieces))
        out.append(data)
    return b"".join(out)


def total(data: bytes) -> int:
    """The tokens of a packed tree."""
    return _HEAD.unpack_from(data)[3]


def unpack(data: bytes, text: str) -> Node:
    """The tree of a packed one over its text; pairs stay packed."""
    if _HEAD.unpack_from(data)[2] != len(text):
        raise ValueError("the tree is not that of the text")
    at = place = 0

    def node() -> Node:
        nonlocal at, place
        kind, n, chars, tokens, pieces = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        x = Node.__new__(Node)
        x.leaf, x.chars, x.tokens, x.pieces, x.packed, x.text = kind > 0, chars, tokens, pieces, b"", ""
        if not kind:
            x._items = [node() for _ in range(n)]
            return x
        size = 2 * n * struct.calcsize(_KINDS[kind])
        x._items, x.packed, x.text = [], data[at : at + size], text[place : place + chars]
        at, place = at + size, place + chars
        return x

    return node()


def leaves(node: Node) -> Iterator[Node]:
    if node.leaf:
        yield node
    else:
        for x in node.items:
            yield from leaves(x)


def find(root: Node, char: int) -> tuple[int, int]:
    """(number, first character) of the pre-token that holds a character; the last one for the end."""
    node, number, at = root, 0, 0
    while not node.leaf:
        for x in node.items:
            if char < at + x.chars or x is node.items[-1]:
                node = x
                break
            at, number = at + x.chars, number + x.pieces
    for size, _ in node.items:
        if char < at + size:
            break
        at, number = at + size, number + 1
    return number, at


def between(node: Node, start: int, stop: int) -> str:
    """The text of the pre-tokens from number ``start`` to before ``stop``."""
    if start <= 0 and stop >= node.pieces and node.leaf:
        return node.text
    if node.leaf:
        sizes = list(accumulate(map(itemgetter(0), node.items), initial=0))
        return node.text[sizes[max(0, start)] : sizes[min(max(0, stop), node.pieces)]]
    out, at = [], 0
    for x in node.items:
        if at < stop and at + x.pieces > start:
            out.append(between(x, start - at, stop - at))
        at += x.pieces
    return "".join(out)


def lengths(root: Node, start: int, stop: int) -> list[int]:
    """Lengths of the pre-tokens from number ``start`` to before ``stop``."""
    if root.leaf:
        return [s for s, _ in root.items[max(0, start) : max(0, stop)]]
    out, at = [], 0
    for x in root.items:
        if at < stop and at + x.pieces > start:
            out += lengths(x, start - at, stop - at)
        at += x.pieces
    return out


def splice(node: Node, start: int, stop: int, new: list[tuple[int, int]], text: str) -> list[Node]:
    """Puts ``new`` with its text in place of the pre-tokens from ``start`` to before ``stop``; a node may become several or none."""
    if node.leaf:
        start, stop = max(0, start), max(0, stop)
        node.text = between(node, 0, start) + text + between(node, stop, node.pieces)
        node.items[start:stop] = new
        if len(node.items) <= FAN:
            node.sum()
            return [node] if node.items else []
        out, at = [], 0
        for i in range(0, len(node.items), FAN // 2):
            part = Node(node.items[i : i + FAN // 2], True)
            part.text = node.text[at : at + part.chars]
            at += part.chars
            out.append(part)
        return out
    out, at, given = [], 0, False
    for i, x in enumerate(node.items):
        last = i == len(node.items) - 1
        takes = not given and (start < at + x.pieces or last)
        size = x.pieces
        if takes or at < stop and at + size > start:
            out += splice(x, start - at, min(stop - at, size), *((new, text) if takes else ([], "")))
            given = given or takes
        else:
            out.append(x)
        at += size
    node.items[:] = out
    if len(out) <= FAN:
        node.sum()
        return [node] if out else []
    return [Node(out[i : i + FAN // 2], False) for i in range(0, len(out), FAN // 2)]


class Document:
    """A tree over a text, and how many pre-tokens edits made it encode again."""

    def __init__(self, text: str, model: Counter, packed: bytes | None = None):
        self.model, self.encoded = model, 0
        if packed is not None:
            self.root = unpack(packed, text)
            return
        pieces = model.pieces(text)
        self.root = build(list(zip(map(len, pieces), map(model.__getitem__, pieces), strict=True)), text)

    @property
    def tokens(self) -> int:
        return self.root.tokens

    @property
    def text(self) -> str:
        return "".join(x.text for x in leaves(self.root))

    def edit(self, start: int, length: int, new: str) -> None:
        """Replaces ``length`` characters from ``start``; limits beyond the text are moved to its end.

        Only leaves near the edit are read or copied.
        """
        size = self.root.chars
        start = min(max(0, start), size)
        length = min(max(0, length), size - start)
        if not length and not new:
            return
        first, _ = find(self.root, start)
        last, _ = find(self.root, start + length)
        low, high = max(0, first - CONTEXT), min(self.root.pieces, last + 1 + CONTEXT)
        at = start - self._offset(low)
        while True:
            old = between(self.root, low, high)
            text = old[:at] + new + old[at + length :]
            # The next characters are read too: a match may depend on them.
            pieces = self.model.pieces(text + between(self.root, high, high + AHEAD)[:AHEAD])
            limits, ends = list(accumulate(map(len, pieces), initial=0)), None
            if high >= self.root.pieces:
                ends = len(pieces)
            elif len(text) in limits and at + len(new) < len(text):
                ends = limits.index(len(text))
            if ends is not None:
                break
            high = min(self.root.pieces, high + 2 * (high - low) + 8)
        pieces = pieces[:ends]
        pairs = list(zip(map(len, pieces), map(self.model.__getitem__, pieces), strict=True))
        self.encoded += len(pairs)
        self.root = join(splice(self.root, low, high, pairs, text))

    def _offset(self, number: int) -> int:
        node, at = self.root, 0
        while not node.leaf:
            for x in node.items:
                if number < x.pieces or x is node.items[-1]:
                    node = x
                    break
                number, at = number - x.pieces, at + x.chars
        return at + sum(s for s, _ in node.items[:number])


def _plant(path: str):
    def run(texts: pd.Series) -> pd.DataFrame:
        model, out = counter(path), []
        for text in texts:
            root = Document(text or "", model).root
            out.append((root.tokens, root.pieces, pack(root)))
        return pd.DataFrame(out, columns=["n_tokens", "n_pieces", "tree"])

    return run


def _edit(path: str):
    def run(texts: pd.Series, trees: pd.Series, edits: pd.Series) -> pd.DataFrame:
        model, out = counter(path), []
        for text, tree, changes in zip(texts, trees, edits, strict=True):
            text = text or ""
            if changes is None or not len(changes):
                out.append((total(tree), 0, text, tree))
                continue
            doc = Document(text, model, tree)
            for e in changes:
                if e is not None:
                    doc.edit(int(e["start"] or 0), int(e["length"] or 0), e["text"] or "")
            out.append((doc.tokens, doc.encoded, doc.text, pack(doc.root)))
        return pd.DataFrame(out, columns=["n_tokens_after", "n_encoded_again", "text_after", "tree"])

    return run


def _plant_and_edit(path: str):
    def run(texts: pd.Series, edits: pd.Series) -> pd.DataFrame:
        planted = _plant(path)(texts)
        edited = _edit(path)(texts, planted.pop("tree"), edits)
        return pd.concat([planted, edited], axis=1)

    return run


def plant(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_pieces (pre-tokens) and the packed ``tree`` of each whole text.

    Null texts count as empty.  Columns of those names are replaced, others
    pass unchanged.
    """
    base = without(docs, "n_tokens", "n_pieces", "tree", "__counts")
    found = F.pandas_udf(_plant(path), "n_tokens long, n_pieces long, tree binary")(F.col(text_col))
    return base.withColumn("__counts", found).select(*[F.col(f"`{c}`") for c in base.columns], "__counts.*")


def apply_edits(docs: DataFrame, edits: Column, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a ``tree`` for each text, after edits: n_tokens_after, n_encoded_again, text_after, and the new ``tree``.

    ``edits`` is an array of (start, length, text) in characters, applied one
    after the other, each to what the former left; null or none leaves text and
    tree as they are.  n_encoded_again counts the pre-tokens that edits made it
    encode.  text_after goes with the new tree: the next edits take both.  A
    tree that is not its text's is an error.
    """
    base = without(docs, "n_tokens_after", "n_encoded_again", "text_after", "__counts")
    kind = "n_tokens_after long, n_encoded_again long, text_after string, tree binary"
    found = F.pandas_udf(_edit(path), kind)(F.col(text_col), F.col("tree"), edits.cast(EDITS))
    kept = [F.col(f"`{c}`") for c in base.columns if c.lower() != "tree"]
    return base.withColumn("__counts", found).select(*kept, "__counts.*")


def count(docs: DataFrame, edits: Column, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with token counts before and after edits of each whole text, through the tree of every document.

    Results: those of ``plant`` and of ``apply_edits``, one after the other in
    one Python worker; columns of their names are replaced, others pass
    unchanged.
    """
    base = without(docs, "n_tokens", "n_pieces", "n_tokens_after", "n_encoded_again", "text_after", "tree", "__counts")
    kind = "n_tokens long, n_pieces long, n_tokens_after long, n_encoded_again long, text_after string, tree binary"
    found = F.pandas_udf(_plant_and_edit(path), kind)(F.col(text_col), edits.cast(EDITS))
    return base.withColumn("__counts", found).select(*[F.col(f"`{c}`") for c in base.columns], "__counts.*")


#: What redaction looks for.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,7}\.[A-Za-z]{2,24}")
_DIGITS = re.compile(r"(?<![\w.])(?:(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})|\d{12,19})(?!\w)")


def personal(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, mark) of e-mail addresses, IP addresses and long numbers, in order, apart from each other."""
    hits, at = [], text.find("@")
    while at >= 0:
        before, after = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
        if before and after:
            hits.append((before.start(), after.end(), "<EMAIL>"))
        at = text.find("@", at + 1)
    hits += [(m.start(), m.end(), "<IP>" if m[1] else "<NUMBER>") for m in _DIGITS.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for hit in sorted(hits):
        if not out or hit[0] >= out[-1][1]:
            out.append(hit)
    return out


def _redactions(texts: pd.Series) -> pd.Series:
    # From the end on, so that an edit doesn't move the next ones.
    found = ([{"start": a, "length": b - a, "text": t} for a, b, t in reversed(personal(x or ""))] for x in texts)
    return pd.Series(list(found))


def redactions(text: Column) -> Column:
    """Edits that put a mark in place of each e-mail address, IP address and long number of a text."""
    return F.pandas_udf(_redactions, EDITS)(text)
