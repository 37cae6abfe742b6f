"""BPE encoding and decoding as streaming transducers.

Encoding reads a text piece by piece.  Whether a token is final depends only on
a bounded number of bytes after it: the *sufficient lookahead* of the merge
list (``lookahead``).  A run of bytes that one word has gone on for so long is
encoded, the tokens that end before its last ``lookahead`` bytes are emitted,
and reading goes on from the last of them.  So a word of any length needs
constant memory.  Words are kept with their ids in a bounded cache.

Decoding is a state machine over token ids: it holds the bytes of an unfinished
character, or the pending separator, and nothing else.

Files are those of the ``tokenizers`` library with a BPE model, byte-level
alphabet and end-of-word suffix, lower-casing, and words cut by the pattern
that CLIP made known.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from codecs import getincrementaldecoder
from heapq import heapify, heappop, heappush
from itertools import chain
from typing import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, without

#: The words of the pattern, in the order in which they are tried.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters of a text that are handled at a time; entries of each half of a cache.
WINDOW, CACHE = 1 << 16, 60_000
#: Words of more characters are not cached; bytes of a word that are merged at a time.
LONG, STEP = 512, 8192
_NONE = 1 << 60
_PACK = struct.Struct("<I").pack


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(other)) for b in range(256)]


class Cache(dict):
    """Two generations: what is not asked for again goes when the younger one is full."""

    def __init__(self, make, size: int = CACHE):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Bpe:
    """The model of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if (
            model["type"] != "BPE"
            or kinds != ["NFC", "Replace", "Lowercase"]
            or [x["type"] for x in steps] != ["Split", "ByteLevel"]
            or steps[0]["pattern"] != {"Regex": PATTERN}
            or spec["decoder"]
        ):
            raise ValueError(f"{path}: not a tokenizer of the kind that this transducer reads")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = byte_alphabet()
        self.start = [self.vocab[c] for c in letters]
        self.end = [self.vocab[c + self.suffix] for c in letters]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {
            self.vocab[a] << 20 | self.vocab[b]: rank << 20 | self.vocab[a + b] for rank, (a, b) in enumerate(pairs, 1)
        }
        self.names = {i: t for t, i in chain(self.vocab.items(), self.special.items())}
        self.sizes = {i: len(t.removesuffix(self.suffix)) for i, t in self.names.items()}
        self.lookahead = self._lookahead(pairs)
        self.longest = max(self.sizes.values())
        self.words = Cache(lambda w: b"".join(map(_PACK, self.word_ids([w]))))
        self.chunks = Cache(self._chunk)
        self.path, self.library = path, None
        self.spelled, self.meant = _tables(self)
        self.pieces = regex.compile(PATTERN)
        specials = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.specials = regex.compile(f"({specials})") if specials else None

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """Bytes after which what follows can no longer change a token.

        Two texts that agree on a prefix are merged alike left of a frontier
        that starts at the end of the prefix.  Rule (a, b) moves it left by
        len(a) if a ends at the frontier and b begins there in one of the
        texts only; b then begins with the token by which an earlier rule
        moved it, or with bytes from beyond the prefix.  The farthest that
        such a chain of rules reaches is a bound.
        """
        reach: dict[str, int] = {}
        far = 0
        for a, b in pairs:
            text = b.removesuffix(self.suffix) if self.suffix else b
            back = max((reach.get(text[:n], 0) for n in range(1, len(text) + 1)), default=0)
            move = len(a) + back
            reach[a] = max(reach.get(a, 0), move)
            far = max(far, move)
        return far

    def merge(self, ids: list[int]) -> list[int]:
        """The merge list applied to a whole list of ids; it is changed."""
        if len(ids) > 64:
            return self._merge_long(ids)
        get = self.merges.get
        pairs = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while pairs and (best := min(pairs)) != _NONE:
            i, new = pairs.index(best), best & 0xFFFFF
            ids[i : i + 2] = [new]
            del pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] << 20 | new, _NONE)
            if i < len(pairs):
                pairs[i] = get(new << 20 | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n steps: a linked list, and a heap of (rule, place, pair)."""
        get, n = self.merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i] << 20 | ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << 20 | ids[i + 1]))]
        heapify(heap)
        while heap:
            rule, i, pair = heappop(heap)
            j = after[i]
            if j >= n or ids[i] < 0 or ids[i] << 20 | ids[j] != pair:
                continue
            ids[i], ids[j] = rule & 0xFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (m := get(ids[a] << 20 | ids[b])):
                    heappush(heap, (m, a, ids[a] << 20 | ids[b]))
        return [x for x in ids if x >= 0]

    def word_ids(self, parts: Iterable[str]) -> Iterator[int]:
        """Ids of one word that comes in parts, each as soon as it is final."""
        held = b""
        for part in parts:
            held += part.encode("utf-8", "replace")
            if len(held) > STEP + self.lookahead + self.longest:
                # The last byte may turn out to be the end of the word, so it is not merged yet.
                stable, done = len(held) - 1 - self.lookahead, 0
                for i in self.merge([self.start[b] for b in held[:-1]]):
                    if done + self.sizes[i] > stable:
                        break
                    done += self.sizes[i]
                    yield i
                held = held[done:]
        if held:
            yield from self.merge([self.start[b] for b in held[:-1]] + [self.end[held[-1]]])

    def cut(self, text: str) -> list[str]:
        """The words of a text, normalised and lower-cased.

        Characters from U+0370 on are left to the library, whose Unicode tables
        are not of the same version as Python's.
        """
        if text.isascii() or max(text) < "\u0370":
            if _CONTROL.search(text):
                text = _GAP.sub(" ", text)
            return self.pieces.findall(unicodedata.normalize("NFC", text).lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.words.__getitem__, self.cut(chunk)))

    def feed(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text, window by window."""
        at, n = 0, len(text)
        while at < n:
            to = min(n, at + WINDOW)
            if to < n:
                cut = max(text.rfind(" ", at, to), text.rfind("\n", at, to)) + 1
                if cut <= at:
                    m = _BLANK.search(text, to)
                    cut = m.start() if m else n
                to = cut
            yield self._window(text[at:to])
            at = to

    def _window(self, text: str) -> bytes:
        if self.specials and "<|" in text and self.specials.search(text):
            parts = self.specials.split(text)
            return b"".join(
                np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in parts if p
            )
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if _CONTROL.search(text):  # these four are white space for str.split, but not for the pattern
            return self._unbroken(text)
        chunks = text.split()
        if max(map(len, chunks), default=0) <= LONG:
            return b"".join(map(self.chunks.__getitem__, chunks))
        return b"".join(self._unbroken(c) if len(c) > LONG else self.chunks[c] for c in chunks)

    def _unbroken(self, text: str) -> bytes:
        return b"".join(self._long(p) if len(p) > LONG else self.words[p] for p in self.cut(text))

    def _long(self, word: str) -> bytes:
        return b"".join(map(_PACK, self.word_ids(word[i : i + STEP] for i in range(0, len(word), STEP))))

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, packed; null counts as empty."""
        return b"".join(self.feed(text or ""))

    @property
    def decoder(self) -> "Decoder":
        return Decoder(self)


_CONTROL = regex.compile("[\x1c-\x1f]")
_GAP = regex.compile(r"[^\S\x1c-\x1f]+")
_BLANK = regex.compile(r"[ \t\n\r\x0b\x0c]")


class Decoder:
    """Ids to text, some at a time.

    ``joined``: as the library decodes a file that names no decoder, the tokens
    as the vocabulary spells them with a space between; the state is whether a
    token has come.  Else the bytes that tokens stand for, with a space at the
    end of each word; the state is the bytes of a character that isn't complete.
    """

    def __init__(self, bpe: Bpe, joined: bool = True):
        self.bpe, self.joined, self.begun = bpe, joined, False
        self.state = getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes) -> bytes:
        """The next part of the text, in UTF-8."""
        ids = np.frombuffer(packed, "<u4").tolist()
        if not ids:
            return b""
        if self.joined:
            table = self.bpe.spelled
            out = b" ".join(map(table.__getitem__, ids))
            out = b" " + out if self.begun else out
            self.begun = True
            return out
        table = self.bpe.meant
        return self.state.decode(b"".join(map(table.__getitem__, ids))).encode()

    def finish(self) -> bytes:
        return b"" if self.joined else self.state.decode(b"", True).encode()


def _tables(bpe: Bpe) -> tuple[dict[int, bytes], dict[int, bytes]]:
    """Of each id the token as the vocabulary spells it, and the bytes that it stands for."""
    byte = {c: b for b, c in enumerate(byte_alphabet())}
    spelled, meant = {}, {}
    for i, name in bpe.names.items():
        spelled[i] = name.encode()
        body = name.removesuffix(bpe.suffix)
        meant[i] = spelled[i] if name in bpe.special else bytes(byte[c] for c in body) + (b" " if body != name else b"")
    return spelled, meant


def load(path: str) -> Bpe:
    """The model of a file, once for each Python worker."""
    return held(("bpe", path), lambda: Bpe(path))


def _digests(path: str, keep: bool = False):
    def run(texts: pd.Series) -> pd.DataFrame:
        bpe, out = load(path), []
        for text in texts:
            ids, text_of, n, decoder, kept = hashlib.sha256(), hashlib.sha256(), 0, bpe.decoder, []
            for packed in bpe.feed(text or ""):
                n += len(packed) // 4
                if keep:
                    kept.append(packed)
                ids.update(packed)
                text_of.update(decoder.feed(packed))
            text_of.update(decoder.finish())
            out.append((n, ids.hexdigest(), text_of.hexdigest(), b"".join(kept))[: 4 if keep else 3])
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 if keep else 3])

    return run


def round_trip(docs: DataFrame, path: str, text_col: str = "text", keep: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 of each whole text.

    Ids and decoded text are hashed as they stream by; ``keep`` adds the ids as
    ``ids`` (binary: unsigned 32-bit integers, the lowest byte first).  Null counts as empty
    (no tokens, digests of nothing).  Columns of these names are replaced,
    others pass unchanged.
    """
    base = without(docs, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep else []), "__bpe")
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if keep else "")
    return base.withColumn("__bpe", F.pandas_udf(_digests(path, keep), kind)(F.col(text_col))).select(
        *[F.col(f"`{c}`") for c in base.columns], "__bpe.*"
    )


def _ids(path: str):
    def run(texts: pd.Series) -> pd.Series:
        bpe = load(path)
        return pd.Series([np.frombuffer(bpe.encode(t), "<u4").astype(np.int32) for t in texts])

    return run


def _texts(path: str, joined: bool):
    def run(ids: pd.Series) -> pd.Series:
        bpe, out = load(path), []
        for x in ids:
            decoder = Decoder(bpe, joined)
            data = decoder.feed(np.asarray([] if x is None else x, "<u4").tobytes())
            out.append((data + decoder.finish()).decode())
        return pd.Series(out, dtype=object)

    return run


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text as ``ids_col`` (array of int; null: empty)."""
    return without(docs, ids_col).withColumn(ids_col, F.pandas_udf(_ids(path), "array<int>")(F.col(text_col)))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded", joined: bool = True) -> DataFrame:
    """``rows`` with the text of their ids as ``text_col`` (null ids: empty)."""
    return without(rows, text_col).withColumn(text_col, F.pandas_udf(_texts(path, joined), "string")(F.col(ids_col)))
