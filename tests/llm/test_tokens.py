"""BPE transducer and edit-aware counts against the libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindrel.llm import bpe, token_counts

PATH, COUNTS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "<|endoftext|>x<|startoftext|>", "ΑΣ ΑΣ.Β İ", "a\x1cb\x85c\xa0d", "it's we'LL", "é́", "z" * 100_000, "ab " * 60_000, "日本語" * 3000, "!?" * 2000, "\U0001f600"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def check(library, text):
    want = library.encode(text or "", add_special_tokens=False).ids
    model = bpe.load(PATH)
    packed = model.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == want
    decoder = model.decoder
    parts = [decoder.feed(packed[i : i + 12]) for i in range(0, len(packed), 12)]
    assert b"".join(parts).decode() == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD, ids=range(len(ODD)))
def test_odd_texts(library, text):
    check(library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(library, text):
    check(library, text)


def test_long_words_stream(library, monkeypatch):
    """Words are cut at every kind of place, with the least memory that the lookahead allows."""
    monkeypatch.setattr(bpe, "STEP", 16)
    model, rng = bpe.load(PATH), random.Random(2)
    for alphabet in ("ab", "the", "aab", "abcdefghij", "éàt"):
        word = "".join(rng.choice(alphabet) for _ in range(4000))
        want = library.encode(word, add_special_tokens=False).ids
        assert list(model.word_ids(word[i : i + 16] for i in range(0, len(word), 16))) == want


def test_round_trip_query_columns(spark, library):
    rows = [(i, t, "mine", 1) for i, t in enumerate(ODD)] + [(0, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string, n_tokens int")
    out = bpe.round_trip(docs, PATH, keep=True)
    assert out.columns == ["doc_id", "text", "extra", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    for r in out.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        text = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], bytes(r["ids"])) == (len(ids), hashlib.sha256(packed).hexdigest(), packed)
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    plain = bpe.decode(bpe.encode(docs.where("doc_id = 6"), PATH), PATH, joined=False)
    assert plain.first()["decoded"] == "it 's we 'll "
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


PIECES = ["the", " ", "  ", "\n", "don't", "'s", "é", "12", "3", "!!", "x", "'", " 're", "　", "Ab", "\t", "\x1c", "\x85", "²"]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_edits_equal_counting_again(data):
    model = token_counts.counter(COUNTS)
    text = "".join(data.draw(st.lists(st.sampled_from(PIECES), max_size=200)))
    doc = token_counts.Document(text, model)
    for _ in range(data.draw(st.integers(1, 5))):
        if data.draw(st.booleans()):  # through the column and back
            doc = token_counts.Document(text, model, token_counts.pack(doc.root))
        start, length = data.draw(st.integers(0, len(text) + 2)), data.draw(st.integers(0, 20))
        new = "".join(data.draw(st.lists(st.sampled_from(PIECES), max_size=6)))
        a = min(start, len(text))
        text = text[:a] + new + text[min(len(text), a + length) :]
        doc.edit(start, length, new)
        assert doc.text == text
        assert token_counts.lengths(doc.root, 0, doc.root.pieces) == list(map(len, model.pieces(text)))
        assert doc.tokens == len(model.model.encode_ordinary(text))


def test_edits_of_a_long_text_touch_little():
    doc = token_counts.Document("some words here " * 20_000, token_counts.counter(COUNTS))
    doc.edit(100_000, 5, "other")
    assert doc.encoded < 40 and doc.tokens == len(doc.model.model.encode_ordinary(doc.text))
    packed, text = token_counts.pack(doc.root), doc.text
    again = token_counts.Document(text, doc.model, packed)
    again.edit(200_000, 3, " odd " * 300)
    again.edit(7, 0, "x")
    assert 300 < again.encoded < 700 and again.tokens == len(doc.model.model.encode_ordinary(again.text))
    opened = sum(not x.packed for x in token_counts.leaves(again.root))
    assert opened < 60 < 1000 < sum(1 for _ in token_counts.leaves(again.root))  # the others were never unpacked
    assert token_counts.pack(token_counts.unpack(packed, text)) == packed


def test_a_second_batch_uses_the_kept_trees(spark):
    rows = [(1, "one two three " * 500, [(6, 3, "2")], [(0, 3, "1"), (100, 0, "x@y.org")]), (2, None, None, [(0, 0, "new")]), (3, "", [], None), (4, "keep me", [None], [(None, None, None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first array<struct<start:long,length:long,text:string>>, second array<struct<start:long,length:long,text:string>>")
    once = token_counts.apply_edits(token_counts.plant(docs, COUNTS), F.col("first"), COUNTS)
    kept = once.select("doc_id", F.col("text_after").alias("text"), "tree", "second")
    twice = token_counts.apply_edits(kept, F.col("second"), COUNTS)
    model = token_counts.counter(COUNTS)
    for r in twice.collect():
        doc = token_counts.Document(r["text_after"], model)
        assert r["n_tokens_after"] == len(model.model.encode_ordinary(r["text_after"])) == token_counts.unpack(bytes(r["tree"]), r["text_after"]).tokens
        assert token_counts.lengths(token_counts.unpack(bytes(r["tree"]), r["text_after"]), 0, 1 << 40) == list(map(len, model.pieces(r["text_after"])))
        assert r["n_encoded_again"] < 40 and doc.tokens == r["n_tokens_after"]
    with pytest.raises(Exception, match="tree is not that of the text"):
        token_counts.apply_edits(kept.withColumn("text", F.lit("other")), F.col("second"), COUNTS).collect()


def test_counts_of_odd_rows(spark):
    texts = [None, "", "mail me@x.org or 10.0.0.1 now", "x" * 50_000, "me@x.org", "a@b", "1234567890123456 7"]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(0, None, 9)], "doc_id long, text string, n_tokens int")
    out = token_counts.count(docs, token_counts.redactions(F.col("text")), COUNTS).collect()
    model = token_counts.counter(COUNTS).model
    for r in out:
        want = r["text"] or ""
        for a, b in (("me@x.org", "<EMAIL>"), ("10.0.0.1", "<IP>"), ("1234567890123456", "<NUMBER>")):
            want = want.replace(a, b)
        assert r["text_after"] == want
        assert (r["n_tokens"], r["n_tokens_after"]) == (len(model.encode_ordinary(r["text"] or "")), len(model.encode_ordinary(want)))
    assert token_counts.count(docs.limit(0), token_counts.redactions(F.col("text")), COUNTS).count() == 0
