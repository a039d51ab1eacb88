"""Corpus encoding against an independent library, with forced boundaries and hostile texts."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm import encode

pytestmark = pytest.mark.skipif(not Path(encode.VOCABULARY).exists(), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def _ids(texts):
    import pyarrow as pa

    ids, offsets = encode.encoder(encode.VOCABULARY).encode_column(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


TRICKY = ["a", " ", "  x", "x  ", "\t\tq", "a\n \n b", "'s", "!'s", "x's", "it's 'tis ''s", "a\u00a0 b", "\u00e9\u2003\u2003x", "\u3000\u3000w", "\u65e5\u672c\u8a9e \u30c6\u30ad\u30b9\u30c8", "Zo\u00eb's na\u00efve caf\u00e9\u2014ok", "\U0001f3e0\U0001f44d\U0001f3fd x", "<|endoftext|>", "don't!'re", "\x1c\x1d x", "x\u0085\u0085y", "12345 6,789.0", "a'b'c", "\r\n\r\nZ", "\u00ff\u00fe"]


def test_tricky_texts(reference):
    assert _ids(TRICKY) == reference(TRICKY)


ALPHABET = list("ab \'\"sdtmlrve0.!-\n\t\r") + list("\u00e9\u00a0\u3000\u00df\u044f\u8a9e\U0001f3e0\u0301\u200d\u0085\u2019")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(ALPHABET), st.characters(exclude_categories=("Cs",))), max_size=60), min_size=1, max_size=6))
def test_random_texts(reference, texts):
    assert _ids(texts) == [[] if not t else ids for t, ids in zip(texts, reference(texts))]


def test_heap_merge_equals_the_library(reference):
    e = encode.encoder(encode.VOCABULARY)
    rng = random.Random(1)
    for n in (1, 2, 3, 10, 50, 500):
        for _ in range(20):
            piece = bytes(rng.choice(b"abcaaZ \xc3\xa9") for _ in range(n))
            assert encode.heap_merge(piece, e.ranks) == e.fast._encode_single_piece(piece)


@pytest.mark.parametrize("text", ["a" * 100_000, " " * 50_000, "ab" * 30_000, "é" * 30_000, "^" * 60_000, "word " * 40_000, "\n" * 30_000 + "x"])
def test_long_texts(reference, text):
    assert _ids([text]) == reference([text])


def test_tables(spark, rows, reference):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "hello world", "y")], "doc_id long, text string, ids string")
    want = reference(["hello world"])[0]
    assert rows(encode.encode_texts(df)) == [(1, want), (1, want), (2, []), (3, [])]
    assert rows(encode.count_tokens(df)) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert encode.encode_texts(df.limit(0)).count() == 0
    named = df.select(df.doc_id.cast("string").alias("a b"), df.text.alias("t"))
    assert rows(encode.encode_texts(named, "a b", "t"))[0] == ("1", want)


def test_slices_keep_rows(spark, reference, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(encode, "SLICE", 20)
    texts = ["x" * 30, None, "", "a b", "c" * 90, "d"]
    parts = list(encode._slices(pa.record_batch([pa.array(texts)], ["text"]), "text"))
    assert [v for p in parts for v in p.column("text").to_pylist()] == texts and len(parts) > 1
    assert [i for p in parts for i in _ids(p.column("text").to_pylist())] == [[] if not t else reference([t])[0] for t in texts]
