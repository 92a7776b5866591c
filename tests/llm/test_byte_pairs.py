import hashlib

import public_tokenizers
import pytest
from helpers import TEXTS, by, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from tablescope.llm import byte_pairs

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return byte_pairs.Codec(RANKS, public_tokenizers.PATTERN)


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(byte_pairs, "LEAF", 8)


ALPHABET = st.sampled_from(list("abcdefgh ABC 019 '.,!\n\t\r éß漢\u00a0\u0301🙂\x85\x1c") + ["'s", "  ", " the", "ing", "\n\n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=120).map("".join))
def test_halves_join_to_the_whole(text):
    codec = byte_pairs.codec(RANKS, public_tokenizers.PATTERN)
    leaf, byte_pairs.LEAF = byte_pairs.LEAF, 8
    try:
        ids = codec.encode(text)
        assert ids == codec.encoding.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
    finally:
        byte_pairs.LEAF = leaf


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "the", "ing", "tion", "z", "er", "q"]), min_size=5, max_size=200).map("".join))
def test_long_runs_are_joined_by_windows(run):
    codec = byte_pairs.codec(RANKS, public_tokenizers.PATTERN)
    leaf, byte_pairs.LEAF = byte_pairs.LEAF, 8
    try:
        assert codec.encode_run(run.encode()) == codec.merge(run.encode())
    finally:
        byte_pairs.LEAF = leaf


def test_tree_of_any_bytes(codec, small_leaves):
    run = bytes(range(97, 123)) * 40
    assert codec.encode_run(run) == codec.merge(run)


@pytest.mark.parametrize("text", ["漢字かな" * 3000, "ab" * 9000 + "!" + "é" * 700, "?!" * 3000, "x" * 5000 + " " * 3000 + "y", " \x1c\x85" * 900, "don't " * 2000])
def test_long_stretches_without_spaces(codec, text):
    assert codec.encode(text) == codec.encoding.encode_ordinary(text)


def test_most_texts_are_joined_from_halves(spark, monkeypatch):
    """On the test documents, nearly all encodings come from windows and not from one call."""
    codec = byte_pairs.Codec(RANKS, public_tokenizers.PATTERN)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    calls = []
    real = codec.join_at
    monkeypatch.setattr(codec, "join_at", lambda *a: calls.append(a[0]) or real(*a))
    for text in texts:
        assert codec.encode(text) == codec.encoding.encode_ordinary(text)
    assert len(calls) > 5 * len(texts) and len(set(calls) & set(texts)) > len(texts) * 0.8
    run = "abcdefghij" * 500
    joins = []
    join = codec.join
    monkeypatch.setattr(codec, "join", lambda *a: joins.append(1) or join(*a))
    assert codec.encode(run) == codec.merge(run.encode()) and joins


def test_all_kinds_of_texts(spark, codec):
    rows = by(byte_pairs.digests(documents(spark), "doc_id", "text", RANKS, public_tokenizers.PATTERN))
    assert set(rows) == set(TEXTS)
    for i, text in TEXTS.items():
        ids = codec.encoding.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_special_strings_are_text_and_empty_frames_stay_empty(spark):
    encoded = byte_pairs.encode(documents(spark, {1: "<|endoftext|>"}, ()), "doc_id", "text", RANKS, public_tokenizers.PATTERN)
    assert len(encoded.first().ids) > 1
    assert byte_pairs.encode(empty(spark), "doc_id", "text", RANKS, public_tokenizers.PATTERN).count() == 0


def test_decoding_keeps_columns_and_takes_nulls(spark):
    df = spark.createDataFrame([(1, None, b"x"), (2, [31373], b"x")], "doc_id long, ids array<int>, decoded binary")
    rows = by(byte_pairs.decode(df, "ids", RANKS, public_tokenizers.PATTERN))
    assert (bytes(rows[1].decoded), bytes(rows[2].decoded)) == (b"", b"hello")
