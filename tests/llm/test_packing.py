import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import TEXTS, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablescope.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
FRESH = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


ALPHABET = st.sampled_from(list("abcXYZ 019 '.,!\"#\n\t\r éßÉİΣσ漢 ̸́=<🙂\x85\x1c") + ["'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "Word"])


@settings(max_examples=500, deadline=None)
@given(st.lists(ALPHABET, max_size=40).map("".join))
def test_words_apart_are_the_whole_text(text):
    words = packing.words_of(PATH)
    ids = b"".join(map(words.__getitem__, text.encode().split()))
    assert np.frombuffer(ids, dtype="<u2").tolist() == FRESH.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_ids_of_their_own():
    words = packing.Words(PATH)
    for text in ("a <|endoftext|> b", "x<|startoftext|>y.", "<|endoftext|><|endoftext|>", "End<|endoftext|>!!", "é<|endoftext|>É"):
        ids = np.frombuffer(b"".join(map(words.__getitem__, text.encode().split())), dtype="<u2").tolist()
        assert ids == FRESH.encode(text, add_special_tokens=False).ids and {49406, 49407} & set(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("etaoinshrdluéèüößñjqxz漢字Éσς"), min_size=1, max_size=16), min_size=200, max_size=200))
def test_merging_by_rank_is_the_tokenizers_way(names):
    words = packing.words_of(PATH)
    for name in names:
        assert np.frombuffer(words.encoded(name.encode()), dtype="<u2").tolist() == FRESH.encode(name).ids


def test_every_word_of_the_vocabulary():
    words = packing.words_of(PATH)
    texts = [FRESH.decode([i]).strip() for i in range(512, 49406)]
    texts = [t for t in dict.fromkeys(texts) if t and not t.isspace()]
    expected = [e.ids for e in FRESH.encode_batch(texts, add_special_tokens=False)]
    found = [np.frombuffer(b"".join(map(words.__getitem__, t.encode().split())), dtype="<u2").tolist() for t in texts]
    assert found == expected


def test_a_full_memory_starts_anew(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    words = packing.Words(PATH)
    text = "Some words, and more words. Some again!"
    ids = b"".join(map(words.__getitem__, text.encode().split()))
    assert np.frombuffer(ids, dtype="<u2").tolist() == whole(tokenizer, text)[:-1]


def test_the_curve_visits_neighbours(monkeypatch):
    monkeypatch.setattr(packing, "LEVELS", 3)
    for d in (2, 3):
        cells = np.stack(np.meshgrid(*[np.arange(8)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        keys = packing.hilbert_key(cells)
        assert sorted(keys.tolist()) == list(range(8**d))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def check(rows, texts, tokenizer, length, repeats=1):
    ids = {i: np.array(whole(tokenizer, t), dtype="<u4") for i, t in texts.items()}
    spelled = {}
    for r in rows:
        assert 0 < r.length and r.offset + r.length <= length and r.doc_tokens == len(ids[r.doc_id])
        piece = np.frombuffer(r.ids, dtype="<u4")
        assert piece.tolist() == ids[r.doc_id][r.start : r.start + r.length].tolist()
        spelled[r.doc_id] = spelled.get(r.doc_id, 0) + r.length
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    ends = []
    for pieces in sequences.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        ends.append(at)
    assert sorted(sequences) == list(range(len(sequences)))
    assert sorted(ends)[1:] == [length] * (len(ends) - 1)  # all but one are full
    return spelled, ids


def test_every_token_lies_in_one_piece(spark, tokenizer):
    rows = packing.pack(documents(spark), "doc_id", "text", PATH, length=64).collect()
    spelled, ids = check(rows, TEXTS, tokenizer, 64)
    assert spelled == {i: len(x) * (2 if i == 1 else 1) for i, x in ids.items()}


def test_like_documents_are_neighbours(spark):
    r = random.Random(4)
    topics = [[f"{a}{b}" for b in "aeiou"] for a in ("ba", "ko", "lu", "mi")]
    texts = {i: " ".join(r.choice(topics[i % 4]) for _ in range(60)) for i in range(200)}
    rows = packing.pack(documents(spark, texts, ()), "doc_id", "text", PATH, length=128).collect()
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    same = sum(a % 4 == b % 4 for a, b in zip(order, order[1:]))
    assert same > 150  # 50 if they stood at random


def test_empty_frames_and_bad_lengths(spark):
    assert packing.pack(empty(spark), "doc_id", "text", PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty(spark), "doc_id", "text", PATH, length=0)


def test_end_id_alone(spark):
    rows = packing.pack(documents(spark, {1: None, 2: ""}, ()), "doc_id", "text", PATH, length=1).collect()
    assert [(r.length, zlib.crc32(r.ids)) for r in rows] == [(1, zlib.crc32(b"\x01\0\0\0"))] * 2
