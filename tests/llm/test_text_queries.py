"""The registered text queries next to their SQL, or next to a plain version where there is none."""

import base64
import hashlib
import re
import zlib

import __spark_entry__ as registered
import check
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_licenses import plain_words
from test_private_data import plain_spans
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def rows(spark, name):
    return registered.queries()[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", ["op1_url_filter", "op3_top_k", "op9_merkle"])
def test_sql(spark, name):
    outcome, *_ = check.compare(spark, check.database(FOLDER), name, FOLDER)
    assert outcome == "ok"


def test_all_are_registered():
    found = [re.match(r"op(\d+)_", n) for n in registered.queries()]
    assert sorted(int(m[1]) for m in found if m) == list(range(1, 14))
    assert "pipeline" in registered.queries()


def test_private_data(spark, texts):
    found = rows(spark, "op2_private_data")
    assert len(found) == len(texts)
    for r in found:
        spans = plain_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        spelled = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(spelled).encode()).hexdigest()
        assert set(spelled) <= set(r.spans.split(","))


def test_simhash(spark, texts):
    found = {r.doc_id: r for r in rows(spark, "op4_simhash")}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: int(r.fingerprint, 16) for i, r in found.items()} == fps
    assert {i: r.component_id for i, r in found.items()} == plain_components(fps)


def test_packing(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for i, t in texts.items()}
    pieces = sorted(rows(spark, "op5_packing"), key=lambda r: (r.sequence_id, r.offset))
    ends, covered = {}, {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert r.start == covered.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        covered[r.doc_id] = r.start + r.length
    assert covered == {i: len(x) for i, x in ids.items()}
    for r in pieces:
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert sorted(ends) == list(range(len(ends))) and sum(e < 2048 for e in ends.values()) <= 1 and max(ends.values()) <= 2048


def test_byte_pairs(spark, texts):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows(spark, "op6_byte_pairs"):
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_sharding(spark, texts):
    found = rows(spark, "op7_sharding")
    slots = {}
    for r in found:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(found) == len(texts)
    sizes = [len(slots.get(s, ())) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_licenses(spark, texts):
    phrases = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
    for r in rows(spark, "op8_licenses"):
        words = plain_words(texts[r.doc_id])
        places = {
            (i, label) for phrase, label in phrases for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
        }
        base = {label for _, label in places}
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted(base)))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert base <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_quality(spark):
    folder = "/root/testdata/sf0.01"  # the smallest has only 19 labels held out
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = registered.queries()["op10_quality"](spark, folder).collect()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    held = [r.predicted == labels[r.doc_id] for r in found if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean(held) > 0.95
