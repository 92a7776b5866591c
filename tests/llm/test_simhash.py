import random
import re

import numpy as np
import pytest
import xxhash
from helpers import TEXTS, by, documents, empty

from tablescope.llm import simhash
from tablescope.llm.simhash import THREE_BITS, Settings


def plain_fingerprint(text, words=3):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, max_bits=3):
    """Smallest key reachable, by key."""
    keys = sorted(fps)
    label = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a in keys:
            for b in keys:
                if label[a] < label[b] and bin(fps[a] ^ fps[b]).count("1") <= max_bits:
                    label[b], changed = label[a], True
    return label


@pytest.mark.parametrize("text", [t for i, t in TEXTS.items() if i != 7] + ["a", "a b", "A b C", "É é", "w " * 1000])
def test_fingerprint(text):
    assert int.from_bytes(simhash.fingerprint(text, THREE_BITS), "big") == plain_fingerprint(text)


def test_wide_fingerprints_start_with_the_narrow_one():
    wide = simhash.fingerprint(TEXTS[1], Settings(words=3, lanes=4))
    assert len(wide) == 32 and wide[:8] == simhash.fingerprint(TEXTS[1], THREE_BITS)


def test_gray_rank_counts_through_the_code():
    code = np.array([i ^ i >> 1 for i in range(300)], dtype=np.uint64)[:, None]
    assert simhash.gray_rank(code).ravel().tolist() == list(range(300))
    wide = np.array([[i >> 6 ^ i >> 7, 0] for i in range(300)], dtype=np.uint64)  # parity carries into lane two
    assert simhash.gray_rank(wide)[:, 0].tolist() == [i >> 6 for i in range(300)]
    ones = np.array([[1, 0], [0, 0]], dtype=np.uint64)
    assert simhash.gray_rank(ones).tolist() == [[1, 2**64 - 1], [0, 0]]


def clusters(seed, centres, each, flips, lanes=1):
    r = random.Random(seed)
    out = []
    for _ in range(centres):
        centre = r.getrandbits(64 * lanes)
        for _ in range(each):
            fp = centre
            for _ in range(r.randint(0, flips)):
                fp ^= 1 << r.randrange(64 * lanes)
            out.append(fp)
    return sorted(set(out))


@pytest.mark.parametrize("lanes, max_bits, flips", [(1, 3, 4), (1, 0, 2), (2, 10, 9), (1, 64, 2)])
def test_index_finds_every_link(lanes, max_bits, flips):
    values = clusters(3, 20, 40, flips, lanes)
    fps = np.array([[v >> 64 * (lanes - 1 - n) & 2**64 - 1 for n in range(lanes)] for v in values], dtype=np.uint64)
    fps = fps[simhash.gray_order(fps)]
    index = simhash.GrayIndex(fps)
    found = set()
    for first in range(0, len(fps), 100):
        found |= set(zip(*(x.tolist() for x in index.links(first, min(len(fps), first + 100), max_bits))))
    apart = simhash.distance(fps[:, None], fps[None])
    assert found == {(i, j) for i, j in zip(*np.nonzero(apart <= max_bits)) if i < j}


def fingerprint_frame(spark, values):
    return spark.createDataFrame([(v.to_bytes(8, "big"),) for v in values], "fp binary")


@pytest.mark.parametrize("block", [8192, 40])
def test_components_of_clusters(spark, monkeypatch, block):
    """With small blocks, busy buckets are cut into pairs of blocks and nothing is lost."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    values = clusters(5, 6, 150, 5)
    values += [v ^ 1 << 60 for v in values[:50] if v ^ 1 << 60 not in values]
    edges = simhash.links(fingerprint_frame(spark, values), THREE_BITS)
    labels = {int.from_bytes(r.fp, "big"): int.from_bytes(r.label, "big") for r in simhash.components(edges).collect()}
    expected = plain_components({v: v for v in values})
    assert {v: labels.get(v, v) for v in values} == expected
    assert edges.count() <= 12 * len(values)


def test_long_chains_are_one_component(spark):
    chain = [0]
    for bit in range(60):
        chain.append(chain[-1] | 1 << bit)
    edges = simhash.links(fingerprint_frame(spark, chain[::3]), THREE_BITS)
    assert {bytes(r.label) for r in simhash.components(edges).collect()} == {bytes(8)}


def test_documents_of_all_kinds(spark):
    texts = TEXTS | {i: TEXTS[1].replace("dog", "cat") for i in (20, 21)} | {30: "a b c " * 500, 31: "a b c " * 499 + "d"}
    rows = by(simhash.near_duplicates(documents(spark, texts), "doc_id", "text", THREE_BITS))
    fps = {i: plain_fingerprint(t) for i, t in texts.items() if i != 7}
    fps[7] = int.from_bytes(simhash.fingerprint(texts[7], THREE_BITS), "big")
    assert {i: int.from_bytes(r.fp, "big") for i, r in rows.items()} == fps
    assert {i: r.component for i, r in rows.items()} == plain_components(fps)


def test_one_row_of_each_group_stays_with_all_columns(spark):
    df = documents(spark, repeat=(1, 6))
    kept = simhash.first_of_groups(df, "doc_id", "text", THREE_BITS)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 6, 7, 8, 9, 10]


def test_null_keys_and_empty_frames(spark):
    assert simhash.near_duplicates(empty(spark), "doc_id", "text", THREE_BITS).count() == 0
    assert simhash.first_of_groups(empty(spark), "doc_id", "text").count() == 0
    rows = [(None, "a b c d"), (5, "a b c d"), (None, "other words here now"), (None, "other words here now"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.first_of_groups(df, "doc_id", "text").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == [(5, "a b c d"), (None, "other words here now"), (None, None)]


def test_settings():
    assert THREE_BITS.exact and not Settings(lanes=4).exact
    with pytest.raises(ValueError):
        Settings(lanes=1, bands=21)
