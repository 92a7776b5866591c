import random
import re

import __spark_entry__ as registered
import numpy as np
import pytest
from helpers import TEXTS, by, documents, empty

from tablescope.llm import jaccard

FOLDER = "/root/testdata/sf0.001"


def plain_set(text, words=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(found) < words:
        return {" ".join(found)} if found else set()
    return {" ".join(found[i : i + words]) for i in range(len(found) - words + 1)}


def plain_join(texts, words=4, percent=85):
    """(n_shingles, component) by key; every pair is compared."""
    sets = {i: plain_set(t, words) for i, t in texts.items()}
    label = {i: i for i in texts}
    links = [
        (a, b) for a in texts for b in texts
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in texts}


def found(spark, texts, **settings):
    rows = by(jaccard.join(documents(spark, texts, ()), "doc_id", "text", **settings))
    return {i: (r.n_shingles, r.component) for i, r in rows.items()}


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"e{r.randrange(10**9)}"
    return words


def corpus(seed, groups=14, each=9):
    """Groups of edited copies about the limit, chains of them, and unrelated texts that share passages."""
    r = random.Random(seed)
    common = [f"p{i}" for i in range(60)]
    texts = {}
    for g in range(groups):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice([5, 9, 30, 120, 300]))]
        for n in range(each):
            own = edited(r, words, r.randrange(0, 2 + len(words) // 25))
            texts[100 * g + n] = " ".join(own)
            if n % 3 == 0:  # a chain: the next copies follow this one
                words = own + [f"w{r.randrange(10**6)}" for _ in range(len(own) // 20)]
    for n in range(40):
        texts[10_000 + n] = " ".join(common + [f"u{r.randrange(10**6)}" for _ in range(r.randrange(1, 60))])
    return texts


@pytest.mark.parametrize("tile, open_tile, leaders", [(4096, 512, 64), (8, 4, 64), (16, 512, 1)])
def test_against_all_pairs(spark, monkeypatch, tile, open_tile, leaders):
    """Small tiles and few leaders change nothing; leaders alone would not do."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "OPEN_TILE", open_tile)
    monkeypatch.setattr(jaccard, "LEADERS", leaders)
    texts = corpus(leaders)
    expected = plain_join(texts)
    assert found(spark, texts) == expected
    assert len({label for _, label in expected.values()}) < len(texts)


def test_another_similarity_and_shingle(spark):
    texts = corpus(5, 6)
    assert found(spark, texts, words=2, percent=60) == plain_join(texts, 2, 60)


def test_links_that_only_buckets_find(spark, monkeypatch):
    """Without any link from leaders, the buckets and the exact comparison find all."""
    monkeypatch.setattr(jaccard, "similar", lambda *_: False)
    texts = {1: "a b c d e f g h i j k l m n o p q r s t u v w x y z", 2: "same text here now", 3: "same text here now"}
    assert {i: c for i, (_, c) in found(spark, texts).items()} == {1: 1, 2: 2, 3: 2}  # equal sets are one set
    monkeypatch.undo()
    monkeypatch.setattr(jaccard, "LEADERS", 1)
    r = random.Random(2)
    texts = {}
    for g in range(30):  # the smallest hash of two copies often differs
        words = [f"w{r.randrange(10**6)}" for _ in range(200)]
        texts[2 * g], texts[2 * g + 1] = " ".join(words), " ".join(edited(r, words, 4))
    assert found(spark, texts) == plain_join(texts)


def test_sets_have_the_shingles_of_the_text():
    for text in [t for i, t in TEXTS.items() if i != 7] + ["a", "a b", "a b c d", "a b c d a b c d", "b a d c"]:
        assert len(jaccard.set_of(text, 4)) == len(plain_set(text))
    a, b = jaccard.set_of("a b c d e", 4), jaccard.set_of("x a B c D", 4)
    assert len(np.intersect1d(a, b)) == 1 and not len(np.intersect1d(jaccard.set_of("a b", 4), jaccard.set_of("b a", 4)))


def test_more_sets_than_a_broadcast_takes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PICKED", 0)
    monkeypatch.setattr(jaccard, "SORTED", 5)
    monkeypatch.setattr(jaccard, "HOT", 3)
    texts = corpus(8, 4)
    assert found(spark, texts) == plain_join(texts)


def test_prefixes_of_linked_sets_meet():
    r = np.random.default_rng(1)
    for n in list(range(1, 40)) + [100, 333]:
        for _ in range(40):
            a = r.integers(0, 400, n)
            b = np.concatenate([a[int(r.integers(0, 1 + n // 6)) :], r.integers(0, 400, int(r.integers(0, 1 + n // 10)))])
            a, b = np.unique(a).astype(np.uint64), np.unique(b).astype(np.uint64)
            if not len(b) or not jaccard.linked(len(np.intersect1d(a, b)), len(a), len(b), 85):
                continue
            assert jaccard.may_meet(min(len(a), len(b)), max(len(a), len(b)), 85)
            for frequent in (np.zeros((0, 2), dtype=np.int64), np.array([[x, x % 7 + 3] for x in range(0, 400, 3)])):
                assert len(np.intersect1d(jaccard.prefix(a, frequent, 85), jaccard.prefix(b, frequent, 85)))


def test_signatures_bound_the_overlap():
    r = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(r.integers(0, 2**63, int(r.integers(1, 500))).astype(np.uint64))
        b = np.unique(np.concatenate([r.choice(a, int(r.integers(0, len(a) + 1)), False), r.integers(0, 2**63, int(r.integers(1, 300))).astype(np.uint64)]))
        x, y = jaccard.signature(a), jaccard.signature(b)
        assert 64 * len(x) == jaccard.width_of(len(a))
        for words in {1, min(len(x), len(y))}:
            most = jaccard.most_common(jaccard.folded(x, words), jaccard.folded(y, words), len(a), len(b))
            assert len(np.intersect1d(a, b)) <= most


def test_bounds_prune_before_the_exact_comparison(monkeypatch):
    """Texts that share a passage, but not enough, never reach the intersection."""
    calls = []
    real = np.intersect1d
    monkeypatch.setattr(np, "intersect1d", lambda *a, **k: calls.append(1) or real(*a, **k))
    r = np.random.default_rng(4)
    shared = r.integers(0, 2**63, 100).astype(np.uint64)
    for _ in range(50):
        sets = [np.unique(np.concatenate([shared, r.integers(0, 2**63, 200).astype(np.uint64)])) for _ in range(2)]
        assert not jaccard.similar(*((s, jaccard.signature(s)) for s in sets), 85)
    assert not calls


def test_documents_of_all_kinds(spark):
    texts = TEXTS | {20: "A b c", 21: "a B  c", 22: "a b", 23: "É é c d", 24: "é é c d", 30: TEXTS[7] + " more", 31: " \n"}
    assert found(spark, texts) == plain_join(texts)
    assert jaccard.join(empty(spark), "doc_id", "text").count() == 0
    nulls = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "x y"), (None, "x y"), (None, None), (7, None)], "doc_id long, text string")
    rows = sorted((tuple(r) for r in jaccard.join(nulls, "doc_id", "text").collect()), key=repr)
    assert rows == sorted([(None, 1, 5), (5, 1, 5), (None, 1, None), (None, 1, None), (None, 0, None), (7, 0, 7)], key=repr)


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = registered.queries()["op11_jaccard_join"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain_join(texts)
