import math
import random
import re
from collections import Counter

import __spark_entry__ as registered
import check
import numpy as np
import pytest
from helpers import TEXTS, documents, empty

from tablescope.llm import ranked

FOLDER = "/root/testdata/sf0.001"


def plain_terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_search(items, docs, k=10):
    """(item, rank, key, score): every document is scored; docs are (key, text) pairs, items a dict."""
    held = [(key, Counter(plain_terms(text))) for key, text in docs]
    held = [(key, tf, sum(tf.values())) for key, tf in held if tf]
    n_all, total = len(held), sum(n for *_, n in held)
    df = Counter(term for _, tf, _ in held for term in tf)
    out = []
    for item, text in items.items():
        scores = []
        for key, tf, n in held:
            m = 100 - 90 + 90 * n * n_all // total
            score = 0
            for term in set(plain_terms(text)) & set(tf):
                w = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[term] + 1)))
                score += w * (1000000000 * tf[term] // (1000 * tf[term] + 8 * m))
            if score > 0:
                scores.append((-score, key is None, key))
        out += [(item, rank, key, -score) for rank, (score, _, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n, words=400):
    r = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(words)]
    shares = [1 / (i + 1) for i in range(words)]
    text = lambda size: " ".join(r.choices(vocabulary, shares, k=size))
    docs = [(i, text(r.randrange(0, 60))) for i in range(n)]
    return docs, {i: text(r.randrange(1, 12)) for i in range(25)}


def frames(spark, items, docs):
    return (
        spark.createDataFrame(list(items.items()), "item_id long, text string"),
        spark.createDataFrame(docs, "doc_id long, text string"),
    )


def found(spark, items, docs, k=10):
    items, docs = frames(spark, items, docs)
    out = ranked.search(items, "item_id", "text", docs, "doc_id", "text", k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("terms, block, k", [(100_000, 8192, 10), (20, 16, 3), (100_000, 5, 1)])
def test_against_all_documents(spark, monkeypatch, terms, block, k):
    """Small blocks of items and of documents change nothing."""
    monkeypatch.setattr(ranked, "BLOCK_TERMS", terms)
    monkeypatch.setattr(ranked, "BLOCK_DOCUMENTS", block)
    docs, items = corpus(k, 300)
    assert found(spark, items, docs, k) == plain_search(items, docs, k)


def test_accumulators_are_limited():
    """Documents that hold only common terms get none, and the k best stay right."""
    docs, items = corpus(7, 2000)
    held = [Counter(plain_terms(text)) for _, text in docs]
    held = [tf for tf in held if tf]
    numbers = {term: i for i, term in enumerate(sorted({t for tf in held for t in tf}))}
    df = Counter(t for tf in held for t in tf)
    sizes = np.array([sum(tf.values()) for tf in held])
    weights = np.array([ranked.weight(len(held), df[t]) for t in sorted(numbers)], dtype=np.int64)
    ids = [np.array(sorted(numbers[t] for t in tf), dtype=np.int32) for tf in held]
    tfs = [np.array([tf[t] for t in sorted(tf)], dtype=np.int64) for tf in held]
    block = ranked.Block(ids, tfs, ranked.lengths(sizes, len(held), int(sizes.sum())), weights)
    made_all = matched = 0
    for text in items.values():
        terms = sorted({t for t in plain_terms(text) if t in numbers}, key=lambda t: df[t])
        own = np.array([numbers[t] for t in terms], dtype=np.int64)
        every, scores, all_made = block.best(own, len(held), 0)
        kept, kept_scores, made = block.best(own, 5, 0)
        assert sorted(kept_scores.tolist())[-5:] == sorted(scores.tolist())[-5:]
        assert dict(zip(kept.tolist(), kept_scores.tolist())).items() <= dict(zip(every.tolist(), scores.tolist())).items()
        floored = block.best(own, 5, int(kept_scores.min()) + 1 if len(kept) else 1)
        assert set(floored[0].tolist()) <= set(kept.tolist())
        made_all, matched = made_all + made, matched + all_made
    assert made_all < matched * 0.8


def test_ties_repeated_rows_and_nulls(spark):
    docs = [(5, "same words"), (3, "same words"), (3, "same words"), (None, "same words"), (9, None), (10, ""), (11, "other")]
    docs += [(100 + i, f"filler{i} text") for i in range(20)]
    items = {1: "WORDS of the same words", 2: None, 3: "", 4: "nowhere", 5: "filler1 filler2 text", 6: "--- ,,,"}
    assert found(spark, items, docs) == plain_search(items, docs)
    assert found(spark, items, docs, 2) == plain_search(items, docs, 2)
    assert [r[2] for r in found(spark, items, docs) if r[0] == 1] == [3, 3, 5, None]
    assert found(spark, items, []) == [] and found(spark, {}, docs) == []


def test_items_that_share_a_key_are_one(spark):
    items = spark.createDataFrame([(1, "alpha beta"), (1, "beta gamma"), (None, "gamma")], "item_id long, text string")
    docs = [(i, t) for i, t in enumerate(["alpha gamma", "beta", "gamma gamma", "delta", "delta x"])]
    own = ranked.search(items, "item_id", "text", frames(spark, {}, docs)[1], "doc_id", "text")
    expected = plain_search({1: "alpha beta gamma", None: "gamma"}, docs)
    assert sorted((tuple(r) for r in own.collect()), key=repr) == expected


def test_documents_of_all_kinds(spark):
    texts = {i: t for i, t in TEXTS.items() if i != 8} | {8: "x" * 30_000}
    items = {1: "The QUICK fox, more words", 2: "漢字かな交じり文", 3: "example.com 4111", 4: "x" * 30_000, 5: "Ünïcödé   "}
    frame = documents(spark, texts)
    wanted = spark.createDataFrame([(i, t, "x", 1) for i, t in items.items()], "item_id long, text string, score string, key long")
    out = ranked.search(wanted, "item_id", "text", frame, "doc_id", "text")
    pairs = list(texts.items()) + [(1, texts[1])]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain_search(items, pairs)
    assert ranked.search(wanted, "item_id", "text", empty(spark), "doc_id", "text").count() == 0


def test_string_keys(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "three")], "id string, body string")
    items = spark.createDataFrame([("q", "one three")], "name string, body string")
    rows = ranked.search(items, "name", "body", docs, "id", "body").collect()
    assert [(r["rank"], r["id"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, "c"), (2, "a"), (3, "b")]


def test_lengths_beyond_64_bits():
    terms = np.array([10**9, 5], dtype=np.int64)
    assert ranked.lengths(terms, 10**12, 10**15).tolist() == [10 + 90 * n * 10**12 // 10**15 for n in (10**9, 5)]


def test_query(spark):
    outcome, *_ = check.compare(spark, check.database(FOLDER), "op12_ranked_search", FOLDER)
    assert outcome == "ok"
    assert registered.queries()["op12_ranked_search"](spark, FOLDER).columns[:4] == ["item_id", "rank", "doc_id", "score"]
