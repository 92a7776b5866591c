import hashlib
import random
import re
import zlib

import __spark_entry__ as registered
import numpy as np
import pytest
from helpers import LONG, TEXTS, by, documents, empty

from tablescope.llm import runs

FOLDER = "/root/testdata/sf0.001"


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def plain_runs(words, shortest=12):
    """Every lag is tried; a stretch of matches on it is a run if the lag is its smallest period."""
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i
            while i < n and words[i] == words[i - q]:
                i += 1
            start, length = first - q, i - first + q
            if length >= max(shortest, 2 * q) and smallest_period(words[start : start + length]) == q:
                found.append((start, length, q))
    return sorted(found, key=lambda run: (run[0], run[2]))


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_collapsed(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found_in(words, shortest=12):
    return runs.runs_of(runs.numbered([str(w).encode() for w in words]), shortest)


@pytest.mark.parametrize("shortest", [2, 5, 12])
@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_random_words(letters, shortest):
    r = random.Random(letters * 100 + shortest)
    for _ in range(150):
        words = [r.randrange(letters) for _ in range(r.randrange(60))]
        assert found_in(words, shortest) == plain_runs(words, shortest)


def test_random_repetitions():
    """Nested, neighbouring and overlapping repetitions of all periods."""
    r = random.Random(4)
    for _ in range(400):
        words = []
        while len(words) < r.randrange(20, 260):
            part = [r.randrange(r.choice([2, 4, 40])) for _ in range(r.randrange(1, 25))]
            if r.random() < 0.4:
                part = part * r.randrange(1, 5) + part[: r.randrange(len(part) + 1)]
            words += part * r.randrange(1, 7)
            if words and r.random() < 0.3:
                words[r.randrange(len(words))] = -1
        assert found_in(words) == plain_runs(words)


@pytest.mark.parametrize(
    "words",
    [
        ([0] * 30 + [1]) * 9,
        ([0] * 12 + [1]) * 8 + [0] * 40,
        (([0, 1] * 8 + [2]) * 4 + [3]) * 4,
        ([0, 0, 1] * 6 + [2]) * 7 + [0, 0, 1] * 9,
        [*range(50)] * 2 + [*range(49)],
        [0] * 11,
        [0] * 12,
        [*range(6)] * 2,
        [*range(5)] * 2 + [0],
        [*range(5)] * 2 + [0, 1],
    ],
)
def test_awkward_texts(words):
    assert found_in(words) == plain_runs(words)


def test_strings_of_fibonacci():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert found_in(b) == plain_runs(b)


def test_long_periodic_texts_stay_cheap():
    words = runs.numbered(runs.words_of(LONG))
    assert runs.runs_of(words) == [(0, 120_000, 3)]
    block = ([0] * 300 + [1]) * 40
    assert len(found_in(block)) == 41


def test_kept_words():
    words = list("abcabcabcabcaxyyyyyyyyyyyyy")
    own = found_in(words)
    assert own == [(0, 13, 3), (14, 13, 1)]
    mask = runs.kept(len(words), own)
    assert "".join(np.array(words)[mask]) == "abcxy" and plain_collapsed(words, own) == "a b c x y"


def test_documents_of_all_kinds(spark):
    texts = TEXTS | {20: "a b " * 9, 21: "É é É é " * 6, 22: "A a " * 6, 23: "no\x1cbreak " * 12}
    rows = by(runs.find_runs(documents(spark, texts), "doc_id", "text"))
    assert set(rows) == set(texts)
    for i, text in texts.items():
        words = plain_words(text)
        expected = plain_runs(words) if i != 7 else [(0, 120_000, 3)]
        assert rows[i].n_words == len(words)
        assert [tuple(run) for run in rows[i].runs] == expected
        if i != 7:
            assert rows[i].collapsed == plain_collapsed(words, expected)
    assert rows[7].collapsed == "one more word end"
    assert rows[23].runs and rows[20].collapsed == "a b"
    assert runs.find_runs(empty(spark), "doc_id", "text").count() == 0
    nulls = spark.createDataFrame([(None, "a " * 20), (None, None)], "doc_id long, text string")
    assert sorted(r.n_words for r in runs.find_runs(nulls, "doc_id", "text").collect()) == [0, 20]


def planted(doc_id, text):
    words, h = plain_words(text), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_planted_runs(spark):
    texts = {i: " ".join(f"w{k}\t" for k in range(i % 37)) for i in range(300)} | {-5: "a b", 10**12: "x y z " * 9}
    rows = by(runs.with_planted_runs(documents(spark, texts, ()), "doc_id", "text"))
    assert {i: plain_words(r.text) for i, r in rows.items()} == {i: planted(i, t) for i, t in texts.items()}
    nulls = spark.createDataFrame([(None, "a b"), (3, None)], "doc_id long, text string")
    assert sorted((tuple(r) for r in runs.with_planted_runs(nulls, "doc_id", "text").collect()), key=repr) == [(3, None), (None, "a b")]


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = registered.queries()["op13_periodic_runs"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    assert any(r.n_runs for r in rows)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for r in rows:
        words = planted(r.doc_id, texts[r.doc_id])
        own = found_in(words)
        if len(words) < 1500:
            assert own == plain_runs(words)
        best = max(own, key=lambda run: (run[1], -run[0], -run[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(own), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if own else None)
        assert r.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in own))
        assert r.collapsed_sha256 == sha(plain_collapsed(words, own))
