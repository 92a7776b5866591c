import random
import zlib

import numpy as np
import pytest
from helpers import TEXTS, by, documents, empty
from pyspark.sql import functions as F

from tablescope.llm import quality


def corpus(n=200, seed=3):
    """Texts and labels: prose, and prose with marks, capitals or bars."""
    r = random.Random(seed)
    words = ["of", "the", "and", "river", "stone", "light", "moving", "under", "window", "paper"]
    texts, labels = {}, {}
    for i in range(n):
        lines = [" ".join(r.choice(words) for _ in range(r.randint(5, 15))) + "." for _ in range(r.randint(2, 6))]
        text, labels[i] = "\n".join(lines), 1
        if i % 4 == 0:
            labels[i] = 0
            text = [text.upper() + "!!", text.replace(" ", "### "), text.replace(" ", " | ")][i // 4 % 3]
        texts[i] = text
    return texts, labels


def label_frame(spark, labels):
    rows = [(i, q, 0, "x") for i, q in labels.items()]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def fitted(spark, texts, labels, **options):
    rows = quality.training_rows(documents(spark, texts, ()), label_frame(spark, labels), "doc_id", "text", "quality", **options)
    return rows, quality.fit(rows, "text", "label")


def test_held_out_rows_are_never_learnt(spark):
    texts, labels = corpus()
    rows, _ = fitted(spark, texts, labels)
    assert {r._key for r in rows.collect()} == {i for i in texts if zlib.crc32(str(i).encode()) % 5}
    rows, _ = fitted(spark, texts, labels, rows=40)
    assert 15 < rows.count() <= 80


def test_moments_are_those_of_all_rows(spark):
    texts, labels = corpus()
    _, model = fitted(spark, texts, labels)
    chosen = [i for i in texts if zlib.crc32(str(i).encode()) % 5]
    x = quality.matrix(texts[i] for i in chosen)
    y = np.array([labels[i] for i in chosen])
    for c in (0, 1):
        assert np.allclose(model.means[c], x[y == c].mean(axis=0))
        assert np.allclose(model.covariances[c], model.covariances[c].T)
        assert np.linalg.eigvalsh(model.covariances[c]).min() > 0
    # The score against the density written out in full.
    logs = []
    for c in (0, 1):
        gap = x - model.means[c]
        inverse = np.linalg.inv(model.covariances[c])
        logs.append(-0.5 * ((gap @ inverse * gap).sum(axis=1) + np.linalg.slogdet(model.covariances[c])[1]))
    words = np.array([len(texts[i].split()) for i in chosen])
    odds = quality.TEMPER * words / (words + quality.SHORT) * (logs[1] - logs[0]) + np.log(model.priors[1] / model.priors[0])
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-np.clip(odds, -700, 700))))


def test_held_out_accuracy(spark):
    texts, labels = corpus(400)
    _, model = fitted(spark, texts, labels)
    rows = by(quality.score(documents(spark, texts, ()), "doc_id", "text", model))
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(rows[i].score >= 0.3) == labels[i] for i in held]) > 0.95


def test_all_kinds_of_texts_have_a_score(spark):
    _, model = fitted(spark, *corpus())
    rows = by(quality.score(documents(spark), "doc_id", "text", model))
    assert all(0 <= rows[i].score <= 1 for i in TEXTS)
    assert rows[2].score == rows[3].score == pytest.approx(model.priors[1])
    column = documents(spark).select("doc_id", quality.score_column(F.col("text"), model).alias("score"))
    assert {i: r.score for i, r in by(column).items()} == {i: r.score for i, r in rows.items()}


@pytest.mark.parametrize("labels", [{}, {1: 1}, {1: 0, 2: 0}, {1: None, 2: 7}, {None: 1}])
def test_few_or_no_labels(spark, labels):
    texts = {1: "a b c", 2: "d e f"}
    _, model = fitted(spark, texts, labels)
    scores = model.scores(quality.matrix(["a b c", None]))
    assert np.isfinite(scores).all() and ((scores > 0) & (scores < 1)).all()


def test_empty_frames(spark):
    _, model = fitted(spark, *corpus())
    assert quality.score(empty(spark), "doc_id", "text", model).count() == 0


def test_statistics_do_not_fail_on_odd_texts():
    odd = ["", None, "\n\n", " ", "|", "é", "\x00", "🙂" * 1000, "A" * 10_000, "a\n" * 10_000]
    assert np.isfinite(quality.matrix(odd)).all()
