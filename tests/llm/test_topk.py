import math
import random

import pytest
from pyspark.sql import functions as F

from tablescope.llm import topk

SCHEMA = "vec_id long, embedding array<float>, id string, rank string, score string, n int"


def brute(rows, k=10):
    good = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in good:
        if q % 100 == 0:
            scores = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a)]
            out += [(q, place, i, -s) for place, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def found(spark, rows, k=10):
    df = spark.createDataFrame([(i, v, "x", "y", "z", 1) for i, v in rows], SCHEMA)
    got = topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, k)
    return sorted((r.query_id, r.rank, r.id, r.score) for r in got.collect())


def vectors(n, dim=6, seed=1, values=None):
    r = random.Random(seed)
    draw = (lambda: r.choice(values)) if values else (lambda: r.randint(-2048, 2048) / 1024)
    return [(i, [draw() for _ in range(dim)]) for i in range(n)]


def test_random_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    rows = vectors(450)
    assert found(spark, rows) == brute(rows)


def test_ties_go_to_smaller_ids(spark):
    rows = vectors(320, dim=2, values=[0.0, 1.0])
    assert found(spark, rows) == brute(rows)


def test_rows_that_take_no_part_and_few_candidates(spark):
    rows = [(0, [1.0, 2.0]), (100, [0.5, -0.25]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0])]
    rows += [(4, [float("inf"), 1.0]), (5, []), (6, [3.0, 3.0]), (None, [1.0, 1.0]), (200, [1.0, 1.0, 1.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, []) == []


def test_repeated_rows_are_candidates_of_their_own(spark):
    got = found(spark, [(0, [1.0]), (7, [1.0]), (7, [1.0]), (8, [2.0]), (0, [1.0])], k=3)
    assert got == [(0, 1, 8, 2 * 1024**2), (0, 2, 7, 1024**2), (0, 3, 7, 1024**2)]


def test_scores_beyond_doubles_are_refused(spark):
    with pytest.raises(Exception, match="exact double"):
        found(spark, [(0, [1e6]), (1, [1e6])])
