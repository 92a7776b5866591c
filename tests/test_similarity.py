import random

import pytest

from tablescope.functions.similarity import partial_ratio, partial_ratio_of, partial_ratios


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
    return row[-1]


def plain_ratio(a, b):
    """Every window of the longer string, one by one."""
    best = 0.0
    sides = [(a, b)] if len(a) < len(b) else [(b, a)] if len(b) < len(a) else [(a, b), (b, a)]
    for short, long in sides:
        m = len(short)
        windows = [long[i : i + m] for i in range(len(long))] + [long[:k] for k in range(1, m)]
        for w in windows:
            best = max(best, 200.0 * lcs(short, w) / (m + len(w)))
    return best


def words(seed, count, letters="abcde_", longest=11):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))) for _ in range(count)]


def test_known_values():
    assert partial_ratio_of("key", "key") == 100
    assert partial_ratio_of("cust_id", "id") == 100
    assert partial_ratio_of("abc", "xyz") == 0
    assert partial_ratio_of("Key", "key") < 100
    assert partial_ratio_of("", "") == 100 and partial_ratio_of("", "x") == 0
    assert partial_ratio_of(None, "x") is None
    # "_custkey" against "o_custkey": 200 * 8 / 17.
    assert partial_ratio_of("o_custkey", "c_custkey") == pytest.approx(1600 / 17)


def test_matches_every_window():
    names = words(3, 120)
    for a, b in zip(names, reversed(names)):
        assert partial_ratio_of(a, b) == pytest.approx(plain_ratio(a, b))


def test_many_pairs_at_once():
    names = words(3, 150) + words(4, 40, "ab", 90) + ["", None, "x" * 64, "x" * 63 + "y", "x" * 65, "é🙂_key", "key"]
    pairs = list(zip(names, reversed(names))) + [(a, b) for a in names[-8:] for b in names[-8:]]
    for (a, b), score in zip(pairs, partial_ratios(pairs)):
        assert score == (None if a is None or b is None else pytest.approx(partial_ratio_of(a, b))), (a, b)
    assert partial_ratios([]) == []


def test_column_function(spark):
    pairs = [("o_custkey", "c_custkey"), ("abc", "xyz"), (None, "x")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    found = frame.select("a", partial_ratio("a", "b").alias("score")).collect()
    assert [r.score for r in found] == [pytest.approx(1600 / 17), 0.0, None]
