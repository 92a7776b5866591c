"""Fuzzy name similarity.

``partial_ratio`` is the best normalised Indel similarity, 0 to 100, of the shorter
string against the windows of the longer one: 200 * LCS / (length + window length).
Windows are as long as the shorter string, or shorter at both ends. With equal
lengths both directions are tried. It is case-sensitive.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Send these functions to the executors by value, so the package need not be there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _lcs_lengths(pattern: str, text: str) -> list[int]:
    """LCS length of ``pattern`` with every prefix of ``text``, by bit-parallel rows."""
    places: dict[str, int] = {}
    for index, letter in enumerate(pattern):
        places[letter] = places.get(letter, 0) | (1 << index)
    every = (1 << len(pattern)) - 1
    row, lengths = every, [0]
    for letter in text:
        hits = row & places.get(letter, 0)
        row = ((row + hits) | (row - hits)) & every
        lengths.append(len(pattern) - row.bit_count())
    return lengths


def _best_window(short: str, long: str) -> float:
    """Every window that starts at some place: the full one, and at the start all prefixes."""
    size, best = len(short), 0.0
    for start in range(len(long)):
        window = long[start : start + size]
        lengths = _lcs_lengths(short, window)
        ends = range(1, len(window) + 1) if start == 0 else (len(window),)
        for end in ends:
            best = max(best, 200.0 * lengths[end] / (size + end))
    return best


def partial_ratio_of(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = sorted((a, b), key=len)
    best = _best_window(short, long)
    return max(best, _best_window(long, short)) if len(a) == len(b) else best


# Names up to this length fit the bits of one machine word.
WORD = 64
# Windows that are worked on together.
WINDOWS = 200_000


def _codes(names: list[str], fill: int) -> np.ndarray:
    """Code points of names as rows, filled up on the right."""
    wide = np.full((len(names), max(map(len, names))), fill, dtype=np.int64)
    for row, name in enumerate(names):
        wide[row, : len(name)] = [ord(letter) for letter in name]
    return wide


def _best_windows(short: list[str], long: list[str]) -> np.ndarray:
    """``_best_window`` of many pairs at once; all windows advance letter by letter together."""
    m, n = (np.array([len(x) for x in names]) for names in (short, long))
    patterns, texts = _codes(short, -1), _codes(long, -2)
    powers = np.left_shift(np.uint64(1), np.arange(patterns.shape[1], dtype=np.uint64))
    places = np.zeros(texts.shape, dtype=np.uint64)  # where each letter of the longer name stands in the shorter
    for k, power in enumerate(powers):
        places |= np.where(patterns[:, k : k + 1] == texts, power, np.uint64(0))
    pair = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    every = np.uint64(2**64 - 1) >> (WORD - m[pair]).astype(np.uint64)
    size = np.minimum(m[pair], n[pair] - start)
    row, best = every.copy(), np.zeros(len(n))
    for step in range(int(size.max())):
        at = np.flatnonzero(step < size)
        hits = row[at] & places[pair[at], start[at] + step]
        row[at] = ((row[at] + hits) | (row[at] - hits)) & every[at]
        ends = at[(start[at] == 0) | (size[at] == step + 1)]
        common = m[pair[ends]] - np.bitwise_count(row[ends]).astype(np.int64)
        np.maximum.at(best, pair[ends], 200.0 * common / (m[pair[ends]] + step + 1))
    return best


def partial_ratios(pairs: list[tuple[str | None, str | None]]) -> list[float | None]:
    """``partial_ratio_of`` of many pairs; only names longer than a machine word go one by one."""
    scores: list[float | None] = [None] * len(pairs)
    jobs: list[tuple[int, str, str]] = []
    for at, (a, b) in enumerate(pairs):
        if not a or not b or min(len(a), len(b)) > WORD:
            scores[at] = partial_ratio_of(a, b)
            continue
        short, long = sorted((a, b), key=len)
        scores[at] = 0.0
        jobs.append((at, short, long))
        if len(a) == len(b):
            jobs.append((at, long, short))
    begin = 0
    while begin < len(jobs):
        end, windows = begin, 0
        while end < len(jobs) and (end == begin or windows + len(jobs[end][2]) <= WINDOWS):
            windows += len(jobs[end][2])
            end += 1
        best = _best_windows([j[1] for j in jobs[begin:end]], [j[2] for j in jobs[begin:end]])
        for (at, _, _), score in zip(jobs[begin:end], best.tolist()):
            scores[at] = max(scores[at], score)
        begin = end
    return scores


@F.pandas_udf(T.DoubleType())
def _partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = list(dict.fromkeys(zip(a, b)))
    scores = dict(zip(pairs, partial_ratios(pairs)))
    return pd.Series([scores[pair] for pair in zip(a, b)], dtype="float64")


def partial_ratio(a, b) -> Column:
    """Similarity of two name columns; call it on candidate pairs only."""
    return _partial_ratio(a, b)
