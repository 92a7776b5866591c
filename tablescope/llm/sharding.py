"""Sharding by a Feistel permutation over global row numbers.

Rows are numbered 0 to n-1 in the order of their key. A balanced Feistel network permutes the
smallest domain of 4^b numbers that holds n; a number that leaves 0 to n-1 walks on along its
cycle until it is back, so the whole is a permutation of 0 to n-1. With place = permuted
number, shard = place mod shards and slot = place div shards: shard sizes differ by one row at
most, slots have no gaps, and both follow from the row number, n and the seed alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import in_order

ROUNDS = 6


def round_keys(seed: int) -> np.ndarray:
    return mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def half_bits(n: int) -> int:
    """Bits of one half of the smallest Feistel domain of at least ``n`` numbers."""
    return max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)


def network(x: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    for key in keys:
        left, right = right, left ^ (mixed(right + key) & mask)
    return left << shift | right


def permuted(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where the row numbers ``x`` (each below ``n``) go among 0 to n-1."""
    bits, keys = half_bits(n), round_keys(seed)
    out = network(x.astype(np.uint64), bits, keys)
    walking = np.flatnonzero(out >= n)
    while walking.size:  # under 4 steps on average: the domain holds less than 4n numbers
        out[walking] = network(out[walking], bits, keys)
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def shard_rows(df: DataFrame, key: str, text: str, shards: int, seed: int = 42) -> DataFrame:
    """One row per row of ``df``: key, size, text_crc32, row_number, place, shard, slot.

    ``size`` is the text's UTF-8 bytes plus 8 and ``text_crc32`` its CRC-32; a null text has
    size 8 and the CRC of no bytes. Rows are numbered by key (null first), then CRC and size,
    so repeated rows are interchangeable. Further columns are not read. An empty frame gives
    no rows. Texts are reduced to two numbers before anything is shuffled.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    narrow = df.select(
        df[key].alias("key"),
        (F.coalesce(F.octet_length(df[text]), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(df[text], F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = in_order(narrow, ["key", "text_crc32", "size"], label="shards")
    n = rows.agg(F.max("position")).first()[0]
    n = 0 if n is None else n + 1

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), n, seed))

    return (
        rows.withColumn("place", place("position"))
        .withColumn("shard", (F.col("place") % shards).cast("int"))
        .withColumn("slot", F.expr(f"place div {shards}"))
        .withColumnsRenamed({"key": key, "position": "row_number"})
    )
