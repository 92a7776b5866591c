"""Periodic runs of words: an online sparse diagonal DP over each text.

A run is a stretch of words that repeats with a smallest period and cannot be longer on either
side. Word i that equals word i - q lies on diagonal q; a run with period q is a piece of that
diagonal, as long as the run without its first period. The words are read once, in order. Each
word's earlier occurrences name the diagonals that go on or begin there; a diagonal that has no
match at the next word ends, and if it was long enough its run is emitted at once.

Three exact rules keep the table of active diagonals sparse:

- A run needs a diagonal of ``shortest / 2`` words at least (see ``least_match``). So a word counts
  as an occurrence of another only where that many words from it on are equal, and positions whose
  stretch stands nowhere else are passed over.
- No period is longer than half a text.
- While a stretch with period p, two periods long or longer, is being read, a new diagonal q >= 2p
  whose earlier side lies in that stretch too is not followed. If q is a multiple of p, it begins
  and ends with the stretch, whose smallest period is smaller than q. Else its part in the stretch
  is shorter than p, and no run by itself. If the diagonal leaves the stretch, it is noticed there,
  and its matches so far are counted backwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORTEST = 12
# So many earlier occurrences are looked up at once; the third rule below is for more.
FEW = 8
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return (text or "").encode().split()


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers."""
    numbers = {word: n for n, word in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))


def least_match(shortest: int) -> int:
    """How many words of a run at least equal the one a period before.

    That is length - q with length >= max(shortest, 2q): least where shortest = 2q.
    """
    return max(1, -(-shortest // 2))


def stretches(ids: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the stretches of ``size`` words from each position on, equal where they are equal."""
    have, width = ids, 1
    while width < size:
        step = min(width, size - width)
        left, right = have[: len(have) - step], have[step:]
        _, have = np.unique(left * (int(have.max()) + 1) + right, return_inverse=True)
        width += step
    return have


def repeats(ids: np.ndarray, size: int) -> bool:
    """False only if no stretch of ``size`` words stands twice: then all their hashes differ."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    n = len(ids) - size + 1
    total = mixed[:n].copy()
    for offset in range(1, size):
        total = total * np.uint64(0xBF58476D1CE4E5B9) + mixed[offset : offset + n]
    total.sort()
    return bool((total[1:] == total[:-1]).any())


def primitive(ids: np.ndarray, start: int, length: int, period: int) -> bool:
    """Whether no smaller period fits; in two periods and more, the smallest divides all others."""
    own, rest, factor = ids[start : start + length], period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            shorter = period // factor
            if np.array_equal(own[shorter:], own[:-shorter]):
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


class Diagonals:
    """The active diagonals of one text: lag and first match of each."""

    def __init__(self, ids: np.ndarray, shortest: int):
        self.ids, self.shortest, self.size = ids, shortest, least_match(shortest)
        self.lags = np.zeros(0, dtype=np.int64)
        self.begun = np.zeros(0, dtype=np.int64)
        self.live = np.zeros(len(ids) // 2 + 1, dtype=bool)  # by lag: is it in the table?
        self.found: list[tuple[int, int, int]] = []

    def end(self, over: np.ndarray, last: int) -> None:
        """Diagonals of the mask ``over`` had their last match at ``last``; emit those that are runs."""
        for lag, begun in zip(self.lags[over].tolist(), self.begun[over].tolist()):
            start, length = begun - lag, last + self.size - begun + lag
            if length >= max(self.shortest, 2 * lag) and primitive(self.ids, start, length, lag):
                self.found.append((start, length, lag))
        self.live[self.lags[over]] = False
        self.lags, self.begun = self.lags[~over], self.begun[~over]

    def starts_stretch(self, here: np.ndarray, i: int) -> bool:
        """Whether the occurrence of ``i`` that a diagonal may begin with is the first word of a
        stretch whose two periods have been read: the third rule leaves it out."""
        for begun, lag in zip(self.begun[:FEW].tolist(), self.lags[:FEW].tolist()):
            first = begun - lag
            if first <= i - 2 * lag and i - begun + self.size >= lag and here[first] == here[i]:
                return first == 0 or here[first - 1] != here[i - 1]
        return False

    def new_lags(self, i: int, earlier: np.ndarray) -> np.ndarray:
        """Lags to the occurrences before ``i`` (ascending) that are not left out by the rules above."""
        if len(earlier) > FEW:
            earlier = earlier[np.searchsorted(earlier, i - len(self.live) + 1) :]
            known = i - self.begun + self.size >= self.lags  # two periods have been read
            # One pass per stretch; the furthest first, as it leaves out most.
            for first, lag in sorted(zip((self.begun - self.lags)[known].tolist(), self.lags[known].tolist())):
                a, b = np.searchsorted(earlier, [first, i - 2 * lag + 1])
                if a < b:
                    earlier = np.concatenate([earlier[:a], earlier[b:]])
        lags = i - earlier
        lags = lags[lags < len(self.live)]
        return lags[~self.live[lags]]


def occurrences(here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions by what stands there; where each position's equals begin in that order; and how
    many of them come before it."""
    order = np.argsort(here, kind="stable")
    sorted_ = here[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(here)]]))
    first, rank = np.empty(len(here), dtype=np.int64), np.empty(len(here), dtype=np.int64)
    first[order] = np.repeat(starts, sizes)
    rank[order] = np.arange(len(here))
    return order, first, rank - first


def runs_of(ids: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    size = least_match(shortest)
    if len(ids) < shortest or not repeats(ids, size):
        return []
    here = stretches(ids, size)
    times = np.bincount(here)
    if times.max() == 1:
        return []
    order, first, earlier_ones = occurrences(here)
    # Where all earlier occurrences follow one and the same stretch, no diagonal begins.
    _, _, after_same = occurrences(here[:-1] * (int(here.max()) + 1) + here[1:]) if len(here) > 1 else (0, 0, [])
    begins = np.concatenate([[1], earlier_ones[1:] - after_same])  # how many may begin at each position
    table, last = Diagonals(ids, shortest), -1
    busy = np.flatnonzero(times[here] > 1)
    for i, beginning in zip(busy.tolist(), begins[busy].tolist()):
        if len(table.lags):
            over = here[i - table.lags] != here[i] if i == last + 1 else np.ones(len(table.lags), dtype=bool)
            if over.any():
                table.end(over, last)
                beginning = len(ids)  # diagonals that were not followed may have to be
        last = i
        if not beginning or not earlier_ones[i] or (beginning == 1 and table.starts_stretch(here, i)):
            continue
        earlier = order[first[i] : first[i] + earlier_ones[i]]
        lags = table.new_lags(i, earlier)
        if len(lags):
            begun = np.full(len(lags), i)
            back = np.flatnonzero((i - 1 - lags >= 0) & (here[i - 1 - lags] == here[i - 1])) if i else []
            for n in back:  # not followed so far: count its matches backwards
                at, lag = i, int(lags[n])
                while at - 1 - lag >= 0 and here[at - 1] == here[at - 1 - lag]:
                    at -= 1
                begun[n] = at
            table.live[lags] = True
            table.lags = np.concatenate([table.lags, lags])
            table.begun = np.concatenate([table.begun, begun])
    table.end(np.ones(len(table.lags), dtype=bool), last)
    return sorted(table.found, key=lambda run: (run[0], run[2]))


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """A mask of n words: those that no run holds after its first period."""
    depth = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def find_runs(df: DataFrame, key: str, text: str, shortest: int = SHORTEST) -> DataFrame:
    """key, n_words, runs (array of start, length, period) and collapsed of every row.

    A run has ``shortest`` words or more and two periods or more. ``collapsed`` joins by one space
    the words that no run holds after its first period. A null, empty or blank text has no words,
    no runs and an empty collapsed text. Whole texts are read. Repeated rows each give a row, an
    empty frame none; null keys stay, and further columns are not read. No shuffle.
    """
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = df.schema[key].dataType.simpleString()

    def collapsed(words, runs):
        if not runs:
            return b" ".join(words)
        return b" ".join([words[i] for i in np.flatnonzero(kept(len(words), runs)).tolist()])

    def found(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                counts, runs, texts = [], [], []
                for text in part.column(1):
                    words = words_of(text.as_py())
                    own = runs_of(numbered(words), shortest)
                    counts.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), run)) for run in own])
                    texts.append(collapsed(words, own).decode())
                kinds = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(runs, kinds), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(found, f"key {kind}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("key", key)


def with_planted_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and text, where every tenth row by a hash of its key repeats its words from some word on.

    With h the CRC-32 of the decimal key and g = h div 10, rows with h divisible by 10 have each
    word from word a = g mod n on replaced by the word (i - a) mod p behind a, where
    p = 1 + (n - a) div (3 + g mod 8). Other rows, and those with a null key or no words, stay.
    """
    crc = F.crc32(F.col(key).cast("string").cast("binary"))
    rows = df.select(df[key].alias(key), df[text].alias("text"), crc.alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")))
    rows = rows.withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = "transform(words, (w, i) -> if(i < a, w, words[a + (i - a) % p]))"
    planted = F.when(F.col("a").isNotNull(), F.expr(f"concat_ws(' ', {again})"))
    return rows.select(key, F.coalesce(planted, F.col("text")).alias("text"))


def digests(found: DataFrame, key: str) -> DataFrame:
    """The number of runs, the longest of them, and digests of all runs and of the collapsed text."""
    best = "array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))"
    spelled = "concat_ws('', transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'))"
    rows = found.withColumn("best", F.expr(best)).withColumn("spelled", F.expr(spelled))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return rows.select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(F.col("spelled").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
