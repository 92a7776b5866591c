"""Quality classifier: a regularised quadratic discriminant over text statistics.

Each text is reduced to a dozen statistics that are transformed towards normal distributions.
Both classes get a mean and a covariance matrix; the matrix is shrunk towards the pooled one and
towards its own diagonal, so it stays positive definite with few or constant rows. The score is
the posterior probability of the good class from the difference of the log densities, worked out
with the Cholesky factors that the model caches.

Labels enter only through ``fit``. It adds up counts, sums and products per class and task, so
the driver receives a number of values that depends on the number of statistics alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of the pooled covariance and of the diagonal in each class's covariance.
POOLED, DIAGONAL = 0.05, 0.05
# Added to every variance, for statistics that are constant.
FLOOR = 1e-3
# Log-density differences are damped before the posterior, for the statistics overlap.
TEMPER = 0.5
# With so many words the densities count by half; a text without words has the prior's score.
SHORT = 20
# Things that every share gets on both sides, so that short texts say little.
SMOOTHING = 2.0
# Labels that a model is fitted to at most, about.
FIT_ROWS = 20_000

STATISTICS = (
    "log_words", "word_length", "long_words", "upper", "digits", "marks", "odd_marks", "pipes", "not_letters",
    "variety", "top_word", "line_length", "line_repeats", "ending", "entropy",
)


def kinds_of_bytes() -> np.ndarray:
    """Byte -> 0 others, 1 lower, 2 upper, 3 digit, 4 common mark, 5 other mark, 6 white space."""
    kinds = np.zeros(256, dtype=np.int64)
    for b in range(128):
        c = chr(b)
        kinds[b] = (
            1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c in ".,;:'-()" else
            6 if c.isspace() else 5 if c.isprintable() else 0
        )
    return kinds


KINDS = kinds_of_bytes()


def odds(share: float, n: int) -> float:
    """A share of n things as smoothed log odds, which spread out near 0 and 1."""
    return float(np.log((share * n + SMOOTHING) / ((1 - share) * n + SMOOTHING)))


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of ``STATISTICS``; null counts as empty."""
    data = (text or "").encode()
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    kinds = np.bincount(KINDS, weights=counts, minlength=7)
    size, words = max(1, len(data)), data.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    seen: dict[bytes, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    lines = [line for line in data.split(b"\n") if line.strip()]
    different = len(set(lines))
    letters = kinds[0] + kinds[1] + kinds[2]
    shares = counts[counts > 0] / size
    mean, sd = lengths.mean(), lengths.std()
    return [
        np.log1p(len(words)),
        np.log1p(mean),
        np.log1p(sd),
        odds(kinds[2] / max(1, letters), max(1, letters)),
        odds(kinds[3] / size, size),
        odds(kinds[4] / size, size),
        odds(kinds[5] / size, size),
        odds(min(1.0, counts[ord("|")] / n), n),
        odds(1 - (letters + kinds[6]) / size, size),
        np.log((len(seen) + 0.5) / (n + 0.5)) / np.log(n + 2),
        odds(max(seen.values(), default=0) / n, n),
        np.log1p(len(data) / max(1, len(lines))),
        np.log((different + 0.5) / (len(lines) + 0.5)),
        odds(sum(line.rstrip().endswith((b".", b"!", b"?")) for line in lines) / max(1, len(lines)), max(1, len(lines))),
        float(-(shares * np.log(shares)).sum()),
    ]


def matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(STATISTICS))


@dataclass
class Model:
    """Means and covariances of the classes 0 and 1, with their Cholesky factors."""

    priors: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    factors: list = field(init=False)
    log_dets: list = field(init=False)

    def __post_init__(self):
        lower = [np.linalg.cholesky(c) for c in self.covariances]
        self.factors = [np.linalg.inv(f) for f in lower]
        self.log_dets = [2 * np.log(np.diag(f)).sum() for f in lower]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior probability of class 1 for each row."""
        logs = [
            -0.5 * ((((x - mean) @ factor.T) ** 2).sum(axis=1) + log_det)
            for mean, factor, log_det in zip(self.means, self.factors, self.log_dets)
        ]
        words = np.expm1(x[:, STATISTICS.index("log_words")])
        evidence = TEMPER * words / (words + SHORT)
        difference = evidence * (logs[1] - logs[0]) + np.log(self.priors[1] / self.priors[0])
        return 1 / (1 + np.exp(-np.clip(difference, -700, 700)))


def fit(df: DataFrame, text: str, label: str) -> Model:
    """A model from rows with label 0 or 1; other labels and nulls take no part.

    With no row of a class, that class has the other's moments, so the scores are the prior.
    """
    d = len(STATISTICS)
    rows = df.filter(df[label].isin(0, 1)).select(df[text].alias("text"), df[label].cast("int").alias("label"))

    def moments(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = matrix(batch["text"]), batch["label"].to_numpy()
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        c, at = np.nonzero(total)
        yield pd.DataFrame({"class": c, "at": at, "value": total[c, at]})

    parts = rows.mapInPandas(moments, "class int, at int, value double")
    sums = np.zeros((2, 1 + d + d * d))
    for row in parts.groupBy("class", "at").agg(F.sum("value").alias("value")).collect():  # 2 (1 + d + d²) rows
        sums[row["class"], row["at"]] = row["value"]
    return from_moments(sums)


def from_moments(sums: np.ndarray) -> Model:
    d = len(STATISTICS)
    n = sums[:, 0]
    if n.sum() == 0:
        return Model(np.full(2, 0.5), np.zeros((2, d)), np.stack([np.eye(d)] * 2))
    if not n.all():
        sums = np.stack([sums[n.argmax()]] * 2)
    counts = sums[:, 0][:, None]
    means = sums[:, 1 : 1 + d] / counts
    spread = sums[:, 1 + d :].reshape(2, d, d) / counts[:, :, None] - means[:, :, None] * means[:, None, :]
    pooled = (spread * counts[:, :, None]).sum(axis=0) / counts.sum()
    shrunk = []
    for own, m in zip(spread, sums[:, 0]):
        # Few rows tell little: a class of as many rows as statistics leans on the pooled matrix by half.
        weight = POOLED + (1 - POOLED) * d / (d + m)
        mixed = (1 - weight) * own + weight * pooled
        mixed = (1 - DIAGONAL) * mixed + DIAGONAL * np.diag(np.diag(mixed))
        shrunk.append(mixed + FLOOR * np.eye(d))
    return Model((n + 1) / (n.sum() + 2), means, np.stack(shrunk))


def score(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """Key and score (0 to 1, higher for class 1) of every row; null and empty texts too.

    Repeated rows each give a row, an empty frame none; only the two columns are read.
    """
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = df.schema[key].dataType.simpleString()

    def scored(batches):
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "score": model.scores(matrix(batch["text"]))})

    return rows.mapInPandas(scored, f"key {kind}, score double").withColumnRenamed("key", key)


def score_column(text: Column, model: Model) -> Column:
    """The score as a column, for filters that keep all columns of their rows."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(matrix(texts)))

    return scored(text)


def held_out(key: Column) -> Column:
    """Every fifth row by the CRC-32 of its key's text; a null key counts as held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int = FIT_ROWS
) -> DataFrame:
    """Texts with labels, without held-out keys; a key that is labelled twice counts twice.

    Of more than ``rows`` labels about as many are taken, by a hash of their key, so the labels
    fit every executor and no text is shuffled.
    """
    chosen = labels.filter(labels[label].isin(0, 1) & ~held_out(labels[key]))
    chosen = chosen.select(labels[key].alias("_key"), labels[label].alias("label"))
    share = rows / max(1, chosen.count())
    if share < 1:
        chosen = chosen.filter(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # At most twice ``rows`` rows of two numbers: the hash takes ``rows`` of them on average.
    chosen = F.broadcast(chosen.limit(2 * rows))
    return docs.select(docs[key].alias("_key"), docs[text].alias("text")).join(chosen, "_key")
