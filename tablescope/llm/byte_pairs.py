"""Byte-level BPE encoding and decoding as a reduction over a tree of text halves.

A text is cut in the middle, again and again, until pieces are short. The pieces are encoded, and
neighbours are joined by encoding a window around their cut anew, until what lies outside provably
stays. Two proofs end a window:

- an edge of the splitting pattern that both neighbours of the edge settle (``EDGE``): nothing
  before it depends on what follows, and matching starts anew there;
- inside a long stretch that the pattern keeps whole, tokens: a sequence of tokens is the encoding
  of its bytes exactly when every two neighbours are the encoding of their own bytes, so it is
  enough that both edges of the window pass that test.

Decoding concatenates up the same kind of tree.
"""

from __future__ import annotations

import base64
import functools
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters (or bytes, inside an unbroken run) of a piece that is encoded at once.
LEAF = 256
# Rows of a batch that leaves Python; texts may be long.
BATCH_ROWS = 256

# Letters and marks for certain, in all versions of Unicode.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁぁ-ゖァ-ヺ一-龥"
# Edges of the splitting pattern for certain. Only white space and a leading blank stand with what
# follows them, so there is one before a space or line break that follows anything but white space
# (some control characters count as white space in one library and not in another: no edge there).
# A match that holds a letter ends before a mark.
EDGE = re.compile(rf"(?<=[^\s\x1c-\x1f])(?=[ \n])|(?<=[{LETTERS}])(?=[!-/:-@\[-`{{-~、。])")
# Runs that the splitting pattern keeps whole.
RUN = re.compile(rf" ?(?:[{LETTERS}]+|[0-9]+)")


class Codec:
    """Encoder and decoder over a file of ranks, one ``base64 rank`` pair per line."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = dict(zip(ranks.values(), ranks.keys()))
        self.size_of = {token: len(data) for token, data in self.bytes_of.items()}
        self.merge = self.encoding._core_bpe.encode_single_piece
        self.neighbours = functools.lru_cache(maxsize=65536)(self._neighbours)

    def _neighbours(self, left: int, right: int) -> bool:
        return self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def encode(self, text: str) -> list[int]:
        if len(text) <= LEAF:
            return self.encoding.encode_ordinary(text)
        middle = len(text) // 2
        return self.join_at(text, middle, self.encode(text[:middle]), self.encode(text[middle:]))

    def join_at(self, text: str, middle: int, left: list[int], right: list[int]) -> list[int]:
        """The encoding of ``text`` from those of its parts before and after ``middle``."""
        first, last = edge_before(text, middle), edge_after(text, middle)
        a, size = len(left), len(text[first:middle].encode())
        while size > 0:
            a -= 1
            size -= self.size_of[left[a]]
        b, size = 0, len(text[middle:last].encode())
        while size > 0:
            size -= self.size_of[right[b]]
            b += 1
        if last - first > 4 * LEAF and RUN.fullmatch(text, first, last):
            window = self.join(left[a:], right[:b])
        else:
            window = self.encoding.encode_ordinary(text[first:last])
        return left[:a] + window + right[b:]

    def encode_run(self, run: bytes) -> list[int]:
        """A run that is one match of the splitting pattern."""
        if len(run) <= LEAF:
            return self.merge(run)
        middle = len(run) // 2
        return self.join(self.encode_run(run[:middle]), self.encode_run(run[middle:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of what two encoded neighbours spell together."""
        if not left or not right or self.neighbours(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            inside = self.merge(b"".join(self.bytes_of[t] for t in left[-i:] + right[:j]))
            left_stays = i >= len(left) or self.neighbours(left[-i - 1], inside[0])
            right_stays = j >= len(right) or self.neighbours(inside[-1], right[j])
            if left_stays and right_stays:
                return left[: max(0, len(left) - i)] + inside + right[j:]
            i = i if left_stays else min(2 * i, len(left))
            j = j if right_stays else min(2 * j, len(right))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def edge_before(text: str, middle: int) -> int:
    """The last certain edge that the characters before ``middle`` settle, or the beginning."""
    reach = 32
    while True:
        found = None
        for found in EDGE.finditer(text, max(0, middle - reach), middle):
            pass
        if found or reach >= middle:
            return found.start() if found else 0
        reach *= 8


def edge_after(text: str, middle: int) -> int:
    """The first certain edge that the characters from ``middle`` on settle, or the end."""
    found = EDGE.search(text, middle + 1)
    return found.start() if found else len(text)


@functools.lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    return Codec(ranks_path, pattern)


def encode(df: DataFrame, key: str, text: str, ranks_path: str, pattern: str) -> DataFrame:
    """Key and ``ids`` (array of int) of every row of ``df``.

    A null or empty text has no ids. Strings of special tokens are ordinary text. Repeated rows
    each give a row; further columns are not read. ``ranks_path`` must exist on every executor.
    There is no shuffle, and whole texts are encoded.
    """
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = df.schema[key].dataType.simpleString()

    def encoded(batches):
        own = codec(ranks_path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                ids = [own.encode(t) if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, type=pa.list_(pa.int32()))], names=["key", "ids"]
                )

    return rows.mapInArrow(encoded, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, ids: str, ranks_path: str, pattern: str) -> DataFrame:
    """``df`` with ``decoded``, the bytes that ``ids`` spell; null ids spell nothing.

    An existing column named ``decoded`` is replaced.
    """
    kept = [name for name in df.columns if name != "decoded"]
    frame = df.select(*kept)
    place = kept.index(ids)

    def spelled(batches):
        own = codec(ranks_path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                found = [own.decode(x) if x else b"" for x in part.column(place).to_pylist()]
                arrays = [*part.columns, pa.array(found, type=pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "decoded"])

    return frame.mapInArrow(spelled, f"{frame.schema.toDDL()}, decoded binary")


def digests(df: DataFrame, key: str, text: str, ranks_path: str, pattern: str) -> DataFrame:
    """Encode and decode every text, and reduce both results to digests."""
    ids = encode(df, key, text, ranks_path, pattern)
    spelled = decode(ids, "ids", ranks_path, pattern)
    return spelled.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
