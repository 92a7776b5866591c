"""Packing along a space-filling curve.

A document's token counts, hashed into signed buckets and scaled to length one, are projected to
a few dimensions; its place on the Hilbert curve through those dimensions is its sort key. All
documents are range-sorted by it, their token streams are laid end to end along the curve, and
the whole is cut every ``length`` tokens. So neighbours in a sequence are alike, only the very
last sequence is padded, and documents are cut where sequences end.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablescope.llm.common import in_order, stored

BUCKETS = 256
DIMENSIONS = 4
LEVELS = 12
SEED = 42
# Words whose ids a Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 500_000
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Stands for the end of a word; no UTF-8 text holds this byte.
WORD_END = b"\xff"


def letters_of_bytes() -> dict[str, int]:
    """The characters that byte-level vocabularies spell bytes with: printable ones stand for
    themselves, the others for the characters from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def plain(stem: str) -> bool:
    """Letters that normalising and lower case leave letters, so that marks after them stay apart."""
    return stem.isalpha() and (
        stem.isascii() or (unicodedata.is_normalized("NFC", stem) and stem.lower().isalpha())
    )


class Words(dict):
    """Token ids (packed) of what stands between white space.

    The tokenizer's splitting never crosses white space, nor do its added tokens (which are ids of
    their own wherever a text spells them), so words can be encoded one by one, and marks at a
    word's end apart from it. Where the vocabulary marks ends of words, plain words of
    letters are merged by rank with the end mark as one more byte, which is much quicker than
    the tokenizer's way through normalisers; everything else goes to the tokenizer itself.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4"
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        for added in spec["added_tokens"]:
            if added["content"].split() != [added["content"]] or added["lstrip"] or added["rstrip"] or added["normalized"]:
                raise ValueError(f"the added token {added['content']!r} does not stay inside a word")
        suffix, self.merge = model.get("end_of_word_suffix"), None
        if suffix:
            spelled = letters_of_bytes()
            ranks = {}
            for token, rank in model["vocab"].items():
                body = token.removesuffix(suffix)
                if all(letter in spelled for letter in body):
                    whole = bytes(map(spelled.__getitem__, body))
                    ranks[whole + WORD_END if body != token else whole] = rank
            own = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
            self.merge = own._core_bpe.encode_single_piece

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[word] = self.encoded(word)
        return ids

    def encoded(self, word: bytes) -> bytes:
        text = word.decode()
        stem = text.rstrip(MARKS)
        if self.merge and plain(stem):
            low = stem.lower() if stem.isascii() else stem
            if len(stem) < len(text) or low != stem:
                return self[low.encode()] + (self[text[len(stem) :].encode()] if len(stem) < len(text) else b"")
            if low.isascii() or low == low.lower():
                return np.array(self.merge(word + WORD_END), dtype=self.kind).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()


@functools.lru_cache(maxsize=2)
def words_of(tokenizer_path: str) -> Words:
    """One memory per Python worker and tokenizer."""
    return Words(tokenizer_path)


@functools.lru_cache(maxsize=2)
def projection(ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of each token id, and the matrix from buckets to dimensions."""
    random = np.random.default_rng(SEED)
    x = (np.arange(ids, dtype=np.uint64) + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    bucket = ((x >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)
    sign = np.where((x >> np.uint64(39)) & np.uint64(1), 1.0, -1.0)
    return bucket, sign, random.standard_normal((BUCKETS, DIMENSIONS))


def coordinates(documents: list[np.ndarray], ids: int) -> np.ndarray:
    """Each document's cell along each dimension; without tokens it is in the middle."""
    bucket, sign, matrix = projection(ids)
    vectors = np.zeros((len(documents), BUCKETS))
    for row, tokens in enumerate(documents):
        counts = np.bincount(tokens, minlength=1)
        seen = np.flatnonzero(counts)
        vectors[row] = np.bincount(bucket[seen], weights=sign[seen] * np.log1p(counts[seen]), minlength=BUCKETS)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    places = (vectors / np.where(lengths > 0, lengths, 1)) @ matrix
    shares = 1 / (1 + np.exp(-1.702 * places))  # places are about standard normal
    return np.minimum((shares * (1 << LEVELS)).astype(np.int64), (1 << LEVELS) - 1)


def hilbert_key(cells: np.ndarray) -> np.ndarray:
    """Position of each row of cells on the Hilbert curve of ``LEVELS`` bits per dimension.

    Bits of the axes are worked off from the highest: where an axis lies in the upper half, lower
    bits of the first axis are mirrored, else exchanged with that axis; a Gray decoding follows.
    """
    x = cells.copy()
    d = x.shape[1]
    for bit in range(LEVELS - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in range(d):
            upper = (x[:, axis] >> bit) & 1 == 1
            swap = (x[:, 0] ^ x[:, axis]) & low
            x[:, axis] ^= np.where(upper, 0, swap)
            x[:, 0] ^= np.where(upper, low, swap)
    for axis in range(1, d):
        x[:, axis] ^= x[:, axis - 1]
    flips = np.zeros(len(x), dtype=np.int64)
    for bit in range(LEVELS - 1, 0, -1):
        flips ^= np.where((x[:, d - 1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flips[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for bit in range(LEVELS - 1, -1, -1):
        for axis in range(d):
            key = key << 1 | (x[:, axis] >> bit) & 1
    return key


def tokenised(df: DataFrame, key: str, text: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """key, tokens (packed ids, the end id last), n and curve of every row; null counts as empty."""
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = df.schema[key].dataType.simpleString()

    def encoded(batches):
        words = words_of(tokenizer_path)
        end = np.array([end_id], dtype=words.kind).tobytes()
        width, ids = len(end), max(words.tokenizer.get_vocab_size(), end_id + 1)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                packed = [
                    b"".join(map(words.__getitem__, (t or "").encode().split())) + end
                    for t in part.column(1).to_pylist()
                ]
                tokens = [np.frombuffer(p, dtype=words.kind) for p in packed]
                curve = hilbert_key(coordinates([t[:-1] for t in tokens], ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(packed, type=pa.binary()),
                        pa.array([len(p) // width for p in packed], type=pa.int64()),
                        pa.array(curve),
                    ],
                    names=["key", "tokens", "n", "curve"],
                )

    return rows.mapInArrow(encoded, f"key {kind}, tokens binary, n long, curve long")


def pack(df: DataFrame, key: str, text: str, tokenizer_path: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: key, start, length, doc_tokens, sequence_id, offset and its ids.

    ``ids`` is binary, four little-endian bytes per token. Each token of each document, its end
    id included, lies in exactly one piece. A null or empty text has its end id alone. Documents
    of one place on the curve follow each other by key; repeated rows are documents of their own.
    An empty frame gives no pieces; further columns are not read. Tokens are written once and
    shuffled once; only (row, place, count) is sorted.
    """
    if length < 1:
        raise ValueError("a sequence needs room for a token")
    rows = tokenised(df, key, text, tokenizer_path, end_id).withColumn("row", F.monotonically_increasing_id())
    rows, _ = stored(rows, "tokens")
    order = in_order(rows.select("row", "curve", "key", "n"), ["curve", "key", "row"], F.col("n"), "curve")
    placed = rows.select("row", "key", "tokens", "n").join(order.select("row", "position"), "row")
    kind = df.schema[key].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            out = {name: [] for name in ("key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}
            for doc, tokens, n, at in zip(batch["key"], batch["tokens"], batch["n"], batch["position"]):
                ids = np.frombuffer(tokens, dtype="<u2" if len(tokens) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    for name, value in zip(out, (doc, start, size, n, sequence, offset, ids[start : start + size])):
                        out[name].append(value.tobytes() if name == "ids" else value)
                    start += size
            yield pd.DataFrame(out)

    schema = f"key {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    pieces = placed.select("key", "tokens", "n", "position").mapInPandas(cut, schema)
    return pieces.withColumnRenamed("key", key)
