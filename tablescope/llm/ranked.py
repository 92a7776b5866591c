"""Ranked lexical search, term at a time, with a limit on new accumulators.

Documents are indexed once: how often each holds the terms of the items, and how many terms it
has. Each task inverts a block of documents and takes every item's terms one by one, rarest first.
A term adds its part of the score to the accumulators of the documents that hold it. Before each
term, the largest parts that the terms to come can add in this block are summed. Once that sum
cannot reach the k-th best partial score, a document without an accumulator can no longer be among
the k best, so no accumulator is made any more; those that exist are still updated exactly.
The k best of earlier blocks of the task set a floor as well. At most k rows per item leave a task.

Items are handled in blocks of about ``BLOCK_TERMS`` terms. What the driver and the tasks hold of
the items is bounded by that (and one item), however many items there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tablescope.llm.common import free, in_order, stored

BLOCK_TERMS = 100_000
BLOCK_DOCUMENTS = 8192
# How many tasks' winners are ranked together before the last ranking.
FAN_IN = 64

_KEPT = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum())
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEPT else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal stretches of ASCII letters, digits and characters beyond ASCII, A-Z in lower case."""
    return (text or "").encode().translate(_LOWER).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def lengths(terms: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents with so many terms, where all have ``total``; in whole numbers."""
    if len(terms) and 90 * int(terms.max()) * documents >= 2**63:  # beyond 64 bits on the way
        return np.array([10 + 90 * n * documents // total for n in terms.tolist()], dtype=np.int64)
    return 10 + 90 * terms * documents // total


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass(frozen=True)
class Queries:
    """Items of one block: their terms by number, rarest first, and the weight of each number."""

    items: list
    terms: list[np.ndarray]
    weights: np.ndarray


class Block:
    """The inverted lists of some documents."""

    def __init__(self, ids: list[np.ndarray], tfs: list[np.ndarray], m: np.ndarray, weights: np.ndarray):
        self.size = len(ids)
        number = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
        document = np.repeat(np.arange(self.size), [len(own) for own in ids])
        order = np.argsort(number, kind="stable")
        number, self.documents = number[order], document[order]
        tf = np.concatenate(tfs)[order].astype(np.int64) if tfs else np.zeros(0, dtype=np.int64)
        self.parts = weights[number] * impacts(tf, m[self.documents])
        self.ends = np.searchsorted(number, np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), dtype=np.int64)  # the largest part of each term
        held = np.flatnonzero(np.diff(self.ends))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.parts, self.ends[held])

    def best(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the k best with their exact scores, and accumulators made.

        ``terms`` come rarest first. A document whose score is below ``floor`` may be left out.
        """
        terms = terms[self.most[terms] > 0]
        ahead = np.cumsum(self.most[terms][::-1])[::-1]  # what this and later terms add at most
        scores = np.zeros(self.size, dtype=np.int64)
        made = np.zeros(self.size, dtype=bool)
        limited, threshold = False, max(floor, 1)
        for term, most in zip(terms.tolist(), ahead.tolist()):
            limited = limited or most < threshold
            own = slice(self.ends[term], self.ends[term + 1])
            documents, parts = self.documents[own], self.parts[own]
            if limited:
                survive = made[documents]
                scores[documents[survive]] += parts[survive]
                continue
            made[documents] = True
            scores[documents] += parts
            partial = scores[made]
            if len(partial) >= k:
                threshold = max(threshold, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
        found = np.flatnonzero(made & (scores >= max(floor, 1)))
        if len(found) > k:
            kth = np.partition(scores[found], len(found) - k)[len(found) - k]
            found = found[scores[found] >= kth]
        return found, scores[found], int(made.sum())


def ranked_first(pairs: list[tuple], k: int) -> list[tuple]:
    """The k best (score, key): highest first, ties by key, a null key last."""
    return sorted(pairs, key=lambda own: (-own[0], own[1] is None, own[1] if own[1] is not None else 0))[:k]


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term), each once."""
    rows = items.select(items[item].alias("item"), items[text].alias("text"))
    kind = items.schema[item].dataType.simpleString()

    def split(batches):
        for batch in batches:
            found = [sorted(set(terms_of(t.as_py()))) for t in batch.column(1)]
            at = np.repeat(np.arange(batch.num_rows), [len(own) for own in found])
            terms = pa.array([term for own in found for term in own], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), terms], names=["item", "term"])

    return rows.mapInArrow(split, f"item {kind}, term binary").distinct()


def indexed(docs: DataFrame, key: str, text: str, terms: list[bytes]) -> DataFrame:
    """key, n (all terms), ids and tfs (of ``terms``, by number) of every document that has a term."""
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def counted(batches):
        numbers = {term: i for i, term in enumerate(terms)}
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                keep, ns, ids, tfs = [], [], [], []
                for at, text in enumerate(part.column(1)):
                    words = terms_of(text.as_py())
                    if not words:
                        continue
                    own = [i for i in map(numbers.get, words) if i is not None]
                    number, times = np.unique(np.array(own, dtype=np.int32), return_counts=True)
                    keep.append(at)
                    ns.append(len(words))
                    ids.append(number.tobytes())
                    tfs.append(times.astype(np.int64).tobytes())
                columns = [part.column(0).take(pa.array(keep, pa.int64())), pa.array(ns, pa.int64())]
                columns += [pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "ids", "tfs"])

    return rows.mapInArrow(counted, f"key {kind}, n long, ids binary, tfs binary")


def document_frequencies(index: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each term stands; a task sends one row per term it met."""

    def counted(batches):
        total = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.int32)
            total += np.bincount(ids, minlength=terms)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["term", "df"])

    found = np.zeros(terms, dtype=np.int64)
    for row in index.select("ids").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        found[row.term] = row.df
    return found


def best_of_tasks(index: DataFrame, queries: Queries, documents: int, total: int, k: int) -> DataFrame:
    """(number, key, score, task): up to k rows per item and task, among them the k best of all."""
    kind = index.schema["key"].dataType.simpleString()

    def search(batches):
        best: list[list[tuple]] = [[] for _ in queries.items]
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_DOCUMENTS):
                part = batch.slice(start, BLOCK_DOCUMENTS)
                ids = [np.frombuffer(x, dtype=np.int32) for x in part.column(2).to_pylist()]
                tfs = [np.frombuffer(x, dtype=np.int64) for x in part.column(3).to_pylist()]
                m = lengths(part.column(1).to_numpy(), documents, total)
                block = Block(ids, tfs, m, queries.weights)
                keys = part.column(0).to_pylist()
                for own, terms in zip(best, queries.terms):
                    floor = own[-1][0] if len(own) == k else 0
                    found, scores, _ = block.best(terms, k, floor)
                    if len(found):
                        own[:] = ranked_first(own + [(s, keys[d]) for d, s in zip(found.tolist(), scores.tolist())], k)
        rows = [(number, key, score) for number, own in enumerate(best) for score, key in own]
        numbers, keys, scores = zip(*rows) if rows else ((), (), ())
        columns = [pa.array(numbers, pa.int32()), pa.array(keys, key_type), pa.array(scores, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["number", "key", "score"])

    key_type = to_arrow_type(index.schema["key"].dataType)
    found = index.select("key", "n", "ids", "tfs").mapInArrow(search, f"number int, key {kind}, score long")
    return found.withColumn("task", F.spark_partition_id())


def top_of(rows: DataFrame, group: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(items: DataFrame, item: str, item_text: str, docs: DataFrame, key: str, text: str, k: int = 10) -> DataFrame:
    """item, rank (from 1), key and score of each item's k best documents; scores are above 0.

    N counts the documents with a term, L all their terms, n one document's, df the documents that
    hold a term and tf its occurrences in one. A term weighs w = floor(1000 ln((2N+2)/(2df+1))), and
    a document scores the sum of w * (10^9 tf div (1000 tf + 8 m)) over the item's distinct terms,
    with m = 10 + 90 n N div L. Equal scores are ranked by the key, null last; repeated rows are
    documents of their own. Rows with one item key are one item. Items without terms or matches
    give no rows, neither do empty tables. Texts are read whole; further columns are not read.
    """
    spark, kind = docs.sparkSession, items.schema[item].dataType.simpleString()
    schema = f"item {kind}, key {docs.schema[key].dataType.simpleString()}, score long, task int"
    wanted, wanted_path = stored(item_terms(items, item, item_text), "item-terms")
    counts = wanted.groupBy("item").agg(F.count(F.lit(1)).alias("terms"))
    blocks = in_order(counts, ["item"], F.col("terms"), "item-blocks")
    blocks, blocks_path = stored(blocks.select("item", F.expr(f"position div {BLOCK_TERMS}").alias("block")), "blocks")
    found = spark.createDataFrame([], schema)
    numbers = sorted(r.block for r in blocks.select("block").distinct().collect())
    paths = []
    for block in numbers:
        own = wanted.alias("w").join(blocks.filter(F.col("block") == block).alias("b"), F.expr("w.item <=> b.item"))
        best, more = block_of_items(own.select("w.item", "w.term").collect(), docs, key, text, k, kind)
        paths += more
        found = found.unionAll(best)
    found = top_of(found.withColumn("part", F.expr(f"task div {FAN_IN}")), ["item", "part"], k).drop("rank")
    out, _ = stored(top_of(found, ["item"], k).select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score"), "ranked")
    free(spark, wanted_path, blocks_path, *paths)
    return out


def block_of_items(pairs: list, docs: DataFrame, key: str, text: str, k: int, kind: str) -> tuple[DataFrame, list[str]]:
    """(item, key, score, task) of the best documents for the items of (item, term) pairs."""
    spark = docs.sparkSession
    terms = sorted({bytes(p.term) for p in pairs})
    index, path = stored(indexed(docs, key, text, terms), "ranked-index")
    sizes = index.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    frequency = document_frequencies(index, len(terms))
    weights = np.array([weight(sizes.documents, int(df)) for df in frequency], dtype=np.int64)
    numbers, of_item = {term: i for i, term in enumerate(terms)}, {}
    for p in pairs:
        of_item.setdefault(p.item, []).append(numbers[bytes(p.term)])
    rarest = [np.array(sorted(own, key=lambda i: (frequency[i], i)), dtype=np.int64) for own in of_item.values()]
    best = best_of_tasks(index, Queries(list(of_item), rarest, weights), sizes.documents, sizes.total, k)
    names = spark.createDataFrame(list(enumerate(of_item)), f"number int, item {kind}")
    best, best_path = stored(best.join(names, "number").select("item", "key", "score", "task"), "ranked-best")
    free(spark, path)
    return best, [best_path]


ORACLE = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), held AS (SELECT doc_id, r, terms, len(terms)::BIGINT AS n FROM words WHERE len(terms) > 0),
sizes AS (SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS total FROM held),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), postings AS (
  SELECT doc_id, r, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, r, n, unnest(terms) AS term FROM held)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(documents) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, sizes GROUP BY term
), scored AS (
  SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * documents) // total))))::BIGINT AS score
  FROM wanted JOIN postings USING (term) JOIN weights USING (term), sizes GROUP BY item_id, doc_id, r
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
