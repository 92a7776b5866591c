"""Exact top-k search by distributed histogram selection.

Candidates and queries are packed into blocks of a fixed number of rows, and each pair of
blocks is scored in one matrix product. The k-th score of a query is located in rounds: every
pair of blocks counts its scores per bin of the query's current score range, the counts are
summed over all blocks, and the bin that holds the k-th score is the next range. A block only
reports its highest bins, down to the one that holds its own k-th score: no lower bin can hold
the k-th score of all blocks, so the sums stay exact. When ranges are single scores, a last
pass keeps the scores above the k-th value, and of those equal to it the smallest ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import free, stored

BLOCK_ROWS = 1024
QUERY_ROWS = 512
BIN_BITS = 12
# A score must stay an exact double, and a block of scores must fit in memory.
SCORE_LIMIT = 2**52


def packed(df: DataFrame, key: str, vector: str, scale: int, block_rows: int) -> DataFrame:
    """Blocks of up to ``block_rows`` vectors: block, cell, n, dim, ids, values, longest.

    Components become floor(scale * x). Rows whose id or vector is null, whose vector is empty,
    or which hold a null or non-finite component take no part.
    """
    good = F.forall(df[vector], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.filter(df[key].isNotNull() & df[vector].isNotNull() & (F.size(df[vector]) > 0) & good)
    rows = rows.select(df[key].cast("long").alias("id"), df[vector].alias("vector"))

    def blocks(batches):
        for batch in batches:
            vectors = batch["vector"].to_numpy()
            lengths = np.array([len(v) for v in vectors])
            for dim in np.unique(lengths):  # vectors of another length are scored among themselves
                chosen = np.flatnonzero(lengths == dim)
                for start in range(0, len(chosen), block_rows):
                    part = chosen[start : start + block_rows]
                    matrix = np.floor(np.stack([np.asarray(vectors[i], dtype=np.float64) for i in part]) * scale)
                    ids = batch["id"].to_numpy()[part].astype("<i8")
                    longest = float(np.sqrt((matrix**2).sum(axis=1).max()))
                    if longest**2 >= SCORE_LIMIT:
                        raise ValueError("scores of these vectors do not fit an exact double")
                    yield pd.DataFrame(
                        {
                            "n": [len(part)], "dim": [int(dim)], "ids": [ids.tobytes()],
                            "vectors": [matrix.astype("<i4" if np.abs(matrix).max() < 2**31 else "<i8").tobytes()],
                            "longest": [longest],
                        }
                    )

    schema = "n int, dim int, ids binary, vectors binary, longest double"
    return rows.mapInPandas(blocks, schema)


def matrix_of(block, n, dim):
    return np.frombuffer(block, dtype="<i4" if len(block) == 4 * n * dim else "<i8").reshape(n, dim).astype(np.float64)


def scored(row):
    """Query ids, candidate ids and the matrix of scores; a query's own id scores nothing."""
    queries = np.frombuffer(row.q_ids, dtype="<i8")
    ids = np.frombuffer(row.ids, dtype="<i8")
    scores = matrix_of(row.q_vectors, row.q_n, row.dim) @ matrix_of(row.vectors, row.n, row.dim).T
    return queries, ids, scores.astype(np.int64), queries[:, None] == ids[None, :]


def top_k(df: DataFrame, key: str, vector: str, is_query, k: int = 10, scale: int = 1024) -> DataFrame:
    """The ``k`` best-scoring rows of ``df`` for each query row: query_id, rank, id, score.

    ``is_query`` is a condition on the rows of ``df``; candidates are all rows with another id.
    Score: inner product of the vectors floor(scale * x). Ties go to the smaller id; a query
    with fewer candidates returns them all. Repeated rows are candidates of their own, and
    repeated query ids are answered once, by the smallest of their vectors' bytes. Further
    columns are not read. An empty frame gives no rows.

    Work grows with queries times rows, as asked; a block of queries meets a block of rows in
    one task at a time, and what is reported per pair of blocks is at most k rows per query.
    """
    spark = df.sparkSession
    base = df.select(df[key].alias("id"), df[vector].alias("vector"), is_query.alias("asks"))
    blocks, blocks_path = stored(packed(base, "id", "vector", scale, BLOCK_ROWS), "vectors")
    asked = base.filter("asks").groupBy("id").agg(F.min("vector").alias("vector"))
    # Few enough partitions that blocks of queries are full, and more of them with more queries.
    parts = -(-base.filter("asks").count() // QUERY_ROWS)
    asked, asked_path = stored(packed(asked.coalesce(max(1, parts)), "id", "vector", scale, QUERY_ROWS), "queries")
    n_blocks, n_asked = max(1, blocks.count()), max(1, asked.count())
    bound = blocks.agg(F.max("longest")).first()[0] or 0.0
    limit = int(bound * bound) + 2  # every |score| is below it
    # Blocks meet on a grid of cells: a cell holds about one block of each side.
    cell = lambda name, cells: F.pmod(F.xxhash64(name), F.lit(cells)).cast("int")
    across = lambda cells: F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    right = blocks.withColumn("c", cell("ids", n_blocks)).withColumn("q", across(n_asked))
    left = (
        asked.drop("longest")
        .withColumnsRenamed({"n": "q_n", "ids": "q_ids", "vectors": "q_vectors"})
        .withColumn("q", cell("q_ids", n_asked))
        .withColumn("c", across(n_blocks))
    )
    grid = left.join(right.hint("shuffle_hash"), ["dim", "q", "c"])

    # The range of a query is [low, low + 2^width); ``above`` scores are known to lie over it.
    width = BIN_BITS * -(-(2 * limit).bit_length() // BIN_BITS)
    states, paths = None, [blocks_path, asked_path]
    while width > 0:
        width -= BIN_BITS
        found = counted(grid, states, -limit, width, k)
        total = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        bins = found.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        if states is not None:
            bins = bins.join(states, "query_id")
        else:
            bins = bins.withColumns({"low": F.lit(-limit).cast("long"), "above": F.lit(0).cast("long")})
        bins = bins.withColumn("upto", F.sum("n").over(total) + F.col("above"))
        last = Window.partitionBy("query_id").orderBy("reached", "position")
        bins = (
            bins.withColumn("reached", F.when(F.col("upto") >= k, 0).otherwise(1))
            .withColumn("position", F.when(F.col("upto") >= k, -F.col("bin")).otherwise(F.col("bin")))
            .withColumn("place", F.row_number().over(last))
            .filter("place = 1")
        )
        new = bins.select(
            "query_id",
            (F.col("low") + F.col("bin") * F.lit(1 << width)).alias("low"),
            (F.col("upto") - F.col("n")).alias("above"),
        )
        states, path = stored(new, "ranges")
        paths.append(path)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    result = (
        kept(grid, states, k)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )
    answer, _ = stored(result, "nearest")
    free(spark, *paths)
    return answer


def with_states(grid: DataFrame, states: DataFrame | None) -> DataFrame:
    """The grid, with the ranges of each query block as two packed columns."""
    if states is None:
        return grid.withColumns({"lows": F.lit(None).cast("array<long>"), "has": F.lit(None).cast("array<long>")})
    schema = "q_ids binary, query_id long"

    def unpacked(batches):
        for batch in batches:
            for block in batch["q_ids"]:
                yield pd.DataFrame({"q_ids": block, "query_id": np.frombuffer(block, dtype="<i8")})

    owners = grid.select("q_ids").distinct().mapInPandas(unpacked, schema)
    packs = (
        owners.join(states, "query_id")
        .groupBy("q_ids")
        .agg(F.collect_list(F.struct("query_id", "low")).alias("pairs"))  # at most QUERY_ROWS of them
        .select("q_ids", F.col("pairs.query_id").alias("has"), F.col("pairs.low").alias("lows"))
    )
    return grid.join(packs, "q_ids")


def lows_of(row, queries, default):
    """The low end of each query's range, and which queries have one."""
    if row.lows is None:
        return np.full(len(queries), default, dtype=np.int64), np.ones(len(queries), dtype=bool)
    has, lows = np.asarray(row.has, dtype=np.int64), np.asarray(row.lows, dtype=np.int64)
    order = np.argsort(has)
    at = np.searchsorted(has[order], queries).clip(max=len(has) - 1)
    return lows[order][at], has[order][at] == queries


def counted(grid: DataFrame, states: DataFrame | None, low: int, width: int, k: int) -> DataFrame:
    """query_id, bin, n: the highest bins of each query in each pair of blocks."""
    refined = states is not None

    def count(batches):
        for batch in batches:
            for row in batch.itertuples():
                queries, _, scores, own = scored(row)
                lows, known = lows_of(row, queries, low)
                bins = (scores - lows[:, None]) >> width
                # Scores over the range are counted in ``above``; those under it cannot matter.
                outside = own | (bins < 0) | ~known[:, None]
                if refined:
                    outside |= bins >= 1 << BIN_BITS
                bins[outside] = -1
                places = min(k, bins.shape[1])
                kth = np.partition(bins, bins.shape[1] - places, axis=1)[:, bins.shape[1] - places]
                q, c = np.nonzero((bins >= np.maximum(kth, 0)[:, None]) & ~outside)
                both, n = np.unique(np.stack([q, bins[q, c]]), axis=1, return_counts=True)
                yield pd.DataFrame({"query_id": queries[both[0]], "bin": both[1], "n": n.astype(np.int64)})

    return with_states(grid, states).mapInPandas(count, "query_id long, bin long, n long")


def kept(grid: DataFrame, states: DataFrame, k: int) -> DataFrame:
    """The scores of each pair of blocks that can be among the k best."""

    def keep(batches):
        for batch in batches:
            for row in batch.itertuples():
                queries, ids, scores, own = scored(row)
                lows, known = lows_of(row, queries, 0)
                q, c = np.nonzero((scores >= lows[:, None]) & ~own & known[:, None])
                s = scores[q, c]
                order = np.lexsort((ids[c], -s, q))
                q, c, s = q[order], c[order], s[order]
                first = np.searchsorted(q, q)  # of each query, the block's k best in final order
                best = np.arange(len(q)) - first < k
                yield pd.DataFrame({"query_id": queries[q[best]], "id": ids[c[best]], "score": s[best]})

    return with_states(grid, states).mapInPandas(keep, "query_id long, id long, score long")


ORACLE = """
    WITH whole AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
      vec_id, score FROM scores
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
