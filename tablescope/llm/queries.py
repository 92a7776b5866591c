"""The registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tablescope.llm import byte_pairs, jaccard, licenses, merkle, packing, private_data, quality, ranked, runs, sharding, simhash, topk, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) by its name, with its SQL if there is one."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(url_filter.oracle())
def op1_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), "page_id", "url", url_filter.RULES)


@query()
def op2_private_data(spark, sf_dir):
    return private_data.digests(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(topk.ORACLE)
def op3_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = topk.top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=10, scale=1024)
    return found.withColumnRenamed("id", "vec_id")


@query()
def op4_simhash(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    found = simhash.near_duplicates(documents, "doc_id", "text", simhash.THREE_BITS)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


@query()
def op5_packing(spark, sf_dir):
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer, length=2048, end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query()
def op6_byte_pairs(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_pairs.digests(table(spark, sf_dir, "documents"), "doc_id", "text", ranks, public_tokenizers.PATTERN)


@query()
def op7_sharding(spark, sf_dir):
    shards = sharding.shard_rows(table(spark, sf_dir, "documents"), "doc_id", "text", shards=24)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


@query()
def op8_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"), "doc_id", "text").drop("spans")


@query(merkle.oracle())
def op9_merkle(spark, sf_dir):
    return merkle.half_replaced(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def op10_quality(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(quality.training_rows(documents, labels, "doc_id", "text", "quality"), "text", "label")
    scores = quality.score(documents, "doc_id", "text", model)
    return scores.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query(jaccard.ORACLE)
def op11_jaccard_join(spark, sf_dir):
    found = jaccard.join(table(spark, sf_dir, "documents"), "doc_id", "text", words=4, percent=85)
    return found.withColumnRenamed("component", "component_id")


@query(ranked.ORACLE)
def op12_ranked_search(spark, sf_dir):
    items, documents = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    return ranked.search(items, "item_id", "text", documents, "doc_id", "text", k=10)


@query()
def op13_periodic_runs(spark, sf_dir):
    documents = runs.with_planted_runs(table(spark, sf_dir, "documents"), "doc_id", "text")
    return runs.digests(runs.find_runs(documents, "doc_id", "text"), "doc_id")


QUERIES["pipeline"] = corpus_pipeline.run
