"""From raw documents to packed training sequences, one stage after the other.

Each stage is one operator: it takes (spark, docs, sf_dir), works on all that the stage before it
kept, and its result is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm import packing, private_data, quality, simhash
from tablescope.llm.common import free, stored

LEAST_SCORE = 0.3
SEQUENCE = 2048


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is 0.3 or more; the classifier learns from the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(quality.training_rows(docs, labels, "doc_id", "text", "quality"), "text", "label")
    return docs.filter(quality.score_column(docs["text"], model) >= LEAST_SCORE)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose fingerprints are linked at three bits, the one with the smallest id."""
    return simhash.first_of_groups(docs, "doc_id", "text", simhash.THREE_BITS)


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with private data replaced by the name of its kind."""
    masked = private_data.redact(docs, "doc_id", "text")
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(docs, "doc_id", "text", tokenizer, length=SEQUENCE, end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality_classifier", good_quality),
    ("near_duplicates", one_of_each),
    ("private_data", without_private_data),
    ("packing", packed),
]

# Scores, fingerprints and tokens are beyond SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir), name)
        if before:
            free(spark, before)
        before = path
    return docs
