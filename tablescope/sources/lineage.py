"""Lineage sources: table pairs, column pairs, and graph documents in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_LINEAGE = {"source_table_full_name": "source", "target_table_full_name": "target"}
COLUMN_LINEAGE = {
    "source_table_full_name": "source_table",
    "source_column_name": "source_column",
    "target_table_full_name": "target_table",
    "target_column_name": "target_column",
}
GRAPH_SCHEMA = (
    "root string, direction string, "
    "nodes array<struct<id:string,downstream_count:bigint,downstream_tables:array<string>>>, "
    "edges array<struct<source:string,target:string,is_join:boolean>>"
)


def table_pairs(log: DataFrame) -> DataFrame:
    """``(source, target)`` of the rows of a lineage log that give both names; keeps no state."""
    return log.select(*(F.col(c).alias(n) for c, n in TABLE_LINEAGE.items())).dropna()


def column_pairs(log: DataFrame) -> DataFrame:
    """Column pairs of the rows of a lineage log that give all four names; keeps no state."""
    return log.select(*(F.col(c).alias(n) for c, n in COLUMN_LINEAGE.items())).dropna()


def table_lineage(log: DataFrame) -> DataFrame:
    """Distinct ``(source, target)`` of a lineage log, both names given."""
    return table_pairs(log).distinct()


def column_lineage(log: DataFrame) -> DataFrame:
    """Distinct column pairs of a lineage log, all four names given."""
    return column_pairs(log).distinct()


def graph_edges(documents: DataFrame, graph: str = "graph") -> DataFrame:
    """Edges of parsed graph documents; a missing ``is_join`` is false."""
    return documents.select(F.inline(f"{graph}.edges")).select(
        "source", "target", F.coalesce("is_join", F.lit(False)).alias("is_join")
    )


def graph_nodes(documents: DataFrame, graph: str = "graph") -> DataFrame:
    """Distinct nodes of parsed graph documents, those met only in edges included."""
    edges = F.col(f"{graph}.edges")
    ids = F.concat(
        F.coalesce(F.col(f"{graph}.nodes.id"), F.array()),
        F.coalesce(edges["source"], F.array()),
        F.coalesce(edges["target"], F.array()),
    )
    return documents.select(F.explode(ids).alias("node")).dropna().distinct()


def parse_graphs(texts: DataFrame, text: str) -> DataFrame:
    """Graph documents from a text column, as struct ``graph``."""
    return texts.select(F.from_json(text, GRAPH_SCHEMA).alias("graph"))


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """Graph documents from JSON files, one document per file."""
    documents = spark.read.schema(GRAPH_SCHEMA).json(path, multiLine=True)
    return documents.select(F.struct(*documents.columns).alias("graph"))
