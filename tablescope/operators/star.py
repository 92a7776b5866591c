"""Star navigation over scored foreign keys, and the report on one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.names import last_part
from tablescope.operators.graph import DOWNSTREAM, LineageGraph, one_root
from tablescope.operators.keys import relation_owners
from tablescope.operators.lineage import beyond_root, bounded_lineage
from tablescope.workspace import written

REPORT_DEPTH = 3


@dataclass(frozen=True)
class TableReport:
    """Lineage within a depth, star neighbours and downstream impact of one table."""

    table: str
    table_type: str
    nodes: DataFrame
    edges: DataFrame
    dimensions: DataFrame
    downstream_impact: DataFrame


def fact_dimensions(relations: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per relation: fact, dimension, both column names and the confidence."""
    return relation_owners(relations.select("fk", "pk", "confidence"), columns).select(
        "fact",
        "dimension",
        last_part("fk").alias("fact_column"),
        last_part("pk").alias("dimension_column"),
        "confidence",
    )


def related_facts(star: DataFrame, table_types: DataFrame) -> DataFrame:
    """Distinct ``(dimension, fact)`` for tables typed FACT; ``star`` is ``fact_dimensions``.

    The distinct rows are found where the join with the facts has put them. It is no semi-join, as
    the optimizer would move that to the columns and shuffle all of those by their tables.
    """
    facts = table_types.filter(F.col("table_type") == "FACT").select(F.col("full_name").alias("fact")).distinct()
    return star.select("dimension", "fact").join(facts, "fact").select("dimension", "fact").distinct()


def table_type(table_types: DataFrame, table: str) -> str:
    """The type of a table, or TABLE if it has none."""
    row = table_types.filter(F.col("full_name") == table).select("table_type").first()
    return (row and row["table_type"]) or "TABLE"


def star_tables(relations: DataFrame, columns: DataFrame, table_types: DataFrame, table: str) -> DataFrame:
    """Star neighbours as ``(dimension, fact_column, dimension_column, confidence)`` rows.

    For a FACT: its dimensions. For a DIM: every related fact, as a row without columns,
    and all relations of those facts, its own included. Otherwise nothing. Relations are cut
    down to the columns of the tables in question before any is joined with its owners. What is
    left at each step is written, so that where it is little, the large tables stay where they are.
    """
    kind = table_type(table_types, table)
    names = ["dimension", "fact_column", "dimension_column", "confidence"]
    own = columns.filter(F.col("full_name") == table).select("id")

    def relations_of(side: str, ids: DataFrame) -> DataFrame:
        ids = written(ids.withColumnRenamed("id", side), "star-columns")
        kept = written(relations.join(ids, side, "left_semi"), "star-relations")
        ends = written(kept.select(F.explode(F.array("fk", "pk")).alias("id")).distinct(), "star-columns")
        return fact_dimensions(kept, written(columns.join(ends, "id", "left_semi"), "star-owners"))

    if kind == "FACT":
        return relations_of("fk", own).select(names)
    if kind != "DIM":
        return fact_dimensions(relations.filter(F.lit(False)), columns).select(names)
    star = written(relations_of("pk", own), "star")
    types = table_types.join(star.select(F.col("fact").alias("full_name")), "full_name", "left_semi")
    facts = written(related_facts(star, types).select("fact"), "facts")
    ids = columns.join(facts.withColumnRenamed("fact", "full_name"), "full_name", "left_semi").select("id")
    fact_rows = facts.select(
        F.col("fact").alias("dimension"),
        F.lit(None).cast("string").alias("fact_column"),
        F.lit(None).cast("string").alias("dimension_column"),
        F.lit(None).cast("double").alias("confidence"),
    )
    return fact_rows.unionByName(relations_of("fk", ids).select(names))


def star_table_names(relations: DataFrame, columns: DataFrame, table_types: DataFrame, table: str) -> DataFrame:
    return star_tables(relations, columns, table_types, table).select("dimension").distinct()


def table_report(
    graph: LineageGraph,
    relations: DataFrame,
    columns: DataFrame,
    table_types: DataFrame,
    table: str,
    depth: int = REPORT_DEPTH,
) -> TableReport:
    """Lineage within ``depth`` with table types, star neighbours, downstream impact."""
    down = graph.walk(one_root(graph, table), DOWNSTREAM)
    nodes, edges = bounded_lineage(graph, table, depth, down)
    types = table_types.select(F.col("full_name").alias("id"), F.col("table_type").alias("type"))
    nodes = nodes.join(types, "id", "left").fillna("TABLE", "type")
    return TableReport(
        table,
        table_type(table_types, table),
        nodes,
        edges,
        star_tables(relations, columns, table_types, table),
        beyond_root(graph, down, table, DOWNSTREAM),
    )


def report_rows(report: TableReport) -> DataFrame:
    """A report as rows ``(section, name, other, detail)``."""

    def section(df: DataFrame, label: str, name: str, other: str | None, detail: str | None) -> DataFrame:
        cell = lambda c: F.lit(None).cast("string") if c is None else F.col(c).cast("string")
        return df.select(
            F.lit(label).alias("section"),
            cell(name).alias("name"),
            cell(other).alias("other"),
            cell(detail).alias("detail"),
        )

    return (
        section(report.nodes, "node", "id", None, "type")
        .unionByName(section(report.edges, "edge", "source", "target", None))
        .unionByName(
            section(report.dimensions, "dimension", "dimension", "fact_column", "dimension_column")
        )
        .unionByName(section(report.downstream_impact, "downstream", "table", None, None))
    )
