"""Catalog metadata: lookups, snapshot, hierarchy, search and filters.

Answers are flat rows with their ancestors' names and counts. A catalog may hold a
third of all tables, so none is gathered into one nested value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.names import NAME_PARTS, full_name, is_three_part, name_parts

SEARCH_RESULTS = 20


class EntityNotFound(LookupError):
    """The catalog, schema or table that was asked for does not exist."""


def visible(df: DataFrame) -> DataFrame:
    """Rows outside the system catalog and the information schema."""
    return df.filter((F.col("schema_name") != "information_schema") & (F.col("catalog_name") != "system"))


def all_tables(tables: DataFrame) -> DataFrame:
    """Visible tables, in the order of their three-part names."""
    return visible(tables).select(
        *NAME_PARTS, "table_type", "comment", "data_source_format", "storage_path"
    ).orderBy(*NAME_PARTS)


def all_columns(columns: DataFrame) -> DataFrame:
    """Visible columns, in the order of their tables and positions."""
    return visible(columns).select(
        *NAME_PARTS, "column_name", "ordinal_position", "data_type", "is_nullable", "comment"
    ).orderBy(*NAME_PARTS, "ordinal_position", "column_name")


def _children(parent: DataFrame, children: DataFrame, keys: list[str], count: str, what: str) -> DataFrame:
    """Parent attributes, the number of children, and one row per child (one without any).

    All children share one key, so the single parent row goes to them.
    """
    parent = parent.limit(1)
    if parent.isEmpty():
        raise EntityNotFound(f"{what} not found")
    number = children.count()
    parent = parent.withColumn(count, F.lit(number).cast("bigint"))
    # The parent is one row.
    found = children.join(F.broadcast(parent), keys)
    return found if number else found.unionByName(parent, allowMissingColumns=True)


def catalog_metadata(catalogs: DataFrame, schemata: DataFrame, catalog: str) -> DataFrame:
    """A catalog with its schemas and their number, ordered by schema."""
    own = F.col("catalog_name") == catalog
    children = schemata.filter(own).withColumnsRenamed(
        {"created_at": "schema_created_at", "last_altered_at": "schema_altered_at"}
    ).drop("last_altered_by")
    found = _children(
        catalogs.filter(own), children, ["catalog_name"], "schema_count", f"catalog {catalog}"
    )
    return found.orderBy("schema_name")


def schema_metadata(schemata: DataFrame, tables: DataFrame, catalog: str, schema: str) -> DataFrame:
    """A schema with its tables and their number, ordered by table."""
    own = (F.col("catalog_name") == catalog) & (F.col("schema_name") == schema)
    found = _children(
        schemata.filter(own),
        tables.filter(own),
        ["catalog_name", "schema_name"],
        "table_count",
        f"schema {catalog}.{schema}",
    )
    return found.orderBy("table_name")


def table_metadata(tables: DataFrame, columns: DataFrame, catalog: str, schema: str, table: str) -> DataFrame:
    """A table with its columns and their number, ordered by position and name."""
    own = (
        (F.col("catalog_name") == catalog) & (F.col("schema_name") == schema) & (F.col("table_name") == table)
    )
    children = columns.filter(own).withColumnRenamed("comment", "column_comment")
    found = _children(
        tables.filter(own), children, list(NAME_PARTS), "column_count", f"table {catalog}.{schema}.{table}"
    )
    return found.orderBy("ordinal_position", "column_name")


def _not_blank(*names: str) -> Column:
    """None of the names is null or empty."""
    kept = F.lit(True)
    for name in names:
        kept = kept & F.coalesce(F.col(name) != "", F.lit(False))
    return kept


def yes_no(name: str) -> Column:
    """YES and NO as a boolean, anything else as null."""
    return F.when(F.col(name) == "YES", True).when(F.col(name) == "NO", False)


def tables_with_columns(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Every table with its columns; a table without columns keeps one row."""
    column_rows = columns.filter(_not_blank(*NAME_PARTS, "column_name")).select(
        full_name().alias("full_name"),
        "column_name",
        "ordinal_position",
        "data_type",
        yes_no("is_nullable").alias("is_nullable"),
        F.col("comment").alias("column_comment"),
    )
    table_rows = tables.filter(_not_blank(*NAME_PARTS)).select(
        full_name().alias("full_name"),
        *NAME_PARTS,
        "table_type",
        "comment",
        "data_source_format",
        "storage_path",
    )
    # A table may hold a large share of all columns. Spark can split the larger side of an
    # inner join but not the right side of a left one.
    bare = table_rows.join(column_rows.select("full_name").distinct(), "full_name", "left_anti")
    return column_rows.join(table_rows, "full_name").unionByName(bare, allowMissingColumns=True)


def catalog_snapshot(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """The whole catalog, ordered by catalog, schema, table and column position."""
    return tables_with_columns(tables, columns).orderBy(*NAME_PARTS, "ordinal_position", "column_name")


def snapshot_stats(snapshot: DataFrame) -> DataFrame:
    """One row: catalogs, schemas, tables and columns of a snapshot."""
    per_table = snapshot.groupBy("catalog_name", "schema_name", "table_name").agg(
        F.count("column_name").alias("columns")
    )
    per_schema = per_table.groupBy("catalog_name", "schema_name").agg(
        F.count(F.lit(1)).alias("tables"), F.sum("columns").alias("columns")
    )
    return per_schema.agg(
        F.count_distinct("catalog_name").alias("catalog_count"),
        F.count(F.lit(1)).alias("schema_count"),
        F.coalesce(F.sum("tables"), F.lit(0)).alias("table_count"),
        F.coalesce(F.sum("columns"), F.lit(0)).alias("column_count"),
    )


def snapshot_by_schema(snapshot: DataFrame) -> DataFrame:
    """Tables and columns per schema: the upper levels of the catalog tree."""
    per_table = snapshot.groupBy(*NAME_PARTS).agg(F.count("column_name").alias("columns"))
    return per_table.groupBy("catalog_name", "schema_name").agg(
        F.count(F.lit(1)).alias("table_count"), F.sum("columns").alias("column_count")
    )


def listed_tables(tables: DataFrame) -> DataFrame:
    """Distinct three-part names, from ``full_name`` or else ``name``, in order."""
    return _listed(tables).orderBy("table")


def _listed(tables: DataFrame) -> DataFrame:
    name = F.coalesce("full_name", "name")
    return tables.select(name.alias("table")).filter(is_three_part("table")).distinct()


def name_hierarchy(tables: DataFrame) -> DataFrame:
    """Listed tables split into catalog, schema and table name, in order."""
    parts = _listed(tables).select(F.col("table").alias("full_name"), *name_parts("table"))
    return parts.filter(_not_blank(*NAME_PARTS)).orderBy(*NAME_PARTS)


def search_tables(tables: DataFrame, text: str, limit: int = SEARCH_RESULTS) -> DataFrame:
    """The first ``limit`` listed tables that contain ``text``, whatever its case; names
    that start with it come first."""
    text = (text or "").strip().lower()
    listed = _listed(tables)
    if not text:
        return listed.filter(F.lit(False))
    lowered = F.lower("table")
    return (
        listed.filter(lowered.contains(text))
        .orderBy(F.when(lowered.startswith(text), 0).otherwise(1), "table")
        .limit(limit)
    )


def matching_tables(tables: DataFrame, text: str) -> DataFrame:
    """Catalog-tree filter: tables that match by catalog, schema, table or full name.

    The kept catalogs and schemas are the distinct ancestors of these rows.
    """
    if not text.strip():
        return tables.filter(F.lit(False))
    hit = F.lit(False)
    for name in (*NAME_PARTS, "full_name"):
        hit = hit | F.coalesce(F.lower(name).contains(text.lower()), F.lit(False))
    return tables.filter(hit)


def matching_schemas(tables: DataFrame, text: str) -> DataFrame:
    """Kept schemas and catalogs of the tree filter with their match counts."""
    return (
        matching_tables(tables, text)
        .groupBy("catalog_name", "schema_name")
        .agg(F.count("table_name").alias("match_count"))
    )


def matching_children(children: DataFrame, name: str, text: str) -> DataFrame:
    """Child rows whose name contains the text, whatever its case."""
    return children.filter(F.lower(name).contains(text.lower()))
