"""Registered catalog queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.operators import catalog
from tablescope.operators.profile import columns_of, data_profile
from tablescope.plans import inputs
from tablescope.plans.registry import Tables, query
from tablescope.sources.catalog import load_snapshot, refresh_snapshot, tables_of, write_snapshot
from tablescope.workspace import new_path

INFO = "WITH " + inputs.INFO_SQL.strip()
TABLE_COLUMNS = "catalog_name, schema_name, table_name, table_type, comment, data_source_format, storage_path"


@query("s4_all_tables", INFO + f" SELECT {TABLE_COLUMNS} FROM visible_tables")
def s4(t: Tables) -> DataFrame:
    return catalog.all_tables(inputs.info_tables(t))


@query("s5_all_columns", INFO + " SELECT * FROM visible_columns")
def s5(t: Tables) -> DataFrame:
    return catalog.all_columns(inputs.info_columns(t))


@query(
    "s4_tables_of_files",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT 'lake' AS catalog_name, 'sales' AS schema_name, '{x}' AS table_name, count(*) AS row_count FROM {x}"
        for x in inputs.STAR_COLUMNS
    )
    + ")",
)
def s4_files(t: Tables) -> DataFrame:
    """Tables and columns listed from the schemas of Parquet files, with their row counts."""
    star = inputs.star_tables(t)
    listed = catalog.all_tables(tables_of(star, data_source_format="PARQUET"))
    columns = catalog.all_columns(columns_of(star)).select("catalog_name", "schema_name", "table_name").distinct()
    names = ["catalog_name", "schema_name", "table_name"]
    rows = data_profile(star).groupBy(*names).agg(F.max("row_count").alias("row_count"))
    return listed.select(*names).join(columns, names).join(rows, names)


# Schemata and catalogs with what the information schema says about them.
SCHEMATA = (
    INFO
    + """, schemata AS (
  SELECT catalog_name, schema_name, 'owner_' || schema_name AS schema_owner,
         min(TIMESTAMP '2020-01-01' + INTERVAL (p_partkey) HOUR) AS created_at,
         max(TIMESTAMP '2020-01-01' + INTERVAL (p_partkey) HOUR) AS last_altered_at, 'me' AS last_altered_by
  FROM info_tables JOIN part ON table_name = 't' || p_partkey GROUP BY catalog_name, schema_name),
catalogs AS (
  SELECT catalog_name, 'owner_' || catalog_name AS catalog_owner, min(created_at) AS created_at,
         'me' AS created_by, max(last_altered_at) AS last_altered_at, 'me' AS last_altered_by
  FROM schemata GROUP BY catalog_name)"""
)


def schemata(t: Tables) -> DataFrame:
    hour = F.col("key") * F.expr("INTERVAL '1' HOUR")
    at = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz") + hour
    tables = inputs.info_tables(t).withColumn("key", F.substring_index("table_name", "t", -1).cast("int"))
    return tables.groupBy("catalog_name", "schema_name").agg(
        F.concat(F.lit("owner_"), F.col("schema_name")).alias("schema_owner"),
        F.min(at).alias("created_at"),
        F.max(at).alias("last_altered_at"),
        F.lit("me").alias("last_altered_by"),
    )


def catalogs(t: Tables) -> DataFrame:
    return schemata(t).groupBy("catalog_name").agg(
        F.concat(F.lit("owner_"), F.col("catalog_name")).alias("catalog_owner"),
        F.min("created_at").alias("created_at"),
        F.lit("me").alias("created_by"),
        F.max("last_altered_at").alias("last_altered_at"),
        F.lit("me").alias("last_altered_by"),
    )


@query(
    "f8_catalog_metadata",
    SCHEMATA
    + """ SELECT c.catalog_name, catalog_owner, c.created_at, created_by, c.last_altered_at, c.last_altered_by,
      count(*) OVER () AS schema_count, schema_name, schema_owner, s.created_at AS schema_created_at,
      s.last_altered_at AS schema_altered_at
    FROM catalogs c JOIN schemata s USING (catalog_name) WHERE catalog_name = 'economy'""",
)
def f8(t: Tables) -> DataFrame:
    return catalog.catalog_metadata(catalogs(t), schemata(t), "economy")


# Part 2 names a table, and so a schema, that every scale has.
@query(
    "f9_schema_metadata",
    SCHEMATA
    + """ SELECT catalog_name, schema_name, schema_owner, created_at, last_altered_at, last_altered_by,
      count(*) OVER () AS table_count, table_name, table_type, comment, data_source_format, storage_path
    FROM schemata JOIN info_tables USING (catalog_name, schema_name)
    WHERE (catalog_name, schema_name) = (SELECT (catalog_name, schema_name) FROM info_tables WHERE table_name = 't2')""",
)
def f9(t: Tables) -> DataFrame:
    name = inputs.info_tables(t).filter("table_name = 't2'").first()
    return catalog.schema_metadata(
        schemata(t), inputs.info_tables(t), name["catalog_name"], name["schema_name"]
    )


_PART = "(SELECT * FROM info_tables WHERE table_name = 't2')"


@query(
    "f10_table_metadata",
    INFO
    + f""" SELECT catalog_name, schema_name, table_name, table_type, p.comment, data_source_format, storage_path,
      count(*) OVER () AS column_count, column_name, ordinal_position, data_type, is_nullable,
      c.comment AS column_comment
    FROM {_PART} p JOIN info_columns c USING (catalog_name, schema_name, table_name)""",
)
def f10(t: Tables) -> DataFrame:
    name = inputs.info_tables(t).filter("table_name = 't2'").first()
    return catalog.table_metadata(
        inputs.info_tables(t), inputs.info_columns(t), name["catalog_name"], name["schema_name"], "t2"
    )


NAMED = "WITH " + inputs.NAMED_SQL.strip()


@query("f11_listed_tables", NAMED + ' SELECT "table" FROM listed')
def f11(t: Tables) -> DataFrame:
    return catalog.listed_tables(inputs.named_tables(t))


@query(
    "a9_name_hierarchy",
    NAMED
    + """ SELECT "table" AS full_name, split_part("table", '.', 1) AS catalog_name,
      split_part("table", '.', 2) AS schema_name, split_part("table", '.', 3) AS table_name FROM listed""",
)
def a9(t: Tables) -> DataFrame:
    return catalog.name_hierarchy(inputs.named_tables(t))


@query(
    "l1_table_search",
    NAMED
    + """ SELECT "table" FROM listed WHERE contains(lower("table"), 'lake')
    ORDER BY CASE WHEN starts_with(lower("table"), 'lake') THEN 0 ELSE 1 END, "table" LIMIT 20""",
)
def l1(t: Tables) -> DataFrame:
    return catalog.search_tables(inputs.named_tables(t), " LAKE ")


@query(
    "l4_one_row_lookup",
    INFO + f" SELECT {TABLE_COLUMNS} FROM info_tables WHERE table_name = 't2'",
)
def l4(t: Tables) -> DataFrame:
    found = inputs.info_tables(t).filter("table_name = 't2'")
    return found.orderBy("catalog_name", "schema_name", "table_name").limit(1)


JOINED = """, joined AS (
  SELECT t.catalog_name || '.' || t.schema_name || '.' || t.table_name AS full_name, t.*,
         column_name, ordinal_position, data_type,
         CASE is_nullable WHEN 'YES' THEN true WHEN 'NO' THEN false END AS is_nullable,
         c.comment AS column_comment
  FROM visible_tables t LEFT JOIN visible_columns c USING (catalog_name, schema_name, table_name))"""


def _snapshot(t: Tables) -> DataFrame:
    return catalog.catalog_snapshot(
        catalog.visible(inputs.info_tables(t)), catalog.visible(inputs.info_columns(t))
    )


@query("j9_tables_with_columns", INFO + JOINED + " SELECT * FROM joined")
def j9(t: Tables) -> DataFrame:
    return catalog.tables_with_columns(
        catalog.visible(inputs.info_tables(t)), catalog.visible(inputs.info_columns(t))
    )


@query("a8_catalog_snapshot", INFO + JOINED + " SELECT * FROM joined")
def a8(t: Tables) -> DataFrame:
    return _snapshot(t)


@query(
    "a8_schemas_of_snapshot",
    INFO
    + JOINED
    + """ SELECT catalog_name, schema_name, count(DISTINCT table_name) AS table_count,
      count(column_name) AS column_count FROM joined GROUP BY catalog_name, schema_name""",
)
def a8_schemas(t: Tables) -> DataFrame:
    return catalog.snapshot_by_schema(_snapshot(t))


@query("l2_sorted_catalog", INFO + " SELECT * FROM visible_columns")
def l2(t: Tables) -> DataFrame:
    names = ["catalog_name", "schema_name", "table_name", "ordinal_position", "column_name"]
    return catalog.visible(inputs.info_columns(t)).orderBy(*names)


@query(
    "a7_snapshot_stats",
    INFO
    + JOINED
    + """ SELECT count(DISTINCT catalog_name) AS catalog_count,
      count(DISTINCT (catalog_name, schema_name)) AS schema_count,
      count(DISTINCT full_name) AS table_count, count(column_name) AS column_count FROM joined""",
)
def a7(t: Tables) -> DataFrame:
    return catalog.snapshot_stats(_snapshot(t))


@query("s8_kept_snapshot", INFO + JOINED + " SELECT * FROM joined")
def s8(t: Tables) -> DataFrame:
    return refresh_snapshot(inputs.info_tables(t), inputs.info_columns(t), new_path(t.spark, "snapshot"))


@query(
    "s8_kept_snapshot_json",
    INFO + " SELECT catalog_name, schema_name, table_name, storage_path FROM visible_tables",
)
def s8_json(t: Tables) -> DataFrame:
    path = new_path(t.spark, "snapshot")
    tables = catalog.visible(inputs.info_tables(t)).select(
        "catalog_name", "schema_name", "table_name", "storage_path"
    )
    write_snapshot(tables, path, "json")
    return load_snapshot(t.spark, path, "json", tables.schema)


TEXT = "D_1"
HIT = " OR ".join(
    f"contains(lower({c}), lower('{TEXT}'))" for c in ("catalog_name", "schema_name", "table_name", "full_name")
)
TREE = (
    INFO
    + """, tree AS (SELECT *, catalog_name || '.' || schema_name || '.' || table_name AS full_name FROM info_tables)"""
)


def _tree(t: Tables) -> DataFrame:
    name = F.concat_ws(".", "catalog_name", "schema_name", "table_name")
    return inputs.info_tables(t).withColumn("full_name", name)


@query("a12_matching_tables", TREE + f" SELECT catalog_name, schema_name, table_name FROM tree WHERE {HIT}")
def a12(t: Tables) -> DataFrame:
    return catalog.matching_tables(_tree(t), TEXT).select("catalog_name", "schema_name", "table_name")


@query(
    "a12_matching_schemas",
    TREE
    + f" SELECT catalog_name, schema_name, count(*) AS match_count FROM tree WHERE {HIT}"
    " GROUP BY catalog_name, schema_name",
)
def a12_schemas(t: Tables) -> DataFrame:
    return catalog.matching_schemas(_tree(t), TEXT)


@query(
    "a12_matching_children",
    INFO + " SELECT catalog_name, schema_name, table_name FROM info_tables WHERE contains(lower(table_name), 't19')",
)
def a12_children(t: Tables) -> DataFrame:
    found = catalog.matching_children(inputs.info_tables(t), "table_name", "T19")
    return found.select("catalog_name", "schema_name", "table_name")
