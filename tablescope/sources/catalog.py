"""Catalog sources and the snapshot that is kept of them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tablescope.operators.catalog import all_columns, all_tables, catalog_snapshot
from tablescope.operators.profile import columns_of
from tablescope.operators.upsert import VersionedTable

TABLE_SCHEMA = (
    "catalog_name string, schema_name string, table_name string, table_type string, "
    "comment string, data_source_format string, storage_path string"
)


def tables_of(
    tables: Mapping[str, DataFrame],
    table_type: str = "EXTERNAL",
    data_source_format: str | None = None,
    paths: Mapping[str, str] | None = None,
) -> DataFrame:
    """Table rows, as the information schema lists them, for frames given by full name."""
    rows = [
        (*name.split(".", 2), table_type, None, data_source_format, (paths or {}).get(name))
        for name in tables
    ]
    return SparkSession.active().createDataFrame(rows, TABLE_SCHEMA)


def session_tables(spark: SparkSession, catalog: str | None = None) -> dict[str, DataFrame]:
    """The tables of every database of a session catalog, by full name."""
    catalog = catalog or spark.catalog.currentCatalog()
    found = {}
    for database in spark.catalog.listDatabases():
        for table in spark.catalog.listTables(database.name):
            if not table.isTemporary:
                name = f"{catalog}.{database.name}.{table.name}"
                found[name] = spark.table(f"`{catalog}`.`{database.name}`.`{table.name}`")
    return found


def write_snapshot(snapshot: DataFrame, path: str, file_format: str = "parquet") -> int:
    """Keep a snapshot as the next version under ``path``."""
    return VersionedTable(snapshot.sparkSession, path, file_format).write(snapshot)


def load_snapshot(spark: SparkSession, path: str, file_format: str = "parquet", schema=None) -> DataFrame:
    """The last complete snapshot under ``path``."""
    snapshot = VersionedTable(spark, path, file_format).read(schema=schema)
    if snapshot is None:
        raise FileNotFoundError(f"no snapshot under {path}")
    return snapshot


def refresh_snapshot(tables: DataFrame, columns: DataFrame, path: str) -> DataFrame:
    """Read the visible tables and columns, build the snapshot, keep it, and return it."""
    write_snapshot(catalog_snapshot(all_tables(tables), all_columns(columns)), path)
    return load_snapshot(tables.sparkSession, path)


def refresh_from_session(spark: SparkSession, path: str) -> DataFrame:
    """Refresh the snapshot from the tables of the session catalog."""
    found = session_tables(spark)
    return refresh_snapshot(tables_of(found, "MANAGED"), columns_of(found), path)
