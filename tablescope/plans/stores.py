"""Registered upsert, write-back and ingest queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.operators import keys, upsert
from tablescope.plans import inputs
from tablescope.plans.keys import CLASSIFIED, CONFIDENCE, FOREIGN_KEYS_SQL, PROFILE, SCORED_SQL, Scored, Star
from tablescope.plans.registry import Tables, query
from tablescope.sources.lineage import column_pairs, table_lineage, table_pairs
from tablescope.streaming.ingest import EdgeLog, ingest_edges
from tablescope.streaming.keyed import KeyedEdgeLog
from tablescope.workspace import new_path, written

def at():
    return F.lit(datetime(2024, 1, 31)).cast("timestamp_ntz")


# Profile rows at the grain of line items: a table per part, a column per order line.
WIDE_PROFILE_SQL = """WITH wide AS (
  SELECT 'lake' AS catalog_name, 'parts' AS schema_name, 'p' || l_partkey AS table_name,
         'c' || l_linenumber AS column_name, max(l_quantity)::BIGINT AS row_count, 'LONG' AS data_type,
         count(*) AS distinct_count, round(max(l_discount), 4) AS null_ratio,
         round(max(l_tax) + 0.9, 4) AS uniqueness_ratio
  FROM lineitem GROUP BY l_partkey, l_linenumber
), wide_tables AS (
  SELECT catalog_name || '.' || schema_name || '.' || table_name AS full_name, catalog_name AS catalog,
         schema_name AS "schema", table_name AS name, max(row_count) AS row_count FROM wide
  GROUP BY catalog_name, schema_name, table_name
)"""


def wide_profile(t: Tables) -> DataFrame:
    return (
        t["lineitem"]
        .groupBy("l_partkey", "l_linenumber")
        .agg(
            F.max("l_quantity").cast("bigint").alias("row_count"),
            F.count(F.lit(1)).alias("distinct_count"),
            F.round(F.max("l_discount"), 4).alias("null_ratio"),
            F.round(F.max("l_tax") + 0.9, 4).alias("uniqueness_ratio"),
        )
        .select(
            F.lit("lake").alias("catalog_name"),
            F.lit("parts").alias("schema_name"),
            F.concat(F.lit("p"), "l_partkey").alias("table_name"),
            F.concat(F.lit("c"), "l_linenumber").alias("column_name"),
            F.lit("LONG").alias("data_type"),
            "row_count",
            "distinct_count",
            "null_ratio",
            "uniqueness_ratio",
        )
    )


def known_tables(t: Tables) -> DataFrame:
    """Table rows of all parts, as an earlier run has left them."""
    name = F.concat(F.lit("p"), "p_partkey")
    return t["part"].select(
        F.concat(F.lit("lake.parts."), name).alias("full_name"),
        F.lit("lake").alias("catalog"),
        F.lit("parts").alias("schema"),
        name.alias("name"),
        F.col("p_partkey").alias("row_count"),
        F.col("p_brand").alias("owner"),
    )


@query(
    "s9_upsert_tables",
    WIDE_PROFILE_SQL
    + """ SELECT 'lake.parts.p' || p_partkey AS full_name, 'lake' AS catalog, 'parts' AS "schema",
      'p' || p_partkey AS name, coalesce(w.row_count, p_partkey) AS row_count, p_brand AS owner
    FROM part LEFT JOIN wide_tables w ON w.full_name = 'lake.parts.p' || p_partkey""",
)
def s9(t: Tables) -> DataFrame:
    return upsert.upsert_tables(known_tables(t), wide_profile(t))


@query(
    "s10_upsert_columns",
    WIDE_PROFILE_SQL
    + """ SELECT catalog_name || '.' || schema_name || '.' || table_name || '.' || column_name AS id,
      catalog_name || '.' || schema_name || '.' || table_name AS full_name, column_name AS name,
      data_type, distinct_count, null_ratio, uniqueness_ratio FROM wide
    WHERE table_name IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 10)""",
)
def s10(t: Tables) -> DataFrame:
    known = t["part"].filter("p_size > 10").select(
        F.concat(F.lit("lake.parts.p"), "p_partkey").alias("full_name")
    )
    return upsert.upsert_columns(None, wide_profile(t), known)


EDGES = "WITH " + inputs.EDGES_SQL.strip()


@query(
    "s11_upsert_lineage_edges",
    EDGES + " SELECT source, target FROM edges UNION SELECT 'raw.supplier.s' || s_suppkey, 'raw.nation.n' || s_nationkey FROM supplier",
)
def s11(t: Tables) -> DataFrame:
    current = t["supplier"].select(
        F.concat(F.lit("raw.supplier.s"), "s_suppkey").alias("source"),
        F.concat(F.lit("raw.nation.n"), "s_nationkey").alias("target"),
    )
    return upsert.merge_edges(current, inputs.edges(t))


@query(
    "s11_tables_of_lineage",
    EDGES
    + """ SELECT 'stage.part.p' || p_partkey AS full_name, p_brand AS owner FROM part
    UNION ALL (SELECT DISTINCT source, NULL FROM edges WHERE source LIKE 'raw.%')""",
)
def s11_tables(t: Tables) -> DataFrame:
    known = t["part"].select(
        F.concat(F.lit("stage.part.p"), "p_partkey").alias("full_name"), F.col("p_brand").alias("owner")
    )
    return upsert.upsert_lineage_tables(known, inputs.edges(t))


# Streams read the line items where they lie; a stream without end would bring more files.


def _stream_of(t: Tables, folder: str, files: int) -> DataFrame:
    """Line items as they arrive in a folder, some files per batch."""
    schema = T.StructType([*t["lineitem"].schema.fields, T.StructField("lot", T.IntegerType())])
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def _arrived(t: Tables, rows: DataFrame, folder: str, lots: int) -> int:
    """Append rows to a folder and say how many files make a lot of them.

    Each task deals its own rows, so a file is never more than one split of the line items, and
    the files of a batch are read side by side.
    """
    lot = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(lots)).cast("int")
    before = _files(t, folder)
    rows.withColumn("lot", lot).write.mode("append").partitionBy("lot").parquet(folder)
    return max(1, -(-(_files(t, folder) - before) // lots))


def _files(t: Tables, folder: str) -> int:
    place = t.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/lot=*/*.parquet")
    found = place.getFileSystem(t.spark._jsc.hadoopConfiguration()).globStatus(place)
    return len(found) if found else 0


def _line_item_stream(t: Tables) -> DataFrame:
    folder = new_path(t.spark, "line-items")
    return _stream_of(t, folder, _arrived(t, t["lineitem"], folder, 3))


def _ingested(t: Tables, rows: DataFrame, schema: str, to_edges) -> DataFrame:
    log = KeyedEdgeLog(t.spark, new_path(t.spark, "edge-log"), schema)
    log.ingest(rows, to_edges).awaitTermination()
    return log.edges()


EDGE_SCHEMA = "source string, target string"

STREAMED = """SELECT DISTINCT 'raw.supplier.s' || l_suppkey AS source, 'stage.part.p' || l_partkey AS target
  FROM lineitem WHERE l_suppkey <> 13"""


def _streamed_edges(t: Tables) -> DataFrame:
    log = _line_item_stream(t).select(
        F.concat(F.lit("raw.supplier.s"), F.nullif("l_suppkey", F.lit(13))).alias("source_table_full_name"),
        F.concat(F.lit("stage.part.p"), "l_partkey").alias("target_table_full_name"),
    )
    return _ingested(t, log, "source string, target string", table_pairs)


@query("s12_batched_table_lineage", STREAMED)
def s12(t: Tables) -> DataFrame:
    return _streamed_edges(t)


@query(
    "s13_batched_column_lineage",
    """SELECT DISTINCT 'raw.supplier.s' || l_suppkey AS source_table, 'line_' || l_linenumber AS source_column,
      'stage.part.p' || l_partkey AS target_table, 'supply' AS target_column FROM lineitem""",
)
def s13(t: Tables) -> DataFrame:
    log = _line_item_stream(t).select(
        F.concat(F.lit("raw.supplier.s"), "l_suppkey").alias("source_table_full_name"),
        F.concat(F.lit("line_"), "l_linenumber").alias("source_column_name"),
        F.concat(F.lit("stage.part.p"), "l_partkey").alias("target_table_full_name"),
        F.lit("supply").alias("target_column_name"),
    )
    schema = "source_table string, source_column string, target_table string, target_column string"
    return _ingested(t, log, schema, column_pairs)


@query("t1_incremental_ingest", STREAMED)
def t1(t: Tables) -> DataFrame:
    """A stream of several files that stops, goes on with later files, and is replayed whole."""
    folder, log = new_path(t.spark, "line-items"), EdgeLog(t.spark, new_path(t.spark, "edge-log"), EDGE_SCHEMA)
    first, second = new_path(t.spark, "ingest-state"), new_path(t.spark, "ingest-state")
    for arriving, state in (("l_linenumber < 4", first), ("l_linenumber >= 4", first), (None, second)):
        if arriving:
            files = _arrived(t, t["lineitem"].filter(arriving), folder, 2)
        rows = _stream_of(t, folder, files).select(
            F.concat(F.lit("raw.supplier.s"), F.nullif("l_suppkey", F.lit(13))).alias("source_table_full_name"),
            F.concat(F.lit("stage.part.p"), "l_partkey").alias("target_table_full_name"),
        )
        ingest_edges(rows, log, state, table_lineage).awaitTermination()
    return log.edges()


@query("t1_keyed_ingest", STREAMED)
def t1_keyed(t: Tables) -> DataFrame:
    """A stream that stops, goes on with later files, and is delivered all of them a second time."""
    folder, log = new_path(t.spark, "line-items"), KeyedEdgeLog(t.spark, new_path(t.spark, "edge-log"), EDGE_SCHEMA)
    for arriving in ("l_linenumber < 4", "l_linenumber >= 4", "true"):
        files = _arrived(t, t["lineitem"].filter(arriving), folder, 2)
        rows = _stream_of(t, folder, files).select(
            F.concat(F.lit("raw.supplier.s"), F.nullif("l_suppkey", F.lit(13))).alias("source"),
            F.concat(F.lit("stage.part.p"), "l_partkey").alias("target"),
        )
        log.ingest(rows).awaitTermination()
    return log.edges()


@query(
    "s14_duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def s14(t: Tables) -> DataFrame:
    return upsert.duplicate_keys(t["lineitem"], ["l_orderkey", "l_linenumber"])


@query(
    "s15_write_back_keys",
    WIDE_PROFILE_SQL
    + """ SELECT 'lake.parts.' || table_name || '.' || column_name AS id, 'lake.parts.' || table_name AS full_name,
      column_name AS name, data_type, distinct_count, null_ratio, uniqueness_ratio,
      CASE WHEN is_key THEN true END AS is_primary_key, CASE WHEN is_key THEN uniqueness_ratio END AS pk_confidence,
      CASE WHEN is_key THEN 'rule_based' END AS pk_source,
      CASE WHEN is_key THEN TIMESTAMP '2024-01-31' END AS pk_last_updated
    FROM (SELECT *, uniqueness_ratio > 0.95 AND null_ratio < 0.05 AS is_key FROM wide)""",
)
def s15(t: Tables) -> DataFrame:
    profile = wide_profile(t)
    columns = upsert.column_nodes(profile, upsert.table_nodes(profile))
    return upsert.write_back_keys(columns, keys.detect_primary_keys(profile), at())


@query(
    "i1_primary_keys_written_back",
    PROFILE
    + """ SELECT full_name || '.' || column_name AS id, round(uniqueness_ratio, 6) AS pk_confidence
    FROM profile WHERE uniqueness_ratio > 0.95 AND null_ratio < 0.05""",
)
def i1(t: Tables) -> DataFrame:
    found = Star(t)
    marked = upsert.write_back_keys(found.nodes()[1], found.keys, at())
    return marked.filter("is_primary_key").select("id", F.round("pk_confidence", 6).alias("pk_confidence"))


@query(
    "s16_upsert_foreign_keys",
    FOREIGN_KEYS_SQL
    + """ SELECT target_table || '.' || fk_column AS fk, dimension_table || '.' || pk_column AS pk,
      0.8::DOUBLE AS confidence, 'semantic' AS relationship_type, 'rule_based' AS source,
      TIMESTAMP '2024-01-31' AS last_updated FROM foreign_keys""",
)
def s16(t: Tables) -> DataFrame:
    found = Star(t)
    return upsert.upsert_relations(None, found.foreign_keys(), found.nodes()[1], at())


@query(
    "s17_write_back_scores",
    SCORED_SQL
    + f""" SELECT fk, pk, {CONFIDENCE} AS confidence, round(naming, 6) AS naming_score,
      0.2::DOUBLE AS semantic_score, lineage AS lineage_score FROM scored""",
)
def s17(t: Tables) -> DataFrame:
    found = Scored(t)
    unscored = found.relations.withColumn("confidence", F.lit(0.8))
    return upsert.write_back_scores(unscored, found.scores).withColumns(
        {"confidence": F.round("confidence", 6), "naming_score": F.round("naming_score", 6)}
    )


@query(
    "s18_write_back_types",
    SCORED_SQL
    + CLASSIFIED
    + """ SELECT full_name, row_count, round(fact_score, 6) AS fact_score, fk_columns, dim_connections,
      CASE WHEN fact_score > (SELECT median(fact_score) FROM fact_scores) THEN 'FACT' ELSE 'DIM' END AS table_type
    FROM fact_scores JOIN (SELECT full_name, max(row_count) AS row_count FROM profile GROUP BY full_name)
      USING (full_name)""",
)
def s18(t: Tables) -> DataFrame:
    found = Scored(t)
    classified = keys.classify_tables(found.profile, found.scores, found.columns)
    return upsert.write_back_types(found.tables, classified).select(
        "full_name",
        "row_count",
        F.round("fact_score", 6).alias("fact_score"),
        "fk_columns",
        "dim_connections",
        "table_type",
    )


@query(
    "u1_upsert",
    """WITH latest AS (
      SELECT CASE WHEN event_type = 'error' THEN -user_id ELSE user_id END AS user,
        arg_max(event_type, (ts, event_id)) AS last_event, arg_max(value, (ts, event_id)) AS last_value
      FROM events GROUP BY ALL)
    SELECT coalesce(c.c_custkey, l.user) AS id, c.c_name AS name,
      CASE WHEN l.user IS NULL THEN c.c_mktsegment ELSE last_event END AS state, l.last_value
    FROM customer c FULL JOIN latest l ON l.user = c.c_custkey""",
)
def u1(t: Tables) -> DataFrame:
    """Customers, with the state of those that occur in the events replaced by their last one.

    Errors go by another key than customers have, so they are inserted.
    """
    current = t["customer"].select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("state")
    )
    updates = t["events"].select(
        F.when(F.col("event_type") == "error", -F.col("user_id")).otherwise(F.col("user_id")).alias("id"),
        F.col("event_type").alias("state"),
        F.col("value").alias("last_value"),
        F.struct("ts", "event_id").alias("version"),
    )
    return upsert.upsert(current, updates, ["id"], version="version")


@query(
    "u1_versioned_store",
    """SELECT 'lake.parts.p' || p_partkey AS full_name, p_brand AS owner, p_size::BIGINT AS row_count FROM part""",
)
def u1_store(t: Tables) -> DataFrame:
    """Two upserts, each kept as a version; the second reads what the first has written."""
    store = upsert.VersionedTable(t.spark, new_path(t.spark, "store"))
    name = F.concat(F.lit("lake.parts.p"), "p_partkey").alias("full_name")
    store.write(upsert.upsert(store.read(), t["part"].select(name, F.col("p_brand").alias("owner")), ["full_name"]))
    sizes = t["part"].select(name, F.col("p_size").cast("bigint").alias("row_count"))
    store.write(upsert.upsert(store.read(), sizes, ["full_name"]))
    return store.read()


@query(
    "s14_keys_hold",
    "SELECT 'lake.parts.p' || p_partkey AS full_name, count(*) AS rows FROM part GROUP BY 1 HAVING count(*) > 1",
)
def s14_holds(t: Tables) -> DataFrame:
    return upsert.duplicate_keys(written(s9(t), "tables"), ["full_name"])
