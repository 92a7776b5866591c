"""Metadata tables derived from the test tables, in Spark and in SQL.

The test data holds no lineage log, information schema or foreign-key table, so each is
spelled from the rows that are there and grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.operators.graph import LineageGraph
from tablescope.operators.upsert import column_nodes, table_nodes
from tablescope.plans.registry import Tables
from tablescope.sources.lineage import column_lineage, graph_edges, parse_graphs, table_lineage
from tablescope.workspace import written


def _name(prefix: str, key) -> Column:
    return F.concat(F.lit(prefix), key)


def _part(key) -> Column:
    return _name("stage.part.p", key)


def _half(key: str, by: int) -> Column:
    return F.floor(F.col(key) / by)


# Table lineage: suppliers feed the parts of their line items; part k feeds k/2 and k/3.

LINEAGE_LOG_SQL = """
lineage_log AS (
  SELECT 'raw.supplier.s' || nullif(l_suppkey, 13) AS source_table_full_name,
         'stage.part.p' || l_partkey AS target_table_full_name
  FROM lineitem
  UNION ALL
  SELECT 'stage.part.p' || p_partkey, 'stage.part.p' || (p_partkey // 2) FROM part WHERE p_partkey >= 2
  UNION ALL
  SELECT 'stage.part.p' || p_partkey, 'stage.part.p' || (p_partkey // 3) FROM part WHERE p_partkey >= 2
)"""

EDGES_SQL = (
    LINEAGE_LOG_SQL
    + """, edges AS (
  SELECT DISTINCT source_table_full_name AS source, target_table_full_name AS target
  FROM lineage_log
  WHERE source_table_full_name IS NOT NULL AND target_table_full_name IS NOT NULL
)"""
)


def lineage_log(t: Tables) -> DataFrame:
    supplied = t["lineitem"].select(
        _name("raw.supplier.s", F.nullif("l_suppkey", F.lit(13))).alias("source_table_full_name"),
        _part(F.col("l_partkey")).alias("target_table_full_name"),
    )
    derived = t["part"].filter("p_partkey >= 2").select(
        _part(F.col("p_partkey")).alias("source_table_full_name"),
        F.explode(F.array(_part(_half("p_partkey", 2)), _part(_half("p_partkey", 3)))).alias(
            "target_table_full_name"
        ),
    )
    return supplied.unionByName(derived)


def edges(t: Tables) -> DataFrame:
    return table_lineage(lineage_log(t))


def graph(t: Tables) -> LineageGraph:
    return LineageGraph(edges(t))


# Column lineage over the same tables.

COLUMN_LOG_SQL = """
column_log AS (
  SELECT 'raw.supplier.s' || nullif(l_suppkey, 13) AS source_table, 'suppkey' AS source_column,
         'stage.part.p' || l_partkey AS target_table, 'supply' AS target_column
  FROM lineitem
  UNION ALL
  SELECT 'stage.part.p' || p_partkey, 'supply', 'stage.part.p' || (p_partkey // 2), 'supply'
  FROM part WHERE p_partkey >= 2
  UNION ALL
  SELECT 'stage.part.p' || p_partkey, 'price', 'stage.part.p' || (p_partkey // 3), 'price'
  FROM part WHERE p_partkey >= 2
  UNION ALL
  SELECT 'stage.part.p' || p_partkey, 'price', 'stage.part.p' || (p_partkey // 2), 'supply'
  FROM part WHERE p_partkey >= 2
),
column_edges AS (
  SELECT DISTINCT * FROM column_log WHERE source_table IS NOT NULL
),
cedges AS (
  SELECT DISTINCT source_table || '.' || source_column AS source,
         target_table || '.' || target_column AS target
  FROM column_edges
),
cnodes AS (
  SELECT source_table || '.' || source_column AS id, source_table AS "table", source_column AS "column"
  FROM column_edges
  UNION
  SELECT target_table || '.' || target_column, target_table, target_column FROM column_edges
)"""


def column_log(t: Tables) -> DataFrame:
    supplied = t["lineitem"].select(
        _name("raw.supplier.s", F.nullif("l_suppkey", F.lit(13))).alias("source_table_full_name"),
        F.lit("suppkey").alias("source_column_name"),
        _part(F.col("l_partkey")).alias("target_table_full_name"),
        F.lit("supply").alias("target_column_name"),
    )

    def entry(source_column: str, by: int, target_column: str) -> Column:
        return F.struct(
            _part(F.col("p_partkey")).alias("source_table_full_name"),
            F.lit(source_column).alias("source_column_name"),
            _part(_half("p_partkey", by)).alias("target_table_full_name"),
            F.lit(target_column).alias("target_column_name"),
        )

    entries = F.array(entry("supply", 2, "supply"), entry("price", 3, "price"), entry("price", 2, "supply"))
    derived = t["part"].filter("p_partkey >= 2").select(F.inline(entries))
    return supplied.unionByName(derived)


def column_edges(t: Tables) -> DataFrame:
    return column_lineage(column_log(t))


# Lineage graph documents: one JSON text per part; the second edge leaves is_join out.

FLOW_SQL = """
flow_rows AS (
  SELECT 'stage.part.p' || p_partkey AS source, 'stage.part.p' || (p_partkey // 2) AS target,
         p_size > 25 AS is_join
  FROM part WHERE p_partkey >= 2
  UNION ALL
  SELECT 'stage.part.p' || p_partkey, 'stage.part.p' || (p_partkey // 3), false
  FROM part WHERE p_partkey >= 2
),
flow AS (SELECT source, target, bool_or(is_join) AS is_join FROM flow_rows GROUP BY source, target),
flow_both AS (
  SELECT source AS here, target AS there FROM flow UNION SELECT target, source FROM flow
)"""


def graph_documents(t: Tables) -> DataFrame:
    """One graph document per part, as text in column ``text``."""
    here = _part(F.col("p_partkey"))
    half = F.struct(
        here.alias("source"),
        _part(_half("p_partkey", 2)).alias("target"),
        F.when(F.col("p_size") > 25, True).otherwise(False).alias("is_join"),
    )
    third = F.struct(
        here.alias("source"),
        _part(_half("p_partkey", 3)).alias("target"),
        F.lit(None).cast("boolean").alias("is_join"),
    )
    document = F.struct(
        F.array(F.struct(here.alias("id"))).alias("nodes"), F.array(half, third).alias("edges")
    )
    return t["part"].filter("p_partkey >= 2").select(F.to_json(document).alias("text"))


def flow_edges(t: Tables) -> DataFrame:
    return graph_edges(parse_graphs(graph_documents(t), "text"))


def flow_graph(t: Tables) -> LineageGraph:
    return LineageGraph(flow_edges(t))


# The information schema: a table per part, a column per line item.

INFO_SQL = """
info_tables AS (
  SELECT CASE p_type WHEN 'PROMO' THEN 'system' ELSE lower(p_type) END AS catalog_name,
         CASE p_brand WHEN 'Brand#7' THEN 'information_schema'
              ELSE replace(lower(p_brand), '#', '_') END AS schema_name,
         't' || p_partkey AS table_name,
         CASE WHEN p_size > 25 THEN 'MANAGED' ELSE 'VIEW' END AS table_type,
         nullif(p_name, 'small ring') AS comment,
         CASE WHEN p_size > 25 THEN 'PARQUET' END AS data_source_format,
         '/lake/' || p_partkey AS storage_path
  FROM part
),
info_columns AS (
  SELECT catalog_name, schema_name, table_name,
         'c' || l_orderkey || '_' || l_linenumber AS column_name,
         l_linenumber AS ordinal_position,
         CASE l_returnflag WHEN 'A' THEN 'bigint' WHEN 'N' THEN 'string' ELSE 'double' END AS data_type,
         CASE l_linestatus WHEN 'O' THEN CASE WHEN l_tax > 0.02 THEN 'YES' ELSE 'NO' END END AS is_nullable,
         nullif(l_returnflag, 'R') AS comment
  FROM lineitem JOIN info_tables ON table_name = 't' || l_partkey
),
visible_tables AS (
  SELECT * FROM info_tables WHERE schema_name <> 'information_schema' AND catalog_name <> 'system'
),
visible_columns AS (
  SELECT * FROM info_columns WHERE schema_name <> 'information_schema' AND catalog_name <> 'system'
)"""


def info_tables(t: Tables) -> DataFrame:
    return t["part"].select(
        F.when(F.col("p_type") == "PROMO", "system").otherwise(F.lower("p_type")).alias("catalog_name"),
        F.when(F.col("p_brand") == "Brand#7", "information_schema")
        .otherwise(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")))
        .alias("schema_name"),
        _name("t", F.col("p_partkey")).alias("table_name"),
        F.when(F.col("p_size") > 25, "MANAGED").otherwise("VIEW").alias("table_type"),
        F.nullif("p_name", F.lit("small ring")).alias("comment"),
        F.when(F.col("p_size") > 25, "PARQUET").alias("data_source_format"),
        _name("/lake/", F.col("p_partkey")).alias("storage_path"),
    )


def info_columns(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = t["lineitem"].select(
        _name("t", F.col("l_partkey")).alias("table_name"),
        F.concat(F.lit("c"), "l_orderkey", F.lit("_"), "l_linenumber").alias("column_name"),
        F.col("l_linenumber").alias("ordinal_position"),
        F.when(flag == "A", "bigint").when(flag == "N", "string").otherwise("double").alias("data_type"),
        F.when(
            F.col("l_linestatus") == "O", F.when(F.col("l_tax") > 0.02, "YES").otherwise("NO")
        ).alias("is_nullable"),
        F.nullif("l_returnflag", F.lit("R")).alias("comment"),
    )
    names = info_tables(t).select("catalog_name", "schema_name", "table_name")
    return rows.join(names, "table_name").select(
        "catalog_name",
        "schema_name",
        "table_name",
        "column_name",
        "ordinal_position",
        "data_type",
        "is_nullable",
        "comment",
    )


# Graph-store table names: some lack the full name, some have two or four parts.

NAMED_SQL = """
named AS (
  SELECT CASE WHEN p_size > 5 THEN lower(p_type) || '.' || replace(lower(p_brand), '#', '_') || '.'
              || replace(p_name, ' ', CASE WHEN p_size > 45 THEN '.' ELSE '_' END) || '_' || p_partkey END
           AS full_name,
         CASE WHEN p_size > 2 THEN 'lake.loose.p' || p_partkey ELSE 'loose.p' || p_partkey END AS name
  FROM part
),
listed AS (
  SELECT DISTINCT coalesce(full_name, name) AS "table" FROM named
  WHERE len(string_split(coalesce(full_name, name), '.')) = 3
)"""


def named_tables(t: Tables) -> DataFrame:
    joiner = F.when(F.col("p_size") > 45, ".").otherwise("_")
    full = F.concat(
        F.lower("p_type"),
        F.lit("."),
        F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")),
        F.lit("."),
        F.replace("p_name", F.lit(" "), joiner),
        F.lit("_"),
        "p_partkey",
    )
    loose = F.when(F.col("p_size") > 2, _name("lake.loose.p", F.col("p_partkey"))).otherwise(
        _name("loose.p", F.col("p_partkey"))
    )
    return t["part"].select(F.when(F.col("p_size") > 5, full).alias("full_name"), loose.alias("name"))


# The star tables, with some values taken out, under three-part names.

# Columns and rule types of the star tables.
STAR_COLUMNS = {
    "region": {"r_regionkey": "INTEGER", "r_name": "STRING"},
    "nation": {"n_nationkey": "INTEGER", "n_name": "STRING", "n_regionkey": "INTEGER"},
    "customer": {
        "c_custkey": "LONG",
        "c_name": "STRING",
        "c_nationkey": "INTEGER",
        "c_acctbal": "DOUBLE",
        "c_mktsegment": "STRING",
    },
    "supplier": {"s_suppkey": "LONG", "s_name": "STRING", "s_nationkey": "INTEGER", "s_acctbal": "DOUBLE"},
    "part": {
        "p_partkey": "LONG",
        "p_name": "STRING",
        "p_brand": "STRING",
        "p_type": "STRING",
        "p_size": "INTEGER",
        "p_retailprice": "DOUBLE",
    },
    "orders": {
        "o_orderkey": "LONG",
        "o_custkey": "LONG",
        "o_orderstatus": "STRING",
        "o_totalprice": "DOUBLE",
        "o_orderdate": "TIMESTAMP",
        "o_orderpriority": "STRING",
    },
    "lineitem": {
        "l_orderkey": "LONG",
        "l_partkey": "LONG",
        "l_suppkey": "LONG",
        "l_linenumber": "INTEGER",
        "l_quantity": "DOUBLE",
        "l_extendedprice": "DOUBLE",
        "l_discount": "DOUBLE",
        "l_tax": "DOUBLE",
        "l_returnflag": "STRING",
        "l_linestatus": "STRING",
        "l_shipdate": "TIMESTAMP",
    },
}
# Which star table is made from which.
STAR_LINEAGE = [
    ("region", "nation"),
    ("nation", "customer"),
    ("nation", "supplier"),
    ("customer", "orders"),
    ("orders", "lineitem"),
    ("part", "lineitem"),
    ("supplier", "lineitem"),
]

STAR_SQL = """
star_customer AS (
  SELECT * REPLACE (nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment) FROM customer
),
star_orders AS (
  SELECT * REPLACE (nullif(o_orderpriority, '5-LOW') AS o_orderpriority) FROM orders
)"""


def star_name(table: str) -> str:
    return f"lake.sales.{table}"


def star_sql_table(table: str) -> str:
    return f"star_{table}" if table in ("customer", "orders") else table


def star_tables(t: Tables) -> dict[str, DataFrame]:
    emptied = {"customer": ("c_mktsegment", "MACHINERY"), "orders": ("o_orderpriority", "5-LOW")}
    found = {}
    for table in STAR_COLUMNS:
        df = t[table]
        if table in emptied:
            column, value = emptied[table]
            df = df.withColumn(column, F.nullif(column, F.lit(value)))
        found[star_name(table)] = df
    return found


def star_edges(t: Tables) -> DataFrame:
    rows = [(star_name(a), star_name(b)) for a, b in STAR_LINEAGE]
    return t.spark.createDataFrame(rows, "source string, target string")


def star_roots(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(star_name(x),) for x in STAR_COLUMNS], "root string")


def per_column_sql(select: str, tables: dict[str, dict[str, str]] | None = None) -> str:
    """A UNION ALL of one SELECT per star column.

    ``select`` may use {table}, {full}, {column}, {position}, {type} and {source}.
    """
    parts = []
    for table, columns in (tables or STAR_COLUMNS).items():
        for position, (column, kind) in enumerate(columns.items(), start=1):
            parts.append(
                select.format(
                    table=table,
                    full=star_name(table),
                    column=column,
                    position=position,
                    type=kind,
                    source=star_sql_table(table),
                )
            )
    return "\nUNION ALL\n".join(parts)


PROFILE_SQL = STAR_SQL + ", profile AS (" + per_column_sql(
    "SELECT '{full}' AS full_name, '{table}' AS table_name, '{column}' AS column_name,"
    " {position} AS ordinal_position, '{type}' AS data_type, count(*) AS row_count,"
    " count(DISTINCT {column}) AS distinct_count,"
    " (count(*) - count({column}))::DOUBLE / count(*) AS null_ratio,"
    " count(DISTINCT {column})::DOUBLE / count(*) AS uniqueness_ratio FROM {source}"
) + ")"


def star_nodes(t: Tables, profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Table and column rows of a star profile."""
    tables = table_nodes(profile)
    return tables, column_nodes(profile, tables)


# A large star: orders are facts, and their line items refer to parts and suppliers.

RELATIONS_SQL = """
relation_rows AS (
  SELECT 'mart.fact.o' || l_orderkey AS fact, 'part_' || l_linenumber AS fact_column,
         'mart.dim.p' || l_partkey AS dimension, 'partkey' AS dimension_column,
         round(0.5 + l_discount * 4, 4) AS confidence
  FROM lineitem
  UNION ALL
  SELECT 'mart.fact.o' || l_orderkey, 'supp_' || l_linenumber, 'mart.dim.s' || l_suppkey, 'suppkey',
         round(0.45 + l_tax * 4, 4)
  FROM lineitem
),
relations AS MATERIALIZED (
  SELECT fact || '.' || fact_column AS fk, dimension || '.' || dimension_column AS pk, fact, dimension,
         fact_column, dimension_column, max(confidence) AS confidence
  FROM relation_rows GROUP BY ALL
)""".replace("GROUP BY ALL", "GROUP BY fact, fact_column, dimension, dimension_column")

TABLE_TYPES_SQL = """
table_types AS MATERIALIZED (
  SELECT 'mart.fact.o' || o_orderkey AS full_name,
         CASE o_orderstatus WHEN 'P' THEN NULL ELSE 'FACT' END AS table_type
  FROM orders
  UNION ALL SELECT 'mart.dim.p' || p_partkey, 'DIM' FROM part
  UNION ALL SELECT 'mart.dim.s' || s_suppkey, 'DIM' FROM supplier
)"""


def _column_numbers(t: Tables) -> DataFrame:
    """The line items with both numbers of their fact's columns, or with neither."""
    both = F.col("l_orderkey").isNotNull() & F.col("l_linenumber").isNotNull()
    return t["lineitem"].withColumns({c: F.when(both, F.col(c)) for c in ("l_orderkey", "l_linenumber")})


def relations(t: Tables) -> DataFrame:
    """Repeated relations are merged by their numbers; names are spelled afterwards."""

    def of(kind: str, key: str, confidence: Column) -> Column:
        confidence = F.round(confidence, 4)
        return F.struct(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("key"), confidence.alias("confidence"))

    sides = F.inline(
        F.array(
            of("part", "l_partkey", F.lit(0.5) + F.col("l_discount") * 4),
            of("supp", "l_suppkey", F.lit(0.45) + F.col("l_tax") * 4),
        )
    )
    numbers = _column_numbers(t).select("l_orderkey", "l_linenumber", sides)
    merged = numbers.groupBy("l_orderkey", "l_linenumber", "kind", "key").agg(F.max("confidence").alias("confidence"))
    part = F.col("kind") == "part"
    return merged.select(
        F.concat(F.lit("mart.fact.o"), "l_orderkey", F.lit("."), "kind", F.lit("_"), "l_linenumber").alias("fk"),
        F.when(part, F.concat(F.lit("mart.dim.p"), "key", F.lit(".partkey")))
        .otherwise(F.concat(F.lit("mart.dim.s"), "key", F.lit(".suppkey")))
        .alias("pk"),
        "confidence",
    )


def relations_and_columns(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The relations, and the columns they run between with their tables, both as kept tables."""
    kept = written(relations(t), "relations")
    fact = _name("mart.fact.o", F.col("l_orderkey"))

    def of(kind: str) -> Column:
        return F.struct(F.concat(fact, F.lit(f".{kind}_"), "l_linenumber").alias("id"), fact.alias("full_name"))

    lines = _column_numbers(t).select("l_orderkey", "l_linenumber").distinct()
    columns = lines.select(F.inline(F.array(of("part"), of("supp"))))
    for key, prefix, column in (("l_partkey", "mart.dim.p", "partkey"), ("l_suppkey", "mart.dim.s", "suppkey")):
        table = _name(prefix, F.col(key))
        owned = t["lineitem"].select(key).distinct()
        columns = columns.unionByName(owned.select(F.concat(table, F.lit(f".{column}")).alias("id"), table.alias("full_name")))
    # A column whose numbers are not given has no name, and nothing refers to it.
    return kept, written(columns.dropna(), "columns")


def table_types(t: Tables) -> DataFrame:
    orders = t["orders"].select(
        _name("mart.fact.o", F.col("o_orderkey")).alias("full_name"),
        F.when(F.col("o_orderstatus") != "P", "FACT").alias("table_type"),
    )
    parts = t["part"].select(
        _name("mart.dim.p", F.col("p_partkey")).alias("full_name"), F.lit("DIM").alias("table_type")
    )
    suppliers = t["supplier"].select(
        _name("mart.dim.s", F.col("s_suppkey")).alias("full_name"), F.lit("DIM").alias("table_type")
    )
    return orders.unionByName(parts).unionByName(suppliers)


# Signal history: each event type is a table, each day a snapshot; some have no rows.

HISTORY_SQL = """
history AS (
  SELECT 'lake.web.' || event_type AS full_table_name, 'lake' AS table_catalog, 'web' AS table_schema,
         event_type AS table_name, max(ts) AS freshness_timestamp,
         count(*) // 2 AS row_count, count(DISTINCT user_id)::DOUBLE / count(*) AS uniqueness_ratio,
         count(*) FILTER (WHERE value < 5)::DOUBLE / count(*) AS null_ratio,
         md5(CAST(date_part('week', ts::DATE) AS VARCHAR)) AS schema_hash
  FROM events GROUP BY event_type, ts::DATE, date_part('week', ts::DATE)
)"""


def signal_history(t: Tables) -> DataFrame:
    day = F.col("ts").cast("date")
    # Users first, so that the distinct count moves one row per user, type and day.
    per_user = (
        t["events"]
        .groupBy("event_type", day.alias("day"), "user_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("ts").alias("last"),
            F.count_if(F.col("value") < 5).alias("low"),
        )
    )
    rows = F.sum("n")
    daily = per_user.groupBy("event_type", "day").agg(
        F.max("last").alias("freshness_timestamp"),
        F.floor(rows / 2).alias("row_count"),
        (F.count(F.lit(1)).cast("double") / rows).alias("uniqueness_ratio"),
        (F.sum("low").cast("double") / rows).alias("null_ratio"),
    )
    return daily.select(
        _name("lake.web.", F.col("event_type")).alias("full_table_name"),
        F.lit("lake").alias("table_catalog"),
        F.lit("web").alias("table_schema"),
        F.col("event_type").alias("table_name"),
        "freshness_timestamp",
        "row_count",
        "uniqueness_ratio",
        "null_ratio",
        F.md5(F.weekofyear("day").cast("string")).alias("schema_hash"),
    )
