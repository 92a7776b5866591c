"""Registered profile, statistics and signal queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.names import NAME_PARTS
from tablescope.operators import layout, profile, signals
from tablescope.plans import inputs
from tablescope.plans.inputs import STAR_COLUMNS, STAR_SQL, per_column_sql, star_name
from tablescope.plans.registry import Tables, query

AS_OF = datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"

NUMERIC = {
    table: {c: k for c, k in columns.items() if k in ("LONG", "INTEGER", "DOUBLE")}
    for table, columns in STAR_COLUMNS.items()
}
# All but doubles print alike in both engines, so their MD5 can be compared.
PRINTS_ALIKE = {
    table: {c: k for c, k in columns.items() if k != "DOUBLE"}
    for table, columns in STAR_COLUMNS.items()
}

PROFILE_COLUMNS = """ SELECT full_name, table_name, column_name, ordinal_position, data_type, row_count,
  distinct_count, round(null_ratio, 6) AS null_ratio, round(uniqueness_ratio, 6) AS uniqueness_ratio
  FROM profile"""


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query("a13_data_profile", "WITH " + inputs.PROFILE_SQL.strip() + PROFILE_COLUMNS)
def a13(t: Tables) -> DataFrame:
    found = profile.data_profile(inputs.star_tables(t))
    return rounded(found, "null_ratio", "uniqueness_ratio").drop("catalog_name", "schema_name")


@query("s3_profile_of_catalog", "WITH " + inputs.PROFILE_SQL.strip() + PROFILE_COLUMNS)
def s3(t: Tables) -> DataFrame:
    """The profile as a kept table, read back."""
    kept = inputs.written(profile.data_profile(inputs.star_tables(t)), "data-profile")
    return rounded(kept.filter("catalog_name = 'lake'"), "null_ratio", "uniqueness_ratio").drop(
        "catalog_name", "schema_name"
    )


QUALITY_SQL = (
    STAR_SQL
    + ", quality AS ("
    + per_column_sql(
        "SELECT '{table}' AS table_name, '{column}' AS column_name, '{type}' AS data_type,"
        " count(*) - count({column}) AS null_count,"
        " round(100.0 * (count(*) - count({column})) / count(*), 6)::DOUBLE AS null_percentage,"
        " count(DISTINCT {column}) AS distinct_count,"
        " CASE WHEN '{type}' IN ('LONG', 'INTEGER', 'DOUBLE')"
        "   THEN count(*) FILTER (WHERE CAST({column} AS VARCHAR) IN ('0', '0.0', '-0.0')) END AS zero_count,"
        " count(*) AS total_rows FROM {source}"
    )
    + ")"
)


@query("a14_quality_stats", "WITH " + QUALITY_SQL.strip() + " SELECT * FROM quality")
def a14(t: Tables) -> DataFrame:
    found = profile.quality_stats(inputs.star_tables(t))
    return rounded(found, "null_percentage").drop("full_name", "catalog_name", "schema_name", "fingerprint")


FINGERPRINT = per_column_sql(
    "SELECT '{table}' AS table_name, '{column}' AS column_name,"
    " CAST(sum(('0x' || substr(md5(CAST({column} AS VARCHAR)), 1, 15))::BIGINT::HUGEINT) AS VARCHAR)"
    " AS fingerprint FROM {source}",
    PRINTS_ALIKE,
)


@query("a14_quality_fingerprint", "WITH " + STAR_SQL.strip() + FINGERPRINT)
def a14_fingerprint(t: Tables) -> DataFrame:
    tables = {
        star_name(table): inputs.star_tables(t)[star_name(table)].select(*columns)
        for table, columns in PRINTS_ALIKE.items()
    }
    return profile.quality_stats(tables).select("table_name", "column_name", "fingerprint")


DISTRIBUTION_SQL = (
    STAR_SQL
    + ", distribution AS ("
    + per_column_sql(
        "SELECT '{table}' AS table_name, '{column}' AS column_name, '{type}' AS data_type,"
        " count(*) AS row_count, count(DISTINCT {column}) AS distinct_count,"
        " round(avg({column}::DOUBLE), 4) AS mean, round(min({column})::DOUBLE, 6) AS min_val,"
        " round(quantile_cont({column}::DOUBLE, 0.25), 6) AS p25,"
        " round(quantile_cont({column}::DOUBLE, 0.5), 6) AS median,"
        " round(quantile_cont({column}::DOUBLE, 0.75), 6) AS p75,"
        " round(max({column})::DOUBLE, 6) AS max_val FROM {source}",
        NUMERIC,
    )
    + ")"
)
FIGURES = ("min_val", "p25", "median", "p75", "max_val")


def figures(df: DataFrame) -> DataFrame:
    """Rounded figures; a mean depends on the order of addition in its last digits.

    DuckDB's views do not say where their files are, so of a size only its presence compares.
    """
    df = df.withColumn("has_file_size", F.coalesce(F.col("file_size_bytes") > 0, F.lit(False)))
    return rounded(df, *FIGURES).withColumn("mean", F.round("mean", 4)).drop("file_size_bytes")


def table_paths(t: Tables) -> dict[str, str]:
    return {star_name(table): f"{t.folder}/{table}.parquet" for table in STAR_COLUMNS}


@query("a15_distribution_stats", "WITH " + DISTRIBUTION_SQL.strip() + " SELECT *, true AS has_file_size FROM distribution")
def a15(t: Tables) -> DataFrame:
    found = profile.distribution_stats(inputs.star_tables(t), table_paths(t))
    return figures(found).drop("full_name", "catalog_name", "schema_name")


@query(
    "a15_file_sizes",
    " UNION ALL ".join(f"SELECT '{star_name(table)}' AS full_name, true AS has_files, true AS has_size" for table in STAR_COLUMNS),
)
def a15_files(t: Tables) -> DataFrame:
    """Which tables have files with something in them; the unit tests compare exact sizes."""
    sizes = profile.file_sizes(table_paths(t))
    return sizes.select(
        "full_name", (F.col("file_count") > 0).alias("has_files"), (F.col("file_size_bytes") > 0).alias("has_size")
    )


FRESHNESS_SQL = f"""
WITH freshness AS (
  SELECT 'lake' AS catalog_name, 'web' AS schema_name, event_type AS table_name,
         max(ts) AS last_modified_at, count(DISTINCT date_part('week', ts::DATE)) AS current_version,
         max(CASE WHEN value > 100 THEN ts END) AS last_documented_at,
         count(DISTINCT ts::DATE) AS partition_count,
         round(date_diff('second', max(ts), {AS_OF_SQL}) / 3600.0, 3)::DOUBLE AS latency_hours
  FROM events GROUP BY event_type
)"""


def freshness(t: Tables) -> DataFrame:
    events = t["events"].withColumns(
        {"catalog_name": F.lit("lake"), "schema_name": F.lit("web"), "table_name": F.col("event_type")}
    )
    day = F.col("ts").cast("date")
    return profile.freshness_stats(
        events,
        NAME_PARTS,
        modified_at=F.col("ts"),
        as_of=as_of(),
        partition=day,
        version=F.weekofyear(day),
        documented_at=F.when(F.col("value") > 100, F.col("ts")),
    )


# Whole seconds are cut in Spark and counted at their borders in DuckDB, so hours are compared
# to a tenth.
LATENCY = "round(latency_hours, 1)"


@query("a16_freshness_stats", FRESHNESS_SQL + f" SELECT * REPLACE ({LATENCY} AS latency_hours) FROM freshness")
def a16(t: Tables) -> DataFrame:
    return freshness(t).withColumn("latency_hours", F.round("latency_hours", 1))


@query(
    "f1_freshness_lookup",
    FRESHNESS_SQL
    + f""" SELECT last_modified_at, {LATENCY} AS latency_hours, current_version, last_documented_at, partition_count
    FROM freshness WHERE catalog_name = 'lake' AND schema_name = 'web' AND table_name = 'click'""",
)
def f1(t: Tables) -> DataFrame:
    kept = profile.kept_stats(freshness(t), "freshness-stats")
    return signals.freshness_of(kept, "lake.web.click").withColumn(
        "latency_hours", F.round("latency_hours", 1)
    )


@query(
    "f2_quality_lookup",
    "WITH " + QUALITY_SQL.strip() + " SELECT * EXCLUDE (table_name) FROM quality WHERE table_name = 'lineitem'",
)
def f2(t: Tables) -> DataFrame:
    kept = profile.kept_stats(profile.quality_stats(inputs.star_tables(t)), "quality-stats")
    found = signals.quality_of(kept, star_name("lineitem"))
    return rounded(found, "null_percentage").drop("fingerprint")


@query(
    "f3_profile_lookup",
    "WITH "
    + DISTRIBUTION_SQL.strip()
    + " SELECT * EXCLUDE (table_name), true AS has_file_size FROM distribution WHERE table_name = 'orders'",
)
def f3(t: Tables) -> DataFrame:
    stats = profile.distribution_stats(inputs.star_tables(t), table_paths(t))
    return figures(signals.profile_of(profile.kept_stats(stats, "profile-stats"), star_name("orders")))


# Signals -----------------------------------------------------------------------------------

SPARK_TYPES = {
    "LONG": "bigint", "INTEGER": "int", "DOUBLE": "double", "STRING": "string", "TIMESTAMP": "timestamp_ntz",
}
SIGNALS_SQL = "WITH " + inputs.PROFILE_SQL.strip()


@query(
    "a17_table_signals",
    SIGNALS_SQL
    + ", shapes(full_name, shape) AS (VALUES "
    + ", ".join(
        f"('{star_name(table)}', '{','.join(f'{c}:{SPARK_TYPES[k]}' for c, k in columns.items())}')"
        for table, columns in STAR_COLUMNS.items()
    )
    + """) SELECT full_name AS full_table_name, table_name, max(row_count) AS row_count,
      count(*) AS column_count, round(avg(null_ratio), 6) AS null_ratio,
      round(avg(uniqueness_ratio), 6) AS uniqueness_ratio, sha256(any_value(shape)) AS schema_hash,
      full_name || '@2024-01-31 00:00:00' AS signal_id
      FROM profile JOIN shapes USING (full_name) GROUP BY full_name, table_name""",
)
def a17(t: Tables) -> DataFrame:
    found = signals.table_signals(inputs.star_tables(t), as_of())
    return rounded(found, "null_ratio", "uniqueness_ratio").select(
        "full_table_name", "table_name", "row_count", "column_count", "null_ratio", "uniqueness_ratio",
        "schema_hash", "signal_id",
    )


@query(
    "a18_column_signals",
    "WITH "
    + STAR_SQL.strip()
    + " "
    + per_column_sql(
        "SELECT '{table}' AS table_name, '{column}' AS column_name, '{type}' AS data_type,"
        " round((count(*) - count({column}))::DOUBLE / count(*), 6) AS null_ratio,"
        " round(count(DISTINCT {column})::DOUBLE / count(*), 6) AS uniqueness_ratio,"
        " CAST(min({column}) AS VARCHAR) AS min_value, CAST(max({column}) AS VARCHAR) AS max_value FROM {source}",
        PRINTS_ALIKE,
    ),
)
def a18(t: Tables) -> DataFrame:
    tables = {
        star_name(table): inputs.star_tables(t)[star_name(table)].select(*columns)
        for table, columns in PRINTS_ALIKE.items()
    }
    found = signals.column_signals(tables, as_of())
    return rounded(found, "null_ratio", "uniqueness_ratio").select(
        "table_name", "column_name", "data_type", "null_ratio", "uniqueness_ratio", "min_value", "max_value"
    )


# Columns of more types, and how each engine spells their least and greatest values.
ODD_TYPES = {
    "price": ("CAST(l_extendedprice AS DECIMAL(12, 2))", "CAST({} AS VARCHAR)"),
    "shipped": ("l_shipdate", "strftime({}, '%Y-%m-%d %H:%M:%S')"),
    "shipday": ("CAST(l_shipdate AS DATE)", "CAST({} AS VARCHAR)"),
    "returned": ("l_returnflag = 'R'", "CAST({} AS VARCHAR)"),
    "quantity": ("CAST(l_quantity AS SMALLINT)", "CAST({} AS VARCHAR)"),
    "discount": ("l_discount", "printf('%.4f', {})"),
    "note": ("CASE WHEN l_linenumber > 2 THEN l_linestatus END", "CAST({} AS VARCHAR)"),
}


@query(
    "a18_column_signals_all_types",
    " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, {spell.format(f'min({value})')} AS min_value,"
        f" {spell.format(f'max({value})')} AS max_value,"
        f" round((count(*) - count({value}))::DOUBLE / count(*), 6) AS null_ratio,"
        f" round(count(DISTINCT {value})::DOUBLE / count(*), 6) AS uniqueness_ratio FROM lineitem"
        for name, (value, spell) in ODD_TYPES.items()
    ),
)
def a18_all(t: Tables) -> DataFrame:
    """Extremes of decimals, times, days, truth values, small integers, doubles and texts."""
    line_items = t["lineitem"].select(*(F.expr(value).alias(name) for name, (value, _) in ODD_TYPES.items()))
    found = signals.column_signals({"lake.sales.odd": line_items}, as_of())
    to_digits = lambda c: F.when(F.col("column_name") == "discount", F.format_string("%.4f", F.col(c).try_cast("double")))
    for end in ("min_value", "max_value"):
        found = found.withColumn(end, to_digits(end).otherwise(F.col(end)))
    return rounded(found, "null_ratio", "uniqueness_ratio").select(
        "column_name", "min_value", "max_value", "null_ratio", "uniqueness_ratio"
    )


SPELLS_SQL = (
    "WITH "
    + inputs.HISTORY_SQL.strip()
    + """, spells AS (
  SELECT *, freshness_timestamp AS valid_from,
         lead(freshness_timestamp) OVER (PARTITION BY full_table_name ORDER BY freshness_timestamp) AS valid_to
  FROM history
), signals AS (SELECT *, valid_to IS NULL AS is_current FROM spells)"""
)
SIGNAL_COLUMNS = """ SELECT full_table_name, table_catalog, table_schema, table_name, freshness_timestamp,
  row_count, round(uniqueness_ratio, 6) AS uniqueness_ratio, round(null_ratio, 6) AS null_ratio,
  schema_hash, valid_from, valid_to, is_current FROM signals"""


def history(t: Tables) -> DataFrame:
    return rounded(inputs.signal_history(t), "uniqueness_ratio", "null_ratio")


def signal_rows(t: Tables) -> DataFrame:
    return signals.validity(history(t), ["full_table_name"], "freshness_timestamp")


@query("w1_signal_validity", SPELLS_SQL + SIGNAL_COLUMNS)
def w1(t: Tables) -> DataFrame:
    return signal_rows(t)


@query(
    "w1_event_validity",
    """SELECT event_id, event_type, ts, ts AS valid_from, lead(ts) OVER w AS valid_to,
      lead(ts) OVER w IS NULL AS is_current
    FROM (SELECT event_type, ts, max(event_id) AS event_id FROM events GROUP BY event_type, ts)
    WINDOW w AS (PARTITION BY event_type ORDER BY ts)""",
)
def w1_events(t: Tables) -> DataFrame:
    """Validity at the grain of single events, where a key holds a large share of all rows."""
    events = t["events"].groupBy("event_type", "ts").agg(F.max("event_id").alias("event_id"))
    return signals.validity(events, ["event_type"], "ts")


@query(
    "w2_drift",
    "WITH "
    + inputs.HISTORY_SQL.strip()
    + """ SELECT full_table_name, freshness_timestamp, row_count, schema_hash,
      lag(row_count) OVER w AS previous_row_count, row_count - lag(row_count) OVER w AS row_count_change,
      coalesce(schema_hash <> lag(schema_hash) OVER w, false) AS schema_changed
    FROM history WINDOW w AS (PARTITION BY full_table_name ORDER BY freshness_timestamp)""",
)
def w2(t: Tables) -> DataFrame:
    rows = inputs.signal_history(t).select("full_table_name", "freshness_timestamp", "row_count", "schema_hash")
    return signals.drift(rows, ["full_table_name"], "freshness_timestamp")


@query("f4_past_signals", SPELLS_SQL + SIGNAL_COLUMNS + " WHERE NOT is_current")
def f4(t: Tables) -> DataFrame:
    return signals.only_current(signal_rows(t), False)


@query("f5_table_signals", SPELLS_SQL + SIGNAL_COLUMNS + " WHERE full_table_name = 'lake.web.error'")
def f5(t: Tables) -> DataFrame:
    return signals.table_signals_of(signal_rows(t), "lake.web.error")


@query("f5_all_current_signals", SPELLS_SQL + SIGNAL_COLUMNS + " WHERE is_current")
def f5_all(t: Tables) -> DataFrame:
    return signals.table_signals_of(signal_rows(t), is_current=True)


# Column signals over time: one row per event type (a table), user (a column) and day.
COLUMN_SIGNALS_SQL = """
WITH column_signals AS (
  SELECT 'lake' AS table_catalog, 'web' AS table_schema, event_type AS table_name,
         'u' || user_id AS column_name, max(ts) AS "timestamp",
         round(count(*) FILTER (WHERE value < 5)::DOUBLE / count(*), 6) AS null_ratio,
         round(1.0 / count(*), 6)::DOUBLE AS uniqueness_ratio,
         CASE WHEN max(value) > 50 THEN 'DOUBLE' ELSE 'LONG' END AS data_type
  FROM events GROUP BY event_type, user_id, ts::DATE
)"""


def column_signal_rows(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return (
        t["events"]
        .groupBy("event_type", "user_id", F.col("ts").cast("date"))
        .agg(
            F.max("ts").alias("timestamp"),
            F.round(F.count_if(F.col("value") < 5) / n, 6).alias("null_ratio"),
            F.round(1 / n, 6).alias("uniqueness_ratio"),
            F.when(F.max("value") > 50, "DOUBLE").otherwise("LONG").alias("data_type"),
        )
        .select(
            F.lit("lake").alias("table_catalog"),
            F.lit("web").alias("table_schema"),
            F.col("event_type").alias("table_name"),
            F.concat(F.lit("u"), "user_id").alias("column_name"),
            "timestamp",
            "null_ratio",
            "uniqueness_ratio",
            "data_type",
        )
    )


@query("f6_column_signals", COLUMN_SIGNALS_SQL + " SELECT * FROM column_signals WHERE table_name = 'view'")
def f6(t: Tables) -> DataFrame:
    return signals.column_signals_of(column_signal_rows(t), "lake.web.view")


@query("f6_all_column_signals", COLUMN_SIGNALS_SQL + " SELECT * FROM column_signals")
def f6_all(t: Tables) -> DataFrame:
    return signals.column_signals_of(column_signal_rows(t))


@query("l3_sorted_column_signals", COLUMN_SIGNALS_SQL + " SELECT * FROM column_signals")
def l3(t: Tables) -> DataFrame:
    return signals.sort_column_signals(column_signal_rows(t), "null_ratio", descending=True)


@query(
    "f7_current_signal",
    SPELLS_SQL
    + SIGNAL_COLUMNS
    + """ QUALIFY row_number() OVER (PARTITION BY full_table_name
      ORDER BY is_current DESC, freshness_timestamp DESC) = 1""",
)
def f7(t: Tables) -> DataFrame:
    return signals.current_signal(signal_rows(t))


HEALTH = f"""CASE WHEN row_count = 0 THEN 'critical'
  WHEN {AS_OF_SQL} - freshness_timestamp > INTERVAL 24 HOUR OR null_ratio > 0 THEN 'warning'
  ELSE 'healthy' END"""


@query(
    "i5_health_status",
    "WITH " + inputs.HISTORY_SQL.strip() + f" SELECT full_table_name, freshness_timestamp, {HEALTH} AS status FROM history",
)
def i5(t: Tables) -> DataFrame:
    return inputs.signal_history(t).select(
        "full_table_name", "freshness_timestamp", signals.health_status(as_of()).alias("status")
    )


@query(
    "g18_upstream_trust_by_signals",
    f"""WITH users AS (
      SELECT 'lake.user.u' || user_id AS "table", max(ts) AS freshness_timestamp, count(*) - 1 AS row_count,
             count(*) FILTER (WHERE value < 0.5)::DOUBLE / count(*) AS null_ratio FROM events GROUP BY user_id),
    states AS (SELECT "table", {HEALTH} AS status FROM users)
    SELECT e.event AS "table", s."table" AS parent, s.status
    FROM (SELECT DISTINCT 'lake.user.u' || user_id AS parent, 'lake.web.' || event_type AS event FROM events) e
    JOIN states s ON s."table" = e.parent WHERE s.status <> 'healthy'""",
)
def g18_signals(t: Tables) -> DataFrame:
    users = t["events"].groupBy(F.concat(F.lit("lake.user.u"), "user_id").alias("table")).agg(
        F.max("ts").alias("freshness_timestamp"),
        (F.count(F.lit(1)) - 1).alias("row_count"),
        (F.count_if(F.col("value") < 0.5) / F.count(F.lit(1))).alias("null_ratio"),
    )
    states = users.select("table", signals.health_status(as_of()).alias("status"))
    edges = t["events"].select(
        F.concat(F.lit("lake.user.u"), "user_id").alias("source"),
        F.concat(F.lit("lake.web."), "event_type").alias("target"),
    )
    return layout.upstream_trust(edges, states)


@query(
    "i6_bands",
    "WITH "
    + inputs.RELATIONS_SQL.strip()
    + """ SELECT fk, pk, CASE WHEN confidence >= 0.88 THEN 'High' WHEN confidence >= 0.7 THEN 'Med' ELSE 'Low' END
      AS confidence_band,
      CASE WHEN round(confidence - 0.5, 4) = 0 THEN 'none' WHEN round(confidence - 0.5, 4) < 0.1 THEN 'some'
           ELSE 'many' END AS null_band FROM relations""",
)
def i6(t: Tables) -> DataFrame:
    found = inputs.relations(t).withColumn("null_ratio", F.round(F.col("confidence") - 0.5, 4))
    return found.select(
        "fk", "pk", signals.confidence_band().alias("confidence_band"), signals.null_band().alias("null_band")
    )
