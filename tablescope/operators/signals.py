"""Stats lookups, observability signals, their history, and health states."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.names import NAME_PARTS, full_name, has_full_name
from tablescope.operators.profile import (
    COLUMN_KEY,
    columns_of,
    data_profile,
)
from tablescope.workspace import partitions_for, written

# Limits of the health state and of the bands.
OLD_AFTER_HOURS = 24
SOME_NULLS = 0.1
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE = 0.88, 0.7

FRESHNESS = ["last_modified_at", "latency_hours", "current_version", "last_documented_at", "partition_count"]
QUALITY = [
    "column_name",
    "data_type",
    "null_count",
    "null_percentage",
    "distinct_count",
    "zero_count",
    "total_rows",
    "fingerprint",
]
PROFILE = [
    "column_name",
    "data_type",
    "row_count",
    "file_size_bytes",
    "distinct_count",
    "mean",
    "min_val",
    "p25",
    "median",
    "p75",
    "max_val",
]


def freshness_of(stats: DataFrame, table: str) -> DataFrame:
    """The freshness row of one table."""
    return has_full_name(stats, table).select(FRESHNESS).limit(1)


def quality_of(stats: DataFrame, table: str) -> DataFrame:
    """The quality rows of one table, by column name."""
    return has_full_name(stats, table).select(QUALITY).orderBy("column_name")


def profile_of(stats: DataFrame, table: str) -> DataFrame:
    """The distribution rows of one table, by column name."""
    return has_full_name(stats, table).select(PROFILE).orderBy("column_name")


def only_current(signals: DataFrame, is_current: bool | None = None) -> DataFrame:
    """Current or past signals; None keeps both."""
    return signals if is_current is None else signals.filter(F.col("is_current") == is_current)


def table_signals_of(signals: DataFrame, table: str | None = None, is_current: bool | None = None) -> DataFrame:
    """Table signals, of one table or all, newest first."""
    if table is not None:
        signals = signals.filter(F.col("full_table_name") == table)
    return only_current(signals, is_current).orderBy(F.desc("freshness_timestamp"), "full_table_name")


def column_signals_of(signals: DataFrame, table: str | None = None) -> DataFrame:
    """Column signals, of one table or all, newest first."""
    if table is not None:
        parts = table.split(".", 2)
        for name, part in zip(("table_catalog", "table_schema", "table_name"), parts):
            signals = signals.filter(F.col(name) == part)
    return signals.orderBy(F.desc("timestamp"), "column_name")


def sort_column_signals(signals: DataFrame, by: str = "column_name", descending: bool = False) -> DataFrame:
    """Column signals by name, null ratio, uniqueness or type, ties by name."""
    if by not in ("column_name", "null_ratio", "uniqueness_ratio", "data_type"):
        raise ValueError(f"cannot sort by {by}")
    order = F.col(by).desc() if descending else F.col(by).asc()
    return signals.orderBy(order, "column_name")


def current_signal(signals: DataFrame) -> DataFrame:
    """Per table its current signal, or else its newest; one aggregation, no sort."""
    rest = [c for c in signals.columns if c != "full_table_name"]
    best = F.max(
        F.struct(
            F.coalesce("is_current", F.lit(False)).alias("_current"),
            F.col("freshness_timestamp").alias("_at"),
            *rest,
        )
    )
    return signals.groupBy("full_table_name").agg(best.alias("best")).select(
        "full_table_name", *(F.col(f"best.{c}").alias(c) for c in rest)
    ).select(signals.columns)


def schema_hash(df: DataFrame) -> str:
    """SHA-256 of a frame's column names and types, in order."""
    text = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return hashlib.sha256(text.encode()).hexdigest()


def table_signals(tables: Mapping[str, DataFrame], at: Column) -> DataFrame:
    """One observability row per table: its profile rolled up, schema hash and time."""
    hashes = F.create_map(*(F.lit(x) for name, df in tables.items() for x in (name, schema_hash(df))))
    rolled = data_profile(tables).groupBy("full_name", *NAME_PARTS).agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.avg("null_ratio").alias("null_ratio"),
        F.avg("uniqueness_ratio").alias("uniqueness_ratio"),
    )
    return rolled.select(
        F.concat_ws("@", "full_name", at.cast("string")).alias("signal_id"),
        F.col("catalog_name").alias("table_catalog"),
        F.col("schema_name").alias("table_schema"),
        "table_name",
        F.col("full_name").alias("full_table_name"),
        "row_count",
        "column_count",
        "null_ratio",
        "uniqueness_ratio",
        hashes[F.col("full_name")].alias("schema_hash"),
        at.alias("freshness_timestamp"),
    )


def column_signals(tables: Mapping[str, DataFrame], at: Column) -> DataFrame:
    """One observability row per column: ratios, least and greatest value as text, type."""
    return (
        data_profile(tables)
        .join(column_extremes(tables), COLUMN_KEY, "left")
        .select(
            F.concat_ws("@", F.concat_ws(".", "full_name", "column_name"), at.cast("string")).alias("signal_id"),
            F.col("catalog_name").alias("table_catalog"),
            F.col("schema_name").alias("table_schema"),
            "table_name",
            "column_name",
            "null_ratio",
            "uniqueness_ratio",
            "min_value",
            "max_value",
            "data_type",
            at.alias("timestamp"),
        )
    )


def column_extremes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Least and greatest value of every column, found in its own type and then spelled.

    One aggregation per table, with one row per task. Binary values are spelled in
    hexadecimal digits, nested values as JSON; values that have no order (maps, variants)
    are compared by that spelling. A column without values has nulls.
    """
    parts = []
    for name, df in tables.items():
        ends = []
        for position, field in enumerate(df.schema.fields, start=1):
            kind, value = field.dataType, F.col(f"`{field.name}`")
            if isinstance(kind, T.BinaryType):
                spell = F.hex
            elif isinstance(kind, (T.ArrayType, T.StructType)):
                spell = F.to_json
            else:
                spell = lambda end: end.cast("string")
            if not _ordered(kind):
                value, spell = F.to_json(value), lambda end: end
            ends.append(
                F.struct(
                    F.lit(position).alias("ordinal_position"),
                    spell(F.min(value)).alias("min_value"),
                    spell(F.max(value)).alias("max_value"),
                )
            )
        if ends:
            parts.append(df.agg(F.array(*ends).alias("ends")).select(F.lit(name).alias("full_name"), F.inline("ends")))
    if not parts:
        schema = "full_name string, ordinal_position int, min_value string, max_value string"
        return SparkSession.active().createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def _ordered(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_ordered(field.dataType) for field in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def with_neighbour(
    df: DataFrame, keys: Sequence[str], at: str, columns: Sequence[str], name: str, earlier: bool
) -> DataFrame:
    """Each row with the given columns of the row before (or after) it, as struct ``name``.

    The rows are written in ranges of key and time, so a key with a third of all rows is
    spread over many tasks. Neighbours inside a range come from a window over that range;
    the row at its edge asks the nearest other range of the key.
    """
    keys, part = list(keys), "_part"
    picked = F.struct(*columns)
    edge, shift = (F.max, F.lag) if earlier else (F.min, F.lead)
    # Written first, so that counting and finding the ranges do not run the input again.
    df = written(df, "history")
    parts = partitions_for(df.sparkSession, df.count())
    ranged = written(
        df.repartitionByRange(parts, *keys, at).withColumn(part, F.spark_partition_id()), "history-ranges"
    )
    # One row per key and range: at most the number of keys plus the number of ranges.
    edges = ranged.groupBy(*keys, part).agg(
        edge(F.struct(F.col(at).alias("at"), picked.alias("row"))).alias("_end")
    )
    across = Window.partitionBy(*keys).orderBy(part)
    ours = [f"_key{n}" for n in range(len(keys))]
    edges = edges.select(
        *(F.col(key).alias(own) for key, own in zip(keys, ours)),
        F.col(part).alias("_edge"),
        shift(F.col("_end.row")).over(across).alias("_beyond"),
    )
    # A null key is a key like any other.
    same = F.col(part) == F.col("_edge")
    for key, own in zip(keys, ours):
        same = same & F.col(key).eqNullSafe(F.col(own))
    within = Window.partitionBy(*keys, part).orderBy(at)
    return (
        ranged.withColumn("_inside", shift(picked).over(within))
        .join(edges, same)
        .withColumn(name, F.coalesce("_inside", "_beyond"))
        .drop(part, "_inside", "_beyond", "_edge", *ours)
    )


def validity(history: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """History rows with ``valid_from``, ``valid_to`` and ``is_current``.

    A row holds until the next one of its key; the last one is current. Rows of one key
    need distinct times.
    """
    followed = with_neighbour(history, keys, at, [at], "_next", earlier=False)
    return followed.select(
        *history.columns, F.col(at).alias("valid_from"), F.col(f"_next.{at}").alias("valid_to")
    ).withColumn("is_current", F.col("valid_to").isNull())


def drift(history: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Schema and row-count changes against the previous snapshot of the same table."""
    compared = with_neighbour(history, keys, at, ["schema_hash", "row_count"], "_last", earlier=True)
    return compared.select(
        *history.columns,
        F.col("_last.row_count").alias("previous_row_count"),
        (F.col("row_count") - F.col("_last.row_count")).alias("row_count_change"),
        F.coalesce(F.col("schema_hash") != F.col("_last.schema_hash"), F.lit(False)).alias("schema_changed"),
    )


def health_status(as_of: Column) -> Column:
    """critical without rows; warning when old (or undated) or with nulls; else healthy."""
    age = F.timestamp_diff("MICROSECOND", F.col("freshness_timestamp"), as_of)
    old = F.coalesce(age > OLD_AFTER_HOURS * 3_600_000_000, F.lit(True))
    nulls = F.coalesce(F.col("null_ratio") > 0, F.lit(False))
    return (
        F.when(F.col("row_count") == 0, "critical").when(old | nulls, "warning").otherwise("healthy")
    )


def null_band(ratio: str = "null_ratio") -> Column:
    return F.when(F.col(ratio) == 0, "none").when(F.col(ratio) < SOME_NULLS, "some").otherwise("many")


def confidence_band(confidence: str = "confidence") -> Column:
    value = F.col(confidence)
    return F.when(value >= HIGH_CONFIDENCE, "High").when(value >= MEDIUM_CONFIDENCE, "Med").otherwise("Low")
