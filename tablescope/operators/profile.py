"""Data profiles, quality and distribution statistics, freshness, signals.

Rows, nulls, zeros, extremes and means come from one aggregation per table that
sends one row per task; fingerprints are added up from distinct values. Only distinct values take a
long form, one row per cell, combined before it moves, so a value in a third of all rows costs one
row per task; texts go as digests.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.names import NAME_PARTS, full_name
from tablescope.functions.types import lane_of, lanes, rule_type
from tablescope.operators.quantiles import column_quantiles
from tablescope.workspace import new_path, written

COLUMN_SCHEMA = (
    "catalog_name string, schema_name string, table_name string, column_name string, "
    "ordinal_position int, data_type string, is_nullable string, comment string"
)
LANE_NAMES = ["number", "real", "moment", "words"]
COLUMN_KEY = ["full_name", "ordinal_position"]


def columns_of(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The columns of tables given by full name, as the information schema lists them."""
    rows = []
    for name, df in tables.items():
        parts = name.split(".", 2)
        for position, field in enumerate(df.schema.fields, start=1):
            comment = (field.metadata or {}).get("comment")
            nullable = "YES" if field.nullable else "NO"
            rows.append((*parts, field.name, position, rule_type(field.dataType), nullable, comment))
    return SparkSession.active().createDataFrame(rows, COLUMN_SCHEMA)


def long_values(
    tables: Mapping[str, DataFrame], only: Mapping[str, Collection[str]] | None = None
) -> DataFrame:
    """Rows ``(full_name, ordinal_position, lanes…)``, one per cell of all tables.

    ``only`` names the columns to look at, by table; the scan reads no others.
    """

    def long_form(name: str, df: DataFrame) -> DataFrame | None:
        cells = [
            cell
            for position, field in enumerate(df.schema.fields, start=1)
            if only is None or field.name in only.get(name, ())
            for cell in (F.lit(position), *lanes(field))
        ]
        if not cells:
            return None
        rows = F.lit(len(cells) // (1 + len(LANE_NAMES)))
        return df.select(
            F.lit(name).alias("full_name"), F.stack(rows, *cells).alias("ordinal_position", *LANE_NAMES)
        )

    parts = [part for name, df in tables.items() if (part := long_form(name, df)) is not None]
    return reduce(DataFrame.unionByName, parts)


def value_counts(
    tables: Mapping[str, DataFrame], only: Mapping[str, Collection[str]] | None = None
) -> DataFrame:
    """Rows ``(full_name, ordinal_position, lanes…, n)``: each distinct value of each column."""
    return long_values(tables, only).groupBy(*COLUMN_KEY, *LANE_NAMES).agg(F.count(F.lit(1)).alias("n"))


def wide_stats(tables: Mapping[str, DataFrame], measures: Callable[[T.StructField], list[Column]]) -> DataFrame:
    """Rows ``(full_name, ordinal_position, measures…)`` from one aggregation per table.

    ``measures`` gives the named aggregates of one column. One row per task leaves the scan,
    however many cells a table has.
    """
    parts = []
    for name, df in tables.items():
        cells = [
            F.struct(F.lit(position).alias("ordinal_position"), *measures(field))
            for position, field in enumerate(df.schema.fields, start=1)
        ]
        if cells:
            one_row = df.agg(F.array(*cells).alias("cells"))
            parts.append(one_row.select(F.lit(name).alias("full_name"), F.inline("cells")))
    return reduce(DataFrame.unionByName, parts)


def _counted_values(tables: Mapping[str, DataFrame], only: Mapping[str, Collection[str]] | None) -> list[DataFrame]:
    """Per lane: rows ``(full_name, ordinal_position, value, n)`` for each distinct value of a column, not null.

    While they are grouped, columns go by a number, and each lane has values of one type. Texts of 16
    bytes and more go as their 128-bit digests, shorter ones, which no digest equals, as they are.
    """
    places: list[tuple[int, str, int]] = []
    by_lane: dict[str, list[DataFrame]] = {}
    for name, df in tables.items():
        cells: dict[str, list[Column]] = {}
        for position, field in enumerate(df.schema.fields, start=1):
            if only is None or field.name in only.get(name, ()):
                places.append((len(places), name, position))
                lane, value = lane_of(field)
                if lane == "words":
                    value = F.when(F.octet_length(value) < 16, value.cast("binary")).otherwise(F.unhex(F.md5(value)))
                cells.setdefault(lane, []).extend((F.lit(places[-1][0]), value))
        for lane, own in cells.items():
            long_form = df.select(F.stack(F.lit(len(own) // 2), *own).alias("place", "value"))
            by_lane.setdefault(lane, []).append(long_form.filter(F.col("value").isNotNull()))
    named = SparkSession.active().createDataFrame(places, "place int, full_name string, ordinal_position int")
    counted = []
    for parts in by_lane.values():
        values = reduce(DataFrame.unionByName, parts).groupBy("place", "value").agg(F.count(F.lit(1)).alias("n"))
        counted.append(values.join(F.broadcast(named), "place").drop("place"))
    return counted


def _bits(lane: str) -> Column:
    """60 bits of the MD5 of a counted value's text."""
    value = F.col("value")
    if lane == "binary":
        digest = F.when(F.octet_length(value) < 16, F.md5(value)).otherwise(F.lower(F.hex(value)))
    else:
        digest = F.md5(value.cast("string"))
    return _first_bits(digest)


def _first_bits(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)")


def distinct_counts(
    tables: Mapping[str, DataFrame], only: Mapping[str, Collection[str]] | None = None, bits: bool = False
) -> DataFrame:
    """Rows ``(full_name, ordinal_position, distinct_count)``; nulls are not counted.

    Texts go as 128-bit digests, so what is shuffled does not grow with their length. With ``bits``,
    a column ``bits`` adds up, over all rows, 60 bits of the MD5 of the value's text; -0.0 counts as 0.0.
    """
    parts = []
    for values in _counted_values(tables, only):
        measures = [F.count(F.lit(1)).alias("distinct_count")]
        if bits:
            own = _bits(values.schema["value"].dataType.simpleString()) * F.col("n").cast("decimal(20,0)")
            measures.append(F.sum(own.cast("decimal(38,0)")).alias("bits"))
        parts.append(values.groupBy(*COLUMN_KEY).agg(*measures))
    if not parts:
        return SparkSession.active().createDataFrame(
            [], "full_name string, ordinal_position int, distinct_count bigint" + ", bits decimal(38,0)" * bits
        )
    return reduce(DataFrame.unionByName, parts)


def _with_columns(tables: Mapping[str, DataFrame], stats: DataFrame) -> DataFrame:
    """Per-column results next to the column names; a table without rows keeps its columns."""
    columns = columns_of(tables).withColumn("full_name", full_name())
    return columns.join(stats, COLUMN_KEY, "left")


def _ratio(part, whole) -> Column:
    return F.try_divide(F.col(part).cast("double"), F.col(whole))


def data_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column: row and distinct counts, null and uniqueness ratios.

    Ratios of an empty table are null.
    """

    def measures(field: T.StructField) -> list[Column]:
        rows, values = F.count(F.lit(1)), F.count(F.col(f"`{field.name}`"))
        return [rows.alias("row_count"), (rows - values).alias("null_count")]

    return (
        _with_columns(tables, wide_stats(tables, measures))
        .join(distinct_counts(tables), COLUMN_KEY, "left")
        .fillna(0, ["row_count", "distinct_count", "null_count"])
        .select(
            "full_name",
            *NAME_PARTS,
            "column_name",
            "ordinal_position",
            "data_type",
            "row_count",
            "distinct_count",
            _ratio("null_count", "row_count").alias("null_ratio"),
            _ratio("distinct_count", "row_count").alias("uniqueness_ratio"),
        )
    )


def quality_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column: nulls, distinct values, zeros, rows and a fingerprint.

    The fingerprint does not depend on row order: it adds up, over all rows, 60 bits of
    the MD5 of the value's text. Each distinct value is digested once. Zeros are counted in numeric
    columns only.
    """
    # Grouping makes 0.0 of -0.0, whose text differs, so those are counted and put right.
    plain, signed = (_first_bits(F.md5(F.lit(text))) for text in ("0.0", "-0.0"))

    def measures(field: T.StructField) -> list[Column]:
        column = F.col(f"`{field.name}`")
        rows, values = F.count(F.lit(1)), F.count(column)
        zeros = F.lit(None).cast("bigint")
        if isinstance(field.dataType, T.NumericType):
            zeros = F.count_if(column == 0)
        below = F.lit(0).cast("bigint")
        lane, value = lane_of(field)
        if lane == "real":
            below = F.count_if((value == 0) & (value.cast("string") == "-0.0"))
        return [
            rows.alias("total_rows"),
            (rows - values).alias("null_count"),
            zeros.alias("zero_count"),
            below.alias("signed_zeros"),
        ]

    put_right = F.col("signed_zeros").cast("decimal(16,0)") * (signed - plain)
    fingerprint = (F.col("bits") + put_right).cast("decimal(38,0)").cast("string")

    return (
        _with_columns(tables, wide_stats(tables, measures))
        .join(distinct_counts(tables, bits=True), COLUMN_KEY, "left")
        .fillna(0, ["total_rows", "distinct_count", "null_count"])
        .select(
            "full_name",
            *NAME_PARTS,
            "column_name",
            "data_type",
            "null_count",
            (_ratio("null_count", "total_rows") * 100).alias("null_percentage"),
            "distinct_count",
            "zero_count",
            "total_rows",
            fingerprint.alias("fingerprint"),
        )
    )


def distribution_stats(tables: Mapping[str, DataFrame], paths: Mapping[str, str] | None = None) -> DataFrame:
    """One row per numeric column: mean, exact quartiles, extremes, distinct values, rows.

    ``file_size_bytes`` is the size of the table's files where ``paths`` says where they are,
    else null.
    """
    numeric = {
        name: df.select(*(f"`{f.name}`" for f in df.schema.fields if isinstance(f.dataType, T.NumericType)))
        for name, df in tables.items()
    }
    positions = {
        name: [p for p, f in enumerate(df.schema.fields, start=1) if isinstance(f.dataType, T.NumericType)]
        for name, df in tables.items()
    }
    numeric = {name: df for name, df in numeric.items() if df.columns}

    def measures(field: T.StructField) -> list[Column]:
        column = F.col(f"`{field.name}`")
        value = column.cast("double")
        return [
            F.count(F.lit(1)).alias("row_count"),
            F.avg(value).alias("mean"),
            F.min(value).alias("min_val"),
            F.max(value).alias("max_val"),
        ]

    distinct = distinct_counts(numeric)
    quartiles = (
        column_quantiles(numeric, [0.25, 0.5, 0.75])
        .groupBy(*COLUMN_KEY)
        .pivot("quantile", [0.25, 0.5, 0.75])
        .agg(F.first("value"))
        .withColumnsRenamed({"0.25": "p25", "0.5": "median", "0.75": "p75"})
    )
    stats = (
        wide_stats(numeric, measures)
        .join(distinct, COLUMN_KEY, "left")
        .join(quartiles, COLUMN_KEY, "left")
        .withColumnRenamed("ordinal_position", "place")
    )
    # Positions among the numeric columns, next to those among all.
    places = SparkSession.active().createDataFrame(
        [(name, place, position) for name, own in positions.items() for place, position in enumerate(own, start=1)],
        "full_name string, place int, ordinal_position int",
    )
    sizes = file_sizes(paths or {}).select("full_name", "file_size_bytes")
    return (
        columns_of(tables)
        .withColumn("full_name", full_name())
        .join(places, COLUMN_KEY)
        .join(stats, ["full_name", "place"], "left")
        .join(sizes, "full_name", "left")
        .fillna(0, ["row_count", "distinct_count"])
        .select(
            "full_name",
            *NAME_PARTS,
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
        )
    )


def table_files(paths: Mapping[str, str]) -> DataFrame:
    """Rows ``(full_name, path, length, modified_at, folder)``: the files below each table's path.

    The files are listed and not opened.
    """
    spark = SparkSession.active()

    def files(name: str, path: str) -> DataFrame:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return listed.select(
            F.lit(name).alias("full_name"),
            "path",
            "length",
            F.col("modificationTime").alias("modified_at"),
            F.regexp_replace("path", "/[^/]*$", "").alias("folder"),
        )

    if not paths:
        schema = "full_name string, path string, length bigint, modified_at timestamp, folder string"
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, (files(name, path) for name, path in paths.items()))


def file_sizes(paths: Mapping[str, str]) -> DataFrame:
    """Total size and number of the files of each table, given by the path that it lies at."""
    return table_files(paths).groupBy("full_name").agg(
        F.sum("length").alias("file_size_bytes"), F.count(F.lit(1)).alias("file_count")
    )


def file_freshness(paths: Mapping[str, str], as_of: Column, versions: Mapping[str, int] | None = None) -> DataFrame:
    """Per table: last modification of a file, hours since then, folders with files, and version.

    ``versions`` gives the number of kept snapshots by table, where there are any.
    """
    hours = F.timestamp_diff("SECOND", F.col("last_modified_at"), as_of) / 3600
    kept = [F.lit(x) for name, count in (versions or {}).items() for x in (name, count)]
    version = F.create_map(*kept)[F.col("full_name")] if kept else F.lit(None)
    return (
        table_files(paths)
        .groupBy("full_name")
        .agg(F.max("modified_at").alias("last_modified_at"), F.count_distinct("folder").alias("partition_count"))
        .withColumn("latency_hours", hours)
        .withColumn("current_version", version.cast("bigint"))
    )


def kept_stats(stats: DataFrame, label: str) -> DataFrame:
    """Statistics as a stored table with a folder per table name, so that a lookup reads one."""
    path = new_path(stats.sparkSession, label)
    stats.write.partitionBy(*NAME_PARTS).parquet(path)
    return stats.sparkSession.read.schema(stats.schema).parquet(path)


def freshness_stats(
    df: DataFrame,
    keys: Sequence[str],
    modified_at: Column,
    as_of: Column,
    partition: Column,
    version: Column,
    documented_at: Column | None = None,
) -> DataFrame:
    """Per table: last change, hours since then, versions, partitions, last documentation.

    ``as_of`` is an argument, so that results repeat.
    """
    documented_at = F.lit(None).cast("timestamp_ntz") if documented_at is None else documented_at
    inputs = df.select(
        *keys,
        modified_at.alias("modified_at"),
        documented_at.alias("documented_at"),
        partition.alias("partition_value"),
        version.alias("version_value"),
    )
    # Few rows per table leave the first aggregation, so that distinct counts stay cheap.
    daily = inputs.groupBy(*keys, "partition_value", "version_value").agg(
        F.max("modified_at").alias("modified_at"), F.max("documented_at").alias("documented_at")
    )
    hours = F.timestamp_diff("SECOND", F.col("last_modified_at"), as_of) / 3600
    return (
        daily.groupBy(*keys)
        .agg(
            F.max("modified_at").alias("last_modified_at"),
            F.count_distinct("version_value").alias("current_version"),
            F.max("documented_at").alias("last_documented_at"),
            F.count_distinct("partition_value").alias("partition_count"),
        )
        .withColumn("latency_hours", hours)
    )
