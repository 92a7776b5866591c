"""Exact quantiles of weighted values for many keys at once, and of all columns of tables.

The value at quantile ``p`` lies between the rows of rank ``floor((N-1)p)`` and
``ceil((N-1)p)`` and is interpolated, as ``median`` and ``percentile`` do.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tablescope.workspace import partitions_for, written

SKETCH_SIZE = 1024
# Sketches of the tasks are merged in this many groups before they become one.
MERGE_GROUPS = 64
RANKS = "full_name string, ordinal_position int, quantile double, share double, rank bigint"
VALUES = "full_name string, ordinal_position int, quantile double, value double"


def weighted_quantiles(
    values: DataFrame, keys: Sequence[str], quantiles: Sequence[float], parts: int | None = None
) -> DataFrame:
    """Rows ``(keys…, quantile, value)`` from rows ``(keys…, value, n)``.

    Each value occurs once per key. All values are spread over ``parts`` ranges of key and
    value, however many a key has; only the ranges that hold a wanted rank are numbered.
    """
    keys = list(keys)
    parts = parts or partitions_for(values.sparkSession, values.count())
    ranged, by_part = _ranges(values, keys, parts)
    position = (F.col("total") - 1) * F.col("quantile")
    wanted = by_part.select(
        "*", F.explode(F.array(*(F.lit(float(q)) for q in quantiles))).alias("quantile")
    ).select(
        "*",
        (position - F.floor(position)).alias("share"),
        F.explode(F.array(F.floor(position), F.ceil(position))).alias("rank"),
    )
    return _at_ranks(ranged, wanted, keys)


def _ranges(values: DataFrame, keys: list[str], parts: int) -> tuple[DataFrame, DataFrame]:
    """The values in ranges of key and value, and each range's rows, those below it, and the key's."""
    ranged = written(
        values.repartitionByRange(parts, *keys, "value").withColumn("part", F.spark_partition_id()),
        "ranges",
    )
    # One row per key and range: at most the number of keys plus the number of ranges.
    by_part = ranged.groupBy(*keys, "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    return ranged, by_part.select(
        *keys,
        "part",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"),
        F.col("n").alias("inside"),
        F.sum("n").over(whole).alias("total"),
    )


def _at_ranks(ranged: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows ``(keys…, quantile, value)`` of the ranks that ``wanted`` asks of the ranges."""
    wanted = wanted.filter(
        (F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("inside"))
    ).distinct()
    wanted = written(wanted, "ranks")
    # The running sum stays inside one range of one key, which is one task's share.
    inner = Window.partitionBy(*keys, "part").orderBy("value")
    inner = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (
        ranged.join(wanted.select(*keys, "part").distinct(), [*keys, "part"], "left_semi")
        .withColumn("upto", F.sum("n").over(inner))
    )
    hits = wanted.join(numbered, [*keys, "part"]).filter(
        (F.col("rank") >= F.col("below") + F.col("upto") - F.col("n"))
        & (F.col("rank") < F.col("below") + F.col("upto"))
    )
    # Two ranks per quantile, or one when the position is whole.
    low, high = F.min(F.struct("rank", "value")), F.max(F.struct("rank", "value"))
    between = F.col("low.value") + (F.col("high.value") - F.col("low.value")) * F.col("share")
    return hits.groupBy(*keys, "quantile", "share").agg(low.alias("low"), high.alias("high")).select(
        *keys,
        "quantile",
        # Equal ends need no sum, which infinities would turn into NaN.
        F.when(F.col("low.value") == F.col("high.value"), F.col("low.value")).otherwise(between).alias("value"),
    )


def column_quantiles(
    tables: Mapping[str, DataFrame], quantiles: Sequence[float], size: int = SKETCH_SIZE
) -> DataFrame:
    """Exact quantiles of every column: rows ``(full_name, ordinal_position, quantile, value)``.

    All columns must be numbers; they count as doubles. A mergeable sketch of each column
    brackets the wanted ranks; a scan counts what lies below and inside each bracket, and only
    values inside are moved and sorted, about ten rows per ``size``. A bracket that missed its rank
    is opened to that end, so the sketch never decides a result. A bracket around one value is
    settled by the counts. The driver holds one row per column and quantile.

    Nulls are left out, NaN is above all numbers, and a column without values has no row.
    """
    spark = SparkSession.active()
    # Each cell is made a double once, however many brackets look at it.
    tables = {
        name: df.select(*(F.col(f"`{c}`").cast("double").alias(f"v{p}") for p, c in enumerate(df.columns, 1)))
        for name, df in tables.items()
        if df.columns
    }
    if not tables or not quantiles:
        return spark.createDataFrame([], VALUES)
    brackets = _brackets(tables, quantiles, size)
    if not brackets:
        return spark.createDataFrame([], VALUES)
    counts = {
        (row["full_name"], row["ordinal_position"], row["quantile"]): row
        for row in _per_bracket(tables, brackets, counted=True).collect()
    }
    settled, still_open, ranks, moved = [], [], [], 0
    for b in brackets:
        key = (b["full_name"], b["ordinal_position"], b["quantile"])
        below, upto, low, high = counts[key]["below"], counts[key]["upto"], b["low"], b["high"]
        if b["first"] < below:
            low, below = -math.inf, 0
        if b["last"] >= upto:
            high, upto = math.nan, b["total"]
        if low == high or (math.isnan(low) and math.isnan(high)):
            settled.append((*key, low))
            continue
        moved += upto - below
        still_open.append(Row(**(b.asDict() | {"low": low, "high": high})))
        ranks += [(*key, b["share"], rank - below) for rank in {b["first"], b["last"]}]
    found = spark.createDataFrame(settled, VALUES)
    if not still_open:
        return found
    keys = ["full_name", "ordinal_position", "quantile"]
    values = _per_bracket(tables, still_open, counted=False)
    values = values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    ranged, by_part = _ranges(values, keys, partitions_for(spark, moved))
    wanted = by_part.join(F.broadcast(spark.createDataFrame(ranks, RANKS)), keys)
    # The quantile is part of the key here, and is named once in the result.
    hits = _at_ranks(ranged.withColumnRenamed("quantile", "_q"), wanted.withColumn("_q", F.col("quantile")), [*keys[:2], "_q"])
    return found.unionByName(hits.drop("_q"))


def _brackets(tables: Mapping[str, DataFrame], quantiles: Sequence[float], size: int) -> list[Row]:
    """Per column and quantile: the ranks wanted, and the values that the sketch puts around them."""
    # Twice the published error of a rank, as a share of all rows.
    error = 2 * 2.296 / size**0.9723

    def sketched(name: str, df: DataFrame) -> DataFrame:
        places = range(1, len(df.columns) + 1)
        values = df.withColumn("_group", F.spark_partition_id() % MERGE_GROUPS)
        # Sketches pass over NaN, so it goes in as infinity, its neighbour.
        known = {p: F.when(F.isnan(f"v{p}"), F.lit(math.inf)).otherwise(F.col(f"v{p}")) for p in places}
        some = values.groupBy("_group").agg(
            *(F.kll_sketch_agg_double(known[p], F.lit(size)).alias(f"s{p}") for p in places),
            *(F.count(f"v{p}").alias(f"n{p}") for p in places),
        )
        cells = (
            F.struct(
                F.lit(p).alias("ordinal_position"),
                F.kll_merge_agg_double(f"s{p}", F.lit(size)).alias("sketch"),
                F.sum(f"n{p}").alias("total"),
            )
            for p in places
        )
        return some.agg(F.array(*cells).alias("cells")).select(F.lit(name).alias("full_name"), F.inline("cells"))

    sketches = reduce(DataFrame.unionByName, (sketched(name, df) for name, df in tables.items()))
    found = [
        F.struct(
            F.lit(float(q)).alias("quantile"),
            F.kll_sketch_get_quantile_double("sketch", F.lit(max(0.0, q - error))).alias("low"),
            F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, q + error))).alias("high"),
        )
        for q in quantiles
    ]
    position = (F.col("total") - 1) * F.col("quantile")
    return (
        sketches.filter(F.col("total") > 0)
        .select("full_name", "ordinal_position", "total", F.inline(F.array(*found)))
        .select(
            "full_name",
            "ordinal_position",
            "quantile",
            "total",
            F.floor(position).alias("first"),
            F.ceil(position).alias("last"),
            (position - F.floor(position)).alias("share"),
            "low",
            F.when(F.col("high") == math.inf, F.lit(math.nan)).otherwise(F.col("high")).alias("high"),
        )
        .collect()
    )


def _value(bracket: Row) -> Column:
    return F.col(f"v{bracket['ordinal_position']}")


def _counts_of(bracket: Row) -> list[Column]:
    value = _value(bracket)
    below, upto = F.count_if(value < F.lit(bracket["low"])), F.count_if(value <= F.lit(bracket["high"]))
    return [below.alias("below"), upto.alias("upto")]


def _value_inside(bracket: Row) -> list[Column]:
    value = _value(bracket)
    inside = (value >= F.lit(bracket["low"])) & (value <= F.lit(bracket["high"]))
    return [F.when(inside, value).alias("value")]


def _per_bracket(tables: Mapping[str, DataFrame], brackets: Sequence[Row], counted: bool) -> DataFrame:
    """Rows ``(full_name, ordinal_position, quantile, …)``: the counts, or each value inside a bracket."""
    parts = []
    for name, df in tables.items():
        own = [b for b in brackets if b["full_name"] == name]
        if not own:
            continue
        cells = [
            F.struct(
                F.lit(b["ordinal_position"]).alias("ordinal_position"),
                F.lit(b["quantile"]).alias("quantile"),
                *(_counts_of(b) if counted else _value_inside(b)),
            )
            for b in own
        ]
        if counted:
            rows = df.agg(F.array(*cells).alias("cells"))
        else:
            rows = df.select(F.filter(F.array(*cells), lambda c: c["value"].isNotNull()).alias("cells"))
        parts.append(rows.select(F.lit(name).alias("full_name"), F.inline("cells")))
    return reduce(DataFrame.unionByName, parts)
