"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescope.workspace import new_path, removed

# Bits of monotonically_increasing_id() that number the rows of one partition.
ROW_BITS = 33


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder, read it back, and say where it is."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def free(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        removed(spark, path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def in_order(df: DataFrame, order: list, weight=None, label: str = "ordered") -> DataFrame:
    """``df`` with ``position``: how many rows (or how much ``weight``) come before each row.

    Rows are range-partitioned by ``order`` and sorted inside the partitions. Each partition
    adds up its own rows; only one total per partition is summed in one place. Columns of
    ``order`` must settle the order, up to rows that are equal in all columns.
    """
    weighted = df.withColumn("_weight", F.lit(1).cast("long") if weight is None else weight)
    parts = weighted.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"{weighted.schema.toDDL()}, _part int, _before long"

    def running(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = batch["_weight"].cumsum()
            yield batch.assign(_part=part, _before=before + sums - batch["_weight"])
            before += int(sums.iloc[-1]) if len(batch) else 0

    rows, _ = stored(parts.mapInPandas(running, schema), label)
    totals = rows.groupBy("_part").agg(F.max(F.col("_before") + F.col("_weight")).alias("_total"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_start"))
    # One row per partition of the range partitioning, so its size does not follow the data's.
    return (
        rows.join(F.broadcast(starts), "_part")
        .withColumn("position", F.col("_start") + F.col("_before"))
        .drop("_part", "_before", "_weight", "_start")
    )
