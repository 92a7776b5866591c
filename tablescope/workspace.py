"""Intermediate tables in the folder that all executors share.

Loops and multi-step jobs write each step as a Parquet table and read it back.
That cuts the lineage of the plan, gives the optimizer real sizes to choose joins
by, and survives the loss of an executor.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# About the most rows that one partition of a range or hash partitioning should hold.
ROWS_IN_PARTITION = 5_000_000


def partitions_for(spark: SparkSession, rows: int) -> int:
    """The session's number of shuffle partitions, or more where the rows need more."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, -(-rows // ROWS_IN_PARTITION))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder in the session's warehouse.

    Both are shared by the driver and all executors of a cluster.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses; it goes when the session's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/tablescope/{label}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


# Spark's own setting: shuffle files go when the query that made them has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run here delete their shuffle files when they end.

    Otherwise these stay until the driver happens to collect its garbage, so a job of many steps
    holds the shuffles of all of them. What a step leaves is a stored table, which needs none.
    """
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def written(df: DataFrame, label: str, path: str | None = None, schema=None) -> DataFrame:
    """Write ``df`` as a new table in the shared folder and read it back."""
    path = path or new_path(df.sparkSession, label)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)
