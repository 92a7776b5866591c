"""Incremental lineage ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Folders that a batch is dealt into by a hash of its edges.
BUCKETS = 64


class EdgeLog:
    """An edge table as one folder per run and batch, each with the edges that batch added.

    A run is the life of one stream checkpoint; another checkpoint numbers its batches anew.
    A batch only writes edges that no earlier batch and no other run holds, and replaces its
    own folder when it is replayed, so a repeated batch leaves the table as it was. Edges lie
    in buckets, and a batch reads only the buckets that its own edges fall into.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def read(self) -> DataFrame:
        """All edges, with the run, the batch that added them, and their bucket."""
        schema = f"{self.schema}, run string, batch bigint, bucket int"
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def edges(self) -> DataFrame:
        return self.read().drop("run", "batch", "bucket")

    def add(self, edges: DataFrame, batch: int, run: str = "run"):
        """Merge the distinct complete edges of one batch."""
        keys = edges.columns
        bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
        # Worked out once, and dealt by bucket, so that a bucket is one file of the batch.
        fresh = edges.dropna().distinct().withColumn("bucket", bucket).repartition("bucket").persist()
        used = [row.bucket for row in fresh.select("bucket").distinct().collect()]  # at most BUCKETS
        earlier = self.read().filter(F.col("bucket").isin(used) & ((F.col("run") != run) | (F.col("batch") < batch)))
        new = fresh.join(earlier.select("bucket", *keys), ["bucket", *keys], "left_anti")
        new.select(*keys, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.path}/run={run}/batch={batch}"
        )
        fresh.unpersist()


def ingest_edges(
    rows: DataFrame,
    log: EdgeLog,
    checkpoint: str,
    to_edges: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Merge all rows that a streaming frame has to offer into an edge log, and stop."""

    def merge(batch_rows: DataFrame, batch: int):
        # Spark keeps the query's id in the checkpoint, so it names the run.
        run = batch_rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        log.add(to_edges(batch_rows) if to_edges else batch_rows, batch, run)

    return (
        rows.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
