"""Lineage ingest on keyed streaming state: a batch costs its own rows, however long the log is.

Each edge that was ever seen is a key of the stream's state store. A batch is shuffled by edge, the
store answers which edges are new, and only those are appended by Spark's file sink. The log itself
is never read. State and log are committed together by batch, so a batch that is run again after a
failure writes nothing twice, and edges that are delivered again add nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeyedEdgeLog:
    """Distinct edges that one stream after the other appends under ``path``.

    ``path`` lies in a folder that all executors share. State and source positions lie beside the
    edges, so a log has one life: a stream that goes on later takes up where the last one ended.
    State is kept in RocksDB on the executors' disks and saved to ``path`` with every batch.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.schema = spark, schema
        self.folder, self.state = f"{path.rstrip('/')}/edges", f"{path.rstrip('/')}/state"

    def edges(self) -> DataFrame:
        """All committed edges, each once; none before the first batch."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def ingest(self, rows: DataFrame, to_edges: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
        """Append the new complete edges of all that a streaming frame has to offer, and stop.

        ``to_edges`` makes edges of rows and may use stateless operations only. Edges with a null
        are left out.
        """
        edges = (to_edges(rows) if to_edges else rows).dropna()
        # No watermark: an edge counts as seen for as long as the log lives.
        edges = edges.dropDuplicates(edges.columns)
        before = self.spark.conf.get(PROVIDER)
        self.spark.conf.set(PROVIDER, ROCKS_DB)  # taken by the stream as it starts
        try:
            return (
                edges.writeStream.format("parquet")
                .option("path", self.folder)
                .option("checkpointLocation", self.state)
                .trigger(availableNow=True)
                .start()
            )
        finally:
            self.spark.conf.set(PROVIDER, before)
