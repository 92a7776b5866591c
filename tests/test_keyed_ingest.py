"""Keyed streaming state next to plain sets of edges."""

import random

from pyspark.sql import functions as F

from conftest import rows
from tablescope.streaming.keyed import PROVIDER, KeyedEdgeLog

SCHEMA = "source string, target string"


def deliver(spark, folder, edges):
    spark.createDataFrame(edges, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_every_edge_is_appended_once(spark, tmp_path):
    """Random deliveries with repeats and nulls, in several lives of the stream."""
    r, folder = random.Random(5), str(tmp_path / "in")
    log, seen = KeyedEdgeLog(spark, str(tmp_path / "log"), SCHEMA), set()
    assert rows(log.edges()) == []
    provider = spark.conf.get(PROVIDER)
    for _ in range(4):
        edges = [(r.choice("abcdef"), r.choice(["x", "y", "z", None])) for _ in range(r.randrange(1, 12))]
        deliver(spark, folder, edges)
        seen |= {e for e in edges if None not in e}
        log.ingest(stream(spark, folder)).awaitTermination()
        assert rows(log.edges()) == sorted(seen)
    assert spark.conf.get(PROVIDER) == provider


def test_a_replay_adds_nothing_and_a_batch_reads_its_own_rows(spark, tmp_path):
    folder, log = str(tmp_path / "in"), KeyedEdgeLog(spark, str(tmp_path / "log"), SCHEMA)
    first = [(f"s{i}", f"t{i % 7}") for i in range(300)]
    deliver(spark, folder, first)
    log.ingest(stream(spark, folder)).awaitTermination()
    again = log.ingest(stream(spark, folder))  # nothing has arrived
    again.awaitTermination()
    assert sum(p["numInputRows"] for p in again.recentProgress) == 0
    deliver(spark, folder, first[:5] + [("new", "t")])
    later = log.ingest(stream(spark, folder))
    later.awaitTermination()
    progress = [p for p in later.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in progress] == [6]  # rows of its own, none of the 300 in the log
    state = progress[0]["stateOperators"][0]
    assert (state["numRowsUpdated"], state["numRowsTotal"]) == (1, 301)
    assert rows(log.edges()) == sorted({*first, ("new", "t")})


def test_rows_become_edges(spark, tmp_path):
    folder, log = str(tmp_path / "in"), KeyedEdgeLog(spark, str(tmp_path / "log"), SCHEMA)
    deliver(spark, folder, [("a", "b"), ("A", "b"), ("a", None)])
    log.ingest(stream(spark, folder), lambda df: df.select(F.lower("source").alias("source"), "target")).awaitTermination()
    assert rows(log.edges()) == [("a", "b")]
