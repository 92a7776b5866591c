"""Stored steps."""

import os

from tablescope.workspace import FREE_SHUFFLES, written


def shuffle_files():
    from pyspark import SparkContext

    manager = SparkContext._active_spark_context._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(f.startswith("shuffle_") for top in manager.localDirsString() for _, _, names in os.walk(top) for f in names)


def test_a_stored_step_leaves_no_shuffle_files(spark):
    rows = spark.range(1000).selectExpr("id % 7 AS k", "id")
    before = shuffle_files()
    kept = written(rows.groupBy("k").count().join(rows.repartition(3, "id"), "k"), "step")
    assert shuffle_files() <= before
    assert kept.count() == 1000
    assert spark.conf.get(FREE_SHUFFLES, None) in (None, "false")
