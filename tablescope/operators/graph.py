"""The frontier loop behind every lineage operator.

Edges are rows ``(source, target)`` in data-flow order. A walk keeps rows
``(root, node, dist)``, so one loop serves many roots. Each level joins the frontier
with the edges, drops what was already reached and adds the rest to a bucketed table; the
driver only learns how many rows a level has. Small levels of a long walk are not compared with all
that was reached, but at depths that double; what they meet again is dropped at the end.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.workspace import ROWS_IN_PARTITION, new_path, partitions_for, shuffles_freed, written

UPSTREAM, DOWNSTREAM, BOTH_WAYS = "upstream", "downstream", "both"

# A partition of edges is not made for fewer.
EDGES_IN_SMALL_PARTITION = 50_000

# In its first levels, a frontier of few rows goes to the edges before a direction's copy of them is made.
EARLY_LEVELS, FEW_ROWS = 2, 1_000

# A level is compared with all that was reached if it may have more than one row for so many of those.
SMALL_LEVEL = 8


@dataclass(frozen=True)
class Carry:
    """A value that a walk brings along: its start, its next value and how ties fold."""

    start: Column
    step: Column
    fold: object


@dataclass(frozen=True)
class _Steps:
    """Edges seen from one side, partitioned by the side a frontier joins on."""

    frame: DataFrame
    hubs: DataFrame | None


class LineageGraph:
    """An edge table prepared for walks; use it as a context manager.

    The distinct edges are written once. Each direction that is walked keeps a copy
    partitioned by its join key, so a level moves its frontier and not the edges. A node
    with more than ``hub_edges`` edges is split over several partitions.
    """

    def __init__(self, edges: DataFrame, hub_edges: int = ROWS_IN_PARTITION):
        keys = ["source", "target"]
        extra = [c for c in edges.columns if c not in keys]
        edges = edges.dropna(subset=keys)
        if extra:
            edges = edges.groupBy(*keys).agg(*(F.max(c).alias(c) for c in extra))
        else:
            edges = edges.select(*keys).distinct()
        self.extra = extra
        self.edges = written(edges, "edges")
        self.edge_count = self.edges.count()
        self._hub_edges = hub_edges
        self._steps: dict[str, _Steps] = {}

    def __enter__(self) -> LineageGraph:
        return self

    def __exit__(self, *_):
        for steps in self._steps.values():
            steps.frame.unpersist()
        self._steps.clear()

    def nodes(self) -> DataFrame:
        ends = F.explode(F.array("source", "target")).alias("node")
        return self.edges.select(ends).distinct()

    def steps(self, direction: str) -> _Steps:
        if direction not in self._steps:
            self._steps[direction] = self._prepare(direction)
        return self._steps[direction]

    def edges_of(self, reached: DataFrame, direction: str) -> DataFrame:
        """(root, source, target): the edges that lead on in a direction from rows ``(root, node)``.

        Where a walk has made a copy of the edges for that direction, they stay where they lie.
        """
        made = self._steps.get(direction)
        edges = self._seen_from(direction) if made is None else made.frame
        names = ("target", "source") if direction == UPSTREAM else ("source", "target")
        met = edges.select("here", "there").join(reached.select("root", F.col("node").alias("here")), "here")
        return met.select("root", F.col("here").alias(names[0]), F.col("there").alias(names[1])).select("root", "source", "target")

    def _seen_from(self, direction: str) -> DataFrame:
        forward = self.edges.withColumnsRenamed({"source": "here", "target": "there"})
        backward = self.edges.withColumnsRenamed({"source": "there", "target": "here"})
        frame = {DOWNSTREAM: forward, UPSTREAM: backward}.get(direction)
        return forward.unionByName(backward) if frame is None else frame

    def _prepare(self, direction: str) -> _Steps:
        frame = self._seen_from(direction)
        keys = ["here"]
        hubs = written(
            frame.groupBy("here")
            .agg(F.count(F.lit(1)).alias("degree"))
            .filter(F.col("degree") > self._hub_edges)
            .select("here", F.ceil(F.col("degree") / self._hub_edges).cast("int").alias("parts")),
            "hubs",
        )
        if hubs.isEmpty():
            hubs = None
        else:
            frame = frame.join(hubs, "here", "left")
            spread = F.pmod(F.xxhash64("there"), F.col("parts")).cast("int")
            frame = frame.withColumn("salt", F.coalesce(spread, F.lit(0))).drop("parts")
            keys = ["here", "salt"]
        frame = frame.repartition(self._partitions(), *keys)
        return _Steps(frame.persist(StorageLevel.MEMORY_AND_DISK), hubs)

    def _partitions(self) -> int:
        """Few partitions for a small graph; beyond the session's number only by size."""
        few = -(-self.edge_count // EDGES_IN_SMALL_PARTITION)
        return max(1, min(few, partitions_for(self.edges.sparkSession, self.edge_count)))

    def walk(
        self,
        roots: DataFrame,
        direction: str,
        max_depth: int | None = None,
        blocked: DataFrame | None = None,
        carry: Mapping[str, Carry] | None = None,
        repeats: bool = False,
    ) -> Walk:
        """Shortest distances from every root.

        ``roots`` has a column ``root``, or ``root`` and a starting ``node``. A node in
        ``blocked`` (column ``node``) is never entered. The roots are at distance 0. With
        ``repeats``, a node may be there again with greater distances; the least one is right.
        """
        carry = dict(carry or {})
        spark = roots.sparkSession
        start = roots if "node" in roots.columns else roots.withColumn("node", F.col("root"))
        start = start.select("root", "node", F.lit(0).alias("dist"), *(c.start.alias(n) for n, c in carry.items()))
        depth, table = 0, _Reached(spark)
        total, repeated = 0, False
        try:
            rows = table.add(start.distinct())
            while rows and (max_depth is None or depth < max_depth):
                total += rows
                # The distance comes from the rows and not from a literal, so that every level
                # runs the same generated code. All rows of a level have one distance.
                if depth < EARLY_LEVELS and rows <= FEW_ROWS and direction not in self._steps:
                    # A walk may end here, so it does not wait for a copy of the edges.
                    reached = self._seen_from(direction).join(F.broadcast(table.level(depth)), F.col("node") == F.col("here"))
                else:
                    reached = self._advance(table.level(depth), self.steps(direction), rows)
                reached = reached.select(
                    "root",
                    F.col("there").alias("node"),
                    (F.col("dist") + 1).alias("dist"),
                    *(c.step.alias(n) for n, c in carry.items()),
                )
                folds = [c.fold(n).alias(n) for n, c in carry.items()]
                reached = reached.groupBy("root", "node").agg(F.max("dist").alias("dist"), *folds)
                if direction != BOTH_WAYS and not carry and rows * SMALL_LEVEL < total and depth & (depth + 1):
                    repeated = True
                else:
                    # Where edges go both ways, neighbours' distances differ by one at most.
                    before = table.read().filter(F.col("dist") >= (depth - 1 if direction == BOTH_WAYS else 0))
                    reached = reached.join(before.select("root", "node"), ["root", "node"], "left_anti")
                if blocked is not None:
                    reached = reached.join(blocked.select("node"), "node", "left_anti")
                rows = table.add(reached.select("root", "node", "dist", *carry))
                depth += bool(rows)
            found = table.files(start.schema)
            if repeated and not repeats:
                once = found.groupBy("root", "node").agg(F.min("dist").alias("dist"))
                once = written(once, "walked")
                return Walk(once, once.agg(F.max("dist")).first()[0])
            return Walk(found, depth)
        finally:
            table.forget()

    def _advance(self, frontier: DataFrame, steps: _Steps, rows: int) -> DataFrame:
        """The frontier joined with its edges.

        A hub's rows meet each part of its edges. A node that more roots stand at than one
        partition should hold is split by root, and its edges go to each part.
        """
        if rows > self._hub_edges:
            crowds = written(
                frontier.groupBy("node")
                .agg(F.count(F.lit(1)).alias("roots"))
                .filter(F.col("roots") > self._hub_edges)
                .select("node", F.ceil(F.col("roots") / self._hub_edges).cast("int").alias("crowd")),
                "crowds",
            )
            if not crowds.isEmpty():
                calm = frontier.join(crowds, "node", "left_anti")
                part = F.pmod(F.xxhash64("root"), F.col("crowd")).cast("int")
                split = frontier.join(crowds, "node").withColumn("part", part).drop("crowd")
                every = F.explode(F.sequence(F.lit(0), F.col("crowd") - 1))
                copies = crowds.withColumn("copy", every).withColumnRenamed("node", "here").drop("crowd")
                edges = steps.frame.join(copies, "here").drop("salt")
                met = split.join(edges, (F.col("node") == F.col("here")) & (F.col("part") == F.col("copy")))
                return self._meet(calm, steps).drop("salt", "at_salt", "parts").unionByName(met.drop("part", "copy"))
        return self._meet(frontier, steps)

    def _meet(self, frontier: DataFrame, steps: _Steps) -> DataFrame:
        edges = steps.frame
        if steps.hubs is None:
            return frontier.join(edges, F.col("node") == F.col("here"))
        hubs = steps.hubs.withColumnRenamed("here", "node")
        salts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        frontier = frontier.join(hubs, "node", "left").withColumn("at_salt", salts)
        return frontier.join(edges, (F.col("node") == F.col("here")) & (F.col("at_salt") == F.col("salt")))


class _Reached:
    """What a walk has reached, as a table in buckets of (root, node) with a folder per distance.

    New rows are compared with those of their own bucket, so only the new level is shuffled.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.name = spark, f"tablescope_walk_{uuid.uuid4().hex}"
        self.path = new_path(spark, "walk")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, rows: DataFrame) -> int:
        """Append rows and say how many they are."""
        seen = Observation()
        writer = rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").option("path", self.path)
        with shuffles_freed(self.spark):
            writer.partitionBy("dist").bucketBy(self.buckets, "root", "node").saveAsTable(self.name)
        return seen.get["rows"]

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def level(self, depth: int) -> DataFrame:
        return self.read().filter(F.col("dist") == depth)

    def files(self, schema: T.StructType) -> DataFrame:
        """The rows without the table, which is forgotten at the end of the walk."""
        return self.spark.read.schema(schema).parquet(self.path)

    def forget(self):
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


@dataclass(frozen=True)
class Walk:
    """What a walk reached, and the greatest distance it met."""

    reached: DataFrame
    depth: int


def one_root(graph: LineageGraph, root: str) -> DataFrame:
    """A one-row frame of roots."""
    return graph.edges.sparkSession.range(1).select(F.lit(root).alias("root"))
