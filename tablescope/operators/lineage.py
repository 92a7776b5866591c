"""Table and column lineage: reachability, neighbours, families, adjacency."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.names import column_id
from tablescope.operators.graph import DOWNSTREAM, UPSTREAM, LineageGraph, Walk, one_root
from tablescope.workspace import written

COLUMN_PAIR = ["source_table", "source_column", "target_table", "target_column"]


@dataclass(frozen=True)
class TableLineage:
    """Nodes with their downstream counts, edges, and one row per downstream table."""

    nodes: DataFrame
    edges: DataFrame
    downstream_tables: DataFrame


@dataclass(frozen=True)
class ColumnLineage:
    """Per root column: nodes with positions, edges and four counts; and the totals."""

    nodes: DataFrame
    edges: DataFrame
    stats: DataFrame
    totals: DataFrame


def adjacency(edges: DataFrame) -> DataFrame:
    """One row per table, direction and neighbour: the long form of adjacency lists."""
    up = edges.select(
        F.col("target").alias("table"), F.lit(UPSTREAM).alias("direction"), F.col("source").alias("neighbour")
    )
    down = edges.select(
        F.col("source").alias("table"), F.lit(DOWNSTREAM).alias("direction"), F.col("target").alias("neighbour")
    )
    return up.unionByName(down).distinct()


def adjacency_counts(edges: DataFrame) -> DataFrame:
    """Upstream and downstream neighbour counts of every table, in one aggregation."""
    ends = F.inline(
        F.array(
            F.struct(F.col("target").alias("table"), F.lit(1).alias("up"), F.lit(0).alias("down")),
            F.struct(F.col("source").alias("table"), F.lit(0).alias("up"), F.lit(1).alias("down")),
        )
    )
    return (
        edges.select("source", "target")
        .distinct()
        .select(ends)
        .groupBy("table")
        .agg(F.sum("up").alias("upstream_count"), F.sum("down").alias("downstream_count"))
    )


def neighbours(edges: DataFrame, table: str, direction: str) -> DataFrame:
    """Direct neighbours of one table; the filter reaches the scan."""
    here, there = ("target", "source") if direction == UPSTREAM else ("source", "target")
    return edges.filter(F.col(here) == table).select(F.col(there).alias("table")).distinct()


def upstream_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("upstream_count"))


def table_lineage(graph: LineageGraph, root: str, direction: str = UPSTREAM) -> TableLineage:
    """All ancestors or descendants of a table, without a depth limit.

    ``is_join`` says that the edge's target has more than one upstream table, and the
    downstream counts are those of the whole graph. An unknown root is one node.
    """
    reached = graph.walk(one_root(graph, root), direction).reached.select(F.col("node").alias("id"))
    downstream = graph.edges.join(
        reached.withColumnRenamed("id", "source"), "source", "left_semi"
    ).select(F.col("source").alias("id"), F.col("target").alias("downstream_table"))
    counts = downstream.groupBy("id").agg(F.count(F.lit(1)).alias("downstream_count"))
    nodes = reached.join(counts, "id", "left").fillna(0, "downstream_count")
    near = "target" if direction == UPSTREAM else "source"
    edges = graph.edges.select("source", "target")
    if direction == DOWNSTREAM:
        edges = edges.join(reached.withColumnRenamed("id", near), near, "left_semi")
    # Written, so that a busy target can be split. Upstream only the reached targets are counted for,
    # and the same join finds their edges.
    joins = upstream_counts(graph.edges).select(F.col("id").alias("target"), (F.col("upstream_count") > 1).alias("is_join"))
    if direction == UPSTREAM:
        joins = joins.join(reached.withColumnRenamed("id", near), near, "left_semi")
    edges = edges.join(written(joins, "joins"), "target").select("source", "target", "is_join")
    return TableLineage(nodes, edges, downstream)


def descendants(graph: LineageGraph, root: str, max_depth: int | None = None) -> DataFrame:
    """Distinct tables downstream by one step or more; the root too if it is on a cycle."""
    walk = graph.walk(one_root(graph, root), DOWNSTREAM, max_depth)
    return beyond_root(graph, walk, root, DOWNSTREAM, max_depth)


def ancestors(graph: LineageGraph, root: str, max_depth: int | None = None) -> DataFrame:
    """Distinct tables upstream by one step or more; the root too if it is on a cycle."""
    walk = graph.walk(one_root(graph, root), UPSTREAM, max_depth)
    return beyond_root(graph, walk, root, UPSTREAM, max_depth)


def beyond_root(
    graph: LineageGraph, walk: Walk, root: str, direction: str, max_depth: int | None = None
) -> DataFrame:
    """Tables of a finished walk from ``root`` that one step or more leads to."""
    near, far = ("target", "source") if direction == UPSTREAM else ("source", "target")
    reached = walk.reached
    inside = reached if max_depth is None else reached.filter(F.col("dist") < max_depth)
    back = (
        graph.edges.filter(F.col(far) == root)
        .join(inside.select(F.col("node").alias(near)), near, "left_semi")
        .select(F.col(far).alias("table"))
    )
    others = reached.filter(F.col("dist") > 0).select(F.col("node").alias("table"))
    return others.unionByName(back).distinct()


def families(graph: LineageGraph, roots: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Rows ``(root, member)``: ancestors, descendants, children of direct parents, self.

    With ``members`` (column ``member``) only those are listed: children of other kinds are
    dropped before parents and children meet.
    """
    up = graph.walk(roots, UPSTREAM).reached.select("root", F.col("node").alias("member"))
    down = graph.walk(roots, DOWNSTREAM).reached.select("root", F.col("node").alias("member"))
    parents = roots.join(graph.edges, F.col("root") == F.col("target")).select("root", "source")
    children = graph.edges.select("source", F.col("target").alias("member"))
    lines = up.unionByName(down)
    if members is not None:
        children = children.join(members.select("member"), "member", "left_semi")
        lines = lines.join(members.select("member"), "member", "left_semi")
    siblings = parents.join(children, "source").select("root", "member")
    return lines.unionByName(siblings).distinct()


def family(graph: LineageGraph, table: str) -> DataFrame:
    return families(graph, one_root(graph, table)).select(F.col("member").alias("table"))


def bounded_lineage(
    graph: LineageGraph, table: str, depth: int, down: Walk | None = None
) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes and edges on paths of at most ``depth`` steps up or down.

    A caller that has already walked downstream from the table passes that walk.
    """
    root = one_root(graph, table)
    up = graph.walk(root, UPSTREAM, depth).reached
    down = (down or graph.walk(root, DOWNSTREAM, depth)).reached.filter(F.col("dist") <= depth)
    nodes = up.unionByName(down).select(F.col("node").alias("id")).distinct()
    return nodes, _path_edges(graph, up, down, depth).select("source", "target").distinct()


def _path_edges(graph: LineageGraph, up: DataFrame, down: DataFrame, depth: int | None) -> DataFrame:
    """Edges on paths within ``depth``, per root: an edge that starts at a node at distance
    ``depth - 1`` or less lies on such a path, so no paths need to be listed."""
    if depth is not None:
        up, down = up.filter(F.col("dist") < depth), down.filter(F.col("dist") < depth)
    above, below = graph.edges_of(up, UPSTREAM), graph.edges_of(down, DOWNSTREAM)
    # An edge is once on each side, and on both only where its target is above as well.
    both = up.select("root", F.col("node").alias("target"))
    return above.unionByName(below.join(both, ["root", "target"], "left_anti"))


def column_graph_edges(column_edges: DataFrame) -> DataFrame:
    """Column lineage rows as edges between column ids ``table.column``."""
    return column_edges.select(
        column_id("source_table", "source_column").alias("source"),
        column_id("target_table", "target_column").alias("target"),
    )


def column_nodes(column_edges: DataFrame) -> DataFrame:
    """Distinct columns met in the lineage: id, table and column name."""
    ends = F.inline(
        F.array(
            F.struct(F.col("source_table").alias("table"), F.col("source_column").alias("column")),
            F.struct(F.col("target_table").alias("table"), F.col("target_column").alias("column")),
        )
    )
    return column_edges.select(ends).distinct().withColumn("id", column_id("table", "column"))


def table_columns(column_edges: DataFrame, table: str) -> DataFrame:
    """Distinct column names of a table, in order."""
    return (
        column_nodes(column_edges)
        .filter((F.col("table") == table) & F.col("column").isNotNull())
        .select("column")
        .distinct()
        .orderBy("column")
    )


def column_lineage(
    graph: LineageGraph, columns: DataFrame, roots: DataFrame, max_depth: int | None = None
) -> ColumnLineage:
    """Lineage of every root column within a depth, in two walks for all roots together.

    ``graph`` runs between column ids, ``columns`` is ``column_nodes``, ``roots`` has a
    column ``root``. Roots that the lineage does not know have no rows. Without ``max_depth``
    there is no limit.
    """
    if max_depth is not None and max_depth < 1:
        raise ValueError("the depth must be at least 1")
    known = roots.select("root").join(columns.select(F.col("id").alias("root")), "root", "left_semi").distinct()
    up = graph.walk(known, UPSTREAM, max_depth).reached
    down = graph.walk(known, DOWNSTREAM, max_depth).reached
    sides = up.withColumn("side", F.lit(1)).unionByName(down.withColumn("side", F.lit(2)))
    position = (
        F.when(F.col("node") == F.col("root"), "root")
        .when(F.col("sides") == 1, "upstream")
        .when(F.col("sides") == 2, "downstream")
        .otherwise("both")
    )
    nodes = (
        sides.groupBy("root", "node")
        .agg(F.sum("side").alias("sides"))
        .select("root", F.col("node").alias("id"), position.alias("position"))
        .join(columns, "id")
        .select("root", "id", "table", "column", "position")
    )
    edges = _path_edges(graph, up, down, max_depth)
    nodes, edges = written(nodes, "column-nodes"), written(edges, "column-edges")
    is_up = F.col("position").isin("upstream", "both")
    is_down = F.col("position").isin("downstream", "both")
    stats = (
        nodes.groupBy("root")
        .agg(
            F.count(F.lit(1)).alias("node_count"),
            F.count_if(is_up).alias("upstream_node_count"),
            F.count_if(is_down).alias("downstream_node_count"),
        )
        .join(edges.groupBy("root").agg(F.count(F.lit(1)).alias("edge_count")), "root", "left")
        .fillna(0, "edge_count")
    )
    # Roots without lineage rows count as zeros in the answer for one column.
    stats = roots.select("root").distinct().join(stats, "root", "left").fillna(0)
    return ColumnLineage(nodes, edges, stats, _column_totals(stats, nodes, edges))


def _column_totals(stats: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: columns with lineage on each side, summed and distinct counts."""
    one = F.lit(1)
    parts = [
        stats.select(
            one.alias("root_column_count"),
            (F.col("upstream_node_count") > 0).cast("int").alias("columns_with_upstream"),
            (F.col("downstream_node_count") > 0).cast("int").alias("columns_with_downstream"),
            F.col("node_count").alias("aggregate_node_count"),
            F.col("edge_count").alias("aggregate_edge_count"),
        ),
        nodes.select("id").distinct().select(one.alias("unique_node_count")),
        edges.select("source", "target").distinct().select(one.alias("unique_edge_count")),
    ]
    # Each part fills its own columns of the sums; the others stay null there.
    rows = parts[0].unionByName(parts[1], True).unionByName(parts[2], True)
    return rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns))


def lineage_of_table(
    column_edges: DataFrame, table: str, max_depth: int | None = None
) -> ColumnLineage:
    """Column lineage of every column of a table."""
    column_edges = written(column_edges.select(*COLUMN_PAIR), "column-pairs")
    columns = written(column_nodes(column_edges), "columns")
    roots = columns.filter((F.col("table") == table) & F.col("column").isNotNull())
    with LineageGraph(column_graph_edges(column_edges)) as graph:
        return column_lineage(graph, columns, roots.select(F.col("id").alias("root")), max_depth)


def lineage_of_column(
    column_edges: DataFrame, table: str, column: str, max_depth: int | None = None
) -> ColumnLineage:
    """Column lineage of one column."""
    column_edges = written(column_edges.select(*COLUMN_PAIR), "column-pairs")
    columns = written(column_nodes(column_edges), "columns")
    with LineageGraph(column_graph_edges(column_edges)) as graph:
        return column_lineage(graph, columns, one_root(graph, f"{table}.{column}"), max_depth)

