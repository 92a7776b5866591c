"""Registered lineage queries: scans, reachability, paths, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.operators import closure, labels, layout, lineage, paths
from tablescope.operators.graph import DOWNSTREAM, UPSTREAM, one_root
from tablescope.plans import inputs
from tablescope.plans.registry import Tables, query
from tablescope.sources import lineage as sources

ROOT = "stage.part.p1"
START = "raw.supplier.s5"
PART = "stage.part.p3"
# More levels than any shortest path in the undirected part graph has.
FAR_ENOUGH = 40


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(p.strip() for p in parts)


def _reach(name: str, edges: str, roots: str, near: str, far: str, depth: int | None = None) -> str:
    """CTE of ``(root, node)`` or, with a depth, ``(root, node, dist)`` reached from roots."""
    if depth is None:
        return (
            f"{name}(root, node) AS ({roots} UNION "
            f"SELECT r.root, e.{far} FROM {name} r JOIN {edges} e ON e.{near} = r.node)"
        )
    return (
        f"{name}_all(root, node, dist) AS (SELECT root, node, 0 FROM ({roots}) UNION "
        f"SELECT r.root, e.{far}, r.dist + 1 FROM {name}_all r JOIN {edges} e ON e.{near} = r.node "
        f"WHERE r.dist < {depth}), {name} AS (SELECT root, node, min(dist) AS dist FROM {name}_all GROUP BY root, node)"
    )


def _root(name: str) -> str:
    return f"SELECT '{name}' AS root, '{name}' AS node"


UP = _reach("up", "edges", _root(ROOT), "target", "source")
DOWN = _reach("down", "edges", _root(START), "source", "target")


# Scans ------------------------------------------------------------------------------


@query("s1_table_lineage", _with(inputs.EDGES_SQL) + " SELECT source, target FROM edges")
def s1(t: Tables) -> DataFrame:
    return inputs.edges(t)


@query(
    "s2_column_lineage",
    _with(inputs.COLUMN_LOG_SQL)
    + " SELECT source_table, source_column, target_table, target_column FROM column_edges",
)
def s2(t: Tables) -> DataFrame:
    return inputs.column_edges(t)


@query("s7_graph_document_edges", _with(inputs.FLOW_SQL) + " SELECT source, target, is_join FROM flow_rows")
def s7(t: Tables) -> DataFrame:
    return inputs.flow_edges(t)


@query(
    "s7_graph_document_nodes",
    _with(inputs.FLOW_SQL) + " SELECT source AS node FROM flow UNION SELECT target FROM flow",
)
def s7_nodes(t: Tables) -> DataFrame:
    return sources.graph_nodes(sources.parse_graphs(inputs.graph_documents(t), "text"))


# Adjacency and reachability ------------------------------------------------------------


@query(
    "a5_adjacency",
    _with(inputs.EDGES_SQL)
    + """ SELECT target AS "table", 'upstream' AS direction, source AS neighbour FROM edges
    UNION SELECT source, 'downstream', target FROM edges""",
)
def a5(t: Tables) -> DataFrame:
    return lineage.adjacency(inputs.edges(t))


@query(
    "a5_adjacency_counts",
    _with(inputs.EDGES_SQL)
    + """ SELECT "table", sum(up)::BIGINT AS upstream_count, sum(down)::BIGINT AS downstream_count FROM (
      SELECT target AS "table", 1 AS up, 0 AS down FROM edges
      UNION ALL SELECT source, 0, 1 FROM edges) GROUP BY "table" """,
)
def a5_counts(t: Tables) -> DataFrame:
    return lineage.adjacency_counts(inputs.edges(t))


NODES_SQL = """ SELECT node AS id, (SELECT count(*) FROM edges WHERE source = node) AS downstream_count FROM {}"""
COUNTED = """indegree AS (SELECT target AS t, count(*) AS n FROM edges GROUP BY target)"""


@query("g1_upstream_nodes", _with(inputs.EDGES_SQL, UP) + NODES_SQL.format("up"))
def g1_nodes(t: Tables) -> DataFrame:
    with inputs.graph(t) as graph:
        return lineage.table_lineage(graph, ROOT, UPSTREAM).nodes


@query(
    "g1_upstream_edges",
    _with(inputs.EDGES_SQL, UP, COUNTED)
    + " SELECT source, target, n > 1 AS is_join FROM edges JOIN indegree ON t = target"
    " WHERE target IN (SELECT node FROM up)",
)
def g1_edges(t: Tables) -> DataFrame:
    with inputs.graph(t) as graph:
        return lineage.table_lineage(graph, ROOT, UPSTREAM).edges


@query(
    "g1_upstream_downstream_tables",
    _with(inputs.EDGES_SQL, UP)
    + " SELECT source AS id, target AS downstream_table FROM edges WHERE source IN (SELECT node FROM up)",
)
def g1_tables(t: Tables) -> DataFrame:
    with inputs.graph(t) as graph:
        return lineage.table_lineage(graph, ROOT, UPSTREAM).downstream_tables


@query("g2_downstream_nodes", _with(inputs.EDGES_SQL, DOWN) + NODES_SQL.format("down"))
def g2_nodes(t: Tables) -> DataFrame:
    with inputs.graph(t) as graph:
        return lineage.table_lineage(graph, START, DOWNSTREAM).nodes


@query(
    "g2_downstream_edges",
    _with(inputs.EDGES_SQL, DOWN, COUNTED)
    + " SELECT source, target, n > 1 AS is_join FROM edges JOIN indegree ON t = target"
    " WHERE source IN (SELECT node FROM down)",
)
def g2_edges(t: Tables) -> DataFrame:
    with inputs.graph(t) as graph:
        return lineage.table_lineage(graph, START, DOWNSTREAM).edges


@query(
    "g3_direct_upstream",
    _with(inputs.EDGES_SQL) + f""" SELECT source AS "table" FROM edges WHERE target = '{PART}'""",
)
def g3_up(t: Tables) -> DataFrame:
    return lineage.neighbours(inputs.edges(t), PART, UPSTREAM)


@query(
    "g3_direct_downstream",
    _with(inputs.EDGES_SQL) + f""" SELECT target AS "table" FROM edges WHERE source = '{START}'""",
)
def g3_down(t: Tables) -> DataFrame:
    return lineage.neighbours(inputs.edges(t), START, DOWNSTREAM)


@query(
    "g6_family",
    _with(
        inputs.EDGES_SQL,
        _reach("up", "edges", _root("stage.part.p5"), "target", "source"),
        _reach("down", "edges", _root("stage.part.p5"), "source", "target"),
    )
    + """ SELECT node AS "table" FROM up UNION SELECT node FROM down UNION
    SELECT s.target FROM edges p JOIN edges s ON s.source = p.source WHERE p.target = 'stage.part.p5'""",
)
def g6(t: Tables) -> DataFrame:
    with inputs.graph(t) as graph:
        return lineage.family(graph, "stage.part.p5")


BOUNDED = (
    inputs.EDGES_SQL,
    _reach("up", "edges", _root(PART), "target", "source", 3),
    _reach("down", "edges", _root(PART), "source", "target", 3),
)
BOUNDED_EDGES = """
    SELECT source, target FROM edges WHERE target IN (SELECT node FROM up WHERE dist < 3)
    UNION SELECT source, target FROM edges WHERE source IN (SELECT node FROM down WHERE dist < 3)"""


@query("g7_bounded_nodes", _with(*BOUNDED) + " SELECT node AS id FROM up UNION SELECT node FROM down")
def g7_nodes(t: Tables) -> DataFrame:
    with inputs.graph(t) as graph:
        return lineage.bounded_lineage(graph, PART, 3)[0]


@query("g7_bounded_edges", _with(*BOUNDED) + BOUNDED_EDGES)
def g7_edges(t: Tables) -> DataFrame:
    with inputs.graph(t) as graph:
        return lineage.bounded_lineage(graph, PART, 3)[1]


@query(
    "g8_downstream_impact",
    _with(inputs.EDGES_SQL, DOWN) + f""" SELECT node AS "table" FROM down WHERE node <> '{START}'""",
)
def g8(t: Tables) -> DataFrame:
    with inputs.graph(t) as graph:
        return lineage.descendants(graph, START)


@query(
    "o2_family_union",
    _with(
        inputs.EDGES_SQL,
        _reach("up", "edges", _root("stage.part.p40"), "target", "source"),
        _reach("down", "edges", _root("stage.part.p40"), "source", "target"),
    )
    + """ SELECT 'stage.part.p40' AS root, node AS member FROM up UNION
    SELECT 'stage.part.p40', node FROM down UNION
    SELECT 'stage.part.p40', s.target FROM edges p JOIN edges s ON s.source = p.source
    WHERE p.target = 'stage.part.p40'""",
)
def o2(t: Tables) -> DataFrame:
    with inputs.graph(t) as graph:
        return lineage.families(graph, one_root(graph, "stage.part.p40"))


# Column lineage --------------------------------------------------------------------------

COLUMN = "stage.part.p2.supply"


def _column_sql(roots: str) -> str:
    return _with(
        inputs.COLUMN_LOG_SQL,
        f"roots AS ({roots})",
        _reach("up", "cedges", "SELECT root, root AS node FROM roots", "target", "source", 20),
        _reach("down", "cedges", "SELECT root, root AS node FROM roots", "source", "target", 20),
        """positions AS (
          SELECT root, node AS id, bool_or(up) AS up, bool_or(NOT up) AS down FROM (
            SELECT root, node, true AS up FROM up UNION ALL SELECT root, node, false FROM down)
          GROUP BY root, node),
        graph_nodes AS (
          SELECT root, id, "table", "column",
                 CASE WHEN id = root THEN 'root' WHEN up AND down THEN 'both'
                      WHEN up THEN 'upstream' ELSE 'downstream' END AS position
          FROM positions JOIN cnodes USING (id)),
        graph_edges AS (
          SELECT up.root, e.source, e.target FROM up JOIN cedges e ON e.target = up.node WHERE up.dist < 20
          UNION
          SELECT down.root, e.source, e.target FROM down JOIN cedges e ON e.source = down.node
          WHERE down.dist < 20),
        stats AS (
          SELECT root, count(*) AS node_count,
                 count(*) FILTER (WHERE position IN ('upstream', 'both')) AS upstream_node_count,
                 count(*) FILTER (WHERE position IN ('downstream', 'both')) AS downstream_node_count,
                 (SELECT count(*) FROM graph_edges g WHERE g.root = n.root) AS edge_count
          FROM graph_nodes n GROUP BY root)""",
    )


ONE_COLUMN = _column_sql(f"SELECT '{COLUMN}' AS root")
ALL_COLUMNS = _column_sql(f"SELECT id AS root FROM cnodes WHERE \"table\" = '{ROOT}'")


@query("g4_column_graph_nodes", ONE_COLUMN + ' SELECT id, "table", "column", position FROM graph_nodes')
def g4_nodes(t: Tables) -> DataFrame:
    found = lineage.lineage_of_column(inputs.column_edges(t), "stage.part.p2", "supply")
    return found.nodes.drop("root")


@query("g4_column_graph_edges", ONE_COLUMN + " SELECT source, target FROM graph_edges")
def g4_edges(t: Tables) -> DataFrame:
    found = lineage.lineage_of_column(inputs.column_edges(t), "stage.part.p2", "supply")
    return found.edges.drop("root")


@query(
    "g5_column_lineage_stats",
    ALL_COLUMNS
    + " SELECT root, node_count, upstream_node_count, downstream_node_count, edge_count FROM stats",
)
def g5(t: Tables) -> DataFrame:
    return lineage.lineage_of_table(inputs.column_edges(t), ROOT).stats


@query(
    "a6_column_lineage_totals",
    ALL_COLUMNS
    + """ SELECT count(*) AS root_column_count,
      count(*) FILTER (WHERE upstream_node_count > 0) AS columns_with_upstream,
      count(*) FILTER (WHERE downstream_node_count > 0) AS columns_with_downstream,
      sum(node_count)::BIGINT AS aggregate_node_count, sum(edge_count)::BIGINT AS aggregate_edge_count,
      (SELECT count(DISTINCT id) FROM graph_nodes) AS unique_node_count,
      (SELECT count(*) FROM (SELECT DISTINCT source, target FROM graph_edges)) AS unique_edge_count
    FROM stats""",
)
def a6(t: Tables) -> DataFrame:
    return lineage.lineage_of_table(inputs.column_edges(t), ROOT).totals


@query(
    "o3_column_lineage_union",
    ALL_COLUMNS + " SELECT DISTINCT source, target FROM graph_edges",
)
def o3(t: Tables) -> DataFrame:
    return lineage.lineage_of_table(inputs.column_edges(t), ROOT).edges.select("source", "target").distinct()


@query(
    "l6_table_columns",
    _with(inputs.COLUMN_LOG_SQL) + f""" SELECT DISTINCT "column" FROM cnodes WHERE "table" = '{ROOT}'""",
)
def l6(t: Tables) -> DataFrame:
    return lineage.table_columns(inputs.column_edges(t), ROOT)


# Shortest paths --------------------------------------------------------------------------

# Pairs to measure: each supplier against the parts that follow its own ones in an order.
PAIRS_SQL = """pairs AS (
  SELECT DISTINCT 'raw.supplier.s' || a.l_suppkey AS source, 'stage.part.p' || b.l_partkey AS target
  FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
)"""


DISTANCES_SQL = (
    _with(
        inputs.EDGES_SQL,
        PAIRS_SQL,
        _reach("hops", "edges", "SELECT DISTINCT source AS root, source AS node FROM pairs", "source", "target", 40),
    )
    + """ SELECT p.source, p.target, coalesce(min(h.dist), 5)::INTEGER AS distance
    FROM pairs p LEFT JOIN hops h ON h.root = p.source AND h.node = p.target GROUP BY p.source, p.target"""
)


@query("g10_lineage_distance", DISTANCES_SQL)
def g10(t: Tables) -> DataFrame:
    with inputs.graph(t) as graph:
        return paths.lineage_distances(graph, _distance_pairs(t))


def _distance_pairs(t: Tables) -> DataFrame:
    line = F.col("l_linenumber")
    own = t["lineitem"].select("l_orderkey", line, F.concat(F.lit("raw.supplier.s"), "l_suppkey").alias("source"))
    after = t["lineitem"].select(
        "l_orderkey", (line - 1).alias("l_linenumber"), F.concat(F.lit("stage.part.p"), "l_partkey").alias("target")
    )
    return own.join(after, ["l_orderkey", "l_linenumber"]).select("source", "target")


@query("g10_distances_by_closure", DISTANCES_SQL)
def g10_closure(t: Tables) -> DataFrame:
    return closure.distances_of_pairs(closure.closure(inputs.edges(t)), _distance_pairs(t))


@query("g10_distances_by_labels", DISTANCES_SQL)
def g10_labels(t: Tables) -> DataFrame:
    return labels.distances_by_labels(labels.hub_labels(inputs.edges(t)), _distance_pairs(t))


ALL_HOPS_SQL = """
  hops_all(root, node, dist) AS (
    SELECT source, target, 1 FROM {edges} UNION
    SELECT h.root, e.target, h.dist + 1 FROM hops_all h JOIN {edges} e ON e.source = h.node WHERE h.dist < 40
  ), hops AS (SELECT root, node, min(dist) AS dist FROM hops_all GROUP BY root, node)"""


FAMILIES_SQL = """ SELECT root, node AS member FROM hops UNION SELECT node, root FROM hops
    UNION SELECT source, source FROM flow UNION SELECT target, target FROM flow
    UNION SELECT a.target, b.target FROM flow a JOIN flow b ON a.source = b.source"""


@query("g6_families_of_all_tables", _with(inputs.FLOW_SQL, ALL_HOPS_SQL.format(edges="flow")) + FAMILIES_SQL)
def g6_all(t: Tables) -> DataFrame:
    return closure.families_of_all(closure.closure(inputs.flow_edges(t)))


@query("g6_families_by_labels", _with(inputs.FLOW_SQL, ALL_HOPS_SQL.format(edges="flow")) + FAMILIES_SQL)
def g6_labels(t: Tables) -> DataFrame:
    found = labels.hub_labels(inputs.flow_edges(t))
    return labels.families_by_labels(found, found.nodes.withColumnRenamed("node", "root"))


# Are the parts of two neighbouring lines of an order of one family?
RELATED_SQL = f""", families AS ({FAMILIES_SQL}),
asked AS (
  SELECT DISTINCT 'stage.part.p' || a.l_partkey AS root, 'stage.part.p' || b.l_partkey AS member
  FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
) SELECT root, member FROM asked JOIN families USING (root, member)"""


@query("g6_related_pairs", _with(inputs.FLOW_SQL, ALL_HOPS_SQL.format(edges="flow")) + RELATED_SQL)
def g6_related(t: Tables) -> DataFrame:
    part = F.concat(F.lit("stage.part.p"), "l_partkey")
    own = t["lineitem"].select("l_orderkey", "l_linenumber", part.alias("root"))
    after = t["lineitem"].select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), part.alias("member"))
    asked = own.join(after, ["l_orderkey", "l_linenumber"])
    return labels.related_pairs(labels.hub_labels(inputs.flow_edges(t)), asked)


@query(
    "g8_impact_of_all_tables",
    _with(inputs.EDGES_SQL, ALL_HOPS_SQL.format(edges="edges"))
    + """, sides AS (SELECT node AS "table", dist AS up, NULL::INTEGER AS down FROM hops
      UNION ALL SELECT root, NULL, dist FROM hops)
    SELECT "table", count(up) AS upstream_count, coalesce(max(up), 0)::INTEGER AS upstream_depth,
      count(down) AS downstream_count, coalesce(max(down), 0)::INTEGER AS downstream_depth FROM sides GROUP BY "table" """,
)
def g8_all(t: Tables) -> DataFrame:
    return closure.impact_of_all(closure.closure(inputs.edges(t)))


TARGETS = ["stage.part.p1", "stage.part.p6"]
TARGETS_SQL = 'targets("table") AS (VALUES ' + ", ".join(f"('{x}')" for x in TARGETS) + ")"
EXPANDED_SQL = """
  walked(root, node, dist, has_join) AS (
    SELECT "table", "table", 0, false FROM targets
    UNION
    SELECT w.root, f.source, w.dist + 1, w.has_join OR f.is_join
    FROM walked w JOIN flow f ON f.target = w.node WHERE w.dist < 2
  ),
  nearest AS (SELECT root, node, min(dist) AS dist FROM walked GROUP BY root, node),
  expanded AS (
    SELECT DISTINCT w.node AS "table" FROM walked w JOIN nearest n
      ON n.root = w.root AND n.node = w.node AND n.dist = w.dist
    WHERE w.dist = 0 OR w.has_join
  )"""


def _targets(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(x,) for x in TARGETS], "table string")


@query(
    "g11_join_priority_expansion",
    _with(inputs.FLOW_SQL, TARGETS_SQL, EXPANDED_SQL) + ' SELECT "table" FROM expanded',
)
def g11(t: Tables) -> DataFrame:
    with inputs.flow_graph(t) as graph:
        return paths.join_priority_expansion(graph, _targets(t))


def _chains_sql(roots: str, tables: str) -> str:
    """CTEs ``parents`` and ``chains``: least shortest undirected paths as joined text."""
    return f"""
  ring_all(root, node, dist) AS (
    SELECT root, root, 0 FROM ({roots})
    UNION
    SELECT r.root, f.there, r.dist + 1 FROM ring_all r JOIN flow_both f ON f.here = r.node
    WHERE r.dist < {FAR_ENOUGH}
  ),
  ring AS (SELECT root, node, min(dist) AS dist FROM ring_all GROUP BY root, node),
  parents AS (
    SELECT r.root, r.node, r.dist, min(n.node) AS parent
    FROM ring r JOIN flow_both f ON f.here = r.node
      JOIN ring n ON n.root = r.root AND n.node = f.there AND n.dist = r.dist - 1
    GROUP BY r.root, r.node, r.dist
  ),
  chain_rows(root, start, node, dist, chain) AS (
    SELECT root, node, node, dist, node FROM parents WHERE node IN (SELECT "table" FROM ({tables}))
    UNION ALL
    SELECT c.root, c.start, p.parent, c.dist - 1, c.chain || '>' || p.parent
    FROM chain_rows c JOIN parents p ON p.root = c.root AND p.node = c.node
  ),
  chains AS (SELECT root, start, chain FROM chain_rows WHERE dist = 0)"""


ALL_TABLES = 'SELECT source AS "table" FROM flow UNION SELECT target FROM flow'


def _chains(t: Tables) -> DataFrame:
    """Chains from every table to the two targets."""
    with inputs.flow_graph(t) as graph:
        roots = _targets(t).withColumnRenamed("table", "root")
        return paths.join_chains(graph, roots, graph.nodes().withColumnRenamed("node", "table"))


def _as_text(chains: DataFrame) -> DataFrame:
    return chains.withColumn("chain", F.array_join("chain", ">"))


CHAINS = _with(
    inputs.FLOW_SQL, TARGETS_SQL, _chains_sql('SELECT "table" AS root FROM targets', ALL_TABLES)
)


@query("g12_join_chains", CHAINS + " SELECT root, start, chain FROM chains")
def g12(t: Tables) -> DataFrame:
    return _as_text(_chains(t))


@query(
    "g13_relevant_tables",
    _with(
        inputs.FLOW_SQL,
        TARGETS_SQL,
        EXPANDED_SQL,
        _chains_sql('SELECT "table" AS root FROM targets', 'SELECT "table" FROM expanded'),
    )
    + """ SELECT DISTINCT node AS "table" FROM chain_rows""",
)
def g13(t: Tables) -> DataFrame:
    with inputs.flow_graph(t) as graph:
        return paths.relevant_tables(graph, _targets(t))


@query(
    "o4_redundant_chains",
    CHAINS
    + """, split AS (SELECT DISTINCT root, chain, string_split(chain, '>') AS nodes FROM chains)
    SELECT a.root, a.chain FROM split a WHERE NOT EXISTS (
      SELECT 1 FROM split b WHERE b.root = a.root AND len(a.nodes) < len(b.nodes)
        AND list_has_all(b.nodes, a.nodes))""",
)
def o4(t: Tables) -> DataFrame:
    return _as_text(paths.filter_redundant_chains(_chains(t)))


@query("o5_tables_of_chains", CHAINS + """ SELECT DISTINCT node AS "table" FROM chain_rows""")
def o5(t: Tables) -> DataFrame:
    return paths.tables_of_chains(paths.distinct_chains(_chains(t)))


# Layout ------------------------------------------------------------------------------------

REMOVED = ["stage.part.p4", "raw.supplier.s7"]


def _removed(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(x,) for x in REMOVED], "table string")


_NOT_REMOVED = "(" + ", ".join(f"'{x}'" for x in REMOVED) + ")"
LEVELS_UP = _with(
    inputs.EDGES_SQL,
    f"kept AS (SELECT * FROM edges WHERE source NOT IN {_NOT_REMOVED})",
    _reach("up", "kept", _root(ROOT), "target", "source", FAR_ENOUGH),
)


@query(
    "g14_levels_upstream",
    LEVELS_UP + """ SELECT node AS "table", ((SELECT max(dist) FROM up) - dist)::INTEGER AS level FROM up""",
)
def g14_up(t: Tables) -> DataFrame:
    with inputs.graph(t) as graph:
        return layout.levels(graph, ROOT, UPSTREAM, _removed(t))


@query(
    "g14_levels_downstream",
    _with(
        inputs.EDGES_SQL,
        f"kept AS (SELECT * FROM edges WHERE target NOT IN {_NOT_REMOVED})",
        _reach("down", "kept", _root(START), "source", "target", FAR_ENOUGH),
    )
    + """ SELECT node AS "table", dist::INTEGER AS level FROM down""",
)
def g14_down(t: Tables) -> DataFrame:
    with inputs.graph(t) as graph:
        return layout.levels(graph, START, DOWNSTREAM, _removed(t))


@query(
    "g15_level_columns",
    LEVELS_UP + """ SELECT ((SELECT max(dist) FROM up) - dist)::INTEGER AS level, node AS "table" FROM up""",
)
def g15(t: Tables) -> DataFrame:
    with inputs.graph(t) as graph:
        return layout.level_columns(layout.levels(graph, ROOT, UPSTREAM, _removed(t)))


@query(
    "g16_cascade_removals",
    _with(inputs.FLOW_SQL)
    + """, gone("table") AS (VALUES ('stage.part.p4'), ('stage.part.p12'), ('stage.part.p8'), ('stage.part.p5')),
    parents AS (SELECT DISTINCT source FROM flow WHERE target = 'stage.part.p8' AND source NOT IN (FROM gone))
    SELECT "table" FROM gone UNION SELECT source FROM parents
    WHERE NOT EXISTS (SELECT 1 FROM flow f WHERE f.source = parents.source AND f.target NOT IN (FROM gone))""",
)
def g16(t: Tables) -> DataFrame:
    removed = t.spark.createDataFrame(
        [(f"stage.part.p{k}",) for k in (4, 12, 5)], "table string"
    )
    return layout.cascade_removals(inputs.flow_edges(t), "stage.part.p8", removed)


ROLLUP = ALL_COLUMNS + f""", tables AS (SELECT DISTINCT "table" FROM graph_nodes),
  table_edges AS (
    SELECT DISTINCT s."table" AS source, d."table" AS target FROM graph_edges g
      JOIN cnodes s ON s.id = g.source JOIN cnodes d ON d.id = g.target WHERE s."table" <> d."table"),
  {_reach("above", "table_edges", _root(ROOT), "target", "source", FAR_ENOUGH)},
  free AS (SELECT * FROM table_edges WHERE target NOT IN (SELECT node FROM above)),
  {_reach("below", "free", _root(ROOT), "source", "target", FAR_ENOUGH)},
  shift AS (SELECT max(dist) AS s FROM above),
  placed AS (
    SELECT node AS "table", s - dist AS level FROM above, shift
    UNION ALL SELECT node, s + dist FROM below, shift WHERE dist > 0)"""


def _rollup(t: Tables):
    found = lineage.lineage_of_table(inputs.column_edges(t), ROOT)
    return layout.table_rollup(found.nodes, found.edges, ROOT)


@query("g17_rollup_table_edges", ROLLUP + " SELECT source, target FROM table_edges")
def g17_edges(t: Tables) -> DataFrame:
    return _rollup(t)[0]


@query("g17_rollup_columns", ROLLUP + ' SELECT DISTINCT "table", "column", id FROM graph_nodes')
def g17_columns(t: Tables) -> DataFrame:
    return _rollup(t)[1]


@query(
    "g17_rollup_levels",
    ROLLUP
    + """ SELECT "table", level::INTEGER AS level FROM placed UNION ALL
    SELECT "table", s::INTEGER FROM tables, shift WHERE "table" NOT IN (SELECT "table" FROM placed)""",
)
def g17_levels(t: Tables) -> DataFrame:
    return _rollup(t)[2]


@query(
    "g18_upstream_trust",
    _with(inputs.EDGES_SQL)
    + """, statuses AS (
      SELECT 'stage.part.p' || p_partkey AS "table",
             CASE WHEN p_size < 5 THEN 'critical' WHEN p_size < 20 THEN 'warning' ELSE 'healthy' END AS status
      FROM part)
    SELECT e.target AS "table", e.source AS parent, s.status FROM edges e JOIN statuses s ON s."table" = e.source
    WHERE s.status <> 'healthy'""",
)
def g18(t: Tables) -> DataFrame:
    size = F.col("p_size")
    statuses = t["part"].select(
        F.concat(F.lit("stage.part.p"), "p_partkey").alias("table"),
        F.when(size < 5, "critical").when(size < 20, "warning").otherwise("healthy").alias("status"),
    )
    return layout.upstream_trust(inputs.edges(t), statuses)
