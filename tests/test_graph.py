import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fixtures import CYCLE, SAMPLE, SELF_LOOP, TWO_PARTS, brute_distances, pairs
from tablescope.operators import graph as graph_module
from tablescope.operators import layout, lineage, paths
from tablescope.operators.graph import BOTH_WAYS, DOWNSTREAM, UPSTREAM, LineageGraph, one_root


def edges_of(spark, edges):
    if edges and len(edges[0]) == 3:
        return spark.createDataFrame(edges, "source string, target string, is_join boolean")
    return spark.createDataFrame(edges, "source string, target string")


def walked(graph, root, direction, depth=None):
    return {r.node: r.dist for r in graph.walk(one_root(graph, root), direction, depth).reached.collect()}


def random_edges(seed, nodes=14, count=30):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(count)]


@pytest.mark.parametrize("edges", [pairs(SAMPLE), CYCLE, SELF_LOOP, TWO_PARTS, random_edges(1)])
@pytest.mark.parametrize("direction", [UPSTREAM, BOTH_WAYS])
def test_walk_matches_breadth_first_search(spark, edges, direction):
    root = edges[0][0]
    with LineageGraph(edges_of(spark, edges)) as graph:
        assert walked(graph, root, direction) == brute_distances(edges, root, direction)


def test_unknown_root_and_empty_graph(spark):
    with LineageGraph(edges_of(spark, TWO_PARTS)) as graph:
        assert walked(graph, "nowhere", UPSTREAM) == {"nowhere": 0}
    with LineageGraph(edges_of(spark, [])) as graph:
        assert walked(graph, "nowhere", DOWNSTREAM) == {"nowhere": 0}


def test_null_and_duplicate_edges_are_dropped(spark):
    with LineageGraph(edges_of(spark, [("a", "b"), ("a", "b"), (None, "b"), ("a", None)])) as graph:
        assert rows(graph.edges) == [("a", "b")]


def test_split_hubs_change_nothing(spark):
    edges = [("hub", f"n{i}") for i in range(60)] + [(f"n{i}", f"m{i % 7}") for i in range(60)]
    with LineageGraph(edges_of(spark, edges), hub_edges=10) as graph:
        for direction in (UPSTREAM, DOWNSTREAM, BOTH_WAYS):
            for root in ("hub", "m3", "n5"):
                assert walked(graph, root, direction) == brute_distances(edges, root, direction)
        assert {r.here for r in graph.steps(DOWNSTREAM).hubs.collect()} == {"hub"}
        assert graph.steps(DOWNSTREAM).frame.select("salt").distinct().count() > 3


def test_many_roots_at_one_node_are_split(spark):
    edges = [(f"r{i}", "middle") for i in range(80)] + [("middle", f"m{i}") for i in range(5)] + [("m1", "r3")]
    roots = spark.createDataFrame([(f"r{i}",) for i in range(80)], "root string")
    with LineageGraph(edges_of(spark, edges), hub_edges=20) as graph:
        reached = graph.walk(roots, DOWNSTREAM).reached
        found = {}
        for r in reached.collect():
            found.setdefault(r.root, {})[r.node] = r.dist
        assert found == {f"r{i}": brute_distances(edges, f"r{i}", DOWNSTREAM) for i in range(80)}
        level = reached.filter("dist = 1").select("root", "node", "dist")
        plan = graph._advance(level, graph.steps(DOWNSTREAM), 80)
        assert "copy" in plan._jdf.queryExecution().analyzed().toString()


def test_visited_rows_are_not_shuffled_again(spark):
    chain = [(f"t{i}", f"t{i + 1}") for i in range(6)]
    table = graph_module._Reached(spark)
    table.add(spark.createDataFrame([("a", "b", 0), ("a", "c", 0)], "root string, node string, dist int"))
    new = spark.createDataFrame([("a", "c", 1), ("a", "d", 1)], "root string, node string, dist int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        grouped = new.groupBy("root", "node").agg(F.max("dist").alias("dist"))
        fresh = grouped.join(table.read().select("root", "node"), ["root", "node"], "left_anti")
        assert rows(fresh) == [("a", "d", 1)]
        plan = fresh._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        table.forget()
    with LineageGraph(edges_of(spark, chain)) as graph:
        assert walked(graph, "t0", DOWNSTREAM) == {f"t{i}": i for i in range(7)}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tablescope_walk")]


def test_deep_graph(spark):
    chain = [(f"t{i}", f"t{i + 1}") for i in range(9)]
    with LineageGraph(edges_of(spark, chain)) as graph:
        assert walked(graph, "t0", DOWNSTREAM) == {f"t{i}": i for i in range(10)}
        assert walked(graph, "t0", DOWNSTREAM, 4) == {f"t{i}": i for i in range(5)}


def test_up_and_down_mirror_each_other(spark):
    edges = random_edges(5)
    names = sorted({n for e in edges for n in e})
    roots = spark.createDataFrame([(n,) for n in names], "root string")
    with LineageGraph(edges_of(spark, edges)) as graph:
        up = {(r.root, r.node, r.dist) for r in graph.walk(roots, UPSTREAM).reached.collect()}
        down = {(r.node, r.root, r.dist) for r in graph.walk(roots, DOWNSTREAM).reached.collect()}
    assert up == down


def test_table_lineage_of_the_sample(spark):
    with LineageGraph(edges_of(spark, pairs(SAMPLE))) as graph:
        up = lineage.table_lineage(graph, "F", UPSTREAM)
        assert rows(up.nodes, "id", "downstream_count") == [
            ("D", 1), ("F", 0), ("M", 1), ("R", 4), ("R0", 1), ("S", 3),
        ]
        assert rows(up.edges, "source", "target", "is_join") == sorted(
            [(a, b, b in ("F", "D", "M")) for a, b in pairs(SAMPLE)], key=repr
        )
        down = lineage.table_lineage(graph, "M", DOWNSTREAM)
        assert rows(down.nodes, "id") == [("D",), ("F",), ("M",)]
        assert rows(down.edges, "source", "target", "is_join") == [("D", "F", True), ("M", "D", True)]
        alone = lineage.table_lineage(graph, "Z", UPSTREAM)
        assert rows(alone.nodes, "id", "downstream_count") == [("Z", 0)]
        assert rows(alone.edges) == []


def test_families_impact_and_bounded_lineage(spark):
    with LineageGraph(edges_of(spark, pairs(SAMPLE))) as graph:
        # Ancestors R, R0, S; descendants D, F; the children of R and S; itself.
        assert rows(lineage.family(graph, "M"), "table") == [("D",), ("F",), ("M",), ("R",), ("R0",), ("S",)]
        assert rows(lineage.descendants(graph, "S"), "table") == [("D",), ("F",), ("M",)]
        nodes, edges = lineage.bounded_lineage(graph, "M", 1)
        assert rows(nodes, "id") == [("D",), ("M",), ("R",), ("S",)]
        assert rows(edges, "source", "target") == [("M", "D"), ("R", "M"), ("S", "M")]
    with LineageGraph(edges_of(spark, CYCLE)) as graph:
        assert rows(lineage.descendants(graph, "a"), "table") == [("a",), ("b",), ("c",)]
        nodes, edges = lineage.bounded_lineage(graph, "a", 3)
        assert rows(edges, "source", "target") == [("a", "b"), ("b", "c"), ("c", "a")]


def test_neighbours_and_adjacency(spark):
    edges = edges_of(spark, pairs(SAMPLE))
    assert rows(lineage.neighbours(edges, "D", UPSTREAM)) == [("M",), ("R",), ("S",)]
    assert rows(lineage.neighbours(edges, "S", DOWNSTREAM)) == [("D",), ("F",), ("M",)]
    counts = {r.table: (r.upstream_count, r.downstream_count) for r in lineage.adjacency_counts(edges).collect()}
    assert counts["R"] == (1, 4) and counts["F"] == (3, 0) and counts["R0"] == (0, 1)
    assert lineage.adjacency(edges).count() == 20


COLUMN_EDGES = [("A", "x", "B", "y"), ("B", "y", "C", "z"), ("C", "z", "A", "x"), ("B", "w", "C", "z"), ("C", "z", "E", "q")]
COLUMN_SCHEMA = "source_table string, source_column string, target_table string, target_column string"


def test_column_lineage_on_a_cycle(spark):
    edges = spark.createDataFrame(COLUMN_EDGES, COLUMN_SCHEMA)
    found = lineage.lineage_of_column(edges, "A", "x")
    positions = {r.id: r.position for r in found.nodes.collect()}
    assert positions == {"A.x": "root", "B.y": "both", "C.z": "both", "B.w": "upstream", "E.q": "downstream"}
    assert found.edges.count() == 5
    stats = found.stats.first()
    assert (stats.node_count, stats.edge_count) == (5, 5)
    assert (stats.upstream_node_count, stats.downstream_node_count) == (3, 3)
    near = lineage.lineage_of_column(edges, "A", "x", max_depth=1)
    assert {r.id: r.position for r in near.nodes.collect()} == {"A.x": "root", "B.y": "downstream", "C.z": "upstream"}
    assert rows(near.edges, "source", "target") == [("A.x", "B.y"), ("C.z", "A.x")]


def test_column_lineage_of_table_and_unknown_column(spark):
    edges = spark.createDataFrame(COLUMN_EDGES, COLUMN_SCHEMA)
    totals = lineage.lineage_of_table(edges, "B").totals.first().asDict()
    assert totals == {
        "root_column_count": 2,
        "columns_with_upstream": 1,
        "columns_with_downstream": 2,
        "aggregate_node_count": 10,
        "aggregate_edge_count": 10,
        "unique_node_count": 5,
        "unique_edge_count": 5,
    }
    none = lineage.lineage_of_column(edges, "B", "nothing").stats.first()
    assert (none.node_count, none.edge_count, none.upstream_node_count, none.downstream_node_count) == (0, 0, 0, 0)
    assert lineage.lineage_of_table(edges, "Q").totals.first().root_column_count == 0
    assert rows(lineage.table_columns(edges, "B")) == [("w",), ("y",)]
    with pytest.raises(ValueError):
        lineage.lineage_of_column(edges, "A", "x", max_depth=0)


def test_column_lineage_has_no_depth_limit(spark):
    chain = [(f"t{i:02}", "c", f"t{i + 1:02}", "c") for i in range(52)]
    edges = spark.createDataFrame(chain, COLUMN_SCHEMA)
    assert lineage.lineage_of_column(edges, "t00", "c").stats.first().downstream_node_count == 52


def test_distances(spark):
    asked = [("R0", "F"), ("M", "F"), ("F", "R0"), ("F", "F"), ("Z", "Z"), ("Z", "F")]
    frame = spark.createDataFrame(asked, "source string, target string")
    with LineageGraph(edges_of(spark, pairs(SAMPLE))) as graph:
        found = {(r.source, r.target): r.distance for r in paths.lineage_distances(graph, frame).collect()}
    assert found == {
        ("R0", "F"): 2, ("M", "F"): 2, ("F", "R0"): 5, ("F", "F"): 0, ("Z", "Z"): 5, ("Z", "F"): 5,
    }


def test_join_priority_chains_and_relevant_tables(spark):
    targets = spark.createDataFrame([("F",)], "table string")
    with LineageGraph(edges_of(spark, SAMPLE)) as graph:
        expanded = paths.join_priority_expansion(graph, targets)
        assert rows(expanded) == [("D",), ("F",), ("M",), ("R",), ("R0",), ("S",)]
        assert rows(paths.join_priority_expansion(graph, targets, hops=1)) == [("D",), ("F",), ("R",), ("S",)]
        chains = paths.join_chains(graph, targets.withColumnRenamed("table", "root"), expanded)
        assert {r.start: r.chain for r in chains.collect()} == {
            "D": ["D", "F"], "S": ["S", "F"], "R": ["R", "F"], "M": ["M", "D", "F"], "R0": ["R0", "R", "F"],
        }
        kept = paths.filter_redundant_chains(chains)
        assert sorted(r.chain for r in kept.collect()) == [["M", "D", "F"], ["R0", "R", "F"], ["S", "F"]]
        assert rows(paths.tables_of_chains(paths.distinct_chains(kept))) == rows(expanded)
        assert rows(paths.relevant_tables(graph, targets)) == rows(expanded)
        stranger = spark.createDataFrame([("Z",)], "table string")
        assert rows(paths.relevant_tables(graph, stranger)) == []


@pytest.mark.parametrize("seed", range(3))
def test_join_chains_are_least_shortest_paths(spark, seed):
    edges = random_edges(10 + seed, nodes=10, count=14)
    step = {}
    for a, b in edges:
        step.setdefault(a, set()).add(b)
        step.setdefault(b, set()).add(a)
    root = edges[0][0]

    def all_shortest(start):
        found, ring = [], [[start]]
        seen = {start}
        while ring and not found:
            found = [p for p in ring if p[-1] == root]
            longer = [p + [n] for p in ring for n in step[p[-1]] if n not in seen]
            seen |= {p[-1] for p in longer}
            ring = longer
        return min(found) if found else None

    expected = {n: all_shortest(n) for n in step if n != root}
    with LineageGraph(edges_of(spark, edges)) as graph:
        chains = paths.join_chains(
            graph,
            spark.createDataFrame([(root,)], "root string"),
            graph.nodes().withColumnRenamed("node", "table"),
        )
        assert {r.start: r.chain for r in chains.collect()} == {n: p for n, p in expected.items() if p}
        some = [n for n in sorted(step)][:4]
        inside = {x for n in some if n != root and expected[n] for x in expected[n]}
        tables = spark.createDataFrame([(n,) for n in some], "table string")
        found = paths.chain_nodes(graph, spark.createDataFrame([(root,)], "root string"), tables)
        assert {r.table for r in found.collect()} == inside


@pytest.mark.parametrize("seed", range(2))
def test_redundant_chains_match_brute_force(spark, seed):
    rng = random.Random(seed)
    chains = [(k % 2, [f"n{rng.randrange(7)}" for _ in range(rng.randrange(1, 6))]) for k in range(40)]
    frame = spark.createDataFrame(chains, "root int, chain array<string>")
    kept = {(r.root, tuple(r.chain)) for r in paths.filter_redundant_chains(frame).collect()}
    expected = {
        (k, tuple(c))
        for k, c in chains
        if not any(k == j and len(c) < len(o) and set(c) <= set(o) for j, o in chains)
    }
    assert kept == expected


def test_opened_chains_are_never_broadcast(spark):
    # A file of chains is a fraction of the rows opened from it.
    chains = [("r", [f"n{i}" for i in range(k, 60)]) for k in range(40)] + [("r", ["n1", "n3"]), ("r", ["m", "n3"])]
    kept = paths.filter_redundant_chains(spark.createDataFrame(chains, "root string, chain array<string>"))
    assert sorted((r.chain for r in kept.collect()), key=len) == [["m", "n3"], [f"n{i}" for i in range(60)]]
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()


def test_levels_and_removals(spark):
    edges = edges_of(spark, pairs(SAMPLE))
    with LineageGraph(edges) as graph:
        up = {r.table: r.level for r in layout.levels(graph, "F", UPSTREAM).collect()}
        assert up == {"F": 2, "D": 1, "S": 1, "R": 1, "M": 0, "R0": 0}
        gone = spark.createDataFrame([("R",), ("D",)], "table string")
        assert {r.table: r.level for r in layout.levels(graph, "F", UPSTREAM, gone).collect()} == {"F": 1, "S": 0}
        down = layout.levels(graph, "R0", DOWNSTREAM)
        assert [(r.level, r.table) for r in layout.level_columns(down).collect()] == [
            (0, "R0"), (1, "R"), (2, "D"), (2, "F"), (2, "M"), (2, "S"),
        ]
    none = spark.createDataFrame([], "table string")
    # M is the only parent of D without another child.
    assert rows(layout.cascade_removals(edges, "D", none)) == [("D",), ("M",)]
    some = spark.createDataFrame([("F",), ("M",)], "table string")
    assert rows(layout.cascade_removals(edges, "D", some)) == [("D",), ("F",), ("M",), ("S",)]


def test_rollup_of_a_column_graph(spark):
    nodes = spark.createDataFrame(
        [("A.x", "A", "x"), ("A.y", "A", "y"), ("B.x", "B", "x"), ("C.x", "C", "x"), ("Z.x", "Z", "x")],
        "id string, table string, column string",
    )
    edges = spark.createDataFrame([("A.x", "B.x"), ("A.y", "B.x"), ("A.x", "A.y"), ("B.x", "C.x")], "source string, target string")
    table_edges, columns, levels = layout.table_rollup(nodes, edges, "B")
    assert rows(table_edges) == [("A", "B"), ("B", "C")]
    assert {r.table: r.level for r in levels.collect()} == {"A": 0, "B": 1, "C": 2, "Z": 1}
    assert [(r.table, r.column) for r in columns.collect()][:2] == [("A", "x"), ("A", "y")]


def test_upstream_trust(spark):
    states = spark.createDataFrame([("R", "critical"), ("S", "healthy"), ("M", "warning")], "table string, status string")
    found = layout.upstream_trust(edges_of(spark, pairs(SAMPLE)), states)
    assert ("D", "R", "critical") in rows(found) and ("D", "M", "warning") in rows(found)
    assert not [r for r in rows(found) if r[1] == "S"]


def test_small_levels_are_not_compared_with_all_that_was_reached(spark, monkeypatch):
    """A bush with a long tail that leads back: the tail's levels are compared at depths that double."""
    edges = [("r", f"b{i}") for i in range(200)] + [("b0", "t0")] + [(f"t{i}", f"t{i + 1}") for i in range(11)]
    edges += [("t11", "r"), ("t5", "t4"), ("t7", "b3")]
    reads = []
    read = graph_module._Reached.read
    monkeypatch.setattr(graph_module._Reached, "read", lambda self: reads.append(1) or read(self))
    with LineageGraph(edges_of(spark, edges)) as graph:
        walk = graph.walk(one_root(graph, "r"), DOWNSTREAM)
    found = walk.reached.collect()
    assert {r.node: r.dist for r in found} == brute_distances(edges, "r", DOWNSTREAM) and len(found) == 213
    assert walk.depth == 13
    # Each level reads its frontier; those that double and the ones after the bush read all as well.
    assert len(reads) <= 16 + 8


def test_distances_walk_by_number_and_end_on_cycles(spark, monkeypatch):
    edges = random_edges(9, 30, 60)
    names = sorted({n for e in edges for n in e} | {"nowhere"})
    asked = spark.createDataFrame([(a, b) for a in names for b in names] + [(None, "n1"), ("n1", None)], "source string, target string")
    kinds = []
    walk = LineageGraph.walk
    monkeypatch.setattr(
        LineageGraph, "walk", lambda self, roots, *a, **k: kinds.append(roots.schema["root"].dataType.simpleString()) or walk(self, roots, *a, **k)
    )
    with LineageGraph(edges_of(spark, edges)) as graph:
        found = {(r.source, r.target): r.distance for r in paths.lineage_distances(graph, asked).collect()}
    assert kinds == ["bigint"]
    for a in names[:-1]:
        near = brute_distances(edges, a, DOWNSTREAM)
        known = {n: near.get(n, paths.FAR) for n in names}
        assert {b: found[a, b] for b in names} == known
    assert found["nowhere", "nowhere"] == found[None, "n1"] == found["n1", None] == paths.FAR


def test_edges_stay_where_a_walk_has_put_them(spark):
    chain = [(f"t{i}", f"t{i + 1}") for i in range(6)]
    with LineageGraph(edges_of(spark, chain)) as graph:
        up = graph.walk(one_root(graph, "t6"), UPSTREAM).reached
        down = graph.walk(one_root(graph, "t6"), DOWNSTREAM)
        # Nothing leads on from there, so no copy of the edges was made for it.
        assert rows(down.reached, "node") == [("t6",)] and set(graph._steps) == {UPSTREAM}
        met = graph.edges_of(up, UPSTREAM)
        assert rows(met, "root", "source", "target") == [("t6", a, b) for a, b in chain]
        assert "InMemoryTableScan" in met._jdf.queryExecution().executedPlan().toString()


def test_an_edge_of_a_cycle_is_listed_once(spark):
    edges = CYCLE + [("x", "a"), ("b", "y")]
    with LineageGraph(edges_of(spark, edges)) as graph:
        roots = spark.createDataFrame([("a",), ("x",), ("y",)], "root string")
        up, down = graph.walk(roots, UPSTREAM).reached, graph.walk(roots, DOWNSTREAM).reached
        found = rows(lineage._path_edges(graph, up, down, None))
    whole = sorted(edges)
    assert found == sorted([("a", *e) for e in whole] + [("x", *e) for e in whole] + [("y", *e) for e in whole])
