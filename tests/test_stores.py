import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablescope import workspace
from tablescope.operators import catalog, upsert
from tablescope.operators.profile import columns_of
from tablescope.plans import stores
from tablescope.plans.registry import Tables
from tablescope.sources import catalog as catalog_source
from tablescope.sources import lineage as lineage_source
from tablescope.streaming.ingest import EdgeLog, ingest_edges
from tablescope.streaming.keyed import KeyedEdgeLog


def test_upsert_inserts_overwrites_and_keeps(spark):
    current = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, owner string, n int")
    updates = spark.createDataFrame([(2, 5, 1), (2, None, 2), (3, 7, 1), (4, 1, 1), (4, 2, 1)], "id int, n int, version int")
    merged = upsert.upsert(current, updates, ["id"], "version")
    expected = [(1, "a", 10), (2, "b", None), (3, None, 7), (4, None, 2)]
    assert merged.columns == ["id", "owner", "n"] and rows(merged) == expected
    assert rows(upsert.upsert(merged, updates, ["id"], "version")) == expected
    assert rows(upsert.upsert(None, updates, ["id"], "version")) == [(2, None), (3, 7), (4, 2)]
    wider = upsert.upsert(current, spark.createDataFrame([(1, 0.5)], "id int, score double"), ["id"])
    assert rows(wider) == [(1, "a", 10, 0.5), (2, "b", 20, None)]


def test_edges_and_nodes(spark):
    old = spark.createDataFrame([("a", "b")], "source string, target string")
    new = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "c"), (None, "c")], "source string, target string")
    merged = upsert.merge_edges(old, new)
    assert rows(merged) == [("a", "b"), ("b", "c")] == rows(upsert.merge_edges(merged, new))
    tables = spark.createDataFrame([("a", 5)], "full_name string, row_count int")
    assert rows(upsert.upsert_lineage_tables(tables, merged)) == [("a", 5), ("b", None), ("c", None)]
    assert rows(upsert.duplicate_keys(new.dropna(), ["source"])) == [("b", 2)]


def test_versions_never_overwrite_what_is_read(spark, tmp_path):
    store = upsert.VersionedTable(spark, str(tmp_path / "store"))
    assert store.read() is None
    assert store.write(spark.range(2)) == 1
    assert store.write(store.read().union(store.read())) == 2
    assert store.read().count() == 4 and store.read(1).count() == 2
    # A write that broke off has no _SUCCESS: readers skip it, writers go past it.
    os.makedirs(tmp_path / "store" / "version=3")
    assert store.read().count() == 4 and store.write(spark.range(1)) == 4


def test_edge_log_is_idempotent(spark, tmp_path):
    log = EdgeLog(spark, str(tmp_path / "log"), "source string, target string")
    assert rows(log.edges()) == []
    first = spark.createDataFrame([("a", "b"), ("a", "b"), (None, "x")], "source string, target string")
    second = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    log.add(first, 0)
    for _ in range(2):
        log.add(second, 1)
        assert rows(log.edges()) == [("a", "b"), ("b", "c")]
    assert rows(log.read(), "source", "target", "batch") == [("a", "b", 0), ("b", "c", 1)]
    log.add(second, 2)
    assert rows(log.edges()) == [("a", "b"), ("b", "c")]


def test_stream_of_files(spark, tmp_path):
    source, schema = tmp_path / "in", "source_table_full_name string, target_table_full_name string"

    def arrive(data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(source))

    log = EdgeLog(spark, str(tmp_path / "log"), "source string, target string")

    def ingest():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        ingest_edges(stream, log, str(tmp_path / "state"), lineage_source.table_lineage).awaitTermination()

    arrive([("a", "b"), ("a", None)])
    arrive([("a", "b"), ("b", "c")])
    ingest()
    assert rows(log.edges()) == [("a", "b"), ("b", "c")]
    arrive([("c", "d"), ("b", "c")])
    ingest()
    assert rows(log.edges()) == [("a", "b"), ("b", "c"), ("c", "d")]
    assert {r.batch for r in log.read().collect()} == {0, 1, 2} or len({r.batch for r in log.read().collect()}) >= 2
    # Another checkpoint numbers its batches anew and must not replace the first one's.
    arrive([("d", "e")])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    ingest_edges(stream, log, str(tmp_path / "other"), lineage_source.table_lineage).awaitTermination()
    assert rows(log.edges()) == [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")]
    assert log.read().select("run").distinct().count() == 2


def test_graph_files(spark, tmp_path):
    document = {"root": "b", "direction": "upstream", "nodes": [{"id": "z", "downstream_count": 0, "downstream_tables": []}],
                "edges": [{"source": "a", "target": "b", "is_join": True}, {"source": "c", "target": "b"}]}
    (tmp_path / "g.json").write_text(json.dumps(document, indent=1))
    graphs = lineage_source.read_graphs(spark, str(tmp_path))
    assert rows(lineage_source.graph_edges(graphs)) == [("a", "b", True), ("c", "b", False)]
    assert rows(lineage_source.graph_nodes(graphs)) == [("a",), ("b",), ("c",), ("z",)]
    log = spark.createDataFrame([("t", "x", "u", "y"), ("t", None, "u", "y"), ("t", "x", "u", "y")],
                                "source_table_full_name string, source_column_name string, target_table_full_name string, target_column_name string")
    assert rows(lineage_source.column_lineage(log)) == [("t", "x", "u", "y")]


def info(spark):
    tables = spark.createDataFrame(
        [("l", "s", "t1", "MANAGED", None, "delta", None), ("l", "s", "t2", "VIEW", "two", None, None),
         ("l", "information_schema", "x", None, None, None, None), ("system", "s", "x", None, None, None, None),
         ("m", "", "t", None, None, None, None), ("m", "S_9", "odd", None, None, None, None)],
        catalog_source.TABLE_SCHEMA,
    )
    columns = spark.createDataFrame(
        [("l", "s", "t1", "b", 2, "int", "NO", None), ("l", "s", "t1", "a", 1, "string", "YES", "c"),
         ("l", "s", "t1", "", 3, "int", "NO", None), ("l", "s", "t1", "z", None, "int", "MAYBE", None)],
        "catalog_name string, schema_name string, table_name string, column_name string, ordinal_position int,"
        " data_type string, is_nullable string, comment string",
    )
    return tables, columns


def test_catalog_snapshot(spark, tmp_path):
    tables, columns = info(spark)
    snapshot = catalog_source.refresh_snapshot(tables, columns, str(tmp_path / "snap"))
    assert rows(snapshot, "full_name", "column_name", "is_nullable") == [
        ("l.s.t1", "a", True), ("l.s.t1", "b", False), ("l.s.t1", "z", None), ("l.s.t2", None, None), ("m.S_9.odd", None, None),
    ]
    stats = catalog.snapshot_stats(snapshot).first()
    assert tuple(stats) == (2, 2, 3, 3)
    assert rows(catalog.snapshot_by_schema(snapshot)) == [("l", "s", 2, 3), ("m", "S_9", 1, 0)]
    with pytest.raises(FileNotFoundError):
        catalog_source.load_snapshot(spark, str(tmp_path / "none"))


def test_catalog_lookups(spark):
    tables, columns = info(spark)
    schemata = spark.createDataFrame([("l", "s", "me")], "catalog_name string, schema_name string, schema_owner string")
    found = catalog.schema_metadata(schemata, tables, "l", "s")
    assert [(r.table_name, r.table_count) for r in found.collect()] == [("t1", 2), ("t2", 2)]
    found = catalog.table_metadata(tables, columns, "l", "s", "t1")
    assert [r.column_name for r in found.collect()] == ["z", "a", "b", ""]
    bare = catalog.table_metadata(tables, columns, "l", "s", "t2").collect()
    assert [(r.column_count, r.column_name) for r in bare] == [(0, None)]
    with pytest.raises(catalog.EntityNotFound):
        catalog.table_metadata(tables, columns, "l", "s", "t9")


def test_search_hierarchy_and_tree(spark):
    named = spark.createDataFrame(
        [("l.s.Orders", None), ("orders.s.x", None), (None, "l.s.reorders"), ("two.parts", None), ("a.b.c.orders", None),
         ("l.s.Orders", None), ("l..orders", None)],
        "full_name string, name string",
    )
    assert [r.table for r in catalog.search_tables(named, " ORDERS ").collect()] == ["orders.s.x", "l..orders", "l.s.Orders", "l.s.reorders"]
    assert [r.table for r in catalog.search_tables(named, "orders", limit=1).collect()] == ["orders.s.x"]
    assert catalog.search_tables(named, "  ").count() == 0
    assert [r.full_name for r in catalog.name_hierarchy(named).collect()] == ["l.s.Orders", "l.s.reorders", "orders.s.x"]
    tables = info(spark)[0].withColumn("full_name", F.concat_ws(".", "catalog_name", "schema_name", "table_name"))
    assert rows(catalog.matching_tables(tables, "s_9"), "full_name") == [("m.S_9.odd",)]
    assert rows(catalog.matching_tables(tables, "L.S"), "full_name") == [("l.s.t1",), ("l.s.t2",)]
    assert catalog.matching_tables(tables, " ").count() == 0
    assert rows(catalog.matching_schemas(tables, "t1")) == [("l", "s", 1)]


def test_columns_of_frames(spark):
    found = columns_of({"a.b.c.d": spark.createDataFrame([], "x int, y array<int>")})
    assert rows(found, "table_name", "column_name", "ordinal_position", "data_type") == [
        ("c.d", "x", 1, "INTEGER"), ("c.d", "y", 2, "ARRAY<INT>"),
    ]


def test_shared_folder_comes_from_the_session(spark):
    assert workspace.shared_folder(spark) == workspace.shared_folder(spark)
    path = workspace.new_path(spark, "x")
    assert path != workspace.new_path(spark, "x")
    kept = workspace.written(spark.range(3), "numbers")
    assert kept.count() == 3 and "Parquet" in kept._jdf.queryExecution().toString()


def test_line_items_arrive_as_a_file_per_task_and_lot(spark, tmp_path):
    """Tasks deal what they read, so no file and no task of the stream grows with all line items."""
    t = Tables(spark, "/root/testdata/sf0.001")
    items, folder = t["lineitem"].repartition(5), str(tmp_path / "items")
    first = stores._arrived(t, items.filter("l_linenumber < 4"), folder, 2)
    second = stores._arrived(t, items.filter("l_linenumber >= 4"), folder, 2)
    assert (first, second) == (5, 5)
    arrived = spark.read.parquet(folder)
    assert len(arrived.inputFiles()) == 20 and arrived.drop("lot").exceptAll(t["lineitem"]).isEmpty()
    assert arrived.count() == t["lineitem"].count()
    log = KeyedEdgeLog(spark, str(tmp_path / "log"), "l_suppkey bigint, l_partkey bigint")
    query = log.ingest(stores._stream_of(t, folder, 5).select("l_suppkey", "l_partkey"))
    query.awaitTermination()
    assert [p["numInputRows"] > 0 for p in query.recentProgress].count(True) == 4
    assert log.edges().count() == t["lineitem"].select("l_suppkey", "l_partkey").distinct().count()
