import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablescope.operators import keys, profile, star, upsert
from tablescope.operators.graph import LineageGraph
from tablescope.operators.lineage import families
from tablescope.plans import inputs

DIM, OTHER, FACT = "l.s.dim", "l.s.other", "l.s.fact"


@pytest.fixture(scope="module")
def lake(spark):
    dim = spark.createDataFrame([(i, f"n{i}") for i in range(40)], "d_custkey bigint, d_name string")
    other = spark.createDataFrame([(i,) for i in range(5, 45)], "e_custkey bigint")
    fact = spark.createDataFrame(
        [(i, i % 40, None if i == 7 else i % 30, float(i)) for i in range(120)],
        "f_id bigint, f_custkey bigint, g_custkey bigint, amount double",
    )
    tables = {DIM: dim, OTHER: other, FACT: fact}
    edges = spark.createDataFrame([(DIM, FACT), (OTHER, FACT)], "source string, target string")
    with LineageGraph(edges) as graph:
        found = families(graph, spark.createDataFrame([(t,) for t in tables], "root string"))
    return tables, profile.data_profile(tables), found


def test_primary_key_limits(spark):
    ratios = [("a", 0.95, 0.0), ("b", 0.96, 0.05), ("c", 0.951, 0.049), ("d", 1.0, None), ("e", None, 0.0)]
    frame = spark.createDataFrame(ratios, "column_name string, uniqueness_ratio double, null_ratio double")
    assert rows(keys.detect_primary_keys(frame), "column_name") == [("c",)]


def test_foreign_keys(lake):
    tables, prof, found = lake
    assert rows(keys.detect_primary_keys(prof), "full_name", "column_name") == [
        (DIM, "d_custkey"), (DIM, "d_name"), (FACT, "amount"), (FACT, "f_id"), (OTHER, "e_custkey"),
    ]
    candidates = keys.fk_candidates(prof, keys.detect_primary_keys(prof), found).cache()
    pairs = rows(candidates, "target_table", "fk_column", "dimension_table", "pk_column")
    assert (FACT, "f_custkey", DIM, "d_custkey") in pairs and (FACT, "g_custkey", OTHER, "e_custkey") in pairs
    assert not [p for p in pairs if p[0] == p[2]]
    names = rows(keys.contained(candidates, tables), "target_table", "fk_column", "dimension_table", "pk_column")
    assert (FACT, "f_custkey", DIM, "d_custkey") in names
    # A null among the values counts as unmatched.
    assert not [p for p in names if p[1] == "g_custkey"]
    assert (FACT, "f_custkey", OTHER, "e_custkey") not in names


def relations(spark):
    data = [(f"{FACT}.f_custkey", f"{DIM}.d_custkey", 0.9), (f"{FACT}.g_custkey", f"{DIM}.d_custkey", 0.5),
            (f"{FACT}.f_custkey", f"{OTHER}.e_custkey", 0.6), (f"{FACT}.gone", f"{DIM}.d_custkey", 0.9)]
    return spark.createDataFrame(data, "fk string, pk string, confidence double")


def columns(spark, lake):
    return upsert.column_nodes(lake[1], upsert.table_nodes(lake[1]))


def test_scores(spark, lake):
    owned = columns(spark, lake)
    edges = spark.createDataFrame([(DIM, "l.s.mid"), ("l.s.mid", FACT)], "source string, target string")
    with LineageGraph(edges) as graph:
        scores = {(r.fk, r.pk): r for r in keys.score_foreign_keys(relations(spark), owned, graph).collect()}
    near = scores[f"{FACT}.f_custkey", f"{DIM}.d_custkey"]
    assert near.naming_score == pytest.approx(16 / 17) and near.lineage_score == 0.1
    assert near.confidence == pytest.approx(0.8 + 0.2 * 16 / 17)
    assert scores[f"{FACT}.f_custkey", f"{OTHER}.e_custkey"].lineage_score == 0.0
    assert len(scores) == 3
    plain = keys.score_foreign_keys(relations(spark), owned)
    assert {r.lineage_score for r in plain.collect()} == {0.0}
    full = spark.createDataFrame([(f"{FACT}.f_id", f"{FACT}.f_id")], "fk string, pk string")
    with LineageGraph(edges) as graph:
        assert keys.score_foreign_keys(full, owned, graph).first().confidence == 0.99


def test_classification(spark, lake):
    _, prof, _ = lake
    classes = {r.full_name: r for r in keys.classify_tables(prof, relations(spark), columns(spark, lake)).collect()}
    fact = classes[FACT]
    # Two relations are confident, both from one column.
    assert (fact.fk_columns, fact.dim_connections, fact.numeric_columns) == (1, 2, 4)
    assert fact.fact_score == pytest.approx(0.5 + 0.6 + 0.2 * 4 / 2)
    # Scores 1.5, 0.2 and 0.1414: the middle one is the median, and a tie is DIM.
    assert {t: r.table_type for t, r in classes.items()} == {FACT: "FACT", DIM: "DIM", OTHER: "DIM"}


def test_even_median_is_the_mean_of_two(spark):
    frame = spark.createDataFrame([(1.0,), (4.0,), (2.0,), (9.0,), (None,)], "x double")
    assert keys.median_of(frame, "x") == 3.0
    assert keys.median_of(frame.filter("x > 99"), "x") is None


def test_numeric_types(spark):
    names = ["bigint", "LONG", "int", "decimal(9,2)", "float", "string", "interval day", "date", "DOUBLE", None]
    frame = spark.createDataFrame([("t", f"c{i}", n) for i, n in enumerate(names)], "full_name string, column_name string, data_type string")
    row = keys.numeric_density(frame).first()
    assert (row.numeric_columns, row.total_columns) == (6, 10)


def test_star(spark, lake):
    held = relations(spark), columns(spark, lake)
    links = star.fact_dimensions(*held)
    types = spark.createDataFrame([(FACT, "FACT"), (DIM, "DIM"), (OTHER, None)], "full_name string, table_type string")
    assert rows(links, "dimension", "fact_column", "confidence") == [
        (DIM, "f_custkey", 0.9), (DIM, "g_custkey", 0.5), (OTHER, "f_custkey", 0.6),
    ]
    assert rows(star.star_tables(*held, types, FACT), "dimension", "fact_column") == [
        (DIM, "f_custkey"), (DIM, "g_custkey"), (OTHER, "f_custkey"),
    ]
    around = star.star_tables(*held, types, DIM)
    assert rows(around, "dimension", "fact_column") == [
        (DIM, "f_custkey"), (DIM, "g_custkey"), (FACT, None), (OTHER, "f_custkey"),
    ]
    assert rows(star.star_tables(*held, types, OTHER)) == [] and star.table_type(types, "x.y.z") == "TABLE"
    assert rows(star.star_table_names(*held, types, DIM)) == [(DIM,), (FACT,), (OTHER,)]
    edges = spark.createDataFrame([(DIM, FACT), (FACT, "l.s.report")], "source string, target string")
    with LineageGraph(edges) as graph:
        report = star.table_report(graph, *held, types, DIM, depth=1)
    assert rows(report.nodes) == [(DIM, "DIM"), (FACT, "FACT")] and rows(report.edges) == [(DIM, FACT)]
    assert rows(report.downstream_impact) == [(FACT,), ("l.s.report",)] and report.table_type == "DIM"
    assert star.report_rows(report).count() == 2 + 1 + 4 + 2


def test_write_backs(spark, lake):
    _, prof, _ = lake
    owned = columns(spark, lake)
    at = F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp_ntz")
    marked = upsert.write_back_keys(owned, keys.detect_primary_keys(prof), at)
    again = upsert.write_back_keys(marked, keys.detect_primary_keys(prof), at)
    assert rows(marked) == rows(again)
    assert rows(again.filter("is_primary_key"), "id", "pk_source")[0] == (f"{DIM}.d_custkey", "rule_based")
    found = spark.createDataFrame(
        [(FACT, "f_custkey", DIM, "d_custkey"), (FACT, "nope", DIM, "d_custkey")],
        "target_table string, fk_column string, dimension_table string, pk_column string",
    )
    stored = upsert.upsert_relations(relations(spark), found, owned, at)
    by_pair = {(r.fk, r.pk): r for r in stored.collect()}
    assert by_pair[f"{FACT}.f_custkey", f"{DIM}.d_custkey"].confidence == 0.8
    assert by_pair[f"{FACT}.g_custkey", f"{DIM}.d_custkey"].confidence == 0.5 and len(by_pair) == 4
    scored = upsert.write_back_scores(stored, keys.score_foreign_keys(relations(spark), owned))
    by_pair = {(r.fk, r.pk): r for r in scored.collect()}
    assert by_pair[f"{FACT}.gone", f"{DIM}.d_custkey"].naming_score is None
    assert by_pair[f"{FACT}.f_custkey", f"{DIM}.d_custkey"].semantic_score == 0.2
    classified = keys.classify_tables(prof, relations(spark), owned)
    typed = upsert.write_back_types(upsert.table_nodes(prof), classified)
    assert rows(typed, "full_name", "table_type", "row_count") == [(DIM, "DIM", 40), (FACT, "FACT", 120), (OTHER, "DIM", 40)]


def test_connectivity_moves_no_row_twice(spark):
    """Foreign keys and dimensions are both counted exactly, without a copy of the rows for each count."""
    found = [("f.a", "d.x", 0.9), ("f.a", "d.x", 0.7), ("f.a", "e.x", 0.9), ("f.b", "d.y", 0.9), ("g.a", "n.x", 0.9)]
    relations = spark.createDataFrame([*found, ("g.b", "d.x", 0.5)], "fk string, pk string, confidence double")
    owners = [(i, i[0]) for i in ("f.a", "f.b", "g.a", "g.b", "d.x", "d.y", "e.x")] + [("n.x", None)]
    counted = keys.fk_connectivity(relations, spark.createDataFrame(owners, "id string, full_name string"))
    assert rows(counted, "full_name", "fk_columns", "dim_connections") == [("f", 2, 2), ("g", 1, 0)]
    assert "Expand" not in counted._jdf.queryExecution().toString()


def test_star_of_a_table_joins_its_own_columns_only(spark, monkeypatch):
    kept = {}

    def written(df, label, **_):
        kept[label] = max(kept.get(label, 0), df.count())
        return df

    monkeypatch.setattr(star, "written", written)
    many = [(f"f{i}.a", f"d{i}.k", 0.9) for i in range(200)]
    relations = spark.createDataFrame(many, "fk string, pk string, confidence double")
    columns = spark.createDataFrame([(c, c.split(".")[0]) for r in many for c in r[:2]], "id string, full_name string")
    types = [(f"{kind}{i}", name) for i in range(200) for kind, name in (("f", "FACT"), ("d", "DIM"))]
    types = spark.createDataFrame(types, "full_name string, table_type string")
    assert rows(star.star_tables(relations, columns, types, "d7"), "dimension", "fact_column") == [("d7", "a"), ("f7", None)]
    assert rows(star.star_tables(relations, columns, types, "f7"), "dimension", "fact_column") == [("d7", "a")]
    assert kept["star-owners"] == 2


def test_relations_are_merged_by_number(spark):
    """The same rows as by name: a line without its order or number has no foreign key, whatever the other is."""
    lines = [(1, 1, 5, 9, 0.1, 0.0), (1, 1, 5, 9, 0.2, 0.0), (1, 1, 6, 9, 0.1, 0.2), (11, 1, 5, 9, 0.1, 0.0)]
    lines += [(None, 1, 5, 9, 0.1, 0.0), (None, 2, 5, 9, 0.3, None), (3, None, 5, 9, 0.2, 0.0), (2, 1, None, 8, None, 0.0)]
    lines += [(2, 1, None, 8, 0.4, 0.0)]
    schema = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_discount double, l_tax double"
    tables = {"lineitem": spark.createDataFrame(lines, schema)}
    best = {}
    for order, number, part, supplier, discount, tax in lines:
        for kind, name, key, score in (
            ("part", "p{}.partkey", part, None if discount is None else 0.5 + discount * 4),
            ("supp", "s{}.suppkey", supplier, None if tax is None else 0.45 + tax * 4),
        ):
            fk = None if None in (order, number) else f"mart.fact.o{order}.{kind}_{number}"
            pk = None if key is None else "mart.dim." + name.format(key)
            best.setdefault((fk, pk), []).append(score)
    expected = [(*k, max((round(s, 4) for s in v if s is not None), default=None)) for k, v in best.items()]
    merged = inputs.relations(tables)
    assert rows(merged, "fk", "pk", "confidence") == sorted(expected, key=repr)
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [l_orderkey" in plan
    kept, columns = inputs.relations_and_columns(type("T", (dict,), {})(tables))
    ids = {i for r in expected for i in r[:2] if i is not None}
    assert rows(columns, "id", "full_name") == sorted(((i, i.rsplit(".", 1)[0]) for i in ids), key=repr)


def test_pairs_of_a_frequent_pair_of_names_stay_where_they_are(spark, lake):
    """Whether names count as frequent changes no row, and frequent ones move no pairs to one task."""
    _, prof, found = lake
    marked = keys.detect_primary_keys(prof)
    few, usual = (keys.fk_candidates(prof, marked, found, n) for n in (0, 1_000_000))
    assert rows(few, *sorted(few.columns)) == rows(usual, *sorted(few.columns)) != []
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_facts_meet_pairs_and_not_all_columns(spark, table, tmp_path):
    relations = [(f"f{i}.a", f"d{i % 3}.k", 0.5) for i in range(9)] + [("f0.b", "d0.k", 0.6), ("nowhere.a", "d0.k", 0.6)]
    columns = [(f"f{i}.{c}", f"f{i}") for i in range(9) for c in "ab"] + [(f"d{i}.k", f"d{i}") for i in range(3)]
    types = [(f"f{i}", "FACT" if i % 2 else None) for i in range(9)] + [("f1", "FACT"), ("d0", "DIM")]
    frames = {
        "relations": spark.createDataFrame(relations, "fk string, pk string, confidence double"),
        "columns": spark.createDataFrame(columns + [("f1.c", None)], "id string, full_name string"),
        "types": spark.createDataFrame(types, "full_name string, table_type string"),
    }
    for name, frame in frames.items():
        frame.write.parquet(f"{tmp_path}/{name}")
    stored = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in frames}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = star.related_facts(star.fact_dimensions(stored["relations"], stored["columns"]), stored["types"])
        assert table(found, "dimension", "fact") == [(f"d{i % 3}", f"f{i}") for i in sorted((1, 3, 5, 7), key=lambda i: (i % 3, i))]
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The facts come after the joins with the owners, and the distinct rows need no shuffle of their own.
    assert "LeftSemi" not in plan and "hashpartitioning(dimension" not in plan
