import datetime
import json

import pytest

from conftest import rows
from tablescope.operators import quality
from tablescope.operators.quality import EPOCH_MS, YYYYMMDD, LowerBound, RuleConfig
from tablescope.sources.documentation import documentation_records, read_documents
from pyspark.sql import functions as F

AS_OF = datetime.date(2024, 3, 10)
NAN = float("nan")


CONFIG = RuleConfig(
    max_length={"MARKET_NAME": 100},
    ranges={
        "MARKET_ID": LowerBound("<", 0),
        "PRODUCT_ID": LowerBound("<=", 0, null_fails=True),
        "WAC_DOLLARS": LowerBound("<", 0, nan_fails=True),
    },
    zero_columns=frozenset({"WAC_DOLLARS"}),
    coded_dates={"MONTH_ENDING_DATE": YYYYMMDD},
    fresh_days={"STAGED_FILE_DATE": 7},
)


def violations(df, selections, config=CONFIG):
    found = quality.run_checks(df, selections, AS_OF, config).collect()
    return {(r.rule, r.column_name): r.violations if r.violations is not None else r.status for r in found}


def test_row_rules(spark):
    day = datetime.date
    df = spark.createDataFrame(
        [
            ("", 0.0, "20240310", day(2024, 3, 10), day(2024, 3, 3), -1, 0),
            ("  ", -1.0, "20240311", day(2024, 3, 11), day(2024, 3, 2), 0, None),
            ("\t", NAN, "20241350", None, None, 1, 5),
            (None, None, None, day(2020, 1, 1), day(2020, 1, 1), None, -5),
            ("x" * 101, 5.0, "junk", day(2024, 1, 1), day(2024, 3, 9), 2, 1),
        ],
        "MARKET_NAME string, WAC_DOLLARS double, MONTH_ENDING_DATE string, day date, STAGED_FILE_DATE date,"
        " MARKET_ID int, PRODUCT_ID int",
    )
    found = violations(
        df,
        [
            ("not_null", "MARKET_NAME"),
            ("no_blank_strings", "MARKET_NAME"),
            ("length_validation", "MARKET_NAME"),
            ("numeric_range_validation", "WAC_DOLLARS"),
            ("numeric_range_validation", "MARKET_ID"),
            ("numeric_range_validation", "PRODUCT_ID"),
            ("zero_value_check", "WAC_DOLLARS"),
            ("no_future_dates", "MONTH_ENDING_DATE"),
            ("no_future_dates", "day"),
            ("freshness_validation", "STAGED_FILE_DATE"),
        ],
    )
    assert found == {
        ("not_null", "MARKET_NAME"): 1,
        ("no_blank_strings", "MARKET_NAME"): 2,
        ("length_validation", "MARKET_NAME"): 1,
        ("numeric_range_validation", "WAC_DOLLARS"): 2,
        ("numeric_range_validation", "MARKET_ID"): 1,
        ("numeric_range_validation", "PRODUCT_ID"): 3,
        ("zero_value_check", "WAC_DOLLARS"): 1,
        ("no_future_dates", "MONTH_ENDING_DATE"): 4,
        ("no_future_dates", "day"): 1,
        ("freshness_validation", "STAGED_FILE_DATE"): 2,
    }


def test_epoch_dates_and_unique_values(spark):
    ms = int(datetime.datetime(2024, 3, 11, tzinfo=datetime.timezone.utc).timestamp() * 1000)
    df = spark.createDataFrame(
        [(ms, 0.0, "a"), (ms - 1, -0.0, "a"), (None, NAN, "b"), (0, NAN, None), (1, 1.0, None)],
        "MONTH_ENDING_DATE bigint, x double, s string",
    )
    config = RuleConfig(coded_dates={"MONTH_ENDING_DATE": EPOCH_MS})
    chosen = [("no_future_dates", "MONTH_ENDING_DATE"), ("unique_values", "x"), ("unique_values", "s")]
    assert violations(df, chosen, config) == {
        ("no_future_dates", "MONTH_ENDING_DATE"): 2,
        ("unique_values", "x"): 2,
        ("unique_values", "s"): 1,
    }


def test_errors_stay_with_their_check(spark):
    df = spark.createDataFrame([("a", 1)], "s string, n int")
    config = RuleConfig(ranges={"s": LowerBound("<", 0)}, max_length={"n": 1}, coded_dates={"n": quality.EPOCH_MS})
    chosen = [
        ("not_null", "s"), ("not_null", "gone"), ("numeric_range_validation", "s"), ("length_validation", "n"),
        ("zero_value_check", "n"), ("not_null", "s"),
    ]
    results = quality.run_checks(df, chosen, AS_OF, config)
    assert {(r.rule, r.column_name): r.status for r in results.collect()} == {
        ("not_null", "s"): "passed",
        ("not_null", "gone"): "error",
        ("numeric_range_validation", "s"): "error",
        ("length_validation", "n"): "passed",
        ("zero_value_check", "n"): "not_applicable",
    }
    row = quality.summary(results).first()
    assert (row.total_checks_requested, row.total_checks_evaluated, row.all_passed) == (5, 4, False)
    assert quality.summary(quality.run_checks(df, [("not_null", "s")], AS_OF)).first().all_passed
    assert quality.summary(quality.run_checks(df, [], AS_OF)).first().all_passed
    assert not quality.summary(quality.run_checks(df, [("zero_value_check", "n")], AS_OF)).first().all_passed


def test_one_bad_value_leaves_other_checks_alone(spark):
    df = spark.createDataFrame([(2**63 - 1, "x"), (-(2**63), None), (0, "y"), (None, "z")], "m long, s string")
    config = RuleConfig(coded_dates={"m": quality.EPOCH_MS}, max_length={"m": 5})
    chosen = [("no_future_dates", "m"), ("not_null", "s"), ("length_validation", "m")]
    assert violations(df, chosen, config) == {
        ("no_future_dates", "m"): 3, ("not_null", "s"): 1, ("length_validation", "m"): 2,
    }


def test_empty_table_passes(spark):
    df = spark.createDataFrame([], "s string, n int")
    assert violations(df, [("not_null", "s"), ("unique_values", "n")]) == {("not_null", "s"): 0, ("unique_values", "n"): 0}


def test_suggestions(spark):
    columns = spark.createDataFrame(
        [("c.s.t", "a", 1, "string"), ("c.s.t", "b", 2, "LONG"), ("c.s.t", "d", 3, "decimal(3,1)"), ("c.s.t", "e", 4, "date")],
        "full_name string, column_name string, ordinal_position int, data_type string",
    )
    by_rule = {}
    for r in quality.suggest_rules(columns).orderBy("rule_position", "ordinal_position").collect():
        by_rule.setdefault(r.rule, []).append(r.column_name)
    assert list(by_rule) == quality.RULE_ORDER
    assert by_rule == {
        "not_null": ["a", "b", "d", "e"], "no_blank_strings": ["a"], "length_validation": ["a"],
        "unique_values": ["a", "b", "d", "e"], "numeric_range_validation": ["b"], "zero_value_check": ["b"],
        "no_future_dates": ["e"], "freshness_validation": ["e"],
    }


def test_selections_from_payloads(spark):
    payloads = [
        (1, {"selections": [{"rule": "not_null", "column": "a"}, {"rule": "x"}, {"rule": "not_null", "column": "a"}]}),
        (2, {"selected_keys": ["sel__unique_values__a__b", "nope", "sel__not_null__c"], "sel__not_null__c": True}),
        (3, {"sel__r__f": False, "sel__r__z": 0, "sel__r__e": "", "sel__r__n": None, "sel__r__l": [],
             "sel__r__s": "false", "sel__r__i": 2, "sel__r__y": [0], "sel__r__o": {}, "sel__r__d": 0.0, "sel__r__m": {"a": 1}}),
        (4, {}),
    ]
    frame = spark.createDataFrame([(i, json.dumps(p)) for i, p in payloads], "id int, body string")
    found = quality.parse_selections(frame, "id", "body")
    assert rows(found, "id", "rule", "column") == [
        (1, "not_null", "a"), (2, "not_null", "c"), (2, "unique_values", "a__b"),
        (3, "r", "i"), (3, "r", "m"), (3, "r", "s"), (3, "r", "y"),
    ]
    first = found.filter("id = 2").orderBy("position").collect()
    assert [r.rule for r in first] == ["unique_values", "not_null"]


def test_proposed_mappings(spark):
    texts = [
        (1, '{"not_null": ["a", "zz", "a", 3], "odd": ["a"]}'),
        (2, 'Here:\n{"rule_to_columns": {"unique_values": ["b", "a"]}}\nbye'),
        (3, '{"rule_to_columns": ["a"]}'),
        (4, "nothing"), (5, '{"not_null": "a"}'), (6, "{broken"), (7, "[1]"), (8, ""),
    ]
    frame = spark.createDataFrame(texts, "id int, reply string")
    trees = frame.select("id", quality.json_from_text(F.col("reply")).alias("tree"))
    valid = spark.createDataFrame([("a",), ("b",)], "column_name string")
    found = quality.proposed_columns(trees, "id", "tree", valid)
    assert rows(found, "id", "rule", "column_name") == [(1, "not_null", "a"), (2, "unique_values", "a"), (2, "unique_values", "b")]


DOCUMENT = {
    "catalog": "lake",
    "parts": {
        "schema": "sales",
        "tables": [
            {"name": "t1", "columns": [{"name": "a", "type": "LONG"}, {"type": "LONG"}, "odd"]},
            {"table": {"table_name": "t2", "table_description": "two", "columns": [{"column_name": "b", "description": "bee"}]}},
            {"name": "none", "columns": []},
            {"name": "flat", "columns": {"a": 1}},
        ],
        "x.y.z": {"columns": [{"name": "c"}]},
    },
    "loose": {"full_table_name": "p.q.r.s", "columns": [{"name": "d"}]},
}


def test_documentation_records(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(DOCUMENT))
    (tmp_path / "two.json").write_text('[{"full_table_name": "m.n.o", "columns": [{"name": "e"}]}]')
    (tmp_path / "bad.json").write_text("{")
    records = documentation_records(read_documents(spark, str(tmp_path)))
    found = rows(records, "full_table_name", "catalog", "schema", "table_name", "column_name", "data_type", "description")
    assert found == [
        # The inherited names go before those of the three-part key.
        ("lake.sales.t1", "lake", "sales", "t1", "a", "LONG", ""),
        ("lake.sales.t2", "lake", "sales", "t2", "b", "", "bee"),
        ("m.n.o", "m", "n", "o", "e", "", ""),
        ("p.q.r.s", "lake", "q", "s", "d", "", ""),
        ("x.y.z", "lake", "sales", "z", "c", "", ""),
    ]
    assert rows(quality.find_documentation(records, "`M`.N.o"), "column_name") == [("e",)]
    with pytest.raises(ValueError):
        quality.find_documentation(records)


def test_documentation_fingerprint_follows_the_columns(spark):
    def prints(document):
        text = spark.createDataFrame([("x", json.dumps(document))], "document string, text string")
        found = quality.documentation_fingerprint(documentation_records(text)).collect()
        return {r.target: r.fingerprint for r in found}

    changed = json.loads(json.dumps(DOCUMENT))
    changed["parts"]["tables"][0]["columns"][0]["type"] = "STRING"
    before, after = prints(DOCUMENT), prints(changed)
    assert before.keys() == after.keys()
    assert [t for t in before if before[t] != after[t]] == ["lake.sales.t1"]
    assert before["lake.sales.t1"].startswith("lake.sales.t1:")
