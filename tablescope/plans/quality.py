"""Registered data-quality queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.types import clean_scalars
from tablescope.operators import quality
from tablescope.operators.quality import EPOCH_MS, YYYYMMDD, LowerBound, RuleConfig
from tablescope.plans import inputs
from tablescope.plans.inputs import STAR_COLUMNS, star_name
from tablescope.plans.registry import Tables, query
from tablescope.sources.documentation import documentation_records

AS_OF = date(2001, 6, 30)
AS_OF_SQL = "DATE '2001-06-30'"

# Line items with nulls, NaN, blanks, days and coded days put in.
CHECKED_SQL = """
WITH checked AS (
  SELECT l_orderkey, l_partkey, l_linenumber,
         CASE WHEN l_quantity = 7 THEN 'NaN'::DOUBLE ELSE nullif(l_quantity, 3) END AS l_quantity,
         l_extendedprice - 2000 AS l_margin, l_discount, l_tax,
         CASE l_returnflag WHEN 'R' THEN NULL WHEN 'N' THEN '  ' ELSE l_returnflag END AS l_returnflag,
         l_shipdate, l_shipdate::DATE AS l_shipday,
         CASE WHEN l_linenumber = 1 THEN '20001399' WHEN l_linenumber <> 2 THEN strftime(l_shipdate, '%Y%m%d') END
           AS l_shipcode,
         CASE WHEN l_linenumber = 3 AND l_partkey % 7 = 0 THEN 9223372036854775807
           WHEN l_linenumber <> 2 THEN epoch_ms(l_shipdate) END AS l_shipmillis,
         repeat('x', l_quantity::INTEGER) AS l_note
  FROM lineitem
)"""


def checked(t: Tables) -> DataFrame:
    number, line = F.col("l_quantity"), F.col("l_linenumber")
    flag = F.col("l_returnflag")
    return t["lineitem"].select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.when(number == 7, float("nan")).when(number != 3, number).alias("l_quantity"),
        (F.col("l_extendedprice") - 2000).alias("l_margin"),
        "l_discount",
        "l_tax",
        F.when(flag == "N", "  ").when(flag != "R", flag).alias("l_returnflag"),
        "l_shipdate",
        F.col("l_shipdate").cast("date").alias("l_shipday"),
        F.when(line == 1, "20001399").when(line != 2, F.date_format("l_shipdate", "yyyyMMdd")).alias("l_shipcode"),
        F.when((line == 3) & (F.col("l_partkey") % 7 == 0), F.lit(2**63 - 1))
        .when(line != 2, F.unix_millis(F.col("l_shipdate").cast("timestamp")))
        .alias("l_shipmillis"),
        F.repeat(F.lit("x"), number.cast("int")).alias("l_note"),
    )


CONFIG = RuleConfig(
    max_length={"l_note": 40},
    ranges={
        "l_quantity": LowerBound("<", 2, null_fails=True, nan_fails=True),
        "l_margin": LowerBound("<", 0, nan_fails=True),
        "l_linenumber": LowerBound("<=", 1),
    },
    zero_columns=frozenset({"l_tax", "l_discount"}),
    coded_dates={"l_shipcode": YYYYMMDD, "l_shipmillis": EPOCH_MS},
    fresh_days={"l_shipdate": 700, "l_shipday": 700},
)

# rule, column, and the SQL condition of a violating row.
CONDITIONS = [
    ("not_null", "l_quantity", "l_quantity IS NULL"),
    ("not_null", "l_returnflag", "l_returnflag IS NULL"),
    ("not_null", "l_orderkey", "l_orderkey IS NULL"),
    ("no_blank_strings", "l_returnflag", "l_returnflag IS NOT NULL AND trim(l_returnflag) = ''"),
    ("length_validation", "l_note", "length(l_note) > 40"),
    ("numeric_range_validation", "l_quantity", "l_quantity IS NULL OR l_quantity < 2 OR isnan(l_quantity)"),
    ("numeric_range_validation", "l_margin", "l_margin < 0 OR isnan(l_margin)"),
    ("numeric_range_validation", "l_linenumber", "l_linenumber <= 1"),
    ("zero_value_check", "l_tax", "l_tax = 0"),
    ("zero_value_check", "l_discount", "l_discount = 0"),
    ("no_future_dates", "l_shipday", f"l_shipday > {AS_OF_SQL}"),
    (
        "no_future_dates",
        "l_shipcode",
        f"try_strptime(l_shipcode, '%Y%m%d') IS NULL OR try_strptime(l_shipcode, '%Y%m%d')::DATE > {AS_OF_SQL}",
    ),
    (
        "no_future_dates",
        "l_shipmillis",
        f"CASE WHEN l_shipmillis IS NULL OR l_shipmillis > 9000000000000000 THEN true"
        f" ELSE make_timestamp_ms(l_shipmillis)::DATE > {AS_OF_SQL} END",
    ),
    ("freshness_validation", "l_shipdate", f"l_shipdate < {AS_OF_SQL} - 700"),
    ("freshness_validation", "l_shipday", f"l_shipday < {AS_OF_SQL} - 700"),
]
UNIQUE = ["l_orderkey", "l_quantity", "l_returnflag", "l_margin", "l_shipdate"]


def _row_sql(rule: str, column: str, condition: str) -> str:
    return (
        f"SELECT '{rule}' AS rule, '{column}' AS column_name, count(*) FILTER (WHERE {condition}) AS violations FROM checked"
    )


def _unique_sql(column: str) -> str:
    return (
        f"SELECT 'unique_values', '{column}', (SELECT count(*) FROM (SELECT 1 FROM checked"
        f" WHERE {column} IS NOT NULL GROUP BY {column} HAVING count(*) > 1))"
    )


def _counts_sql(rules: set[str] | None = None) -> str:
    parts = [_row_sql(*c) for c in CONDITIONS if rules is None or c[0] in rules]
    if rules is None or "unique_values" in rules:
        unique = [_unique_sql(c) for c in UNIQUE]
        if not parts:
            unique[0] = unique[0].replace("'unique_values',", "'unique_values' AS rule,").replace(
                f"'{UNIQUE[0]}',", f"'{UNIQUE[0]}' AS column_name,"
            ) + " AS violations"
        parts += unique
    return CHECKED_SQL + ", counts AS (" + " UNION ALL ".join(parts) + ")"


def _selections(rules: set[str] | None = None) -> list[tuple[str, str]]:
    pairs = [(rule, column) for rule, column, _ in CONDITIONS]
    pairs += [("unique_values", column) for column in UNIQUE]
    return [pair for pair in pairs if rules is None or pair[0] in rules]


def _violations(t: Tables, *rules: str) -> DataFrame:
    results = quality.run_checks(checked(t), _selections(set(rules)), AS_OF, CONFIG)
    return results.select("rule", "column_name", "violations")


def _register_rule(name: str, rule: str):
    @query(name, _counts_sql({rule}) + " SELECT rule, column_name, violations FROM counts")
    def run(t: Tables) -> DataFrame:
        return _violations(t, rule)


for _name, _rule in [
    ("q1_not_null", "not_null"),
    ("q2_no_blank_strings", "no_blank_strings"),
    ("q3_length_validation", "length_validation"),
    ("q4_unique_values", "unique_values"),
    ("q5_numeric_range", "numeric_range_validation"),
    ("q6_zero_value_check", "zero_value_check"),
    ("q7_no_future_dates", "no_future_dates"),
    ("q8_freshness", "freshness_validation"),
]:
    _register_rule(_name, _rule)


STATUS = "CASE WHEN violations > 0 THEN 'failed' ELSE 'passed' END"


@query("o1_all_checks_in_one_pass", _counts_sql() + " SELECT rule, column_name, violations FROM counts")
def o1(t: Tables) -> DataFrame:
    return quality.run_checks(checked(t), _selections(), AS_OF, CONFIG).select(
        "rule", "column_name", "violations"
    )


# Selections that do not apply, name no column, or cannot be evaluated.
ODD = [
    ("no_blank_strings", "l_tax"),
    ("not_null", "l_nothing"),
    ("length_validation", "l_tax"),
    ("odd_rule", "l_tax"),
    ("numeric_range_validation", "l_note"),
]
ODD_CONFIG = RuleConfig(
    **{
        **CONFIG.__dict__,
        "max_length": {"l_note": 40, "l_tax": 3},
        "ranges": {**CONFIG.ranges, "l_note": LowerBound("<", 0)},
    }
)
ODD_SQL = """, results AS (
  SELECT rule, column_name, CASE WHEN violations > 0 THEN 'failed' ELSE 'passed' END AS status, violations FROM counts
  UNION ALL VALUES ('no_blank_strings', 'l_tax', 'not_applicable', NULL), ('not_null', 'l_nothing', 'error', NULL),
    ('numeric_range_validation', 'l_note', 'error', NULL), ('odd_rule', 'l_tax', 'not_applicable', NULL)
  UNION ALL SELECT 'length_validation', 'l_tax', 'failed', count(*) FILTER (WHERE length(l_tax::VARCHAR) > 3) FROM checked)"""


def _odd_results(t: Tables) -> DataFrame:
    return quality.run_checks(checked(t), _selections() + ODD, AS_OF, ODD_CONFIG)


@query("q10_check_results", _counts_sql() + ODD_SQL + " SELECT * FROM results WHERE status = 'failed'")
def q10(t: Tables) -> DataFrame:
    return quality.failures(_odd_results(t)).select("rule", "column_name", "status", "violations")


@query("q11_isolated_errors", _counts_sql() + ODD_SQL + " SELECT * FROM results")
def q11(t: Tables) -> DataFrame:
    return _odd_results(t).select("rule", "column_name", "status", "violations")


@query("j10_applicable_checks", _counts_sql() + ODD_SQL + " SELECT rule, column_name FROM results WHERE violations IS NOT NULL")
def j10(t: Tables) -> DataFrame:
    return _odd_results(t).filter("violations is not null").select("rule", "column_name")


@query(
    "a4_duplicate_values",
    """SELECT (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY text HAVING count(*) > 1)) AS text_values,
      (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY source HAVING count(*) > 1)) AS source_values""",
)
def a4(t: Tables) -> DataFrame:
    chosen = [("unique_values", "text"), ("unique_values", "source")]
    results = quality.run_checks(t["documents"], chosen, AS_OF)
    return results.agg(
        F.max(F.when(F.col("column_name") == "text", F.col("violations"))).alias("text_values"),
        F.max(F.when(F.col("column_name") == "source", F.col("violations"))).alias("source_values"),
    )


@query(
    "a10_check_summary",
    _counts_sql()
    + ODD_SQL
    + """ SELECT count(*) AS total_checks_requested,
      count(*) FILTER (WHERE status <> 'not_applicable') AS total_checks_evaluated,
      count(DISTINCT column_name) FILTER (WHERE status = 'failed') AS total_columns_with_failures,
      bool_and(status IN ('passed', 'not_applicable')) AS all_passed FROM results""",
)
def a10(t: Tables) -> DataFrame:
    return quality.summary(_odd_results(t))


@query(
    "a11_check_totals",
    _counts_sql()
    + ODD_SQL
    + """ SELECT sum(violations)::BIGINT AS total_violations,
      count(*) FILTER (WHERE status = 'failed') AS failed_checks,
      count(*) FILTER (WHERE status = 'passed') AS passed_checks FROM results""",
)
def a11(t: Tables) -> DataFrame:
    return quality.totals(_odd_results(t))


SUGGESTED_SQL = """
  rules(rule_position, rule, title, applies) AS (VALUES
    (1, 'not_null', 'Not NULL', '*'), (2, 'no_blank_strings', 'No Blank Strings', 'STRING'),
    (3, 'length_validation', 'Length Validation', 'STRING'), (4, 'unique_values', 'Uniqueness', '*'),
    (5, 'numeric_range_validation', 'Numeric Range', 'LONG DOUBLE INTEGER'),
    (6, 'zero_value_check', 'Zero Value Check', 'LONG DOUBLE INTEGER'),
    (7, 'no_future_dates', 'No Future Dates', 'TIMESTAMP DATE'),
    (8, 'freshness_validation', 'Freshness Check', 'TIMESTAMP DATE'))"""


@query(
    "q9_suggested_rules",
    "WITH "
    + inputs.INFO_SQL.strip()
    + ","
    + SUGGESTED_SQL
    + """, typed AS (
      SELECT catalog_name || '.' || schema_name || '.' || table_name AS full_name, column_name, ordinal_position,
             CASE data_type WHEN 'bigint' THEN 'LONG' WHEN 'string' THEN 'STRING' ELSE 'DOUBLE' END AS data_type
      FROM info_columns)
    SELECT full_name, column_name, ordinal_position, data_type, rule_position, rule, title
    FROM typed JOIN rules ON applies = '*' OR contains(applies, data_type)""",
)
def q9(t: Tables) -> DataFrame:
    columns = inputs.info_columns(t).withColumn(
        "full_name", F.concat_ws(".", "catalog_name", "schema_name", "table_name")
    )
    return quality.suggest_rules(columns)


@query(
    "q10_suggested_checks",
    "WITH "
    + " , ".join(
        f"c{i} AS (SELECT '{column}' AS column_name, count(*) - count({column}) AS nulls,"
        f" (SELECT count(*) FROM (SELECT 1 FROM orders WHERE {column} IS NOT NULL GROUP BY {column}"
        f" HAVING count(*) > 1)) AS repeated FROM orders)"
        for i, column in enumerate(STAR_COLUMNS["orders"])
    )
    + " , found AS ("
    + " UNION ALL ".join(f"FROM c{i}" for i in range(len(STAR_COLUMNS["orders"])))
    + """), strings(column_name, blank) AS (
      SELECT 'o_orderstatus', count(*) FILTER (WHERE trim(o_orderstatus) = '') FROM orders UNION ALL
      SELECT 'o_orderpriority', count(*) FILTER (WHERE trim(o_orderpriority) = '') FROM orders)
    SELECT 'not_null' AS rule, column_name, nulls AS violations FROM found
    UNION ALL SELECT 'unique_values', column_name, repeated FROM found
    UNION ALL SELECT 'no_blank_strings', column_name, blank FROM strings""",
)
def q10_suggested(t: Tables) -> DataFrame:
    results = quality.run_suggested(t["orders"], AS_OF)
    return results.filter(F.col("status").isin("passed", "failed")).select("rule", "column_name", "violations")


@query(
    "x2_scalar_cleaning",
    CHECKED_SQL
    + """ SELECT l_orderkey, l_linenumber, CASE WHEN NOT isnan(l_quantity) THEN l_quantity END AS l_quantity,
      strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS l_shipdate, strftime(l_shipday, '%Y-%m-%d') AS l_shipday,
      l_returnflag FROM checked""",
)
def x2(t: Tables) -> DataFrame:
    names = ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_shipday", "l_returnflag"]
    return clean_scalars(checked(t).select(*names))


# Selections and proposals as JSON: one payload per event, one reply per event.

PAYLOADS = """'{"selections": [{"rule": "not_null", "column": "' || event_type || '"}, {"rule": "", "column": "x"}], '
  || '"selected_keys": ["sel__not_null__' || event_type || '", "sel__unique_values__user__' || user_id || '", "other"], '
  || '"sel__zero_value_check__value": ' || CASE WHEN value > 40 THEN 'true' ELSE 'false' END || ', '
  || '"sel__no_future_dates__ts": "' || CASE WHEN value > 20 THEN 'on' ELSE '' END || '"}'"""


@query(
    "f14_selections",
    """WITH picked AS (
      SELECT event_id, 'not_null' AS rule, event_type AS "column", 1 AS seen FROM events
      UNION ALL SELECT event_id, 'unique_values', 'user__' || user_id, 2 FROM events
      UNION ALL SELECT event_id, 'zero_value_check', 'value', 4 FROM events WHERE value > 40
      UNION ALL SELECT event_id, 'no_future_dates', 'ts', 3 FROM events WHERE value > 20)
    SELECT event_id, rule, "column", row_number() OVER (PARTITION BY event_id ORDER BY seen)::INTEGER AS place
    FROM picked""",
)
def f14(t: Tables) -> DataFrame:
    payloads = t["events"].select("event_id", F.expr(PAYLOADS).alias("payload"))
    """Members of an object have no order of their own but that of their names."""
    found = quality.parse_selections(payloads, "event_id", "payload")
    order = Window.partitionBy("event_id").orderBy("position")
    return found.withColumn("place", F.row_number().over(order)).drop("position")


REPLIES = """CASE WHEN value > 30
  THEN 'Sure, here it is: {"rule_to_columns": {"not_null": ["value", "u' || user_id || '", "value"], "'
       || event_type || '": ["ts"], "unique_values": "ts"}} Done.'
  WHEN value > 15 THEN '{"no_future_dates": ["ts", "gone", 5], "unique_values": ["event_id", "ts"]}'
  WHEN value > 5 THEN 'no braces here' ELSE 'broken {"not_null": ["ts"' END"""


def replies(t: Tables) -> DataFrame:
    texts = t["events"].select("event_id", F.expr(REPLIES).alias("reply"))
    return texts.select("event_id", quality.json_from_text(F.col("reply")).alias("tree"))


@query(
    "f15_sanitised_mapping",
    """WITH proposed AS (
      SELECT event_id, event_type, 'not_null' AS rule, 'value' AS column_name FROM events WHERE value > 30
      UNION ALL SELECT event_id, event_type, 'no_future_dates', 'ts' FROM events WHERE value > 15 AND value <= 30
      UNION ALL SELECT event_id, event_type, 'unique_values', unnest(['event_id', 'ts']) FROM events
        WHERE value > 15 AND value <= 30)
    SELECT event_id, rule, column_name FROM proposed WHERE NOT (event_type = 'click' AND column_name = 'ts')""",
)
def f15(t: Tables) -> DataFrame:
    names = F.array(*(F.lit(c) for c in t["events"].columns))
    # Each reply is about a table of its own; tables of clicks have no column of times.
    known = t["events"].select("event_id", "event_type", F.explode(names).alias("column_name"))
    known = known.filter("NOT (event_type = 'click' AND column_name = 'ts')")
    return quality.proposed_columns(replies(t), "event_id", "tree", known.select("event_id", "column_name"))


@query(
    "f16_json_in_text",
    """SELECT event_id, value > 15 AS has_json, CASE WHEN value > 30 THEN 'ts' END AS nested_text,
      CASE WHEN value > 30 THEN 'u' || user_id WHEN value > 15 THEN 'gone' END AS second_item,
      CASE WHEN value > 15 AND value <= 30 THEN 5::BIGINT END AS third_item FROM events""",
)
def f16(t: Tables) -> DataFrame:
    """What is found in the JSON of the replies, bare or with words around it."""
    inside = lambda path, kind: F.try_variant_get("tree", path, kind)
    return replies(t).select(
        "event_id",
        F.col("tree").isNotNull().alias("has_json"),
        inside("$.rule_to_columns.unique_values", "string").alias("nested_text"),
        F.coalesce(inside("$.rule_to_columns.not_null[1]", "string"), inside("$.no_future_dates[1]", "string")).alias(
            "second_item"
        ),
        inside("$.no_future_dates[2]", "bigint").alias("third_item"),
    )


# Documentation: one nested JSON document per text document, with two table records each.

DOCUMENTATION = """'{"catalog": "' || source || '", "languages": {"schema": "' || lang || '", "tables": ['
  || '{"name": "doc_' || doc_id || '", "columns": [{"name": "text", "type": "STRING", "summary": "the words"}, '
  || '{"column_name": "n_chars", "data_type": "LONG"}, {"type": "LONG"}, "loose"]}, {"name": "empty", "columns": []}], '
  || '"lake.docs.d' || doc_id || '": {"table": {"table_description": "copy", "columns": [{"name": "body"}]}}}}'"""

RECORDS_SQL = """WITH records AS (
  SELECT source AS catalog, lang AS "schema", 'doc_' || doc_id AS table_name,
         source || '.' || lang || '.doc_' || doc_id AS full_table_name, NULL::VARCHAR AS table_description,
         0 AS position, 'text' AS column_name, 'STRING' AS data_type, 'the words' AS description FROM documents
  UNION ALL
  SELECT source, lang, 'doc_' || doc_id, source || '.' || lang || '.doc_' || doc_id, NULL, 1, 'n_chars', 'LONG', ''
  FROM documents
  UNION ALL
  SELECT source, lang, 'd' || doc_id, 'lake.docs.d' || doc_id, 'copy', 0, 'body', '', '' FROM documents
)"""


def records(t: Tables) -> DataFrame:
    documents = t["documents"].select(
        F.col("doc_id").cast("string").alias("document"), F.expr(DOCUMENTATION).alias("text")
    )
    return documentation_records(documents).drop("document", "place")


@query("s6_documentation_records", RECORDS_SQL + " SELECT * FROM records")
def s6(t: Tables) -> DataFrame:
    return records(t)


@query(
    "q12_documentation_lookup",
    RECORDS_SQL + " SELECT * FROM records WHERE lower(full_table_name) = 'lake.docs.d17'",
)
def q12(t: Tables) -> DataFrame:
    return quality.find_documentation(records(t), "Lake.`DOCS`.D17")


@query(
    "q13_documentation_fingerprint",
    RECORDS_SQL
    + """, hashed AS (
      SELECT catalog || '.' || "schema" || '.' || table_name AS target,
             ('0x' || substr(md5(position || chr(31) || column_name || chr(31) || data_type || chr(31) ||
               coalesce(description, '')), 1, 15))::BIGINT::HUGEINT AS bits,
             coalesce(table_description, '') AS described
      FROM records)
    SELECT target, target || ':' || md5(max(described) || chr(31) || sum(bits)::VARCHAR) AS fingerprint
    FROM hashed GROUP BY target""",
)
def q13(t: Tables) -> DataFrame:
    return quality.documentation_fingerprint(records(t))
