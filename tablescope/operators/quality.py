"""Data-quality rules: suggestion, selection, execution in one pass, summaries."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.names import clean_full_name
from tablescope.functions.types import normal_type, rule_type
from tablescope.operators.profile import value_counts

# Rule keys in their order, with titles.
RULE_TITLES = {
    "not_null": "Not NULL",
    "no_blank_strings": "No Blank Strings",
    "length_validation": "Length Validation",
    "unique_values": "Uniqueness",
    "numeric_range_validation": "Numeric Range",
    "zero_value_check": "Zero Value Check",
    "no_future_dates": "No Future Dates",
    "freshness_validation": "Freshness Check",
}
RULE_ORDER = list(RULE_TITLES)

# The column types a rule is suggested for; None means every type.
SUGGESTED_FOR = {
    "not_null": None,
    "no_blank_strings": ("STRING",),
    "length_validation": ("STRING",),
    "unique_values": None,
    "numeric_range_validation": ("LONG", "DOUBLE", "INTEGER"),
    "zero_value_check": ("LONG", "DOUBLE", "INTEGER"),
    "no_future_dates": ("TIMESTAMP", "DATE"),
    "freshness_validation": ("TIMESTAMP", "DATE"),
}

YYYYMMDD, EPOCH_MS = "yyyyMMdd", "epoch_ms"
_BELOW = {"<": operator.lt, "<=": operator.le}


@dataclass(frozen=True)
class LowerBound:
    """A value violates when ``value <op> bound``; null or NaN can count as well."""

    op: str
    bound: float
    null_fails: bool = False
    nan_fails: bool = False


@dataclass(frozen=True)
class RuleConfig:
    """Bounds and columns of the rules that need them."""

    max_length: Mapping[str, int] = field(default_factory=dict)
    ranges: Mapping[str, LowerBound] = field(default_factory=dict)
    zero_columns: frozenset[str] = frozenset()
    coded_dates: Mapping[str, str] = field(default_factory=dict)
    fresh_days: Mapping[str, int] = field(default_factory=dict)


# Bounds and their columns belong to the tables that are checked, so there are none by default.
DEFAULT_CONFIG = RuleConfig()
# Milliseconds that a timestamp of microseconds can hold.
MOST_MILLIS = 9_000_000_000_000_000


class NotComparable(ValueError):
    """The rule cannot be evaluated on a column of this type."""


def violation(rule: str, column: str, kind: T.DataType, config: RuleConfig, as_of: date) -> Column | None:
    """The condition that marks a violating row, or None if the rule does not apply.

    ``unique_values`` counts values and not rows, and is not a row condition.
    """
    value, type_name = F.col(f"`{column}`"), rule_type(kind)
    if rule == "not_null":
        return value.isNull()
    if rule == "no_blank_strings" and type_name == "STRING":
        return F.trim(value) == ""
    if rule == "length_validation" and column in config.max_length:
        _need(isinstance(kind, T.AtomicType), rule, type_name)
        # Numbers and dates are measured as they are spelled.
        measured = value if isinstance(kind, T.BinaryType) else value.cast("string")
        return F.length(measured) > config.max_length[column]
    if rule == "numeric_range_validation" and column in config.ranges:
        _need(isinstance(kind, T.NumericType), rule, type_name)
        limit = config.ranges[column]
        broken = _BELOW[limit.op](value, F.lit(limit.bound))
        if limit.null_fails:
            broken = broken | value.isNull()
        if limit.nan_fails and type_name == "DOUBLE":
            broken = broken | F.isnan(value)
        return broken
    if rule == "zero_value_check" and column in config.zero_columns:
        _need(isinstance(kind, T.NumericType), rule, type_name)
        return value == 0
    if rule == "no_future_dates":
        if type_name == "DATE":
            return value > F.lit(as_of)
        if column in config.coded_dates:
            day = _coded_date(value, config.coded_dates[column])
            return day.isNull() | (day > F.lit(as_of))
    if rule == "freshness_validation" and column in config.fresh_days:
        _need(isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)), rule, type_name)
        return value < F.date_sub(F.lit(as_of), config.fresh_days[column])
    return None


def _need(met: bool, rule: str, type_name: str):
    if not met:
        raise NotComparable(f"{rule} cannot be evaluated on {type_name}")


def _coded_date(value: Column, coding: str) -> Column:
    if coding == EPOCH_MS:
        millis = value.try_cast("bigint")
        # Beyond these the conversion would raise and take all other checks with it.
        return F.when(millis.between(-MOST_MILLIS, MOST_MILLIS), F.to_date(F.timestamp_millis(millis)))
    return F.try_to_date(value.cast("string"), YYYYMMDD)


CHECK_SCHEMA = "position int, rule string, title string, column_name string, status string, error string"


def run_checks(
    df: DataFrame,
    selections: Sequence[tuple[str, str]],
    as_of: date,
    config: RuleConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """One row per distinct selection: ``status`` and, where evaluated, ``violations``.

    All row conditions are counted in one aggregation over one scan; uniqueness of all
    selected columns takes one more, keyed by column and value. A selection that cannot
    be evaluated becomes an ``error`` row and leaves the others alone; one that does not
    apply to its column is ``not_applicable`` and stays out of the evaluated count.
    """
    spark, fields = df.sparkSession, {f.name: f for f in df.schema.fields}
    rows, counts, unique = [], {}, {}
    for position, (rule, column) in enumerate(dict.fromkeys(selections)):
        status, error = "evaluated", None
        if column not in fields:
            status, error = "error", f"no column {column}"
        elif rule == "unique_values":
            unique[column] = position
        else:
            try:
                broken = violation(rule, column, fields[column].dataType, config, as_of)
                if broken is None:
                    status = "not_applicable"
                else:
                    counts[position] = F.count_if(broken)
            except NotComparable as reason:
                status, error = "error", str(reason)
        rows.append((position, rule, RULE_TITLES.get(rule, rule), column, status, error))
    checks = spark.createDataFrame(rows, CHECK_SCHEMA)
    found = _row_violations(df, counts, unique)
    result = checks if found is None else checks.join(found, "position", "left")
    if found is None:
        result = result.withColumn("violations", F.lit(None).cast("bigint"))
    violations = F.when(F.col("status") == "evaluated", F.coalesce("violations", F.lit(0)))
    outcome = F.when(violations > 0, "failed").when(violations == 0, "passed").otherwise(F.col("status"))
    return result.select(
        "position", "rule", "title", "column_name", outcome.alias("status"), violations.alias("violations"), "error"
    )


def _row_violations(df: DataFrame, counts: dict[int, Column], unique: dict[str, int]) -> DataFrame | None:
    parts = []
    if counts:
        one_row = df.agg(*(count.alias(f"c{position}") for position, count in counts.items()))
        cells = [
            F.struct(F.lit(position).alias("position"), F.col(f"c{position}").alias("violations"))
            for position in counts
        ]
        parts.append(one_row.select(F.inline(F.array(*cells))))
    if unique:
        parts.append(_duplicate_values(df, unique))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _duplicate_values(df: DataFrame, positions: Mapping[str, int]) -> DataFrame:
    """For each column, how many values (null left out) occur more than once."""
    columns = list(positions)
    counts = value_counts({"": df.select(*(f"`{c}`" for c in columns))})
    repeated = (F.col("n") > 1) & F.coalesce(
        F.col("number").cast("string"), F.col("real").cast("string"), F.col("moment").cast("string"), "words"
    ).isNotNull()
    position = F.element_at(F.array(*(F.lit(positions[c]) for c in columns)), F.col("ordinal_position"))
    return counts.groupBy("ordinal_position").agg(F.count_if(repeated).alias("violations")).select(
        position.alias("position"), "violations"
    )


def failures(results: DataFrame) -> DataFrame:
    """The failing checks, by column and rule."""
    return results.filter(F.col("status") == "failed").orderBy("column_name", "position")


def summary(results: DataFrame) -> DataFrame:
    """One row: checks requested and evaluated, columns with failures, ``all_passed``.

    ``all_passed`` needs at least one evaluated check, no failure and no error; it holds
    when nothing was asked.
    """
    evaluated = F.count_if(F.col("status").isin("passed", "failed"))
    failed, errors = F.count_if(F.col("status") == "failed"), F.count_if(F.col("status") == "error")
    return results.agg(
        F.count(F.lit(1)).alias("total_checks_requested"),
        (evaluated + errors).alias("total_checks_evaluated"),
        F.count_distinct(F.when(F.col("status") == "failed", F.col("column_name"))).alias(
            "total_columns_with_failures"
        ),
        ((F.count(F.lit(1)) == 0) | ((evaluated > 0) & (failed == 0) & (errors == 0))).alias("all_passed"),
    )


def totals(results: DataFrame) -> DataFrame:
    """One row: all violations, failed checks, passed checks."""
    return results.agg(
        F.coalesce(F.sum("violations"), F.lit(0)).alias("total_violations"),
        F.count_if(F.col("status") == "failed").alias("failed_checks"),
        F.count_if(F.col("status") == "passed").alias("passed_checks"),
    )


def suggest_rules(columns: DataFrame) -> DataFrame:
    """The rules that a column's type suggests, as one row per table, rule and column.

    ``columns`` needs ``full_name``, ``column_name``, ``ordinal_position``, ``data_type``.
    """
    kind = normal_type("data_type")
    offers = []
    for position, rule in enumerate(RULE_ORDER, start=1):
        offer = F.struct(
            F.lit(position).alias("rule_position"),
            F.lit(rule).alias("rule"),
            F.lit(RULE_TITLES[rule]).alias("title"),
        )
        types = SUGGESTED_FOR[rule]
        offers.append(offer if types is None else F.when(kind.isin(*types), offer))
    return columns.select(
        "full_name",
        "column_name",
        "ordinal_position",
        kind.alias("data_type"),
        F.inline(F.array_compact(F.array(*offers))),
    )


def run_suggested(df: DataFrame, as_of: date, config: RuleConfig = DEFAULT_CONFIG) -> DataFrame:
    """Run every rule that the types of ``df`` suggest."""
    selections = [
        (rule, f.name)
        for rule in RULE_ORDER
        for f in df.schema.fields
        if SUGGESTED_FOR[rule] is None or rule_type(f.dataType) in SUGGESTED_FOR[rule]
    ]
    return run_checks(df, selections, as_of, config)


# Selections and proposals that arrive as JSON text ------------------------------------


def parse_selections(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """Distinct ``(key, rule, column)`` of JSON payloads, with ``position`` in first-seen order.

    A payload lists them as ``selections`` of objects, as ``selected_keys`` of the form
    ``sel__rule__column``, or as members of that form with a true value.
    """
    parsed = payloads.select(
        F.col(key),
        F.from_json(
            payload, "selections array<struct<rule:string,column:string>>, selected_keys array<string>"
        ).alias("listed"),
        F.try_parse_json(payload).alias("tree"),
    )
    objects = parsed.select(key, F.posexplode("listed.selections").alias("at", "item")).select(
        key,
        F.struct(F.lit(1).alias("form"), "at").alias("seen"),
        F.nullif("item.rule", F.lit("")).alias("rule"),
        F.nullif("item.column", F.lit("")).alias("column"),
    )
    keys = parsed.select(key, F.posexplode("listed.selected_keys").alias("at", "text")).select(
        key, F.struct(F.lit(2).alias("form"), "at").alias("seen"), "text"
    )
    spark = payloads.sparkSession
    members = parsed.filter(F.schema_of_variant("tree").startswith("OBJECT")).lateralJoin(
        spark.tvf.variant_explode(F.col("tree").outer())
    )
    kind, text = F.schema_of_variant("value"), F.try_variant_get("value", "$", "string")
    is_true = ~(
        kind.isin("VOID", "ARRAY<VOID>", "OBJECT<>")
        | ((kind == "BOOLEAN") & (text == "false"))
        | ((kind == "STRING") & (text == ""))
        | (kind.startswith("BIGINT") & (text == "0"))
        | (kind.startswith("DECIMAL") & (F.try_variant_get("value", "$", "double") == 0))
        | (kind.startswith("DOUBLE") & (F.try_variant_get("value", "$", "double") == 0))
    )
    flags = members.filter(F.col("key").startswith("sel__") & is_true).select(
        F.col(f"{key}") if key != "key" else parsed[key],
        F.struct(F.lit(3).alias("form"), F.col("pos").alias("at")).alias("seen"),
        F.col("key").alias("text"),
    )
    coded = keys.unionByName(flags).filter(F.col("text").startswith("sel__"))
    pieces = F.split("text", "__", 3)
    coded = coded.select(
        key, "seen", F.get(pieces, 1).alias("rule"), F.get(pieces, 2).alias("column")
    )
    every = objects.unionByName(coded).filter(F.col("rule").isNotNull() & F.col("column").isNotNull())
    return every.groupBy(key, "rule", "column").agg(F.min("seen").alias("position"))


def json_from_text(text) -> Column:
    """The JSON in a reply: the whole text, or else its first ``{`` to its last ``}``."""
    inner = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(inner))


def proposed_columns(
    replies: DataFrame,
    key: str,
    tree: str,
    valid_columns: DataFrame,
    valid_rules: Iterable[str] = tuple(RULE_ORDER),
) -> DataFrame:
    """Distinct known ``(key, rule, column_name)`` of proposed rule-to-columns mappings.

    ``tree`` is a variant column; the mapping is bare or under ``rule_to_columns``.
    ``valid_columns`` has a column ``column_name``; with a column ``key`` as well, each reply
    is held against the columns of its own table.
    """
    spark = replies.sparkSession
    known = [name for name in (key, "column_name") if name in valid_columns.columns]
    objects = replies.filter(F.schema_of_variant(tree).startswith("OBJECT"))
    nested = F.try_variant_get(tree, "$.rule_to_columns", "variant")
    mapping = objects.select(F.col(key).alias("_key"), F.coalesce(nested, F.col(tree)).alias("mapping"))
    mapping = mapping.filter(F.schema_of_variant("mapping").startswith("OBJECT"))
    rules = mapping.lateralJoin(spark.tvf.variant_explode(F.col("mapping").outer())).select(
        "_key", F.col("key").alias("rule"), F.col("value").alias("proposed")
    )
    rules = rules.filter(
        F.col("rule").isin(*valid_rules) & F.schema_of_variant("proposed").startswith("ARRAY")
    )
    columns = rules.lateralJoin(spark.tvf.variant_explode(F.col("proposed").outer())).filter(
        F.schema_of_variant("value") == "STRING"
    )
    return (
        columns.select(
            F.col("_key").alias(key), "rule", F.try_variant_get("value", "$", "string").alias("column_name")
        )
        .join(valid_columns.select(*known).distinct(), known, "left_semi")
        .select(key, "rule", "column_name")
        .distinct()
    )


# Documentation records -----------------------------------------------------------------


def find_documentation(records: DataFrame, table: str | None = None) -> DataFrame:
    """Documented columns of one table, by full name and ignoring case.

    Of several records with the name the first one counts, by document and place in it.
    Without a name the records must describe a single table.
    """
    if table is not None:
        found = records.filter(F.lower("full_table_name") == clean_full_name(table).lower())
        order = [name for name in ("document", "place") if name in records.columns]
        if not order:
            return found
        first = found.agg(F.min(F.struct(*order)).alias("first"))
        return found.join(first, F.struct(*(found[name] for name in order)) == F.col("first")).drop("first")
    if len(records.select("full_table_name").distinct().take(2)) > 1:
        raise ValueError("a table name is needed: the records describe several tables")
    return records


def documentation_fingerprint(records: DataFrame) -> DataFrame:
    """``target:md5`` per table, over its columns, their order, types and descriptions.

    The columns' hashes are added up before the last MD5, so no table is gathered as a list.
    """
    target = F.concat_ws(".", "catalog", "schema", "table_name")
    column = F.concat_ws(
        "\u001f",
        F.col("position").cast("string"),
        "column_name",
        "data_type",
        F.coalesce("description", F.lit("")),
    )
    bits = F.conv(F.substring(F.md5(column), 1, 15), 16, 10).cast("decimal(38,0)")
    return (
        records.withColumn("target", target)
        .groupBy("target")
        .agg(
            F.sum(bits).cast("string").alias("columns"),
            F.max(F.coalesce("table_description", F.lit(""))).alias("described"),
        )
        .select(
            "target",
            F.concat_ws(":", "target", F.md5(F.concat_ws("\u001f", "described", "columns"))).alias("fingerprint"),
        )
    )
