"""Primary keys, foreign keys, their scores, and FACT or DIM classification."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.names import NAME_PARTS, last_part
from tablescope.functions.similarity import partial_ratio
from tablescope.functions.types import is_numeric_name
from tablescope.operators.graph import LineageGraph
from tablescope.operators.paths import lineage_distances
from tablescope.operators.profile import COLUMN_KEY, LANE_NAMES, long_values, value_counts
from tablescope.operators.quantiles import weighted_quantiles
from tablescope.workspace import written

# Thresholds and weights of the key rules.
PK_MIN_UNIQUENESS = 0.95
PK_MAX_NULLS = 0.05
FK_MAX_NULLS = 0.5
FK_MIN_NAME_SCORE = 70
FK_FIRST_CONFIDENCE = 0.8
CONNECTED_CONFIDENCE = 0.5
SCORE_BASE, NAMING_WEIGHT, SEMANTIC_SCORE, LINEAGE_SCORE, SCORE_CAP = 0.5, 0.2, 0.2, 0.1, 0.99
NEAR_LINEAGE = 2
# Pairs of columns with one pair of names that a task may well read.
FREQUENT_NAMES = 1_000_000
FK_WEIGHT, DIM_WEIGHT, NUMERIC_WEIGHT = 0.5, 0.3, 0.2


def detect_primary_keys(profile: DataFrame) -> DataFrame:
    """Columns that are nearly unique and hardly ever null; a null ratio fails."""
    return profile.filter(
        (F.col("uniqueness_ratio") > PK_MIN_UNIQUENESS) & (F.col("null_ratio") < PK_MAX_NULLS)
    )


def restrict_to(profile: DataFrame, tables: DataFrame) -> DataFrame:
    """Profile rows of the given tables (column ``table``)."""
    return profile.join(tables.select(F.col("table").alias("full_name")), "full_name", "left_semi")


def keys_with_profile(keys: DataFrame, profile: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Primary-key columns, of the given tables if any, next to their profile rows."""
    if tables is not None:
        keys = restrict_to(keys, tables)
    names = [*NAME_PARTS, "column_name"]
    rest = [c for c in profile.columns if c not in names and c not in keys.columns]
    return keys.join(profile.select(*names, *rest), names, "left")


def fk_candidates(
    profile: DataFrame, keys: DataFrame, families: DataFrame, frequent_names: int = FREQUENT_NAMES
) -> DataFrame:
    """Column pairs that may be a foreign key and the primary key it refers to.

    Columns meet the keys of their own family, rows ``(root, member)``, by type; columns with
    more values than the key go before names are compared, and each distinct pair of names is
    compared once. ``families`` need only hold the roots that are asked for.
    """
    columns = profile.filter(F.col("null_ratio") <= FK_MAX_NULLS).select(
        F.col("full_name").alias("target_table"),
        F.col("ordinal_position").alias("fk_position"),
        F.col("column_name").alias("fk_column"),
        "data_type",
        F.col("distinct_count").alias("fk_distinct"),
    )
    key_side = keys.select(
        F.col("full_name").alias("dimension_table"),
        F.col("ordinal_position").alias("pk_position"),
        F.col("column_name").alias("pk_column"),
        "data_type",
        F.col("distinct_count").alias("pk_distinct"),
    )
    relatives = families.filter(F.col("root") != F.col("member")).select(
        F.col("root").alias("target_table"), F.col("member").alias("dimension_table")
    )
    pairs = (
        relatives.join(key_side, "dimension_table")
        .join(columns, ["target_table", "data_type"])
        .filter(F.col("fk_distinct") <= F.col("pk_distinct"))
        .drop("pk_distinct")
    )
    pairs = written(pairs, "fk-pairs")
    names = pairs.groupBy("fk_column", "pk_column").agg(F.count(F.lit(1)).alias("uses"))
    names = names.withColumn("name_score", partial_ratio("fk_column", "pk_column"))
    names = written(names.filter(F.col("name_score") >= FK_MIN_NAME_SCORE), "fk-names")
    # All pairs of one frequent pair of names would meet in one task. There are few such, at most one
    # for so many pairs, so they go to the pairs; the pairs of the others go to their names.
    frequent = names.filter(F.col("uses") > frequent_names).drop("uses")
    by_name = ["fk_column", "pk_column"]
    met = pairs.join(F.broadcast(frequent), by_name)
    rest = pairs.join(F.broadcast(frequent.select(by_name)), by_name, "left_anti")
    return met.unionByName(rest.join(names.filter(F.col("uses") <= frequent_names).drop("uses"), by_name))


def contained(candidates: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Candidates whose foreign-key values all occur in the key column.

    All candidates are tested in one anti join of all distinct values, read from the
    candidates' columns only. A null among the values counts as unmatched.
    """
    fk, pk = ["target_table", "fk_position"], ["dimension_table", "pk_position"]
    pairs = candidates.select(*fk, *pk).distinct()
    fk_names = _named(candidates, "target_table", "fk_column")
    pk_names = _named(candidates, "dimension_table", "pk_column")
    if not fk_names:
        return candidates
    value = F.struct(*LANE_NAMES).alias("value")
    fk_columns = candidates.select(
        F.col("target_table").alias("full_name"), F.col("fk_position").alias("ordinal_position")
    ).distinct()
    values = value_counts(tables, fk_names).join(fk_columns, COLUMN_KEY, "left_semi")
    values = values.select(*COLUMN_KEY, value).withColumnsRenamed(dict(zip(COLUMN_KEY, fk)))
    wanted = values.join(pairs, fk)
    pk_columns = pairs.select(*(F.col(a).alias(b) for a, b in zip(pk, COLUMN_KEY))).distinct()
    held = long_values(tables, pk_names).filter(_some_lane()).join(pk_columns, COLUMN_KEY, "left_semi")
    held = held.select(*COLUMN_KEY, value).withColumnsRenamed(dict(zip(COLUMN_KEY, pk)))
    # Equal types share one lane. A null value has all lanes empty and stays unmatched.
    unmatched = wanted.join(held, [*pk, "value"], "left_anti")
    return candidates.join(unmatched.select(*fk, *pk).distinct(), [*fk, *pk], "left_anti")


def _named(candidates: DataFrame, table: str, column: str) -> dict[str, set[str]]:
    """The candidates' columns by table: one row per table, no longer than its list of columns."""
    lists = candidates.groupBy(F.col(table).alias("table")).agg(F.collect_set(column).alias("names"))
    return {row["table"]: set(row["names"]) for row in lists.collect()}


def _some_lane() -> Column:
    some = F.lit(False)
    for lane in LANE_NAMES:
        some = some | F.col(lane).isNotNull()
    return some


def detect_foreign_keys(
    profile: DataFrame,
    tables: Mapping[str, DataFrame],
    families: DataFrame,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Foreign keys of all roots of ``families`` at once: family, candidates, containment."""
    keys = detect_primary_keys(profile) if keys is None else keys
    candidates = written(fk_candidates(profile, keys, families), "fk-candidates")
    found = contained(candidates, tables)
    return found.select("target_table", "fk_column", "dimension_table", "pk_column", "name_score")


def relation_owners(relations: DataFrame, columns: DataFrame) -> DataFrame:
    """Relations next to the tables that own their two columns; both must be known.

    ``columns`` holds each ``id`` once, as a stored table: both sides of each join then come
    straight from a shuffle, and a key column with a third of all relations is split.
    """
    owner = columns.select("id", "full_name")
    return relations.join(owner.withColumnsRenamed({"id": "pk", "full_name": "dimension"}), "pk").join(
        owner.withColumnsRenamed({"id": "fk", "full_name": "fact"}), "fk"
    )


def score_foreign_keys(
    relations: DataFrame, columns: DataFrame, graph: LineageGraph | None = None
) -> DataFrame:
    """``(fk, pk)`` with naming, semantic and lineage scores and the confidence they give.

    Without a graph the lineage term is off.
    """
    owned = relation_owners(relations.select("fk", "pk").distinct(), columns)
    owned = owned.withColumns({"fk_name": last_part("fk"), "pk_name": last_part("pk")})
    if graph is not None:
        owned = written(owned, "relations")
    names = owned.select("fk_name", "pk_name").distinct()
    names = names.withColumn("naming_score", partial_ratio("fk_name", "pk_name") / 100)
    scored = owned.join(names, ["fk_name", "pk_name"])
    if graph is None:
        scored = scored.withColumn("lineage_score", F.lit(0.0))
    else:
        pairs = owned.select(F.col("dimension").alias("source"), F.col("fact").alias("target"))
        near = lineage_distances(graph, pairs, NEAR_LINEAGE).withColumnsRenamed(
            {"source": "dimension", "target": "fact"}
        )
        score = F.when(F.col("distance") <= NEAR_LINEAGE, LINEAGE_SCORE).otherwise(0.0)
        scored = scored.join(near, ["dimension", "fact"]).withColumn("lineage_score", score)
    total = F.lit(SCORE_BASE) + F.col("naming_score") * NAMING_WEIGHT + SEMANTIC_SCORE + F.col("lineage_score")
    return scored.select(
        "fk",
        "pk",
        "fact",
        "dimension",
        F.least(total, F.lit(SCORE_CAP)).alias("confidence"),
        "naming_score",
        F.lit(SEMANTIC_SCORE).alias("semantic_score"),
        "lineage_score",
    )


def numeric_density(profile: DataFrame) -> DataFrame:
    """Per table: numeric columns over the square root of all columns."""
    counted = profile.groupBy("full_name").agg(
        F.count("column_name").alias("total_columns"),
        F.count_if(is_numeric_name("data_type")).alias("numeric_columns"),
    )
    return counted.withColumn("numeric_density", F.col("numeric_columns") / F.sqrt("total_columns"))


def fk_connectivity(relations: DataFrame, columns: DataFrame) -> DataFrame:
    """Per fact: distinct foreign-key columns and dimensions of its confident relations."""
    confident = relations.filter(F.col("confidence") > CONNECTED_CONFIDENCE).select("fk", "pk")
    # The owners leave the rows of a foreign key together: it is counted at its first row there, and
    # only facts and dimensions move on.
    first = F.row_number().over(Window.partitionBy("fk").orderBy("dimension")) == 1
    met = relation_owners(confident, columns).withColumn("first", first.cast("int"))
    dimensions = met.groupBy("fact", "dimension").agg(F.sum("first").alias("fk_columns"))
    return dimensions.groupBy(F.col("fact").alias("full_name")).agg(
        F.sum("fk_columns").alias("fk_columns"), F.count("dimension").alias("dim_connections")
    )


def median_of(df: DataFrame, column: str) -> float | None:
    """Exact median of a column: the mean of the middle two values."""
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    row = weighted_quantiles(written(values, "scores"), [], [0.5]).first()
    return None if row is None else row["value"]


def fact_scores(profile: DataFrame, relations: DataFrame, columns: DataFrame) -> DataFrame:
    """Numeric density and foreign-key connectivity of each table, weighed to one score."""
    scored = (
        numeric_density(profile)
        .join(fk_connectivity(relations, columns), "full_name", "left")
        .fillna(0, ["fk_columns", "dim_connections"])
    )
    return scored.withColumn(
        "fact_score",
        F.col("fk_columns") * FK_WEIGHT
        + F.col("dim_connections") * DIM_WEIGHT
        + F.col("numeric_density") * NUMERIC_WEIGHT,
    )


def classify_tables(profile: DataFrame, relations: DataFrame, columns: DataFrame) -> DataFrame:
    """FACT where the score is above the median of all tables, else DIM."""
    scored = written(fact_scores(profile, relations, columns), "fact-scores")
    threshold = F.lit(median_of(scored, "fact_score")).cast("double")
    kind = F.when(F.col("fact_score") > threshold, "FACT").otherwise("DIM")
    return scored.withColumn("table_type", kind)
