"""Registered key-inference, classification and star queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.similarity import partial_ratio
from tablescope.operators import keys, lineage, star
from tablescope.operators.graph import LineageGraph
from tablescope.operators.profile import data_profile
from tablescope.plans import inputs
from tablescope.plans.inputs import STAR_COLUMNS, STAR_LINEAGE, star_name, star_sql_table
from tablescope.plans.registry import Tables, query
from tablescope.workspace import written

RATIOS = "round(null_ratio, 6) AS null_ratio, round(uniqueness_ratio, 6) AS uniqueness_ratio"
IS_KEY = "uniqueness_ratio > 0.95 AND null_ratio < 0.05"
PROFILE = "WITH RECURSIVE " + inputs.PROFILE_SQL.strip()


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("null_ratio", "uniqueness_ratio")})


@query(
    "f13_primary_keys",
    PROFILE + f" SELECT full_name, column_name, data_type, row_count, distinct_count, {RATIOS} FROM profile WHERE {IS_KEY}",
)
def f13(t: Tables) -> DataFrame:
    found = keys.detect_primary_keys(data_profile(inputs.star_tables(t)))
    return _rounded(found).select(
        "full_name", "column_name", "data_type", "row_count", "distinct_count", "null_ratio", "uniqueness_ratio"
    )


# Lineage among the star tables, spelled in SQL, and the family of each table.
STAR_EDGES_SQL = "star_edges(source, target) AS (VALUES " + ", ".join(
    f"('{star_name(a)}', '{star_name(b)}')" for a, b in STAR_LINEAGE
) + ")"
FAMILIES_SQL = (
    STAR_EDGES_SQL
    + ", star_roots(root) AS (VALUES "
    + ", ".join(f"('{star_name(x)}')" for x in STAR_COLUMNS)
    + """),
  up(root, node) AS (SELECT root, root FROM star_roots UNION
    SELECT up.root, e.source FROM up JOIN star_edges e ON e.target = up.node),
  down(root, node) AS (SELECT root, root FROM star_roots UNION
    SELECT down.root, e.target FROM down JOIN star_edges e ON e.source = down.node),
  families AS (
    SELECT root, node AS member FROM up UNION SELECT root, node FROM down UNION
    SELECT p.target, s.target FROM star_edges p JOIN star_edges s ON s.source = p.source)"""
)

LCS = """list_reduce(range(1, len({a}) + 1), lambda prev, i:
    list_reduce(range(1, len({w}) + 1), lambda acc, j: list_append(acc,
      CASE WHEN substr({a}, i, 1) = substr({w}, j, 1) THEN prev[j] + 1
           ELSE greatest(acc[j], prev[j + 1]) END), [0::BIGINT]),
    list_transform(range(0, len({w}) + 1), lambda z: 0::BIGINT))[-1]"""


def scores_sql(pairs: str) -> str:
    """CTE ``scores(a, b, score)`` of partial ratios; ``pairs`` selects ``a`` and ``b``."""
    lcs = LCS.format(a="short", w="piece")
    return f"""
  name_pairs AS (SELECT DISTINCT a, b FROM ({pairs})),
  sides AS (
    SELECT a, b, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS short,
           CASE WHEN len(a) <= len(b) THEN b ELSE a END AS long FROM name_pairs
    UNION SELECT a, b, b, a FROM name_pairs WHERE len(a) = len(b)
  ),
  windows AS (
    SELECT DISTINCT a, b, short, substr(long, i::INTEGER, len(short)) AS piece
    FROM (SELECT *, unnest(range(1, len(long) + 1)) AS i FROM sides)
    UNION
    SELECT DISTINCT a, b, short, substr(long, 1, i::INTEGER)
    FROM (SELECT *, unnest(range(1, len(short) + 1)) AS i FROM sides)
  ),
  scores AS (
    SELECT a, b, max(200.0::DOUBLE * {lcs} / (len(short) + len(piece))) AS score FROM windows GROUP BY a, b
  )"""


def _pairs_sql() -> str:
    return """
  cheap_pairs AS (
    SELECT f.full_name AS target_table, f.column_name AS fk_column,
           k.full_name AS dimension_table, k.column_name AS pk_column
    FROM profile f
    JOIN families m ON m.root = f.full_name AND m.member <> m.root
    JOIN profile k ON k.full_name = m.member AND k.data_type = f.data_type
    WHERE k.uniqueness_ratio > 0.95 AND k.null_ratio < 0.05
      AND f.distinct_count <= k.distinct_count AND f.null_ratio <= 0.5
  )"""


CANDIDATES_SQL = (
    PROFILE
    + ", "
    + FAMILIES_SQL
    + ", "
    + _pairs_sql()
    + ", "
    + scores_sql("SELECT fk_column AS a, pk_column AS b FROM cheap_pairs")
    + """,
  candidates AS (
    SELECT target_table, fk_column, dimension_table, pk_column, round(score, 6) AS name_score
    FROM cheap_pairs JOIN scores ON a = fk_column AND b = pk_column WHERE score >= 70
  )"""
)


def _values_sql() -> str:
    parts = [
        f"SELECT DISTINCT '{star_name(table)}' AS full_name, '{column}' AS column_name,"
        f" CAST({column} AS VARCHAR) AS value FROM {star_sql_table(table)}"
        for table, columns in STAR_COLUMNS.items()
        for column in columns
    ]
    return "all_values AS (" + " UNION ALL ".join(parts) + ")"


FOREIGN_KEYS_SQL = (
    CANDIDATES_SQL
    + ", "
    + _values_sql()
    + """,
  unmatched AS (
    SELECT DISTINCT c.target_table, c.fk_column, c.dimension_table, c.pk_column
    FROM candidates c JOIN all_values f ON f.full_name = c.target_table AND f.column_name = c.fk_column
    LEFT JOIN all_values k ON k.full_name = c.dimension_table AND k.column_name = c.pk_column AND k.value = f.value
    WHERE k.value IS NULL
  ),
  foreign_keys AS (SELECT * FROM candidates ANTI JOIN unmatched
    USING (target_table, fk_column, dimension_table, pk_column))"""
)


class Star:
    """Profile, keys and families of the star tables, computed once per query."""

    def __init__(self, t: Tables):
        self.t = t
        self.star = inputs.star_tables(t)
        self.profile = written(data_profile(self.star), "profile")
        self.keys = keys.detect_primary_keys(self.profile)
        with LineageGraph(inputs.star_edges(t)) as graph:
            self.families = lineage.families(graph, inputs.star_roots(t))

    def candidates(self) -> DataFrame:
        return written(keys.fk_candidates(self.profile, self.keys, self.families), "candidates")

    def foreign_keys(self) -> DataFrame:
        return keys.detect_foreign_keys(self.profile, self.star, self.families, self.keys)

    def nodes(self) -> tuple[DataFrame, DataFrame]:
        return inputs.star_nodes(self.t, self.profile)


PAIR = ["target_table", "fk_column", "dimension_table", "pk_column"]


@query(
    "f12_family_profile",
    PROFILE
    + ", "
    + FAMILIES_SQL
    + " SELECT full_name, column_name, data_type, distinct_count FROM profile"
    + f" WHERE full_name IN (SELECT member FROM families WHERE root = '{star_name('customer')}')",
)
def f12(t: Tables) -> DataFrame:
    found = Star(t)
    family = found.families.filter(F.col("root") == star_name("customer")).select(
        F.col("member").alias("table")
    )
    return keys.restrict_to(found.profile, family).select(
        "full_name", "column_name", "data_type", "distinct_count"
    )


@query(
    "j1_keys_in_family",
    PROFILE
    + ", "
    + FAMILIES_SQL
    + f" SELECT full_name, column_name, data_type, distinct_count, {RATIOS} FROM profile"
    + f" WHERE {IS_KEY} AND full_name IN (SELECT member FROM families WHERE root = '{star_name('supplier')}')",
)
def j1(t: Tables) -> DataFrame:
    found = Star(t)
    family = found.families.filter(F.col("root") == star_name("supplier")).select(
        F.col("member").alias("table")
    )
    marked = found.keys.select("full_name", "catalog_name", "schema_name", "table_name", "column_name")
    joined = keys.keys_with_profile(marked, found.profile, family)
    return _rounded(joined).select(
        "full_name", "column_name", "data_type", "distinct_count", "null_ratio", "uniqueness_ratio"
    )


@query("j2_fk_candidates", CANDIDATES_SQL + " SELECT * FROM candidates")
def j2(t: Tables) -> DataFrame:
    return Star(t).candidates().select(*PAIR, F.round("name_score", 6).alias("name_score"))


# A catalog that grows with the data: each part is a table of three columns below the table
# numbered by a quarter of its key.
MANY_TABLES_SQL = """WITH RECURSIVE links AS (
    SELECT p_partkey AS child, p_partkey // 4 AS parent FROM part WHERE p_partkey >= 4),
  up(root, node) AS (SELECT p_partkey, p_partkey FROM part UNION ALL
    SELECT root, parent FROM up JOIN links ON child = node),
  families AS (
    SELECT root, node AS member FROM up UNION SELECT node, root FROM up UNION
    SELECT a.child, b.child FROM links a JOIN links b USING (parent)),
  columns AS (
    SELECT p_partkey AS k, unnest(['key', 'part_key', 'note']) AS name,
      unnest([p_size * 10, p_size * 7, 3]) AS n, unnest([1.0, 0.2, 0.1]) AS uniqueness FROM part)
  SELECT 'lake.parts.t' || f.k AS target_table, f.name AS fk_column, 'lake.parts.t' || p.k AS dimension_table,
    p.name AS pk_column FROM columns f JOIN families ON root = f.k AND member <> root
  JOIN columns p ON p.k = member AND p.name = 'key' WHERE f.n <= p.n AND f.name <> 'note'"""


@query("j2_candidates_of_many_tables", MANY_TABLES_SQL)
def j2_many(t: Tables) -> DataFrame:
    name = lambda key: F.concat(F.lit("lake.parts.t"), key.cast("string"))

    def column(position: int, label: str, distinct, uniqueness: float):
        return F.struct(
            F.lit(position).alias("ordinal_position"),
            F.lit(label).alias("column_name"),
            F.lit("LONG").alias("data_type"),
            distinct.cast("bigint").alias("distinct_count"),
            F.lit(uniqueness).alias("uniqueness_ratio"),
            F.lit(0.0).alias("null_ratio"),
        )

    size = F.col("p_size")
    listed = [column(1, "key", size * 10, 1.0), column(2, "part_key", size * 7, 0.2), column(3, "note", F.lit(3), 0.1)]
    profile = written(
        t["part"].select(name(F.col("p_partkey")).alias("full_name"), F.inline(F.array(*listed))), "many-profiles"
    )
    child = F.col("p_partkey")
    links = t["part"].filter(child >= 4).select(
        name(F.floor(child / 4).cast("bigint")).alias("source"), name(child).alias("target")
    )
    marked = keys.detect_primary_keys(profile)
    with LineageGraph(links) as graph:
        roots = t["part"].select(name(child).alias("root"))
        members = marked.select(F.col("full_name").alias("member"))
        found = lineage.families(graph, roots, members)
        return written(keys.fk_candidates(profile, marked, found).select(*PAIR), "many-candidates")


@query("j3_containment", FOREIGN_KEYS_SQL + " SELECT target_table, fk_column, dimension_table, pk_column FROM foreign_keys")
def j3(t: Tables) -> DataFrame:
    found = Star(t)
    return keys.contained(found.candidates(), found.star).select(*PAIR)


@query("i2_foreign_keys", FOREIGN_KEYS_SQL + " SELECT * FROM foreign_keys")
def i2(t: Tables) -> DataFrame:
    return Star(t).foreign_keys().withColumn("name_score", F.round("name_score", 6))


NAME_PAIRS_SQL = """
  SELECT DISTINCT p_name || '_' || lower(p_type) AS a, lower(p_type) || '_' || split_part(p_name, ' ', 2) AS b
  FROM part"""


@query(
    "x1_partial_ratio",
    "WITH " + scores_sql(NAME_PAIRS_SQL).strip() + " SELECT a, b, round(score, 6) AS score FROM scores",
)
def x1(t: Tables) -> DataFrame:
    names = t["part"].select(
        F.concat("p_name", F.lit("_"), F.lower("p_type")).alias("a"),
        F.concat(F.lower("p_type"), F.lit("_"), F.element_at(F.split("p_name", " "), 2)).alias("b"),
    )
    return names.distinct().select("a", "b", F.round(partial_ratio("a", "b"), 6).alias("score"))


# Scores of the inferred relations: lineage is near if the dimension reaches the fact in two steps.
SCORED_SQL = (
    FOREIGN_KEYS_SQL
    + """,
  near AS (SELECT source, target FROM star_edges UNION
    SELECT a.source, b.target FROM star_edges a JOIN star_edges b ON b.source = a.target),
  key_scores AS ("""
    + """
    SELECT a AS fk_name, b AS pk_name, score / 100 AS naming FROM scores),
  scored AS (
    SELECT f.target_table || '.' || f.fk_column AS fk, f.dimension_table || '.' || f.pk_column AS pk,
           f.target_table AS fact, f.dimension_table AS dimension, naming,
           CASE WHEN n.source IS NULL THEN 0.0 ELSE 0.1 END::DOUBLE AS lineage
    FROM foreign_keys f JOIN key_scores ON fk_name = f.fk_column AND pk_name = f.pk_column
    LEFT JOIN near n ON n.source = f.dimension_table AND n.target = f.target_table)"""
)
CONFIDENCE = "round(least(0.5 + naming * 0.2 + 0.2 + lineage, 0.99)::DOUBLE, 6)"


class Scored(Star):
    """The star's foreign keys, scored."""

    def __init__(self, t: Tables):
        super().__init__(t)
        self.tables, self.columns = (written(df, "nodes") for df in self.nodes())
        detected = self.foreign_keys()
        self.relations = written(
            detected.select(
                F.concat_ws(".", "target_table", "fk_column").alias("fk"),
                F.concat_ws(".", "dimension_table", "pk_column").alias("pk"),
            ),
            "relations",
        )
        with LineageGraph(inputs.star_edges(t)) as graph:
            self.scores = written(keys.score_foreign_keys(self.relations, self.columns, graph), "scores")


@query(
    "i3_fk_scores",
    SCORED_SQL
    + f""" SELECT fk, pk, fact, dimension, {CONFIDENCE} AS confidence, round(naming, 6) AS naming_score,
    0.2::DOUBLE AS semantic_score, lineage AS lineage_score FROM scored""",
)
def i3(t: Tables) -> DataFrame:
    return Scored(t).scores.withColumns(
        {"confidence": F.round("confidence", 6), "naming_score": F.round("naming_score", 6)}
    )


@query(
    "i3_fk_scores_without_lineage",
    SCORED_SQL
    + """ SELECT fk, pk, round(least(0.7 + naming * 0.2, 0.99)::DOUBLE, 6) AS confidence,
    0.0::DOUBLE AS lineage_score FROM scored""",
)
def i3_plain(t: Tables) -> DataFrame:
    found = Scored(t)
    scores = keys.score_foreign_keys(found.relations, found.columns)
    return scores.select("fk", "pk", F.round("confidence", 6).alias("confidence"), "lineage_score")


CLASSIFIED = """,
  density AS (
    SELECT full_name, count(*) AS total_columns,
           count(*) FILTER (WHERE data_type IN ('LONG', 'INTEGER', 'DOUBLE')) AS numeric_columns
    FROM profile GROUP BY full_name),
  connected AS (
    SELECT fact, count(DISTINCT fk) AS fk_columns, count(DISTINCT dimension) AS dim_connections
    FROM scored WHERE least(0.5 + naming * 0.2 + 0.2 + lineage, 0.99) > 0.5 GROUP BY fact),
  weighed AS (
    SELECT full_name, total_columns, numeric_columns, numeric_columns / sqrt(total_columns) AS numeric_density,
           coalesce(fk_columns, 0) AS fk_columns, coalesce(dim_connections, 0) AS dim_connections
    FROM density LEFT JOIN connected ON fact = full_name),
  fact_scores AS (
    SELECT *, fk_columns * 0.5::DOUBLE + dim_connections * 0.3::DOUBLE + numeric_density * 0.2::DOUBLE AS fact_score
    FROM weighed)"""


def _classified(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"numeric_density": F.round("numeric_density", 6), "fact_score": F.round("fact_score", 6)}
    )


@query(
    "i4_table_classes",
    SCORED_SQL
    + CLASSIFIED
    + """ SELECT full_name, total_columns, numeric_columns, round(numeric_density, 6) AS numeric_density,
      fk_columns, dim_connections, round(fact_score, 6) AS fact_score,
      CASE WHEN fact_score > (SELECT median(fact_score) FROM fact_scores) THEN 'FACT' ELSE 'DIM' END AS table_type
    FROM fact_scores""",
)
def i4(t: Tables) -> DataFrame:
    found = Scored(t)
    return _classified(keys.classify_tables(found.profile, found.scores, found.columns))


# The same classification at the grain of the test rows: each order is a table.

WIDE_SQL = (
    "WITH "
    + inputs.INFO_SQL.strip()
    + """,
  numbers AS (
    SELECT catalog_name || '.' || schema_name || '.' || table_name AS full_name, count(*) AS total_columns,
           count(*) FILTER (WHERE data_type IN ('bigint', 'double')) AS numeric_columns
    FROM info_columns GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY catalog_name, schema_name, table_name")
)


def _wide_profile(t: Tables) -> DataFrame:
    names = F.concat_ws(".", "catalog_name", "schema_name", "table_name")
    return inputs.info_columns(t).withColumn("full_name", names)


@query(
    "a1_numeric_density",
    WIDE_SQL
    + " SELECT full_name, total_columns, numeric_columns,"
    " round(numeric_columns / sqrt(total_columns), 6) AS numeric_density FROM numbers",
)
def a1(t: Tables) -> DataFrame:
    found = keys.numeric_density(_wide_profile(t))
    return found.withColumn("numeric_density", F.round("numeric_density", 6))


CONNECTED_SQL = (
    "WITH "
    + inputs.RELATIONS_SQL.strip()
    + """,
  connected AS (
    SELECT fact AS full_name, count(DISTINCT fk) AS fk_columns, count(DISTINCT dimension) AS dim_connections
    FROM relations WHERE confidence > 0.5 GROUP BY fact)"""
)


@query("a2_fk_connectivity", CONNECTED_SQL + " SELECT full_name, fk_columns, dim_connections FROM connected")
def a2(t: Tables) -> DataFrame:
    return keys.fk_connectivity(*inputs.relations_and_columns(t))


@query(
    "a3_median_score",
    CONNECTED_SQL
    + " SELECT round(median(fk_columns * 0.5 + dim_connections * 0.3)::DOUBLE, 6) AS median_score FROM connected",
)
def a3(t: Tables) -> DataFrame:
    scored = a2(t).withColumn("score", F.col("fk_columns") * 0.5 + F.col("dim_connections") * 0.3)
    return t.one.select(F.round(F.lit(keys.median_of(scored, "score")), 6).alias("median_score"))


# Every order has the same three columns here, two of them numeric.
@query(
    "j4_fact_scores",
    CONNECTED_SQL
    + """,
  order_columns AS (
    SELECT 'mart.fact.o' || o_orderkey AS full_name, o_orderstatus FROM orders)
  SELECT full_name, CASE o_orderstatus WHEN 'F' THEN 2 ELSE 3 END::BIGINT AS total_columns,
    CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END::BIGINT AS numeric_columns,
    coalesce(fk_columns, 0) AS fk_columns, coalesce(dim_connections, 0) AS dim_connections,
    round(coalesce(fk_columns, 0) * 0.5::DOUBLE + coalesce(dim_connections, 0) * 0.3::DOUBLE + 0.2::DOUBLE *
      CASE o_orderstatus WHEN 'F' THEN 1 / sqrt(2) ELSE 2 / sqrt(3) END, 6) AS fact_score
  FROM order_columns LEFT JOIN connected USING (full_name)""",
)
def j4(t: Tables) -> DataFrame:
    table = F.concat(F.lit("mart.fact.o"), "o_orderkey").alias("full_name")

    def column(name: str, kind: str):
        return F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("data_type"))

    short = F.array(column("amount", "double"), column("note", "string"))
    long = F.array(column("amount", "double"), column("note", "string"), column("item", "bigint"))
    listed = F.inline(F.when(F.col("o_orderstatus") == "F", short).otherwise(long))
    scored = keys.fact_scores(t["orders"].select(table, listed), *inputs.relations_and_columns(t))
    return scored.withColumn("fact_score", F.round("fact_score", 6)).drop("numeric_density")


# Star navigation ---------------------------------------------------------------------------

STAR_SQL = "WITH " + inputs.RELATIONS_SQL.strip() + ", " + inputs.TABLE_TYPES_SQL.strip()
RELATION_COLUMNS = "fact, dimension, fact_column, dimension_column, confidence"


def _star(t: Tables) -> DataFrame:
    return star.fact_dimensions(*inputs.relations_and_columns(t))


@query("j5_relation_owners", STAR_SQL + " SELECT fk, pk, fact, dimension, confidence FROM relations")
def j5(t: Tables) -> DataFrame:
    return keys.relation_owners(*inputs.relations_and_columns(t)).select(
        "fk", "pk", "fact", "dimension", "confidence"
    )


@query("j6_fact_dimensions", STAR_SQL + f" SELECT {RELATION_COLUMNS} FROM relations")
def j6(t: Tables) -> DataFrame:
    return _star(t)


@query(
    "j7_related_facts",
    STAR_SQL
    + " SELECT DISTINCT dimension, fact FROM relations"
    " WHERE fact IN (SELECT full_name FROM table_types WHERE table_type = 'FACT')",
)
def j7(t: Tables) -> DataFrame:
    return star.related_facts(_star(t), inputs.table_types(t)).select("dimension", "fact")


DIMENSION, FACT = "mart.dim.p5", "mart.fact.o7"
AROUND_DIMENSION = f""", facts AS MATERIALIZED (
  SELECT DISTINCT fact FROM relations JOIN table_types ON full_name = fact AND table_type = 'FACT'
  WHERE dimension = '{DIMENSION}')"""


@query(
    "j8_star_of_dimension",
    STAR_SQL
    + AROUND_DIMENSION
    + """ SELECT fact AS dimension, NULL::VARCHAR AS fact_column, NULL::VARCHAR AS dimension_column,
      NULL::DOUBLE AS confidence FROM facts
    UNION ALL SELECT dimension, fact_column, dimension_column, confidence FROM relations JOIN facts USING (fact)""",
)
def j8(t: Tables) -> DataFrame:
    return star.star_tables(*inputs.relations_and_columns(t), inputs.table_types(t), DIMENSION)


@query(
    "j8_star_of_fact",
    STAR_SQL
    + f""" SELECT dimension, fact_column, dimension_column, confidence FROM relations WHERE fact = '{FACT}'
    AND EXISTS (SELECT 1 FROM table_types WHERE full_name = '{FACT}' AND table_type = 'FACT')""",
)
def j8_fact(t: Tables) -> DataFrame:
    return star.star_tables(*inputs.relations_and_columns(t), inputs.table_types(t), FACT)


@query(
    "j8_star_names",
    STAR_SQL
    + AROUND_DIMENSION
    + " SELECT fact AS dimension FROM facts UNION SELECT dimension FROM relations WHERE fact IN (FROM facts)",
)
def j8_names(t: Tables) -> DataFrame:
    return star.star_table_names(*inputs.relations_and_columns(t), inputs.table_types(t), DIMENSION)


# The report joins lineage, types and star of one table: here an order's supplier.

REPORT = "mart.dim.s3"


@query(
    "g9_table_report",
    "WITH RECURSIVE "
    + inputs.RELATIONS_SQL.strip()
    + ", "
    + inputs.TABLE_TYPES_SQL.strip()
    + f""",
  flows AS (
    SELECT DISTINCT dimension AS source, fact AS target FROM relations
    UNION SELECT DISTINCT 'mart.fact.o' || o_orderkey, 'mart.report.c' || o_custkey FROM orders),
  below(node, dist) AS (
    SELECT '{REPORT}', 0 UNION SELECT f.target, b.dist + 1 FROM below b JOIN flows f ON f.source = b.node),
  facts AS (
    SELECT DISTINCT fact FROM relations JOIN table_types ON full_name = fact AND table_type = 'FACT'
    WHERE dimension = '{REPORT}')
  SELECT 'node' AS section, node AS name, NULL::VARCHAR AS other, coalesce(table_type, 'TABLE') AS detail
  FROM below LEFT JOIN table_types ON full_name = node
  UNION ALL SELECT DISTINCT 'edge', source, target, NULL FROM flows JOIN below ON node = source WHERE dist < 3
  UNION ALL SELECT 'dimension', fact, NULL, NULL FROM facts
  UNION ALL SELECT 'dimension', dimension, fact_column, dimension_column FROM relations JOIN facts USING (fact)
  UNION ALL SELECT 'downstream', node, NULL, NULL FROM below WHERE dist > 0""",
)
def g9(t: Tables) -> DataFrame:
    relations, columns = inputs.relations_and_columns(t)
    orders = t["orders"].select(
        F.concat(F.lit("mart.fact.o"), "o_orderkey").alias("source"),
        F.concat(F.lit("mart.report.c"), "o_custkey").alias("target"),
    )
    owned = star.fact_dimensions(relations, columns)
    flows = owned.select(F.col("dimension").alias("source"), F.col("fact").alias("target"))
    with LineageGraph(flows.unionByName(orders)) as graph:
        report = star.table_report(graph, relations, columns, inputs.table_types(t), REPORT)
        return star.report_rows(report)
