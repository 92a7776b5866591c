"""Documentation records from nested JSON of any shape.

A document is a tree that holds table records somewhere. All documents are walked
together, one level per step, with the catalog, schema and key that a node inherits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.workspace import written


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(document, text)`` per JSON file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("document"), F.col("value").alias("text")
    )


def _text(node: str, *paths: str) -> Column:
    """The first non-empty string under the given members of a variant."""
    return F.coalesce(
        *(F.nullif(F.try_variant_get(node, f"$.{path}", "string"), F.lit("")) for path in paths)
    )


def _is_object(node) -> Column:
    """Whether a variant has members; only its own level is read."""
    return F.try_variant_get(node, "$", "map<string,variant>").isNotNull()


def _is_array(node) -> Column:
    return F.try_variant_get(node, "$", "array<variant>").isNotNull()


def documentation_records(documents: DataFrame, document: str = "document", text: str = "text") -> DataFrame:
    """One row per documented column: catalog, schema, table, full name, column, type.

    A node is a table record if it has columns, and a catalog, schema and name of its own
    or inherited. The name comes from ``table_name``, the table block, ``full_table_name``,
    a three-part key, or ``name``. A table block may be a record by itself as well as
    through its parent, so equal rows are merged. ``place`` orders the records of a document
    as they stand in it.
    """
    spark = documents.sparkSession
    level = documents.select(
        F.col(document).alias("document"),
        F.try_parse_json(text).alias("node"),
        F.lit(None).cast("string").alias("inherited_key"),
        F.lit(None).cast("string").alias("inherited_catalog"),
        F.lit(None).cast("string").alias("inherited_schema"),
        F.lit("").alias("place"),
    ).filter(F.col("node").isNotNull())
    records = None
    while True:
        level = written(level, "documents")
        if level.isEmpty():
            break
        found = _records(spark, level)
        records = found if records is None else records.unionByName(found)
        level = _children(spark, level)
    records = _records(spark, level) if records is None else records
    return records.groupBy(*(c for c in records.columns if c != "place")).agg(F.min("place").alias("place"))


def _children(spark: SparkSession, level: DataFrame) -> DataFrame:
    level = level.filter(_is_object("node") | _is_array("node"))
    exploded = level.withColumn("is_object", _is_object("node")).lateralJoin(
        spark.tvf.variant_explode(F.col("node").outer())
    )
    own = F.col("is_object")
    return exploded.filter(_is_object("value") | _is_array("value")).select(
        "document",
        F.col("value").alias("node"),
        F.when(own, F.col("key")).otherwise(F.col("inherited_key")).alias("inherited_key"),
        F.when(own, F.coalesce(_string("catalog"), F.col("inherited_catalog")))
        .otherwise(F.col("inherited_catalog"))
        .alias("inherited_catalog"),
        F.when(own, F.coalesce(_string("schema"), F.col("inherited_schema")))
        .otherwise(F.col("inherited_schema"))
        .alias("inherited_schema"),
        F.concat_ws(".", "place", F.lpad(F.col("pos").cast("string"), 9, "0")).alias("place"),
    )


def _string(member: str) -> Column:
    """A member of the node, if it is a string."""
    value = F.try_variant_get("node", f"$.{member}", "variant")
    plain = ~_is_object(value) & ~_is_array(value)
    text = F.try_variant_get("node", f"$.{member}", "string")
    return F.when(plain, F.when(F.schema_of_variant(value) == "STRING", text))


def _records(spark: SparkSession, level: DataFrame) -> DataFrame:
    full = F.coalesce(
        _text("node", "full_table_name"),
        F.when(F.size(F.split("inherited_key", r"\.")) == 3, F.col("inherited_key")),
    )
    parts = F.split(F.col("full"), r"\.")
    named = F.size(parts) >= 3
    table_block = F.try_variant_get("node", "$.table", "variant")
    candidates = (
        level.filter(_is_object("node"))
        .withColumn("full", full)
        .withColumn("block", F.when(_is_object(table_block), table_block))
        .select(
            "document",
            "place",
            F.coalesce(
                _text("node", "catalog"), F.col("inherited_catalog"), F.when(named, F.get(parts, 0))
            ).alias("catalog"),
            F.coalesce(
                _text("node", "schema"), F.col("inherited_schema"), F.when(named, F.get(parts, 1))
            ).alias("schema"),
            F.coalesce(
                _text("node", "table_name"),
                _text("block", "table_name"),
                F.when(named, F.element_at(parts, -1)),
                _text("node", "name"),
            ).alias("table_name"),
            F.coalesce(_text("block", "table_description"), _text("node", "table_description")).alias(
                "table_description"
            ),
            "full",
            F.coalesce(
                F.try_variant_get("block", "$.columns", "variant"),
                F.try_variant_get("node", "$.columns", "variant"),
            ).alias("columns"),
        )
        .filter(_is_array("columns"))
        .filter("catalog is not null and schema is not null and table_name is not null")
        .withColumn(
            "full_table_name",
            F.coalesce("full", F.concat_ws(".", "catalog", "schema", "table_name")),
        )
    )
    items = candidates.lateralJoin(spark.tvf.variant_explode(F.col("columns").outer()))
    return (
        items.filter(_is_object("value"))
        .select(
            "document",
            "place",
            "catalog",
            "schema",
            "table_name",
            "full_table_name",
            "table_description",
            F.col("pos").alias("position"),
            _text("value", "column_name", "name").alias("column_name"),
            F.coalesce(_text("value", "data_type", "type"), F.lit("")).alias("data_type"),
            F.coalesce(_text("value", "description", "summary"), F.lit("")).alias("description"),
        )
        .filter(F.col("column_name").isNotNull())
    )
