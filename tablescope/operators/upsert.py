"""Upserts of node and edge tables, write-backs, and versioned storage.

An upsert is one aggregation by key over the old rows and the new ones together, so it
combines before it shuffles and a key that arrives often is no burden.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.names import NAME_PARTS, column_id, full_name
from tablescope.operators.keys import FK_FIRST_CONFIDENCE

TABLE_METRICS = [
    "table_type",
    "fact_score",
    "numeric_density",
    "numeric_columns",
    "total_columns",
    "fk_columns",
    "dim_connections",
]


def upsert(
    current: DataFrame | None, updates: DataFrame, keys: Sequence[str], version: str | None = None
) -> DataFrame:
    """Rows of ``current`` with ``updates`` merged in by key.

    An absent key is inserted; a present one has the updates' columns overwritten, nulls
    included, and keeps its others. Of several updates of a key the one with the greatest
    ``version`` wins, and then the one with the greatest values.
    """
    keys = list(keys)
    given = [c for c in updates.columns if c not in keys and c != version]
    if current is None:
        current = updates.select(*keys, *given).limit(0)
    types = {f.name: f.dataType for f in updates.schema.fields}
    kept = [c for c in current.columns if c not in keys and c not in given]

    def entry(rank: int, order: Column, values: list[Column]) -> Column:
        return F.struct(F.lit(rank).alias("rank"), order.alias("version"), F.struct(*values).alias("values"))

    marker = F.lit(True).alias("_present")
    order_type = types[version] if version else "int"
    old_values = [
        (F.col(c) if c in current.columns else F.lit(None)).cast(types[c]).alias(c) for c in given
    ]
    old = current.select(
        *keys,
        entry(0, F.lit(None).cast(order_type), [marker, *old_values]).alias("entry"),
        F.struct(marker, *kept).alias("kept"),
    )
    new_order = F.col(version) if version else F.lit(None).cast("int")
    new = updates.select(
        *keys,
        entry(1, new_order, [marker, *(F.col(c) for c in given)]).alias("entry"),
        F.lit(None).cast(old.schema["kept"].dataType).alias("kept"),
    )
    merged = old.unionByName(new).groupBy(*keys).agg(F.max("entry").alias("entry"), F.max("kept").alias("kept"))
    columns = [F.col(f"entry.values.`{c}`").alias(c) for c in given]
    columns += [F.col(f"kept.`{c}`").alias(c) for c in kept]
    order = [c for c in current.columns if c not in keys] + [c for c in given if c not in current.columns]
    return merged.select(*keys, *columns).select(*keys, *order)


def merge_edges(current: DataFrame | None, updates: DataFrame) -> DataFrame:
    """Distinct edges of both frames; edges carry no other columns."""
    updates = updates.dropna()
    return (updates if current is None else current.unionByName(updates)).distinct()


def table_nodes(profile: DataFrame) -> DataFrame:
    """Table rows of a column profile: one per table, with its greatest row count."""
    return profile.groupBy(*NAME_PARTS).agg(F.max("row_count").alias("row_count")).select(
        full_name().alias("full_name"),
        F.col("catalog_name").alias("catalog"),
        F.col("schema_name").alias("schema"),
        F.col("table_name").alias("name"),
        "row_count",
    )


def upsert_tables(tables: DataFrame | None, profile: DataFrame) -> DataFrame:
    return upsert(tables, table_nodes(profile), ["full_name"])


def column_nodes(profile: DataFrame, tables: DataFrame) -> DataFrame:
    """Column rows of a profile, for known tables only."""
    return (
        profile.withColumn("full_name", full_name())
        .join(tables.select("full_name"), "full_name", "left_semi")
        .select(
            column_id().alias("id"),
            "full_name",
            F.col("column_name").alias("name"),
            "data_type",
            "distinct_count",
            "null_ratio",
            "uniqueness_ratio",
        )
    )


def upsert_columns(columns: DataFrame | None, profile: DataFrame, tables: DataFrame) -> DataFrame:
    return upsert(columns, column_nodes(profile, tables), ["id"])


def upsert_lineage_tables(tables: DataFrame, lineage: DataFrame) -> DataFrame:
    """Known tables and, by name alone, the unknown endpoints of lineage edges."""
    ends = lineage.select(F.explode(F.array("source", "target")).alias("full_name")).dropna().distinct()
    unknown = ends.join(tables, "full_name", "left_anti")
    return tables.unionByName(unknown, allowMissingColumns=True)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; an empty answer means the key holds."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def write_back_keys(columns: DataFrame, keys: DataFrame, at: Column) -> DataFrame:
    """Mark primary keys on the column rows, with their uniqueness as confidence."""
    marks = keys.select(
        F.concat(full_name(), F.lit("."), "column_name").alias("id"),
        F.lit(True).alias("is_primary_key"),
        F.col("uniqueness_ratio").cast("double").alias("pk_confidence"),
        F.lit("rule_based").alias("pk_source"),
        at.alias("pk_last_updated"),
    )
    return columns.drop("is_primary_key", "pk_confidence", "pk_source", "pk_last_updated").join(marks, "id", "left")


def new_relations(detected: DataFrame, columns: DataFrame, at: Column) -> DataFrame:
    """Detected foreign keys as relation rows; both columns must be known."""
    known = columns.select("id").distinct()
    return (
        detected.select(
            F.concat_ws(".", "target_table", "fk_column").alias("fk"),
            F.concat_ws(".", "dimension_table", "pk_column").alias("pk"),
        )
        .distinct()
        .join(known.withColumnRenamed("id", "fk"), "fk", "left_semi")
        .join(known.withColumnRenamed("id", "pk"), "pk", "left_semi")
        .select(
            "fk",
            "pk",
            F.lit(FK_FIRST_CONFIDENCE).alias("confidence"),
            F.lit("semantic").alias("relationship_type"),
            F.lit("rule_based").alias("source"),
            at.alias("last_updated"),
        )
    )


def upsert_relations(
    relations: DataFrame | None, detected: DataFrame, columns: DataFrame, at: Column
) -> DataFrame:
    return upsert(relations, new_relations(detected, columns, at), ["fk", "pk"])


def write_back_scores(relations: DataFrame, scores: DataFrame) -> DataFrame:
    """Overwrite confidence and component scores of the relations that were scored."""
    names = ["confidence", "naming_score", "semantic_score", "lineage_score"]
    scored = scores.select("fk", "pk", F.struct(*names).alias("_new"))
    joined = relations.join(scored, ["fk", "pk"], "left")

    def value(name: str) -> Column:
        old = F.col(name) if name in relations.columns else F.lit(None).cast("double")
        return F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(old)

    return joined.withColumns({name: value(name) for name in names}).drop("_new")


def write_back_types(tables: DataFrame, classified: DataFrame) -> DataFrame:
    """Table rows with their type and its metrics."""
    return tables.drop(*TABLE_METRICS).join(classified.select("full_name", *TABLE_METRICS), "full_name", "left")


class VersionedTable:
    """A table kept as numbered Parquet versions; readers see the last complete one.

    A version is complete once Spark has left its ``_SUCCESS`` file, so a failed write is
    never read and the version being read is never overwritten.
    """

    def __init__(self, spark: SparkSession, path: str, file_format: str = "parquet"):
        self.spark, self.path, self.file_format = spark, path.rstrip("/"), file_format

    def _versions(self, pattern: str) -> list[int]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        glob = hadoop.Path(f"{self.path}/{pattern}")
        system = glob.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = system.globStatus(glob)
        names = [status.getPath().toString() for status in found or []]
        return sorted(int(name.split("/version=")[1].split("/")[0]) for name in names)

    def versions(self) -> list[int]:
        return self._versions("version=*/_SUCCESS")

    def read(self, version: int | None = None, schema=None) -> DataFrame | None:
        """The given or the last version; None if there is none."""
        versions = self.versions()
        if not versions:
            return None
        reader = self.spark.read.format(self.file_format)
        if schema is not None:
            reader = reader.schema(schema)
        return reader.load(f"{self.path}/version={versions[-1] if version is None else version}")

    def write(self, df: DataFrame) -> int:
        """Write the next version and return its number."""
        begun = self._versions("version=*")
        version = (begun[-1] if begun else 0) + 1
        df.write.format(self.file_format).save(f"{self.path}/version={version}")
        return version
