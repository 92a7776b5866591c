"""Three-part table names ``catalog.schema.table`` and column ids.

A name is split at most twice, so the table part may itself contain dots.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME_PARTS = ("catalog_name", "schema_name", "table_name")


def full_name(catalog="catalog_name", schema="schema_name", table="table_name") -> Column:
    """Three columns joined to one name; null if any part is null."""
    return F.concat(F.col(catalog), F.lit("."), F.col(schema), F.lit("."), F.col(table))


def column_id(table="full_name", column="column_name") -> Column:
    return F.concat(F.col(table), F.lit("."), F.col(column))


def name_parts(name) -> list[Column]:
    """Catalog, schema and table of a full name; null where a part is missing."""
    parts = F.split(F.col(name) if isinstance(name, str) else name, r"\.", 3)
    return [F.get(parts, i).alias(part) for i, part in enumerate(NAME_PARTS)]


def last_part(name) -> Column:
    return F.substring_index(F.col(name) if isinstance(name, str) else name, ".", -1)


def is_three_part(name) -> Column:
    """Exactly three dot-separated parts."""
    return F.size(F.split(F.col(name) if isinstance(name, str) else name, r"\.")) == 3


# Three parts that are not empty, apart from white space around them; the last may hold dots.
_THREE_PARTS = re.compile(r"\s*([^.]*[^.\s])\s*\.\s*([^.]*[^.\s])\s*\.\s*(.*\S)\s*", re.DOTALL)


def clean_full_name(name: str) -> str:
    """A name as a user gives it, quoted or not, as ``catalog.schema.table``."""
    found = _THREE_PARTS.fullmatch(name.translate({ord("`"): None}))
    if found is None:
        raise ValueError(f"expected catalog.schema.table, got {name!r}")
    return ".".join(found.groups())


def has_full_name(df: DataFrame, name: str) -> DataFrame:
    """Rows whose three name columns spell ``name``; the equalities reach the scan."""
    for column, part in zip(NAME_PARTS, clean_full_name(name).split(".", 2)):
        df = df.filter(F.col(column) == part)
    return df
