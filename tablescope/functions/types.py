"""Type names used by the rules, and the typed lanes of the long value form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The quality rules' type vocabulary, by Spark type name.
RULE_TYPE_NAMES = {
    "string": "STRING",
    "bigint": "LONG",
    "int": "INTEGER",
    "double": "DOUBLE",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}

# A data type that contains one of these words counts as numeric.
NUMERIC_TYPE_WORDS = ("int", "bigint", "double", "float", "decimal", "numeric")

# LONG and INTEGER are the rule names of BIGINT and INT, so they are numeric too.
_NUMERIC_PATTERN = "(?i)" + "|".join((*NUMERIC_TYPE_WORDS, "^long$"))


def rule_type(data_type: T.DataType) -> str:
    """A Spark type in the rules' vocabulary; other types keep their Spark name."""
    name = data_type.simpleString()
    return RULE_TYPE_NAMES.get(name, name.upper())


def normal_type(name) -> Column:
    """A column of type names brought to the rules' vocabulary."""
    name = F.col(name) if isinstance(name, str) else name
    result = F.upper(name)
    for spark_name, rule_name in RULE_TYPE_NAMES.items():
        result = F.when(F.lower(name) == spark_name, rule_name).otherwise(result)
    return result


def is_numeric_name(name) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.coalesce(name.rlike(_NUMERIC_PATTERN) & ~F.lower(name).startswith("interval"), F.lit(False))


def clean_scalars(df: DataFrame) -> DataFrame:
    """All columns as plain values: NaN becomes null, dates and times become ISO 8601 text."""

    def clean(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            # Fractions are written with six digits, and only where there are any.
            micros = F.date_format(value, ".SSSSSS")
            value = F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == ".000000", "").otherwise(micros))
        elif isinstance(field.dataType, T.DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        return value.alias(field.name)

    return df.select(*(clean(field) for field in df.schema.fields))


LANES = "number bigint, real double, moment timestamp_ntz, words string"


def lanes(df_field: T.StructField) -> list[Column]:
    """One column's value in the lane of its type; the other lanes are null.

    Each mapping is one to one, so grouping by the four lanes groups by the value.
    Spark itself treats -0.0 as 0.0 and all NaN as one when it groups doubles.
    """
    column, kind = F.col(f"`{df_field.name}`"), df_field.dataType
    number, real = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    moment, words = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("string")
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        number = column.cast("bigint") if isinstance(kind, T.IntegralType) else column.cast("int").cast("bigint")
    elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        real = column.cast("double")
    elif isinstance(kind, (T.DateType, T.TimestampNTZType)):
        moment = column.cast("timestamp_ntz")
    elif isinstance(kind, T.TimestampType):
        number = F.unix_micros(column)
    elif isinstance(kind, T.BinaryType):
        words = F.hex(column)
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        words = F.to_json(column)
    else:
        words = column.cast("string")
    return [
        number.alias("number"),
        real.alias("real"),
        moment.alias("moment"),
        words.alias("words"),
    ]


def lane_of(df_field: T.StructField) -> tuple[str, Column]:
    """The name of the lane that a column's values lie in, and the values."""
    kind = df_field.dataType
    if isinstance(kind, (T.IntegralType, T.BooleanType, T.TimestampType)):
        place = 0
    elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        place = 1
    elif isinstance(kind, (T.DateType, T.TimestampNTZType)):
        place = 2
    else:
        place = 3
    return ("number", "real", "moment", "words")[place], lanes(df_field)[place]
