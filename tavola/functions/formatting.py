"""Text rendering of result columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

STAMP = "yyyy-MM-dd HH:mm:ss"
DAY = "yyyy-MM-dd"


def format_datetimes(df: DataFrame) -> DataFrame:
    """Timestamps as `yyyy-MM-dd HH:mm:ss`, dates as `yyyy-MM-dd`; the rest unchanged."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, STAMP)
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, DAY)
        out.append(column.alias(field.name))
    return df.select(*out)


def as_text(df: DataFrame) -> DataFrame:
    """Every column as a string with NULL written as the empty string."""
    shown = format_datetimes(df)
    return shown.select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in shown.columns]
    )


def plain_types(df: DataFrame) -> DataFrame:
    """Widen integers to bigint and decimals to double, and render dates as text."""
    out = []
    for field in format_datetimes(df).schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            column = column.cast("double")
        out.append(column.alias(field.name))
    return format_datetimes(df).select(*out)
