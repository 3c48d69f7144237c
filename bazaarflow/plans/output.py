"""Result columns in types that compare alike across engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def comparable(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and timestamps as text, lists as '|'-joined text."""
    def plain(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return column.cast("double").alias(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return column.cast("string").alias(field.name)
        if isinstance(field.dataType, T.ArrayType):
            return F.array_join(column, "|", "").alias(field.name)
        if isinstance(field.dataType, T.IntegerType):
            return column.cast("bigint").alias(field.name)
        return column

    return df.select(*[plain(f) for f in df.schema.fields])
