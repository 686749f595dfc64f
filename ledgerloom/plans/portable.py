"""Result columns in a form every engine prints alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def portable(df: DataFrame) -> DataFrame:
    """Dates, times, decimals and flags as text; nested values as JSON text."""

    def column(field: T.StructField):
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(field.name)
        if isinstance(kind, (T.DateType, T.DecimalType, T.BooleanType)):
            return c.cast("string").alias(field.name)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            return F.array_join(c, "|").alias(field.name)
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(c).alias(field.name)
        return c

    return df.select(*[column(f) for f in df.schema.fields])
