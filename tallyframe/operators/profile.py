"""Profiles of the data in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.types import varchar_size
from tallyframe.functions.values import quoted


def string_profile(df: DataFrame) -> DataFrame:
    """Longest text per string column, all columns in one scan; columns without text are left out."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, max_length int")
    longest = df.agg(*[F.max(F.length(F.col(quoted(n)))).alias(n) for n in names])
    entries = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(quoted(n)).alias("max_length")) for n in names])
    return longest.select(F.inline(entries)).filter("max_length > 0")


def varchar_sizing(profile: DataFrame) -> DataFrame:
    """Column size per profiled column."""
    return profile.withColumn("varchar_size", varchar_size(F.col("max_length")))
