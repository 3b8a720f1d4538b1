"""Aggregate checks on a source and a target: counts, nulls, duplicates, sums, averages.

Each side is scanned once. The two one-row results meet by union and a final
aggregate, so nothing is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.values import half_even, quoted, shortened, shown

SAMPLE_ROWS = 100  # report size of every sample list (fixed value)
TOLERANCE = 1e-6  # largest difference of sums and averages that still passes (fixed value)
IDENTIFIER_COLUMNS = ("id", "pk", "uuid", "guid", "key")  # looked for in this order (fixed values)


_FLOATS = (T.DoubleType, T.FloatType)
_LARGE, _HUGE = 1e15, 1e38


def exact_sum(value: Column, dtype: T.DataType) -> Column:
    """The sum as a double that does not depend on the order of the rows, over finite values; NULL without any.

    Floating point numbers go through decimals: their part down to 1e-12, what is left
    below that in units of 1e-15, and numbers from 1e15 on in units of that. Beyond
    1e38, or where a decimal overflows, doubles are added as they are.
    """
    if not isinstance(dtype, T.NumericType):
        raise ValueError(f"no sum over {dtype.simpleString()}")
    plain = F.sum(F.when(_finite(value, dtype), value.cast("double")))
    if not isinstance(dtype, _FLOATS):
        wide = f"decimal(38,{dtype.scale})" if isinstance(dtype, T.DecimalType) else "decimal(38,0)"
        return F.coalesce(F.try_sum(value.cast(wide)).cast("double"), plain)
    x, size = value.cast("double"), F.abs(value.cast("double"))
    near = F.when(size < _LARGE, x)
    part = near.cast("decimal(27,12)")
    low = ((near - part.cast("double")) * _LARGE).cast("decimal(27,12)")
    large = F.when((size >= _LARGE) & (size < _HUGE), x / _LARGE).cast("decimal(38,12)")
    huge = F.sum(F.when((size >= _HUGE) & _finite(value, dtype), x))
    total = lambda c: F.coalesce(F.try_sum(c).cast("double"), F.lit(0.0))
    exact = total(part) + total(low) / _LARGE + total(large) * _LARGE + F.coalesce(huge, F.lit(0.0))
    return F.when(plain.isNotNull(), exact)


def _finite(value: Column, dtype: T.DataType) -> Column:
    if not isinstance(dtype, _FLOATS):
        return value.isNotNull()
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def not_finite(value: Column, dtype: T.DataType) -> Column:
    """How many values are NaN, infinite and minus infinite, as text ``n/n/n``; sums leave these out, so they are compared apart."""
    if not isinstance(dtype, _FLOATS):
        return F.max(F.lit("0/0/0"))
    counts = [F.count_if(F.isnan(value)), *[F.count_if(value == F.lit(sign * float("inf"))) for sign in (1, -1)]]
    return F.concat_ws("/", *[c.cast("string") for c in counts])


def both_sides(source: DataFrame, target: DataFrame, measures) -> DataFrame:
    """One row: every measure as ``source_<name>`` and ``target_<name>``."""
    sides = []
    for tag, df in ((0, source), (1, target)):
        aggregates = measures(df)
        sides.append(df.agg(*[c.alias(n) for n, c in aggregates.items()]).withColumn("_side", F.lit(tag)))
    names = list(aggregates)
    return (
        sides[0]
        .unionByName(sides[1])
        .agg(
            *[F.max(F.when(F.col("_side") == 0, F.col(n))).alias(f"source_{n}") for n in names],
            *[F.max(F.when(F.col("_side") == 1, F.col(n))).alias(f"target_{n}") for n in names],
        )
    )


def _status(passed: Column) -> Column:
    return F.when(passed, "passed").otherwise("failed")


def row_count_result(source_count: Column, target_count: Column) -> list[Column]:
    difference = F.abs(source_count - target_count)
    share = (
        F.when((source_count == 0) & (target_count == 0), 0.0)
        .when(source_count == 0, 100.0)
        .otherwise(half_even(F.try_divide(difference.cast("double"), source_count.cast("double")) * 100, 5))
    )
    return [
        source_count.alias("source_count"),
        target_count.alias("target_count"),
        difference.alias("difference"),
        share.alias("percentage_difference"),
        _status(difference == 0).alias("status"),
    ]


def rowcount_parity(source: DataFrame, target: DataFrame) -> DataFrame:
    counts = both_sides(source, target, lambda df: {"count": F.count(F.lit(1))})
    return counts.select(*row_count_result(F.col("source_count"), F.col("target_count")))


def null_parity(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    counts = both_sides(source, target, lambda df: {"null_count": F.count_if(F.col(column).isNull())})
    return counts.select(
        F.lit(column).alias("column_name"),
        "source_null_count",
        "target_null_count",
        (F.col("source_null_count") - F.col("target_null_count")).alias("difference"),
        _status(F.col("source_null_count") == F.col("target_null_count")).alias("status"),
    )


def identifier_columns(df: DataFrame, exclude: str) -> list[str]:
    """The columns that point a reader at a row: a conventional id, else the first three others."""
    by_name = {c.lower(): c for c in df.columns}
    for name in IDENTIFIER_COLUMNS:
        if name in by_name:
            return [by_name[name]]
    return [c for c in df.columns if c.lower() != exclude.lower()][:3]


def sample_identifier(df: DataFrame, exclude: str) -> Column:
    """The identifying values of a row as ``map<column, text>``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts: list[Column] = []
    for name in identifier_columns(df, exclude):
        parts += [F.lit(name), shortened(shown(F.col(name), types[name]))]
    return F.create_map(*parts)


def null_samples(source: DataFrame, target: DataFrame, column: str, limit: int = SAMPLE_ROWS) -> DataFrame:
    """Up to ``limit`` rows whose ``column`` is NULL, those of the source first."""
    sides = []
    for order, (side, df) in enumerate((("source", source), ("target", target))):
        identifier = F.to_json(sample_identifier(df, column))
        sides.append(
            df.filter(F.col(column).isNull()).select(F.lit(order).alias("_o"), F.lit(f"null_in_{side}").alias("discrepancy"), identifier.alias("row_identifier"))
        )
    return sides[0].unionByName(sides[1]).orderBy("_o", "row_identifier").limit(limit).drop("_o")


def key_copies(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Copies of every key on both sides. Counting before the shuffle takes care of hot keys."""
    tagged = [df.select(*keys, F.lit(tag).alias("_side")) for tag, df in ((0, source), (1, target))]
    return (
        tagged[0]
        .unionByName(tagged[1])
        .groupBy(*keys)
        .agg(F.count_if(F.col("_side") == 0).alias("source_copies"), F.count_if(F.col("_side") == 1).alias("target_copies"))
    )


def duplicate_parity(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys occur more than once per side; equal numbers pass, NULL is a key."""
    counts = key_copies(source, target, keys).agg(
        F.count_if(F.col("source_copies") > 1).alias("source_duplicate_count"),
        F.count_if(F.col("target_copies") > 1).alias("target_duplicate_count"),
    )
    return counts.select(
        "*",
        (F.col("source_duplicate_count") - F.col("target_duplicate_count")).alias("difference"),
        _status(F.col("source_duplicate_count") == F.col("target_duplicate_count")).alias("status"),
    )


def duplicate_samples(df: DataFrame, keys: Sequence[str], limit: int = SAMPLE_ROWS) -> DataFrame:
    """The keys with most copies."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
        .orderBy(F.desc("copies"), *keys)
        .limit(limit)
    )


def column_type(df: DataFrame, column: str) -> T.DataType:
    return next(f.dataType for f in df.schema.fields if f.name.lower() == column.lower())


def aggregate_value(df: DataFrame, column: str, kind: str) -> Column:
    """SUM or AVERAGE of the finite values as a double, 0 when there is none."""
    dtype = column_type(df, column)
    value = F.col(quoted(column))
    total = exact_sum(value, dtype)
    result = total if kind == "SUM" else F.try_divide(total, F.count(F.when(_finite(value, dtype), 1)))
    return F.coalesce(result, F.lit(0.0))


def not_finite_value(df: DataFrame, column: str) -> Column:
    return not_finite(F.col(quoted(column)), column_type(df, column))


def aggregate_parity(source: DataFrame, target: DataFrame, column: str, kind: str) -> DataFrame:
    """SUM or AVERAGE of a column per side; no value counts as 0.

    Passes when the values agree within ``TOLERANCE`` and both sides have equally many
    NaN, infinite and minus infinite values (``*_not_finite``).
    """
    kind = kind.upper()
    if kind not in ("SUM", "AVERAGE"):
        raise ValueError(f"unknown aggregate {kind}")

    difference = F.col("source_value") - F.col("target_value")
    measures = both_sides(source, target, lambda df: {"value": aggregate_value(df, column, kind), "not_finite": not_finite_value(df, column)})
    return measures.select(
        F.lit(column).alias("column_name"),
        F.lit(kind).alias("aggregate_type"),
        "source_value",
        "target_value",
        difference.alias("difference"),
        "source_not_finite",
        "target_not_finite",
        _status((F.abs(difference) <= TOLERANCE) & (F.col("source_not_finite") == F.col("target_not_finite"))).alias("status"),
    )


def incremental_delta(counts: DataFrame) -> DataFrame:
    """Judge recorded loads: ``load_type, source_count, previous_count, current_count``.

    A full load must hold exactly the source rows; an incremental one must have
    grown by at least the batch.
    """
    full = F.col("load_type") == "full"
    grown = F.col("current_count") - F.col("previous_count")
    delta = F.when(full, F.col("current_count") - F.col("source_count")).otherwise(grown)
    passed = F.when(full, F.col("current_count") == F.col("source_count")).otherwise(grown >= F.col("source_count"))
    return counts.select("*", delta.alias("delta"), _status(passed).alias("status"))
