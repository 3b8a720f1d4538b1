"""How rows lie in files: partitions, order and file sizes."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.values import quoted
from tallyframe.operators.load import point_to, table_location
from tallyframe.sources.files import file_listing, list_data_files, source_size

MIB = 1024 * 1024
MIN_TARGET, MAX_TARGET = 64 * MIB, 512 * MIB  # allowed file sizes (fixed values)
STRATEGIES = ("binpack", "sort", "z-order")

# Partition transform per column type and granularity.
TRANSFORMS = {
    ("DATE", None): "day", ("DATE", "DAY"): "day",
    ("DATETIME", None): "day", ("DATETIME", "DAY"): "day", ("DATETIME", "HOUR"): "hour", ("DATETIME", "MONTH"): "month", ("DATETIME", "YEAR"): "year",
    ("TIMESTAMP", None): "day", ("TIMESTAMP", "DAY"): "day", ("TIMESTAMP", "HOUR"): "hour", ("TIMESTAMP", "MONTH"): "month", ("TIMESTAMP", "YEAR"): "year",
}
TIME_TYPES = ("DATE", "DATETIME", "TIMESTAMP")
_PATTERNS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH"}


def partition_transform(column: str, column_type: str, granularity: str | None = None) -> str:
    """The transform for a partition column; times never partition by their own value."""
    if not column:
        raise ValueError("a partition column is required")
    kind = column_type.strip().upper()
    if kind not in TIME_TYPES:
        return "identity"
    key = (kind, granularity.strip().upper() if granularity else None)
    if key not in TRANSFORMS:
        raise ValueError(f"no partition transform for {kind} by {granularity}")
    return TRANSFORMS[key]


def partition_value(column: str, transform: str) -> Column:
    return F.col(column) if transform == "identity" else F.date_format(column, _PATTERNS[transform])


def write_partitioned(
    df: DataFrame, path: str, column: str, column_type: str, granularity: str | None = None, cluster_by: Sequence[str] = (), mode: str = "error"
) -> str:
    """Write ``df`` in folders by the transform of one column, sorted by the cluster columns.

    The folder column is ``<column>_<transform>``; filter on it to prune. Rows are
    rebalanced by it, so a large folder gets several even files and a small one few.
    """
    transform = partition_transform(column, column_type, granularity)
    name = column if transform == "identity" else f"{column}_{transform}"
    rows = df if transform == "identity" else df.withColumn(name, partition_value(column, transform))
    order = [F.col(c).asc_nulls_last() for c in cluster_by if c]
    rows = rows.hint("rebalance", F.col(name)).sortWithinPartitions(F.col(name), *order)
    rows.write.mode(mode).partitionBy(name).parquet(path)
    return name


def check_compaction(strategy: str, columns: Sequence[str], schema: Sequence[str], target_bytes: int) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if not MIN_TARGET <= target_bytes <= MAX_TARGET:
        raise ValueError(f"target file size must lie between {MIN_TARGET} and {MAX_TARGET} bytes")
    if strategy != "binpack" and not columns:
        raise ValueError(f"{strategy} needs columns")
    absent = [c for c in columns if c.lower() not in {s.lower() for s in schema}]
    if absent:
        raise ValueError(f"columns not in table: {', '.join(absent)}")


#: Values of a column that bounds are drawn from.
MAX_SAMPLE = 100_000
#: Bits of all ranks together; the curve through so many cells is a table of its own.
CURVE_BITS = 16


def equal_bounds(df: DataFrame, column: str, parts: int) -> list:
    """Values that cut a column of any type with an order into ``parts`` ranges with about equally many rows.

    They are found on a sample of about ``MAX_SAMPLE`` rows and only tell where rows lie,
    never which. A value that fills several ranges is one bound.
    """
    values = df.select(F.col(quoted(column)).alias("v")).where("v is not null")
    count = values.count()
    drawn = values if count <= MAX_SAMPLE else values.sample(MAX_SAMPLE / count, seed=7)
    ranges = drawn.repartitionByRange(parts, "v").groupBy(F.spark_partition_id().alias("p")).agg(F.max("v").alias("v"))
    return sorted({r["v"] for r in ranges.collect()})[:-1]


def rank_in(column: str, bounds: Sequence[object], dtype: T.DataType) -> Column:
    """How many bounds a value lies beyond, by halving; NULL and NaN come last."""
    value = F.col(quoted(column))

    def halve(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= F.lit(bounds[middle]).cast(dtype), halve(low, middle)).otherwise(halve(middle + 1, high))

    return F.when(value.isNull(), len(bounds)).otherwise(halve(0, len(bounds)))


def curve(dimensions: int, bits: int) -> list[tuple[int, int]]:
    """(cell, place) of every cell of a grid along a Hilbert curve; neighbours on the curve are neighbours in the grid.

    A cell's number has the ``bits`` bits of each coordinate after one another. By
    J. Skilling's transform of an index to coordinates.
    """
    found = []
    for place in range(1 << (dimensions * bits)):
        # the bits of the place, dealt out in turn
        x = [sum((place >> ((bits - 1 - b) * dimensions + dimensions - 1 - d) & 1) << (bits - 1 - b) for b in range(bits)) for d in range(dimensions)]
        carry = x[-1] >> 1
        for d in range(dimensions - 1, 0, -1):
            x[d] ^= x[d - 1]
        x[0] ^= carry
        step = 2
        while step < 1 << bits:
            mask = step - 1
            for d in range(dimensions - 1, -1, -1):
                if x[d] & step:
                    x[0] ^= mask
                else:
                    swap = (x[0] ^ x[d]) & mask
                    x[0] ^= swap
                    x[d] ^= swap
            step <<= 1
        cell = 0
        for value in x:
            cell = cell << bits | value
        found.append((cell, place))
    return found


def curve_place(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with ``_place``, the place of each row along a Hilbert curve through the ranks of its columns.

    Ranks are ranges with equally many rows each, so skewed numbers and texts with a
    common beginning spread over the whole curve. The curve has 2^16 cells at most,
    which is the size of the table that is broadcast.
    """
    bits = max(1, min(8, CURVE_BITS // len(columns)))
    cell = F.lit(0)
    for c in columns:
        rank = rank_in(c, equal_bounds(df, c, 1 << bits), df.schema[c].dataType)
        cell = cell * (1 << bits) + rank
    if bits * len(columns) > CURVE_BITS:  # so many columns that the curve would be too long
        return df.withColumn("_place", cell)
    places = df.sparkSession.createDataFrame(curve(len(columns), bits), "_cell int, _place int")
    return df.withColumn("_cell", cell.cast("int")).join(F.broadcast(places), "_cell", "left").drop("_cell")


def compact_files(
    spark: SparkSession, path: str, out: str, strategy: str = "binpack", columns: Sequence[str] = (), target_bytes: int = 128 * MIB, partition_by: Sequence[str] = (), schema: T.StructType | None = None
) -> int:
    """Rewrite the Parquet files below ``path`` into files of about ``target_bytes`` in the new folder ``out``.

    binpack only packs file pieces into reads of the target size, without a shuffle.
    sort and z-order cut the order into as many ranges as there are files, z-order that
    along a curve through the ranks of all columns (:func:`curve_place`); a row
    number is the last range column, so a value that fills many files is spread over
    many tasks. Folders named by ``partition_by`` are kept, and come first in the order.
    Returns the number of files aimed at.
    """
    read = lambda session: (session.read if schema is None else session.read.schema(schema)).parquet(path)
    df = read(spark)
    check_compaction(strategy, columns, df.columns, target_bytes)
    size = source_size(list_data_files(file_listing(spark, path), "PARQUET")).first()["total_bytes"]
    files = max(1, math.ceil(size / target_bytes))
    if strategy == "binpack":
        packed = spark.newSession()
        packed.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes))
        packed.conf.set("spark.sql.files.openCostInBytes", "0")
        packed.conf.set("spark.sql.files.minPartitionNum", "1")
        read(packed).write.partitionBy(*partition_by).parquet(out)
        return files
    folders = [F.col(quoted(c)) for c in partition_by]
    if strategy == "sort":
        order, keyed = [F.col(quoted(c)).asc_nulls_last() for c in columns], df
    else:
        order, keyed = [F.col("_place")], curve_place(df, columns)
    ranges = keyed.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(files, *folders, *order, "_tie")
    ranges.sortWithinPartitions(*folders, *order).drop("_tie", "_place").write.partitionBy(*partition_by).parquet(out)
    return files


def compact_table(
    spark: SparkSession, name: str, root: str, strategy: str = "binpack", columns: Sequence[str] = (), target_bytes: int = 128 * MIB
) -> int:
    """Compact the files of a table, in its partitions, and point the table to them; a failed rewrite changes nothing."""
    out = f"{root.rstrip('/')}/{name}-compacted-{uuid.uuid4().hex}"
    folders = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    files = compact_files(spark, table_location(spark, name), out, strategy, columns, target_bytes, folders, spark.table(name).schema)
    point_to(spark, name, out, spark.table(name).schema, folders)
    return files
