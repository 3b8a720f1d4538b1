"""Running sums and exact ranks without a single-task sort.

A window over a whole table would put it into one task. Here the order is cut
into nested steps (days, seconds, instants; or digits of a number), so that
every window partition holds at most the number of steps one level has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Bits per level: three levels of at most 2**21 steps cover every long.
DIGIT_BITS = 21


def one_row(frames: Sequence[DataFrame]) -> DataFrame:
    """Several one-row frames with different columns as one row."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def peak_running_sum(changes: DataFrame, time: str, change: str) -> DataFrame:
    """Highest value of the running sum of ``change`` over ``time``, at least 0, as ``peak``.

    Changes at one instant are netted first. Each level hands up its total and its
    highest running sum; the next level only needs these two, so nothing is joined.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    net = (
        changes.groupBy(micros.alias("_at")).agg(F.sum(change).alias("_total")).withColumn("_high", F.col("_total"))
        .withColumn("_second", F.expr("_at div 1000000")).withColumn("_day", F.expr("_second div 86400"))
    )
    levels = ((["_day", "_second"], "_at"), (["_day"], "_second"), ([], "_day"))
    for keys, order in levels:
        # Last level: one row per day of the log.
        before = F.sum("_total").over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
        reached = F.coalesce(before, F.lit(0)) + F.col("_high")
        net = net.withColumn("_reached", reached).groupBy(*keys).agg(F.sum("_total").alias("_total"), F.max("_reached").alias("_high"))
    return net.select(F.greatest(F.coalesce(F.col("_high"), F.lit(0)), F.lit(0)).alias("peak"))


def _cumulated(counts: DataFrame) -> DataFrame:
    """Add ``before`` (rows with a smaller value) and ``total`` to ``value, n`` rows."""
    digits = counts.select("*", F.shiftright("value", 2 * DIGIT_BITS).alias("_h"), F.shiftright("value", DIGIT_BITS).alias("_m"))
    middle = digits.groupBy("_h", "_m").agg(F.sum("n").alias("_n"))
    top = middle.groupBy("_h").agg(F.sum("_n").alias("_n"))
    every = W.partitionBy().orderBy("_h")
    top = top.select(
        "_h",
        F.coalesce(F.sum("_n").over(every.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_hb"),
        F.sum("_n").over(W.partitionBy()).alias("total"),
    )
    in_top = W.partitionBy("_h").orderBy("_m").rowsBetween(W.unboundedPreceding, -1)
    middle = middle.withColumn("_mb", F.coalesce(F.sum("_n").over(in_top), F.lit(0))).drop("_n").join(top, "_h")
    in_middle = W.partitionBy("_h", "_m").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    inner = digits.withColumn("_b", F.coalesce(F.sum("n").over(in_middle), F.lit(0)))
    return inner.join(middle, ["_h", "_m"]).select(
        "value", "n", (F.col("_hb") + F.col("_mb") + F.col("_b")).alias("before"), "total"
    )


def nearest_rank(df: DataFrame, value: Column, shares: Mapping[str, float]) -> DataFrame:
    """Exact percentiles in one row: the value at index ``min(int(n * share), n - 1)`` of the sorted list.

    ``value`` must be a whole number; scale it first. Equal values are counted
    before anything is ordered.
    """
    counts = df.select(value.cast("bigint").alias("value")).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    placed = _cumulated(counts)

    def pick(share: float) -> Column:
        index = F.least(F.floor(F.col("total") * F.lit(float(share))), F.col("total") - 1)
        hit = (F.col("before") <= index) & (index < F.col("before") + F.col("n"))
        return F.max(F.when(hit, F.col("value")))

    return placed.agg(*[pick(share).alias(name) for name, share in shares.items()])
