"""Streams into tables: upserts, counts per window, rows without repeats."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.load import merge_partitions, merge_upsert, replace_table, table_location
from tallyframe.operators.units import merge_units
from tallyframe.session import cut_lineage


def _run(stream: DataFrame, apply, checkpoint: str, mode: str = "append") -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_merge(stream: DataFrame, name: str, keys: Sequence[str], root: str, checkpoint: str, newest_by: Sequence[str] = ()) -> None:
    """Upsert every micro-batch into table ``name``.

    The folder of the table's contents is named after the batch that made them, so
    pointing the table there and noting the batch is one step: a batch that is run
    again after a crash is either not there yet or skipped.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        exists = spark.catalog.tableExists(name)
        if exists and last_batch(spark, name, checkpoint) >= batch_id:
            return
        staged = cut_lineage(batch)
        target = spark.table(name) if exists else staged.limit(0)
        replace_table(name, merge_upsert(target, staged, keys, newest_by), root, _label(checkpoint, batch_id))

    _run(stream, apply, checkpoint)


def stream_merge_partitions(
    stream: DataFrame, path: str, keys: Sequence[str], partition: str, checkpoint: str, newest_by: Sequence[str] = ()
) -> None:
    """Upsert every micro-batch into a folder partitioned by ``partition``, rewriting only the partitions it touches.

    For targets of which a batch is a small part. The batch of a stream has a name of
    its own, so a batch that is run again after a crash changes nothing, or completes.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        merge_partitions(path, batch, keys, partition, newest_by, batch=_label(checkpoint, batch_id))

    _run(stream, apply, checkpoint)


def stream_merge_units(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str, newest_by: Sequence[str] = ()) -> None:
    """Upsert every micro-batch into a table kept in units, rewriting only the units that hold one of its keys.

    The batch of a stream has a name of its own, so a batch that is run again after a crash changes nothing.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        merge_units(path, batch, keys, f"{_label(checkpoint, batch_id)}rows", newest_by)

    _run(stream, apply, checkpoint)


def _label(checkpoint: str, batch_id: int | str) -> str:
    return f"{hashlib.md5(checkpoint.encode()).hexdigest()[:12]}-batch{batch_id}-"


def last_batch(spark: SparkSession, name: str, checkpoint: str) -> int:
    """The batch of this stream the table's contents come from, -1 when they come from elsewhere."""
    found = re.search(_label(checkpoint, r"(\d+)"), table_location(spark, name))
    return int(found.group(1)) if found else -1


def stream_concurrency(stream: DataFrame, out: str, checkpoint: str, time: str = "execution_time", grain: str = "1 minute", lateness: str = "1 hour") -> None:
    """Counts per window, written as they change; read them with :func:`window_counts`.

    The watermark bounds the state. Every batch writes the windows it changed, so
    windows that are still open at the end are there as well.
    """
    counts = (
        stream.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, lateness)
        .groupBy(F.window(time, grain))
        .agg(F.count(F.lit(1)).alias("query_count"))
        .select(F.col("window.start").alias("window_start"), "query_count")
    )

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _run(counts, apply, checkpoint, "update")


def window_counts(spark: SparkSession, out: str) -> DataFrame:
    """The newest count of every window."""
    return spark.read.parquet(out).groupBy("window_start").agg(F.max_by("query_count", "batch").alias("query_count"))


def stream_dedup(stream: DataFrame, keys: Sequence[str], out: str, checkpoint: str, time: str = "execution_time", lateness: str = "1 hour") -> None:
    """Rows without those whose key came within the watermark before."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(keys))
    query = (
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
