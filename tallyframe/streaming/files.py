"""Loading files as they arrive."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.sources.files import modified_at

WATERMARK_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def filter_by_watermark(files: DataFrame, watermark: str | None) -> DataFrame:
    """Files modified after the watermark, and files without a time. No or a bad watermark keeps all."""
    mark = F.lit(watermark).cast("string").try_cast("timestamp")
    at = modified_at(files)
    return files.filter(F.coalesce(at > mark, F.lit(True)))


def compute_watermark(files: DataFrame) -> DataFrame:
    """The latest modification time, cut to seconds, as text; NULL when there is none."""
    return files.agg(F.date_format(F.max(modified_at(files)), WATERMARK_FORMAT).alias("watermark"))


def advanced(old: str | None, new: str | None) -> str | None:
    """A watermark only moves forward."""
    return new if old is None else (old if new is None else max(old, new))


def load_available_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    apply: Callable[[DataFrame, int], None],
    checkpoint: str,
    max_files: int = 1000,
    file_format: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> int:
    """Run ``apply`` on the files that arrived since the last call; returns the number of rows.

    The checkpoint remembers which files are done and moves only when a batch
    succeeded. A full reload is a call with a new checkpoint. ``apply`` has to run an
    action over its batch, in which the rows are counted.
    """
    reader = spark.readStream.schema(schema).options(**(options or {})).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true")
    stream = reader.format(file_format).load(path)
    rows: list[int] = []

    def counted(batch: DataFrame, batch_id: int) -> None:
        seen = Observation(f"batch_{uuid.uuid4().hex}")
        apply(batch.observe(seen, F.count(F.lit(1)).alias("rows")), batch_id)
        rows.append(seen.get["rows"])

    query = (
        stream.withColumn("source_file", F.col("_metadata.file_path"))
        .writeStream.foreachBatch(counted)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return sum(rows)


def append_batches(out: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to its own folder; a batch that is run again replaces itself."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return apply
