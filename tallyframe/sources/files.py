"""Listing data files, and writing tables to them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of data files per format, and of any data file.
FORMAT_ENDINGS = {
    "CSV": (".csv", ".csv.gz", ".csv.snappy", ".csv.zst"),
    "PARQUET": (".parquet", ".parquet.snappy", ".parquet.gz"),
    "JSON": (".json", ".json.gz", ".json.snappy", ".json.zst"),
    "AVRO": (".avro", ".avro.snappy", ".avro.gz"),
}
DATA_ENDINGS = (".csv", ".parquet", ".json", ".avro", ".gz", ".snappy", ".zst")

# File name part per codec, and the codecs each format can write.
CODEC_ENDINGS = {"NONE": "", "GZIP": ".gz", "SNAPPY": ".snappy", "DEFLATE": ".deflate", "ZSTD": ".zst"}
WRITABLE = {
    "CSV": ("NONE", "GZIP", "SNAPPY", "DEFLATE"),
    "JSON": ("NONE", "GZIP", "SNAPPY", "DEFLATE"),
    "PARQUET": ("NONE", "GZIP", "SNAPPY", "ZSTD"),
    "AVRO": ("NONE", "SNAPPY", "DEFLATE", "ZSTD"),
}


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """``path, modification_time, length`` of all files below ``path``. Contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.col("modificationTime").alias("modification_time"), "length")
    )


def modified_at(files: DataFrame) -> Column:
    """Modification time of a listing; text that is not a time counts as none."""
    return F.col("modification_time").try_cast("timestamp")


def list_data_files(files: DataFrame, file_format: str | None = None) -> DataFrame:
    """Only data files, of one format when given."""
    endings = FORMAT_ENDINGS.get(file_format.upper(), ()) if file_format else DATA_ENDINGS
    if not endings:
        return files
    pattern = "(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$"
    return files.filter(F.lower("path").rlike(pattern))


def source_size(files: DataFrame) -> DataFrame:
    """Files and bytes, manifests aside."""
    return files.filter(~F.lower("path").contains("manifest")).agg(
        F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes")
    )


def build_manifest(files: DataFrame, table_name, mandatory: bool = True) -> DataFrame:
    """Manifest rows in table and file order. One row per file: a table's list is never held in one place."""
    return files.select(
        table_name.alias("table_name"), F.col("path").alias("url"), F.col("length").alias("content_length"), F.lit(mandatory).alias("mandatory")
    ).orderBy("table_name", "url")


def file_ending(file_format: str, codec: str | None) -> str:
    return file_format.lower() + CODEC_ENDINGS.get((codec or "NONE").upper(), "")


def export_table(df: DataFrame, base: str, dataset: str, table: str, file_format: str = "PARQUET", codec: str = "NONE") -> str:
    """Write ``df`` to ``base/dataset/table`` and return that path."""
    file_format, codec = file_format.upper(), codec.upper()
    if file_format not in WRITABLE:
        raise ValueError(f"unknown format {file_format}")
    if codec not in WRITABLE[file_format]:
        raise ValueError(f"{file_format} cannot be written with {codec}")
    path = f"{base.rstrip('/')}/{dataset}/{table}"
    option = {"NONE": "uncompressed" if file_format in ("PARQUET", "AVRO") else "none"}.get(codec, codec.lower())
    writer = df.write.format(file_format.lower()).option("compression", option)
    if file_format == "CSV":
        writer = writer.option("header", "true")
    try:
        writer.save(path)
    except Exception as error:
        if file_format == "AVRO" and "avro" in str(error).lower():
            raise RuntimeError("AVRO needs the spark-avro package on the class path") from error
        raise
    return path


def export_tables(
    spark: SparkSession,
    tables: Mapping[str, Callable[[], DataFrame]],
    base: str,
    dataset: str,
    settings: Mapping[str, Mapping[str, object]] | None = None,
    threads: int = 4,
    **defaults,
) -> DataFrame:
    """Export many tables at once; a table that fails is a row with its error and stops no other.

    ``settings`` override the defaults per table: ``file_format``, ``codec``, and
    ``timestamp_column`` with ``bookmark`` for an incremental export.
    """
    from tallyframe.operators.load import incremental_filter

    def one(name: str) -> tuple[str, bool, str | None, str | None]:
        options = {**defaults, **(settings or {}).get(name, {})}
        column, bookmark = options.pop("timestamp_column", None), options.pop("bookmark", None)
        try:
            df = tables[name]()
            if column:
                df = incremental_filter(df, column, bookmark)
            return name, True, export_table(df, base, dataset, name, **options), None
        except Exception as error:  # noqa: BLE001 - the error is the result
            return name, False, None, str(error).splitlines()[0]

    with ThreadPoolExecutor(threads) as pool:
        results: Sequence = list(pool.map(one, sorted(tables)))
    return spark.createDataFrame(results, "table_name string, success boolean, path string, error string")
