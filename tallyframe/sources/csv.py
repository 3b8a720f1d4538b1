"""Loading CSV files that are not all well-formed."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.values import quoted
from tallyframe.session import cut_lineage

MAX_ERRORS = 1000  # rejected rows up to which a load passes (fixed value)

_CORRUPT = "_corrupt"
_NEVER = "\x01\x02\x01"
# A line put together again keeps its blanks and empty fields.
_AS_READ = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": "", "emptyValue": ""}


def _moment(text: Column, dtype: T.DataType) -> Column:
    """A date or time in one of the usual forms. The place of the separators tells the form, so one is tried per value."""
    t = F.trim(text)

    def form(pattern: str) -> Column:
        return F.try_to_timestamp(t, F.lit(pattern)).cast("timestamp_ntz")

    third = F.substring(t, 3, 1)
    parsed = (
        F.when(F.substring(t, 5, 1) == "-", t.try_cast("timestamp_ntz"))
        .when(third == "/", form("MM/dd/yyyy[ HH:mm:ss]"))
        .when(third == "-", form("dd-MMM-yyyy"))
        .when((F.length(t) == 8) & (third != ":"), form("yyyyMMdd"))
        .otherwise(t.try_cast("timestamp_ntz"))
    )
    return parsed.cast(dtype)


def _convert(text: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return text
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return _moment(text, dtype)
    return text.try_cast(dtype)


def plain_path_text(path: str) -> str:
    """A path as a reader takes it, from the URL that metadata give; characters of patterns are marked."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(path))


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The lines below the header of each file: one column, as no line holds this separator and quotes mean nothing."""
    return spark.read.schema(T.StructType([T.StructField("_line", T.StringType())])).csv(
        path, header=True, sep=_NEVER, quote="", escape="", enforceSchema=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, multiLine=False
    )


def _quotes_are_odd(line: Column) -> Column:
    return F.length(F.translate(line, '"', "")) % 2 != F.length(line) % 2


def _records(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(records below the headers, files that cannot be cut): lines put together where a quoted value runs on.

    A line feed ends a record if an even number of quotes came before it in its file.
    Every block of a file counts its lines with an odd number of quotes; the sums over
    the blocks before it, one row per block, tell a block in what state it begins,
    so a large file is as many tasks as it has blocks. Only the lines of records that
    run on are brought together. Where a file ends within quotes, its quotes cannot be
    counted upon, and it is named for a reader that takes it as a whole.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")]
    text = F.regexp_replace("value", "\r$", "")
    lines = read.select(*place, text.alias("_line")).withColumn("_odd", _quotes_are_odd(F.col("_line")).cast("long"))
    blocks = lines.groupBy("_file", "_block").agg(F.sum("_odd").alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut_lineage(blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    broken = blocks.groupBy("_file").agg(F.sum("_n").alias("_n")).filter("_n % 2 = 1").select("_file")
    unsafe = [r["_file"] for r in broken.collect()]
    whole = lines.join(blocks.drop("_n").join(broken, "_file", "left_anti"), ["_file", "_block"])
    along = Window.partitionBy("_file", "_block").orderBy("_id")
    opened = F.coalesce(F.sum("_odd").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_before")
    header = (F.col("_block") == 0) & (F.row_number().over(along) == 1)
    marked = whole.withColumns({"_opened": opened, "_header": header})
    alone = (F.col("_opened") % 2 == 0) & (F.col("_odd") == 0)
    single = marked.filter(alone & ~F.col("_header") & (F.trim("_line") != "")).select("_line", "_file")
    # the number of odd lines before its first one names a record that runs on
    parts = F.array_sort(F.collect_list(F.struct("_block", "_id", "_line")))
    record = F.array_join(F.transform(parts, lambda x: x["_line"]), "\n")
    joined = marked.filter(~alone).groupBy("_file", (F.col("_opened") - F.col("_opened") % 2).alias("_record"))
    running = joined.agg(record.alias("_line"), F.bool_or("_header").alias("_header")).filter("not _header").select("_line", "_file")
    return single.unionByName(running), unsafe


def read_tolerant(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Typed rows of CSV files with a header, each with its ``reject`` struct or NULL.

    Empty and blank fields are NULL, bytes that are not UTF-8 are replaced; a row of
    the wrong width, with a value that does not convert, or with a quote that its
    line does not close is marked and kept. Doubled quotes inside quotes are one.
    With ``multi_line`` quoted values may hold line breaks, which come out as line feeds;
    files are cut at records, so a large one is many tasks. A file whose quotes do not
    close is then read by a single task.
    """
    raw_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(_CORRUPT, T.StringType())])
    names = [F.col(quoted(f.name)) for f in schema.fields]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "escape": '"'}
    parsed = F.from_csv(F.col("_line"), ", ".join(f"{quoted(f.name)} string" for f in raw_schema.fields), options | {"maxCharsPerColumn": "-1"})
    lines, unsafe = _records(spark, path) if multi_line else (_lines(spark, path).select("_line", F.col("_metadata.file_path").alias("_file")), [])
    rows = lines.select("_line", "_file", parsed.alias("_row")).select("_line", "_file", "_row.*")
    unclosed = F.lit(False) if multi_line else _quotes_are_odd(F.col("_line"))
    if unsafe:
        reader = spark.read.schema(raw_schema).options(**options).option("header", True).option("enforceSchema", True).option("multiLine", True)
        taken = reader.csv([plain_path_text(p) for p in unsafe]).select("*", F.col("_metadata.file_path").alias("_file"))
        rows = rows.unionByName(taken.withColumn("_line", F.coalesce(F.col(_CORRUPT), F.to_csv(F.struct(*names), _AS_READ))))
    line = F.col("_line")
    checks, values = [], []
    for field in schema.fields:
        own = F.col(quoted(field.name))
        text = F.when(F.trim(own) != "", own)
        value = _convert(text, field.dataType)
        values.append(value.alias(field.name))
        checks.append(
            F.when(text.isNotNull() & value.isNull(), F.struct(F.lit(field.name).alias("column_name"), F.lit("invalid value").alias("reason")))
        )
    fault = lambda when, reason: F.when(when, F.struct(F.lit("").alias("column_name"), F.lit(reason).alias("reason")))
    first = F.coalesce(fault(unclosed, "unclosed quote"), fault(F.col(_CORRUPT).isNotNull(), "wrong number of fields"), *checks)
    reject = F.when(
        first.isNotNull(),
        F.struct(
            first["column_name"].alias("column_name"), first["reason"].alias("reason"), line.alias("raw_line"), F.col("_file").alias("file_path"),
            F.current_timestamp().alias("loaded_at"),
        ),
    )
    return rows.select(*values, reject.alias("reject"))


def load_csv_tolerant(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, max_errors: float | None = MAX_ERRORS, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects; too many rejects fail the load.

    ``max_errors`` is a number of rows, a share of them if below 1, or None for no
    limit. The parsed rows are written once, so the files are parsed once.
    """
    parsed = cut_lineage(read_tolerant(spark, path, schema, multi_line))
    rejects = parsed.filter("reject is not null").select("reject.*")
    if max_errors is not None:
        counts = parsed.agg(F.count("reject").alias("bad"), F.count(F.lit(1)).alias("all")).first()
        allowed = max_errors * counts["all"] if 0 < max_errors < 1 else max_errors
        if counts["bad"] > allowed:
            raise ValueError(f"{counts['bad']} rows rejected, {allowed:g} allowed")
    return parsed.filter("reject is null").drop("reject"), rejects


def load_rejects(rejects: DataFrame, limit: int, newest: Sequence[str] = ("loaded_at", "file_path", "raw_line")) -> DataFrame:
    """The ``limit`` newest rejects."""
    return rejects.orderBy(*[F.desc(c) for c in newest]).limit(limit)
