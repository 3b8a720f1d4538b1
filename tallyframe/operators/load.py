"""Loading tables: in full, incrementally, by key, by slice and by file.

A table is an external Parquet table. New contents go to a new folder and the
catalog entry is pointed there afterwards, so readers see the old or the new
contents and a failed load changes nothing. Where the schema changes as well, the
entry is made anew; a reader that looks just then finds no table.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.values import quoted, sortable
from tallyframe.operators.schema import refuse_incompatible, schema_changes
from tallyframe.session import cut_lineage, remove_folder, shared_folder, work_path
from tallyframe.sources.files import file_listing, list_data_files, modified_at, source_size

HISTORY_SCHEMA = (
    "load_id string, schema_name string, table_name string, source string, file_format string, load_type string, status string, "
    "started_at timestamp, completed_at timestamp, duration_seconds double, rows_loaded bigint, bytes_loaded bigint, error_message string"
)


def incremental_filter(df: DataFrame, column: str, bookmark) -> DataFrame:
    """Rows later than the bookmark; all rows when there is none. The filter reaches the scan."""
    return df if bookmark is None else df.filter(F.col(column) > F.lit(bookmark).cast(df.schema[column].dataType))


def point_to(spark: SparkSession, name: str, path: str, schema: T.StructType, partition_by: Sequence[str] = ()) -> None:
    """Let table ``name`` be what lies below ``path``; of a partitioned table all folders are registered anew."""
    if partition_by:
        columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({', '.join(map(quoted, partition_by))}) LOCATION '{path}'")
        spark.sql(f"MSCK REPAIR TABLE {name}")
    elif spark.catalog.tableExists(name) and spark.table(name).schema.simpleString() == schema.simpleString():
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
    else:
        # External tables: dropping the entry leaves the files alone.
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.catalog.createTable(name, path=path, source="parquet", schema=schema)
    spark.catalog.refreshTable(name)


def replace_table(name: str, df: DataFrame, root: str, label: str = "") -> str:
    """New contents for table ``name`` in a new folder below ``root``; ``label`` becomes part of the folder's name."""
    path = f"{root.rstrip('/')}/{name}-{label}{uuid.uuid4().hex}"
    df.write.parquet(path)
    point_to(df.sparkSession, name, path, df.schema)
    return path


def append_table(name: str, df: DataFrame) -> None:
    target = df.sparkSession.table(name)
    df.select(*target.columns).write.mode("append").insertInto(name)
    df.sparkSession.catalog.refreshTable(name)


def load_full(name: str, df: DataFrame, root: str, truncate: bool = False) -> None:
    """Create the table; an existing one is emptied first when asked, else appended to."""
    if truncate or not df.sparkSession.catalog.tableExists(name):
        replace_table(name, df, root)
    else:
        append_table(name, df)


def newest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, that with the largest ``order`` columns; the other columns decide ties.

    Rows are ranked per task before the shuffle, so a key that fills a third of the
    rows costs one row per task. The other columns may be of any type, maps too.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    rank = F.struct(*[sortable(c, df.schema[c].dataType) for c in [*order, *rest]])
    latest = F.max_by(F.struct(*[F.col(quoted(c)) for c in [*order, *rest]]), rank).alias("_r")
    return df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(latest).select(*[quoted(k) for k in keys], "_r.*").select(*[quoted(c) for c in df.columns])


def merge_upsert(target: DataFrame, staging: DataFrame, keys: Sequence[str], newest_by: Sequence[str] = ()) -> DataFrame:
    """Target rows whose key is not in staging, and the staging rows.

    A key with NULL never matches. Repeated staging keys are all inserted unless
    ``newest_by`` names the columns by which the newest row of a key is told.
    """
    if newest_by:
        staging = newest_rows(staging, keys, newest_by)
    replaced = staging.select(*keys).distinct()
    return target.join(replaced, list(keys), "left_anti").select(*target.columns).unionByName(staging.select(*target.columns))


def merge_table(name: str, staging: DataFrame, keys: Sequence[str], root: str, newest_by: Sequence[str] = ()) -> None:
    """Upsert into a table by writing its next version; a partitioned folder is better served by :func:`merge_partitions`.

    Staging is written first, as it is read twice and a live source could answer differently.
    """
    target = staging.sparkSession.table(name)
    replace_table(name, merge_upsert(target, cut_lineage(staging), keys, newest_by), root)


def read_partitioned(spark: SparkSession, path: str, partition: str, dtype: T.DataType) -> DataFrame:
    """A folder partitioned by one column of a known type; '01' stays '01' where folder names alone would give 1."""
    fields = [f for f in spark.read.parquet(path).schema.fields if f.name != partition]
    return spark.read.schema(T.StructType([*fields, T.StructField(partition, dtype)])).parquet(path)


def plain_path(path: Column, encoded: bool = True) -> Column:
    """A file path with its own characters: ``_metadata.file_path`` is URL-encoded, listings are not. A local scheme goes."""
    text = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))) if encoded else path
    return F.regexp_replace(text, "^file:/+", "/")


def merge_partitions(path: str, staging: DataFrame, keys: Sequence[str], partition: str, newest_by: Sequence[str] = (), batch: str | None = None) -> int:
    """Upsert into a folder partitioned by ``partition``, rewriting only the partitions it touches.

    Touched are the partitions staging brings rows for and those that hold a
    replaced key. Their new contents are written aside first and then put in place
    by dynamic overwrite; a partition left without rows is emptied under the folder
    name its files have. Partition values have the type they have in staging and
    stay in the cluster, but for the folders to empty.

    A named ``batch`` is merged once: run again it does nothing, or puts what was written
    aside in place if that did not come to its end. Returns the number of partitions rewritten.
    """
    spark = staging.sparkSession
    dtype = staging.schema[partition].dataType
    if batch is not None:
        noted = _noted(spark, path, batch)
        if noted is not None:
            if noted["state"] == "written":
                fields = [f for f in read_partitioned(spark, path, partition, dtype).schema.fields]
                _put_partitions(spark.read.schema(T.StructType(fields)).parquet(noted["aside"]), path, partition, noted["emptied"])
                _done(spark, path, batch, noted["aside"])
            return 0
    staging = cut_lineage(staging)
    target = read_partitioned(spark, path, partition, dtype)
    replaced = staging.select(*keys).distinct()
    holding = target.select(*keys, partition).join(replaced, list(keys), "left_semi").select(partition)
    touched = cut_lineage(holding.unionByName(staging.select(partition)).distinct())
    count = touched.count()
    if not count:
        return 0
    same = lambda df: df[partition].eqNullSafe(touched[partition])
    merged = merge_upsert(target.join(touched, same(target), "left_semi"), staging, keys, newest_by)
    aside = f"{shared_folder(spark)}/merges/{uuid.uuid4().hex}" if batch is not None else work_path(spark, "merge")
    merged.write.parquet(aside)
    fresh = spark.read.schema(merged.schema).parquet(aside)
    left = fresh.select(F.col(partition).alias("_left")).distinct()
    gone = touched.join(left, F.col(partition).eqNullSafe(F.col("_left")), "left_anti").withColumnRenamed(partition, "_gone")
    folder = F.regexp_extract(plain_path(F.col("_metadata.file_path")), "([^/]+)/[^/]+$", 1).alias("folder")
    files = target.select(partition, folder).join(gone, F.col(partition).eqNullSafe(F.col("_gone")), "left_semi")
    emptied = [r["folder"] for r in files.select("folder").distinct().collect()]
    if batch is not None:
        _note(spark, path, batch, "written", aside, emptied)
    _put_partitions(fresh, path, partition, emptied)
    if batch is not None:
        _done(spark, path, batch, aside)
    return count


def _put_partitions(fresh: DataFrame, path: str, partition: str, emptied: Sequence[str]) -> None:
    (
        fresh.hint("rebalance", F.col(partition))
        .write.partitionBy(partition)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )
    rows = T.StructType([f for f in fresh.schema.fields if f.name != partition])
    for folder_name in emptied:
        fresh.sparkSession.createDataFrame([], rows).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{folder_name}")


#: Batches merged into a folder, kept below it; readers pass over names that begin like this.
_MERGES, _MERGE_SCHEMA = "_merges", "batch string, state string, aside string, emptied array<string>"


def _note(spark: SparkSession, path: str, batch: str, state: str, aside: str, emptied: Sequence[str]) -> None:
    spark.createDataFrame([(batch, state, aside, list(emptied))], _MERGE_SCHEMA).write.mode("append").parquet(f"{path.rstrip('/')}/{_MERGES}")


def _done(spark: SparkSession, path: str, batch: str, aside: str) -> None:
    _note(spark, path, batch, "done", aside, [])
    remove_folder(spark, aside)


def _noted(spark: SparkSession, path: str, batch: str):
    """The furthest state of a batch, None if it never got to one."""
    log = f"{path.rstrip('/')}/{_MERGES}"
    if not _exists(spark, log):
        return None
    return spark.read.schema(_MERGE_SCHEMA).parquet(log).where(F.col("batch") == batch).orderBy("state").first()


def load_table(name: str, df: DataFrame, root: str, settings: Mapping[str, object] | None = None, **defaults) -> None:
    """Load by settings, those of the table over the defaults.

    ``load_type`` full or incremental, ``primary_key`` and ``truncate``. An
    incremental load without a key appends.
    """
    chosen = {**defaults, **(settings or {})}
    key = chosen.get("primary_key")
    keys = [key] if isinstance(key, str) else list(key or [])
    exists = df.sparkSession.catalog.tableExists(name)
    if chosen.get("load_type", "full") == "incremental" and keys and exists:
        merge_table(name, df, keys, root)
    else:
        load_full(name, df, root, bool(chosen.get("truncate", False)))


def replace_slice(df: DataFrame, path: str, key: str) -> None:
    """Put the rows of each ``key`` in place of those there, leaving other keys alone.

    ``rebalance`` evens out the files of large slices and of small ones.
    """
    (
        df.hint("rebalance", F.col(key))
        .write.partitionBy(key)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def bookmark_of(spark: SparkSession, path: str, table_name: str, dtype: T.DataType | None = None):
    """The largest bookmark stored for a table, compared as values of the type it was stored with."""
    try:
        rows = spark.read.schema("table_name string, bookmark string, kind string").parquet(path).filter(F.col("table_name") == table_name)
        kind = dtype.simpleString() if dtype is not None else rows.agg(F.max("kind")).first()[0] or "string"
        return rows.agg(F.max(F.col("bookmark").cast(kind)).cast("string")).first()[0]
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def load_incremental(
    name: str, source: DataFrame, column: str, bookmarks: str, root: str, keys: Sequence[str] = (), newest_by: Sequence[str] = ()
) -> dict[str, object]:
    """Load the rows after the table's own bookmark and move it to the largest value loaded.

    Values are compared in the type of the column, so 10 comes after 9. The bookmark
    moves only after the load, and only forward.
    """
    spark = source.sparkSession
    dtype = source.schema[column].dataType
    bookmark = bookmark_of(spark, bookmarks, name, dtype)
    fresh = incremental_filter(source, column, bookmark)
    if fresh.isEmpty():
        return {"status": "no_new_data", "rows_loaded": 0, "bookmark": bookmark}
    seen = Observation(f"load_{uuid.uuid4().hex}")
    # Written once, so that what is counted is what is loaded, whatever the source does meanwhile.
    counted = cut_lineage(fresh.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(F.col(quoted(column))).cast("string").alias("latest")))
    if keys and spark.catalog.tableExists(name):
        merge_table(name, counted, keys, root, newest_by)
    else:
        load_full(name, counted, root)
    rows, latest = seen.get["rows"], seen.get["latest"]
    record = [(name, latest, dtype.simpleString())]
    spark.createDataFrame(record, "table_name string, bookmark string, kind string").write.mode("append").parquet(bookmarks)
    return {"status": "loaded", "rows_loaded": rows, "bookmark": latest}


def stored_bytes(spark: SparkSession, name: str) -> int:
    """Bytes of the files of a table."""
    return source_size(list_data_files(file_listing(spark, table_location(spark, name)), "PARQUET")).first()["total_bytes"]


def load_with_history(
    name: str, df: DataFrame, root: str, history: str, load_type: str = "full", source: str | None = None, file_format: str | None = None, **settings
) -> str:
    """Load and append a row about it to the history, counted while writing; a failed load is recorded too.

    ``bytes_loaded`` is what the files of the table have grown by, or all of them where
    the load replaced them. ``source`` and ``file_format`` say where the rows came from.
    """
    spark = df.sparkSession
    schema_name, _, table_name = name.rpartition(".")
    place = lambda: table_location(spark, name) if spark.catalog.tableExists(name) else None
    where = place()
    before = stored_bytes(spark, name) if where else 0
    counted = Observation(f"rows_{uuid.uuid4().hex}")
    started = datetime.now(timezone.utc)
    status, error, rows, size = "completed", None, 0, 0
    try:
        load_table(name, df.observe(counted, F.count(F.lit(1)).alias("rows")), root, load_type=load_type, **settings)
        rows = counted.get["rows"]
        size = stored_bytes(spark, name) - (before if place() == where else 0)
    except Exception as failure:  # noqa: BLE001 - recorded, then raised by the caller if wanted
        status, error = "failed", str(failure).splitlines()[0]
    ended = datetime.now(timezone.utc)
    took = (ended - started).total_seconds()
    record = (uuid.uuid4().hex, schema_name or None, table_name, source, file_format, load_type, status, started, ended, took, rows, size, error)
    spark.createDataFrame([record], HISTORY_SCHEMA).write.mode("append").parquet(history)
    return status


def new_files(files: DataFrame, registered: DataFrame) -> DataFrame:
    """Listed files whose path is not registered yet, as plain paths."""
    plain = files.withColumn("path", plain_path(F.col("path"), encoded=False))
    return plain.join(registered.select("path").distinct(), "path", "left_anti")


#: ``modified`` is the time of a file, and in the record that ends a batch the mark it leaves.
REGISTRY_SCHEMA = "batch string, path string, state string, modified timestamp"


def append_new_files(
    name: str, files: DataFrame, registry: str, root: str, schema: T.StructType, file_format: str = "parquet", options: Mapping[str, str] | None = None
) -> int:
    """Append the files not registered yet and register them; returns how many.

    The registry records a batch and its files as begun before the append and as
    done after it. Only files of a batch that never ended are looked for in the
    target, which has the path of each row in ``source_file``; if the registry is lost,
    that holds for all listed files. Names pass through the driver, as Spark's
    own file index holds them there anyway, and are read as one append.
    """
    return _append_files(name, files, registry, root, schema, file_format, options)


def _append_files(
    name: str, files: DataFrame, registry: str, root: str, schema: T.StructType, file_format: str, options: Mapping[str, str] | None,
    mark: datetime | None = None, replace: bool = False, doubt: bool = False,
) -> int:
    """The batch of :func:`append_new_files`; ``mark`` is what earlier batches left, ``replace`` gives the table new
    contents, ``doubt`` looks for all files in the target."""
    spark = files.sparkSession
    known = spark.read.schema(REGISTRY_SCHEMA).parquet(registry) if _exists(spark, registry) else None
    done = spark.createDataFrame([], "path string")
    if known is not None:
        ended = known.filter("state = 'done'").select("batch").distinct()
        done = known.filter("state = 'begun'").join(ended, "batch", "left_semi")
        # files from before the mark are not listed any more
        done = (done if mark is None else done.filter(F.col("modified").isNull() | (F.col("modified") >= F.lit(mark)))).select("path")
    at = modified_at(files) if "modification_time" in files.columns else F.lit(None).cast("timestamp")
    fresh = new_files(files.withColumn("modified", at), done).groupBy("path").agg(F.max("modified").alias("modified"))
    fresh = cut_lineage(fresh)
    doubtful = fresh if known is None or doubt else fresh.join(known.select("path").distinct(), "path", "left_semi")
    if not replace and spark.catalog.tableExists(name) and not doubtful.isEmpty():
        there = spark.table(name).select(F.col("source_file").alias("path")).join(doubtful, "path", "left_semi").distinct()
        fresh = cut_lineage(fresh.join(there, "path", "left_anti"))
    paths = [row["path"] for row in fresh.select("path").toLocalIterator()]
    if not paths:
        return 0
    batch = uuid.uuid4().hex
    record = lambda df, state: df.select(F.lit(batch).alias("batch"), "path", F.lit(state).alias("state"), "modified").write.mode("append").parquet(registry)
    record(fresh, "begun")
    rows = spark.read.format(file_format).schema(schema).options(**(options or {})).load([_escaped(p) for p in paths])
    load_full(name, rows.withColumn("source_file", plain_path(F.col("_metadata.file_path"))), root, truncate=replace)
    # the end of the batch and the mark it leaves are one row
    newest = F.max("modified") if mark is None else F.greatest(F.max("modified"), F.lit(mark))
    record(fresh.agg(F.lit("").alias("path"), newest.alias("modified")), "done")
    return len(paths)


def stored_mark(spark: SparkSession, registry: str) -> datetime | None:
    """The mark that the batches of a registry left: the latest time of a file that was loaded."""
    if not _exists(spark, registry):
        return None
    return spark.read.schema(REGISTRY_SCHEMA).parquet(registry).filter("state = 'done'").agg(F.max("modified")).first()[0]


def load_files_since_mark(
    name: str, files: DataFrame, registry: str, root: str, schema: T.StructType, file_format: str = "parquet", options: Mapping[str, str] | None = None, reload: bool = False
) -> dict[str, object]:
    """Append the files that changed since the table's mark, and move the mark; ``reload`` starts over with all files.

    ``files`` is a listing with ``modification_time``. Files before the mark are passed over
    without looking at their names. Times are compared in full; files as old as the
    mark are told apart by the registry, so one that arrives later within the same
    second is loaded and none is loaded twice. A time that is missing or cannot be read
    keeps the file in, for the registry to decide.

    The mark is stored in the record that ends the batch, so it moves with the registry
    and only when the batch succeeded. A reload fills a registry of its own and replaces the contents of the
    table; until it ends, the earlier registry and its mark hold.
    """
    spark = files.sparkSession
    finished, begun = _generations(spark, registry)
    current = max(finished, default=0)
    mark = stored_mark(spark, f"{registry}/generation={current}") if finished and not reload else None
    # a reload that never ended may have replaced the table
    doubt = any(g > current for g in begun)
    number = max([current, *begun], default=0) + 1 if reload else current
    since = files if mark is None else files.filter(F.coalesce(modified_at(files) >= F.lit(mark), F.lit(True)))
    count = _append_files(name, since, f"{registry}/generation={number}", root, schema, file_format, options, mark, reload, doubt and not reload)
    return {"files": count, "mark": stored_mark(spark, f"{registry}/generation={number}") if count else mark}


def _generations(spark: SparkSession, registry: str) -> tuple[list[int], list[int]]:
    """Numbers of the loads from the start that came to an end, and of all that were begun."""
    if not _exists(spark, registry):
        return [], []
    log = spark.read.schema(f"{REGISTRY_SCHEMA}, generation int").parquet(registry)
    states = log.groupBy("generation").agg(F.bool_or(F.col("state") == "done").alias("ended")).collect()
    return [r["generation"] for r in states if r["ended"]], [r["generation"] for r in states]


def _escaped(path: str) -> str:
    """A plain path as a reader takes it, which would read these characters as a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").limit(1).collect()
        return True
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def table_location(spark: SparkSession, name: str) -> str:
    return spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter(F.col("col_name") == "Location").first()["data_type"]


def evolve_table(name: str, incoming: DataFrame) -> None:
    """Append rows whose schema has grown. Only the catalog entry changes: old files are read under the wider schema.

    New columns are added in place. A widened type needs a new entry over the same folder.
    """
    spark = incoming.sparkSession
    old = spark.table(name).schema
    changes = refuse_incompatible(schema_changes(old, incoming.schema))
    kinds = {kind for _, kind, _, _ in changes}
    new = [incoming.schema[column] for column, kind, _, _ in changes if kind == "new"]
    if "promotion" in kinds:
        fields = [T.StructField(f.name, incoming.schema[f.name].dataType) for f in old.fields]
        path = table_location(spark, name)
        spark.sql(f"DROP TABLE {name}")
        spark.catalog.createTable(name, path=path, source="parquet", schema=T.StructType(fields + [T.StructField(f.name, f.dataType) for f in new]))
    elif new:
        added = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({added})")
    append_table(name, incoming)
