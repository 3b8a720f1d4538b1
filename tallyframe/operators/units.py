"""Tables kept in units, so that an upsert rewrites only the units that hold one of its keys.

A unit is a folder ``unit=<name>`` of a few Parquet files. First loads cut the table into
ranges of the key; every merged batch adds a unit of its own. Files carry the key's
smallest and largest value of each row group, and a Bloom filter of the keys, which
Parquet writes with them and Spark reads instead of rows it can skip. A filter is as
large as the keys of its row group ask for, so small units stay small files.

A file and a folder cost milliseconds each, whatever they hold, so a table that is loaded
in more than ``FOLDERS`` units keeps them in packs instead: files that many units share,
with the unit's name in a column. A pack is never changed. Units that are written anew
are rows of a later pack, and a log names the pack that holds a unit from then on; a pack
the log does not name is not part of the table. Both are below a folder that readers of
plain files pass over: rows of packs are read by :func:`read_units` only. Rows that later
packs replaced go by :func:`fold_packs`.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.values import quoted
from tallyframe.operators.load import newest_rows, plain_path, read_partitioned, table_location
from tallyframe.session import cut_lineage, folder_exists, remove_folder

UNIT = "unit"
#: Ranges of staged keys that a scan is held against.
RANGES = 64
#: At most so many keys are looked up one by one, by the Bloom filters of the files.
LOOKUPS = 10
#: Sizes a Bloom filter is tried in, each half the one before, from Parquet's megabyte down to 32 bytes; the smallest that fits is written.
FILTER_SIZES = 16
#: Batches merged so far, below the folder of the table; readers pass over names that begin like this.
_LOG = "_merged"
#: A first load of more units writes packs, not a folder for each unit.
FOLDERS = 1_000
#: Rows of a file of a pack, as many as a Bloom filter of Parquet's megabyte tells apart.
PACK_ROWS = 1 << 19
_PACK, _PACKS, _PACK_LOG = "_pack", "_packs/rows", "_packs/log"
#: The ``n``-th pack adds to those before (kind ``pack``) or stands for all of them (``all``); it holds a ``unit`` from then on.
_PACK_SCHEMA = "kind string, _pack string, unit string, n bigint"


def write_units(df: DataFrame, path: str, keys: Sequence[str], units: int | None = None, unit: Column | None = None) -> None:
    """Write ``df`` in units: by ``unit``, an expression, or else in ranges of the keys, ``units`` of them.

    Units that are there by the same name are replaced, others stay.
    """
    spark = df.sparkSession
    if unit is not None:
        rows = df.withColumn(UNIT, unit.cast("string"))
    else:
        order = [F.col(quoted(k)) for k in keys]
        ranged = df.repartitionByRange(units, *order) if units else df.repartitionByRange(*order)
        rows = ranged.withColumn(UNIT, F.format_string("range-%06d", F.spark_partition_id()))
    if _in_packs(spark, path):
        kept = cut_lineage(_named(rows))
        _write_pack(kept, path, keys, kept.select(UNIT).distinct())
    elif not _in_folders(spark, path) and (_more_than(FOLDERS, rows) if unit is not None else (units or 0) > FOLDERS):
        _write_pack(cut_lineage(_named(rows)), path, keys)
    else:
        dealt = rows.hint("rebalance", F.col(UNIT)) if unit is not None else rows
        _write(dealt.sortWithinPartitions(UNIT, *[F.col(quoted(k)) for k in keys]), path, keys)


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all units, with the name of their ``unit``."""
    if not _in_packs(spark, path):
        return read_partitioned(spark, path, UNIT, T.StringType())
    rows, newest = _packs(spark, path)
    found = rows.join(newest, F.col(UNIT).eqNullSafe(F.col("_unit")), "left").where(f"_newest is null or _newest = {_PACK}")
    return found.select(*[F.col(quoted(c)) for c in rows.columns if c not in (UNIT, _PACK)], UNIT)


def _packs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows of all packs that count, and the pack that holds each unit that was written again."""
    log = _pack_log(spark, path)
    names = [r[_PACK] for r in log.where("kind <> 'unit'").select(_PACK).collect()]
    rows = read_partitioned(spark, f"{path.rstrip('/')}/{_PACKS}", _PACK, T.StringType()).where(F.col(_PACK).isin(names))
    return rows, log.where("kind = 'unit'").groupBy(F.col(UNIT).alias("_unit")).agg(F.max_by(_PACK, "n").alias("_newest"))


def _in_packs(spark: SparkSession, path: str) -> bool:
    return folder_exists(spark, f"{path.rstrip('/')}/{_PACK_LOG}")


def _in_folders(spark: SparkSession, path: str) -> bool:
    return folder_exists(spark, path) and any(name.startswith(f"{UNIT}=") for name in _folders(spark, path))


def _more_than(count: int, rows: DataFrame) -> bool:
    return rows.select(UNIT).distinct().limit(count + 1).count() > count


def _named(rows: DataFrame) -> DataFrame:
    """Names of units as folders would keep them: an empty one comes back as NULL."""
    return rows.withColumn(UNIT, F.nullif(F.col(UNIT), F.lit("")))


def _pack_log(spark: SparkSession, path: str) -> DataFrame:
    """What the log says from the last pack that stands for all before it."""
    log = spark.read.schema(_PACK_SCHEMA).parquet(f"{path.rstrip('/')}/{_PACK_LOG}")
    first = log.where("kind = 'all'").agg(F.max(F.struct("n", _PACK)).alias("r")).first()["r"]
    return log if first is None else log.where((F.col("n") >= first["n"]) & ((F.col("kind") != "all") | (F.col(_PACK) == first[_PACK])))


def _last_pack(spark: SparkSession, path: str) -> int:
    return (_pack_log(spark, path).agg(F.max("n")).first()[0] or 0) if _in_packs(spark, path) else 0


def _filtered(writer: DataFrameWriter, keys: Sequence[str]) -> DataFrameWriter:
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.candidates.number#{key}", str(FILTER_SIZES))
    return writer.option("parquet.bloom.filter.adaptive.enabled", "true")


def _write(rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    _filtered(rows.write.partitionBy(UNIT).mode("overwrite").option("partitionOverwriteMode", "dynamic"), keys).parquet(path)


def _write_pack(rows: DataFrame, path: str, keys: Sequence[str], held: DataFrame | None = None, kind: str = "pack", after: int | None = None) -> None:
    """Write materialised ``rows`` as a pack, which takes the place of all earlier rows of the units ``held``.

    Units lie one after the other by their smallest key, rows of one unit by their keys, so
    the ranges that files and their pages keep are narrow. Rows of one key may be many:
    their places tell them apart, so they are cut as well. What the log says of a pack is
    one file, and once it is there the pack counts.
    """
    spark, root, pack = rows.sparkSession, path.rstrip("/"), f"p{uuid.uuid4().hex}"
    starts = rows.groupBy(F.col(UNIT).alias("_unit")).agg(F.min(quoted(keys[0])).alias("_start"))
    placed = rows.withColumn("_place", F.monotonically_increasing_id()).join(starts, F.col(UNIT).eqNullSafe(F.col("_unit")), "left")
    order = [F.col(quoted(c)) for c in ("_start", UNIT, *keys, "_place")]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(quoted(c)) for c in rows.columns])
    _filtered(dealt.write.option("maxRecordsPerFile", PACK_ROWS), keys).parquet(f"{root}/{_PACKS}/{_PACK}={pack}")
    said = spark.range(1).select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias(UNIT))
    if held is not None:
        said = said.unionByName(held.select(F.lit("unit").alias("kind"), UNIT))
    n = (_last_pack(spark, path) if after is None else after) + 1
    said.withColumn(_PACK, F.lit(pack)).coalesce(1).write.mode("append").parquet(f"{root}/{_PACK_LOG}/n={n}")


def near_keys(staged: DataFrame, key: str) -> Column:
    """A filter that rows with a staged key pass, made of values so that it reaches the scan.

    A few keys are listed. Of more, ranges are taken that hold equal shares of them,
    so a batch of recent keys, or of a few stretches, passes over the rest of the table.
    """
    values = staged.select(F.col(quoted(key)).alias("k")).where("k is not null")
    some = values.distinct().limit(LOOKUPS + 1).collect()
    if len(some) <= LOOKUPS:
        return F.col(quoted(key)).isin([r["k"] for r in some]) if some else F.lit(False)
    ranged = values.repartitionByRange(RANGES, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("a"), F.max("k").alias("b"))
    return reduce(Column.__or__, [F.col(quoted(key)).between(F.lit(r["a"]), F.lit(r["b"])) for r in ranged.collect()])


def merge_units(path: str, staging: DataFrame, keys: Sequence[str], batch: str | int, newest_by: Sequence[str] = ()) -> list[str]:
    """Upsert ``staging`` into the units below ``path``; returns the names of the units that had to be rewritten.

    Touched are the units that hold a staged key: found by their key columns alone,
    and only in those parts of files whose ranges or Bloom filters may hold one. They
    are written anew without these keys; the staged rows become the unit of this
    ``batch``. All of it is written aside first and then put in place by one dynamic overwrite,
    or, in a table of packs, by one file of their log.

    A batch that was merged is not merged again. One that ended half way is run again
    and completes: keys that are gone already touch nothing, and the batch's unit is
    replaced as a whole, so also rows with a NULL key, which never match, are there once.
    Staging keys as in :func:`merge_upsert`. Names of units pass through the driver, whose
    file index holds them all anyway.
    """
    spark = staging.sparkSession
    if batch_is_merged(spark, path, batch):
        return []
    packed = _in_packs(spark, path)
    staged = cut_lineage(newest_rows(staging, keys, newest_by) if newest_by else staging)
    own = f"batch-{batch}"
    target = read_units(spark, path).where(F.col(UNIT) != own)
    replaced = staged.select(*[F.col(quoted(k)) for k in keys]).distinct()
    holding = target.where(near_keys(staged, keys[0])).select(*[F.col(quoted(k)) for k in keys], UNIT).join(replaced, list(keys), "left_semi")
    names = holding.select(UNIT).distinct()
    if packed:
        names = cut_lineage(names)
    touched = sorted(r[UNIT] for r in names.collect())
    columns = [F.col(quoted(c)) for c in target.columns if c != UNIT]
    whole = target.join(names, UNIT, "left_semi") if packed and len(touched) > FOLDERS else target.where(F.col(UNIT).isin(touched))
    stripped = whole.join(replaced, list(keys), "left_anti").select(*columns, UNIT)
    fresh = cut_lineage(stripped.unionByName(staged.select(*columns, F.lit(own).alias(UNIT))))
    if packed:
        _write_pack(fresh, path, keys, names.unionByName(spark.range(1).select(F.lit(own).alias(UNIT))))
        _note_merged(spark, path, batch)
        return touched
    folder = F.regexp_extract(plain_path(F.col("_metadata.file_path")), "([^/]+)/[^/]+$", 1).alias("folder")
    left = {r[UNIT] for r in fresh.select(UNIT).distinct().collect()}
    gone = [u for u in touched if u not in left]
    emptied = [r["folder"] for r in target.where(F.col(UNIT).isin(gone)).select(folder).distinct().collect()] if gone else []
    _write(fresh.hint("rebalance", F.col(UNIT)), path, keys)
    nothing = T.StructType([f for f in target.schema.fields if f.name != UNIT])
    for name in emptied:
        spark.createDataFrame([], nothing).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
    _note_merged(spark, path, batch)
    return touched


def _note_merged(spark: SparkSession, path: str, batch: str | int) -> None:
    spark.createDataFrame([(str(batch),)], "batch string").write.mode("append").parquet(f"{path.rstrip('/')}/{_LOG}")


def batch_is_merged(spark: SparkSession, path: str, batch: str | int) -> bool:
    """Whether a batch was merged to its end."""
    log = f"{path.rstrip('/')}/{_LOG}"
    if not folder_exists(spark, log):
        return False
    return not spark.read.schema("batch string").parquet(log).where(F.col("batch") == str(batch)).isEmpty()


def drop_superseded(spark: SparkSession, name: str, root: str, grace_seconds: float = 7 * 24 * 3600) -> list[str]:
    """Delete the folders of earlier contents of table ``name`` below ``root``, once the grace period is over.

    Loads that give a table new contents leave the old ones to readers that still use
    them. Kept are the folder the table points to, whatever its age, and folders that
    were changed within the grace period. Returns the names of the deleted folders.
    """
    if not folder_exists(spark, root):
        return []
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    current = spark._jvm.org.apache.hadoop.fs.Path(table_location(spark, name)).getName()
    now, deleted = spark.sql("SELECT unix_millis(now()) AS t").first()["t"], []
    for status in system.listStatus(base):
        folder = status.getPath().getName()
        ours = folder.startswith(f"{name}-") and status.isDirectory() and folder != current
        if ours and now - status.getModificationTime() >= 1000 * grace_seconds:
            system.delete(status.getPath(), True)
            deleted.append(folder)
    return sorted(deleted)


def fold_packs(spark: SparkSession, path: str, keys: Sequence[str], grace_seconds: float = 7 * 24 * 3600) -> list[str]:
    """Write the rows of a table of packs as one pack, once most of those on disk were replaced or packs are many, and delete what no longer counts.

    Packs that were folded, and the log about them, stay for readers that still use them
    until the grace period is over, as do packs whose load did not come to its end. A
    batch merged meanwhile is kept: its pack comes after those that were read. Returns
    the names of the deleted folders.
    """
    if not _in_packs(spark, path):
        return []
    last, (rows, _), live = _last_pack(spark, path), _packs(spark, path), read_units(spark, path)
    if rows.count() > 2 * live.count() or rows.select(_PACK).distinct().count() > FOLDERS:
        _write_pack(cut_lineage(live), path, keys, kind="all", after=last)
    log = _pack_log(spark, path).where("kind <> 'unit'").collect()
    counting, whole = {f"{_PACK}={r[_PACK]}" for r in log}, {f"{_PACK}={r[_PACK]}" for r in log if r["kind"] == "all"}
    first = min((r["n"] for r in log), default=0)
    packs, lines = _folders(spark, f"{path.rstrip('/')}/{_PACKS}"), _folders(spark, f"{path.rstrip('/')}/{_PACK_LOG}")
    now, deleted = spark.sql("SELECT unix_millis(now()) AS t").first()["t"], []
    past = lambda status: now - status.getModificationTime() >= 1000 * grace_seconds
    if all(past(packs[name]) for name in whole):
        old = {name: s for name, s in packs.items() if name not in counting} | {name: s for name, s in lines.items() if int(name.removeprefix("n=")) < first}
        for name, status in old.items():
            if past(status):
                remove_folder(spark, status.getPath().toString())
                deleted.append(name)
    return sorted(deleted)


def _folders(spark: SparkSession, path: str) -> dict[str, object]:
    """Status of the folders ``name=value`` below a folder, by name."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = {s.getPath().getName(): s for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)}
    return {name: s for name, s in found.items() if "=" in name}
