"""Record match of partitioned tables that remembers: digests of key ranges are kept, and only what differs is read again.

Keys fall into 2^16 ranges of their hash. Of each range in each partition the table
has a digest: the number of keys, of keys that come several times, and sums of hashes
of key and record, in which the order of the rows does not matter. Digests of
wider ranges are sums of those of narrower ones, so two tables are compared from
one range for a whole partition down to the narrowest, and equal ranges are left
where they are found.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.values import key_text, quoted
from tallyframe.operators import records
from tallyframe.operators.load import plain_path, read_partitioned
from tallyframe.session import cut_lineage, folder_exists
from tallyframe.sources.files import file_listing, list_data_files

#: Bits of the hash that name a range, from the widest ranges to the narrowest.
LEVELS = (0, 4, 8, 12, 16)
_SUMS = ["keys", "repeated", "a_high", "a_low", "b_high", "b_low"]
_KEPT = "range int, keys bigint, repeated bigint, a_high bigint, a_low bigint, b_high bigint, b_low bigint, files string, part string"


@dataclass
class Side:
    """A table in folders by one text column, and the folder in which its digests are kept."""

    path: str
    partition: str
    state: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return read_partitioned(spark, self.path, self.partition, T.StringType())


def _range(keys: Sequence[str], bits: int = LEVELS[-1]) -> Column:
    """The range of a row's key, by the upper bits of a hash of the key as text."""
    hashed = F.xxhash64(*[key_text(F.col(quoted(k))) for k in keys])
    return F.shiftrightunsigned(hashed, 64 - bits).cast("int")


def _name(value: Column) -> Column:
    """A partition by its value, such that no value is taken for the partition of NULL."""
    return F.coalesce(F.concat(F.lit("="), value), F.lit("-"))


def _only(side: Side, names: Sequence[str]) -> Column:
    """A filter for some partitions, which reaches the scan."""
    values = [n[1:] for n in names if n.startswith("=")]
    found = F.col(quoted(side.partition)).isin(values)
    return found | F.col(quoted(side.partition)).isNull() if "-" in names else found


def partition_files(spark: SparkSession, side: Side) -> DataFrame:
    """(part, files): a digest of name, time and length of all files of each partition."""
    files = list_data_files(file_listing(spark, side.path), "PARQUET")
    folder = plain_path(F.regexp_extract("path", f"/{side.partition}=([^/]*)/[^/]*$", 1))
    part = _name(F.when(folder != "__HIVE_DEFAULT_PARTITION__", folder))
    marks = F.array_sort(F.collect_list(F.concat_ws("|", F.regexp_extract("path", "([^/]+)$", 1), F.unix_micros("modification_time").cast("string"), F.col("length").cast("string"))))
    return files.groupBy(part.alias("part")).agg(F.md5(F.array_join(marks, "\n")).alias("files"))


def range_digests(rows: DataFrame, partition: str, other: DataFrame, keys: Sequence[str], tag: int) -> DataFrame:
    """(part, range, sums) of a table whose records are compared with ``other``; ``tag`` 0 is the source, 1 the target.

    Repeated keys fold to their largest fingerprint first, as in :func:`records.record_index`.
    """
    rows, other = records.lower_names(rows), records.lower_names(other)
    own, theirs = records.types_of(rows), records.types_of(other)
    columns = [c for c in (rows if tag == 0 else other).columns if c not in keys]
    prints = rows.select(_name(F.col(quoted(partition.lower()))).alias("_part"), *[key_text(F.col(quoted(k))).alias(k) for k in keys], records.fingerprint(own, theirs, columns, tag).alias("_print"))
    folded = prints.groupBy("_part", *keys).agg(F.max("_print").alias("_print"), F.count(F.lit(1)).alias("_copies"))
    hashes = {"a": F.xxhash64(*keys, "_print"), "b": F.xxhash64(F.lit("digest"), "_print", *keys)}
    # halves of 32 bits, so that no sum leaves a long
    halves = {f"{n}_{h}": F.sum(v) for n, c in hashes.items() for h, v in (("high", F.shiftright(c, 32)), ("low", c.bitwiseAND(F.lit(0xFFFFFFFF))))}
    return folded.groupBy(F.col("_part").alias("part"), _range(keys).alias("range")).agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(F.col("_copies") > 1).alias("repeated"), *[v.alias(n) for n, v in halves.items()]
    )


def refresh(spark: SparkSession, side: Side, other: Side, keys: Sequence[str], tag: int) -> tuple[DataFrame, list[str]]:
    """The digests of all partitions, and the partitions that were read for them: those whose files are not as they were.

    Names of partitions pass through the driver, whose file index holds them anyway.
    """
    now = cut_lineage(partition_files(spark, side))
    known = folder_exists(spark, side.state)
    kept = spark.read.schema(_KEPT).parquet(side.state) if known else spark.createDataFrame([], _KEPT)
    stale = cut_lineage(now.join(kept.select("part", "files").distinct(), ["part", "files"], "left_anti"))
    changed = sorted(r["part"] for r in stale.collect())
    if changed:
        found = range_digests(side.rows(spark).where(_only(side, changed)), side.partition, other.rows(spark), keys, tag)
        # a partition without rows leaves a row that notes its files
        noted = stale.join(found, "part", "left").select(*[f.split()[0] for f in _KEPT.split(", ")])
        noted.write.mode("overwrite").partitionBy("part").option("partitionOverwriteMode", "dynamic").parquet(side.state)
        kept = spark.read.schema(_KEPT).parquet(side.state)
    # partitions that are gone do not count
    return kept.join(now, ["part", "files"], "left_semi").where("keys is not null").select("part", "range", *_SUMS), changed


def differing(source: DataFrame, target: DataFrame) -> DataFrame:
    """(part, range) whose digests differ, found level by level: below a range that is equal nothing is looked at."""
    both = source.withColumn("tag", F.lit(0)).unionByName(target.withColumn("tag", F.lit(1)))
    left: DataFrame | None = None
    for bits in LEVELS:
        wide = F.shiftrightunsigned("range", LEVELS[-1] - bits)
        level = both.withColumn("at", wide)
        if left is not None:
            level = level.withColumn("above", F.shiftrightunsigned("at", bits - before)).join(left, ["part", "above"], "left_semi")
        totals = level.groupBy("part", "at", "tag").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in _SUMS])
        sides = totals.groupBy("part", "at").agg(F.count(F.lit(1)).alias("n"), *[(F.min(c) != F.max(c)).alias(c) for c in _SUMS if c != "repeated"])
        unequal = reduce(Column.__or__, [F.col(c) for c in _SUMS if c != "repeated"], F.col("n") < 2)
        left, before = sides.where(unequal).select("part", F.col("at").alias("above")), bits
    return left.select("part", F.col("above").alias("range"))


def record_match_kept(spark: SparkSession, source: Side, target: Side, keys: Sequence[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """(counts, partitions read): the counts of :func:`records.record_match_pk`, by way of kept digests.

    Both sides are partitioned by one rule, so that a key lies in partitions of one name on
    both. Digests of changed partitions are made anew; where digests of a range are equal its
    keys are matched, and only rows of ranges that differ are compared, from their
    partitions alone. ``read`` names the partitions read for digests of the source and
    of the target, and those ``compared``. Digests are sums of two 64-bit hashes.
    """
    keys = [k.lower() for k in keys]
    mine, read_source = refresh(spark, source, target, keys, 0)
    theirs, read_target = refresh(spark, target, source, keys, 1)
    ranges = cut_lineage(differing(mine, theirs))
    parts = sorted(r["part"] for r in ranges.select("part").distinct().collect())

    def rows(side: Side) -> DataFrame:
        found = records.lower_names(side.rows(spark).where(_only(side, parts)))
        marked = found.withColumn("_part", _name(F.col(quoted(side.partition.lower())))).withColumn("_range", _range(keys))
        wanted = ranges.select(F.col("part").alias("_part"), F.col("range").alias("_range"))
        return marked.join(wanted, ["_part", "_range"], "left_semi").drop("_part", "_range")

    equal = mine.join(ranges, ["part", "range"], "left_anti").agg(F.coalesce(F.sum("keys"), F.lit(0)).alias("keys"), F.coalesce(F.sum("repeated"), F.lit(0)).alias("ours")).first()
    repeated = theirs.join(ranges, ["part", "range"], "left_anti").agg(F.coalesce(F.sum("repeated"), F.lit(0)).alias("n")).first()["n"]
    counts = records.record_match_pk(rows(source), rows(target), keys)
    more = {"total_compared": equal["keys"], "matched_count": equal["keys"], "source_duplicate_keys": equal["ours"], "target_duplicate_keys": repeated}
    return counts.withColumns({c: F.col(c) + F.lit(n) for c, n in more.items()}), {"source": read_source, "target": read_target, "compared": parts}
