"""Record-by-record comparison of two tables.

Both sides are tagged, put under one another and grouped by key once. Only the
key and a 64-bit fingerprint of the compared columns travel, and repeated keys
fold before the shuffle, so a key that holds a third of all rows costs one row
per map task. Fingerprints are only ever compared within one key, hence a wrong
match needs two different rows of the same key to collide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tallyframe.functions.types import literal
from tallyframe.functions.values import NULL_MARK, comparable, fingerprint_form, has_map, is_nan, key_text, quoted, shown, shown_sql, values_equal
from tallyframe.operators.parity import SAMPLE_ROWS
from tallyframe.session import cut_lineage


def types_of(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name.lower(): f.dataType for f in df.schema.fields}


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def _check_keys(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> list[str]:
    lowered = [k.lower() for k in keys]
    for side, df in (("source", source), ("target", target)):
        absent = [k for k in lowered if k not in types_of(df)]
        if absent:
            raise ValueError(f"Match key column(s) not found in {side} table: {', '.join(absent)}")
    return lowered


def fingerprint(own: dict[str, T.DataType], other: dict[str, T.DataType], columns: Sequence[str], side: int) -> Column:
    parts, nans = [], []
    for name in columns:
        if name not in own:
            # A column this side does not have compares as NULL.
            parts.append("true, CAST(NULL AS STRING)")
            continue
        column = quoted(name)
        parts.append(f"{column} IS NULL, {fingerprint_form(column, own[name], other.get(name))}")
        nan = is_nan(column, own[name])
        if nan:
            nans.append(f"coalesce({nan}, false)")
    # A NaN equals nothing, so such rows get a fingerprint of their side.
    marked = f"if({' OR '.join(nans)}, {side}, -1)" if nans else "-1"
    return F.expr(f"xxhash64({', '.join([marked, *parts])})")


def record_index(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: copies and fingerprint per side, and the resulting ``record_status``.

    Columns compared are those of the source. Of several rows with one key the
    one with the largest fingerprint stands for all.
    """
    keys = _check_keys(source, target, keys)
    source, target = lower_names(source), lower_names(target)
    own, other = types_of(source), types_of(target)
    columns = [c for c in source.columns if c not in keys]

    def side(df: DataFrame, mine, theirs, tag: int) -> DataFrame:
        return df.select(
            *[key_text(F.col(k)).alias(k) for k in keys],
            F.lit(tag).alias("_side"),
            fingerprint(mine, theirs, columns, tag).alias("_print"),
        )

    in_source, in_target = F.col("_side") == 0, F.col("_side") == 1
    grouped = (
        side(source, own, other, 0)
        .unionByName(side(target, other, own, 1))
        .groupBy(*keys)
        .agg(
            F.count_if(in_source).alias("source_copies"),
            F.count_if(in_target).alias("target_copies"),
            F.max(F.when(in_source, F.col("_print"))).alias("source_print"),
            F.max(F.when(in_target, F.col("_print"))).alias("target_print"),
        )
    )
    status = (
        F.when(F.col("target_copies") == 0, "missing_in_target")
        .when(F.col("source_copies") == 0, "extra_in_target")
        .when(F.col("source_print") == F.col("target_print"), "matched")
        .otherwise("value_mismatch")
    )
    return grouped.withColumn("record_status", status)


def _counts(index: DataFrame) -> DataFrame:
    def of(status: str) -> Column:
        return F.count_if(F.col("record_status") == status)

    counts = index.agg(
        F.count_if(F.col("source_copies") > 0).alias("total_compared"),
        of("matched").alias("matched_count"),
        of("missing_in_target").alias("missing_count"),
        of("extra_in_target").alias("extra_count"),
        of("value_mismatch").alias("mismatch_count"),
        F.count_if(F.col("source_copies") > 1).alias("source_duplicate_keys"),
        F.count_if(F.col("target_copies") > 1).alias("target_duplicate_keys"),
    )
    found = F.col("missing_count") + F.col("extra_count") + F.col("mismatch_count")
    return counts.withColumn("status", F.when(found > 0, "failed").otherwise("passed"))


def record_match_pk(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of matched, missing, extra and changed records, in one row."""
    return _counts(record_index(source, target, keys))


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of all values joined by ``|``, NULL as a mark."""
    types = types_of(df)
    # maps by their entries in the order of the keys
    values = [F.expr(comparable(quoted(c), types[c])) if has_map(types[c]) else shown(F.col(c), types[c]) for c in columns]
    return F.sha2(F.concat_ws("|", *[F.coalesce(v, F.lit(NULL_MARK)) for v in values]), 256)


def _digest_index(source: DataFrame, target: DataFrame) -> DataFrame:
    source, target = lower_names(source), lower_names(target)
    columns = source.columns
    held = [c for c in columns if c in target.columns]
    target = target.select(*held, *[F.lit(None).cast("string").alias(c) for c in columns if c not in held])
    tagged = [df.select(row_digest(df, columns).alias("row_hash"), F.lit(t).alias("_side")) for t, df in ((0, source), (1, target))]
    return (
        tagged[0]
        .unionByName(tagged[1])
        .groupBy("row_hash")
        .agg(F.count_if(F.col("_side") == 0).alias("source_copies"), F.count_if(F.col("_side") == 1).alias("target_copies"))
        .withColumn(
            "record_status",
            F.when(F.col("target_copies") == 0, "missing_in_target")
            .when(F.col("source_copies") == 0, "extra_in_target")
            .otherwise("matched"),
        )
    )


def record_match_hash(source: DataFrame, target: DataFrame) -> DataFrame:
    """Comparison without a key: whole rows by digest, so only missing and extra exist."""
    return _counts(_digest_index(source, target))


def _distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return lower_names(df).select(*[key_text(F.col(k)).alias(k) for k in keys]).distinct()


def _only_in(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    marked = [_distinct_keys(df, keys).withColumn("_side", F.lit(t)) for t, df in ((0, left), (1, right))]
    return marked[0].unionByName(marked[1]).groupBy(*keys).agg(F.max("_side").alias("_side")).filter("_side = 0").select(*keys)


def rows_missing(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the source the target lacks, NULL being a key like others."""
    return _only_in(source, target, _check_keys(source, target, keys))


def rows_extra(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the target the source lacks."""
    return _only_in(target, source, _check_keys(source, target, keys))


def _paired(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str], dict, dict]:
    """One row per key with the chosen record of each side as a struct."""
    source, target = lower_names(source), lower_names(target)
    own, other = types_of(source), types_of(target)
    columns = [c for c in source.columns if c not in keys] or list(keys)

    def side(df: DataFrame, mine, theirs, tag: int) -> DataFrame:
        record = F.struct(F.lit(True).alias("_held"), *[F.col(c).alias(c) for c in columns if c in mine])
        names = [key_text(F.col(k)).alias(k) for k in keys]
        return df.select(
            *names,
            fingerprint(mine, theirs, columns, tag).alias("_print"),
            *[(record if t == tag else F.lit(None)).alias(f"_r{t}") for t in (0, 1)],
        )

    pairs = (
        side(source, own, other, 0)
        .unionByName(side(target, other, own, 1))
        .groupBy(*keys)
        .agg(
            F.max_by("_r0", F.when(F.col("_r0").isNotNull(), F.col("_print"))).alias("s"),
            F.max_by("_r1", F.when(F.col("_r1").isNotNull(), F.col("_print"))).alias("t"),
        )
    )
    return pairs, columns, own, other


def value_diff(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every differing column of every matched record: keys, position, column and both values.

    The keys whose fingerprints differ are found first, from a key and 64 bits per
    row; only their rows are then brought together and compared by value.
    """
    keys = _check_keys(source, target, keys)
    changed = cut_lineage(record_index(source, target, keys).filter("record_status = 'value_mismatch'").select(*keys))
    return _value_diff(_rows_of(source, changed, keys), _rows_of(target, changed, keys), keys)


def _rows_of(df: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key, as text and with NULL as a key, is in ``chosen``."""
    df = lower_names(df)
    return df.join(chosen, [key_text(df[k]).eqNullSafe(chosen[k]) for k in keys], "left_semi")


def _value_diff(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    pairs, columns, own, other = _paired(source, target, keys)
    found = []
    for position, name in enumerate(columns, start=1):
        left, right = quoted("s", name), quoted("t", name)
        right_type = other.get(name)
        if right_type is None:
            right, right_type = "CAST(NULL AS STRING)", T.StringType()
        found.append(
            f"CASE WHEN NOT {values_equal(left, right, own[name], right_type)} THEN named_struct('position', {position}, "
            f"'column_name', {literal(name)}, 'source_value', {shown_sql(left, own[name])}, 'target_value', {shown_sql(right, right_type)}) END"
        )
    both = F.col("s").isNotNull() & F.col("t").isNotNull()
    return (
        pairs.filter(both)
        .select(*keys, F.expr(f"inline(array_compact(array({', '.join(found)})))"))
        .select(*keys, "position", "column_name", "source_value", "target_value")
    )


def record_samples(source: DataFrame, target: DataFrame, keys: Sequence[str], limit: int = SAMPLE_ROWS) -> DataFrame:
    """Up to ``limit`` discrepancies with key, type and, for a changed record, its first differing column."""
    keys = _check_keys(source, target, keys)
    rank = F.when(F.col("record_status") == "extra_in_target", 1).otherwise(0)
    # Written once, because it is used three times.
    chosen = cut_lineage(
        record_index(source, target, keys)
        .filter("record_status <> 'matched'")
        .orderBy(rank, *keys)
        .limit(limit)
        .select(*keys, "record_status")
    )
    first = (
        _value_diff(_rows_of(source, chosen, keys), _rows_of(target, chosen, keys), keys)
        .groupBy(*keys)
        .agg(F.min_by(F.struct("column_name", "source_value", "target_value"), "position").alias("d"))
    )
    left, right = chosen.alias("c"), first.alias("f")
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return left.join(right, on, "left").select(
        F.col("c.record_status").alias("discrepancy"),
        *[F.col(f"c.{k}").alias(k) for k in keys],
        F.col("f.d.column_name").alias("column_name"),
        F.col("f.d.source_value").alias("source_value"),
        F.col("f.d.target_value").alias("target_value"),
    )


Order = Sequence[tuple[str, bool]]  # column, and whether it descends


def _sorting(order: Order) -> list[Column]:
    return [F.col(quoted(c)).desc_nulls_last() if down else F.col(quoted(c)).asc_nulls_first() for c, down in order]


def _before(order: Order, types: dict[str, T.DataType], values: Sequence) -> Column:
    """Whether a row comes before ``values`` in the order; all are known, so a scan can filter by it."""
    found, level = F.lit(False), F.lit(True)
    for (name, down), value in zip(order, values, strict=True):
        column, bound = F.col(quoted(name)), F.lit(value).cast(types[name])
        if value is None:
            less = column.isNotNull() if down else F.lit(False)
        else:
            less = F.coalesce(column > bound, F.lit(False)) if down else column.isNull() | (column < bound)
        found, level = found | (level & less), level & column.eqNullSafe(bound)
    return found


def _tied(df: DataFrame) -> DataFrame:
    """``df`` with a digest of all columns, which decides between rows that are equal in an order."""
    return df.withColumn("_tie", F.xxhash64(*[quoted(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]))


def ordered_page(df: DataFrame, order: Order, start: int, end: int) -> DataFrame:
    """The rows of :func:`ordered_slice`, in order and without their position, for a slice near the top.

    Every task hands up its first ``end`` rows; deep slices are better cut by ranges.
    """
    return _tied(df).orderBy(*_sorting([*order, ("_tie", False)])).offset(start - 1).limit(end - start + 1).drop("_tie")


def ordered_slice(df: DataFrame, order: Order, start: int, end: int) -> DataFrame:
    """Rows ``start`` to ``end`` (from 1, inclusive) of the sorted frame, numbered as ``position``.

    Rows that are equal in the order are sorted by a digest of all their columns, so
    the result does not depend on how they were dealt out. First only the sort
    columns are cut into ranges and counted, which tells the ranges the slice
    touches; then only the rows of these ranges are sorted and written, with their
    place in their partition. No task sees more than its own partition, and what
    comes to the driver is one bound and count per range.
    """
    if start < 1 or end < start:
        raise ValueError("a slice requires 1 <= start <= end")
    tied = _tied(df)
    full = [*order, ("_tie", False)]
    types = {f.name: f.dataType for f in tied.schema.fields}
    names = [quoted(c) for c, _ in full]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = tied.select(*names).repartitionByRange(parts, *_sorting(full)).sortWithinPartitions(*_sorting(full))
    # A range lies in one partition, whose first row is its bound.
    counted = ranges.groupBy(F.spark_partition_id().alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*names)).alias("_first"))
    low, high, skipped, seen = None, None, 0, 0
    for row in sorted(counted.collect(), key=lambda r: r["_part"]):
        if seen + row["_n"] < start:
            skipped = seen + row["_n"]
        elif seen >= end:
            high = high or row["_first"]
        else:
            low = low or row["_first"]
        seen += row["_n"]
    # Beyond the last row there is nothing.
    near = tied.filter(F.lit(False) if low is None else ~_before(full, types, low))
    if high is not None:
        near = near.filter(_before(full, types, high))
    placed = cut_lineage(near.orderBy(*_sorting(full)).drop("_tie").withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(F.col("_id"), 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition of the sort.
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", (before + skipped).alias("_before"))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn("position", F.col("_before") + within + 1)
        .filter(F.col("position").between(start, end))
        .drop("_id", "_part", "_before")
    )


def positional_slice(df: DataFrame, keys: Sequence[str], start: int, end: int) -> DataFrame:
    """Rows ``start`` to ``end`` in key order."""
    return ordered_slice(df, [(k, False) for k in keys], start, end)


def record_match_range(source: DataFrame, target: DataFrame, keys: Sequence[str], start: int, end: int) -> DataFrame:
    """Compare source rows ``start`` to ``end`` in key order with the same keys anywhere in the target."""
    keys = _check_keys(source, target, keys)
    source, target = lower_names(source), lower_names(target)
    # Written once, as it is counted, matched and looked up.
    chosen = cut_lineage(positional_slice(source, keys, start, end).drop("position"))
    wanted = _distinct_keys(chosen, keys).alias("w")
    on = [key_text(target[k]).eqNullSafe(F.col(f"w.{k}")) for k in keys]
    relevant = target.join(wanted, on, "left_semi")
    counts = record_match_pk(chosen, relevant, keys)
    repeated = target.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    seen = counts.first()
    if seen["total_compared"] == 0:
        raise ValueError(f"start row {start} is beyond the source row count")
    if seen["source_duplicate_keys"] > 0:
        raise ValueError(f"match key {keys[0]!r} is not unique in the selected source rows")
    if repeated:
        raise ValueError(f"match key {keys[0]!r} is not unique in the target table")
    # The one row is known by now.
    return source.sparkSession.createDataFrame([seen], counts.schema)
