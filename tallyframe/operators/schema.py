"""Comparing, evolving and reshaping schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.types import check_type, exact_equivalent, normalize_type
from tallyframe.functions.values import quoted

# Types a user-given structure may name.
STRUCTURE_TYPES = {
    "boolean": "boolean", "int": "int", "integer": "int", "long": "bigint", "float": "float", "double": "double",
    "date": "date", "time": "string", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "string": "string",
    "binary": "binary", "decimal": "decimal",
}


def schema_diff(
    source: DataFrame,
    target: DataFrame,
    by: Sequence[str] = (),
    overrides: Mapping[str, str] | None = None,
    exact: bool = False,
) -> DataFrame:
    """Discrepancies between two column lists (``column_name, data_type, is_nullable``).

    ``by`` names the columns that tell tables apart, so a whole catalog is compared
    in one grouping. Families of types decide equivalence unless ``exact`` is set;
    then the mapping table with the user's overrides does.
    """
    def side(df: DataFrame, tag: int) -> DataFrame:
        return df.select(
            *by,
            F.lower("column_name").alias("_name"),
            F.lit(tag).alias("_side"),
            F.struct("column_name", "data_type", "is_nullable").alias("_c"),
        )

    # Dealt out before the grouping: a maximum of structs sorts its rows, and would first sort
    # all that one task reads, where hardly two rows of a list have a name in common.
    rows = side(source, 0).unionByName(side(target, 1)).repartition(*[F.col(c) for c in by], "_name")
    paired = rows.groupBy(*by, "_name").agg(
        F.max(F.when(F.col("_side") == 0, F.col("_c"))).alias("s"), F.max(F.when(F.col("_side") == 1, F.col("_c"))).alias("t")
    )
    s, t = F.col("s"), F.col("t")
    if exact:
        equivalent = exact_equivalent(s.data_type, t.data_type, overrides)
    else:
        equivalent = normalize_type(s.data_type) == normalize_type(t.data_type)

    def entry(kind: str, name: Column, source_type, target_type, expected) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("discrepancy"),
            name.alias("column_name"),
            (source_type if source_type is not None else none).alias("source_type"),
            (target_type if target_type is not None else none).alias("target_type"),
            (expected if expected is not None else none).alias("expected_type"),
        )

    both = s.isNotNull() & t.isNotNull()
    found = F.array(
        F.when(t.isNull(), entry("missing_column", s.column_name, s.data_type, None, check_type(s.data_type, overrides))),
        F.when(s.isNull(), entry("extra_column", t.column_name, None, t.data_type, None)),
        F.when(both & ~equivalent, entry("type_mismatch", s.column_name, s.data_type, t.data_type, None)),
        F.when(
            both & (s.is_nullable != t.is_nullable),
            entry("nullability_mismatch", s.column_name, F.initcap(s.is_nullable.cast("string")), F.initcap(t.is_nullable.cast("string")), None),
        ),
    )
    return paired.select(*by, F.inline(F.array_compact(found)))


def name_set_diff(left: DataFrame, right: DataFrame, column: str = "column_name") -> DataFrame:
    """Names on one side only, compared without case."""
    rows = [df.select(F.lower(column).alias("name"), F.lit(t).alias("_t")) for t, df in ((0, left), (1, right))]
    sides = F.collect_set("_t")  # at most two values
    return (
        rows[0].unionByName(rows[1]).groupBy("name").agg(sides.alias("_s")).filter(F.size("_s") == 1)
        .select("name", F.when(F.col("_s")[0] == 0, "left_only").otherwise("right_only").alias("held_by"))
    )


def is_promotion(old: T.DataType, new: T.DataType) -> bool:
    """Widenings that keep old data readable."""
    if isinstance(old, T.IntegerType) and isinstance(new, T.LongType):
        return True
    if isinstance(old, T.FloatType) and isinstance(new, T.DoubleType):
        return True
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return new.scale == old.scale and new.precision > old.precision
    return False


def schema_changes(existing: T.StructType, incoming: T.StructType) -> list[tuple[str, str, str | None, str | None]]:
    """``(column, change, old type, new type)`` with change new, promotion, incompatible or removed."""
    held = {f.name: f.dataType for f in existing.fields}
    changes: list[tuple[str, str, str | None, str | None]] = []
    for field in incoming.fields:
        old = held.get(field.name)
        if old is None:
            changes.append((field.name, "new", None, field.dataType.simpleString()))
        elif old != field.dataType:
            kind = "promotion" if is_promotion(old, field.dataType) else "incompatible"
            changes.append((field.name, kind, old.simpleString(), field.dataType.simpleString()))
    for name, old in held.items():
        if name not in incoming.names:
            changes.append((name, "removed", old.simpleString(), None))
    return changes


def refuse_incompatible(changes: list[tuple[str, str, str | None, str | None]]) -> list[tuple[str, str, str | None, str | None]]:
    bad = [c for c in changes if c[1] in ("incompatible", "removed")]
    if bad:
        raise ValueError("incompatible schema change: " + "; ".join(f"{n} {k} {o}->{w}" for n, k, o, w in bad))
    return changes


def schema_evolve(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing and incoming rows under the evolved schema; new columns are NULL in old rows."""
    refuse_incompatible(schema_changes(existing.schema, incoming.schema))
    widened = existing.select(
        *[F.col(f.name).cast(incoming.schema[f.name].dataType).alias(f.name) for f in existing.schema.fields]
    )
    return widened.unionByName(incoming, allowMissingColumns=True)


def structure_warnings(structure: Mapping, source_columns: Sequence[str]) -> list[str]:
    """What is wrong with a user-given structure."""
    columns = structure.get("columns") or []
    if not columns:
        return ["structure has no columns"]
    warnings = []
    for column in columns:
        base = str(column.get("type", "")).lower().split("(")[0].strip()
        if base not in STRUCTURE_TYPES:
            warnings.append(f"column {column['name']}: invalid type {column.get('type')}")
    if len(columns) < len(source_columns):
        warnings.append(f"structure has {len(columns)} columns, source has {len(source_columns)}")
    names = {c["name"].lower() for c in columns}
    lost = sorted({c.lower() for c in source_columns} - names)
    if lost:
        warnings.append("source columns not in structure: " + ", ".join(lost))
    partition = (structure.get("partition_spec") or {}).get("column")
    if partition and partition.lower() not in names:
        warnings.append(f"partition column {partition} not in structure")
    for item in structure.get("sort_order") or []:
        name = item if isinstance(item, str) else item.get("column", "")
        if name.lower() not in names:
            warnings.append(f"sort column {name} not in structure")
    return warnings


def _structured(df: DataFrame, structure: Mapping) -> list[tuple[str, Column, Column]]:
    """Name, source value and converted value of every column of a structure."""
    held = {c.lower(): c for c in df.columns}
    found = []
    for column in structure.get("columns") or []:
        base, _, rest = str(column.get("type", "")).lower().partition("(")
        dtype = STRUCTURE_TYPES.get(base.strip(), "string") + (f"({rest}" if rest else "")
        source = F.col(quoted(held[column["name"].lower()])) if column["name"].lower() in held else F.lit(None)
        found.append((column["name"], source, source.try_cast(dtype)))
    return found


def structure_failures(df: DataFrame, structure: Mapping) -> DataFrame:
    """(column_name, failed): rows whose value :func:`apply_structure` cannot convert and makes NULL; one scan."""
    columns = _structured(df, structure)
    counts = df.agg(*[F.count_if(s.isNotNull() & v.isNull()).alias(f"f{k}") for k, (_, s, v) in enumerate(columns)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"f{k}").alias("failed")) for k, (n, _, _) in enumerate(columns)])))


def write_structured(df: DataFrame, structure: Mapping, path: str, mode: str = "error") -> tuple[str | None, list[str]]:
    """Write ``df`` in the columns, order and partitions of a structure; the name of the folder column, and the warnings.

    ``partition_spec`` names a column of the structure and a transform: identity, year,
    month, day or hour. Without one, or with one that does not exist, the folder is flat.
    """
    shaped, warnings = apply_structure(df, structure)
    spec = structure.get("partition_spec") or {}
    by = {c.lower(): c for c in shaped.columns}.get(str(spec.get("column", "")).lower())
    if by is None:
        shaped.write.mode(mode).parquet(path)
        return None, warnings
    transform = str(spec.get("transform") or "identity").lower()
    name = by if transform == "identity" else f"{by}_{transform}"
    rows = shaped if transform == "identity" else shaped.withColumn(name, F.date_format(F.col(quoted(by)), PARTITION_FORMATS[transform]))
    order = [s if isinstance(s, str) else s.get("column", "") for s in structure.get("sort_order") or []]
    order = [c for c in order if c.lower() in {x.lower() for x in shaped.columns}]
    rows = rows.hint("rebalance", F.col(quoted(name))).sortWithinPartitions(F.col(quoted(name)), *[F.col(quoted(c)).asc_nulls_last() for c in order])
    rows.write.mode(mode).partitionBy(name).parquet(path)
    return name, warnings


#: Folder names of time partitions, by transform.
PARTITION_FORMATS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH"}


def apply_structure(df: DataFrame, structure: Mapping) -> tuple[DataFrame, list[str]]:
    """``df`` reshaped to a user-given column list, and the warnings about it.

    Values that do not convert become NULL; :func:`structure_failures` counts them. The
    partitions are put in place by :func:`write_structured`.
    """
    warnings = structure_warnings(structure, df.columns)
    picked = [value.alias(name) for name, _, value in _structured(df, structure)]
    shaped = df.select(*picked) if picked else df
    order = [s if isinstance(s, str) else s.get("column", "") for s in structure.get("sort_order") or []]
    order = [c for c in order if c.lower() in {x.lower() for x in shaped.columns}]
    if order:
        shaped = shaped.sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order])
    return shaped, warnings


def apply_overrides(plans: Sequence[Mapping], overrides: Mapping) -> list[dict]:
    """Table plans without the excluded ones, with the user's partition, sort and properties on top."""
    excluded = set(overrides.get("excluded_tables") or ())
    result = []
    for plan in plans:
        if plan["source_table"] in excluded:
            continue
        extra = overrides.get(plan["source_table"]) or {}
        merged = {**plan, **{k: extra[k] for k in ("partition_spec", "sort_order") if k in extra}}
        if "custom_properties" in extra:
            merged["table_properties"] = {**plan.get("table_properties", {}), **extra["custom_properties"]}
        if merged != plan:
            merged["structure_mode"] = "overridden"
        result.append(merged)
    return result


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
