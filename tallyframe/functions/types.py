"""Type names of several systems: one mapping table and the expressions over it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What each source type becomes, one mapping per target.
TYPE_MAPS = {
    # lakehouse type
    "lake": {
        "STRING": "string", "BYTES": "binary", "INT64": "long", "INTEGER": "long", "FLOAT64": "double",
        "FLOAT": "double", "NUMERIC": "decimal(38,9)", "BIGNUMERIC": "decimal(38,18)", "BOOL": "boolean",
        "BOOLEAN": "boolean", "DATE": "date", "TIME": "time", "DATETIME": "timestamp", "TIMESTAMP": "timestamptz",
        "STRUCT": "struct", "RECORD": "struct", "ARRAY": "list", "JSON": "string", "GEOGRAPHY": "string",
    },
    # warehouse load type
    "load": {
        "STRING": "VARCHAR(65535)", "BYTES": "VARCHAR(65535)", "INT64": "BIGINT", "INTEGER": "BIGINT",
        "FLOAT64": "DOUBLE PRECISION", "FLOAT": "DOUBLE PRECISION", "NUMERIC": "DECIMAL(38, 9)",
        "BIGNUMERIC": "DECIMAL(38, 9)", "BOOL": "BOOLEAN", "BOOLEAN": "BOOLEAN", "DATE": "DATE", "TIME": "TIME",
        "DATETIME": "TIMESTAMP", "TIMESTAMP": "TIMESTAMPTZ", "STRUCT": "SUPER", "RECORD": "SUPER", "ARRAY": "SUPER",
        "JSON": "SUPER", "GEOGRAPHY": "GEOMETRY",
    },
    # warehouse check type
    "check": {
        "STRING": "VARCHAR", "BYTES": "VARBYTE", "INT64": "BIGINT", "FLOAT64": "DOUBLE PRECISION",
        "NUMERIC": "DECIMAL", "BIGNUMERIC": "DECIMAL", "BOOL": "BOOLEAN", "DATE": "DATE", "TIME": "TIME",
        "TIMESTAMP": "TIMESTAMP", "STRUCT": "SUPER", "ARRAY": "SUPER",
    },
    # column-store type
    "column_store": {
        "STRING": "String", "BYTES": "String", "INT64": "Int64", "INTEGER": "Int64", "INT": "Int32",
        "SMALLINT": "Int16", "TINYINT": "Int8", "FLOAT64": "Float64", "FLOAT": "Float32",
        "NUMERIC": "Decimal(38, 10)", "BIGNUMERIC": "Decimal(76, 38)", "DECIMAL": "Decimal(38, 10)", "BOOL": "UInt8",
        "BOOLEAN": "UInt8", "DATE": "Date32", "TIME": "String", "DATETIME": "DateTime64(6)",
        "TIMESTAMP": "DateTime64(6)", "STRUCT": "String", "RECORD": "String", "JSON": "String",
        "GEOGRAPHY": "String",
    },
    # Spark type
    "spark": {
        "STRING": "string", "BYTES": "binary", "INT64": "bigint", "INTEGER": "bigint", "FLOAT64": "double",
        "FLOAT": "double", "NUMERIC": "decimal(38,9)", "BIGNUMERIC": "decimal(38,18)", "BOOL": "boolean",
        "BOOLEAN": "boolean", "DATE": "date", "TIME": "string", "DATETIME": "timestamp_ntz",
        "TIMESTAMP": "timestamp", "JSON": "string", "GEOGRAPHY": "string",
    },
    # how much of it survives
    "compatibility": {
        "STRING": "partial", "BYTES": "partial", "INT64": "full", "INTEGER": "full", "INT": "full",
        "SMALLINT": "full", "TINYINT": "full", "BYTEINT": "full", "BIGINT": "full", "FLOAT64": "full",
        "FLOAT": "full", "NUMERIC": "full", "BIGNUMERIC": "lossy", "DECIMAL": "full", "BIGDECIMAL": "lossy",
        "BOOL": "full", "BOOLEAN": "full", "DATE": "full", "TIME": "full", "DATETIME": "partial",
        "TIMESTAMP": "partial", "STRUCT": "partial", "RECORD": "partial", "ARRAY": "partial", "JSON": "partial",
        "GEOGRAPHY": "partial", "INTERVAL": "lossy", "RANGE": "lossy",
    },
    # type it survives as
    "compat_type": {
        "STRING": "VARCHAR(65535)", "BYTES": "VARCHAR(65535)", "INT64": "BIGINT", "INTEGER": "BIGINT",
        "INT": "BIGINT", "SMALLINT": "SMALLINT", "TINYINT": "SMALLINT", "BYTEINT": "SMALLINT", "BIGINT": "BIGINT",
        "FLOAT64": "DOUBLE PRECISION", "FLOAT": "DOUBLE PRECISION", "NUMERIC": "DECIMAL(38,9)",
        "BIGNUMERIC": "DECIMAL(38,18)", "DECIMAL": "DECIMAL(38,9)", "BIGDECIMAL": "DECIMAL(38,18)",
        "BOOL": "BOOLEAN", "BOOLEAN": "BOOLEAN", "DATE": "DATE", "TIME": "TIME", "DATETIME": "TIMESTAMP",
        "TIMESTAMP": "TIMESTAMPTZ", "STRUCT": "SUPER", "RECORD": "SUPER", "ARRAY": "SUPER", "JSON": "SUPER",
        "GEOGRAPHY": "GEOMETRY", "INTERVAL": "VARCHAR(100)", "RANGE": "VARCHAR(255)",
    },
}

# Canonical family and the type words that mark it, tried in this order.
TYPE_FAMILIES = (
    ("STRING", ("CHAR", "CLOB", "TEXT", "STRING", "VARCHAR", "NVARCHAR")),
    ("INTEGER", ("INT", "BIGINT", "SMALLINT", "TINYINT", "INTEGER")),
    ("DECIMAL", ("DECIMAL", "NUMERIC", "NUMBER", "MONEY", "FLOAT", "DOUBLE", "REAL")),
    ("BOOLEAN", ("BOOL", "BOOLEAN")),
    ("DATE", ("DATE",)),
    ("DATETIME", ("TIMESTAMP", "DATETIME", "TIME")),
    ("BINARY", ("BINARY", "BLOB", "VARBINARY", "BYTEA")),
)

# Sizes a text column is rounded up to.
VARCHAR_SIZES = (64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65535)


def type_map(target: str, overrides: Mapping[str, str] | None = None) -> dict[str, str]:
    """Source type to its type for ``target``, overrides first."""
    return TYPE_MAPS[target] | {k.upper(): v for k, v in (overrides or {}).items()}


def literal(text: str) -> str:
    """A text as SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(key: Column, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """A small fixed mapping as one expression."""
    if not mapping:
        return F.lit(default).cast("string")
    pairs = ", ".join(f"{literal(k)}, {literal(v)}" for k, v in mapping.items())
    found = F.try_element_at(F.expr(f"map({pairs})"), key)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def base_type(name: Column) -> Column:
    """Upper-case type name without parameters."""
    return F.trim(F.regexp_replace(F.upper(name), r"[<(].*", ""))


def normalize_type(name: Column) -> Column:
    """Family of a type name by the first marking word it contains, else the name itself."""
    text = F.regexp_replace(F.upper(F.trim(F.coalesce(name, F.lit("")))), r"\([^)]*\)", "")
    chain = None
    for family, words in TYPE_FAMILIES:
        hit = text.rlike("|".join(words))
        chain = F.when(hit, family) if chain is None else chain.when(hit, family)
    return chain.otherwise(text)


def exact_equivalent(source: Column, target: Column, overrides: Mapping[str, str] | None = None) -> Column:
    """Equivalence by the mapping table and user overrides instead of by family."""
    expected = lookup(F.upper(F.trim(source)), type_map("check", overrides))
    return F.coalesce(F.upper(F.trim(expected)) == F.upper(F.trim(target)), F.lit(False))


def type_max_length(name: Column) -> Column:
    """The length in ``STRING(n)`` or ``BYTES(n)``."""
    return F.regexp_extract(F.upper(F.trim(name)), r"^(?:STRING|BYTES)\(([0-9]+)\)$", 1).try_cast("int")


def varchar_size(max_length: Column) -> Column:
    """Known length plus a fifth, rounded up to a common size; unknown gets the largest."""
    need = F.least(F.ceil(max_length * F.lit(1.2)), F.lit(VARCHAR_SIZES[-1]))
    chain = F.when(max_length.isNull() | (max_length <= 0), VARCHAR_SIZES[-1])
    for size in VARCHAR_SIZES:
        chain = chain.when(need <= size, size)
    return chain.otherwise(VARCHAR_SIZES[-1])


def load_type(name: Column, mode: Column) -> Column:
    """Warehouse type of a declared column; repeated columns are semi-structured."""
    mapped = lookup(F.upper(name), type_map("load"), "VARCHAR(65535)")
    return F.when(F.upper(mode) == "REPEATED", "SUPER").otherwise(mapped)


def column_store_type(name: Column, nullable: Column) -> Column:
    """Column-store type: arrays of the element type, structs as text, the rest wrapped when nullable."""
    names = type_map("column_store")
    plain = F.trim(F.split(F.upper(name), r"\(")[0])
    inner = F.regexp_replace(F.regexp_replace(F.upper(name), "ARRAY<", ""), ">+$", "")
    is_array = (plain == "ARRAY") | F.upper(name).startswith("ARRAY<")
    mapped = lookup(plain, names, "String")
    return (
        F.when(is_array, F.concat(F.lit("Array("), lookup(F.trim(inner), names, "String"), F.lit(")")))
        .when(plain.isin("STRUCT", "RECORD"), "String")
        .when(nullable, F.concat(F.lit("Nullable("), mapped, F.lit(")")))
        .otherwise(mapped)
    )


def check_type(name: Column, overrides: Mapping[str, str] | None = None) -> Column:
    return lookup(F.upper(F.trim(name)), type_map("check", overrides))


_SIMPLE = {k: v for k, v in TYPE_MAPS["spark"].items() if k in TYPE_MAPS["lake"]}
_DDL = {
    "string": T.StringType(),
    "binary": T.BinaryType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "decimal(38,9)": T.DecimalType(38, 9),
    "decimal(38,18)": T.DecimalType(38, 18),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "timestamp": T.TimestampType(),
}


def spark_type(declared: Mapping, max_depth: int | None = None, depth: int = 0) -> T.DataType:
    """Spark type of a declared column ``{name, type, mode, fields}``; unknown types, and structs below ``max_depth``, are text."""
    kind = str(declared.get("type", "STRING")).strip().upper()
    mode = str(declared.get("mode") or "NULLABLE").strip().upper()
    if kind in ("STRUCT", "RECORD"):
        if max_depth is not None and depth >= max_depth:
            found: T.DataType = T.StringType()
        else:
            found = T.StructType([spark_field(f, max_depth, depth + 1) for f in declared.get("fields") or []])
    else:
        found = _DDL.get(_SIMPLE.get(kind, "string"), T.StringType())
    return T.ArrayType(found, True) if mode == "REPEATED" else found


def spark_field(declared: Mapping, max_depth: int | None = None, depth: int = 0) -> T.StructField:
    required = str(declared.get("mode") or "").strip().upper() == "REQUIRED"
    return T.StructField(declared.get("name", "unknown"), spark_type(declared, max_depth, depth), not required)


def spark_schema(declared: Sequence[Mapping]) -> T.StructType:
    """Schema of a declared, possibly nested, column list."""
    return T.StructType([spark_field(c) for c in declared])


def _converted(value: Column, own: T.DataType, wanted: T.DataType) -> Column:
    if own == wanted:
        return value
    if isinstance(wanted, T.StringType) and isinstance(own, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    if isinstance(wanted, T.StructType) and isinstance(own, T.StructType):
        held = {f.name.lower(): f for f in own.fields}
        parts = []
        for field in wanted.fields:
            if field.name.lower() in held:
                inner = held[field.name.lower()]
                parts.append(_converted(value.getField(inner.name), inner.dataType, field.dataType).alias(field.name))
            else:
                parts.append(F.lit(None).cast(field.dataType).alias(field.name))
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(wanted, T.ArrayType) and isinstance(own, T.ArrayType):
        return F.transform(value, lambda x: _converted(x, own.elementType, wanted.elementType))
    if isinstance(own, (T.StructType, T.ArrayType, T.MapType)) or isinstance(wanted, (T.StructType, T.ArrayType)):
        raise ValueError(f"cannot convert {own.simpleString()} to {wanted.simpleString()}")
    return value.try_cast(wanted)


def cast_to_target(df: DataFrame, declared: Sequence[Mapping]) -> DataFrame:
    """Shape ``df`` to a declared schema, nested fields included; absent columns become NULL.

    So do values that do not convert; :func:`conversion_failures` counts them.
    """
    held = {f.name.lower(): f for f in df.schema.fields}
    picked = []
    for field in spark_schema(declared).fields:
        if field.name.lower() in held:
            own = held[field.name.lower()]
            picked.append(_converted(F.col(f"`{own.name}`"), own.dataType, field.dataType).alias(field.name))
        else:
            picked.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*picked)


def _lost(value: Column, own: T.DataType, wanted: T.DataType) -> Column | None:
    """Whether a value, or one inside it, does not convert; None where none can fail."""
    if own == wanted or isinstance(wanted, T.StringType):
        return None
    if isinstance(wanted, T.StructType) and isinstance(own, T.StructType):
        held = {f.name.lower(): f for f in own.fields}
        inner = [(held[f.name.lower()], f) for f in wanted.fields if f.name.lower() in held]
        parts = [p for f, w in inner if (p := _lost(value.getField(f.name), f.dataType, w.dataType)) is not None]
        return F.coalesce(reduce(lambda a, b: a | b, parts), F.lit(False)) if parts else None
    if isinstance(wanted, T.ArrayType) and isinstance(own, T.ArrayType):
        if _lost(value, own.elementType, wanted.elementType) is None:
            return None
        return F.coalesce(F.exists(value, lambda x: _lost(x, own.elementType, wanted.elementType)), F.lit(False))
    if isinstance(wanted, (T.StructType, T.ArrayType)) or isinstance(own, (T.StructType, T.ArrayType, T.MapType)):
        return None
    return value.isNotNull() & value.try_cast(wanted).isNull()


def conversion_failures(df: DataFrame, declared: Sequence[Mapping]) -> DataFrame:
    """(column_name, failed, missing): rows whose value does not convert, and rows without a REQUIRED value; one scan.

    One row per declared column, so that :func:`cast_to_target` need not lose a value unnoticed.
    """
    held = {f.name.lower(): f for f in df.schema.fields}
    sums, names = [], []
    for k, field in enumerate(spark_schema(declared).fields):
        own = held.get(field.name.lower())
        value = F.col(f"`{own.name}`") if own else F.lit(None)
        lost = _lost(value, own.dataType, field.dataType) if own else None
        sums += [F.count_if(lost if lost is not None else F.lit(False)).alias(f"f{k}"), F.count_if(F.lit(not field.nullable) & value.isNull()).alias(f"m{k}")]
        names.append(field.name)
    entries = [F.struct(F.lit(n).alias("column_name"), F.col(f"f{k}").alias("failed"), F.col(f"m{k}").alias("missing")) for k, n in enumerate(names)]
    return df.agg(*sums).select(F.inline(F.array(*entries)))


def nested_to_json(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps as JSON text, other columns unchanged."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def null_fill(df: DataFrame) -> DataFrame:
    """Import defaults: numbers and booleans 0, text '', dates and times untouched."""
    moments = (T.DateType, T.TimestampType, T.TimestampNTZType)
    picked = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.NumericType):
            col = F.coalesce(col, F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, T.BooleanType):
            col = F.coalesce(col, F.lit(False))
        elif isinstance(f.dataType, T.StringType):
            col = F.coalesce(col, F.lit(""))
        elif not isinstance(f.dataType, moments):
            col = F.coalesce(shown_json(col, f.dataType), F.lit(""))
        picked.append(col.alias(f.name))
    return df.select(*picked)


def shown_json(col: Column, dtype: T.DataType) -> Column:
    return F.to_json(col) if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)) else col.cast("string")


def scan_columns(df: DataFrame) -> DataFrame:
    """One row per column of a frame: name, type, nullability, place."""
    spark: SparkSession = df.sparkSession
    rows = [(f.name, f.dataType.simpleString(), f.nullable, i) for i, f in enumerate(df.schema.fields, start=1)]
    return spark.createDataFrame(rows, "column_name string, data_type string, is_nullable boolean, ordinal_position int")
