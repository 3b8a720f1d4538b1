"""Equality and rendering of single values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stands for a NULL inside a joined key: backslash, x, 0, 0 (fixed value).
NULL_MARK = r"\x00"

# Patterns of numbers in text. They are written into SQL as raw literals.
_PLAIN = r"^(?=[+-]?\.?[0-9])\+?(-?)0*([0-9]*)(?:\.([0-9]*?)0*)?$"
_MINUS_ZERO = r"^\x00-\|\|$"
_EXPONENT = r"[eE][+-]?[0-9]+$"
_NUMERAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_INFINITE = r"^[+-]?[iI][nN][fF](?:[iI][nN][iI][tT][yY])?$"


def quoted(*path: str) -> str:
    """A column, or a field of one, as SQL."""
    return ".".join("`" + name.replace("`", "``") + "`" for name in path)


def is_moment(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType))


# The comparison rules are SQL text: a table of many columns is then one expression
# to parse, and not thousands of calls to build.


def _may_be_number(x: str) -> str:
    """A look at both ends, so that ordinary text costs no pattern.

    A number starts with a sign, a point, a digit or the i or n of inf and nan, and
    ends with a digit, a point, or the f, y or n of inf, infinity and nan.
    """
    first, last = f"ascii(trim({x}))", f"ascii(substring(trim({x}), -1, 1))"
    starts = f"({first} BETWEEN 43 AND 57 OR {first} IN (73, 78, 105, 110))"
    return f"({starts} AND ({last} BETWEEN 46 AND 57 OR {last} IN (70, 78, 89, 102, 110, 121)))"


def _without_exponent(x: str) -> str:
    """A numeral with exponent written out. Outside 38 digits it becomes the double it denotes."""
    exact, wide = f"try_cast({x} AS DECIMAL(38,18))", f"try_cast({x} AS DOUBLE)"
    return (
        f"CASE WHEN CAST({exact} AS DOUBLE) = {wide} THEN replace(format_number({exact}, 18), ',', '') "
        f"ELSE concat('\\0~', CAST({wide} AS STRING)) END"
    )


def by_value(x: str) -> str:
    """Numbers as sign, whole and fraction without idle zeros, other text as it is.

    Two texts get the same form exactly when they are the same number or the same
    text. The form starts with a NUL, which database text cannot hold.
    """
    t = f"trim({x})"
    plain = f"CASE WHEN rlike({t}, r'{_EXPONENT}') THEN {_without_exponent(t)} ELSE {t} END"
    number = f"regexp_replace(regexp_replace({plain}, r'{_PLAIN}', '\\0$1|$2|$3'), r'{_MINUS_ZERO}', '\\0||')"
    infinite = f"concat('\\0', if(startswith({t}, '-'), '-inf', 'inf'))"
    return (
        f"CASE WHEN {_may_be_number(x)} THEN CASE WHEN rlike({t}, r'{_NUMERAL}') THEN {number} "
        f"WHEN rlike({t}, r'{_INFINITE}') THEN {infinite} ELSE {x} END ELSE {x} END"
    )


def comparable(x: str, dtype: T.DataType) -> str:
    """Text under which two values of any types are equal when the numbers or texts are."""
    if isinstance(dtype, T.BooleanType):
        return f"initcap(CAST({x} AS STRING))"
    if isinstance(dtype, T.NumericType):
        return by_value(f"CAST({x} AS STRING)")
    if isinstance(dtype, T.StringType):
        return by_value(x)
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return f"to_json({_canonical(x, dtype)})"
    if isinstance(dtype, T.TimestampType):
        return f"CAST(CAST({x} AS TIMESTAMP_NTZ) AS STRING)"
    return f"CAST({x} AS STRING)"


def _canonical(x: str, dtype: T.DataType, depth: int = 0) -> str:
    """A nested value whose leaves are comparable text and whose maps are entries sorted by key.

    So maps are equal whatever the order of their entries, and ``[1.0, 2.0]`` equals
    ``[1, 2]`` as 1.0 equals 1. Fields of a struct are told apart by name; a field that is
    NULL equals one that is not there.
    """
    e = f"_e{depth}"
    if isinstance(dtype, T.ArrayType):
        return f"transform({x}, {e} -> {_canonical(e, dtype.elementType, depth + 1)})"
    if isinstance(dtype, T.MapType):
        key, value = (_canonical(f"{e}.{part}", kind, depth + 1) for part, kind in (("key", dtype.keyType), ("value", dtype.valueType)))
        # sorted as text, because not every value has an order
        return f"array_sort(transform(map_entries({x}), {e} -> to_json(named_struct('key', {key}, 'value', {value}))))"
    if isinstance(dtype, T.StructType):
        fields = [f"'{_escaped(f.name)}', {_canonical(f'{x}.{quoted(f.name)}', f.dataType, depth + 1)}" for f in sorted(dtype.fields, key=lambda f: f.name)]
        return f"if({x} IS NULL, NULL, named_struct({', '.join(fields)}))" if fields else f"CAST({x} AS STRING)"
    return comparable(x, dtype)


def _escaped(name: str) -> str:
    return name.replace("\\", "\\\\").replace("'", "\\'")


def has_map(dtype: T.DataType) -> bool:
    """Whether values of a type hold a map; Spark neither compares nor sorts these."""
    if isinstance(dtype, T.StructType):
        return any(has_map(f.dataType) for f in dtype.fields)
    return has_map(dtype.elementType) if isinstance(dtype, T.ArrayType) else isinstance(dtype, T.MapType)


def sortable(name: str, dtype: T.DataType) -> Column:
    """A column as something rows can be sorted by: itself, or its comparable text where it holds a map."""
    return F.expr(comparable(quoted(name), dtype)).alias(name) if has_map(dtype) else F.col(quoted(name))


def same_kind(a: T.DataType, b: T.DataType) -> bool:
    """Whether values of the two types can be compared directly, without text."""
    if isinstance(a, T.StringType) or isinstance(b, T.StringType):
        return False
    if a == b:
        return not has_map(a)
    if is_moment(a) and is_moment(b):
        return True
    return isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType)


def is_nan(x: str, dtype: T.DataType) -> str | None:
    """Whether a value is, or spells, NaN; None for types that have none."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return f"isnan({x})"
    if isinstance(dtype, T.StringType):
        return f"({_may_be_number(x)} AND length(trim({x})) <= 4 AND lower(trim({x})) IN ('nan', '+nan', '-nan'))"
    return None


def values_equal(source: str, target: str, source_type: T.DataType, target_type: T.DataType) -> str:
    """Type-aware equality: NULL equals NULL, numbers by value, even inside text; NaN equals nothing."""
    a, b = source, target
    if same_kind(source_type, target_type):
        if is_moment(source_type):
            a, b = f"CAST({a} AS TIMESTAMP_NTZ)", f"CAST({b} AS TIMESTAMP_NTZ)"
    else:
        a, b = comparable(a, source_type), comparable(b, target_type)
    equal = f"({a}) = ({b})"
    nan = is_nan(source, source_type)
    if nan:
        equal = f"({equal}) AND NOT {nan}"
    return (
        f"CASE WHEN {source} IS NULL AND {target} IS NULL THEN true WHEN {source} IS NULL OR {target} IS NULL THEN false ELSE {equal} END"
    )


def fingerprint_form(x: str, own: T.DataType, other: T.DataType | None) -> str:
    """What to hash of a column, such that equal hashes mean equal values of the pair of types."""
    if other is not None and same_kind(own, other):
        if is_moment(own):
            return f"CAST({x} AS TIMESTAMP_NTZ)"
        if isinstance(own, T.IntegralType):
            return f"CAST({x} AS BIGINT)"
        if isinstance(own, (T.DoubleType, T.FloatType)):
            return f"({x} + 0.0D)"  # -0.0 and 0.0 are one number
        return x
    return comparable(x, own)


def shown_sql(x: str, dtype: T.DataType) -> str:
    """A value as report text, in SQL."""
    return f"to_json({x})" if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)) else f"CAST({x} AS STRING)"


def shown(value: Column, dtype: T.DataType) -> Column:
    """A value as report text."""
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(value)
    return value.cast("string")


def shortened(text: Column, limit: int | None = None) -> Column:
    """Cut to ``limit`` characters, the last being an ellipsis; whole without a limit."""
    if limit is None:
        return text
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def key_text(value: Column) -> Column:
    """A key part as text, so that 1 and '1' meet."""
    return value.cast("string")


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(value, digits)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part / whole`` in percent, 0 when there is no whole."""
    return F.coalesce(half_even(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits), F.lit(0.0))
