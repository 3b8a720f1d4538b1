"""How well a catalog fits the target warehouse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyframe.functions.types import base_type, lookup, type_map
from tallyframe.functions.values import half_even
from tallyframe.operators.ranks import one_row
from tallyframe.operators.schema import union_all

# Text to look for and its severity. The advice beside them is our own.
DIALECT_PATTERNS = (
    ("SAFE_DIVIDE", "high", "divide by NULLIF(divisor, 0)"),
    ("SAFE_CAST", "medium", "cast only what passes a pattern"),
    ("PARSE_DATE", "medium", "convert with an explicit date format"),
    ("PARSE_TIMESTAMP", "medium", "convert with an explicit time format"),
    ("FORMAT_DATE", "medium", "format the date explicitly"),
    ("FORMAT_TIMESTAMP", "medium", "format the time explicitly"),
    ("UNNEST", "high", "join with the elements of the array"),
    ("ARRAY_AGG", "medium", "collect into delimited text"),
    ("STRUCT(", "high", "store as one semi-structured value"),
    ("GENERATE_ARRAY", "medium", "join with a table of numbers"),
    ("GENERATE_DATE_ARRAY", "medium", "join with a calendar table"),
    ("IF(", "low", "write the cases out"),
    ("IFNULL", "low", "take the first value that is not NULL"),
    ("COUNTIF", "medium", "sum a 0 or 1 per row"),
    ("ANY_VALUE", "low", "take the smallest value"),
    ("APPROX_COUNT_DISTINCT", "low", "use the approximate distinct count of the target"),
    ("FARM_FINGERPRINT", "medium", "use a hash the target has"),
    ("ML.PREDICT", "high", "score outside of the warehouse"),
    ("ML.EVALUATE", "high", "evaluate outside of the warehouse"),
    ("QUALIFY", "high", "filter the window in an outer query"),
    ("PIVOT", "medium", "aggregate once per column"),
    ("UNPIVOT", "medium", "union one query per column"),
    ("EXCEPT(", "medium", "name the wanted columns"),
)

# Share of a column that counts per compatibility, and points a finding costs.
TYPE_WEIGHTS = {"full": 1.0, "partial": 0.7, "lossy": 0.3}
GAP_POINTS = {"high": 5.0, "medium": 2.0, "low": 0.5}
SYNTAX_POINTS = {"high": 4.0, "medium": 2.0, "low": 0.5}
SCORE_WEIGHTS = (0.4, 0.35, 0.25)


def map_types(columns: DataFrame) -> DataFrame:
    """Every column with its target type and how much of it survives."""
    kind = base_type(F.coalesce("data_type", F.lit("")))
    return columns.withColumn("target_type", lookup(kind, type_map("compat_type"), "VARCHAR(65535)")).withColumn(
        "compatibility", lookup(kind, type_map("compatibility"), "unknown")
    )


def type_compatibility(columns: DataFrame) -> DataFrame:
    """Columns per compatibility and target type."""
    return map_types(columns).groupBy("compatibility", "target_type").agg(F.count(F.lit(1)).alias("column_count"))


def compatibility_totals(columns: DataFrame) -> DataFrame:
    def number(kind: str) -> Column:
        return F.count_if(F.col("compatibility") == kind)

    total = F.count(F.lit(1))
    return map_types(columns).agg(
        total.alias("total_columns"),
        *[number(k).alias(f"{k}_count") for k in ("full", "partial", "lossy", "unknown")],
        F.coalesce(half_even(F.try_divide(number("full").cast("double"), total) * 100, 1), F.lit(0.0)).alias("compatibility_pct"),
    )


def _with_items(found: DataFrame, keys: list[str], shown: int | None = None) -> DataFrame:
    """One row per finding and item with the finding's count; with ``shown`` one row per finding and its first names.

    Ranking keeps ``shown`` names per task before the shuffle.
    """
    counts = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("affected_count"))
    items = found.select(*keys, "item").distinct()
    if shown is not None:
        by_name = W.partitionBy(*keys).orderBy("item")
        items = items.withColumn("r", F.row_number().over(by_name)).filter(F.col("r") <= shown)
        items = items.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("item")), ", ").alias("affected_items"))
    return items.join(counts, keys)


def dialect_hits(objects: DataFrame) -> DataFrame:
    """One row per object and pattern found in it."""
    text = F.col("text")
    hits = [
        F.when(text.contains(p.upper()), F.struct(F.lit(p).alias("pattern"), F.lit(s).alias("severity"), F.lit(f).alias("replacement")))
        for p, s, f in DIALECT_PATTERNS
    ]
    label = F.concat_ws(": ", F.when(F.col("object_type") == "ROUTINE", "routine").otherwise("view"), "object_name")
    # Upper case once, in a column of its own, not once per pattern.
    upper = objects.filter("definition <> ''").select(label.alias("item"), F.upper("definition").alias("text"))
    return upper.select("item", F.inline(F.array_compact(F.array(*hits))))


def dialect_scan(objects: DataFrame, shown: int | None = None) -> DataFrame:
    """SQL patterns the target does not know and the objects with each, all of them or the first ``shown``."""
    return _with_items(dialect_hits(objects), ["pattern", "severity", "replacement"], shown)


def gap_items(
    objects: DataFrame, security: DataFrame, shards: DataFrame, tables: DataFrame, columns: DataFrame, models: DataFrame
) -> DataFrame:
    """One row per object that needs work on the target: ``category, severity, item``.

    The categories and severities are fixed values.
    """
    kind = base_type(F.col("data_type"))
    language = F.upper(F.coalesce("external_language", F.lit("")))
    by_spark = language.isin("PYTHON", "SPARK") & (F.upper(F.coalesce("routine_type", F.lit(""))) == "PROCEDURE")

    def found(df: DataFrame, *rules: tuple[Column, str, str, str | Column]) -> DataFrame:
        """All rules over one scan of an input."""
        hits = [
            F.when(held, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), (F.col(item) if isinstance(item, str) else item).alias("item")))
            for held, category, severity, item in rules
        ]
        return df.select(F.inline(F.array_compact(F.array(*hits))))

    always = F.lit(True)
    return union_all(
        [
            found(models, (always, "ML Models (BQML)", "high", "model_name")),
            found(
                objects,
                (language == "JAVASCRIPT", "JavaScript UDFs", "high", "object_name"),
                (by_spark, "Spark Procedures", "medium", "object_name"),
                (F.col("object_type") == "MATERIALIZED_VIEW", "Materialized Views", "low", "object_name"),
            ),
            found(
                security,
                (F.col("security_type") == "RLS", "Row-Level Security", "medium", "policy_name"),
                (F.col("security_type") == "CLS", "Column-Level Security", "medium", "policy_name"),
            ),
            found(shards, (always, "Sharded Tables", "medium", "shard_group")),
            found(
                columns,
                (kind.isin("STRUCT", "RECORD", "ARRAY"), "Complex/Nested Types", "medium", "data_type"),
                (F.upper("data_type").startswith("GEOGRAPHY"), "Geospatial Data", "low", "column_name"),
            ),
            found(tables, (F.size("partitioning_columns") > 0, "Partitioned Tables", "low", F.concat_ws(".", "dataset_name", "table_name"))),
        ]
    )


def feature_gaps(gaps: DataFrame, shown: int | None = None) -> DataFrame:
    """Count and names per category of the rows of :func:`gap_items`, all names or the first ``shown``."""
    return _with_items(gaps, ["category", "severity"], shown)


def _points(found: DataFrame, points: dict[str, float], name: str) -> DataFrame:
    cost = lookup(F.col("severity"), {k: str(p) for k, p in points.items()}).cast("double")
    counts = found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    left = half_even(F.lit(100.0) - F.coalesce(F.sum(F.col("n") * cost), F.lit(0.0)), 1)
    return counts.agg(F.greatest(F.lit(0.0), left).alias(name))


def compat_score(columns: DataFrame, gaps: DataFrame, hits: DataFrame) -> DataFrame:
    """Scores for types, features and syntax, and their weighted sum; ``gaps`` and ``hits`` are the item rows."""
    weight = F.coalesce(lookup(F.col("compatibility"), {k: str(w) for k, w in TYPE_WEIGHTS.items()}).cast("double"), F.lit(0.0))
    counts = map_types(columns).groupBy("compatibility").agg(F.count(F.lit(1)).alias("n"))
    types = counts.agg(half_even(F.coalesce(F.try_divide(F.sum(F.col("n") * weight), F.sum("n")) * 100, F.lit(0.0)), 1).alias("data_types"))
    scores = one_row([types, _points(gaps, GAP_POINTS, "feature_gaps"), _points(hits, SYNTAX_POINTS, "sql_syntax")])
    overall = sum((F.col(c) * w for c, w in zip(("data_types", "feature_gaps", "sql_syntax"), SCORE_WEIGHTS, strict=True)), F.lit(0.0))
    return scores.select("*", F.least(F.lit(100.0), F.greatest(F.lit(0.0), half_even(overall, 1))).alias("overall"))
