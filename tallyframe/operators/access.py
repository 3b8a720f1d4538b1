"""Which tables the logged queries touch, and what follows for their layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import sqltext
from tallyframe.functions.values import percent
from tallyframe.operators.ranks import one_row

HOT_EXECUTIONS = 10  # executions from which a table is hot (fixed value)
LARGE_SCAN = 1_000_000_000  # bytes above which a query counts as a scan (fixed value)
KEYED_ROWS = 1_000_000  # rows from which a distribution key pays (fixed value)
MAX_SORT_KEYS = 4  # fixed value
WRITE_WORDS = ("INSERT", "UPDATE", "DELETE", "MERGE", "CREATE TABLE", "TRUNCATE")  # fixed values
KEY_TYPES = ("INT64", "INTEGER", "STRING", "BIGINT")  # fixed values
TIME_TYPES = ("TIMESTAMP", "DATETIME", "DATE")  # fixed values
TIME_WORDS = ("created", "updated", "date", "time", "at")  # fixed values
MEASURES = ("query_count", "executions", "bytes", "slot_ms", "writes", "reads", "scans")


def short_name(reference: Column) -> Column:
    """Last segment of a dotted name."""
    return F.element_at(F.split(reference, r"\."), -1)


def reference_aliases(reference: Column) -> Column:
    """The name as written, its last segment and its last two segments."""
    parts = F.split(reference, r"\.")
    two = F.concat(F.element_at(parts, -2), F.lit("."), F.element_at(parts, -1))
    return F.when(F.size(parts) >= 2, F.array(reference, F.element_at(parts, -1), two)).otherwise(F.array(reference))


def reference_totals(log: DataFrame) -> DataFrame:
    """Use of every referenced name. Whole names are summed first, so aliases multiply names and not log rows."""
    text = F.upper(F.coalesce("query_text", F.lit("")))
    writes = sqltext.contains_any(text, WRITE_WORDS)
    scanned = F.coalesce("bytes_scanned", F.lit(0))
    executions = F.coalesce("execution_count", F.lit(1)) if "execution_count" in log.columns else F.lit(1)
    rows = log.select(
        F.explode("referenced_tables").alias("reference"),
        F.lit(1).alias("query_count"),
        executions.cast("bigint").alias("executions"),
        scanned.alias("bytes"),
        F.coalesce("slot_milliseconds", F.lit(0)).alias("slot_ms"),
        writes.cast("int").alias("writes"),
        (~writes).cast("int").alias("reads"),
        (scanned > LARGE_SCAN).cast("int").alias("scans"),
    )
    whole = rows.groupBy("reference").agg(*[F.sum(m).alias(m) for m in MEASURES])
    return whole.withColumn("alias", F.explode(reference_aliases(F.col("reference")))).groupBy("alias").agg(*[F.sum(m).alias(m) for m in MEASURES])


def table_access_join(tables: DataFrame, log: DataFrame) -> DataFrame:
    """Tables with their use; a hit on the bare table name wins over ``dataset.table``."""
    used = reference_totals(log)
    by_name = used.select(F.col("alias").alias("table_name"), F.struct(*MEASURES).alias("_n"))
    by_full = used.select(F.col("alias").alias("_full"), F.struct(*MEASURES).alias("_f"))
    full = F.concat_ws(".", F.when(F.col("dataset_name") != "", F.col("dataset_name")), "table_name")
    joined = tables.withColumn("_full", full).join(by_name, "table_name", "left").join(by_full, "_full", "left")
    hit = F.coalesce("_n", "_f")
    return joined.select(*tables.columns, *[F.coalesce(hit[m], F.lit(0)).alias(m) for m in MEASURES])



def table_access_profile(tables: DataFrame, log: DataFrame) -> DataFrame:
    """Use and tier per table: hot, warm or cold by executions.

    When the log references nothing at all, rows and size decide instead.
    """
    referenced = log.filter(F.size("referenced_tables") > 0).limit(1).count() > 0
    runs, rows, size = F.col("executions"), F.col("row_count"), F.col("size_mb")
    if referenced:
        tier = F.when(runs >= HOT_EXECUTIONS, "hot").when(runs >= 1, "warm").otherwise("cold")
    else:
        tier = F.when(rows > 100_000, "hot").when((rows > 1000) | (size > 10), "warm").otherwise("cold")
    profile = table_access_join(tables, log)
    return profile.select(
        "table_id", "dataset_name", "table_name", "size_mb", *MEASURES, tier.alias("tier"), (F.col("writes") > F.col("reads")).alias("write_heavy")
    )


def tier_summary(profile: DataFrame) -> DataFrame:
    """Tables, size and share per tier in one row."""
    def number(tier: str) -> Column:
        return F.count_if(F.col("tier") == tier)

    def gigabytes(tier: str) -> Column:
        return F.round(F.coalesce(F.sum(F.when(F.col("tier") == tier, F.col("size_mb"))), F.lit(0)) / 1024, 2)

    total = F.count(F.lit(1))
    return profile.agg(
        total.alias("total_tables"),
        *[number(t).alias(f"{t}_count") for t in ("hot", "warm", "cold")],
        *[percent(number(t), total).alias(f"{t}_pct") for t in ("hot", "cold")],
        *[gigabytes(t).alias(f"{t}_size_gb") for t in ("hot", "cold")],
        F.count_if("write_heavy").alias("write_heavy_count"),
    )


def sharing_metrics(log: DataFrame) -> DataFrame:
    """Distinct users, tables with more than one user, share of the ten most referenced tables."""
    user = F.when(F.col("user_email") != "", F.col("user_email"))
    use = (
        log.select(user.alias("user"), F.explode("referenced_tables").alias("r"))
        .groupBy("user", short_name(F.col("r")).alias("table_name"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_table = use.groupBy("table_name").agg(F.count("user").alias("users"), F.sum("n").alias("n"))
    totals = per_table.agg(F.count_if(F.col("users") > 1).alias("shared_tables"), F.sum("n").alias("_all"))
    top = per_table.orderBy(F.desc("n")).limit(10).agg(F.sum("n").alias("_top"))
    users = log.select(user.alias("user")).distinct().agg(F.count("user").alias("unique_users"))
    merged = one_row([totals, top, users])
    return merged.select("unique_users", "shared_tables", percent(F.col("_top"), F.col("_all")).alias("top10_pct"))


def update_frequency(log: DataFrame) -> DataFrame:
    """How often a table is referenced, by the mean gap between references.

    The gaps of a sorted list add up to last minus first, so nothing is sorted.
    """
    use = (
        log.filter("execution_time is not null")
        .select("execution_time", F.explode("referenced_tables").alias("table_name"))
        .groupBy("table_name")
        .agg(F.count(F.lit(1)).alias("accesses"), F.min("execution_time").alias("a"), F.max("execution_time").alias("z"))
    )
    seconds = (F.unix_micros(F.col("z").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 1e6
    gap = F.try_divide(seconds / 3600, F.col("accesses") - 1)
    tier = (
        F.when(F.col("accesses") < 2, "rarely").when(gap < 24, "daily").when(gap < 168, "weekly").when(gap < 720, "monthly").otherwise("rarely")
    )
    return use.select("table_name", "accesses", tier.alias("update_frequency"))


def join_columns(log: DataFrame) -> DataFrame:
    """Columns named in join conditions, per table: uses and the first one seen."""
    text = F.lower(F.coalesce("query_text", F.lit("")))
    conditions = F.filter(F.split(text, " on "), lambda _, place: place > 0)
    sides = F.flatten(F.transform(conditions, lambda c: F.split(c, "=")))
    words = F.transform(sides, lambda s: F.split(F.regexp_replace(s, r"^\s+", ""), r"\s+")[0])
    found = (
        log.filter(text.contains(" join ") & text.contains(" on "))
        .select("execution_time", "job_id", F.posexplode(words).alias("place", "word"))
        .filter(F.col("word").contains("."))
        .withColumn("parts", F.split("word", r"\."))
        .select(
            F.element_at("parts", -2).alias("table_name"), F.element_at("parts", -1).alias("column_name"),
            F.struct("execution_time", "job_id", "place").alias("seen"),
        )
    )
    return found.groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("uses"), F.min("seen").alias("first_seen"))


def key_recommendation(tables: DataFrame, columns: DataFrame, log: DataFrame) -> DataFrame:
    """Distribution key, sort keys and column-store order per base table."""
    name, kind = F.lower("column_name"), F.upper("data_type")
    keyed = name.rlike("id|key") & kind.isin(*KEY_TYPES)
    dated = kind.isin(*TIME_TYPES) & sqltext.contains_any(name, TIME_WORDS)
    place = F.col("ordinal_position")
    candidates = columns.groupBy("table_id").agg(
        F.min_by("column_name", F.when(keyed, place)).alias("_key"), F.min_by("column_name", F.when(dated, place)).alias("_time")
    )
    joined = join_columns(log).groupBy(F.col("table_name").alias("_lower")).agg(F.min_by("column_name", "first_seen").alias("_join"))
    base = tables.filter(F.upper("table_type") != "VIEW").withColumn("_lower", F.lower("table_name"))
    rows = base.join(candidates, "table_id", "left").join(joined, "_lower", "left")
    dist = F.when(F.col("row_count") < KEYED_ROWS, "EVEN").otherwise(F.coalesce("_join", "_key", F.lit("EVEN")))
    declared = F.slice(F.array_distinct(F.concat("partitioning_columns", "clustering_columns")), 1, MAX_SORT_KEYS)
    sort = F.when(F.size(declared) > 0, F.array_join(declared, ", ")).otherwise(F.coalesce("_time", F.lit("AUTO")))
    quoted = [F.array_join(F.transform(c, lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ") for c in ("clustering_columns", "partitioning_columns")]
    order = (
        F.when(F.size("clustering_columns") > 0, F.concat(F.lit("("), quoted[0], F.lit(")")))
        .when(F.size("partitioning_columns") > 0, F.concat(F.lit("("), quoted[1], F.lit(")")))
        .otherwise("tuple()")
    )
    return rows.select(
        "table_id",
        F.concat_ws(".", "dataset_name", "table_name").alias("table_name"),
        dist.alias("distribution_key"),
        sort.alias("sort_keys"),
        order.alias("column_store_order"),
    )


