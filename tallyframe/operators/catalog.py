"""Catalogs of datasets, tables, columns, objects, jobs and runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import sqltext
from tallyframe.functions.types import base_type, lookup
from tallyframe.functions.values import quoted, sortable
from tallyframe.operators.ranks import one_row
from tallyframe.operators.records import ordered_slice
from tallyframe.operators.schema import union_all

SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_internal", "sys", "system")
GIB = 1024**3
LARGE_TABLE_BYTES = GIB  # size above which a table should be partitioned (fixed value)
LARGE_TOTAL_GIB = 100  # fixed value
MANY_UNPARTITIONED = 3  # fixed value

# Names a table should not have.
RESERVED_WORDS = (
    "all", "alter", "and", "array", "as", "authorization", "between", "bigint", "binary", "boolean", "both", "by",
    "case", "cast", "char", "column", "conf", "create", "cross", "cube", "current", "database", "date", "decimal",
    "delete", "describe", "distinct", "double", "drop", "else", "end", "exchange", "exists", "extended", "external",
    "false", "fetch", "float", "following", "for", "from", "full", "function", "grant", "group", "grouping",
    "having", "if", "import", "in", "inner", "insert", "int", "integer", "intersect", "interval", "into", "is",
    "join", "lateral", "left", "less", "like", "local", "macro", "map", "more", "none", "not", "null", "of", "on",
    "or", "order", "out", "outer", "over", "partition", "percent", "preceding", "preserve", "procedure", "range",
    "reads", "reduce", "revoke", "right", "rollup", "row", "rows", "select", "set", "smallint", "table",
    "tablesample", "then", "timestamp", "to", "transform", "trigger", "true", "truncate", "unbounded", "union",
    "uniquejoin", "update", "user", "using", "values", "varchar", "when", "where", "window", "with",
)


def user_tables(tables: DataFrame) -> DataFrame:
    """Tables outside the system schemas."""
    return tables.filter(~F.lower("dataset_name").isin(*SYSTEM_SCHEMAS))


def list_tables(tables: DataFrame) -> DataFrame:
    """User tables per dataset with rows and bytes, before a load is planned."""
    size = F.col("size_mb") * 1024 * 1024
    return user_tables(tables).groupBy("dataset_name").agg(
        F.count(F.lit(1)).alias("table_count"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(size), F.lit(0)).alias("size_bytes"),
        F.min("table_name").alias("first_table"),
        F.max("table_name").alias("last_table"),
    )


def is_sharded_name(name: Column) -> Column:
    return name.rlike(r"_\d{8}$|_\d{6}$")


def _ordered_names(name: Column, order: Column, keep: Column) -> Column:
    """Names in order as one text. A table's columns are few, whatever the data."""
    entries = F.array_sort(F.collect_list(F.when(keep, F.struct(order.alias("o"), name.alias("n")))))
    return F.array_join(F.transform(entries, lambda e: e["n"]), ", ")


def catalog_inventory(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per table with size, partition columns, number of columns and the sharded mark."""
    per_table = columns.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("column_count"),
        _ordered_names(F.col("column_name"), F.col("ordinal_position"), F.col("is_partitioning_column")).alias("partition_columns"),
    )
    return tables.join(per_table, "table_id", "left").select(
        "table_id",
        "dataset_name",
        "table_name",
        "table_type",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("size_mb", F.lit(0)).alias("size_mb"),
        F.coalesce("column_count", F.lit(0)).alias("column_count"),
        F.coalesce("partition_columns", F.lit("")).alias("partition_columns"),
        is_sharded_name(F.col("table_name")).alias("is_sharded"),
    )


def page_inventory(tables: DataFrame, partitions: DataFrame, units: DataFrame) -> DataFrame:
    """Rows and megabytes per table from its partitions (``table_id, partition_id, rows``) and their allocation units (``partition_id, pages``)."""
    pages = units.groupBy("partition_id").agg(F.sum("pages").alias("pages"))
    sized = partitions.join(pages, "partition_id", "left").groupBy("table_id").agg(F.sum("rows").alias("rows"), F.sum("pages").alias("pages"))
    return tables.join(sized, "table_id", "left").select(
        "table_id",
        "table_name",
        F.coalesce("rows", F.lit(0)).alias("row_count"),
        F.expr("coalesce(pages, 0) * 8 div 1024").alias("size_mb"),
    )


def object_inventory(objects: Sequence[DataFrame]) -> DataFrame:
    """Views, routines and triggers in one list with what their definitions refer to."""
    code = union_all(objects).withColumn("code", sqltext.code_only(F.col("definition")))
    return code.select(
        "object_name",
        "object_type",
        F.length("definition").alias("definition_length"),
        F.array_join(sqltext.table_references(F.col("code")), ", ").alias("referenced_tables"),
        F.array_join(sqltext.function_references(F.col("code")), ", ").alias("referenced_functions"),
        F.array_join(sqltext.procedure_calls(F.col("definition")), ", ").alias("called_procedures"),
    )


def dataset_summary(datasets: DataFrame, tables: DataFrame) -> DataFrame:
    """Table count and size per dataset, datasets without tables included."""
    sizes = tables.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"), F.sum("size_mb").alias("mb"), F.sum("row_count").alias("r"))
    return datasets.join(sizes, "dataset_name", "left").select(
        "dataset_name",
        F.coalesce("n", F.lit(0)).alias("table_count"),
        F.coalesce("mb", F.lit(0)).alias("total_size_mb"),
        F.coalesce("r", F.lit(0)).alias("total_rows"),
    )


def type_distribution(columns: DataFrame) -> DataFrame:
    """Columns per base type, most frequent first."""
    kind = base_type(F.coalesce("data_type", F.lit("UNKNOWN")))
    return columns.groupBy(kind.alias("base_type")).agg(F.count(F.lit(1)).alias("column_count")).orderBy(F.desc("column_count"), "base_type")


def schema_summary(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Counts over a whole catalog in one row."""
    t = tables.agg(
        F.count(F.lit(1)).alias("tables"),
        F.sum("row_count").alias("total_rows"),
        F.sum("size_mb").alias("total_size_mb"),
        F.count_if(F.size("partitioning_columns") > 0).alias("partitioned_tables"),
        F.count_if(F.size("clustering_columns") > 0).alias("clustered_tables"),
        F.count_if(F.col("has_column_security") | F.col("has_row_security")).alias("secured_tables"),
        F.count_if("is_sharded").alias("sharded_tables"),
    )
    c = columns.agg(
        F.count(F.lit(1)).alias("columns"),
        F.count_if("is_nullable").alias("nullable_columns"),
        F.count_if(~F.col("is_nullable")).alias("non_nullable_columns"),
    )
    d = tables.select("dataset_name").distinct().agg(F.count(F.lit(1)).alias("datasets"))
    return one_row([t, c, d])


def table_columns(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables with their columns nested in ordinal order."""
    entry = F.struct("ordinal_position", "column_name", "data_type", "is_nullable")
    nested = columns.groupBy("table_id").agg(F.array_sort(F.collect_list(entry)).alias("columns"))
    return tables.join(nested, "table_id", "left")


def shard_members(tables: DataFrame) -> DataFrame:
    """Tables named ``prefix_date`` whose date is real, with their group."""
    name = F.col("table_name")

    def date_of(digits: int, pattern: str) -> Column:
        return F.try_to_date(F.regexp_extract(name, rf"^.+_(\d{{{digits}}})$", 1), pattern)

    day, month = date_of(8, "yyyyMMdd"), date_of(6, "yyyyMM")
    rows = tables.withColumn("_day", day).withColumn("shard_date", F.coalesce("_day", month)).filter("shard_date is not null")
    prefix = F.regexp_replace(name, r"_(\d{8}|\d{6})$", "")
    return rows.select("dataset_name", prefix.alias("table_prefix"), "table_name", "shard_date", "size_mb")


def detect_shards(tables: DataFrame) -> DataFrame:
    """Groups of more than one shard with count, size and date range; members come from :func:`shard_members`."""
    groups = (
        shard_members(tables)
        .groupBy("dataset_name", "table_prefix")
        .agg(
            F.count(F.lit(1)).alias("shard_count"),
            F.sum("size_mb").alias("total_size_mb"),
            F.min("shard_date").alias("date_range_start"),
            F.max("shard_date").alias("date_range_end"),
        )
        .filter("shard_count > 1")
    )
    return groups.withColumn("shard_group", F.concat_ws(".", "dataset_name", "table_prefix"))


def security_inventory(columns: DataFrame, row_policies: DataFrame) -> DataFrame:
    """One row per column tag and per row policy, without repeats."""
    none = F.lit(None).cast("string")
    tags = columns.select("table_name", "column_name", F.explode("policy_tags").alias("tag")).select(
        F.lit("CLS").alias("security_type"),
        "table_name",
        F.concat(F.lit("policy_tag_"), "column_name").alias("policy_name"),
        F.col("tag").alias("policy_tag"),
        none.alias("filter_predicate"),
        F.lit(0).alias("grantee_count"),
    )
    grantees = F.when(F.coalesce(F.col("grantee_list"), F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split("grantee_list", ",")
    )
    rows = row_policies.select(
        F.lit("RLS").alias("security_type"),
        "table_name",
        "policy_name",
        none.alias("policy_tag"),
        "filter_predicate",
        F.size(grantees).alias("grantee_count"),
    )
    return tags.unionByName(rows).distinct()


def normalize_names(name: Column) -> Column:
    """Lower case, runs of anything but letters, digits and ``_`` as one ``_``, none at the ends."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9_]", "_"), r"_+", "_")
    clean = F.regexp_replace(clean, r"^_+|_+$", "")
    return F.when(clean == "", "unnamed_table").otherwise(clean)


def namespace_mapping(tables: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Target database per table: the user's name for the dataset, else the dataset itself."""
    if not mapping:
        return tables.withColumn("target_database", F.col("dataset_name"))
    return tables.withColumn("target_database", F.coalesce(lookup(F.col("dataset_name"), mapping), F.col("dataset_name")))


def layout_warnings(tables: DataFrame) -> DataFrame:
    """Tables too large to stay unpartitioned, names that are reserved, and two warnings about the whole."""
    bytes_ = F.col("size_mb") * 1024 * 1024
    unpartitioned = F.size("partitioning_columns") == 0
    name = normalize_names(F.col("table_name"))
    marked = tables.select(
        F.concat_ws(".", "dataset_name", "table_name").alias("subject"),
        (unpartitioned & (bytes_ > LARGE_TABLE_BYTES)).alias("large"),
        name.isin(*RESERVED_WORDS).alias("reserved"),
        unpartitioned.alias("flat"),
        "size_mb",
    )
    single = marked.select(
        "subject",
        F.explode(
            F.array_compact(
                F.array(F.when(F.col("large"), "large_unpartitioned_table"), F.when(F.col("reserved"), "reserved_table_name"))
            )
        ).alias("warning"),
    )
    whole = marked.agg(F.sum("size_mb").alias("mb"), F.count_if("flat").alias("flat")).select(
        F.lit("*").alias("subject"),
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("mb") / 1024 > LARGE_TOTAL_GIB, "large_total_size"),
                    F.when(F.col("flat") > MANY_UNPARTITIONED, "many_unpartitioned_tables"),
                )
            )
        ).alias("warning"),
    )
    return single.unionByName(whole)


def ordered_list_agg(parents: DataFrame, children: DataFrame, key: str, order: str, text: Column) -> DataFrame:
    """Children of each parent in order as one text, such as the key columns of an index."""
    entry = F.struct(F.col(order).alias("o"), text.alias("t"))
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    joined = F.array_join(F.transform("_l", lambda e: e["t"]), ", ")
    return parents.join(lists, key).select(*parents.columns, joined.alias("members"))


def index_column(name: Column, descending: Column) -> Column:
    return F.concat(name, F.when(descending, " DESC").otherwise(" ASC"))


def routine_usage(queries: DataFrame, plans: DataFrame, stats: DataFrame) -> DataFrame:
    """Use of every routine in one go.

    Runtime rows are summed per plan before the joins, so the joins carry one row per plan.
    """
    runs = F.col("count_executions")
    per_plan = stats.groupBy("plan_id").agg(
        F.sum(runs).alias("execution_count"),
        F.sum(F.col("avg_cpu_time") * runs).alias("cpu"),
        F.sum(F.col("avg_duration") * runs).alias("elapsed"),
        F.sum(F.col("avg_logical_io_reads") * runs).alias("logical"),
        F.sum(F.col("avg_physical_io_reads") * runs).alias("physical"),
        F.sum("avg_duration").alias("duration_sum"),
        F.sum("avg_cpu_time").alias("cpu_sum"),
        F.count(F.lit(1)).alias("samples"),
        F.min("first_execution_time").alias("first_seen"),
        F.max("last_execution_time").alias("last_seen"),
    )
    rows = queries.filter("object_id is not null").join(plans, "query_id").join(per_plan, "plan_id").groupBy("object_id").agg(
        *[F.sum(c).alias(c) for c in ("execution_count", "cpu", "elapsed", "logical", "physical", "duration_sum", "cpu_sum", "samples")],
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    micros = F.unix_micros(F.col("last_seen").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))
    days = micros / 1e6 / 86400
    runs = F.col("execution_count").cast("double")
    missed = F.col("physical") / F.greatest(F.col("logical"), F.lit(1))
    return rows.select(
        "object_id",
        "execution_count",
        (F.col("cpu") / 1e6).alias("total_cpu_time_sec"),
        (F.col("elapsed") / 1e6).alias("total_elapsed_time_sec"),
        (F.col("duration_sum") / F.col("samples") / 1e6).alias("avg_elapsed_time_sec"),
        (F.col("cpu_sum") / F.col("samples") / 1e6).alias("avg_cpu_time_sec"),
        F.col("logical").alias("total_logical_reads"),
        F.col("physical").alias("total_physical_reads"),
        F.round(F.when(days > 0, F.try_divide(runs, days)).otherwise(runs), 2).alias("calls_per_day"),
        F.round((F.lit(1.0) - missed) * 100, 2).alias("cache_hit_ratio"),
        "first_seen",
        "last_seen",
    )


def routine_execution_windows(routines: DataFrame, queries: DataFrame, plans: DataFrame, stats: DataFrame, intervals: DataFrame, now: Column) -> DataFrame:
    """Runs per routine today, in the last 7 and the last 30 days, by the start of the measured interval."""
    at, runs = F.col("start_time"), F.col("count_executions")
    recent = intervals.filter(at >= now - F.expr("INTERVAL 30 DAYS"))
    per_plan = stats.join(recent, "interval_id").groupBy("plan_id").agg(
        F.sum(F.when(at >= F.date_trunc("day", now), runs).otherwise(0)).alias("today"),
        F.sum(F.when(at >= now - F.expr("INTERVAL 7 DAYS"), runs).otherwise(0)).alias("week"),
        F.sum(runs).alias("month"),
        F.sum("avg_duration").alias("d"),
        F.count(F.lit(1)).alias("samples"),
        F.max("end_time").alias("last"),
    )
    rows = routines.join(queries, "object_id").join(plans, "query_id").join(per_plan, "plan_id").groupBy("routine_name")
    return rows.agg(
        F.sum("today").alias("executions_today"),
        F.sum("week").alias("executions_last_7_days"),
        F.sum("month").alias("executions_last_30_days"),
        (F.round(F.sum("d") / F.sum("samples")) / 1000).alias("avg_duration_ms"),
        F.max("last").alias("last_execution_time"),
    ).filter("executions_last_30_days > 0")


def query_store_rollup(queries: DataFrame, texts: DataFrame, plans: DataFrame, stats: DataFrame, intervals: DataFrame, since: Column) -> DataFrame:
    """Runs and durations per query of the intervals that end after ``since``, slowest first."""
    kept = intervals.filter(F.col("end_time") >= since)
    wanted = texts.filter(~F.col("query_sql_text").contains("query_store"))
    runs = stats.join(kept, "interval_id").groupBy("plan_id").agg(
        F.sum("count_executions").alias("n"),
        F.sum("avg_duration").alias("d"),
        F.count(F.lit(1)).alias("samples"),
        F.max("avg_duration").alias("top"),
        F.max("end_time").alias("execution_time"),
        F.min("start_time").alias("interval_start_time"),
    )
    rows = queries.join(wanted, "query_text_id").join(plans, "query_id").join(runs, "plan_id")
    grouped = rows.groupBy("query_id", "query_sql_text", "object_id").agg(
        F.sum("n").alias("execution_count"),
        (F.round(F.sum("d") / F.sum("samples")) / 1e6).alias("avg_elapsed_time_sec"),
        F.round(F.max("top") / 1e6, 6).alias("max_elapsed_time_sec"),
        F.max("execution_time").alias("execution_time"),
        F.min("interval_start_time").alias("interval_start_time"),
    )
    return grouped.filter("execution_count > 0").orderBy(F.desc("avg_elapsed_time_sec"), "query_id")


def _rank(rows: DataFrame, columns: Sequence[str]) -> Column:
    """What decides between rows: the columns in turn; those that hold maps, which have no order, by their text."""
    return F.struct(*[sortable(c, rows.schema[c].dataType) for c in dict.fromkeys(columns)])


def latest_completed(runs: DataFrame, key: str, order: str) -> DataFrame:
    """The newest completed run per key. The maximum folds before the shuffle, so a busy key is no hot spot."""
    done = runs.filter("status = 'completed'")
    others = [c for c in runs.columns if c != key]
    return done.groupBy(key).agg(F.max_by(F.struct(*others), _rank(runs, [order, *others])).alias("r")).select(key, "r.*")


def latest_version(rows: DataFrame, name: str, version: str) -> DataFrame:
    """The row with the highest version per name."""
    others = [c for c in rows.columns if c != name]
    return rows.groupBy(name).agg(F.max_by(F.struct(*others), _rank(rows, [version, *others])).alias("r")).select(name, "r.*")


def dedup_keep_first(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the one with the smallest ``order``; rows without one come last, the other columns decide ties."""
    others = [c for c in rows.columns if c not in keys and c != order]
    rank = F.struct(F.col(quoted(order)).isNull().alias("_none"), _rank(rows, [order, *others]).alias("_rank"))
    first = F.min_by(F.struct(*[F.col(quoted(c)) for c in [order, *others]]), rank)
    kept = rows.groupBy(*[F.col(quoted(k)) for k in keys]).agg(first.alias("r"))
    return kept.select(*[quoted(k) for k in keys], "r.*").select(*[quoted(c) for c in rows.columns])


def table_page(tables: DataFrame, children: DataFrame, page: int, page_size: int, dataset: str | None = None) -> DataFrame:
    """One page of tables by id, and only their columns."""
    chosen = tables if dataset is None else tables.filter(F.col("dataset_name") == dataset)
    chosen = ordered_slice(chosen, [("table_id", False)], (page - 1) * page_size + 1, page * page_size)
    return children.join(chosen.select("table_id", "dataset_name", "table_name"), "table_id")


def unified_jobs(kinds: Mapping[str, DataFrame], status: str | None = None) -> DataFrame:
    """Runs of several kinds in one shape (``job_id, job_type, name, status, started_at, progress``), newest first."""
    frames = []
    for kind, df in kinds.items():
        state = F.coalesce("status", F.lit("pending"))
        progress = F.col("progress") if "progress" in df.columns else F.when(state == "completed", 100).when(state == "running", 50).otherwise(0)
        frames.append(
            df.select(
                F.concat_ws("-", F.lit(kind), F.col("id").cast("string")).alias("job_id"),
                F.lit(kind).alias("job_type"),
                "name",
                state.alias("status"),
                "started_at",
                progress.cast("int").alias("progress"),
            )
        )
    merged = union_all(frames)
    if status is not None:
        merged = merged.filter(F.col("status") == status)
    return merged.orderBy(F.desc_nulls_last("started_at"), "job_id")


def recent_activity(kinds: Mapping[str, DataFrame], limit: int = 5) -> DataFrame:
    """The newest ``limit`` of each kind by id, then the newest ``limit`` of these by time."""
    tops = [
        df.orderBy(F.desc("id")).limit(limit).select(F.lit(kind).alias("job_type"), "id", "name", "status", "started_at") for kind, df in kinds.items()
    ]
    return union_all(tops).orderBy(F.desc_nulls_last("started_at"), "job_type", "id").limit(limit)


def status_summary(kinds: Mapping[str, DataFrame]) -> DataFrame:
    """Jobs by status, rows and bytes per kind, with a line for all. ``rows`` and ``bytes`` may be absent."""
    sums = ("rows", "bytes")
    rows = union_all(
        [
            df.select(
                F.lit(kind).alias("job_type"),
                F.coalesce("status", F.lit("pending")).alias("status"),
                *[(F.coalesce(F.col(c), F.lit(0)) if c in df.columns else F.lit(0)).cast("bigint").alias(c) for c in sums],
            )
            for kind, df in kinds.items()
        ]
    )

    def number(*states: str) -> Column:
        return F.count_if(F.col("status").isin(*states))

    measures = {
        "total": F.count(F.lit(1)),
        "running": number("running"),
        "completed": number("completed"),
        "failed": number("failed"),
        "pending": number("pending", "queued", "ready"),
        **{f"total_{c}": F.sum(c) for c in sums},
    }
    per_kind = rows.groupBy("job_type").agg(*[m.alias(n) for n, m in measures.items()])
    lines = F.explode(F.array(F.col("job_type"), F.lit("all"))).alias("job_type")
    return per_kind.select(lines, *measures).groupBy("job_type").agg(*[F.sum(n).alias(n) for n in measures])


def history_filter(
    history: DataFrame,
    migration_id: int | None = None,
    status: str | None = None,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    rows = history
    if migration_id is not None:
        rows = rows.filter(F.col("migration_id") == migration_id)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if start is not None:
        rows = rows.filter(F.col("started_at") >= start)
    if end is not None:
        rows = rows.filter(F.col("started_at") <= end)
    return rows


def history_page(history: DataFrame, page: int, page_size: int) -> DataFrame:
    order = [("started_at", True), ("load_id", False)]
    return ordered_slice(history, order, (page - 1) * page_size + 1, page * page_size).drop("position")


def history_summary(history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return history.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_loads"),
        F.coalesce(F.sum("rows_loaded"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("bytes_loaded"), F.lit(0)).alias("total_bytes"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def load_progress(shards: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shards done, failed and per stage; done means all three stages are."""
    stages = ("export_status", "transfer_status", "load_status")
    done = F.lit(True)
    broken = F.lit(False)
    for stage in stages:
        done, broken = done & (F.col(stage) == "completed"), broken | (F.col(stage) == "failed")
    total = F.count(F.lit(1))
    return shards.groupBy(*by).agg(
        total.alias("total_shards"),
        F.count_if(done).alias("completed_shards"),
        F.count_if(broken).alias("failed_shards"),
        F.round(F.count_if(done) / total * 100, 2).alias("progress_percentage"),
        *[F.count_if(F.col(s) == "completed").alias(s.replace("_status", "_completed")) for s in stages],
    )


def resume_set(planned: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned items whose latest recorded load is not completed."""
    done = history.filter("status = 'completed'").select(*keys).distinct()
    return planned.join(done, list(keys), "left_anti")


