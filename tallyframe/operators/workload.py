"""Figures over a warehouse query log.

The log has ``job_id, execution_time, query_text, bytes_scanned,
slot_milliseconds, cache_hit, referenced_tables, user_email`` and the struct
``query_metadata<total_elapsed_time_ms, bytes_billed, statement_type>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import sqltext, times
from tallyframe.functions.values import half_even, percent
from tallyframe.operators.ranks import nearest_rank, one_row, peak_running_sum
from tallyframe.operators.records import ordered_page, ordered_slice
from tallyframe.session import cut_lineage

ASSUMED_RUNTIME_MS = 30_000  # runtime of a query that has none recorded (fixed value)
REPEATED_TEXT = 10  # occurrences from which a text counts as scheduled (fixed value)
PERCENTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}  # fixed values
TIB = 1024**4
SPAN_DEFAULT_DAYS = 30  # span of a log with fewer than two timed queries (fixed value)


def parse_metadata(raw: Column) -> Column:
    """The metadata struct from JSON text; anything else gives NULL fields."""
    return F.from_json(raw, "total_elapsed_time_ms bigint, bytes_billed bigint, statement_type string")


def scan_query_log(jobs: DataFrame, now: Column, days: int = 30, text_days: int | None = None, text_length: int | None = None) -> DataFrame:
    """Finished queries of the last ``days`` with their whole text.

    To keep less, ``text_days`` drops the text of older queries and ``text_length`` cuts
    it; figures over the text are then of what is left.
    """
    def since(n: int) -> Column:
        return F.col("execution_time") >= now - F.make_interval(days=F.lit(n))

    text = F.col("query_text") if text_length is None else F.substring("query_text", 1, text_length)
    return (
        jobs.filter((F.col("job_type") == "QUERY") & (F.col("state") == "DONE"))
        .filter(since(days))
        .withColumn("query_text", text if text_days is None else F.when(since(text_days), text))
        .drop("job_type", "state")
    )


def enrich(log: DataFrame) -> DataFrame:
    """The log with its gaps filled: the columns all figures are made of."""
    meta = F.col("query_metadata")
    elapsed = F.coalesce(meta["total_elapsed_time_ms"], F.lit(0))
    slot_ms = F.coalesce(F.col("slot_milliseconds"), F.lit(0))
    runtime = F.when(elapsed > 0, elapsed).otherwise(ASSUMED_RUNTIME_MS)
    slots = F.when(slot_ms > 0, F.greatest(F.lit(1.0), slot_ms.cast("double") / runtime))
    return log.select(
        "job_id",
        "execution_time",
        "query_text",
        "referenced_tables",
        F.when(F.col("user_email") != "", F.col("user_email")).alias("user_email"),
        F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"),
        F.upper(F.coalesce(meta["statement_type"], F.lit(""))).alias("statement_type"),
        F.coalesce("bytes_scanned", F.lit(0)).alias("bytes"),
        F.coalesce(meta["bytes_billed"], F.lit(0)).alias("billed"),
        slot_ms.alias("slot_ms"),
        elapsed.alias("elapsed_ms"),
        runtime.alias("runtime_ms"),
        # Decimal, so that sums do not depend on the order of the rows.
        slots.cast("decimal(20,6)").alias("slots"),
        sqltext.statement_class(meta["statement_type"]).alias("statement_class"),
    )


def _span_days() -> Column:
    seconds = (F.unix_micros(F.max("last_at").cast("timestamp")) - F.unix_micros(F.min("first_at").cast("timestamp"))) / 1e6
    return F.when(F.sum("timed") >= 2, F.greatest(seconds / 86400, F.lit(1.0))).otherwise(float(SPAN_DEFAULT_DAYS))


def log_totals(log: DataFrame) -> DataFrame:
    """Totals of an enriched log in one row.

    Grouping by user first makes the distinct count a plain count and needs one shuffle.
    """
    is_select = F.col("statement_type") == "SELECT"
    by_user = log.groupBy("user_email").agg(
        F.count(F.lit(1)).alias("queries"),
        F.sum("bytes").alias("bytes"),
        F.sum("billed").alias("billed"),
        F.sum("slot_ms").alias("slot_ms"),
        F.count_if(F.col("statement_class") == "WRITE").alias("writes"),
        F.count_if(is_select).alias("selects"),
        F.count_if(is_select & F.col("cache_hit")).alias("hits"),
        F.max("slot_ms").alias("max_slot"),
        F.min(F.when(F.col("slot_ms") > 0, F.col("slot_ms"))).alias("min_slot"),
        F.sum("slots").alias("slots"),
        F.count("slots").alias("slotted"),
        F.max("slots").alias("max_slots"),
        F.min("slots").alias("min_slots"),
        F.count("execution_time").alias("timed"),
        F.min("execution_time").alias("first_at"),
        F.max("execution_time").alias("last_at"),
    )
    names = ("queries", "bytes", "billed", "slot_ms", "writes", "selects", "hits", "slotted")
    return by_user.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
        F.count("user_email").alias("users"),
        F.max("max_slot").alias("max_slot"),
        F.coalesce(F.min("min_slot"), F.lit(0)).alias("min_slot"),
        F.coalesce(F.try_divide(F.sum("slots").cast("double"), F.sum("slotted")), F.lit(1.0)).alias("avg_slots"),
        F.max("max_slots").alias("max_slots"),
        F.min("min_slots").alias("min_slots"),
        _span_days().alias("span_days"),
    )


def querylog_kpis(log: DataFrame) -> DataFrame:
    """Headline figures of the log in one row."""
    t = log_totals(enrich(log))
    average = half_even(F.try_divide(F.col("slot_ms").cast("double"), F.col("queries")), 0)
    concurrent = F.greatest(F.col("avg_slots"), F.lit(1.0))
    hours = F.col("slot_ms") / F.lit(3_600_000.0)
    return t.select(
        F.col("queries").alias("total_query_count"),
        F.col("users").alias("active_users_count"),
        F.col("bytes").alias("total_bytes_scanned"),
        F.when(F.col("billed") > 0, F.col("billed")).otherwise(F.col("bytes")).alias("total_bytes_billed"),
        F.col("slot_ms").alias("total_slot_milliseconds"),
        percent(F.col("hits"), F.col("selects"), 2).alias("cache_hit_rate"),
        F.col("hits").alias("cache_hits"),
        (F.col("selects") - F.col("hits")).alias("cache_misses"),
        F.col("selects").alias("select_queries"),
        (F.col("queries") - F.col("writes")).alias("read_queries"),
        F.col("writes").alias("write_queries"),
        F.col("max_slot").alias("max_slot_milliseconds"),
        F.col("min_slot").alias("min_slot_milliseconds"),
        average.alias("avg_slot_ms_per_query"),
        half_even(average / 1000, 3).alias("avg_execution_time_seconds"),
        half_even(F.col("max_slot") / concurrent / 1000, 2).alias("max_query_runtime_seconds"),
        half_even(F.col("min_slot") / concurrent / 1000, 4).alias("min_query_runtime_seconds"),
        half_even(average / concurrent / 1000, 2).alias("avg_query_runtime_seconds"),
        F.least(half_even(hours / (F.col("span_days") * 24), 2), F.lit(24.0)).alias("active_hours_per_day"),
        half_even(F.col("span_days"), 1).alias("query_time_span_days"),
    )


def peak_concurrency(log: DataFrame) -> DataFrame:
    """Highest sum of slots in use at one instant, and the average slots of a query."""
    return _peak_concurrency(enrich(log))


def _peak_concurrency(rich: DataFrame) -> DataFrame:
    timed = rich.filter(F.col("execution_time").isNotNull() & F.col("slots").isNotNull())
    ends = F.col("execution_time") + F.make_dt_interval(secs=F.col("runtime_ms") / 1000)
    changes = timed.select(
        F.inline(
            F.array(
                F.struct(F.col("execution_time").alias("at"), F.col("slots").alias("change")),
                F.struct(ends.alias("at"), (-F.col("slots")).cast("decimal(20,6)").alias("change")),
            )
        )
    )
    average = timed.agg(F.try_divide(F.sum("slots").cast("double"), F.count("slots")).alias("avg_slot_utilization"))
    peak = peak_running_sum(changes, "at", "change").select(half_even(F.col("peak").cast("double"), 1).alias("peak_slot_utilization"))
    return one_row([peak, average]).select(
        "peak_slot_utilization", half_even(F.coalesce("avg_slot_utilization", F.lit(0.0)), 1).alias("avg_slot_utilization")
    )


def workload_metrics(log: DataFrame) -> DataFrame:
    """Totals, monthly extrapolation and concurrency of the log in one row.

    The log is read once: the columns all figures are made of, without texts, are
    written, as totals, peak and median each go over them.
    """
    used = ("execution_time", "user_email", "cache_hit", "statement_type", "bytes", "billed", "slot_ms", "runtime_ms", "slots", "statement_class")
    rich = cut_lineage(enrich(log).select(*used))
    median = nearest_rank(rich, F.col("slots") * 1_000_000, {"median": 0.5}).select(
        half_even(F.col("median") / 1e6, 1).alias("median_concurrent_slots")
    )
    t = log_totals(rich)
    hours, days = F.col("slot_ms") / F.lit(3_600_000.0), F.col("span_days")
    average = F.try_divide(F.col("slot_ms").cast("double"), F.col("queries"))
    concurrent = F.greatest(F.col("avg_slots"), F.lit(1.0))
    totals = t.select(
        F.col("queries").alias("query_count"),
        F.col("slot_ms").alias("total_slot_ms"),
        half_even(hours, 2).alias("total_slot_hours"),
        half_even(average, 0).alias("avg_slot_ms_per_query"),
        F.col("bytes").alias("total_bytes_scanned"),
        half_even(F.col("bytes") / F.lit(float(TIB)), 4).alias("total_tb_scanned"),
        half_even(F.try_divide(F.col("bytes").cast("double"), F.col("queries")), 0).alias("avg_bytes_per_query"),
        half_even(hours / days, 2).alias("estimated_daily_slot_hours"),
        half_even(hours / days * 30, 2).alias("estimated_monthly_slot_hours"),
        half_even(days, 1).alias("query_time_span_days"),
        half_even(average / concurrent / 1000, 1).alias("avg_wall_clock_seconds"),
        half_even(F.least(hours / (days * 24), F.lit(24.0)), 1).alias("active_hours_per_day"),
        half_even(F.col("max_slots").cast("double"), 1).alias("max_concurrent_slots"),
        half_even(F.col("min_slots").cast("double"), 1).alias("min_concurrent_slots"),
        half_even(F.col("avg_slots"), 1).alias("avg_concurrent_slots"),
    )
    peak = _peak_concurrency(rich).select(F.col("peak_slot_utilization").alias("estimated_peak_slots"))
    return one_row([totals, peak, median])


def statement_breakdown(log: DataFrame) -> DataFrame:
    """Jobs, volume and durations per statement type, most jobs first."""
    kind = F.when(F.col("statement_type") == "", "UNKNOWN").otherwise(F.col("statement_type"))
    return (
        enrich(log)
        .groupBy(kind.alias("statement_type"))
        .agg(
            F.count(F.lit(1)).alias("job_count"),
            half_even(F.sum("bytes") / F.lit(float(TIB)), 6).alias("tib_processed"),
            half_even(F.sum("elapsed_ms") / F.count(F.lit(1)) / 1000, 2).alias("avg_duration_sec"),
            half_even(F.max("elapsed_ms") / 1000, 2).alias("max_duration_sec"),
        )
        .orderBy(F.desc("job_count"), "statement_type")
    )


def _every_hour(per_hour: DataFrame, zero: Sequence[str]) -> DataFrame:
    """All 24 hours, missing ones zero. The right side has at most 24 rows."""
    hours = per_hour.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(F.broadcast(per_hour), "hour", "left").select("hour", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero])


def hourly_slot_usage(log: DataFrame) -> DataFrame:
    """Queries and slot use per hour of day, 24 rows."""
    seconds = F.sum("slot_ms") / 1000
    per_hour = (
        enrich(log)
        .filter("execution_time is not null")
        .groupBy(F.hour("execution_time").alias("hour"))
        .agg(
            F.count(F.lit(1)).alias("query_count"),
            half_even(seconds, 1).alias("total_slot_seconds"),
            half_even(seconds / F.count(F.lit(1)), 1).alias("avg_slot_seconds_per_query"),
            half_even(F.sum("slot_ms") / 3_600_000, 1).alias("avg_slots_used"),
        )
    )
    return _every_hour(per_hour, ("query_count", "total_slot_seconds", "avg_slot_seconds_per_query", "avg_slots_used"))


def user_patterns_by_hour(log: DataFrame) -> DataFrame:
    """Per hour of day: distinct users, queries with a user, and the busiest minute."""
    rows = enrich(log).filter("execution_time is not null")
    hour = F.hour("execution_time").alias("hour")
    minutes = rows.groupBy(hour, F.date_trunc("minute", "execution_time").alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    busiest = minutes.groupBy("hour").agg(F.max("n").alias("peak_concurrent_in_hour"))
    users = rows.filter("user_email is not null").groupBy(hour, "user_email").agg(F.count(F.lit(1)).alias("n"))
    seen = users.groupBy("hour").agg(F.count(F.lit(1)).alias("distinct_users"), F.sum("n").alias("total_queries"))
    merged = busiest.unionByName(seen, allowMissingColumns=True).groupBy("hour")
    names = ("distinct_users", "total_queries", "peak_concurrent_in_hour")
    return _every_hour(merged.agg(*[F.max(n).alias(n) for n in names]), names)


def per_minute(log: DataFrame) -> DataFrame:
    return (
        log.filter("execution_time is not null")
        .groupBy(F.date_trunc("minute", "execution_time").cast("timestamp_ntz").alias("minute"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def concurrency_buckets(log: DataFrame) -> DataFrame:
    """Query counts per minute, hour, day and week. Coarser counts come from the minutes, not from the log."""
    at = F.col("minute")
    keys = F.array(
        *[
            F.struct(F.lit(grain).alias("granularity"), key.alias("bucket"))
            for grain, key in (
                ("minute", times.minute_key(at)),
                ("hour", times.hour_key(at)),
                ("day", times.day_key(at)),
                ("week", times.week_key(at)),
            )
        ]
    )
    return per_minute(log).select("n", F.inline(keys)).groupBy("granularity", "bucket").agg(F.sum("n").alias("query_count"))


def minute_percentiles(log: DataFrame) -> DataFrame:
    """Percentiles of the queries per minute that has any, with their maximum and average."""
    minutes = per_minute(log)
    rest = minutes.agg(F.max("n").alias("max"), half_even(F.avg("n"), 1).alias("avg"), F.count(F.lit(1)).alias("minutes"))
    return one_row([nearest_rank(minutes, F.col("n"), PERCENTILES), rest])


def duration_histogram(log: DataFrame) -> DataFrame:
    """Queries per minute of runtime, halves rounded to even; a missing runtime is estimated from slots."""
    slot = F.col("slot_ms").cast("double")
    estimated = F.when(slot > 0, slot / F.greatest(F.lit(1.0), slot / ASSUMED_RUNTIME_MS)).otherwise(0.0)
    runtime = F.when(F.col("elapsed_ms") > 0, F.col("elapsed_ms").cast("double")).otherwise(estimated)
    minutes = half_even(runtime / 60_000, 0).cast("bigint")
    return enrich(log).groupBy(minutes.alias("duration_mins")).agg(F.count(F.lit(1)).alias("query_count"))


def repeat_query_rate(log: DataFrame, shapes: bool = False) -> DataFrame:
    """Texts, distinct texts and the share of queries whose text occurs again; case and white space do not count.

    With ``shapes`` values do not count either: texts that differ in literals only are one query.
    """
    text = sqltext.statement_shape(F.col("query_text")) if shapes else F.lower(F.regexp_replace("query_text", r"\s+", " "))
    digest = F.md5(text)
    texts = log.filter("query_text is not null").groupBy(digest.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    repeated = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return texts.agg(
        total.alias("total_queries"),
        F.count(F.lit(1)).alias("unique_query_count"),
        repeated.alias("repeated_queries"),
        percent(repeated, total).alias("repeat_query_rate"),
    )


def slot_timeline(timeline: DataFrame) -> DataFrame:
    """Slots in use per period (``period_start, period_slot_ms``): peak, average and percentiles."""
    periods = timeline.groupBy("period_start").agg(F.sum(F.coalesce("period_slot_ms", F.lit(0))).alias("ms"))
    ranks = nearest_rank(periods, F.col("ms"), PERCENTILES)
    ranks = ranks.select(*[half_even(F.col(p) / 1000, 1).alias(f"{p}_concurrent_slots") for p in PERCENTILES])
    rest = periods.agg(
        half_even(F.max("ms") / 1000, 1).alias("peak_concurrent_slots"),
        half_even(F.sum("ms") / F.count(F.lit(1)) / 1000, 1).alias("avg_concurrent_slots"),
        F.count(F.lit(1)).alias("timeline_periods_count"),
    )
    return one_row([ranks, rest])


def user_insights(log: DataFrame) -> DataFrame:
    """Queries, volume, slots and cache hits per user, busiest first."""
    return (
        enrich(log)
        .groupBy(F.coalesce("user_email", F.lit("Unknown")).alias("user_email"))
        .agg(
            F.count(F.lit(1)).alias("query_count"),
            F.sum("bytes").alias("total_bytes_scanned"),
            F.sum("slot_ms").alias("total_slot_milliseconds"),
            F.round(F.count_if("cache_hit") / F.count(F.lit(1)) * 100, 1).alias("cache_hit_rate"),
        )
        .orderBy(F.desc("query_count"), "user_email")
    )


def report_summary(log: DataFrame) -> DataFrame:
    """The figures of the printed report: reads and writes by text, slots, cache, busiest hour, users."""
    text = F.trim(F.col("query_text"))
    has_text = F.coalesce(F.col("query_text") != "", F.lit(False))
    writes = has_text & text.rlike(r"(?i)^\s*(INSERT|UPDATE|DELETE|MERGE|CREATE|DROP|ALTER|TRUNCATE|CALL)\b")
    rows = enrich(log)
    total = F.sum("queries")
    by_user = rows.groupBy("user_email").agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(has_text & ~writes).alias("reads"),
        F.count_if(writes).alias("writes"),
        F.sum("slot_ms").alias("slot_ms"),
        F.max("slot_ms").alias("max_slot"),
        F.sum("bytes").alias("bytes"),
        F.count_if("cache_hit").alias("hits"),
    )
    totals = by_user.agg(
        total.alias("total_queries"),
        F.sum("reads").alias("read_queries"),
        F.sum("writes").alias("write_queries"),
        F.round(F.sum("reads") / total * 100, 1).alias("read_pct"),
        F.round(F.sum("writes") / total * 100, 1).alias("write_pct"),
        F.sum("slot_ms").alias("total_slot_ms"),
        F.round(F.sum("slot_ms") / total, 2).alias("avg_slot_ms"),
        F.max("max_slot").alias("max_slot_ms"),
        F.sum("bytes").alias("total_bytes"),
        F.round(F.sum("hits") / total * 100, 1).alias("cache_ratio"),
        F.count(F.lit(1)).alias("unique_users"),
    )
    hours = rows.filter("execution_time is not null").groupBy(F.date_trunc("hour", "execution_time")).agg(F.count(F.lit(1)).alias("n"))
    return one_row([totals, hours.agg(F.coalesce(F.max("n"), F.lit(0)).alias("peak_concurrent"))])


def classify_read_write(log: DataFrame) -> DataFrame:
    """READ or WRITE per query, by type alone and by type with the text as fallback."""
    kind = F.col("query_metadata.statement_type")
    return log.select(
        "job_id",
        sqltext.statement_class(kind).alias("statement_class"),
        sqltext.statement_class_by_text(kind, F.col("query_text")).alias("statement_class_by_text"),
    )


def classify_bi_adhoc(log: DataFrame) -> DataFrame:
    """BI or AD_HOC per query.

    Texts seen often enough are few by count, but the set is unbounded, so Spark
    picks the join and splits a hot text at run time.
    """
    marked = log.select(
        "job_id",
        sqltext.text_fingerprint(F.col("query_text")).alias("_fp"),
        sqltext.looks_like_bi(F.col("query_text"), F.col("user_email")).alias("_bi"),
    )
    repeated = marked.groupBy("_fp").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= REPEATED_TEXT)
    return marked.join(repeated, "_fp", "left").select(
        "job_id", F.when(F.col("_bi") | F.col("_n").isNotNull(), "BI").otherwise("AD_HOC").alias("query_class")
    )


def classification_summary(log: DataFrame) -> DataFrame:
    """Counts and shares of BI, ad-hoc, reads, writes and cache hits in one row; one shuffle, no join."""
    kind = F.upper(F.coalesce(F.col("query_metadata.statement_type"), F.lit("")))
    text = F.coalesce(F.col("query_text"), F.lit(""))
    known = ~kind.isin("", "UNKNOWN")
    writes = sqltext.statement_class_by_text(kind, text) == "WRITE"
    selects = F.when(known, kind == "SELECT").otherwise(~writes & (F.trim(text) != ""))
    hit = F.coalesce(F.col("cache_hit"), F.lit(False))
    by_text = log.groupBy(sqltext.text_fingerprint(text).alias("_fp")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(sqltext.looks_like_bi(text, F.col("user_email"))).alias("bi"),
        F.count_if(writes).alias("writes"),
        F.count_if(selects).alias("selects"),
        F.count_if(selects & hit).alias("hits"),
    )
    t = by_text.agg(
        F.sum("n").alias("total_queries"),
        F.sum(F.when(F.col("n") >= REPEATED_TEXT, F.col("n")).otherwise(F.col("bi"))).alias("bi_count"),
        F.sum("writes").alias("write_count"),
        F.sum("selects").alias("select_queries"),
        F.sum("hits").alias("cache_hits"),
    )
    total = F.col("total_queries")
    adhoc, reads = total - F.col("bi_count"), total - F.col("write_count")
    return t.select(
        "*",
        adhoc.alias("adhoc_count"),
        reads.alias("read_count"),
        percent(F.col("bi_count"), total).alias("bi_pct"),
        percent(adhoc, total).alias("adhoc_pct"),
        percent(reads, total).alias("read_pct"),
        percent(F.col("write_count"), total).alias("write_pct"),
        percent(F.col("cache_hits"), F.col("select_queries")).alias("cache_hit_ratio"),
    )


def billing_rollup(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Billed volume and its monthly projection; scanned bytes stand in when nothing was billed."""
    seconds = F.unix_micros(F.max("execution_time").cast("timestamp")) - F.unix_micros(F.min("execution_time").cast("timestamp"))
    days = F.when(F.count("execution_time") >= 2, F.greatest(seconds / 1e6 / 86400, F.lit(1.0))).otherwise(float(SPAN_DEFAULT_DAYS))
    volume = F.when(F.sum("billed") > 0, F.sum("billed")).otherwise(F.sum("bytes"))
    span = half_even(days, 1)
    return (
        enrich(log)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("total_queries"),
            volume.alias("bytes_for_billing"),
            span.alias("query_time_span_days"),
            F.round(volume / span * 30 / F.lit(float(TIB)), 6).alias("monthly_tb"),
            half_even(F.count(F.lit(1)) / F.greatest(span, F.lit(1.0)) * 30, 0).cast("bigint").alias("monthly_queries"),
        )
    )


def timeframe_filter(log: DataFrame, now: Column, timeframe: str) -> DataFrame:
    return log.filter(times.since(F.col("execution_time"), now, timeframe))


def search_filter(log: DataFrame, needle: str) -> DataFrame:
    """Rows whose text, user or job id contains ``needle`` in any case."""
    lowered = needle.lower()
    found = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(lowered)) for c in ("query_text", "user_email", "job_id")]
    return log.filter(found[0] | found[1] | found[2])


SORT_COLUMNS = {
    "bytes_scanned": "bytes_scanned",
    "slot_milliseconds": "slot_milliseconds",
    "execution_time": "execution_time",
    "est_runtime": "execution_time",
}


DEEP = 10_000  # rows from which on a page is cut by ranges


def query_page(log: DataFrame, sort_by: str = "bytes_scanned", page: int = 1, page_size: int = 50) -> DataFrame:
    """One page of the log, largest first, missing values last.

    Early pages are the top of the log; deep ones are cut by ranges, so that no task
    sorts all rows before them. Both give the same rows.
    """
    order = [(SORT_COLUMNS.get(sort_by, "bytes_scanned"), True), ("job_id", False)]
    start, end = (page - 1) * page_size + 1, page * page_size
    if end <= DEEP:
        return ordered_page(log, order, start, end)
    return ordered_slice(log, order, start, end).orderBy("position").drop("position")


def page_view(page: DataFrame, log: DataFrame, text_length: int | None = None) -> DataFrame:
    """The rows of a page as shown: gaps filled, slots and runtime estimated, text whole or cut at ``text_length``.

    Where no runtime was recorded, the average slots of the whole log stand in; that is one number.
    """
    average = log_totals(enrich(log)).select(F.greatest("avg_slots", F.lit(1.0))).first()[0]
    meta, text = F.col("query_metadata"), F.coalesce("query_text", F.lit(""))
    slot = F.coalesce("slot_milliseconds", F.lit(0)).cast("double")
    elapsed, scanned = F.coalesce(meta["total_elapsed_time_ms"], F.lit(0)), F.coalesce("bytes_scanned", F.lit(0))
    used = F.try_divide(slot, elapsed)
    known = (slot > 0) & (elapsed > 0)
    utilization = F.when(known, F.greatest(F.lit(1.0), used)).when(slot > 0, slot / ASSUMED_RUNTIME_MS).otherwise(0.0)
    runtime = F.when(known, slot / F.greatest(used, F.lit(1.0))).when(slot > 0, slot / F.lit(average)).otherwise(0.0)
    hit = F.col("cache_hit")
    return page.select(
        "job_id",
        "execution_time",
        (text if text_length is None else F.substring(text, 1, text_length)).alias("query_text"),
        scanned.alias("bytes_scanned"),
        F.coalesce(meta["bytes_billed"], scanned).alias("bytes_billed"),
        slot.cast("bigint").alias("slot_milliseconds"),
        half_even(utilization, 1).alias("slot_utilization"),
        half_even(runtime / 1000, 2).alias("est_runtime_seconds"),
        F.when(hit, "Hit").when(~hit, "Miss").otherwise("N/A").alias("cache_hit_status"),
        F.coalesce(meta["statement_type"], F.lit("UNKNOWN")).alias("statement_type"),
        F.coalesce("referenced_tables", F.array().cast("array<string>")).alias("referenced_tables"),
        F.coalesce(F.when(F.col("user_email") != "", F.col("user_email")), F.lit("Unknown")).alias("user_email"),
    )


def page_totals(log: DataFrame, page_size: int = 50) -> DataFrame:
    """How many rows, and pages of them, there are."""
    total = F.count(F.lit(1))
    return log.agg(total.alias("total_filtered"), F.ceil(total / page_size).alias("total_pages"))


def heaviest_queries(log: DataFrame, limit: int = 10) -> DataFrame:
    return log.orderBy(F.col("slot_milliseconds").desc_nulls_last(), "job_id").limit(limit)


def peak_bucket(log: DataFrame) -> DataFrame:
    """Busiest hour of day and weekday; ties go to the smaller hour and the earlier weekday."""
    timed = log.filter("execution_time is not null")
    cells = timed.groupBy(F.hour("execution_time").alias("hour"), F.weekday("execution_time").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    # From here on at most 24 * 7 rows.
    sides = []
    for name in ("hour", "day"):
        counts = cells.groupBy(name).agg(F.sum("n").alias("n"))
        best = F.max(F.struct(F.col("n"), (-F.col(name)).alias("k")))
        sides.append(counts.agg((-best["k"]).alias(f"peak_{name}"), best["n"].alias(f"peak_{name}_queries")))
    names = F.array(*[F.lit(d) for d in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")])
    return one_row(sides).select(
        "peak_hour",
        "peak_hour_queries",
        F.try_element_at(names, F.col("peak_day") + 1).alias("peak_day_of_week"),
        F.col("peak_day_queries"),
    )


def join_etl_metrics(log: DataFrame) -> DataFrame:
    """JOINs per query, queries with joins, scans above 1 GB and the share of loading queries."""
    text = F.upper(F.coalesce(F.col("query_text"), F.lit("")))
    joins = F.regexp_count(text, F.lit(r"\bJOIN\b"))
    loading = sqltext.contains_any(text, ("CREATE TABLE", "INSERT INTO", "MERGE", "CTAS", "CREATE OR REPLACE"))
    total = F.count(F.lit(1))
    return log.agg(
        total.alias("total_queries"),
        F.coalesce(half_even(F.try_divide(F.sum(joins).cast("double"), total), 1), F.lit(0.0)).alias("avg_joins"),
        F.count_if(joins > 0).alias("queries_with_joins"),
        F.count_if(F.coalesce("bytes_scanned", F.lit(0)) > 1_000_000_000).alias("scan_heavy"),
        F.count_if(loading).alias("etl_count"),
        percent(F.count_if(loading), total).alias("etl_pct"),
    )


