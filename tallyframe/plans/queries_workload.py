"""Registered queries: figures over the query log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import sqltext
from tallyframe.operators import ranks, workload
from tallyframe.plans import views as v
from tallyframe.plans.registry import query

RICH = """rich AS (
  SELECT *, upper(statement_type) AS stmt, coalesce(elapsed, 0) AS elapsed_ms, slot_milliseconds AS slot_ms,
    CASE WHEN coalesce(elapsed, 0) > 0 THEN elapsed ELSE 30000 END AS runtime_ms,
    CASE WHEN slot_milliseconds > 0 THEN CAST(greatest(1.0::DOUBLE,
      slot_milliseconds::DOUBLE / (CASE WHEN coalesce(elapsed, 0) > 0 THEN elapsed ELSE 30000 END)) AS DECIMAL(20,6)) END AS slots,
    upper(statement_type) IN ('INSERT', 'MERGE') AS is_write
  FROM query_log)"""

TOTALS = """t AS (
  SELECT count(*)::DOUBLE q, count(DISTINCT user_email) users, sum(bytes_scanned)::BIGINT bytes, sum(billed)::BIGINT billed, sum(slot_ms)::BIGINT slot,
    count(*) FILTER (is_write) w, count(*) FILTER (stmt = 'SELECT') sel, count(*) FILTER (stmt = 'SELECT' AND cache_hit) hits,
    max(slot_ms) max_slot, min(slot_ms) FILTER (slot_ms > 0) min_slot, sum(slots)::DOUBLE / count(slots) avg_slots,
    max(slots)::DOUBLE max_slots, min(slots)::DOUBLE min_slots,
    greatest((epoch_us(max(execution_time)) - epoch_us(min(execution_time)))::DOUBLE / 1e6::DOUBLE / 86400, 1.0::DOUBLE) AS days,
    round_even(sum(slot_ms)::DOUBLE / count(*), 0) avg_slot, sum(slot_ms)::DOUBLE / 3600000.0::DOUBLE AS hours FROM rich)"""

PEAK = """ev AS (
  SELECT execution_time AS w, slots AS d FROM rich WHERE slots IS NOT NULL
  UNION ALL SELECT execution_time + to_milliseconds(runtime_ms), -slots FROM rich WHERE slots IS NOT NULL),
run AS (SELECT sum(d) OVER (ORDER BY w, d ROWS UNBOUNDED PRECEDING) r FROM ev),
pk AS (SELECT round_even(max(r)::DOUBLE, 1) AS peak FROM run)"""


def log_sql(*fragments: str) -> str:
    return v.with_views(v.QUERY_LOG, RICH, *fragments)


@query("querylog_kpis", log_sql(TOTALS, """
SELECT q::BIGINT AS total_query_count, users AS active_users_count, bytes AS total_bytes_scanned,
  CASE WHEN billed > 0 THEN billed ELSE bytes END AS total_bytes_billed, slot AS total_slot_milliseconds,
  round_even(hits::DOUBLE / sel * 100, 2) AS cache_hit_rate, hits AS cache_hits, sel - hits AS cache_misses, sel AS select_queries,
  q::BIGINT - w AS read_queries, w AS write_queries, max_slot AS max_slot_milliseconds, min_slot AS min_slot_milliseconds,
  avg_slot AS avg_slot_ms_per_query, round_even(avg_slot / 1000, 3) AS avg_execution_time_seconds,
  round_even(max_slot / avg_slots / 1000, 2) AS max_query_runtime_seconds,
  round_even(min_slot / avg_slots / 1000, 4) AS min_query_runtime_seconds,
  round_even(avg_slot / avg_slots / 1000, 2) AS avg_query_runtime_seconds,
  least(round_even(hours / (days * 24), 2), 24.0::DOUBLE) AS active_hours_per_day, round_even(days, 1) AS query_time_span_days
FROM t"""))  # fmt: skip
def kpis(spark, sf):
    return workload.querylog_kpis(v.query_log(spark, sf))


@query("workload_metrics", log_sql(TOTALS, PEAK, """
SELECT q::BIGINT AS query_count, slot AS total_slot_ms, round_even(hours, 2) AS total_slot_hours, round_even(slot / q, 0) AS avg_slot_ms_per_query,
  bytes AS total_bytes_scanned, round_even(bytes::DOUBLE / 1099511627776, 4) AS total_tb_scanned, round_even(bytes / q, 0) AS avg_bytes_per_query,
  round_even(hours / days, 2) AS estimated_daily_slot_hours, round_even(hours / days * 30, 2) AS estimated_monthly_slot_hours,
  round_even(days, 1) AS query_time_span_days, round_even(slot / q / avg_slots / 1000, 1) AS avg_wall_clock_seconds,
  round_even(least(hours / (days * 24), 24.0::DOUBLE), 1) AS active_hours_per_day,
  round_even(max_slots, 1) AS max_concurrent_slots, round_even(min_slots, 1) AS min_concurrent_slots, round_even(avg_slots, 1) AS avg_concurrent_slots,
  (SELECT peak FROM pk) AS estimated_peak_slots,
  (SELECT round_even(s::DOUBLE, 1) FROM (SELECT slots s, row_number() OVER (ORDER BY slots) - 1 i, count(*) OVER () n FROM rich WHERE slots IS NOT NULL)
   WHERE i = n // 2) AS median_concurrent_slots
FROM t"""))  # fmt: skip
def metrics(spark, sf):
    return workload.workload_metrics(v.query_log(spark, sf))


@query("peak_concurrency", log_sql(PEAK, """
SELECT peak AS peak_slot_utilization, (SELECT round_even(sum(slots)::DOUBLE / count(slots), 1) FROM rich) AS avg_slot_utilization FROM pk"""))  # fmt: skip
def peak(spark, sf):
    return workload.peak_concurrency(v.query_log(spark, sf))


@query("statement_breakdown", log_sql("""
SELECT stmt AS statement_type, count(*) AS job_count, round_even(sum(bytes_scanned)::DOUBLE / 1099511627776, 6) AS tib_processed,
  round_even(sum(elapsed_ms)::DOUBLE / count(*) / 1000, 2) AS avg_duration_sec, round_even(max(elapsed_ms)::DOUBLE / 1000, 2) AS max_duration_sec
FROM rich GROUP BY 1"""))  # fmt: skip
def statements(spark, sf):
    return workload.statement_breakdown(v.query_log(spark, sf))


@query("hourly_slot_usage", log_sql("""
SELECT h.h AS hour, coalesce(query_count, 0) AS query_count, coalesce(a, 0) AS total_slot_seconds,
  coalesce(b, 0) AS avg_slot_seconds_per_query, coalesce(c, 0) AS avg_slots_used
FROM range(24) h(h) LEFT JOIN (
  SELECT hour(execution_time) hh, count(*) query_count, round_even(sum(slot_ms)::DOUBLE / 1000, 1) a,
    round_even(sum(slot_ms)::DOUBLE / 1000 / count(*), 1) b, round_even(sum(slot_ms)::DOUBLE / 3600000, 1) c FROM rich GROUP BY 1) x ON h.h = hh"""))  # fmt: skip
def slots_by_hour(spark, sf):
    return workload.hourly_slot_usage(v.query_log(spark, sf))


@query("user_patterns_by_hour", log_sql("""
SELECT h.h AS hour, coalesce(u, 0) AS distinct_users, coalesce(n, 0) AS total_queries, coalesce(p, 0) AS peak_concurrent_in_hour
FROM range(24) h(h)
LEFT JOIN (SELECT hour(execution_time) hh, count(DISTINCT user_email) u, count(user_email) n FROM rich GROUP BY 1) a ON a.hh = h.h
LEFT JOIN (SELECT hour(m) hh, max(c) p FROM (SELECT date_trunc('minute', execution_time) m, count(*) c FROM rich GROUP BY 1) GROUP BY 1) b
  ON b.hh = h.h"""))  # fmt: skip
def users_by_hour(spark, sf):
    return workload.user_patterns_by_hour(v.query_log(spark, sf))


@query("concurrency_buckets", v.with_views(v.QUERY_LOG, """
SELECT granularity, bucket, count(*) AS query_count FROM (
  SELECT unnest(['minute', 'hour', 'day', 'week']) AS granularity,
    unnest([strftime(execution_time, '%Y-%m-%d %H:%M'), strftime(execution_time, '%Y-%m-%d %H:00'), strftime(execution_time, '%Y-%m-%d'),
            strftime(execution_time, '%Y-W%W')]) AS bucket FROM query_log) GROUP BY 1, 2"""))  # fmt: skip
def buckets(spark, sf):
    return workload.concurrency_buckets(v.query_log(spark, sf))


@query("duration_histogram", log_sql("""
SELECT CAST(round_even(CASE WHEN elapsed_ms > 0 THEN elapsed_ms::DOUBLE WHEN slot_ms > 0 THEN slot_ms::DOUBLE / greatest(1.0::DOUBLE, slot_ms::DOUBLE / 30000)
  ELSE 0 END / 60000, 0) AS BIGINT) AS duration_mins, count(*) AS query_count FROM rich GROUP BY 1"""))  # fmt: skip
def durations(spark, sf):
    return workload.duration_histogram(v.query_log(spark, sf))


@query("repeat_query_rate", v.with_views(v.QUERY_LOG, """,
h AS (SELECT md5(lower(regexp_replace(query_text, '\\s+', ' ', 'g'))) h, count(*) n FROM query_log WHERE query_text IS NOT NULL GROUP BY 1)
SELECT sum(n)::BIGINT AS total_queries, count(*) AS unique_query_count, sum(n) FILTER (n > 1)::BIGINT AS repeated_queries,
  round_even(sum(n) FILTER (n > 1)::DOUBLE / sum(n)::DOUBLE * 100, 1) AS repeat_query_rate FROM h"""))  # fmt: skip
def repeats(spark, sf):
    return workload.repeat_query_rate(v.query_log(spark, sf))


@query("repeat_shape_rate", v.with_views(v.QUERY_LOG, """,
h AS (SELECT lower(trim(regexp_replace(regexp_replace(regexp_replace(query_text, '--[^\\n]*|/\\*.*?\\*/', ' ', 'g'), '\\b[0-9]+\\b', '?', 'g'), '\\s+', ' ', 'g'))) h, count(*) n
  FROM query_log WHERE query_text IS NOT NULL GROUP BY 1)
SELECT sum(n)::BIGINT AS total_queries, count(*) AS unique_query_count, sum(n) FILTER (n > 1)::BIGINT AS repeated_queries,
  round_even(sum(n) FILTER (n > 1)::DOUBLE / sum(n)::DOUBLE * 100, 1) AS repeat_query_rate FROM h"""))  # fmt: skip
def repeated_shapes(spark, sf):
    return workload.repeat_query_rate(v.query_log(spark, sf), shapes=True)


@query("slot_timeline", v.with_views(v.QUERY_LOG, """,
p AS (SELECT date_trunc('minute', execution_time) m, sum(slot_milliseconds)::BIGINT s FROM query_log GROUP BY 1),
o AS (SELECT s, row_number() OVER (ORDER BY s) - 1 i, count(*) OVER () n FROM p)
SELECT round_even(max(s)::DOUBLE / 1000, 1) AS peak_concurrent_slots, round_even(sum(s)::DOUBLE / count(*) / 1000, 1) AS avg_concurrent_slots,
  round_even(max(s) FILTER (i = least(floor(n * 0.5::DOUBLE), n - 1))::DOUBLE / 1000, 1) AS p50_concurrent_slots,
  round_even(max(s) FILTER (i = least(floor(n * 0.9::DOUBLE), n - 1))::DOUBLE / 1000, 1) AS p90_concurrent_slots,
  round_even(max(s) FILTER (i = least(floor(n * 0.95::DOUBLE), n - 1))::DOUBLE / 1000, 1) AS p95_concurrent_slots,
  round_even(max(s) FILTER (i = least(floor(n * 0.99::DOUBLE), n - 1))::DOUBLE / 1000, 1) AS p99_concurrent_slots,
  count(*) AS timeline_periods_count FROM o"""))  # fmt: skip
def timeline(spark, sf):
    log = v.query_log(spark, sf)
    periods = log.select(F.date_trunc("minute", "execution_time").alias("period_start"), F.col("slot_milliseconds").alias("period_slot_ms"))
    return workload.slot_timeline(periods)


@query("nearest_rank_percentiles", v.with_views(v.QUERY_LOG, """,
p AS (SELECT date_trunc('minute', execution_time) m, count(*) s FROM query_log GROUP BY 1),
o AS (SELECT s, row_number() OVER (ORDER BY s) - 1 i, count(*) OVER () n FROM p)
SELECT max(s) FILTER (i = least(floor(n * 0.5::DOUBLE), n - 1)) AS p50, max(s) FILTER (i = least(floor(n * 0.9::DOUBLE), n - 1)) AS p90,
  max(s) FILTER (i = least(floor(n * 0.95::DOUBLE), n - 1)) AS p95, max(s) FILTER (i = least(floor(n * 0.99::DOUBLE), n - 1)) AS p99,
  max(s) AS max, round_even(sum(s)::DOUBLE / count(*), 1) AS avg, count(*) AS minutes FROM o"""))  # fmt: skip
def minute_ranks(spark, sf):
    return workload.minute_percentiles(v.query_log(spark, sf))


@query("price_percentiles", """
WITH o AS (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) s, row_number() OVER (ORDER BY l_extendedprice) - 1 i, count(*) OVER () n FROM lineitem)
SELECT max(s) FILTER (i = least(floor(n * 0.5::DOUBLE), n - 1)) AS p50, max(s) FILTER (i = least(floor(n * 0.9::DOUBLE), n - 1)) AS p90,
  max(s) FILTER (i = least(floor(n * 0.95::DOUBLE), n - 1)) AS p95, max(s) FILTER (i = least(floor(n * 0.99::DOUBLE), n - 1)) AS p99 FROM o""")  # fmt: skip
def price_ranks(spark, sf):
    cents = F.round(F.col("l_extendedprice") * 100)
    return ranks.nearest_rank(v.table(spark, sf, "lineitem"), cents, workload.PERCENTILES)


@query("user_insights", log_sql("""
SELECT coalesce(user_email, 'Unknown') AS user_email, count(*) AS query_count, sum(bytes_scanned)::BIGINT AS total_bytes_scanned,
  sum(slot_ms)::BIGINT AS total_slot_milliseconds, round(count(*) FILTER (cache_hit)::DOUBLE / count(*) * 100, 1) AS cache_hit_rate
FROM rich GROUP BY 1"""))  # fmt: skip
def users(spark, sf):
    return workload.user_insights(v.query_log(spark, sf))


_REPORT_WRITE = r"regexp_matches(trim(query_text), '(?i)^\s*(INSERT|UPDATE|DELETE|MERGE|CREATE|DROP|ALTER|TRUNCATE|CALL)\b')"


@query("report_summary", log_sql(f"""
SELECT count(*) AS total_queries, count(*) FILTER (NOT {_REPORT_WRITE}) AS read_queries, count(*) FILTER ({_REPORT_WRITE}) AS write_queries,
  round(count(*) FILTER (NOT {_REPORT_WRITE})::DOUBLE / count(*) * 100, 1) AS read_pct,
  round(count(*) FILTER ({_REPORT_WRITE})::DOUBLE / count(*) * 100, 1) AS write_pct,
  sum(slot_ms)::BIGINT AS total_slot_ms, round(sum(slot_ms)::DOUBLE / count(*), 2) AS avg_slot_ms, max(slot_ms) AS max_slot_ms,
  sum(bytes_scanned)::BIGINT AS total_bytes, round(count(*) FILTER (cache_hit)::DOUBLE / count(*) * 100, 1) AS cache_ratio,
  count(DISTINCT coalesce(user_email, 'Unknown')) AS unique_users,
  (SELECT max(n) FROM (SELECT count(*) n FROM rich GROUP BY date_trunc('hour', execution_time))) AS peak_concurrent FROM rich"""))  # fmt: skip
def printed(spark, sf):
    return workload.report_summary(v.query_log(spark, sf))


_TEXT_WRITE = r"regexp_matches(lower(coalesce(query_text, '')), '^\s*(insert|update|delete|merge|create|drop|alter|truncate)')"


@query("classify_read_write", log_sql(f"""
SELECT job_id, CASE WHEN is_write THEN 'WRITE' ELSE 'READ' END AS statement_class,
  CASE WHEN is_write OR (stmt = 'UNKNOWN' AND {_TEXT_WRITE}) THEN 'WRITE' ELSE 'READ' END AS statement_class_by_text FROM rich"""))  # fmt: skip
def read_write(spark, sf):
    return workload.classify_read_write(v.query_log(spark, sf))


_BI = """c AS (SELECT *, regexp_replace(lower(coalesce(query_text, '')), '\\s+', '', 'g') fp,
  regexp_matches(lower(coalesce(query_text, '')), 'dashboard|report|scheduled|looker|tableau|metabase|datastudio|superset|grafana|powerbi')
  OR regexp_matches(lower(coalesce(user_email, '')), 'service|bot|scheduler|airflow|looker') AS bi FROM rich),
f AS (SELECT *, bi OR count(*) OVER (PARTITION BY fp) >= 10 AS is_bi FROM c)"""


@query("classify_bi_adhoc", log_sql(_BI, """
SELECT job_id, CASE WHEN is_bi THEN 'BI' ELSE 'AD_HOC' END AS query_class FROM f"""))  # fmt: skip
def bi_adhoc(spark, sf):
    return workload.classify_bi_adhoc(v.query_log(spark, sf))


@query("classification_summary", log_sql(_BI, f""",
g AS (SELECT *, is_write OR (stmt = 'UNKNOWN' AND {_TEXT_WRITE}) AS wr,
  CASE WHEN stmt <> 'UNKNOWN' THEN stmt = 'SELECT' ELSE NOT {_TEXT_WRITE} AND trim(coalesce(query_text, '')) <> '' END AS sel FROM f),
t AS (SELECT count(*) n, count(*) FILTER (is_bi) b, count(*) FILTER (wr) w, count(*) FILTER (sel) s, count(*) FILTER (sel AND cache_hit) h FROM g)
SELECT n AS total_queries, b AS bi_count, w AS write_count, s AS select_queries, h AS cache_hits, n - b AS adhoc_count, n - w AS read_count,
  round(CAST(b::DOUBLE / n * 100 AS DECIMAL(30,15)), 1)::DOUBLE AS bi_pct, round(CAST((n - b)::DOUBLE / n * 100 AS DECIMAL(30,15)), 1)::DOUBLE AS adhoc_pct,
  round(CAST((n - w)::DOUBLE / n * 100 AS DECIMAL(30,15)), 1)::DOUBLE AS read_pct, round(CAST(w::DOUBLE / n * 100 AS DECIMAL(30,15)), 1)::DOUBLE AS write_pct,
  round(CAST(h::DOUBLE / s * 100 AS DECIMAL(30,15)), 1)::DOUBLE AS cache_hit_ratio FROM t"""))  # fmt: skip
def class_summary(spark, sf):
    return workload.classification_summary(v.query_log(spark, sf))


@query("billing_rollup", log_sql("""
SELECT user_email, count(*) AS total_queries, b::BIGINT AS bytes_for_billing, days AS query_time_span_days,
  round(b / days * 30 / 1099511627776.0::DOUBLE, 6) AS monthly_tb, CAST(round_even(n / greatest(days, 1.0::DOUBLE) * 30, 0) AS BIGINT) AS monthly_queries
FROM (SELECT user_email, count(*)::DOUBLE n, CASE WHEN sum(billed) > 0 THEN sum(billed) ELSE sum(bytes_scanned) END::DOUBLE b,
    CASE WHEN count(*) >= 2 THEN round_even(greatest((epoch_us(max(execution_time)) - epoch_us(min(execution_time)))::DOUBLE / 1e6::DOUBLE / 86400, 1.0::DOUBLE), 1)
         ELSE 30.0 END AS days FROM rich GROUP BY 1) x JOIN rich USING (user_email) GROUP BY ALL
UNION ALL
SELECT NULL, n::BIGINT, b::BIGINT, days, round(b / days * 30 / 1099511627776.0::DOUBLE, 6), CAST(round_even(n / greatest(days, 1.0::DOUBLE) * 30, 0) AS BIGINT)
FROM (SELECT count(*)::DOUBLE n, CASE WHEN sum(billed) > 0 THEN sum(billed) ELSE sum(bytes_scanned) END::DOUBLE b,
    round_even(greatest((epoch_us(max(execution_time)) - epoch_us(min(execution_time)))::DOUBLE / 1e6::DOUBLE / 86400, 1.0::DOUBLE), 1) AS days
  FROM rich WHERE user_email IS NULL)"""))  # fmt: skip
def billing(spark, sf):
    return workload.billing_rollup(v.query_log(spark, sf), by=["user_email"])


@query("scan_query_log", v.with_views(v.QUERY_LOG, """
SELECT job_id, strftime(execution_time, '%Y-%m-%d %H:%M:%S') AS execution_time,
  query_text, bytes_scanned
FROM query_log WHERE execution_time >= TIMESTAMP '2024-01-01 00:00:00'
  AND CAST(substr(job_id, 5) AS BIGINT) % 19 <> 0 AND CAST(substr(job_id, 5) AS BIGINT) % 23 <> 0"""))  # fmt: skip
def scan_log(spark, sf):
    jobs = v.query_log(spark, sf).selectExpr(
        "*",
        "if(cast(substr(job_id, 5) as bigint) % 19 = 0, 'LOAD', 'QUERY') as job_type",
        "if(cast(substr(job_id, 5) as bigint) % 23 = 0, 'RUNNING', 'DONE') as state",
    )
    kept = workload.scan_query_log(jobs, v.now_literal())
    return kept.select("job_id", F.date_format("execution_time", "yyyy-MM-dd HH:mm:ss").alias("execution_time"), "query_text", "bytes_scanned")


@query("timeframe_filter", v.with_views(v.QUERY_LOG, """
SELECT 'all' AS timeframe, count(*) AS queries FROM query_log
UNION ALL SELECT '24h', count(*) FROM query_log WHERE execution_time >= TIMESTAMP '2024-01-30 00:00:00'
UNION ALL SELECT '7d', count(*) FROM query_log WHERE execution_time >= TIMESTAMP '2024-01-24 00:00:00'
UNION ALL SELECT '30d', count(*) FROM query_log WHERE execution_time >= TIMESTAMP '2024-01-01 00:00:00'"""))  # fmt: skip
def frames(spark, sf):
    log = v.query_log(spark, sf)
    parts = [
        workload.timeframe_filter(log, v.now_literal(), t).agg(F.lit(t).alias("timeframe"), F.count(F.lit(1)).alias("queries"))
        for t in ("all", "24h", "7d", "30d")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("search_filter", v.with_views(v.QUERY_LOG, """
SELECT job_id, bytes_scanned FROM query_log WHERE query_text ILIKE '%USER1%' OR user_email ILIKE '%USER1%' OR job_id ILIKE '%USER1%'"""))  # fmt: skip
def search(spark, sf):
    return workload.search_filter(v.query_log(spark, sf), "USER1").select("job_id", "bytes_scanned")


@query("query_page", v.with_views(v.QUERY_LOG, """
SELECT job_id, bytes_scanned, slot_milliseconds FROM query_log ORDER BY bytes_scanned DESC NULLS LAST, job_id OFFSET 50 LIMIT 50"""))  # fmt: skip
def page(spark, sf):
    return workload.query_page(v.query_log(spark, sf), "bytes_scanned", page=2).select("job_id", "bytes_scanned", "slot_milliseconds")


@query("page_totals", v.with_views(v.QUERY_LOG, """
SELECT count(*) AS total_filtered, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages FROM query_log"""))
def page_count(spark, sf):
    return workload.page_totals(v.query_log(spark, sf))


@query("query_page_view", log_sql(TOTALS, """,
p AS (SELECT * FROM rich ORDER BY slot_milliseconds DESC NULLS LAST, job_id LIMIT 50),
x AS (SELECT *, slot_ms::DOUBLE s, (SELECT greatest(avg_slots, 1.0::DOUBLE) FROM t) a FROM p)
SELECT job_id, coalesce(query_text, '') AS query_text, bytes_scanned, billed AS bytes_billed, slot_ms AS slot_milliseconds,
  round(CAST(CASE WHEN elapsed_ms > 0 THEN greatest(1.0::DOUBLE, s / elapsed_ms) ELSE s / 30000 END AS DECIMAL(30,12)), 1)::DOUBLE AS slot_utilization,
  round(CAST(CASE WHEN elapsed_ms > 0 THEN s / greatest(s / elapsed_ms, 1.0::DOUBLE) ELSE s / a END / 1000 AS DECIMAL(30,12)), 2)::DOUBLE AS est_runtime_seconds,
  CASE WHEN cache_hit THEN 'Hit' ELSE 'Miss' END AS cache_hit_status, statement_type, array_to_string(referenced_tables, ', ') AS referenced_tables,
  coalesce(user_email, 'Unknown') AS user_email FROM x"""))  # fmt: skip
def page_shown(spark, sf):
    log = v.query_log(spark, sf)
    shown = workload.page_view(workload.query_page(log, "slot_milliseconds"), log).drop("execution_time")
    return shown.withColumn("referenced_tables", F.array_join("referenced_tables", ", "))


@query("heaviest_queries", v.with_views(v.QUERY_LOG, """
SELECT job_id, bytes_scanned, slot_milliseconds FROM query_log ORDER BY slot_milliseconds DESC NULLS LAST, job_id LIMIT 10"""))  # fmt: skip
def heaviest(spark, sf):
    return workload.heaviest_queries(v.query_log(spark, sf)).select("job_id", "bytes_scanned", "slot_milliseconds")


@query("peak_bucket", v.with_views(v.QUERY_LOG, """,
h AS (SELECT hour(execution_time) k, count(*) n FROM query_log GROUP BY 1 ORDER BY n DESC, k LIMIT 1),
d AS (SELECT (dayofweek(execution_time) + 6) % 7 k, dayname(min(execution_time)) nm, count(*) n FROM query_log GROUP BY 1 ORDER BY n DESC, k LIMIT 1)
SELECT h.k AS peak_hour, h.n AS peak_hour_queries, d.nm AS peak_day_of_week, d.n AS peak_day_queries FROM h, d"""))  # fmt: skip
def busiest(spark, sf):
    return workload.peak_bucket(v.query_log(spark, sf))


@query("join_etl_metrics", v.with_views(v.QUERY_LOG, """,
x AS (SELECT upper(coalesce(query_text, '')) t, bytes_scanned, len(regexp_extract_all(upper(coalesce(query_text, '')), '\\bJOIN\\b')) j FROM query_log),
y AS (SELECT *, regexp_matches(t, 'CREATE TABLE|INSERT INTO|MERGE|CTAS|CREATE OR REPLACE') e FROM x)
SELECT count(*) AS total_queries, round_even(sum(j)::DOUBLE / count(*), 1) AS avg_joins, count(*) FILTER (j > 0) AS queries_with_joins,
  count(*) FILTER (bytes_scanned > 1000000000) AS scan_heavy, count(*) FILTER (e) AS etl_count,
  round_even(count(*) FILTER (e)::DOUBLE / count(*) * 100, 1) AS etl_pct FROM y"""))  # fmt: skip
def join_etl(spark, sf):
    return workload.join_etl_metrics(v.query_log(spark, sf))


@query("statement_type_guess", v.with_views(v.QUERY_LOG, """
SELECT job_id, CASE WHEN query_text IS NULL THEN 'UNKNOWN' WHEN t LIKE 'SELECT%' THEN 'SELECT' WHEN t LIKE 'INSERT%' THEN 'INSERT' WHEN t LIKE 'UPDATE%' THEN 'UPDATE'
  WHEN t LIKE 'DELETE%' THEN 'DELETE' WHEN t LIKE 'MERGE%' THEN 'MERGE'
  WHEN t LIKE 'CREATE%' THEN CASE WHEN upper(query_text) LIKE '%AS SELECT%' THEN 'CREATE_TABLE_AS_SELECT' ELSE 'CREATE_TABLE' END
  ELSE 'UNKNOWN' END AS guess FROM (SELECT *, upper(ltrim(query_text)) t FROM query_log)"""))  # fmt: skip
def guesses(spark, sf):
    return v.query_log(spark, sf).select("job_id", sqltext.statement_type_guess(F.col("query_text")).alias("guess"))
