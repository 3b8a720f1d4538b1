"""Check results put together: one table pair, a run of many tables."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.types import scan_columns
from tallyframe.operators import parity, records
from tallyframe.operators.schema import schema_diff

RESULT_COLUMNS = ("check_name", "status", "source_value", "target_value", "difference")


_ROW = "check_name string, status string, source_value double, target_value double, difference double"


def _entry(name: str, source: Column, target: Column, passed: Column, absolute: bool = False) -> Column:
    """One check in the common shape."""
    source, target = source.cast("double"), target.cast("double")
    difference = F.abs(source - target) if absolute else source - target
    return F.struct(
        F.lit(name).alias("check_name"),
        F.when(passed, "passed").otherwise("failed").alias("status"),
        source.alias("source_value"),
        target.alias("target_value"),
        difference.alias("difference"),
    )


def failed_check(df: DataFrame, name: str) -> DataFrame:
    """The row of a check that could not run."""
    return df.sparkSession.createDataFrame([(name, "error", None, None, None)], _ROW)


def _scalar_checks(source: DataFrame, target: DataFrame, wanted: Mapping[str, str | None]) -> DataFrame:
    """Counts, nulls, sums and averages together: one scan per side."""
    measures: dict[str, Callable[[DataFrame], Column]] = {}
    for name, column in wanted.items():
        if name == "row_count":
            measures[name] = lambda df: F.count(F.lit(1))
        elif name == "null_check":
            measures[name] = lambda df, c=column: F.count_if(F.col(c).isNull())
        else:
            kind = "SUM" if name == "sum_check" else "AVERAGE"
            measures[name] = lambda df, c=column, k=kind: parity.aggregate_value(df, c, k)
            measures[f"{name}_odd"] = lambda df, c=column: parity.not_finite_value(df, c)
    row = parity.both_sides(source, target, lambda df: {n: m(df) for n, m in measures.items()})
    entries = []
    for name in wanted:
        s, t = F.col(f"source_{name}"), F.col(f"target_{name}")
        inexact = name in ("sum_check", "average_check")
        same_odd = F.col(f"source_{name}_odd") == F.col(f"target_{name}_odd") if inexact else None
        passed = (F.abs(s - t) <= parity.TOLERANCE) & same_odd if inexact else s == t
        entries.append(_entry(name, s, t, passed, absolute=name == "row_count"))
    return row.select(F.inline(F.array(*entries)))


def _key_checks(source: DataFrame, target: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Record match and duplicates over the same keys: one grouping of both sides."""
    counts = records.record_match_pk(source, target, keys)
    entries = []
    for name in names:
        if name == "record_match":
            s, t = F.col("total_compared"), F.col("matched_count")
            entries.append(_entry(name, s, t, F.col("status") == "passed"))
        else:
            s, t = F.col("source_duplicate_keys"), F.col("target_duplicate_keys")
            entries.append(_entry(name, s, t, s == t))
    return counts.select(F.inline(F.array(*entries)))


def _schema_check(source: DataFrame, target: DataFrame) -> DataFrame:
    """Column names and type families; schemas are metadata, so no table is read."""
    found = schema_diff(scan_columns(source), scan_columns(target)).filter("discrepancy <> 'nullability_mismatch'")
    s, t = F.lit(len(source.columns)), F.lit(len(target.columns))
    return found.agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(_entry("schema_check", s, t, F.col("n") == 0))))


def _range_check(source: DataFrame, target: DataFrame, key: str, start: int, end: int) -> DataFrame:
    counts = records.record_match_range(source, target, [key], start, end)
    s, t = F.col("total_compared"), F.col("matched_count")
    return counts.select(F.inline(F.array(_entry("specific_row_check", s, t, F.col("status") == "passed"))))


Part = tuple[tuple[str, ...], Callable[[tuple[str, ...]], DataFrame]]


def plan_checks(source: DataFrame, target: DataFrame, checks: Mapping[str, object]) -> list[Part]:
    """The requested checks in parts that share a scan or a grouping: their names, and what computes some of them.

    ``checks`` keys: row_count and schema_check (True), null_check, sum_check and
    average_check (a column), duplicate_check and record_match (keys), and
    specific_row_check (key, start, end).
    """
    held = {c.lower() for c in source.columns} & {c.lower() for c in target.columns}

    def numeric(column: str) -> bool:
        return all(isinstance(parity.column_type(df, column), T.NumericType) for df in (source, target))

    scalars: dict[str, str | None] = {}
    by_keys: dict[tuple[str, ...], list[str]] = {}
    parts: list[Part] = []
    for name, argument in checks.items():
        if not argument:
            continue
        if name == "row_count":
            scalars[name] = None
        elif name == "schema_check":
            parts.append(((name,), lambda _: _schema_check(source, target)))
        elif name in ("null_check", "sum_check", "average_check") and str(argument).lower() in held and (name == "null_check" or numeric(str(argument))):
            scalars[name] = str(argument)
        elif name in ("duplicate_check", "record_match"):
            keys = (argument,) if isinstance(argument, str) else tuple(argument)
            if all(k.lower() in held for k in keys):
                by_keys.setdefault(keys, []).append(name)
            else:
                parts.append(((name,), lambda names: failed_check(source, names[0])))
        elif name == "specific_row_check":
            parts.append(((name,), lambda _, given=argument: _range_check(source, target, *given)))
        else:
            parts.append(((name,), lambda names: failed_check(source, names[0])))
    if scalars:
        parts.append((tuple(scalars), lambda names: _scalar_checks(source, target, {n: scalars[n] for n in names})))
    parts += [(tuple(names), lambda some, keys=keys: _key_checks(source, target, some, keys)) for keys, names in by_keys.items()]
    return parts


#: Seconds after which a check is given up (fixed value).
TIME_LIMIT = 300


@contextmanager
def deadline(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """Ends the Spark jobs that this thread starts within the block once they have run for so long; the block raises then.

    Its jobs bear a tag of their own, by which they and those that follow are cancelled, so
    their tasks end and no other work does. Time in which they only wait for cores that other work
    holds does not count, so one slow check does not make errors of those behind it.
    """
    if seconds is None:
        yield
        return
    context, tag = spark.sparkContext, f"check-{uuid.uuid4().hex}"
    over, done = threading.Event(), threading.Event()

    def watch() -> None:
        ran, last = 0.0, time.monotonic()
        while not done.wait(0.2):  # jobs may follow one another, so it goes on
            now = time.monotonic()
            ran, last = ran + (0 if _waits(spark, tag) else now - last), now
            if ran >= seconds:
                over.set()
                context.cancelJobsWithTag(tag)

    watcher = InheritableThread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        yield
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)
    if over.is_set():
        raise TimeoutError(f"no result within {seconds} seconds")


def _waits(spark: SparkSession, tag: str) -> bool:
    """Whether jobs with this tag are under way, but none of their tasks."""
    status = spark.sparkContext.statusTracker()
    stages = [n for job in spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(tag) if (found := status.getJobInfo(job)) and found.status == "RUNNING" for n in found.stageIds]
    return bool(stages) and not any((info := status.getStageInfo(n)) and info.numActiveTasks for n in stages)


def run_checks(source: DataFrame, target: DataFrame, checks: Mapping[str, object], threads: int = 4, time_limit: float | None = TIME_LIMIT) -> list[tuple]:
    """The rows of all requested checks, a handful, computed at the same time.

    A check that cannot be planned, fails while it runs, or runs longer than
    ``time_limit`` seconds (:func:`deadline`) is one row saying error; its tasks are ended.
    Checks that failed together are run again one by one, so that only those at
    fault are errors.
    """

    def settle(part: Part) -> list[tuple]:
        names, build = part
        try:
            with deadline(source.sparkSession, time_limit):
                return [tuple(r) for r in build(names).collect()]
        except Exception:  # noqa: BLE001 - the error is the result
            if len(names) == 1:
                return [(names[0], "error", None, None, None)]
            return [row for name in names for row in settle(((name,), build))]

    with ThreadPoolExecutor(threads) as pool:
        return [row for rows in pool.map(settle, plan_checks(source, target, checks)) for row in rows]


def validation_report(source: DataFrame, target: DataFrame, checks: Mapping[str, object], time_limit: float | None = TIME_LIMIT) -> DataFrame:
    """All checks of one pair with the overall status on every row.

    error outranks failed, failed outranks passed; a report without checks is one
    row saying ``no_checks``.
    """
    rows = run_checks(source, target, checks, time_limit=time_limit)
    if not rows:
        return failed_check(source, "none").withColumn("status", F.lit("no_checks")).withColumn("overall_status", F.lit("no_checks"))
    found = {status for _, status, *_ in rows}
    overall = next(s for s in ("error", "failed", "passed") if s in found)
    return source.sparkSession.createDataFrame(rows, _ROW).select(F.lit(overall).alias("overall_status"), *RESULT_COLUMNS)


def table_status(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Status per table over its checks that were not skipped: error, failed or completed."""
    return results.groupBy(*by).agg(
        F.when(F.count_if(F.col("status") == "error") > 0, "error")
        .when(F.count_if(F.col("status") == "failed") > 0, "failed")
        .otherwise("completed")
        .alias("table_status"),
        F.count_if(F.col("status") != "skipped").alias("checks_run"),
        F.count_if(F.col("status") == "failed").alias("checks_failed"),
    )


def run_status(tables: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counters and overall status of a run."""

    def number(status: str):
        return F.count_if(F.col("table_status") == status)

    return tables.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tables_total"),
        number("completed").alias("tables_passed"),
        number("failed").alias("tables_failed"),
        number("error").alias("tables_error"),
        F.when(number("error") > 0, "error").when(number("failed") > 0, "failed").otherwise("completed").alias("run_status"),
    )


def validation_run(
    spark: SparkSession,
    pairs: Mapping[str, Callable[[], tuple[DataFrame, DataFrame, Mapping[str, object]]]],
    threads: int = 4,
    time_limit: float | None = TIME_LIMIT,
) -> DataFrame:
    """Check many table pairs at the same time; one row per table.

    Each pair is a function that opens it. A table that cannot be read or checked is
    an error and stops no other; nor does a check that takes too long. Only the check rows, a handful per table, come back.
    """

    def one(name: str) -> list[tuple[str, str, str]]:
        try:
            source, target, checks = pairs[name]()
            found = [(name, check, status) for check, status, *_ in run_checks(source, target, checks, time_limit=time_limit)]
        except Exception:  # noqa: BLE001 - the error is the result
            found = [(name, "read", "error")]
        return found or [(name, "none", "skipped")]

    with ThreadPoolExecutor(threads) as pool:
        results = [row for rows in pool.map(one, sorted(pairs)) for row in rows]
    return table_status(spark.createDataFrame(results, "table_name string, check_name string, status string"), ["table_name"])
