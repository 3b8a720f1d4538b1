"""Named queries of the text operators with the SQL that states the same result."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable

import tallyframe
from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL when there is one."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


#: Rows that go to a Python worker at once. Texts are longer than the rows that the usual 10,000 are meant for.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, and keep their batches small."""
    if spark.conf.get(_BATCH) == "10000":  # unless somebody has chosen otherwise
        spark.conf.set(_BATCH, "2000")
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        top = os.path.dirname(os.path.abspath(tallyframe.__file__))
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tallyframe-code-')}/tallyframe_code", "zip", os.path.dirname(top), os.path.basename(top))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path only Spark needs to understand."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
