"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallyframe", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume.

    On a cluster leave ``master`` and ``partitions`` unset: the submit
    configuration decides, and AQE coalesces what is too many.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Where that is unset, a plain local master gets a temporary folder per
    application, because there the driver's disk is also the executors' disk.
    Any other master must name the folder; no setting is changed here.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tallyframe.work.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[\d*, ]+\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="tallyframe-")
    return _LOCAL_FOLDERS[context.applicationId]


def work_folder(spark: SparkSession) -> str:
    """The folder of this application below the shared one."""
    return f"{shared_folder(spark)}/work/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder of this application; nothing is created yet."""
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> None:
    """Delete what this application has written to its folder.

    To be called at its end: frames that rest on written stages, and tables kept
    there, cannot be read afterwards.
    """
    remove_folder(spark, work_folder(spark))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that is in it; one that is not there is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so a lost executor costs a read and no recomputation."""
    spark = df.sparkSession
    path = work_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
