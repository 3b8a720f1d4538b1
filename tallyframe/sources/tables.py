"""Reading whole tables from files and databases, and listing what there is."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.sources.files import file_listing

# JDBC address per database kind.
JDBC_URLS = {
    "redshift": "jdbc:redshift://{host}:{port}/{database}",
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database}",
    "oracle": "jdbc:oracle:thin:@//{host}:{port}/{database}",
    "db2": "jdbc:db2://{host}:{port}/{database}",
    "sybase": "jdbc:jtds:sybase://{host}:{port}/{database}",
    "clickhouse": "jdbc:clickhouse://{host}:{port}/{database}",
}
# Databases read by a connector of their own instead of JDBC.
CONNECTORS = {"bigquery": "bigquery", "mongodb": "mongodb", "documentdb": "mongodb"}
FILE_FORMATS = ("parquet", "orc", "json", "csv", "avro")


def read_options(kind: str, connection: Mapping[str, object], table: str, split: Mapping[str, object] | None = None) -> tuple[str, dict[str, str]]:
    """Format and options for one table.

    ``split`` names ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions``; without it a database table is read by a single task.
    """
    kind = kind.lower()
    if kind in FILE_FORMATS:
        return kind, {"path": f"{str(connection['path']).rstrip('/')}/{table}"}
    if kind == "bigquery":
        return "bigquery", {"table": table, "parentProject": str(connection["project"])}
    if kind in CONNECTORS:
        return CONNECTORS[kind], {"connection.uri": str(connection["uri"]), "database": str(connection["database"]), "collection": table}
    if kind not in JDBC_URLS:
        raise ValueError(f"unknown database kind {kind}")
    options = {"url": JDBC_URLS[kind].format(**connection), "dbtable": table, "fetchsize": str(connection.get("fetchsize", 10_000))}
    options.update({k: str(connection[k]) for k in ("user", "password", "driver") if k in connection})
    options.update({k: str(v) for k, v in (split or {}).items()})
    return "jdbc", options


def tiles_query(table: str, column: str, parts: int) -> str:
    """A subquery by which the database tells the upper ends of ``parts`` ranges that hold equally many rows."""
    tiles = f"SELECT {column} AS k, ntile({parts}) OVER (ORDER BY {column}) AS tile FROM {table} WHERE {column} IS NOT NULL"
    return f"(SELECT max(k) AS high FROM ({tiles}) tiles GROUP BY tile) bounds"


def split_bounds(spark: SparkSession, kind: str, connection: Mapping[str, object], table: str, column: str, parts: int = 64) -> list[object]:
    """The upper ends of ranges of a column with equally many rows each, ``parts`` values at most; none for an empty table."""
    source, options = read_options(kind, connection, tiles_query(table, column, parts))
    return [row["high"] for row in spark.read.format(source).options(**options).load().toDF("high").collect()]


def _sql_value(value: object) -> str:
    """A value as SQL that databases agree on."""
    if isinstance(value, bool):
        raise ValueError("a yes or no does not split a table")
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    return "'" + str(value).replace("'", "''") + "'"


def range_predicates(column: str, bounds: Sequence[object]) -> list[str]:
    """Conditions by which a table is read in parts: one for each range between the bounds, one beyond the last, one for NULL.

    Every row meets exactly one. Equal bounds, as a value makes that fills several
    ranges, are one range. Without bounds there is no condition.
    """
    ends = sorted(set(bounds))
    if not ends:
        return []
    shown = [_sql_value(e) for e in ends]
    between = [f"{column} > {a} AND {column} <= {b}" for a, b in zip(shown, shown[1:], strict=False)]
    return [f"{column} <= {shown[0]}", *between, f"{column} > {shown[-1]}", f"{column} IS NULL"]


def split_of(column: str, low: object, high: object, parts: int) -> dict[str, object]:
    """Reader options of a split into equally wide ranges between two extremes; none where there are no rows."""
    if low is None or high is None:
        return {}
    return {"partitionColumn": column, "lowerBound": low, "upperBound": high, "numPartitions": parts}


def scan_table(
    spark: SparkSession,
    kind: str,
    connection: Mapping[str, object],
    table: str,
    order_by: str | None = None,
    split: Mapping[str, object] | None = None,
    split_by: str | None = None,
) -> DataFrame:
    """A whole table with lower-case column names, sorted by one column when asked.

    Database tables are read in ranges of ``split_by`` that hold equally many rows each,
    whose bounds the database is asked for, so a skewed key does not fill one task; or by
    a ``split`` given in full.
    """
    source, options = read_options(kind, connection, table, split)
    predicates: list[str] = []
    if split is None and split_by is not None and kind.lower() in JDBC_URLS:
        predicates = range_predicates(split_by, split_bounds(spark, kind, connection, table, split_by))
    if predicates:
        url, name = options.pop("url"), options.pop("dbtable")
        df = spark.read.jdbc(url, name, predicates=predicates, properties=options)
    else:
        df = spark.read.format(source).options(**options).load()
    df = df.toDF(*[c.lower() for c in df.columns])
    return df.orderBy(order_by.lower()) if order_by else df


def list_session_tables(spark: SparkSession) -> DataFrame:
    """Tables and views of the session's catalog; metadata only."""
    rows = [(".".join(t.namespace or []), t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "namespace string, table_name string, table_type string, is_temporary boolean")


def list_path_tables(spark: SparkSession, root: str) -> DataFrame:
    """Tables below a folder: the first path part names the table, with its files and bytes."""
    files = file_listing(spark, root)
    relative = F.regexp_replace(F.col("path"), r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    name = F.regexp_replace(F.split(relative, "/")[0], r"\.[a-z.]+$", "")
    return files.groupBy(name.alias("table_name")).agg(F.count(F.lit(1)).alias("file_count"), F.sum("length").alias("size_bytes"))
