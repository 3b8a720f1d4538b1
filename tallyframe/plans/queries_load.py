"""Registered queries: reading, writing and streaming. Files go below the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import types
from tallyframe.operators import layout, load, parity, ranks, schema, units
from tallyframe.plans import views as v
from tallyframe.plans.registry import query
from tallyframe.session import work_path
from tallyframe.sources import csv, files, tables
from tallyframe.streaming import files as file_stream
from tallyframe.streaming import tables as table_stream


F_STRING = T.StringType()


def _name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex[:12]}"


def _chunks(spark, sf, path, parts=4):
    """Orders in one folder per chunk, as an exporter would leave them."""
    rows = v.table(spark, sf, "orders").withColumn("chunk", F.col("o_orderkey") % parts)
    rows.repartition("chunk").write.partitionBy("chunk").parquet(path)
    return path


@query("scan_table", "SELECT lower(r_name) AS r_name, n_nationkey, n_name, c_custkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")
def scan(spark, sf):
    region, nation, customer = (tables.scan_table(spark, "parquet", {"path": sf}, f"{t}.parquet") for t in ("region", "nation", "customer"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.lower("r_name").alias("r_name"), "n_nationkey", "n_name", "c_custkey")


@query("list_data_files", "SELECT o_orderkey % 4 AS chunk, count(*) AS rows FROM orders GROUP BY 1")
def data_files(spark, sf):
    path = _chunks(spark, sf, work_path(spark, "files"))
    listed = files.list_data_files(files.file_listing(spark, path), "PARQUET")
    rows = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("path"), "chunk").agg(F.count(F.lit(1)).alias("n"))
    found = rows.join(listed, "path").groupBy("chunk").agg(F.sum("n").alias("rows"))
    return found.select(F.col("chunk").cast("bigint").alias("chunk"), "rows")


@query("build_manifest", "SELECT 'chunk=' || (o_orderkey % 4) AS table_name, true AS mandatory, count(*) > 0 AS has_bytes FROM orders GROUP BY 1")
def manifest(spark, sf):
    path = _chunks(spark, sf, work_path(spark, "manifest"))
    listed = files.list_data_files(files.file_listing(spark, path), "PARQUET")
    rows = files.build_manifest(listed, F.regexp_extract("path", r"/(chunk=\d+)/", 1))
    return rows.groupBy("table_name").agg(F.every("mandatory").alias("mandatory"), (F.sum("content_length") > 0).alias("has_bytes"))


@query("source_size", "SELECT count(DISTINCT o_orderkey % 4) AS folders, true AS sizes_agree FROM orders")
def size(spark, sf):
    path = _chunks(spark, sf, work_path(spark, "size"))
    listed = files.file_listing(spark, path)
    data = files.list_data_files(listed, "PARQUET")
    total = files.source_size(data)
    parts = data.groupBy(F.regexp_extract("path", r"/(chunk=\d+)/", 1).alias("c")).agg(F.sum("length").alias("b"))
    sums = parts.agg(F.count(F.lit(1)).alias("folders"), F.sum("b").alias("b"))
    return ranks.one_row([sums, total]).select("folders", (F.col("b") == F.col("total_bytes")).alias("sizes_agree"))


@query("export_table", """
SELECT f.f AS file_format, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total
FROM orders, (VALUES ('CSV'), ('JSON'), ('PARQUET')) f(f) GROUP BY 1""")  # fmt: skip
def export(spark, sf):
    base, orders = work_path(spark, "export"), v.table(spark, sf, "orders")
    frames = []
    for file_format, codec in (("CSV", "GZIP"), ("JSON", "DEFLATE"), ("PARQUET", "ZSTD")):
        path = files.export_table(orders, base, file_format.lower(), "orders", file_format, codec)
        reader = spark.read.schema(orders.schema)
        back = reader.csv(path, header=True) if file_format == "CSV" else reader.format(file_format.lower()).load(path)
        total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
        frames.append(
            back.agg(F.lit(file_format).alias("file_format"), F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"), total.alias("total"))
        )
    return schema.union_all(frames)


@query("export_tables", """
SELECT 'customer' AS table_name, true AS success, count(*) AS rows FROM customer UNION ALL SELECT 'missing', false, 0
UNION ALL SELECT 'orders', true, count(*) FROM orders WHERE o_orderdate > TIMESTAMP '1999-01-01' """)  # fmt: skip
def export_many(spark, sf):
    base = work_path(spark, "exports")
    sources = {t: (lambda t=t: v.table(spark, sf, t)) for t in ("orders", "customer", "missing")}
    settings = {"orders": {"timestamp_column": "o_orderdate", "bookmark": "1999-01-01", "codec": "SNAPPY"}}
    results = files.export_tables(spark, sources, base, "ds", settings, file_format="PARQUET")
    counts = schema.union_all(
        [spark.read.parquet(r["path"]).agg(F.lit(r["table_name"]).alias("table_name"), F.count(F.lit(1)).alias("rows")) for r in results.filter("success").collect()]
    )
    return results.join(counts, "table_name", "left").select("table_name", "success", F.coalesce("rows", F.lit(0)).alias("rows"))


_CSV_SQL = """rows_ AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus END AS st, o_orderdate,
  o_orderkey % 1009 = 0 AS short, o_orderkey % 1013 = 0 AS bad FROM orders)"""


def _parsed(spark, sf):
    wanted = types.spark_schema(
        [
            {"name": "k", "type": "INT64"},
            {"name": "cust", "type": "INT64"},
            {"name": "status", "type": "STRING"},
            {"name": "day", "type": "DATE"},
        ]
    )
    path = work_path(spark, "csv")
    rows = v.table(spark, sf, "orders").selectExpr(
        "cast(o_orderkey as string) as k",
        "if(o_orderkey % 1013 = 0, 'x1', cast(o_custkey as string)) as cust",
        "case o_orderkey % 3 when 0 then '  ' when 1 then '' else o_orderstatus end as status",
        "if(o_orderkey % 2 = 0, date_format(o_orderdate, 'yyyy-MM-dd'), date_format(o_orderdate, 'MM/dd/yyyy')) as day",
        "o_orderkey % 1009 = 0 as short",
    )
    full = rows.filter("not short").drop("short")
    full.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(f"{path}/full")
    # Lines with too few fields.
    rows.filter("short").selectExpr("k", "'cut' as cust").write.option("header", "true").csv(f"{path}/short")
    # A quote that its line does not close, and the rest of the value on a line of its own.
    header = spark.createDataFrame([("k,cust,status,day",)], "value string")
    header.unionAll(rows.filter("k % 1021 = 0").selectExpr("concat(k, ',7,\"two') as value")).coalesce(1).write.text(f"{path}/cut")
    return csv.load_csv_tolerant(spark, [f"{path}/full", f"{path}/short", f"{path}/cut"], wanted, max_errors=None)


@query("load_csv_tolerant", v.with_views(_CSV_SQL, """
SELECT o_orderkey AS k, o_custkey AS cust, st AS status, strftime(o_orderdate, '%Y-%m-%d') AS day FROM rows_ WHERE NOT short AND NOT bad"""))  # fmt: skip
def tolerant(spark, sf):
    good, _ = _parsed(spark, sf)
    return good.withColumn("day", F.col("day").cast("string"))


@query("load_rejects", v.with_views(_CSV_SQL, """
SELECT 'wrong number of fields' AS reason, '' AS column_name, o_orderkey || ',cut' AS raw_line FROM rows_ WHERE short
UNION ALL SELECT 'invalid value', 'cust', o_orderkey || ',x1,' || CASE o_orderkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN '""' ELSE st END || ',' ||
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%m/%d/%Y') END FROM rows_ WHERE bad AND NOT short
UNION ALL SELECT 'unclosed quote', '', o_orderkey || ',7,"two' FROM rows_ WHERE o_orderkey % 1021 = 0
ORDER BY raw_line DESC LIMIT 100"""))  # fmt: skip
def rejects(spark, sf):
    _, bad = _parsed(spark, sf)
    return csv.load_rejects(bad, 100, newest=["raw_line"]).select("reason", "column_name", "raw_line")


@query("load_full", """
SELECT step, n AS rows FROM (SELECT count(*) c FROM orders), LATERAL (VALUES ('create', c), ('append', 2 * c), ('truncate', c)) s(step, n)""")  # fmt: skip
def full_load(spark, sf):
    name, root, orders = _name("full"), work_path(spark, "full"), v.table(spark, sf, "orders")
    frames = []
    for step, truncate in (("create", False), ("append", False), ("truncate", True)):
        load.load_full(name, orders, root, truncate)
        frames.append((step, spark.table(name).count()))
    return spark.createDataFrame(frames, "step string, rows bigint")


@query("write_partitioned", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS rows, min(o_orderkey) AS first_key FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1""")  # fmt: skip
def partitioned(spark, sf):
    path = work_path(spark, "partitioned")
    name = layout.write_partitioned(v.table(spark, sf, "orders"), path, "o_orderdate", "TIMESTAMP", "MONTH", ["o_custkey", "o_orderkey"])
    # Folder names of the form yyyy-MM are read back as dates, so they are declared text.
    rows = spark.read.schema(v.table(spark, sf, "orders").schema.add(name, "string")).parquet(path)
    return rows.filter(F.col(name) >= "1997-01").groupBy(F.col(name).alias("month")).agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first_key"))


@query("compact_files", """
SELECT s AS strategy, count(*) AS rows, sum(l_orderkey)::BIGINT AS keys FROM lineitem, (VALUES ('binpack'), ('sort'), ('z-order')) x(s) GROUP BY 1""")  # fmt: skip
def compacted(spark, sf):
    small, frames = work_path(spark, "small"), []
    v.table(spark, sf, "lineitem").repartition(16).write.parquet(small)
    for strategy, columns in (("binpack", []), ("sort", ["l_shipdate"]), ("z-order", ["l_partkey", "l_shipdate"])):
        out = work_path(spark, f"compact-{strategy}")
        layout.compact_files(spark, small, out, strategy, columns, layout.MIN_TARGET)
        frames.append(spark.read.parquet(out).agg(F.lit(strategy).alias("strategy"), F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").alias("keys")))
    return schema.union_all(frames)


@query("append_new_files", """
SELECT round AS round, files AS files, rows FROM (SELECT count(*) c, count(*) FILTER (o_orderkey % 4 < 2) h FROM orders),
LATERAL (VALUES (1, 2, h), (2, 2, c), (3, 0, c)) r(round, files, rows)""")  # fmt: skip
def appended(spark, sf):
    path = _chunks(spark, sf, work_path(spark, "append"))
    name, root, registry = _name("append"), work_path(spark, "append-table"), work_path(spark, "registry")
    own = v.table(spark, sf, "orders").schema
    listed = files.file_listing(spark, path)
    rounds = []
    for n, chosen in enumerate((listed.filter("path rlike 'chunk=[01]/'"), listed, listed), start=1):
        added = load.append_new_files(name, files.list_data_files(chosen, "PARQUET"), registry, root, own)
        rounds.append((n, added, spark.table(name).count()))
    return spark.createDataFrame(rounds, "round int, files int, rows bigint")


@query("load_history", """
SELECT 'full' AS load_type, 'completed' AS status, count(*) AS rows_loaded, true AS has_bytes, 'orders.parquet' AS source, 'PARQUET' AS file_format FROM orders
UNION ALL SELECT 'full', 'completed', count(*) FILTER (o_orderkey % 2 = 0), true, NULL, NULL FROM orders
UNION ALL SELECT 'incremental', 'failed', 0, false, NULL, NULL""")  # fmt: skip
def history(spark, sf):
    name, root, log = _name("hist"), work_path(spark, "hist"), work_path(spark, "hist-log")
    orders = v.table(spark, sf, "orders")
    load.load_with_history(name, orders, root, log, source="orders.parquet", file_format="PARQUET")
    load.load_with_history(name, orders.filter("o_orderkey % 2 = 0"), root, log, truncate=True)
    broken = orders.withColumn("o_orderkey", F.raise_error(F.lit("broken source")).cast("bigint"))
    load.load_with_history(name, broken, root, log, "incremental", primary_key="o_orderkey")
    return spark.read.parquet(log).select("load_type", "status", "rows_loaded", (F.col("bytes_loaded") > 0).alias("has_bytes"), "source", "file_format")


@query("replace_slice", """
SELECT o_orderstatus, count(*) AS rows, sum(CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1 ELSE o_custkey END)::BIGINT AS custs FROM orders
WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 2 = 0) GROUP BY 1""")  # fmt: skip
def sliced(spark, sf):
    path, orders = work_path(spark, "slice"), v.table(spark, sf, "orders")
    load.replace_slice(orders, path, "o_orderstatus")
    load.replace_slice(orders.filter("o_orderstatus = 'F' and o_orderkey % 2 <> 0").withColumn("o_custkey", F.col("o_custkey") + 1), path, "o_orderstatus")
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_custkey").alias("custs"))


DECLARED = [
    {"name": "o_orderkey", "type": "INT64", "mode": "REQUIRED"},
    {"name": "o_totalprice", "type": "NUMERIC"},
    {"name": "o_orderdate", "type": "DATE"},
    {"name": "o_custkey", "type": "STRING"},
    {"name": "o_orderstatus", "type": "MYSTERY"},
    {"name": "lines", "type": "RECORD", "mode": "REPEATED", "fields": [{"name": "l_linenumber", "type": "STRING"}, {"name": "l_tax", "type": "FLOAT64"}, {"name": "extra", "type": "BOOL"}]},
    {"name": "absent", "type": "TIMESTAMP"},
]


def _nested_orders(spark, sf):
    lines = v.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_tax"))).alias("lines")
    )
    return v.table(spark, sf, "orders").join(lines, "o_orderkey", "left")


@query("cast_to_target", """
SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(38,9))::DOUBLE AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, CAST(o_custkey AS VARCHAR) AS o_custkey,
  o_orderstatus, coalesce(ln, '') AS line_numbers, true AS absent_is_null
FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber, l_tax) ln FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")  # fmt: skip
def casted(spark, sf):
    shaped = types.cast_to_target(_nested_orders(spark, sf), DECLARED)
    numbers = F.array_join(F.transform("lines", lambda x: x["l_linenumber"]), ",")
    return shaped.select(
        "o_orderkey",
        F.col("o_totalprice").cast("double").alias("o_totalprice"),
        F.col("o_orderdate").cast("string").alias("o_orderdate"),
        "o_custkey",
        "o_orderstatus",
        F.coalesce(numbers, F.lit("")).alias("line_numbers"),
        F.col("absent").isNull().alias("absent_is_null"),
    )


@query("csv_with_line_breaks", """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'two' || chr(10) || 'lines, "quoted" ' || o_custkey ELSE 'one line ' || o_custkey END AS note FROM orders""")  # fmt: skip
def broken_lines(spark, sf):
    path = work_path(spark, "csv-lines")
    note = "if(o_orderkey % 4 = 0, concat('two\nlines, \"quoted\" ', o_custkey), concat('one line ', o_custkey)) as note"
    rows = v.table(spark, sf, "orders").selectExpr("cast(o_orderkey as string) as k", note)
    rows.write.option("header", "true").option("escape", '"').csv(path)
    wanted = types.spark_schema([{"name": "k", "type": "INT64"}, {"name": "note", "type": "STRING"}])
    return csv.load_csv_tolerant(spark, path, wanted, max_errors=None, multi_line=True)[0]


@query("conversion_failures", """
SELECT 'o_orderkey' AS column_name, 0::BIGINT AS failed, 0::BIGINT AS missing
UNION ALL SELECT 'price', count(*) FILTER (o_orderkey % 3 = 0), 0 FROM orders UNION ALL SELECT 'day', count(*) FILTER (o_orderkey % 5 = 0), 0 FROM orders
UNION ALL SELECT 'who', 0, count(*) FILTER (o_orderkey % 11 = 0) FROM orders
UNION ALL SELECT 'lines', count(*) FILTER (o_orderkey % 13 = 0), 0 FROM orders UNION ALL SELECT 'absent', 0, count(*) FROM orders""")  # fmt: skip
def lost_values(spark, sf):
    rows = v.table(spark, sf, "orders").selectExpr(
        "o_orderkey", "if(o_orderkey % 3 = 0, 'abc', cast(o_totalprice as string)) as price", "if(o_orderkey % 5 = 0, 'some day', '2024-01-02') as day",
        "if(o_orderkey % 11 = 0, null, o_custkey) as who", "array(named_struct('n', if(o_orderkey % 13 = 0, 'x', '1')), named_struct('n', '2')) as lines",
    )
    declared = [
        {"name": "o_orderkey", "type": "INT64", "mode": "REQUIRED"}, {"name": "price", "type": "NUMERIC"}, {"name": "day", "type": "DATE"},
        {"name": "who", "type": "INT64", "mode": "REQUIRED"}, {"name": "lines", "type": "RECORD", "mode": "REPEATED", "fields": [{"name": "n", "type": "INT64"}]},
        {"name": "absent", "type": "INT64", "mode": "REQUIRED"},
    ]
    return types.conversion_failures(rows, declared)


@query("structure_partitions", """
SELECT strftime(o_orderdate, '%Y-%m') AS folder, count(*) AS rows, (SELECT count(*) FROM orders WHERE o_orderkey % 9 = 0) AS failed FROM orders GROUP BY 1""")  # fmt: skip
def structure_folders(spark, sf):
    rows = v.table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderdate", "if(o_orderkey % 9 = 0, 'none', '12.5') as price")
    wanted = {
        "columns": [{"name": "o_orderkey", "type": "long"}, {"name": "o_orderdate", "type": "timestamp"}, {"name": "price", "type": "double"}],
        "partition_spec": {"column": "o_orderdate", "transform": "month"}, "sort_order": ["o_orderkey"],
    }
    path = work_path(spark, "structured")
    name, _ = schema.write_structured(rows, wanted, path)
    lost = schema.structure_failures(rows, wanted).agg(F.sum("failed")).first()[0]
    back = load.read_partitioned(spark, path, name, F_STRING)
    return back.groupBy(F.col(name).alias("folder")).agg(F.count(F.lit(1)).alias("rows")).withColumn("failed", F.lit(lost))


@query("nested_to_json", """
SELECT o_orderkey, '[' || string_agg('{"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']' AS lines
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")  # fmt: skip
def as_json(spark, sf):
    lines = v.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines")
    )
    return types.nested_to_json(v.table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey"))


@query("null_fill", v.with_views(v.QUERY_LOG, """
SELECT job_id, coalesce(user_email, '') AS user_email, coalesce(query_text, '') AS query_text, coalesce(elapsed, 0) AS elapsed,
  CASE WHEN elapsed IS NULL THEN NULL ELSE strftime(execution_time, '%Y-%m-%d') END AS day FROM query_log"""))  # fmt: skip
def filled(spark, sf):
    elapsed = F.col("query_metadata.total_elapsed_time_ms")
    rows = v.query_log(spark, sf).select(
        "job_id", "user_email", "query_text", elapsed.alias("elapsed"), F.when(elapsed.isNotNull(), F.to_date("execution_time")).alias("day")
    )
    return types.null_fill(rows).withColumn("day", F.col("day").cast("string"))


STRUCTURE = {
    "columns": [
        {"name": "o_orderkey", "type": "string"},
        {"name": "o_totalprice", "type": "decimal(12,1)"},
        {"name": "O_ORDERDATE", "type": "date"},
        {"name": "note", "type": "varchar"},
    ],
    "partition_spec": {"column": "o_custkey", "transform": "identity"},
    "sort_order": [{"column": "o_orderkey", "direction": "asc"}, "gone"],
}


@query("apply_structure", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(12,2)), 1) AS DOUBLE) AS o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, CAST(NULL AS VARCHAR) AS note, 5 AS warning_count FROM orders""")  # fmt: skip
def structured(spark, sf):
    shaped, warnings = schema.apply_structure(v.table(spark, sf, "orders"), STRUCTURE)
    return shaped.select(
        "o_orderkey",
        F.col("o_totalprice").cast("double").alias("o_totalprice"),
        F.col("O_ORDERDATE").cast("string").alias("o_orderdate"),
        "note",
        F.lit(len(warnings)).alias("warning_count"),
    )


@query("incremental_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '2000-06-01'")
def later(spark, sf):
    return load.incremental_filter(v.table(spark, sf, "orders"), "o_orderdate", "2000-06-01 00:00:00").select("o_orderkey", "o_custkey")


@query("incremental_load", """
SELECT step, status, rows FROM (SELECT count(*) FILTER (o_orderdate <= TIMESTAMP '1999-01-01') a, count(*) c FROM orders),
LATERAL (VALUES (1, 'loaded', a), (2, 'loaded', c - a), (3, 'no_new_data', 0)) s(step, status, rows)""")  # fmt: skip
def bookmarked(spark, sf):
    name, root, marks, orders = _name("inc"), work_path(spark, "inc"), work_path(spark, "marks"), v.table(spark, sf, "orders")
    steps = []
    for n, source in enumerate((orders.filter("o_orderdate <= timestamp_ntz'1999-01-01'"), orders, orders), start=1):
        result = load.load_incremental(name, source, "o_orderdate", marks, root)
        steps.append((n, result["status"], result["rows_loaded"]))
    return spark.createDataFrame(steps, "step int, status string, rows bigint")


@query("incremental_load_by_number", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey <= 12 THEN 1 ELSE 2 END AS step FROM orders")
def bookmarked_by_number(spark, sf):
    """Keys 9 and 10 in one load: as text the bookmark would be '9' and rows would be loaded twice."""
    name, root, marks, orders = _name("inc"), work_path(spark, "inc"), work_path(spark, "marks"), v.table(spark, sf, "orders")
    rows = orders.select("o_orderkey", "o_custkey")
    for step, source in enumerate((rows.filter("o_orderkey <= 12"), rows, rows), start=1):
        load.load_incremental(name, source.withColumn("step", F.lit(step)), "o_orderkey", marks, root)
    return spark.table(name)


@query("schema_evolve", """
SELECT o_orderkey::BIGINT AS o_orderkey, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS price, NULL AS channel FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, o_totalprice, 'web' FROM orders WHERE o_orderkey % 2 = 1""")  # fmt: skip
def evolved(spark, sf):
    name, root, orders = _name("evolve"), work_path(spark, "evolve"), v.table(spark, sf, "orders")
    old = orders.filter("o_orderkey % 2 = 0").selectExpr("cast(o_orderkey as int) as o_orderkey", "cast(o_totalprice as float) as price")
    load.load_full(name, old, root)
    new = orders.filter("o_orderkey % 2 = 1").selectExpr("o_orderkey", "o_totalprice as price", "'web' as channel")
    load.evolve_table(name, new)
    return spark.table(name)


_STAGING = "o_orderkey % 5 = 0"
_MERGED_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, o_custkey + 7, 'N' FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT -o_orderkey - 1, o_custkey + 7, 'N' FROM orders WHERE o_orderkey % 10 = 0"""


def _staging(orders):
    changed = orders.filter(_STAGING).withColumn("o_custkey", F.col("o_custkey") + 7).withColumn("o_orderstatus", F.lit("N"))
    return changed.unionByName(changed.filter("o_orderkey % 10 = 0").withColumn("o_orderkey", -F.col("o_orderkey") - 1))


@query("merge_upsert", _MERGED_SQL)
def merged(spark, sf):
    name, root, orders = _name("merge"), work_path(spark, "merge"), v.table(spark, sf, "orders")
    load.load_full(name, orders, root)
    load.load_table(name, _staging(orders), root, {"load_type": "incremental", "primary_key": "o_orderkey"}, load_type="full")
    return spark.table(name).select("o_orderkey", "o_custkey", "o_orderstatus")


_RECENT = "o_orderkey % 5 = 0 AND o_orderkey // 100 % 10 = 3"


@query("merge_units", f"""
SELECT o_orderkey, o_custkey, (SELECT count(DISTINCT o_orderkey // 100) FROM orders WHERE {_RECENT}) AS units_touched FROM orders WHERE NOT ({_RECENT})
UNION ALL SELECT o_orderkey, -o_custkey, (SELECT count(DISTINCT o_orderkey // 100) FROM orders WHERE {_RECENT}) FROM orders WHERE {_RECENT}""")  # fmt: skip
def merged_units(spark, sf):
    """Orders in units of a hundred keys; a batch of keys from every tenth unit is merged, and merged again."""
    path, orders = work_path(spark, "units"), v.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    units.write_units(orders, path, ["o_orderkey"], unit=F.expr("o_orderkey div 100"))
    staging = orders.filter(_RECENT.replace("//", "div")).withColumn("o_custkey", -F.col("o_custkey"))
    touched = units.merge_units(path, staging, ["o_orderkey"], "first")
    units.merge_units(path, staging, ["o_orderkey"], "first")
    return units.read_units(spark, path).select("o_orderkey", "o_custkey", F.lit(len(touched)).cast("bigint").alias("units_touched"))


@query("merge_partitions", _MERGED_SQL)
def merged_partitions(spark, sf):
    path, orders = work_path(spark, "merge-parts"), v.table(spark, sf, "orders")
    load.replace_slice(orders, path, "o_orderstatus")
    load.merge_partitions(path, _staging(orders), ["o_orderkey"], "o_orderstatus")
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("merge_text_partitions", """
SELECT k, v, part FROM (SELECT o_orderkey AS k, o_custkey AS v, 'a/' || (o_orderkey % 3) AS part, o_orderkey FROM orders WHERE o_orderkey % 3 <> 2 AND o_orderkey % 5 <> 0
  UNION ALL SELECT o_orderkey, o_custkey, '0' || (o_orderkey % 4), o_orderkey FROM orders WHERE o_orderkey % 3 = 2 AND o_orderkey % 5 <> 0
  UNION ALL SELECT o_orderkey, o_custkey + 1, '01', o_orderkey FROM orders WHERE o_orderkey % 5 = 0)""")  # fmt: skip
def merged_text_partitions(spark, sf):
    """Folder names that look like numbers or need escaping; keys move into '01' and one partition loses all its rows."""
    path, orders = work_path(spark, "merge-text"), v.table(spark, sf, "orders")
    part = "case when o_orderkey % 5 = 0 and o_orderkey % 2 = 0 then 'left/behind+%' when o_orderkey % 3 <> 2 then concat('a/', o_orderkey % 3) else concat('0', o_orderkey % 4) end"
    rows = orders.selectExpr("o_orderkey as k", "o_custkey as v", f"{part} as part")
    load.replace_slice(rows, path, "part")
    staging = rows.filter("k % 5 = 0").withColumn("v", F.col("v") + 1).withColumn("part", F.lit("01"))
    older = staging.withColumn("v", F.col("v") - 9)
    both = staging.withColumn("version", F.lit(2)).unionByName(older.withColumn("version", F.lit(1)))
    newest = load.newest_rows(both, ["k"], ["version"]).drop("version")
    load.merge_partitions(path, newest, ["k"], "part")
    return load.read_partitioned(spark, path, "part", F_STRING).select("k", "v", "part")


@query("incremental_delta", """
SELECT load_type, source_count, previous_count, current_count,
  CASE WHEN load_type = 'full' THEN current_count - source_count ELSE current_count - previous_count END AS delta, 'passed' AS status
FROM (SELECT count(*) FILTER (o_orderkey % 3 <> 0) a, count(*) FILTER (o_orderkey % 3 = 0) b FROM orders),
LATERAL (VALUES ('full', a, 0, a), ('incremental', b, a, a + b)) s(load_type, source_count, previous_count, current_count)""")  # fmt: skip
def deltas(spark, sf):
    name, root, orders = _name("delta"), work_path(spark, "delta"), v.table(spark, sf, "orders")
    counts, before = [], 0
    for kind, batch in (("full", orders.filter("o_orderkey % 3 <> 0")), ("incremental", orders.filter("o_orderkey % 3 = 0"))):
        load.load_table(name, batch, root, load_type=kind)
        after = spark.table(name).count()
        counts.append((kind, batch.count(), before, after))
        before = after
    recorded = spark.createDataFrame(counts, "load_type string, source_count bigint, previous_count bigint, current_count bigint")
    return parity.incremental_delta(recorded)


# ---- streams ------------------------------------------------------------------------


@query("file_watermark_load", """
SELECT 'rows' AS what, count(*) AS n FROM orders UNION ALL SELECT 'again', 0 UNION ALL SELECT 'kept_without_time', count(DISTINCT o_orderkey % 4) FROM orders
UNION ALL SELECT 'kept_after_watermark', 0 UNION ALL SELECT 'kept_bad_watermark', count(DISTINCT o_orderkey % 4) FROM orders""")  # fmt: skip
def watermarked(spark, sf):
    path, out, checkpoint = _chunks(spark, sf, work_path(spark, "arrive")), work_path(spark, "loaded"), work_path(spark, "checkpoint")
    own = v.table(spark, sf, "orders").schema
    file_stream.load_available_files(spark, path, own, file_stream.append_batches(out), checkpoint, max_files=2)
    rows = spark.read.parquet(out).count()
    again = file_stream.load_available_files(spark, path, own, file_stream.append_batches(out), checkpoint, max_files=2)
    listed = files.list_data_files(files.file_listing(spark, path), "PARQUET").withColumn("modification_time", F.lit("2024-01-15T10:30:00Z"))
    untimed = listed.withColumn("modification_time", F.lit("not a time"))
    mark = file_stream.compute_watermark(listed).first()["watermark"]
    kept = [file_stream.filter_by_watermark(f, m).count() for f, m in ((untimed, mark), (listed, mark), (listed, "garbage"))]
    names = ("kept_without_time", "kept_after_watermark", "kept_bad_watermark")
    return spark.createDataFrame([("rows", rows), ("again", again), *zip(names, kept, strict=True)], "what string, n bigint")


@query("file_mark_load", """
SELECT step, files, rows FROM (SELECT count(*) c, count(*) FILTER (o_orderkey % 4 < 2) a, count(*) FILTER (o_orderkey % 4 < 3) b FROM orders),
LATERAL (VALUES (1, 2, a), (2, 1, b), (3, 0, b), (4, 4, c), (5, 0, c)) s(step, files, rows)""")  # fmt: skip
def marked_files(spark, sf):
    """Two files; one more of the same second; one from before the mark; a reload of all; and nothing new."""
    path = _chunks(spark, sf, work_path(spark, "mark-in"))
    name, root, registry, own = _name("mark"), work_path(spark, "mark"), work_path(spark, "mark-reg"), v.table(spark, sf, "orders").schema
    chunk = F.regexp_extract("path", r"/chunk=(\d)/", 1).cast("int")
    times = F.when(chunk == 0, "2024-05-01T10:00:00.1Z").when(chunk == 3, "2024-05-01T09:59:59Z").otherwise("2024-05-01T10:00:00.5Z")
    listed = files.list_data_files(files.file_listing(spark, path), "PARQUET").withColumn("modification_time", times)
    steps = []
    for step, (upto, reload) in enumerate(((2, False), (3, False), (4, False), (4, True), (4, False)), start=1):
        loaded = load.load_files_since_mark(name, listed.filter(chunk < upto), registry, root, own, reload=reload)
        steps.append((step, loaded["files"], spark.table(name).count()))
    return spark.createDataFrame(steps, "step int, files int, rows bigint")


_CHUNKS = 6
_LATENESS = "10 minutes"
#: Rows that go to one file of a stream, about.
_FILE_ROWS = 1_000_000


def _files(rows: int, parts: int) -> int:
    """Files for each of ``parts`` equal parts of so many rows."""
    return max(1, -(-rows // (parts * _FILE_ROWS)))


def _log_stream(spark, sf, per_trigger: int = 2, extra=None):
    """The query log as a stream of chunks in time order, ``per_trigger`` at a time; ``extra(log, cuts)`` gives more rows for the last chunk.

    All chunks have the same number of files, which grows with the log, so batches end where chunks do.
    Rows are dealt out to the files evenly; a file takes no task that reads more than its rows.
    """
    path = work_path(spark, "log")
    log = v.query_log(spark, sf).select("job_id", "execution_time", "bytes_scanned", "user_email")
    seconds = F.unix_micros(F.col("execution_time").cast("timestamp"))
    cuts, count = log.agg(F.percentile_approx(seconds, [k / _CHUNKS for k in range(1, _CHUNKS)], 10_000), F.count(F.lit(1))).first()
    per_chunk = _files(count, _CHUNKS)
    chunk = sum((seconds > c).cast("int") for c in cuts)
    for k in range(_CHUNKS):
        rows = log.filter(chunk == k)
        if extra is not None and k == _CHUNKS - 1:
            rows = rows.unionByName(extra(log, cuts))
        rows.repartition(per_chunk).write.mode("append").parquet(path)
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", per_trigger * per_chunk).parquet(path)


@query("stream_concurrency", v.with_views(v.QUERY_LOG, """
SELECT strftime(date_trunc('minute', execution_time), '%Y-%m-%d %H:%M') AS window_start, count(*) AS query_count FROM query_log GROUP BY 1"""))  # fmt: skip
def stream_counts(spark, sf):
    """The rows of the first file come again in the last one; they are late by then and not counted."""
    out = work_path(spark, "windows")
    late = lambda log, cuts: log.filter(F.unix_micros(F.col("execution_time").cast("timestamp")) <= cuts[0])
    table_stream.stream_concurrency(_log_stream(spark, sf, extra=late), out, work_path(spark, "checkpoint"), lateness=_LATENESS)
    return table_stream.window_counts(spark, out).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query("stream_dedup", v.with_views(v.QUERY_LOG, """,
e AS (SELECT job_id, bytes_scanned FROM query_log WHERE execution_time = (SELECT min(execution_time) FROM query_log))
SELECT job_id, bytes_scanned FROM query_log UNION ALL SELECT job_id, bytes_scanned FROM e"""))  # fmt: skip
def stream_distinct(spark, sf):
    """Repeats within the lateness go; a key that comes again long after is let through, as its state is gone."""
    out = work_path(spark, "distinct")

    def again(log, cuts):
        ends = log.agg(F.min("execution_time").alias("first"), F.max("execution_time").alias("last")).first()
        soon = log.filter(F.unix_micros(F.col("execution_time").cast("timestamp")) > cuts[-1])
        evicted = log.filter(F.col("execution_time") == F.lit(ends["first"])).withColumn("execution_time", F.lit(ends["last"]).cast("timestamp_ntz"))
        return soon.unionByName(evicted)

    table_stream.stream_dedup(_log_stream(spark, sf, extra=again), ["job_id"], out, work_path(spark, "checkpoint"), lateness=_LATENESS)
    return spark.read.parquet(out).select("job_id", "bytes_scanned")


@query("stream_merge_partitions", v.with_views(v.QUERY_LOG, """
SELECT job_id, CASE WHEN event % 5 = 0 THEN -1 ELSE bytes_scanned END AS bytes_scanned, 'p' || (event % 4) AS part
FROM (SELECT *, CAST(substr(job_id, 5) AS BIGINT) AS event FROM query_log)"""))  # fmt: skip
def stream_upsert_partitions(spark, sf):
    """Files of every fifth job with a new value arrive after the table was filled, in two batches."""
    out, path = work_path(spark, "stream-parts"), work_path(spark, "late-values")
    rows = v.query_log(spark, sf).selectExpr("job_id", "bytes_scanned", "concat('p', cast(substr(job_id, 5) as bigint) % 4) as part", "cast(substr(job_id, 5) as bigint) as event")
    load.replace_slice(rows.drop("event"), out, "part")
    per_batch = _files(rows.filter("event % 5 = 0").count(), 2)
    for k in (0, 1):
        rows.filter(f"event % 5 = 0 and event % 2 = {k}").selectExpr("job_id", "-1L as bytes_scanned", "part").repartition(per_batch).write.mode("append").parquet(path)
    stream = spark.readStream.schema("job_id string, bytes_scanned bigint, part string").option("maxFilesPerTrigger", per_batch).parquet(path)
    table_stream.stream_merge_partitions(stream, out, ["job_id"], "part", work_path(spark, "checkpoint"))
    return load.read_partitioned(spark, out, "part", F_STRING).select("job_id", "bytes_scanned", "part")


@query("stream_merge", v.with_views(v.QUERY_LOG, "SELECT job_id, bytes_scanned FROM query_log"))
def stream_upsert(spark, sf):
    name, root = _name("stream_merge"), work_path(spark, "stream-merge")
    again = lambda log, cuts: log.filter("bytes_scanned % 5 = 0").withColumn("bytes_scanned", F.col("bytes_scanned") - 1).withColumn("execution_time", F.lit("2020-01-01").cast("timestamp_ntz"))
    recent = lambda log, cuts: again(log.filter(F.unix_micros(F.col("execution_time").cast("timestamp")) > cuts[-1]), cuts)
    table_stream.stream_merge(_log_stream(spark, sf, per_trigger=3, extra=recent), name, ["job_id"], root, work_path(spark, "checkpoint"), newest_by=["execution_time"])
    return spark.table(name).select("job_id", "bytes_scanned")
