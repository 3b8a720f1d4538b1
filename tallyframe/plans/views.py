"""Inputs derived from the given tables, once as DataFrames and once as SQL.

Each view grows with the table it reads. The DataFrame and the SQL text state
the same formula; the SQL side is only used to check results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# "Now" for everything relative to the present: just after the last logged event.
NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of orders with known damage: dropped, changed, emptied, repeated and added rows."""
    return (
        table(spark, sf_dir, "orders")
        .selectExpr(
            "*",
            """explode(filter(array(
                 if(o_orderkey % 97 <> 0, 'keep', null),
                 if(o_orderkey % 97 <> 0 and o_orderkey % 107 = 0, 'again', null),
                 if(o_orderkey % 109 = 0, 'added', null)), v -> v is not null)) as variant""",
        )
        .selectExpr(
            "if(variant = 'added', -o_orderkey - 1, o_orderkey) as o_orderkey",
            "o_custkey",
            "o_orderstatus",
            "if(variant <> 'added' and o_orderkey % 101 = 0, o_totalprice + 1, o_totalprice) as o_totalprice",
            "o_orderdate",
            "if(variant <> 'added' and o_orderkey % 103 = 0, null, o_orderpriority) as o_orderpriority",
        )
    )


ORDERS_TARGET = """orders_target AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 101 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         o_orderdate,
         CASE WHEN o_orderkey % 103 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders, (VALUES (1), (2)) c(n)
  WHERE o_orderkey % 97 <> 0 AND (n = 1 OR o_orderkey % 107 = 0)
  UNION ALL
  SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 109 = 0)"""


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A warehouse query log, one row per event."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "event_id",
            "ts",
            "user_id as u",
            "event_type",
            "value",
            "cast(get_json_object(props, '$.k') as int) as k",
        )
        .selectExpr(
            "concat('job_', event_id) as job_id",
            "ts as execution_time",
            """case
                 when event_type = 'view' then concat('SELECT COUNT(*) FROM ds_', u % 7, '.tbl_', u, ' JOIN ds_',
                      k % 7, '.tbl_', k, ' ON ds_', u % 7, '.tbl_', u, '.id = tbl_', k, '.user_id WHERE tbl_', u, '.k = ', k)
                 when event_type = 'click' then concat('select *  from ds_', u % 7, '.tbl_', u,
                      if(k % 4 = 0, ' -- dashboard ', ' -- page '), event_id % 40)
                 when event_type = 'purchase' then concat('INSERT INTO ds_', u % 7, '.tbl_', u,
                      ' SELECT * FROM ds_', k % 7, '.tbl_', k, ' WHERE v > ', event_id)
                 when event_type = 'signup' then concat('MERGE INTO ds_', u % 7, '.tbl_', u, ' t USING src s ON t.id = s.id -- ', event_id)
                 when k % 3 = 0 then concat('  create or replace table x_', k, ' as select 1 as a')
                 when k % 3 = 1 then null
                 else concat('with t as (select 1) select * from t /* report */ limit ', event_id)
               end as query_text""",
            "cast(floor(value * 1e7) as bigint) as bytes_scanned",
            "if(event_id % 17 = 0, 0L, cast(floor(value * 1000) as bigint)) as slot_milliseconds",
            "event_id % 3 = 0 as cache_hit",
            """case
                 when event_type = 'error' and k % 3 = 1 then cast(array() as array<string>)
                 when event_id % 13 = 0 then array(concat('tbl_', u))
                 when event_type in ('view', 'purchase') then
                      array(concat('proj.ds_', u % 7, '.tbl_', u), concat('proj.ds_', k % 7, '.tbl_', k))
                 else array(concat('proj.ds_', u % 7, '.tbl_', u))
               end as referenced_tables""",
            """case when u % 31 = 0 then null
                    when u % 29 = 0 then concat('svc-scheduler', u, '@example.com')
                    else concat('user', u, '@example.com') end as user_email""",
            """named_struct(
                 'total_elapsed_time_ms', if(k % 10 = 0, null, cast(k as bigint) * 3000),
                 'bytes_billed', if(event_id % 3 = 0, 0L, (cast(floor(value * 1e7) as bigint) div 10485760 + 1) * 10485760),
                 'statement_type', case event_type when 'view' then 'SELECT' when 'click' then 'SELECT'
                     when 'purchase' then 'INSERT' when 'signup' then 'merge' else 'UNKNOWN' end) as query_metadata""",
        )
    )


QUERY_LOG = """events_k AS (
  SELECT event_id, ts, user_id AS u, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
query_log AS (
  SELECT 'job_' || event_id AS job_id, ts AS execution_time,
    CASE
      WHEN event_type = 'view' THEN 'SELECT COUNT(*) FROM ds_' || (u % 7) || '.tbl_' || u || ' JOIN ds_' ||
           (k % 7) || '.tbl_' || k || ' ON ds_' || (u % 7) || '.tbl_' || u || '.id = tbl_' || k || '.user_id WHERE tbl_' || u || '.k = ' || k
      WHEN event_type = 'click' THEN 'select *  from ds_' || (u % 7) || '.tbl_' || u ||
           CASE WHEN k % 4 = 0 THEN ' -- dashboard ' ELSE ' -- page ' END || (event_id % 40)
      WHEN event_type = 'purchase' THEN 'INSERT INTO ds_' || (u % 7) || '.tbl_' || u ||
           ' SELECT * FROM ds_' || (k % 7) || '.tbl_' || k || ' WHERE v > ' || event_id
      WHEN event_type = 'signup' THEN 'MERGE INTO ds_' || (u % 7) || '.tbl_' || u || ' t USING src s ON t.id = s.id -- ' || event_id
      WHEN k % 3 = 0 THEN '  create or replace table x_' || k || ' as select 1 as a'
      WHEN k % 3 = 1 THEN NULL
      ELSE 'with t as (select 1) select * from t /* report */ limit ' || event_id
    END AS query_text,
    CAST(floor(value * CAST(1e7 AS DOUBLE)) AS BIGINT) AS bytes_scanned,
    CASE WHEN event_id % 17 = 0 THEN 0 ELSE CAST(floor(value * CAST(1000 AS DOUBLE)) AS BIGINT) END AS slot_milliseconds,
    event_id % 3 = 0 AS cache_hit,
    CASE
      WHEN event_type = 'error' AND k % 3 = 1 THEN CAST([] AS VARCHAR[])
      WHEN event_id % 13 = 0 THEN ['tbl_' || u]
      WHEN event_type IN ('view', 'purchase') THEN
           ['proj.ds_' || (u % 7) || '.tbl_' || u, 'proj.ds_' || (k % 7) || '.tbl_' || k]
      ELSE ['proj.ds_' || (u % 7) || '.tbl_' || u]
    END AS referenced_tables,
    CASE WHEN u % 31 = 0 THEN NULL
         WHEN u % 29 = 0 THEN 'svc-scheduler' || u || '@example.com'
         ELSE 'user' || u || '@example.com' END AS user_email,
    CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(k AS BIGINT) * 3000 END AS elapsed,
    CASE WHEN event_id % 3 = 0 THEN 0 ELSE (CAST(floor(value * CAST(1e7 AS DOUBLE)) AS BIGINT) // 10485760 + 1) * 10485760 END AS billed,
    CASE event_type WHEN 'view' THEN 'SELECT' WHEN 'click' THEN 'SELECT'
         WHEN 'purchase' THEN 'INSERT' WHEN 'signup' THEN 'merge' ELSE 'UNKNOWN' END AS statement_type
  FROM events_k)"""


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table catalog, one row per part."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as table_id",
        "'proj' as project_id",
        "concat('ds_', p_partkey % 7) as dataset_name",
        """case
             when p_partkey % 5 = 3 then concat('shard_', lower(p_type), '_',
                  date_format(date_add(date'2024-01-01', cast(p_partkey % 400 as int)), 'yyyyMMdd'))
             when p_partkey % 25 = 4 then concat('arch_', 202400 + p_partkey % 16)
             when p_partkey % 40 = 1 then element_at(array('select', 'Table', 'user', 'window'), cast(p_partkey % 4 + 1 as int))
             when p_partkey % 40 = 2 then concat('--Odd Name!', p_partkey)
             else concat('tbl_', p_partkey) end as table_name""",
        "if(p_partkey % 11 = 0, 'VIEW', 'BASE TABLE') as table_type",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(p_partkey % 1000 as int), 0, 0) as creation_time",
        "cast(p_size as bigint) * (p_partkey % 50 + 1) * 1000 as row_count",
        "cast(p_size as bigint) * (p_partkey % 40 + 1) as size_mb",
        "if(p_partkey % 3 = 0, array('created_date'), cast(array() as array<string>)) as partitioning_columns",
        "if(p_partkey % 4 = 0, array('region', 'id'), cast(array() as array<string>)) as clustering_columns",
        "p_partkey % 10 = 0 as has_column_security",
        "p_partkey % 15 = 0 as has_row_security",
        "p_partkey % 5 = 3 as is_sharded",
    )


CATALOG_TABLES = """catalog_tables AS (
  SELECT p_partkey AS table_id, 'proj' AS project_id, 'ds_' || (p_partkey % 7) AS dataset_name,
    CASE
      WHEN p_partkey % 5 = 3 THEN 'shard_' || lower(p_type) || '_' ||
           strftime(DATE '2024-01-01' + CAST(p_partkey % 400 AS INTEGER), '%Y%m%d')
      WHEN p_partkey % 25 = 4 THEN 'arch_' || (202400 + p_partkey % 16)
      WHEN p_partkey % 40 = 1 THEN ['select', 'Table', 'user', 'window'][CAST(p_partkey % 4 + 1 AS INTEGER)]
      WHEN p_partkey % 40 = 2 THEN '--Odd Name!' || p_partkey
      ELSE 'tbl_' || p_partkey END AS table_name,
    CASE WHEN p_partkey % 11 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(p_partkey % 1000 AS INTEGER)) AS creation_time,
    CAST(p_size AS BIGINT) * (p_partkey % 50 + 1) * 1000 AS row_count,
    CAST(p_size AS BIGINT) * (p_partkey % 40 + 1) AS size_mb,
    CASE WHEN p_partkey % 3 = 0 THEN ['created_date'] ELSE CAST([] AS VARCHAR[]) END AS partitioning_columns,
    CASE WHEN p_partkey % 4 = 0 THEN ['region', 'id'] ELSE CAST([] AS VARCHAR[]) END AS clustering_columns,
    p_partkey % 10 = 0 AS has_column_security,
    p_partkey % 15 = 0 AS has_row_security,
    p_partkey % 5 = 3 AS is_sharded
  FROM part)"""


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the catalog tables, three to eight per table."""
    return (
        table(spark, sf_dir, "part")
        .selectExpr("p_partkey as p", "explode(sequence(1, cast(3 + p_partkey % 6 as int))) as n")
        .selectExpr(
            "p as table_id",
            """element_at(array(if(p % 2 = 0, 'id', 'row_key'), 'created_date', 'Name', 'payload', 'tags', 'geo',
                 'amount', 'note'), n) as column_name""",
            """case n
                 when 1 then 'INT64'
                 when 2 then element_at(array('TIMESTAMP', 'DATE', 'DATETIME'), cast(p % 3 + 1 as int))
                 when 3 then if(p % 2 = 0, concat('STRING(', p % 90 + 10, ')'), 'STRING')
                 when 4 then element_at(array('STRUCT<a INT64, b STRING>', 'json', 'RECORD', 'BYTES'), cast(p % 4 + 1 as int))
                 when 5 then 'ARRAY<STRING>'
                 when 6 then 'GEOGRAPHY'
                 when 7 then element_at(array('NUMERIC(10,2)', 'BIGNUMERIC', 'FLOAT64', 'BOOL', 'INTERVAL'), cast(p % 5 + 1 as int))
                 else 'MYSTERY' end as data_type""",
            "n <> 1 as is_nullable",
            "n as ordinal_position",
            "n = 2 and p % 3 = 0 as is_partitioning_column",
            "if(n = 3 and p % 10 = 0, array('pii', concat('tag_', p % 4)), cast(array() as array<string>)) as policy_tags",
        )
    )


CATALOG_COLUMNS = """catalog_columns AS (
  SELECT p AS table_id,
    [CASE WHEN p % 2 = 0 THEN 'id' ELSE 'row_key' END, 'created_date', 'Name', 'payload', 'tags', 'geo',
     'amount', 'note'][n] AS column_name,
    CASE n
      WHEN 1 THEN 'INT64'
      WHEN 2 THEN ['TIMESTAMP', 'DATE', 'DATETIME'][p % 3 + 1]
      WHEN 3 THEN CASE WHEN p % 2 = 0 THEN 'STRING(' || (p % 90 + 10) || ')' ELSE 'STRING' END
      WHEN 4 THEN ['STRUCT<a INT64, b STRING>', 'json', 'RECORD', 'BYTES'][p % 4 + 1]
      WHEN 5 THEN 'ARRAY<STRING>'
      WHEN 6 THEN 'GEOGRAPHY'
      WHEN 7 THEN ['NUMERIC(10,2)', 'BIGNUMERIC', 'FLOAT64', 'BOOL', 'INTERVAL'][p % 5 + 1]
      ELSE 'MYSTERY' END AS data_type,
    n <> 1 AS is_nullable, n AS ordinal_position,
    n = 2 AND p % 3 = 0 AS is_partitioning_column,
    CASE WHEN n = 3 AND p % 10 = 0 THEN ['pii', 'tag_' || (p % 4)] ELSE CAST([] AS VARCHAR[]) END AS policy_tags
  FROM (SELECT p_partkey AS p, unnest(range(1, 4 + p_partkey % 6)) AS n FROM part))"""


def sql_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View and routine definitions, one per document; the whole text sits in a comment."""
    return (
        table(spark, sf_dir, "documents")
        .selectExpr("doc_id as i", "replace(text, '*/', '') as body")
        .selectExpr(
            "concat('ds.obj_', i) as object_name",
            "case i % 4 when 2 then 'MATERIALIZED_VIEW' when 3 then 'ROUTINE' else 'VIEW' end as object_type",
            "case when i % 4 <> 3 then null when i % 8 = 3 then 'FUNCTION' else 'PROCEDURE' end as routine_type",
            "case when i % 4 <> 3 then null when i % 8 = 3 then 'JAVASCRIPT' when i % 16 = 7 then 'PYTHON' else 'SQL' end as external_language",
            """case when i % 4 = 3 then concat(
                 'CREATE PROCEDURE p() BEGIN\n/* ', body, '\n*/\n',
                 if(i % 48 = 7, 'from pyspark.sql import SparkSession\n', ''),
                 'CALL `ds.obj_', i div 2, '`(1); call audit.log_', i % 3, '(COUNTIF(x));\nINSERT INTO ds.out_', i % 9,
                 ' SELECT COUNTIF(x), IF(y, 1, 0) FROM ds.base_', i % 50, '; END')
               else concat(
                 'CREATE VIEW v PARTITION BY DATE(created_', i % 4, ') CLUSTER BY `region`, id AS\n-- reads FROM ds.hidden_', i, '\n/* ', body, '\n*/\n',
                 'WITH recent AS (SELECT * FROM ds.base_', i % 50, ')\n',
                 'SELECT SAFE_DIVIDE(a, 2), ds.fmt_', i % 5, '(b), my_clean(c), \\'FROM ds.fake\\' AS lit\n',
                 'FROM recent r LEFT JOIN `ds`.`obj_', i div 2, '` o ON r.id = o.id',
                 if(i % 50 = 8, concat(' JOIN ds.obj_', 2 * i, ' p ON p.id = r.id'), ''),
                 if(i % 9 = 0, ' CROSS JOIN UNNEST(o.tags) QUALIFY 1 = 1', ''))
               end as definition""",
        )
    )


SQL_OBJECTS = """sql_objects AS (
  SELECT 'ds.obj_' || i AS object_name,
    CASE i % 4 WHEN 2 THEN 'MATERIALIZED_VIEW' WHEN 3 THEN 'ROUTINE' ELSE 'VIEW' END AS object_type,
    CASE WHEN i % 4 <> 3 THEN NULL WHEN i % 8 = 3 THEN 'FUNCTION' ELSE 'PROCEDURE' END AS routine_type,
    CASE WHEN i % 4 <> 3 THEN NULL WHEN i % 8 = 3 THEN 'JAVASCRIPT' WHEN i % 16 = 7 THEN 'PYTHON' ELSE 'SQL' END AS external_language,
    CASE WHEN i % 4 = 3 THEN
      'CREATE PROCEDURE p() BEGIN' || chr(10) || '/* ' || body || chr(10) || '*/' || chr(10) ||
      CASE WHEN i % 48 = 7 THEN 'from pyspark.sql import SparkSession' || chr(10) ELSE '' END ||
      'CALL `ds.obj_' || (i // 2) || '`(1); call audit.log_' || (i % 3) || '(COUNTIF(x));' || chr(10) || 'INSERT INTO ds.out_' || (i % 9) ||
      ' SELECT COUNTIF(x), IF(y, 1, 0) FROM ds.base_' || (i % 50) || '; END'
    ELSE
      'CREATE VIEW v PARTITION BY DATE(created_' || (i % 4) || ') CLUSTER BY `region`, id AS' || chr(10) ||
      '-- reads FROM ds.hidden_' || i || chr(10) || '/* ' || body || chr(10) || '*/' || chr(10) ||
      'WITH recent AS (SELECT * FROM ds.base_' || (i % 50) || ')' || chr(10) ||
      'SELECT SAFE_DIVIDE(a, 2), ds.fmt_' || (i % 5) || '(b), my_clean(c), ''FROM ds.fake'' AS lit' || chr(10) ||
      'FROM recent r LEFT JOIN `ds`.`obj_' || (i // 2) || '` o ON r.id = o.id' ||
      CASE WHEN i % 50 = 8 THEN ' JOIN ds.obj_' || (2 * i) || ' p ON p.id = r.id' ELSE '' END ||
      CASE WHEN i % 9 = 0 THEN ' CROSS JOIN UNNEST(o.tags) QUALIFY 1 = 1' ELSE '' END
    END AS definition
  FROM (SELECT doc_id AS i, replace(text, '*/', '') AS body FROM documents))"""


def load_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load history rows, one per order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as load_id",
        "o_custkey % 40 as migration_id",
        "concat('ds_', o_custkey % 7) as schema_name",
        "concat('tbl_', o_custkey % 60) as table_name",
        "case o_orderstatus when 'F' then 'completed' when 'O' then 'failed' else 'running' end as status",
        "o_orderdate + make_dt_interval(0, 0, 0, cast(o_orderkey % 86400 as int)) as started_at",
        "cast(floor(o_totalprice) as bigint) as rows_loaded",
        "cast(floor(o_totalprice) as bigint) * 128 as bytes_loaded",
        "cast(o_orderkey % 3 as int) as stage",
    )


LOAD_LOG = """load_log AS (
  SELECT o_orderkey AS load_id, o_custkey % 40 AS migration_id, 'ds_' || (o_custkey % 7) AS schema_name,
    'tbl_' || (o_custkey % 60) AS table_name,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status,
    o_orderdate + to_seconds(o_orderkey % 86400) AS started_at,
    CAST(floor(o_totalprice) AS BIGINT) AS rows_loaded,
    CAST(floor(o_totalprice) AS BIGINT) * 128 AS bytes_loaded,
    CAST(o_orderkey % 3 AS INTEGER) AS stage
  FROM orders)"""


def with_views(*parts_then_body: str) -> str:
    """``WITH view, view body`` from SQL fragments, the last one being the body."""
    *parts, body = parts_then_body
    return "WITH " + ",\n".join(parts) + "\n" + body


def now_literal():
    from pyspark.sql import functions as F

    return F.lit(NOW).cast("timestamp_ntz")
