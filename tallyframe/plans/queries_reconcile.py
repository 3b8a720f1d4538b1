"""Registered queries: comparing tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import digests, parity, records, report, schema
from tallyframe.plans import views as v
from tallyframe.plans.registry import ORACLES, query
from tallyframe.session import work_path


def _pair(spark, sf):
    return v.table(spark, sf, "orders"), v.orders_target(spark, sf)


@query("rowcount_parity", v.with_views(v.ORDERS_TARGET, """
SELECT s AS source_count, t AS target_count, abs(s - t) AS difference,
       round_even(abs(s - t)::DOUBLE / s * 100, 5) AS percentage_difference,
       CASE WHEN s = t THEN 'passed' ELSE 'failed' END AS status
FROM (SELECT (SELECT count(*) FROM orders) s, (SELECT count(*) FROM orders_target) t)"""))  # fmt: skip
def rowcount(spark, sf):
    return parity.rowcount_parity(*_pair(spark, sf))


@query("null_parity", v.with_views(v.ORDERS_TARGET, """
SELECT 'o_orderpriority' AS column_name, s AS source_null_count, t AS target_null_count, s - t AS difference,
       CASE WHEN s = t THEN 'passed' ELSE 'failed' END AS status
FROM (SELECT (SELECT count(*) FROM orders WHERE o_orderpriority IS NULL) s,
             (SELECT count(*) FROM orders_target WHERE o_orderpriority IS NULL) t)"""))  # fmt: skip
def nulls(spark, sf):
    return parity.null_parity(*_pair(spark, sf), "o_orderpriority")


@query("sample_identifier", v.with_views(v.ORDERS_TARGET, """
SELECT 'null_in_target' AS discrepancy, row_identifier FROM (
  SELECT '{"o_orderkey":"' || o_orderkey || '","o_custkey":"' || o_custkey || '","o_orderstatus":"' || o_orderstatus || '"}' AS row_identifier
  FROM orders_target WHERE o_orderpriority IS NULL ORDER BY row_identifier LIMIT 100)"""))  # fmt: skip
def null_rows(spark, sf):
    return parity.null_samples(*_pair(spark, sf), "o_orderpriority")


@query("duplicate_parity", """
WITH s AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1),
     t AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY ALL HAVING count(*) > 1)
SELECT s AS source_duplicate_count, t AS target_duplicate_count, s - t AS difference,
       CASE WHEN s = t THEN 'passed' ELSE 'failed' END AS status
FROM (SELECT (SELECT count(*) FROM s) s, (SELECT count(*) FROM t) t)""")  # fmt: skip
def duplicates(spark, sf):
    source = v.table(spark, sf, "lineitem")
    return parity.duplicate_parity(source, source.filter("l_partkey % 5 <> 0"), ["l_orderkey", "l_linenumber"])


@query("aggregate_parity", v.with_views(v.ORDERS_TARGET, """, m AS (
  SELECT (SELECT sum(CAST(o_totalprice AS DECIMAL(28,6))) FROM orders)::DOUBLE s,
         (SELECT sum(CAST(o_totalprice AS DECIMAL(28,6))) FROM orders_target)::DOUBLE t,
         (SELECT count(*) FROM orders) n, (SELECT count(*) FROM orders_target) m)
SELECT 'o_totalprice' AS column_name, kind AS aggregate_type, round(a, 4) AS source_value, round(b, 4) AS target_value,
       round(a - b, 4) AS difference, CASE WHEN abs(a - b) <= 0.000001 THEN 'passed' ELSE 'failed' END AS status,
       '0/0/0' AS source_not_finite, '0/0/0' AS target_not_finite
FROM (SELECT 'SUM' AS kind, s AS a, t AS b FROM m UNION ALL SELECT 'AVERAGE', s / n, t / m FROM m)"""))  # fmt: skip
def aggregates(spark, sf):
    source, target = _pair(spark, sf)
    frames = [parity.aggregate_parity(source, target, "o_totalprice", k) for k in ("SUM", "AVERAGE")]
    result = schema.union_all(frames)
    return result.select(
        "column_name",
        "aggregate_type",
        *[F.round(c, 4).alias(c) for c in ("source_value", "target_value", "difference")],
        "status", "source_not_finite", "target_not_finite",
    )


@query("aggregate_parity_odd_values", """
WITH o AS (SELECT o_orderkey % 5 AS k, o_custkey AS c FROM orders),
n AS (SELECT count(*) FILTER (k = 0) nan, count(*) FILTER (k = 1) inf, sum(c) FILTER (k = 2) AS small, sum(c) FILTER (k = 3) AS large FROM o)
SELECT 'tiny' AS what, CASE WHEN small * 3e-7 <= 0.000001 THEN 'passed' ELSE 'failed' END AS status, '0/0/0' AS source_not_finite, '0/0/0' AS target_not_finite FROM n
UNION ALL SELECT 'nan', CASE WHEN nan = 0 THEN 'passed' ELSE 'failed' END, nan || '/0/0', '0/0/0' FROM n
UNION ALL SELECT 'infinite', CASE WHEN inf = 0 THEN 'passed' ELSE 'failed' END, '0/' || inf || '/0', '0/0/' || inf FROM n
UNION ALL SELECT 'same', 'passed', nan || '/' || inf || '/0', nan || '/' || inf || '/0' FROM n
UNION ALL SELECT 'bigint', 'passed', '0/0/0', '0/0/0' FROM n""")  # fmt: skip
def odd_aggregates(spark, sf):
    """Values of 1e-7, NaN, infinities, 1e20, and whole numbers whose sum exceeds 64 bits."""
    rows = v.table(spark, sf, "orders").selectExpr("o_orderkey % 5 as k", "o_custkey as c")

    def pick(when: str, value: str):
        return rows.selectExpr(f"case when {when} then {value} end as x")

    odd = "case k when 0 then double('NaN') when 1 then double('Infinity') when 2 then c * 1e-7 when 3 then c * 1e20 end"
    mixed = rows.selectExpr(f"{odd} as x")
    big = rows.selectExpr("9000000000000000000 + k as x")
    pairs = {
        "tiny": (pick("k = 2", "c * 1e-7"), pick("k = 2", "c * 4e-7")),
        "nan": (pick("k = 0 or k = 3", "if(k = 0, double('NaN'), 5D)"), pick("k = 3", "5D")),
        "infinite": (pick("k = 1", "double('Infinity')"), pick("k = 1", "double('-Infinity')")),
        "same": (mixed, mixed.repartition(3)),
        "bigint": (big, big),
    }
    frames = [parity.aggregate_parity(s, t, "x", "SUM").withColumn("what", F.lit(n)) for n, (s, t) in pairs.items()]
    return schema.union_all(frames).select("what", "status", "source_not_finite", "target_not_finite")


_MATCH = """, s AS (SELECT o_orderkey, any_value(orders) AS r FROM orders GROUP BY 1),
t AS (SELECT o_orderkey, max(o_custkey) c, max(o_orderstatus) st, max(o_totalprice) p, max(o_orderdate) d, max(o_orderpriority) pr
      FROM orders_target GROUP BY 1),
j AS (SELECT s.o_orderkey sk, t.o_orderkey tk,
        r.o_custkey IS NOT DISTINCT FROM c AND r.o_orderstatus IS NOT DISTINCT FROM st AND r.o_totalprice IS NOT DISTINCT FROM p
        AND r.o_orderdate IS NOT DISTINCT FROM d AND r.o_orderpriority IS NOT DISTINCT FROM pr AS same
      FROM s FULL JOIN t ON s.o_orderkey = t.o_orderkey)"""


@query("record_match_pk", v.with_views(v.ORDERS_TARGET, _MATCH + """
SELECT count(sk) AS total_compared, count(*) FILTER (sk = tk AND same) AS matched_count,
  count(*) FILTER (tk IS NULL) AS missing_count, count(*) FILTER (sk IS NULL) AS extra_count,
  count(*) FILTER (sk = tk AND NOT same) AS mismatch_count, 0::BIGINT AS source_duplicate_keys,
  (SELECT count(*) FROM (SELECT 1 FROM orders_target GROUP BY o_orderkey HAVING count(*) > 1)) AS target_duplicate_keys,
  CASE WHEN count(*) = count(*) FILTER (sk = tk AND same) THEN 'passed' ELSE 'failed' END AS status
FROM j"""))  # fmt: skip
def match_pk(spark, sf):
    return records.record_match_pk(*_pair(spark, sf), ["o_orderkey"])


@query("record_match_kept", ORACLES["record_match_pk"].replace("SELECT count(sk) AS total_compared,", "SELECT count(sk) AS total_compared, 0 AS read_again,"))
def match_kept(spark, sf):
    """By kept digests of both sides; the second comparison reads no partition for digests."""
    made = []
    for label, df in zip(("source", "target"), _pair(spark, sf), strict=True):
        side = digests.Side(work_path(spark, f"kept-{label}"), "o_orderstatus", work_path(spark, f"digests-{label}"))
        df.write.partitionBy("o_orderstatus").parquet(side.path)
        made.append(side)
    digests.record_match_kept(spark, *made, ["o_orderkey"])
    counts, read = digests.record_match_kept(spark, *made, ["o_orderkey"])
    return counts.withColumn("read_again", F.lit(len(read["source"]) + len(read["target"])))


@query("record_match_composite", """
WITH t AS (SELECT * FROM conversations WHERE (conv_id * 31 + turn) % 17 <> 0)
SELECT count(*) AS total_compared, count(*) FILTER (t.conv_id IS NOT NULL AND (s.conv_id + s.turn) % 11 <> 0) AS matched_count,
  count(*) FILTER (t.conv_id IS NULL) AS missing_count, 0::BIGINT AS extra_count,
  count(*) FILTER (t.conv_id IS NOT NULL AND (s.conv_id + s.turn) % 11 = 0) AS mismatch_count,
  0::BIGINT AS source_duplicate_keys, 0::BIGINT AS target_duplicate_keys, 'failed' AS status
FROM conversations s LEFT JOIN t ON s.conv_id = t.conv_id AND s.turn = t.turn""")  # fmt: skip
def match_composite(spark, sf):
    source = v.table(spark, sf, "conversations")
    target = source.filter("(conv_id * 31 + turn) % 17 <> 0").withColumn(
        "text", F.expr("if((conv_id + turn) % 11 = 0, concat(text, '!'), text)")
    )
    return records.record_match_pk(source, target.withColumn("turn", F.col("turn").cast("string")), ["conv_id", "turn"])


@query("record_match_hash", v.with_views(v.ORDERS_TARGET, """,
s AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, count(*) n FROM orders GROUP BY ALL),
t AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, count(*) n FROM orders_target GROUP BY ALL),
j AS (SELECT s.n sn, t.n tn FROM s FULL JOIN t ON s.o_orderkey = t.o_orderkey AND s.o_custkey = t.o_custkey
      AND s.o_orderstatus = t.o_orderstatus AND s.o_orderpriority IS NOT DISTINCT FROM t.o_orderpriority)
SELECT count(sn) AS total_compared, count(*) FILTER (sn IS NOT NULL AND tn IS NOT NULL) AS matched_count,
  count(*) FILTER (tn IS NULL) AS missing_count, count(*) FILTER (sn IS NULL) AS extra_count, 0::BIGINT AS mismatch_count,
  count(*) FILTER (sn > 1) AS source_duplicate_keys, count(*) FILTER (tn > 1) AS target_duplicate_keys, 'failed' AS status
FROM j"""))  # fmt: skip
def match_hash(spark, sf):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    source, target = _pair(spark, sf)
    return records.record_match_hash(source.select(*columns), target.select(*columns))


@query("rows_missing", v.with_views(v.ORDERS_TARGET, """
SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders_target)"""))  # fmt: skip
def missing(spark, sf):
    return records.rows_missing(*_pair(spark, sf), ["o_orderkey"])


@query("rows_extra", v.with_views(v.ORDERS_TARGET, """
SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders_target
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)"""))  # fmt: skip
def extra(spark, sf):
    return records.rows_extra(*_pair(spark, sf), ["o_orderkey"])


@query("value_diff", v.with_views(v.ORDERS_TARGET, _MATCH + """
SELECT CAST(s.o_orderkey AS VARCHAR) AS o_orderkey, x.* FROM s JOIN t ON s.o_orderkey = t.o_orderkey,
  LATERAL (SELECT 3 AS position, 'o_totalprice' AS column_name, r.o_totalprice AS source_number, p AS target_number, NULL AS source_text, NULL AS target_text
             WHERE r.o_totalprice <> p
           UNION ALL SELECT 5, 'o_orderpriority', NULL, NULL, r.o_orderpriority, pr WHERE r.o_orderpriority IS DISTINCT FROM pr) x"""))  # fmt: skip
def differences(spark, sf):
    found = records.value_diff(*_pair(spark, sf), ["o_orderkey"])
    number = F.col("column_name") == "o_totalprice"
    sides = [c for s in ("source", "target") for c in (F.when(number, F.col(f"{s}_value").cast("double")).alias(f"{s}_number"), F.when(~number, F.col(f"{s}_value")).alias(f"{s}_text"))]
    return found.select("o_orderkey", "position", "column_name", *sides)


@query("record_samples", v.with_views(v.ORDERS_TARGET, _MATCH + """
SELECT CASE WHEN tk IS NULL THEN 'missing_in_target' WHEN sk IS NULL THEN 'extra_in_target' ELSE 'value_mismatch' END AS discrepancy,
  CAST(coalesce(sk, tk) AS VARCHAR) AS o_orderkey,
  CASE WHEN sk = tk THEN CASE WHEN sk % 101 = 0 THEN 'o_totalprice' ELSE 'o_orderpriority' END END AS column_name
FROM j WHERE NOT coalesce(same AND sk = tk, false) ORDER BY (sk IS NULL)::INT, CAST(coalesce(sk, tk) AS VARCHAR) LIMIT 100"""))  # fmt: skip
def samples(spark, sf):
    return records.record_samples(*_pair(spark, sf), ["o_orderkey"]).select("discrepancy", "o_orderkey", "column_name")


@query("record_match_range", """
WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE rn BETWEEN 101 AND 1100)
SELECT count(*) AS total_compared,
  count(*) FILTER (o_orderkey % 97 <> 0 AND o_orderkey % 101 <> 0) AS matched_count,
  count(*) FILTER (o_orderkey % 97 = 0) AS missing_count, 0::BIGINT AS extra_count,
  count(*) FILTER (o_orderkey % 97 <> 0 AND o_orderkey % 101 = 0) AS mismatch_count,
  0::BIGINT AS source_duplicate_keys, 0::BIGINT AS target_duplicate_keys, 'failed' AS status FROM s""")  # fmt: skip
def match_range(spark, sf):
    source = v.table(spark, sf, "orders")
    target = source.filter("o_orderkey % 97 <> 0").withColumn(
        "o_totalprice", F.expr("if(o_orderkey % 101 = 0, o_totalprice + 1, o_totalprice)")
    )
    return records.record_match_range(source, target, ["o_orderkey"], 101, 1100)


@query("positional_slice", """
SELECT l_orderkey, l_partkey, l_suppkey, position FROM (
  SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey) AS position
  FROM lineitem) WHERE position BETWEEN 20001 AND 40000""")  # fmt: skip
def slice_(spark, sf):
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    return records.positional_slice(v.table(spark, sf, "lineitem").select(*keys), keys, 20001, 40000)


def _damaged_columns(columns):
    """The catalog with columns lost, added, retyped and made mandatory."""
    kept = columns.filter("not (ordinal_position = 3 and table_id % 6 = 0)").selectExpr(
        "table_id",
        "upper(column_name) as column_name",
        "case when column_name = 'amount' and table_id % 4 = 0 then 'VARCHAR' else data_type end as data_type",
        "is_nullable and not (ordinal_position = 2 and table_id % 8 = 0) as is_nullable",
    )
    added = columns.filter("ordinal_position = 1 and table_id % 9 = 0").selectExpr(
        "table_id", "'loaded_at' as column_name", "'TIMESTAMP' as data_type", "true as is_nullable"
    )
    return kept.unionByName(added)


_DAMAGED = """damaged AS (
  SELECT table_id, upper(column_name) AS column_name,
    CASE WHEN column_name = 'amount' AND table_id % 4 = 0 THEN 'VARCHAR' ELSE data_type END AS data_type,
    is_nullable AND NOT (ordinal_position = 2 AND table_id % 8 = 0) AS is_nullable
  FROM catalog_columns WHERE NOT (ordinal_position = 3 AND table_id % 6 = 0)
  UNION ALL SELECT table_id, 'loaded_at', 'TIMESTAMP', true FROM catalog_columns WHERE ordinal_position = 1 AND table_id % 9 = 0)"""


@query("schema_diff", v.with_views(v.CATALOG_COLUMNS, _DAMAGED, """,
j AS (SELECT coalesce(s.table_id, t.table_id) AS table_id, s.column_name sn, t.column_name tn, s.data_type sd, t.data_type td,
        s.is_nullable si, t.is_nullable ti
      FROM catalog_columns s FULL JOIN damaged t ON s.table_id = t.table_id AND lower(s.column_name) = lower(t.column_name))
SELECT table_id, 'missing_column' AS discrepancy, sn AS column_name, sd AS source_type, NULL AS target_type,
  CASE sd WHEN 'STRING' THEN 'VARCHAR' END AS expected_type FROM j WHERE tn IS NULL
UNION ALL SELECT table_id, 'extra_column', tn, NULL, td, NULL FROM j WHERE sn IS NULL
UNION ALL SELECT table_id, 'type_mismatch', sn, sd, td, NULL FROM j WHERE sn = 'amount' AND table_id % 4 = 0
UNION ALL SELECT table_id, 'nullability_mismatch', sn, 'True', 'False', NULL FROM j WHERE si AND NOT ti"""))  # fmt: skip
def schemas(spark, sf):
    columns = v.catalog_columns(spark, sf)
    return schema.schema_diff(columns, _damaged_columns(columns), by=["table_id"])


@query("name_set_diff", v.with_views(v.CATALOG_TABLES, """,
a AS (SELECT DISTINCT lower(table_name) n FROM catalog_tables WHERE table_id % 3 <> 0),
b AS (SELECT DISTINCT lower(table_name) n FROM catalog_tables WHERE table_id % 4 <> 0)
SELECT coalesce(a.n, b.n) AS name, CASE WHEN b.n IS NULL THEN 'left_only' ELSE 'right_only' END AS held_by
FROM a FULL JOIN b ON a.n = b.n WHERE a.n IS NULL OR b.n IS NULL"""))  # fmt: skip
def names(spark, sf):
    tables = v.catalog_tables(spark, sf)
    return schema.name_set_diff(tables.filter("table_id % 3 <> 0"), tables.filter("table_id % 4 <> 0"), "table_name")


_CHECKS = {
    "row_count": True,
    "schema_check": True,
    "null_check": "o_orderpriority",
    "duplicate_check": ["o_orderkey"],
    "sum_check": "o_custkey",
    "average_check": "no_such_column",
    "record_match": ["o_orderkey"],
    "specific_row_check": ("o_custkey", 1, 10),
}


@query("validation_report", v.with_views(v.ORDERS_TARGET, _MATCH + """,
n AS (SELECT (SELECT count(*) FROM orders) a, (SELECT count(*) FROM orders_target) b),
r(check_name, s, t) AS (
  SELECT 'row_count', a::DOUBLE, b::DOUBLE FROM n
  UNION ALL SELECT 'null_check', 0, count(*) FROM orders_target WHERE o_orderpriority IS NULL
  UNION ALL SELECT 'duplicate_check', 0, count(*) FROM (SELECT 1 FROM orders_target GROUP BY o_orderkey HAVING count(*) > 1)
  UNION ALL SELECT 'sum_check', (SELECT sum(o_custkey) FROM orders)::DOUBLE, (SELECT sum(o_custkey) FROM orders_target)::DOUBLE
  UNION ALL SELECT 'average_check', NULL, NULL
  UNION ALL SELECT 'specific_row_check', NULL, NULL
  UNION ALL SELECT 'schema_check', 6, 6
  UNION ALL SELECT 'record_match', count(sk), count(*) FILTER (sk = tk AND same) FROM j)
SELECT 'error' AS overall_status, check_name,
  CASE WHEN s IS NULL THEN 'error' WHEN s = t THEN 'passed' ELSE 'failed' END AS status,
  s AS source_value, t AS target_value, CASE WHEN check_name = 'row_count' THEN abs(s - t) ELSE s - t END AS difference FROM r"""))  # fmt: skip
def one_report(spark, sf):
    return report.validation_report(*_pair(spark, sf), _CHECKS)


@query("validation_run", v.with_views(v.ORDERS_TARGET, """
SELECT 'orders' AS table_name, 'failed' AS table_status, 3::BIGINT AS checks_run, 3::BIGINT AS checks_failed
UNION ALL SELECT 'customer', 'completed', 3, 0 WHERE (SELECT count(*) FROM customer) > 0
UNION ALL SELECT 'part', 'error', 2, CASE WHEN (SELECT count(*) FROM part WHERE p_partkey % 2 = 0) > 0 THEN 1 ELSE 0 END
UNION ALL SELECT 'supplier', 'completed', 0, 0 UNION ALL SELECT 'unreadable', 'error', 1, 0"""))  # fmt: skip
def many_tables(spark, sf):
    return _run(spark, sf)


@query("validation_run_status", v.with_views(v.ORDERS_TARGET, """
SELECT 5::BIGINT AS tables_total, 2::BIGINT AS tables_passed, 1::BIGINT AS tables_failed, 2::BIGINT AS tables_error, 'error' AS run_status
FROM (SELECT count(*) c FROM orders_target) WHERE c > 0"""))  # fmt: skip
def whole_run(spark, sf):
    return report.run_status(_run(spark, sf))


def _run(spark, sf):
    def plain(name, checks):
        return lambda: (v.table(spark, sf, name), v.table(spark, sf, name), checks)

    def halved():
        part = v.table(spark, sf, "part")
        return part, part.filter("p_partkey % 2 = 1"), {"row_count": True, "null_check": "absent"}

    return report.validation_run(
        spark,
        {
            "orders": lambda: (*_pair(spark, sf), {"row_count": True, "null_check": "o_orderpriority", "record_match": ["o_orderkey"]}),
            "customer": plain("customer", {"row_count": True, "sum_check": "c_acctbal", "record_match": ["c_custkey"]}),
            "part": halved,
            "supplier": plain("supplier", {}),
            "unreadable": plain("unreadable", {"row_count": True}),
        },
    )
