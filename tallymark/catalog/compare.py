"""Queries: comparison of two datasets by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.catalog import inputs
from tallymark.operators import diff, keys, profile
from tallymark.plans.reconcile import Comparison, compare_files as golden, reconcile, reconcile_many
from tallymark.session import scratch_path
from tallymark.sources.writers import write_delimited, write_report

_MATCHED_ORDERS = "matched AS (SELECT s.*, t.* RENAME (" + ", ".join(
    f"{c} AS t_{c}" for c in [*inputs.ORDER_KEY, *inputs.ORDER_COLUMNS]
) + ") FROM orders s JOIN tgt t ON s.o_orderkey IS NOT DISTINCT FROM t.o_orderkey)"


def _order_pairs(spark: SparkSession, sf_dir: str, **options: str) -> diff.PairedRows:
    source, target = inputs.orders_pair(spark, sf_dir)
    return diff.pair_rows(source, target, inputs.ORDER_KEY, **options)


def count_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.count_validation(*inputs.orders_pair(spark, sf_dir))


def overlap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = inputs.lines_pair(spark, sf_dir)
    return profile.overlap_summary(source, target, inputs.LINE_KEY)


def shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = inputs.orders_pair(spark, sf_dir)
    return keys.shared_keys(source, target, inputs.ORDER_KEY)


def unmatched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = inputs.orders_pair(spark, sf_dir)
    return keys.unmatched_keys(source, target, inputs.ORDER_KEY)


def restrict_to_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = inputs.lines_pair(spark, sf_dir)
    return keys.restrict_to_shared(source, target, inputs.LINE_KEY)


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.column_stats(_order_pairs(spark, sf_dir))


def column_stats_sql_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.column_stats(_order_pairs(spark, sf_dir, null_mode="sql"))


def column_stats_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = inputs.lines_pair(spark, sf_dir)
    return diff.column_stats(diff.pair_rows(source, target, inputs.LINE_KEY, pairing="occurrence"))


def _occurrence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = inputs.lines_pair(spark, sf_dir)
    return diff.row_diff(diff.pair_rows(source, target, inputs.LINE_KEY, pairing="occurrence"))


def row_diff_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readable(_occurrence_rows(spark, sf_dir))


def cell_diff_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = diff.cell_diff(_occurrence_rows(spark, sf_dir)).where("column IS NOT NULL")
    return cells.select(*inputs.LINE_KEY, "occurrence", F.col("column").alias("column_name"))


def column_stats_mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys above 2^53 as long and as decimal, and long cells next to doubles, which cannot hold every long."""
    orders = inputs.table(spark, sf_dir, "orders")
    big = F.col("o_orderkey") + F.lit(1 << 53)
    source = orders.select(big.alias("k"), big.alias("v"), F.col("o_custkey").alias("w"))
    target = orders.select(big.cast("decimal(20,0)").alias("k"), big.cast("double").alias("v"), F.col("o_custkey").cast("double").alias("w"))
    return diff.column_stats(diff.pair_rows(source, target, ["k"]))


def _readable(rows: DataFrame) -> DataFrame:
    names = F.array_join(F.array_sort(F.col("differences.column")), ",")
    return rows.withColumn("changed", names).drop("differences")


def row_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readable(diff.row_diff(_order_pairs(spark, sf_dir)))


def row_diff_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = inputs.lines_pair(spark, sf_dir)
    return _readable(diff.row_diff(diff.pair_rows(source, target, inputs.LINE_KEY, pairing="first")))


def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_summary(diff.row_diff(_order_pairs(spark, sf_dir)))


def cell_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.cell_diff(diff.row_diff(_order_pairs(spark, sf_dir))).withColumnRenamed("column", "column_name")


def mismatch_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.mismatch_sample(_order_pairs(spark, sf_dir))


def flagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = inputs.orders_pair(spark, sf_dir)
    found = diff.row_diff(diff.pair_rows(source, target, inputs.ORDER_KEY))
    flagged = diff.flag_rows(target, found, inputs.ORDER_KEY, "target")
    return flagged.select("o_orderkey", "row_missing", F.array_join("changed_columns", ",").alias("changed"))


def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.table(spark, sf_dir, "lineitem")
    return diff.first_match(lines, inputs.LINE_KEY, inputs.LINE_COLUMNS)


def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.null_profile(inputs.orders_pair(spark, sf_dir)[1])


def duplicate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_profile(inputs.table(spark, sf_dir, "lineitem"), inputs.LINE_KEY)


_SUMMARY_RULES = [
    {"column": "o_orderpriority", "rule": "not_null"},
    {"column": "o_totalprice", "rule": "range", "min": 0},
]


def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = inputs.orders_pair(spark, sf_dir)
    done = reconcile(source, target, inputs.ORDER_KEY, rules=_SUMMARY_RULES)
    return done.summary.select("validation_type", "status")


def reconcile_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the summary."""
    source, target = inputs.orders_pair(spark, sf_dir)
    done = reconcile(source, target, inputs.ORDER_KEY, rules=_SUMMARY_RULES, write_pairs=True)
    return done.summary.select("validation_type", "details")


def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column statistics written as a report table and read again."""
    source, target = inputs.orders_pair(spark, sf_dir)
    done = reconcile(source, target, inputs.ORDER_KEY)
    path = scratch_path(spark, "report")
    write_report({"column_stats": done.column_stats, "nulls": done.null_profile}, path)
    return spark.read.parquet(f"{path}/column_stats")


def recommendation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = inputs.orders_pair(spark, sf_dir)
    return reconcile(source, target, inputs.ORDER_KEY).recommendations.select("kind", "recommendation")


def reconcile_discovered_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No key given and only two validations asked for."""
    source, target = inputs.orders_pair(spark, sf_dir)
    done = reconcile(source, target, validations=["Count", "Nulls"])
    return done.summary.select("validation_type", "status", F.lit(",".join(done.keys)).alias("key_columns"))


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = inputs.orders_pair(spark, sf_dir)
    return reconcile(source, target, inputs.ORDER_KEY).recommendations.select("kind", "column_name")


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = inputs.orders_pair(spark, sf_dir)
    customers = inputs.table(spark, sf_dir, "customer")
    runs = [
        Comparison("orders", source, target, inputs.ORDER_KEY),
        Comparison("customers", customers, customers, ["c_custkey"]),
    ]
    return reconcile_many(runs).select("test_case_name", "validation_type", "status")


def compare_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides as CSV files, all columns text; an empty cell reads as null."""
    paths = []
    for side, df in zip(("source", "target"), inputs.orders_pair(spark, sf_dir)):
        paths.append(scratch_path(spark, f"orders-{side}"))
        write_delimited(df, paths[-1])
    done = golden(spark, {"fmt": "csv", "path": paths[0]}, {"fmt": "csv", "path": paths[1]}, inputs.ORDER_KEY)
    return done.column_stats


def _stats_sql(matched: str, columns: list[str], differs: str) -> str:
    parts = []
    for c in columns:
        d = differs.format(c=c)
        parts.append(f"""
  SELECT '{c}' AS column_name, count(*) AS total_records,
         count(*) FILTER ({c} IS NULL) AS source_null_count, count({c}) AS source_not_null_count,
         count(*) FILTER (t_{c} IS NULL) AS target_null_count, count(t_{c}) AS target_not_null_count,
         count(*) - count(*) FILTER ({d}) AS pass_count
  FROM {matched}""")
    return f"""stats AS ({" UNION ALL ".join(parts)})
SELECT *, CASE WHEN total_records > 0 THEN pass_count / total_records * 100 ELSE 0 END AS pass_percentage,
       CASE WHEN total_records > 0 AND pass_count = total_records THEN 'PASS' ELSE 'FAIL' END AS status
FROM stats"""


_DISTINCT = "{c} IS DISTINCT FROM t_{c}"
_UNEQUAL = "{c} <> t_{c}"


def _changed(columns: list[str], source: str = "s", target: str = "t") -> str:
    cells = ", ".join(
        f"CASE WHEN {source}.{c} IS DISTINCT FROM {target}.{c} THEN '{c}' END" for c in sorted(columns)
    )
    return f"concat_ws(',', {cells})"


_DIFF = f"""rows AS (
  SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
         CASE WHEN t.o_orderkey IS NULL THEN 'missing_in_target'
              WHEN s.o_orderkey IS NULL THEN 'missing_in_source' ELSE 'values_differ' END AS status,
         CASE WHEN s.o_orderkey IS NULL OR t.o_orderkey IS NULL THEN '' ELSE {_changed(inputs.ORDER_COLUMNS)} END AS changed
  FROM orders s FULL JOIN tgt t ON s.o_orderkey = t.o_orderkey
), diff AS (SELECT * FROM rows WHERE status <> 'values_differ' OR changed <> '')"""

_CELLS = "cells AS (" + " UNION ALL ".join(
    f"""
  SELECT o_orderkey, 'values_differ' AS status, '{c}' AS column_name,
         CAST({c} AS VARCHAR) AS source_value, CAST(t_{c} AS VARCHAR) AS target_value
  FROM matched WHERE {c} IS DISTINCT FROM t_{c}""" for c in inputs.ORDER_COLUMNS
) + ")"

_LINE_ORDER = ", ".join(f"{c} NULLS FIRST" for c in inputs.LINE_COLUMNS)
_LINE_CELLS = ", ".join(inputs.LINE_COLUMNS)

# Equal rows cancel one by one; the others are numbered within their key.
_OCCURRENCES = f"""
cs AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, {_LINE_CELLS}) AS c FROM src),
ct AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, {_LINE_CELLS}) AS c FROM tgt),
equal AS (SELECT * FROM cs INTERSECT SELECT * FROM ct),
ns AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER}) AS n
       FROM (SELECT * FROM cs EXCEPT SELECT * FROM equal)),
nt AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER}) AS n
       FROM (SELECT * FROM ct EXCEPT SELECT * FROM equal)),
lone AS (
  SELECT coalesce(s.l_orderkey, t.l_orderkey) AS l_orderkey, coalesce(s.l_linenumber, t.l_linenumber) AS l_linenumber,
         coalesce(s.n, t.n) AS occurrence, s.n AS sn, t.n AS tn,
         {", ".join(f"s.{c}, t.{c} AS t_{c}" for c in inputs.LINE_COLUMNS)}
  FROM ns s FULL JOIN nt t ON s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber AND s.n = t.n
),
matched AS (
  SELECT {_LINE_CELLS}, {", ".join(f"{c} AS t_{c}" for c in inputs.LINE_COLUMNS)} FROM equal
  UNION ALL SELECT {_LINE_CELLS}, {", ".join(f"t_{c}" for c in inputs.LINE_COLUMNS)} FROM lone WHERE sn IS NOT NULL AND tn IS NOT NULL
)"""

_LONE_STATUS = "CASE WHEN tn IS NULL THEN 'missing_in_target' WHEN sn IS NULL THEN 'missing_in_source' ELSE 'values_differ' END"
_LONE_CHANGED = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS DISTINCT FROM t_{c} THEN '{c}' END" for c in sorted(inputs.LINE_COLUMNS)) + ")"
_LONE_CELLS = " UNION ALL ".join(
    f"""SELECT l_orderkey, l_linenumber, occurrence, '{c}' AS column_name FROM lone
    WHERE sn IS NOT NULL AND tn IS NOT NULL AND {c} IS DISTINCT FROM t_{c}""" for c in inputs.LINE_COLUMNS
)

_FIRST = f"""first_rows AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER}) AS rn FROM tgt
  ) WHERE rn = 1
), rows AS (
  SELECT s.l_orderkey, s.l_linenumber,
         CASE WHEN t.l_orderkey IS NULL THEN 'missing_in_target' ELSE 'values_differ' END AS status,
         CASE WHEN t.l_orderkey IS NULL THEN '' ELSE {_changed(inputs.LINE_COLUMNS)} END AS changed
  FROM src s LEFT JOIN first_rows t ON s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber
  UNION ALL
  SELECT t.l_orderkey, t.l_linenumber, 'missing_in_source', ''
  FROM tgt t WHERE NOT EXISTS (
    SELECT 1 FROM src s WHERE s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber)
)
SELECT * FROM rows WHERE status <> 'values_differ' OR changed <> ''"""

_NULLS = "SELECT * FROM (" + " UNION ALL ".join(
    f"""
  SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, count(*) AS total_count,
         count(*) FILTER ({c} IS NULL) / count(*) * 100 AS null_percentage FROM tgt"""
    for c in [*inputs.ORDER_KEY, *inputs.ORDER_COLUMNS]
) + ")"

_CHECKS = """
facts AS (
  SELECT (SELECT count(*) FROM orders) = (SELECT count(*) FROM tgt) AS counts,
         NOT EXISTS (SELECT 1 FROM matched WHERE o_custkey IS DISTINCT FROM t_o_custkey
           OR o_orderstatus IS DISTINCT FROM t_o_orderstatus OR o_totalprice IS DISTINCT FROM t_o_totalprice
           OR o_orderdate IS DISTINCT FROM t_o_orderdate OR o_orderpriority IS DISTINCT FROM t_o_orderpriority) AS data,
         NOT EXISTS (SELECT 1 FROM tgt WHERE o_orderkey IS NULL OR o_custkey IS NULL OR o_orderstatus IS NULL
           OR o_totalprice IS NULL OR o_orderdate IS NULL OR o_orderpriority IS NULL) AS nulls,
         (SELECT count(*) FROM tgt) = (SELECT count(*) FROM (SELECT DISTINCT o_orderkey FROM tgt)) AS duplicates,
         NOT EXISTS (SELECT 1 FROM tgt WHERE o_orderpriority IS NULL OR o_totalprice < 0) AS rules
), words AS (
  SELECT CASE WHEN counts THEN 'PASS' ELSE 'FAIL' END AS c, CASE WHEN data THEN 'PASS' ELSE 'FAIL' END AS d,
         CASE WHEN nulls THEN 'PASS' ELSE 'FAIL' END AS n, CASE WHEN duplicates THEN 'PASS' ELSE 'FAIL' END AS u,
         CASE WHEN rules THEN 'PASS' ELSE 'FAIL' END AS r
  FROM facts
)"""

_WITH = f"WITH {inputs.ORDERS_TARGET}, {_MATCHED_ORDERS}"

QUERIES = {
    "count_validation": (count_validation, f"""WITH {inputs.ORDERS_TARGET},
c AS (SELECT (SELECT count(*) FROM orders) AS source_count, (SELECT count(*) FROM tgt) AS target_count)
SELECT source_count, target_count, source_count = target_count AS count_match,
       abs(source_count - target_count) AS count_difference FROM c"""),
    "overlap_summary": (overlap_summary, f"""WITH {inputs.LINES_TARGET},
k AS (SELECT l_orderkey, l_linenumber, sum(s) AS s, sum(t) AS t FROM (
    SELECT l_orderkey, l_linenumber, 1 AS s, 0 AS t FROM src
    UNION ALL SELECT l_orderkey, l_linenumber, 0, 1 FROM tgt) GROUP BY 1, 2)
SELECT CAST(sum(s) AS BIGINT) AS source_count, CAST(sum(t) AS BIGINT) AS target_count,
       CAST(coalesce(sum(s) FILTER (t > 0), 0) AS BIGINT) AS matching_records,
       count(*) FILTER (t = 0) AS source_only, count(*) FILTER (s = 0) AS target_only,
       count(*) FILTER (s > 0) AS source_unique, count(*) FILTER (t > 0) AS target_unique FROM k"""),
    "shared_keys": (shared_keys, f"""WITH {inputs.ORDERS_TARGET}
SELECT o_orderkey FROM orders INTERSECT SELECT o_orderkey FROM tgt"""),
    "unmatched_keys": (unmatched_keys, f"""WITH {inputs.ORDERS_TARGET}
SELECT o_orderkey, 'source' AS side FROM (SELECT o_orderkey FROM orders EXCEPT SELECT o_orderkey FROM tgt)
UNION ALL
SELECT o_orderkey, 'target' FROM (SELECT o_orderkey FROM tgt EXCEPT SELECT o_orderkey FROM orders)"""),
    "restrict_to_shared": (restrict_to_shared, f"""WITH {inputs.LINES_TARGET}
SELECT * FROM src s WHERE EXISTS (
  SELECT 1 FROM tgt t WHERE t.l_orderkey = s.l_orderkey AND t.l_linenumber = s.l_linenumber)"""),
    "column_stats": (column_stats, f"{_WITH}, " + _stats_sql("matched", inputs.ORDER_COLUMNS, _DISTINCT)),
    "column_stats_sql_nulls": (column_stats_sql_nulls, f"{_WITH}, " + _stats_sql("matched", inputs.ORDER_COLUMNS, _UNEQUAL)),
    "column_stats_occurrence": (
        column_stats_occurrence,
        f"WITH {inputs.LINES_TARGET}, {_OCCURRENCES}, " + _stats_sql("matched", inputs.LINE_COLUMNS, _DISTINCT),
    ),
    "row_diff_occurrence": (
        row_diff_occurrence,
        f"""WITH {inputs.LINES_TARGET}, {_OCCURRENCES}
SELECT l_orderkey, l_linenumber, occurrence, {_LONE_STATUS} AS status,
       CASE WHEN sn IS NULL OR tn IS NULL THEN '' ELSE {_LONE_CHANGED} END AS changed FROM lone""",
    ),
    "cell_diff_occurrence": (
        cell_diff_occurrence, f"WITH {inputs.LINES_TARGET}, {_OCCURRENCES} {_LONE_CELLS}",
    ),
    "column_stats_mixed_types": (
        column_stats_mixed_types,
        """WITH matched AS (
  SELECT o_orderkey + 9007199254740992 AS v, CAST(o_orderkey + 9007199254740992 AS DOUBLE)::HUGEINT AS t_v,
         o_custkey AS w, o_custkey AS t_w FROM orders), """ + _stats_sql("matched", ["v", "w"], _DISTINCT),
    ),
    "row_diff": (row_diff, f"WITH {inputs.ORDERS_TARGET}, {_DIFF} SELECT * FROM diff"),
    "row_diff_first_match": (row_diff_first_match, f"WITH {inputs.LINES_TARGET}, {_FIRST}"),
    "diff_summary": (diff_summary, f"""WITH {inputs.ORDERS_TARGET}, {_DIFF}
SELECT status, count(*) AS row_count FROM diff GROUP BY status"""),
    "cell_diff": (cell_diff, f"""{_WITH}, {_DIFF}, {_CELLS}
SELECT * FROM cells
UNION ALL SELECT o_orderkey, status, NULL, NULL, NULL FROM diff WHERE status <> 'values_differ'"""),
    "mismatch_sample": (mismatch_sample, f"""{_WITH}, {_CELLS}
SELECT column_name, o_orderkey, source_value, target_value FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY o_orderkey) AS rn FROM cells) WHERE rn <= 100"""),
    "flagged_rows": (flagged_rows, f"""WITH {inputs.ORDERS_TARGET}, {_DIFF}
SELECT t.o_orderkey, coalesce(d.status = 'missing_in_source', false) AS row_missing, coalesce(d.changed, '') AS changed
FROM tgt t LEFT JOIN diff d ON d.o_orderkey = t.o_orderkey"""),
    "first_match": (first_match, f"""SELECT l_orderkey, l_linenumber, {_LINE_CELLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER}) AS rn FROM lineitem)
WHERE rn = 1"""),
    "null_profile": (null_profile, f"WITH {inputs.ORDERS_TARGET} {_NULLS}"),
    "duplicate_profile": (duplicate_profile, """WITH c AS (
  SELECT count(*) AS total_records, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS unique_records
  FROM lineitem)
SELECT total_records, unique_records, total_records - unique_records AS duplicate_count,
       (total_records - unique_records) / total_records * 100 AS duplicate_percentage FROM c"""),
    "reconcile_summary": (reconcile_summary, f"""{_WITH}, {_CHECKS}
SELECT unnest(['Count Validation', 'Schema Validation', 'Data Validation', 'Null Check', 'Duplicate Check',
               'Rule Validation', 'Overall Status']) AS validation_type,
       unnest([c, 'PASS', d, n, u, r, CASE WHEN 'FAIL' IN (c, d, n, u, r) THEN 'FAIL' ELSE 'PASS' END]) AS status
FROM words"""),
    "reconcile_details": (reconcile_details, f"""{_WITH}, {_CELLS}, nulls AS ({_NULLS}),
n AS (
  SELECT (SELECT count(*) FROM orders) AS s, (SELECT count(*) FROM tgt) AS t, (SELECT count(DISTINCT column_name) FROM cells) AS c,
         (SELECT count(*) FROM nulls WHERE null_count > 0) AS u, (SELECT count(*) FROM tgt) - (SELECT count(DISTINCT o_orderkey) FROM tgt) AS d,
         (SELECT CAST(count(*) FILTER (o_orderpriority IS NULL) > 0 AS INT) + CAST(count(*) FILTER (o_totalprice < 0) > 0 AS INT) FROM tgt) AS r
)
SELECT unnest(['Count Validation', 'Schema Validation', 'Data Validation', 'Null Check', 'Duplicate Check',
               'Rule Validation', 'Overall Status']) AS validation_type,
       unnest([CASE WHEN s = t THEN 'Counts match' ELSE 'Source: ' || s || ', Target: ' || t END, 'Schemas match',
               'Total Columns: 5, Failed Columns: ' || c, CASE WHEN u = 0 THEN 'No null values found' ELSE 'Columns with nulls: ' || u END,
               CASE WHEN d = 0 THEN 'No duplicates found' ELSE 'Duplicate records: ' || d END,
               CASE WHEN r = 0 THEN 'All rules passed' ELSE 'Failed Rules: ' || r END,
               CASE WHEN s <> t OR c > 0 OR u > 0 OR d > 0 OR r > 0 THEN 'Some validations failed' ELSE 'All validations passed' END]) AS details
FROM n"""),
    "written_report": (written_report, f"{_WITH}, " + _stats_sql("matched", inputs.ORDER_COLUMNS, _DISTINCT)),
    "recommendation_texts": (recommendation_texts, f"""{_WITH}, {_CELLS}, nulls AS ({_NULLS})
SELECT 'column' AS kind, 'Column ' || chr(39) || column_name || chr(39) || ' failed with ' || count(*) || ' mismatches — check data formatting or join logic.' AS recommendation
FROM cells GROUP BY column_name
UNION ALL SELECT 'null', printf('Column %s%s%s has %.2f%% null values — verify if this is expected.', chr(39), column_name, chr(39), null_percentage)
FROM nulls WHERE null_percentage > 0"""),
    "reconcile_discovered_key": (reconcile_discovered_key, f"""{_WITH}, {_CHECKS}
SELECT unnest(['Count Validation', 'Schema Validation', 'Data Validation', 'Null Check', 'Duplicate Check',
               'Rule Validation', 'Overall Status']) AS validation_type,
       unnest([c, 'NULL', 'NULL', n, 'NULL', 'NULL', CASE WHEN 'FAIL' IN (c, n) THEN 'FAIL' ELSE 'PASS' END]) AS status,
       'o_orderkey' AS key_columns
FROM words"""),
    "recommendations": (recommendations, f"""{_WITH}, {_CELLS},
nulls AS ({_NULLS})
SELECT DISTINCT 'column' AS kind, column_name FROM cells
UNION ALL SELECT 'null', column_name FROM nulls WHERE null_percentage > 0"""),
    "compare_files": (compare_files, f"{_WITH}, " + _stats_sql("matched", inputs.ORDER_COLUMNS, _DISTINCT)),
    "batch_summary": (batch_summary, f"""{_WITH}, {_CHECKS}
SELECT 'orders' AS test_case_name,
       unnest(['Count Validation', 'Schema Validation', 'Data Validation', 'Null Check', 'Duplicate Check',
               'Rule Validation', 'Overall Status']) AS validation_type,
       unnest([c, 'PASS', d, n, u, 'NULL', CASE WHEN 'FAIL' IN (c, d, n, u) THEN 'FAIL' ELSE 'PASS' END]) AS status
FROM words
UNION ALL
SELECT 'customers', unnest(['Count Validation', 'Schema Validation', 'Data Validation', 'Null Check',
               'Duplicate Check', 'Rule Validation', 'Overall Status']),
       unnest(['PASS', 'PASS', 'PASS', n, u, 'NULL', CASE WHEN 'FAIL' IN (n, u) THEN 'FAIL' ELSE 'PASS' END])
FROM (SELECT CASE WHEN count(*) = count(c_custkey) AND count(*) = count(c_name) AND count(*) = count(c_nationkey)
                   AND count(*) = count(c_acctbal) AND count(*) = count(c_mktsegment) THEN 'PASS' ELSE 'FAIL' END AS n,
             CASE WHEN count(*) = count(DISTINCT c_custkey) THEN 'PASS' ELSE 'FAIL' END AS u FROM customer)"""),
}
