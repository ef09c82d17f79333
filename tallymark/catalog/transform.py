"""Queries: renames, filters, casts, chains, flattening, code lists, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.catalog import inputs
from tallymark.operators import diff, transforms as t
from tallymark.plans.chain import Step, run_chain

FILTERS = [
    {"column": "o_orderdate", "operator": ">=", "value": "1996-06-01"},
    {"column": "o_totalprice", "operator": "<", "value": 300000},
    {"column": "o_orderstatus", "operator": "in", "value": ["O", "P"]},
    {"column": "o_orderpriority", "operator": "contains", "value": "U"},
    {"column": "o_orderpriority", "operator": "!=", "value": None},
    {"column": "no_such_column", "operator": "==", "value": 1},
    {"column": "o_custkey", "operator": "like", "value": 1},
]
_EITHER = [
    {"column": "o_orderpriority", "operator": "startswith", "value": "1-"},
    {"column": "o_orderpriority", "operator": "endswith", "value": "LOW"},
    {"column": "o_orderstatus", "operator": "not in", "value": ["F", "O"]},
    {"column": "o_orderpriority", "operator": "==", "value": None},
]


def rename_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"c_custkey": "customer_id", "c_name": "customer_name", "absent": "x"}
    return t.rename_columns(inputs.table(spark, sf_dir, "customer"), names)


def filter_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.filter_rows(inputs.orders_pair(spark, sf_dir)[1], FILTERS)


def filter_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.filter_rows(inputs.orders_pair(spark, sf_dir)[1], _EITHER, "or")


def filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.filter_counts(inputs.orders_pair(spark, sf_dir)[1], _EITHER, "or")


def _as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("custkey"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"),
        (F.col("o_orderstatus") == "F").cast("string").alias("done"),
    )


def cast_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = {"custkey": "int", "price": "double", "day": "date", "at": "timestamp", "done": "boolean", "o_orderkey": "string"}
    cast = t.cast_columns(_as_text(spark, sf_dir), types, date_format="dd/MM/yyyy")
    return cast.withColumn("at", F.col("at").cast("timestamp_ntz"))


def align_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = inputs.orders_pair(spark, sf_dir)
    retyped = target.withColumns({"o_custkey": F.col("o_custkey").cast("string"), "o_totalprice": F.col("o_totalprice").cast("string")})
    return t.align_types(source, retyped)


def transform_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain on both sides, one failing step among them, then the row differences that remain."""
    source, target = inputs.orders_pair(spark, sf_dir)
    renamed = target.withColumnRenamed("o_orderkey", "legacy_id")
    done = run_chain(source, renamed, [
        Step("rename_columns", {"names": {"legacy_id": "o_orderkey"}}, "target"),
        Step("upper_column", {"column": "no_such_column"}, "both"),
        Step("filter_rows", {"conditions": [{"column": "o_orderstatus", "operator": "!=", "value": "P"}]}, "both"),
        Step("cast_columns", {"types": {"o_custkey": "string"}}, "source"),
        Step("align_types", side="target"),
        Step("add_constant", {"column": "batch", "value": "b1"}, "both"),
        Step("keep_value", {"column": "batch", "value": "b1"}, "both"),
    ])
    rows = diff.row_diff(diff.pair_rows(done.source, done.target, inputs.ORDER_KEY))
    failed = sum(s["status"] == "error" for s in done.steps)
    return rows.select("o_orderkey", "status", F.array_join("differences.column", ",").alias("changed"), F.lit(failed).alias("failed_steps"))


def explode_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return t.explode_arrays(rows).withColumn("embedding", F.col("embedding").cast("double"))


def flatten_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.table(spark, sf_dir, "events")
    nested = events.select(
        "event_id",
        F.from_json("props", "k long").alias("props"),
        F.struct("user_id", F.struct(F.col("event_type").alias("kind"), "value").alias("what")).alias("who"),
    )
    return t.flatten_structs(nested)


def decode_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names for customers, from a code list that lacks one region's nations."""
    nations = inputs.table(spark, sf_dir, "nation")
    codes = nations.filter("n_regionkey <> 2").select("n_nationkey", "n_name")
    repeated = codes.unionByName(codes.withColumn("n_name", F.concat("n_name", F.lit("_v2"))))
    return t.decode_codes(inputs.table(spark, sf_dir, "customer"), repeated, "c_nationkey")


def upper_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.upper_column(inputs.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name")


def constant_and_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = t.add_constant(inputs.table(spark, sf_dir, "part"), "origin", "catalogue")
    return t.keep_value(parts, "p_type", "ECONOMY")


def group_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = t.group_aggregate(inputs.table(spark, sf_dir, "lineitem"), "l_quantity", "sum", ["l_suppkey", "l_returnflag"])
    return totals


_DISTINCT_CELLS = "concat_ws(',', " + ", ".join(
    f"CASE WHEN s.{c} IS DISTINCT FROM t.{c} THEN '{c}' END" for c in inputs.ORDER_COLUMNS
) + ")"

QUERIES = {
    "rename_columns": (rename_columns, "SELECT c_custkey AS customer_id, c_name AS customer_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"),
    "filter_and": (filter_and, f"""WITH {inputs.ORDERS_TARGET} SELECT * FROM tgt
WHERE o_orderdate >= TIMESTAMP '1996-06-01' AND o_totalprice < 300000 AND o_orderstatus IN ('O', 'P')
  AND contains(o_orderpriority, 'U') AND o_orderpriority IS NOT NULL"""),
    "filter_or": (filter_or, f"""WITH {inputs.ORDERS_TARGET} SELECT * FROM tgt
WHERE o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '%LOW' OR o_orderstatus NOT IN ('F', 'O') OR o_orderpriority IS NULL"""),
    "filter_counts": (filter_counts, f"""WITH {inputs.ORDERS_TARGET}, c AS (
  SELECT count(*) AS b, count(*) FILTER (o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '%LOW'
    OR o_orderstatus NOT IN ('F', 'O') OR o_orderpriority IS NULL) AS a FROM tgt)
SELECT b AS records_before, a AS records_after, b - a AS records_filtered FROM c"""),
    "cast_columns": (cast_columns, """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS INTEGER) AS custkey,
       CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price, CAST(o_orderdate AS DATE) AS day,
       o_orderdate AS at, o_orderstatus = 'F' AS done FROM orders"""),
    "align_types": (align_types, f"WITH {inputs.ORDERS_TARGET} SELECT * FROM tgt"),
    "transform_chain": (transform_chain, f"""WITH {inputs.ORDERS_TARGET}, rows AS (
  SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
         CASE WHEN t.o_orderkey IS NULL THEN 'missing_in_target'
              WHEN s.o_orderkey IS NULL THEN 'missing_in_source' ELSE 'values_differ' END AS status,
         CASE WHEN s.o_orderkey IS NULL OR t.o_orderkey IS NULL THEN '' ELSE {_DISTINCT_CELLS} END AS changed
  FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P') s
  FULL JOIN (SELECT * FROM tgt WHERE o_orderstatus <> 'P') t ON s.o_orderkey = t.o_orderkey)
SELECT o_orderkey, status, changed, 1 AS failed_steps FROM rows WHERE status <> 'values_differ' OR changed <> ''"""),
    "explode_arrays": (explode_arrays, "SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS embedding FROM embeddings"),
    "flatten_structs": (flatten_structs, """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k, user_id AS who_user_id,
       event_type AS who_what_kind, value AS who_what_value FROM events"""),
    "decode_codes": (decode_codes, """SELECT c.*, n.n_name || '_v2' AS c_nationkey_decoded
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey <> 2"""),
    "upper_column": (upper_column, "SELECT p_partkey, upper(p_name) AS p_name FROM part"),
    "constant_and_keep": (constant_and_keep, "SELECT *, 'catalogue' AS origin FROM part WHERE p_type = 'ECONOMY'"),
    "group_aggregate": (group_aggregate, "SELECT l_suppkey, l_returnflag, sum(l_quantity) AS sum_l_quantity FROM lineitem GROUP BY ALL"),
}
