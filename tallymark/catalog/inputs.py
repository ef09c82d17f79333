"""Inputs of the queries: the given tables, and drifted targets, results, logs and spans derived
from them. Every DataFrame has its SQL twin for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- orders against a drifted copy ---------------------------------------------------------

ORDER_KEY = ["o_orderkey"]
ORDER_COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def orders_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All orders, and a target with changed prices, nulled priorities, lost and extra orders."""
    orders = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_totalprice") < 40000, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    nulled = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 250000)
    lost = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderdate") < F.lit("1996-01-01"))
    kept = orders.filter(~lost).withColumns(
        {"o_totalprice": price, "o_orderpriority": F.when(~nulled, F.col("o_orderpriority"))}
    )
    extra = orders.filter("o_totalprice > 470000").withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    return orders, kept.unionByName(extra)


ORDERS_TARGET = """
tgt AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_totalprice < 40000 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         o_orderdate,
         CASE WHEN o_orderstatus = 'P' AND o_totalprice > 250000 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderdate < TIMESTAMP '1996-01-01')
  UNION ALL
  SELECT -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_totalprice > 470000
)"""

# --- line items, whose key repeats, against a drifted copy ----------------------------------

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_COLUMNS = [
    "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def lines_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, *LINE_COLUMNS)
    flag = F.when(F.col("l_quantity") > 45, "X").otherwise(F.col("l_returnflag"))
    return lines, lines.filter("l_quantity <> 3").withColumn("l_returnflag", flag)


LINES_TARGET = f"""
src AS (SELECT {", ".join([*LINE_KEY, *LINE_COLUMNS])} FROM lineitem),
tgt AS (
  SELECT * REPLACE (CASE WHEN l_quantity > 45 THEN 'X' ELSE l_returnflag END AS l_returnflag) FROM src WHERE l_quantity <> 3
)"""

# --- test results from orders ---------------------------------------------------------------


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One test result per order: F is FAIL, O is PASS, P is PENDING; the customer is the run."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "O", "PASS").otherwise("PENDING")
    return o.select(
        F.col("o_orderkey").alias("execution_id"),
        F.col("o_custkey").alias("execution_run_id"),
        F.col("o_orderpriority").alias("traceability_id"),
        F.col("o_orderdate").alias("execution_start_time"),
        F.timestamp_add("MINUTE", (F.col("o_orderkey") % 500).cast("int"), "o_orderdate").alias("execution_end_time"),
        status.alias("status"),
        F.floor("o_totalprice").cast("long").alias("source_count"),
        F.col("o_orderdate").alias("created_at"),
    )


RESULTS = """
results AS (
  SELECT o_orderkey AS execution_id, o_custkey AS execution_run_id, o_orderpriority AS traceability_id,
         o_orderdate AS execution_start_time,
         o_orderdate + to_minutes(CAST(o_orderkey % 500 AS INTEGER)) AS execution_end_time,
         CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'PASS' ELSE 'PENDING' END AS status,
         CAST(floor(o_totalprice) AS BIGINT) AS source_count, o_orderdate AS created_at
  FROM orders
)"""

# --- log events and spans from events -------------------------------------------------------


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a log entry: clicks carry their user as name, errors mention it."""
    e = table(spark, sf_dir, "events")
    user = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    message = F.when(
        F.col("event_type") == "error", F.concat(F.lit("Failure for USER_"), F.col("user_id").cast("string"), F.lit(" seen"))
    ).otherwise(F.concat(F.lit("Function Completed: "), F.col("event_type")))
    return e.select(
        "event_id",
        "ts",
        F.when(F.col("event_type") == "click", user).alias("name"),
        message.alias("message"),
        F.when(F.col("event_type") == "signup", F.col("user_id")).alias("trace_id"),
    )


LOG_EVENTS = """
log_events AS (
  SELECT event_id, ts,
         CASE WHEN event_type = 'click' THEN 'user_' || user_id END AS name,
         CASE WHEN event_type = 'error' THEN 'Failure for USER_' || user_id || ' seen'
              ELSE 'Function Completed: ' || event_type END AS message,
         CASE WHEN event_type = 'signup' THEN user_id END AS trace_id
  FROM events
)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span per user and day with purchases, from the first to the last of them."""
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    day = F.dayofyear("ts")
    daily = e.groupBy("user_id", day.alias("day")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")
    )
    return daily.select(
        (F.col("user_id") * 1000 + F.col("day")).alias("span_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("name"),
        F.col("first").alias("start"),
        F.col("last").alias("end"),
        F.col("user_id").alias("trace_id"),
        "n",
    )


SPANS = """
spans AS (
  SELECT user_id * 1000 + dayofyear(ts) AS span_id, 'user_' || user_id AS name,
         min(ts) AS start_ts, max(ts) AS end_ts, user_id AS trace_id, count(*) AS n
  FROM events WHERE event_type = 'purchase' GROUP BY user_id, dayofyear(ts)
)"""


def broken_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans, without an end where one purchase made them, without a start where two did."""
    s = spans(spark, sf_dir)
    return s.withColumns({"end": F.when(F.col("n") != 1, F.col("end")), "start": F.when(F.col("n") != 2, F.col("start"))})


BROKEN_SPANS = """
broken AS (
  SELECT span_id, name, CASE WHEN n <> 2 THEN start_ts END AS start_ts,
         CASE WHEN n <> 1 THEN end_ts END AS end_ts, trace_id, n
  FROM spans
)"""
