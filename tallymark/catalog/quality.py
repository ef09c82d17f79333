"""Queries: rules, keys and schemas."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.catalog import inputs
from tallymark.operators import keys, profile, rules, schema

ORDER_RULES = [
    {"column": "o_orderkey", "rule": "not_null"},
    {"column": "o_orderpriority", "rule": "not_null"},
    {"column": "o_orderpriority", "rule": "null"},
    {"column": "o_orderpriority", "rule": "threshold", "threshold": 0.999},
    {"column": "o_orderpriority", "rule": "threshold"},
    {"column": "o_orderpriority", "rule": "regex", "pattern": "^[0-9]-[A-Z]+$"},
    {"column": "o_orderstatus", "rule": "regex", "pattern": "[FOP]"},
    {"column": "o_orderstatus", "rule": "regex", "pattern": "([FOP"},
    {"column": "o_orderkey", "rule": "uniqueness"},
    {"column": "o_custkey", "rule": "uniqueness", "threshold": 0.5},
    {"column": "o_totalprice", "rule": "range", "min": 2000, "max": 450000},
    {"column": "o_totalprice", "rule": "custom", "condition": "> 1500"},
    {"column": "o_comment", "rule": "not_null"},
    {"column": "o_orderkey", "rule": "checksum"},
]


_TURN_COLUMNS = ["role", "conv_id", "turn", "text"]
# The candidates in the order in which they are tried.
_KEY_CASES = " ".join(
    f"WHEN count(*) = count(DISTINCT ({', '.join(c)})) THEN '{','.join(c)}'" for n in (1, 2, 3) for c in combinations(_TURN_COLUMNS, n)
)


def _counts(results: DataFrame) -> DataFrame:
    return results.select("position", "column_name", "rule", "status", "violations", "total_count", "ratio")


def rule_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(rules.evaluate_rules(inputs.orders_pair(spark, sf_dir)[1], ORDER_RULES))


def rule_results_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule-to-columns form, with a range given as threshold bounds and as text."""
    given = {
        "not_null": ["c_name", "c_acctbal"],
        "uniqueness": ["c_custkey"],
        "regex": {"c_name": "^Customer#[0-9]+$"},
        "threshold": {"c_acctbal": {"min": 0, "max": 5000}},
        "range": {"c_nationkey": "3-20"},
        "custom": [{"column": "c_acctbal", "condition": "> -999"}],
    }
    return _counts(rules.evaluate_rules(inputs.table(spark, sf_dir, "customer"), given))


def rule_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    addresses = inputs.table(spark, sf_dir, "customer").withColumn(
        "email",
        F.concat(F.regexp_replace("c_name", "#", "."), F.when(F.col("c_acctbal") < 0, "@mail").otherwise("@mail.example.com")),
    )
    return _counts(rules.evaluate_rules(addresses, {"email": [{"rule": "pattern", "pattern": "email"}]}))


def rule_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_verdict(rules.evaluate_rules(inputs.orders_pair(spark, sf_dir)[1], ORDER_RULES))


def rule_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every rule that is not passed."""
    found = rules.evaluate_rules(inputs.orders_pair(spark, sf_dir)[1], ORDER_RULES)
    return found.where("message IS NOT NULL").select("position", "message")


def find_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first key of the conversations, whose single columns all repeat."""
    turns = inputs.table(spark, sf_dir, "conversations").select(*_TURN_COLUMNS)
    found = keys.find_key(turns) or ()
    return profile.duplicate_profile(turns, found).select(
        F.lit(",".join(found)).alias("key_columns"), "total_records", "duplicate_count"
    )


def validate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key that repeats is refused and replaced."""
    customers = inputs.table(spark, sf_dir, "customer")
    found, valid = keys.validate_keys(customers, ["c_nationkey"])
    return profile.duplicate_profile(customers, found).select(
        F.lit(",".join(found)).alias("key_columns"), F.lit(valid).alias("given_valid"), "total_records", "duplicate_count"
    )


def classify_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.classify_keys(inputs.orders_pair(spark, sf_dir)[1])


def schema_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both schemas side by side, with the nulls of each side next to them."""
    source, target = _retyped(spark, sf_dir)
    sides = [
        profile.null_profile(df).select(F.col("column_name").alias(f"_{name}"), F.col("null_count").alias(f"{name}_nulls"))
        for name, df in (("source", source), ("target", target))
    ]
    table = schema.schema_table(source, target)
    for name, side in zip(("source", "target"), sides):
        table = table.join(side, F.col("column_name") == F.col(f"_{name}"), "left_outer").drop(f"_{name}")
    return table


def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema differences, with the rows of the source they concern."""
    source, target = _retyped(spark, sf_dir)
    rows = source.agg(F.count("*").alias("n")).scalar()
    return schema.schema_diff(source, target).withColumn("source_rows", rows)


def _retyped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source, target = inputs.orders_pair(spark, sf_dir)
    changed = target.withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumnRenamed("o_orderstatus", "o_state")
    return source, changed


def conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = _retyped(spark, sf_dir)
    return schema.conform(target, source.schema)


def union_evolving(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = inputs.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    newer = inputs.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return schema.union_evolving(schema.add_missing_columns(customers, [("c_note", "string")]), newer)


_COUNTED = [
    # position, column, rule, violations, ratio, least ratio
    (0, "o_orderkey", "not_null", "count(*) FILTER (o_orderkey IS NULL)", None, None),
    (1, "o_orderpriority", "not_null", "count(*) FILTER (o_orderpriority IS NULL)", None, None),
    (2, "o_orderpriority", "null", "count(*) FILTER (o_orderpriority IS NOT NULL)", None, None),
    (3, "o_orderpriority", "threshold", None, "count(o_orderpriority) / count(*)", 0.999),
    (4, "o_orderpriority", "threshold", None, "count(o_orderpriority) / count(*)", 0.95),
    (5, "o_orderpriority", "regex", "count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[0-9]-[A-Z]+$'))", None, None),
    (6, "o_orderstatus", "regex", "count(*) FILTER (NOT regexp_matches(o_orderstatus, '[FOP]'))", None, None),
    (8, "o_orderkey", "uniqueness", None, "count(DISTINCT o_orderkey) / count(*)", 1.0),
    (9, "o_custkey", "uniqueness", None, "count(DISTINCT o_custkey) / count(*)", 0.5),
    (10, "o_totalprice", "range", "count(*) FILTER (o_totalprice < 2000 OR o_totalprice > 450000)", None, None),
    (11, "o_totalprice", "custom", "count(*) FILTER (NOT o_totalprice > 1500)", None, None),
]
_FIXED = [(7, "o_orderstatus", "regex", "FAIL"), (12, "o_comment", "column_exists", "FAIL"), (13, "o_orderkey", "checksum", "ERROR")]


def _rules_sql(counted: list, fixed: list, source: str) -> str:
    parts = []
    for position, column, rule, violations, ratio, least in counted:
        status = (
            f"CASE WHEN {violations} > 0 THEN 'FAIL' ELSE 'PASS' END" if violations
            else f"CASE WHEN {ratio} < {least} THEN 'FAIL' ELSE 'PASS' END"
        )
        parts.append(
            f"SELECT {position} AS position, '{column}' AS column_name, '{rule}' AS rule, {status} AS status, "
            f"CAST({violations or 'NULL'} AS BIGINT) AS violations, count(*) AS total_count, "
            f"CAST({ratio or 'NULL'} AS DOUBLE) AS ratio FROM {source}"
        )
    for position, column, rule, status in fixed:
        parts.append(f"SELECT {position}, '{column}', '{rule}', '{status}', NULL, count(*), NULL FROM {source}")
    return "\nUNION ALL ".join(parts)


_TARGET_RULES = _rules_sql(_COUNTED, _FIXED, "tgt")
_CUSTOMER_RULES = _rules_sql([
    (0, "c_name", "not_null", "count(*) FILTER (c_name IS NULL)", None, None),
    (1, "c_acctbal", "not_null", "count(*) FILTER (c_acctbal IS NULL)", None, None),
    (2, "c_custkey", "uniqueness", None, "count(DISTINCT c_custkey) / count(*)", 1.0),
    (3, "c_name", "regex", "count(*) FILTER (NOT regexp_matches(c_name, '^Customer#[0-9]+$'))", None, None),
    (4, "c_acctbal", "range", "count(*) FILTER (c_acctbal < 0 OR c_acctbal > 5000)", None, None),
    (5, "c_nationkey", "range", "count(*) FILTER (c_nationkey < 3 OR c_nationkey > 20)", None, None),
    (6, "c_acctbal", "custom", "count(*) FILTER (NOT c_acctbal > -999)", None, None),
], [], "customer")

_KEYABLE = [("o_orderkey", True), ("o_custkey", True), ("o_orderstatus", True), ("o_totalprice", False), ("o_orderpriority", True)]

QUERIES = {
    "rule_results": (rule_results, f"WITH {inputs.ORDERS_TARGET} {_TARGET_RULES}"),
    "rule_results_by_kind": (rule_results_by_kind, _CUSTOMER_RULES),
    "rule_email": (rule_email, """WITH a AS (SELECT replace(c_name, '#', '.') ||
    CASE WHEN c_acctbal < 0 THEN '@mail' ELSE '@mail.example.com' END AS email FROM customer),
c AS (SELECT count(*) AS n, count(*) FILTER (NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$')) AS bad FROM a)
SELECT 0 AS position, 'email' AS column_name, 'pattern' AS rule, CASE WHEN bad > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
       bad AS violations, n AS total_count, CAST(NULL AS DOUBLE) AS ratio FROM c"""),
    "rule_verdict": (rule_verdict, f"""WITH {inputs.ORDERS_TARGET}, r AS ({_TARGET_RULES})
SELECT CASE WHEN count(*) FILTER (status <> 'PASS') > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
       count(*) FILTER (status <> 'PASS') AS failed_rules FROM r"""),
    "find_key": (find_key, f"""WITH k AS (SELECT count(*) AS n, CASE {_KEY_CASES} END AS key_columns FROM conversations)
SELECT key_columns, n AS total_records, 0 AS duplicate_count FROM k"""),
    "rule_messages": (rule_messages, f"""WITH {inputs.ORDERS_TARGET}, c AS (
  SELECT count(*) AS n, count(*) FILTER (o_orderkey IS NULL) AS k, count(*) FILTER (o_orderpriority IS NULL) AS p,
         count(*) FILTER (o_totalprice NOT BETWEEN 2000 AND 450000) AS r, count(*) FILTER (NOT o_totalprice > 1500) AS u,
         count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[0-9]-[A-Z]+$')) AS x,
         count(DISTINCT o_custkey) AS d
  FROM tgt), m AS (
  SELECT unnest([1, 2, 3, 4, 5, 7, 9, 10, 11, 12, 13]) AS position, unnest([
    CASE WHEN p > 0 THEN 'Found ' || p || ' null values out of ' || n || ' records' END,
    CASE WHEN n > p THEN 'Found ' || (n - p) || ' non-null values out of ' || n || ' records' END,
    CASE WHEN (n - p) / n < 0.999 THEN 'Not null ratio ' || round((n - p) / n * 100, 2) || '% is below threshold 99.90%' END,
    CASE WHEN (n - p) / n < {rules.DEFAULT_NOT_NULL_RATIO} THEN 'Not null ratio ' || round((n - p) / n * 100, 2) || '% is below threshold {rules.DEFAULT_NOT_NULL_RATIO:.2%}' END,
    CASE WHEN x > 0 THEN 'Found ' || x || ' values not matching pattern ^[0-9]-[A-Z]+$ out of ' || n || ' records' END,
    'Invalid regex pattern: ([FOP',
    CASE WHEN d / n < 0.5 THEN 'Uniqueness ratio ' || round(d / n * 100, 2) || '% is below threshold 50.00%' END,
    CASE WHEN r > 0 THEN 'Found ' || r || ' values out of range out of ' || n || ' records' END,
    CASE WHEN u > 0 THEN 'Found ' || u || ' values failing > 1500 out of ' || n || ' records' END,
    'Column does not exist in dataframe', 'Unknown rule: checksum']) AS message FROM c)
SELECT * FROM m WHERE message IS NOT NULL"""),
    "validate_keys": (validate_keys, """SELECT 'c_custkey' AS key_columns, false AS given_valid, count(*) AS total_records,
       count(*) - count(DISTINCT c_custkey) AS duplicate_count FROM customer"""),
    "classify_keys": (classify_keys, f"WITH {inputs.ORDERS_TARGET}, p AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {str(exact).lower()} AS exact, "
        f"(SELECT count(*) FROM (SELECT DISTINCT {c} FROM tgt)) / count(*) AS unique_ratio, "
        f"count(*) FILTER ({c} IS NULL) / count(*) AS null_ratio FROM tgt" for c, exact in _KEYABLE
    ) + """)
SELECT column_name, unique_ratio, null_ratio,
       CASE WHEN exact AND unique_ratio = 1 AND null_ratio = 0 THEN 'primary'
            WHEN unique_ratio >= 0.95 AND null_ratio <= 0.05 THEN 'candidate'
            WHEN exact AND unique_ratio < 1 AND null_ratio <= 0.05 THEN 'foreign' END AS key_class FROM p"""),
    "schema_table": (schema_table, f"""WITH {inputs.ORDERS_TARGET}
SELECT 'o_custkey' AS column_name, 'bigint' AS source_type, 'string' AS target_type, 'type_mismatch' AS status,
       (SELECT count(*) FILTER (o_custkey IS NULL) FROM orders) AS source_nulls,
       (SELECT count(*) FILTER (o_custkey IS NULL) FROM tgt) AS target_nulls
UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', 'timestamp_ntz', 'match',
       (SELECT count(*) FILTER (o_orderdate IS NULL) FROM orders), (SELECT count(*) FILTER (o_orderdate IS NULL) FROM tgt)
UNION ALL SELECT 'o_orderkey', 'bigint', 'bigint', 'match',
       (SELECT count(*) FILTER (o_orderkey IS NULL) FROM orders), (SELECT count(*) FILTER (o_orderkey IS NULL) FROM tgt)
UNION ALL SELECT 'o_orderpriority', 'string', 'string', 'match',
       (SELECT count(*) FILTER (o_orderpriority IS NULL) FROM orders), (SELECT count(*) FILTER (o_orderpriority IS NULL) FROM tgt)
UNION ALL SELECT 'o_orderstatus', 'string', 'MISSING', 'missing_in_target',
       (SELECT count(*) FILTER (o_orderstatus IS NULL) FROM orders), NULL
UNION ALL SELECT 'o_state', 'MISSING', 'string', 'missing_in_source', NULL,
       (SELECT count(*) FILTER (o_orderstatus IS NULL) FROM tgt)
UNION ALL SELECT 'o_totalprice', 'double', 'double', 'match',
       (SELECT count(*) FILTER (o_totalprice IS NULL) FROM orders), (SELECT count(*) FILTER (o_totalprice IS NULL) FROM tgt)"""),
    "schema_diff": (schema_diff, """SELECT v.*, (SELECT count(*) FROM orders) AS source_rows FROM (VALUES
  ('o_custkey', 'bigint', 'string', 'type_mismatch'),
  ('o_orderstatus', 'string', 'MISSING', 'missing_in_target'),
  ('o_state', 'MISSING', 'string', 'missing_in_source')) v(column_name, source_type, target_type, status)"""),
    "conform": (conform, f"""WITH {inputs.ORDERS_TARGET}
SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM tgt"""),
    "union_evolving": (union_evolving, """SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS c_note, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer
UNION ALL SELECT c_custkey, c_name, NULL, c_acctbal FROM customer"""),
}
