"""Queries: facts from log text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.catalog import inputs
from tallymark.operators import logs


def _origin_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log entries whose message tells its origin in different ways."""
    e = inputs.table(spark, sf_dir, "events")
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    message = (
        F.when(kind == "click", F.concat(F.lit("Function Started: step_"), user))
        .when(kind == "view", F.concat(F.lit("[FUNCTION:debug] opened page "), user))
        .when(kind == "signup", F.concat(F.lit("welcome mail in module mailer for "), user))
        .when((kind == "error") & (F.col("value") > 10), F.lit("Creating database tables"))
        .when(kind == "error", F.lit("a warning was raised"))
        .otherwise(F.concat(F.lit("paid "), F.floor("value").cast("string")))
    )
    return e.select(
        "event_id", message.alias("message"), F.lit("INFO").alias("level"),
        F.when(F.col("value") > 50, "web").otherwise("unknown").alias("module"), F.lit("unknown").alias("function"),
    )


def fixed_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.fix_unknown_origin(_origin_log(spark, sf_dir))


def unknown_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.unknown_count(logs.fix_unknown_origin(_origin_log(spark, sf_dir)))


def unknown_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.unknown_sample(logs.fix_unknown_origin(_origin_log(spark, sf_dir)))


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.redact_column(inputs.table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def redacted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn with a secret of some kind written into it."""
    c = inputs.table(spark, sf_dir, "conversations")
    n = F.col("conv_id").cast("string")
    secret = (
        F.when(F.col("turn") == 0, F.concat(F.lit(' Password: "pw'), n, F.lit('" API-key=k'), n))
        .when(F.col("turn") == 1, F.concat(F.lit(" jdbc://host/db"), n, F.lit(" card 1234-5678-9012-"), F.lpad(n, 4, "0")))
        .otherwise(F.concat(F.lit(" mail a"), n, F.lit("@example.org from 10.0.0.7, access_key: x"), n, F.lit(" SECRET = s token=t")))
    )
    return logs.redact_column(c.select("conv_id", "turn", F.concat("text", secret).alias("text")), "text")


def _console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as console lines of their user's run."""
    e = inputs.table(spark, sf_dir, "events")
    kind, number = F.col("event_type"), F.floor("value").cast("string")
    line = (
        F.when((kind == "click") & (F.col("value") > 40), F.concat(F.lit("INFO: Source Count: "), number))
        .when(kind == "click", F.concat(F.lit("source count: "), number))
        .when((kind == "view") & (F.col("value") > 20), F.lit("target count: many"))
        .when(kind == "view", F.concat(F.lit("Target count: "), number))
        .when((kind == "signup") & (F.col("value") > 25), F.lit("Data validation failed"))
        .when(kind == "signup", F.lit("Data Validation Passed"))
        .when((kind == "error") & (F.col("value") > 60), F.concat(F.lit("Error: code "), number))
        .when(kind == "error", F.concat(F.lit("ran in "), number))
        .when(F.col("value") > 15, F.lit("All validations passed"))
        .otherwise(F.lit("nothing to report"))
    )
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), line.alias("line"))


def console_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _console(spark, sf_dir)
    rare = lines.withColumn("line", F.when(F.col("line").startswith("Error: code 9"), "RuntimeError").otherwise(F.col("line")))
    return logs.console_outcome(rare)


def run_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.run_facts(_console(spark, sf_dir))


def _suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as output lines of a test suite per user."""
    e = inputs.table(spark, sf_dir, "events")
    kind, number = F.col("event_type"), F.floor("value").cast("string")
    line = (
        F.when(kind == "click", F.concat(F.lit("Ran "), number, F.lit(" tests in 0.01s")))
        .when(kind == "view", F.concat(F.lit("FAILED (failures="), number, F.lit(", errors="), F.floor(F.col("value") / 2).cast("string"), F.lit(")")))
        .when(kind == "signup", F.concat(F.lit("OK (skipped="), number, F.lit(")")))
        .when((kind == "error") & (F.col("value") > 30), F.concat(F.lit("  AssertionError: "), number, F.lit(" != 0 ")))
        .when(kind == "error", F.concat(F.lit(" ValueError: bad "), number))
        .otherwise(F.concat(F.lit("FAIL: test_"), number))
    )
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), line.alias("line"))


def test_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.test_counts(_suite(spark, sf_dir))


def failure_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.failure_reason(_suite(spark, sf_dir))


def _verbose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as verbose test lines of their user's run."""
    e = inputs.table(spark, sf_dir, "events")
    kind, high = F.col("event_type"), F.col("value") > 15
    line = (
        F.when(kind == "click", F.concat(F.lit("test_case_"), F.col("event_id").cast("string"), F.lit(" (suite.Cases) ... ")))
        .when((kind == "view") & high, F.lit("checks ... FAIL"))
        .when(kind == "view", F.lit("checks ... ok"))
        .when((kind == "signup") & high, F.lit("checks ... ERROR"))
        .when(kind == "signup", F.lit("checks ... skipped"))
        .when((kind == "error") & high, F.lit("AssertionError: not equal"))
        .when(kind == "error", F.lit("Traceback (most recent call last):"))
        .otherwise(F.concat(F.lit("  step "), F.col("event_id").cast("string")))
    )
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), line.alias("line"))


def test_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.test_statuses(_verbose(spark, sf_dir))


def test_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.test_messages(_verbose(spark, sf_dir))


_ORIGIN = """log AS (
  SELECT event_id, CASE WHEN event_type = 'click' THEN 'Function Started: step_' || user_id
      WHEN event_type = 'view' THEN '[FUNCTION:debug] opened page ' || user_id
      WHEN event_type = 'signup' THEN 'welcome mail in module mailer for ' || user_id
      WHEN event_type = 'error' AND value > 10 THEN 'Creating database tables'
      WHEN event_type = 'error' THEN 'a warning was raised'
      ELSE 'paid ' || CAST(floor(value) AS BIGINT) END AS message,
    'INFO' AS level, CASE WHEN value > 50 THEN 'web' ELSE 'unknown' END AS module, 'unknown' AS function
  FROM events
), fixed AS (
  SELECT event_id, message, level,
    CASE WHEN message LIKE 'Function%' THEN module WHEN message LIKE '[FUNCTION%' THEN 'custom_logger'
         WHEN message LIKE 'welcome%' THEN 'mailer' WHEN message LIKE 'Creating%' THEN 'db_handler'
         WHEN message LIKE 'a warning%' THEN 'custom_logger' ELSE module END AS module,
    CASE WHEN message LIKE 'Function%' THEN substr(message, 19) WHEN message LIKE '[FUNCTION%' THEN 'debug'
         WHEN message LIKE 'Creating%' THEN 'create_tables' WHEN message LIKE 'a warning%' THEN 'warning' ELSE function END AS function
  FROM log
), clicks AS (
  SELECT event_id, message, level, CASE WHEN message LIKE 'Function%' THEN 'unknown' ELSE module END AS module, function FROM fixed
)"""

_REDACTIONS = [
    ("PASSWORD", """password["\\s]*[:=]\\s*["'']?([^"''\\s,}]+)""", "gi"),
    ("API_KEY", """api[_-]?key["\\s]*[:=]\\s*["'']?([^"''\\s,}]+)""", "gi"),
    ("TOKEN", """token["\\s]*[:=]\\s*["'']?([^"''\\s,}]+)""", "gi"),
    ("SECRET", """secret["\\s]*[:=]\\s*["'']?([^"''\\s,}]+)""", "gi"),
    ("ACCESS_KEY", """access[_-]?key["\\s]*[:=]\\s*["'']?([^"''\\s,}]+)""", "gi"),
    ("CONNECTION_STRING", """(mongodb|jdbc|mysql|postgresql|redis)://[^\\s<>"]+""", "gi"),
    ("EMAIL", """[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}""", "g"),
    ("IP_ADDRESS", """\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b""", "g"),
    ("CREDIT_CARD", """\\b\\d{4}[- ]?\\d{4}[- ]?\\d{4}[- ]?\\d{4}\\b""", "g"),
]


def _redact_sql(text: str) -> str:
    for kind, pattern, flags in _REDACTIONS:
        text = f"regexp_replace({text}, '{pattern}', '[REDACTED_{kind}]', '{flags}')"
    return text


_CONSOLE = """console AS (
  SELECT user_id AS run_id, event_id AS line_no, CASE
      WHEN event_type = 'click' AND value > 40 THEN 'INFO: Source Count: ' || CAST(floor(value) AS BIGINT)
      WHEN event_type = 'click' THEN 'source count: ' || CAST(floor(value) AS BIGINT)
      WHEN event_type = 'view' AND value > 20 THEN 'target count: many'
      WHEN event_type = 'view' THEN 'Target count: ' || CAST(floor(value) AS BIGINT)
      WHEN event_type = 'signup' AND value > 25 THEN 'Data validation failed'
      WHEN event_type = 'signup' THEN 'Data Validation Passed'
      WHEN event_type = 'error' AND value > 60 THEN 'Error: code ' || CAST(floor(value) AS BIGINT)
      WHEN event_type = 'error' THEN 'ran in ' || CAST(floor(value) AS BIGINT)
      WHEN value > 15 THEN 'All validations passed' ELSE 'nothing to report' END AS line,
    event_type, value
  FROM events)"""

_SUITE = """suite AS (
  SELECT user_id AS run_id, event_id AS line_no, event_type AS kind, value, CAST(floor(value) AS BIGINT) AS n,
         CAST(floor(value / 2) AS BIGINT) AS half FROM events)"""

_VERBOSE = """verbose_log AS (
  SELECT user_id AS run_id, event_id AS line_no, CASE
      WHEN event_type = 'click' THEN 'test_case_' || event_id || ' (suite.Cases) ... '
      WHEN event_type = 'view' AND value > 15 THEN 'checks ... FAIL' WHEN event_type = 'view' THEN 'checks ... ok'
      WHEN event_type = 'signup' AND value > 15 THEN 'checks ... ERROR' WHEN event_type = 'signup' THEN 'checks ... skipped'
      WHEN event_type = 'error' AND value > 15 THEN 'AssertionError: not equal'
      WHEN event_type = 'error' THEN 'Traceback (most recent call last):' ELSE '  step ' || event_id END AS line
  FROM events
), inside AS (
  SELECT * FROM (SELECT *, max(CASE WHEN line LIKE 'test%' THEN line_no END) OVER (PARTITION BY run_id ORDER BY line_no) AS start_no
                 FROM verbose_log) WHERE line_no > start_no
), verdict AS (
  SELECT run_id, start_no, min(line_no) AS result_no,
         arg_min(CASE WHEN line LIKE '% ok' THEN 'pass' WHEN line LIKE '% FAIL' THEN 'fail'
                      WHEN line LIKE '% ERROR' THEN 'error' ELSE 'skipped' END, line_no) AS status
  FROM inside WHERE line LIKE 'checks%' GROUP BY run_id, start_no
), bounds AS (
  SELECT v.run_id, v.start_no, v.status,
         min(i.line_no) FILTER (i.line LIKE 'AssertionError%') AS end_no,
         min(i.line_no) FILTER (i.line LIKE 'Traceback%') AS trace_no
  FROM verdict v LEFT JOIN inside i ON i.run_id = v.run_id AND i.start_no = v.start_no AND i.line_no > v.result_no
    AND v.status IN ('fail', 'error')
  GROUP BY v.run_id, v.start_no, v.status
), finished AS (
  SELECT run_id, start_no, 'test_case_' || start_no AS test_name, status,
         CASE WHEN trace_no <= end_no THEN trace_no END AS message_from,
         CASE WHEN trace_no <= end_no THEN end_no END AS message_to
  FROM bounds WHERE status IN ('pass', 'skipped') OR end_no IS NOT NULL
)"""

QUERIES = {
    "fixed_origin": (fixed_origin, f"WITH {_ORIGIN} SELECT * FROM clicks"),
    "unknown_count": (unknown_count, f"WITH {_ORIGIN} SELECT count(*) FILTER (module = 'unknown' OR function = 'unknown') AS remaining FROM clicks"),
    "unknown_sample": (unknown_sample, f"""WITH {_ORIGIN}
SELECT DISTINCT message, level, module, function FROM clicks WHERE module = 'unknown' OR function = 'unknown' ORDER BY ALL LIMIT 5"""),
    "redacted_documents": (redacted_documents, f"SELECT doc_id, {_redact_sql('text')} AS text FROM documents"),
    "redacted_turns": (redacted_turns, "WITH t AS (SELECT conv_id, turn, text || CASE turn "
        "WHEN 0 THEN ' Password: \"pw' || conv_id || '\" API-key=k' || conv_id "
        "WHEN 1 THEN ' jdbc://host/db' || conv_id || ' card 1234-5678-9012-' || lpad(substr(CAST(conv_id AS VARCHAR), 1, 4), 4, '0') "
        "ELSE ' mail a' || conv_id || '@example.org from 10.0.0.7, access_key: x' || conv_id || ' SECRET = s token=t' END AS text "
        f"FROM conversations) SELECT conv_id, turn, {_redact_sql('text')} AS text FROM t"),
    "console_outcome": (console_outcome, f"""WITH {_CONSOLE}
SELECT run_id, CASE WHEN bool_or(line LIKE 'Error: code 9%') THEN 'FAILED'
                    WHEN bool_or(line = 'All validations passed') THEN 'PASSED' ELSE 'UNKNOWN' END AS outcome
FROM console GROUP BY run_id"""),
    "run_facts": (run_facts, f"""WITH {_CONSOLE}
SELECT run_id,
       coalesce(arg_max(CASE WHEN value > 25 THEN 'FAILED' ELSE 'PASSED' END, line_no) FILTER (event_type = 'signup'), 'PASSED') AS status,
       arg_max(CAST(floor(value) AS BIGINT), line_no) FILTER (event_type = 'click' AND value <= 40) AS source_count,
       arg_max(CAST(floor(value) AS BIGINT), line_no) FILTER (event_type = 'view' AND value <= 20) AS target_count,
       arg_max(line, line_no) FILTER (event_type = 'error' AND value > 60) AS error_message
FROM console GROUP BY run_id"""),
    "test_counts": (test_counts, f"""WITH {_SUITE}
SELECT run_id, coalesce(arg_max(n, line_no) FILTER (kind = 'click'), 0) AS run,
       coalesce(arg_min(half, line_no) FILTER (kind = 'view'), 0) AS errors,
       coalesce(arg_min(n, line_no) FILTER (kind = 'view'), 0) AS failures,
       coalesce(arg_min(n, line_no) FILTER (kind = 'signup'), 0) AS skipped
FROM suite GROUP BY run_id"""),
    "failure_reason": (failure_reason, f"""WITH {_SUITE}
SELECT run_id, coalesce(
         arg_min(CASE WHEN value > 30 THEN 'AssertionError: ' || n || ' != 0' ELSE 'ValueError: bad ' || n END, line_no) FILTER (kind = 'error'),
         arg_min('FAIL: test_' || n, line_no) FILTER (kind = 'purchase')) AS reason
FROM suite GROUP BY run_id"""),
    "test_statuses": (test_statuses, f"WITH {_VERBOSE} SELECT * FROM finished"),
    "test_messages": (test_messages, f"""WITH {_VERBOSE}
SELECT f.run_id, f.start_no, f.test_name, i.line_no, i.line FROM finished f
JOIN inside i ON i.run_id = f.run_id AND i.start_no = f.start_no AND i.line_no BETWEEN f.message_from AND f.message_to"""),
}
