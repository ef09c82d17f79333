"""Queries: result tables, rollups, schedules, acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.catalog import inputs
from tallymark.functions import schedule, validators as v
from tallymark.operators import results as r


def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer, the greatest order key among those of one day."""
    orders = inputs.table(spark, sf_dir, "orders")
    return r.latest_per_group(orders, ["o_custkey"], "o_orderdate", "o_orderkey")


def latest_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = inputs.table(spark, sf_dir, "orders")
    return r.latest_per_group(orders, ["o_orderstatus", "o_orderpriority"], "o_orderdate", keep_ties=True)


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New results: every finished one again with more rows, under new ids and in new runs too."""
    known = inputs.results(spark, sf_dir).filter("status <> 'PENDING'")
    again = known.withColumns({
        "execution_id": -1 - F.col("execution_id"),
        "status": F.when(F.col("status") == "FAIL", "PASS"),
        "source_count": F.col("source_count") + 5,
    })
    fresh = known.filter("source_count < 30000").withColumns({
        "execution_id": -1_000_000_000_000 - F.col("execution_id"),
        "execution_run_id": -1 - F.col("execution_run_id"),
    })
    return again.unionByName(fresh)


def upsert_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.upsert_results(
        inputs.results(spark, sf_dir), _incoming(spark, sf_dir), ["traceability_id", "execution_run_id"],
        "execution_id", "created_at", ["execution_end_time", "status", "source_count"],
    )


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.insert_if_absent(
        inputs.results(spark, sf_dir), _incoming(spark, sf_dir), ["traceability_id", "execution_run_id"], "execution_id"
    )


def insert_with_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.insert_if_absent(
        inputs.results(spark, sf_dir), _incoming(spark, sf_dir), ["traceability_id", "execution_run_id"], "execution_id", force=True
    )


def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.run_rollup(inputs.results(spark, sf_dir))


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.run_status(r.run_rollup(inputs.results(spark, sf_dir)))


def all_passed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = inputs.results(spark, sf_dir).withColumn("status", F.when(F.col("status") == "FAIL", "FAILED").otherwise(F.col("status")))
    return r.all_passed_status(failed, "execution_run_id")


def suite_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as test suites, their priority as directory."""
    o = inputs.table(spark, sf_dir, "orders")
    counts = o.select(
        F.col("o_orderpriority").alias("directory"),
        F.lit(10).alias("run"),
        F.when(F.col("o_orderstatus") == "F", 2).otherwise(0).alias("failed"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("errors"),
        F.when(F.col("o_totalprice") > 400000, 3).otherwise(0).alias("skipped"),
    )
    return r.suite_totals(counts)


def test_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.test_history(inputs.results(spark, sf_dir), "1-URGENT")


def fallback_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fallback decisions."""
    decisions = inputs.table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("test_case_id"), F.col("event_type").alias("module_type"),
        F.lit("csv").alias("format_type"), F.col("ts").alias("decision_timestamp"),
    )
    return r.fallback_history(decisions, module_type="error", start="2024-01-05 00:00:00", end="2024-01-20 12:00:00")


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        F.col("event_id").alias("id"), F.when(F.col("value") > 20, "OPEN").otherwise("RESOLVED").alias("resolution_status"),
        F.lit(None).cast("string").alias("resolution_notes"), F.lit("converter").alias("module_type"), F.col("ts").alias("created_at"),
    )


def module_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.module_issues(_issues(spark, sf_dir), status="OPEN", start="2024-01-03 00:00:00")


def update_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = _issues(spark, sf_dir)
    closed = issues.filter("created_at < '2024-01-10'").select(
        "id", F.lit("RESOLVED").alias("resolution_status"), F.lit("closed in review").alias("resolution_notes")
    )
    return r.update_by_id(issues, "id", closed)


def _schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = inputs.table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("schedule_id"),
        F.col("o_custkey").alias("test_case_name"),
        F.col("o_orderpriority").alias("sid"),
        F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("enabled"),
        F.col("o_orderdate").alias("created_at"),
        F.timestamp_add("DAY", F.lit(30), "o_orderdate").alias("next_run_time"),
    )


def due_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("1999-06-01 00:00:00").cast("timestamp_ntz")
    return r.due_rows(_schedules(spark, sf_dir), now, ["test_case_name", "sid"])


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = inputs.table(spark, sf_dir, "orders")
    frequency = F.when(F.col("o_orderstatus") == "F", "daily").when(F.col("o_orderstatus") == "O", "Weekly").otherwise("monthly")
    return o.select(
        "o_orderkey",
        F.timestamp_add("MINUTE", (F.col("o_orderkey") % 1440).cast("int"), "o_orderdate").alias("now"),
        frequency.alias("frequency"),
        (F.col("o_custkey") % 7).cast("int").alias("day"),
        (F.col("o_custkey") % 31 + 1).cast("int").alias("month_day"),
    )


def next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _planned(spark, sf_dir)
    at = schedule.next_run(p.now, p.frequency, p.day, p.month_day)
    iso = schedule.next_run(p.now, p.frequency, p.day + 1, p.month_day, variant="iso")
    return p.select("o_orderkey", at.alias("next_run"), iso.alias("next_run_iso"))


def duration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.results(spark, sf_dir)
    text = schedule.duration_text(F.col("execution_start_time"), F.col("execution_end_time"))
    return rows.select("execution_id", text.alias("duration"))


def _raw_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as they arrive: all text, some fields wrong or missing."""
    o = inputs.table(spark, sf_dir, "orders")
    digest = F.md5(F.col("o_orderkey").cast("string"))
    uuid = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12))
    return o.select(
        F.col("o_orderkey").alias("execution_id"),
        F.when(F.col("o_totalprice") < 5000, F.col("o_orderpriority")).otherwise(uuid).alias("traceability_id"),
        F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "Passed").otherwise(F.lit(None)).alias("status"),
        F.when(F.col("o_totalprice") > 490000, "-4").otherwise(F.floor("o_totalprice").cast("string")).alias("source_count"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("start_time"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(F.col("o_orderpriority")).alias("table_name"),
    )


def accept_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = r.accept_results(_raw_results(spark, sf_dir))
    return checked.select("execution_id", "accepted", F.array_join("reasons", ",").alias("reasons"))


def fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.fill_defaults(_raw_results(spark, sf_dir)).select("execution_id", "status", "table_name", "source_count")


def field_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inputs.table(spark, sf_dir, "events")
    day = F.date_format("ts", "dd").cast("int")
    date = F.concat(F.lit("2024-02-"), day.cast("string"))
    return e.select(
        "event_id",
        v.valid_date(date).alias("date_ok"),
        v.valid_status(F.col("event_type")).alias("status_ok"),
        v.valid_day_of_week(day - 3).alias("weekday_ok"),
        v.valid_day_of_month(F.when(F.col("value") > 30, day + 5)).alias("month_day_ok"),
        v.valid_count(F.col("value").cast("string")).alias("count_ok"),
        v.valid_frequency(F.when(F.col("event_type") == "view", "DAILY").otherwise(F.col("event_type"))).alias("frequency_ok"),
        v.valid_module_type(F.when(F.col("event_type") == "click", "Converter").otherwise(F.lit("x"))).alias("module_ok"),
        v.valid_format_type(F.when(F.col("event_type") == "click", "CSV").otherwise(F.lit("xlsx"))).alias("format_ok"),
    )


def append_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = inputs.table(spark, sf_dir, "orders")
    notes = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).when(F.col("o_orderstatus") == "O", "")
    added = F.when(F.col("o_totalprice") > 100000, "checked")
    return o.select("o_orderkey", r.append_notes(notes, added).alias("notes"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.results(spark, sf_dir).withColumn("execution_run_id", F.col("traceability_id"))
    runs = r.run_status(r.run_rollup(rows)).withColumns({
        "run_name": F.concat(F.lit("run "), F.col("execution_run_id")),
        "start_time": F.lit(None).cast("timestamp_ntz"), "end_time": F.lit(None).cast("timestamp_ntz"),
        "executed_by": F.lit("batch"),
    })
    return r.run_summary(runs, "2-HIGH")


_ROLLUP = """rollup AS (
  SELECT execution_run_id, count(*) AS total_test_cases, count(*) FILTER (status = 'PASS') AS passed_test_cases,
         count(*) FILTER (status IN ('FAIL', 'FAILED')) AS failed_test_cases
  FROM results GROUP BY execution_run_id)"""

_STATUS = """CASE WHEN total_test_cases = 0 THEN 'UNKNOWN' WHEN failed_test_cases = 0 THEN 'PASS'
            WHEN passed_test_cases = 0 THEN 'FAIL' ELSE 'PARTIAL' END AS overall_status,
       'Summary: ' || passed_test_cases || ' passed, ' || failed_test_cases || ' failed out of ' || total_test_cases || ' test cases.' AS notes"""

_INCOMING = """
incoming AS (
  SELECT -1 - execution_id AS execution_id, execution_run_id, traceability_id, execution_start_time, execution_end_time,
         CASE WHEN status = 'FAIL' THEN 'PASS' END AS status, source_count + 5 AS source_count, created_at
  FROM results WHERE status <> 'PENDING'
  UNION ALL
  SELECT -1000000000000 - execution_id, -1 - execution_run_id, traceability_id, execution_start_time, execution_end_time,
         status, source_count, created_at
  FROM results WHERE status <> 'PENDING' AND source_count < 30000
)"""

_RAW = """raw AS (
  SELECT o_orderkey AS execution_id, o_totalprice < 5000 AS bad_id,
         CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'Passed' END AS status,
         CASE WHEN o_totalprice > 490000 THEN '-4' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS source_count,
         o_orderpriority = '5-LOW' AS bad_time,
         CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE o_orderpriority END AS table_name
  FROM orders)"""

_PLANNED = """p AS (
  SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS now, CAST(o_orderdate AS DATE) AS today,
         o_orderstatus AS s, CAST(o_custkey % 7 AS INTEGER) AS day, CAST(o_custkey % 31 + 1 AS INTEGER) AS month_day FROM orders
), q AS (
  SELECT *, (day - (isodow(today) - 1) + 6) % 7 + 1 AS ahead_raw,
         CAST(date_trunc('month', today) AS DATE) AS m0, CAST(date_trunc('month', today) + INTERVAL 1 MONTH AS DATE) AS m1 FROM p
), d AS (
  SELECT *, CASE WHEN day - (isodow(today) - 1) <= 0 THEN day - (isodow(today) - 1) + 7 ELSE day - (isodow(today) - 1) END AS ahead,
         m1 + CAST(least(month_day, day(last_day(m1))) AS INTEGER) - 1 AS in_next,
         m0 + CAST(least(month_day, day(last_day(m0))) AS INTEGER) - 1 AS in_this FROM q)"""

QUERIES = {
    "latest_per_group": (latest_per_group, """SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"""),
    "latest_with_ties": (latest_with_ties, """SELECT * EXCLUDE (rk) FROM (
  SELECT *, rank() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderdate DESC) AS rk FROM orders) WHERE rk = 1"""),
    "upsert_results": (upsert_results, f"""WITH {inputs.RESULTS}, {_INCOMING},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY traceability_id, execution_run_id ORDER BY created_at, execution_id) AS up,
         row_number() OVER (PARTITION BY traceability_id, execution_run_id ORDER BY created_at DESC, execution_id DESC) AS down
  FROM incoming),
firsts AS (SELECT * FROM numbered WHERE up = 1), lasts AS (SELECT * FROM numbered WHERE down = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY traceability_id, execution_run_id ORDER BY created_at DESC, execution_id DESC) AS rn
  FROM results)
SELECT r.execution_id, r.execution_run_id, r.traceability_id, r.execution_start_time,
       CASE WHEN l.up IS NULL THEN r.execution_end_time ELSE l.execution_end_time END AS execution_end_time,
       CASE WHEN l.up IS NULL THEN r.status ELSE l.status END AS status,
       CASE WHEN l.up IS NULL THEN r.source_count ELSE l.source_count END AS source_count, r.created_at
FROM ranked r LEFT JOIN lasts l
  ON r.rn = 1 AND l.traceability_id = r.traceability_id AND l.execution_run_id = r.execution_run_id
UNION ALL
SELECT f.execution_id, f.execution_run_id, f.traceability_id, f.execution_start_time, l.execution_end_time, l.status,
       l.source_count, f.created_at
FROM firsts f JOIN lasts l ON l.traceability_id = f.traceability_id AND l.execution_run_id = f.execution_run_id
WHERE NOT EXISTS (SELECT 1 FROM results r
  WHERE r.traceability_id = f.traceability_id AND r.execution_run_id = f.execution_run_id)"""),
    "insert_if_absent": (insert_if_absent, f"""WITH {inputs.RESULTS}, {_INCOMING},
firsts AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY traceability_id, execution_run_id ORDER BY execution_id) AS rn FROM incoming) WHERE rn = 1)
SELECT * FROM results
UNION ALL SELECT * FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM results r
  WHERE r.traceability_id = f.traceability_id AND r.execution_run_id = f.execution_run_id)"""),
    "insert_with_force": (insert_with_force, f"""WITH {inputs.RESULTS}, {_INCOMING},
lasts AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY traceability_id, execution_run_id ORDER BY execution_id DESC) AS rn FROM incoming) WHERE rn = 1)
SELECT * FROM lasts
UNION ALL SELECT * FROM results r WHERE NOT EXISTS (SELECT 1 FROM lasts l
  WHERE r.traceability_id = l.traceability_id AND r.execution_run_id = l.execution_run_id)"""),
    "run_rollup": (run_rollup, f"WITH {inputs.RESULTS}, {_ROLLUP} SELECT * FROM rollup"),
    "run_status": (run_status, f"WITH {inputs.RESULTS}, {_ROLLUP} SELECT *, {_STATUS} FROM rollup"),
    "all_passed_status": (all_passed_status, f"""WITH {inputs.RESULTS}
SELECT execution_run_id, CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAILED' ELSE 'PASSED' END AS overall_status
FROM results GROUP BY execution_run_id"""),
    "suite_totals": (suite_totals, """WITH c AS (
  SELECT o_orderpriority AS directory, 10 AS run, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS failed,
         CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS errors, CASE WHEN o_totalprice > 400000 THEN 3 ELSE 0 END AS skipped
  FROM orders),
t AS (SELECT directory, grouping(directory) = 1 AS is_total, CAST(sum(run) AS BIGINT) AS run, CAST(sum(failed) AS BIGINT) AS failed,
         CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(skipped) AS BIGINT) AS skipped FROM c GROUP BY ROLLUP (directory))
SELECT *, run - failed - errors - skipped AS passed FROM t"""),
    "test_history": (test_history, f"""WITH {inputs.RESULTS}
SELECT execution_id, execution_start_time AS start_time, execution_end_time AS end_time, status
FROM results WHERE traceability_id = '1-URGENT' ORDER BY start_time DESC"""),
    "fallback_history": (fallback_history, """SELECT event_id, CAST(user_id AS VARCHAR) AS test_case_id, event_type AS module_type,
       'csv' AS format_type, ts AS decision_timestamp
FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:00:00'"""),
    "module_issues": (module_issues, """SELECT event_id AS id, 'OPEN' AS resolution_status, CAST(NULL AS VARCHAR) AS resolution_notes,
       'converter' AS module_type, ts AS created_at
FROM events WHERE event_type = 'error' AND value > 20 AND ts >= TIMESTAMP '2024-01-03'"""),
    "update_by_id": (update_by_id, """SELECT event_id AS id,
       CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'RESOLVED' WHEN value > 20 THEN 'OPEN' ELSE 'RESOLVED' END AS resolution_status,
       CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'closed in review' END AS resolution_notes,
       'converter' AS module_type, ts AS created_at
FROM events WHERE event_type = 'error'"""),
    "due_rows": (due_rows, """WITH s AS (
  SELECT o_orderkey AS schedule_id, o_custkey AS test_case_name, o_orderpriority AS sid,
         CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS enabled, o_orderdate AS created_at,
         o_orderdate + INTERVAL 30 DAY AS next_run_time FROM orders)
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY test_case_name, sid ORDER BY created_at DESC, schedule_id DESC) AS rn FROM s)
WHERE rn = 1 AND enabled = 1 AND next_run_time <= TIMESTAMP '1999-06-01'"""),
    "next_run": (next_run, f"""WITH {_PLANNED}
SELECT o_orderkey,
       CASE s WHEN 'F' THEN CAST(today + 1 AS TIMESTAMP) + INTERVAL 6 HOUR
              WHEN 'O' THEN CAST(today + CAST(ahead AS INTEGER) AS TIMESTAMP) + INTERVAL 6 HOUR
              ELSE CAST(in_next AS TIMESTAMP) + INTERVAL 6 HOUR END AS next_run,
       CASE s WHEN 'F' THEN now + INTERVAL 1 DAY WHEN 'O' THEN now + to_days(CAST(ahead AS INTEGER))
              ELSE CAST(CASE WHEN day(today) < month_day THEN in_this ELSE in_next END AS TIMESTAMP) END AS next_run_iso
FROM d"""),
    "duration_text": (duration_text, f"""WITH {inputs.RESULTS},
m AS (SELECT execution_id, date_diff('second', execution_start_time, execution_end_time) AS s FROM results)
SELECT execution_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's'
  WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS duration FROM m"""),
    "accept_results": (accept_results, f"""WITH {_RAW}, c AS (
  SELECT execution_id, concat_ws(',', CASE WHEN bad_id THEN 'traceability_id' END,
    CASE WHEN source_count = '-4' THEN 'source_count' END, CASE WHEN status = 'Passed' THEN 'status' END,
    CASE WHEN bad_time THEN 'start_time' END) AS reasons FROM raw)
SELECT execution_id, reasons = '' AS accepted, reasons FROM c"""),
    "fill_defaults": (fill_defaults, f"""WITH {_RAW}
SELECT execution_id, coalesce(status, 'FAIL') AS status, coalesce(nullif(table_name, ''), 'unknown') AS table_name, source_count FROM raw"""),
    "field_checks": (field_checks, """WITH d AS (SELECT *, day(ts) AS d FROM events)
SELECT event_id, d <= 29 AS date_ok, event_type = 'error' AS status_ok, d - 3 BETWEEN 0 AND 6 AS weekday_ok,
       coalesce(value > 30, false) = false OR d + 5 <= 31 AS month_day_ok,
       regexp_full_match(CAST(value AS VARCHAR), '\\d+') AS count_ok, event_type = 'view' AS frequency_ok,
       event_type = 'click' AS module_ok, event_type = 'click' AS format_ok FROM d"""),
    "append_notes": (append_notes, """SELECT o_orderkey, nullif(concat_ws(chr(10),
       CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, CASE WHEN o_totalprice > 100000 THEN 'checked' END), '') AS notes FROM orders"""),
    "run_summary": (run_summary, f"""WITH {inputs.RESULTS}, {_ROLLUP.replace('SELECT execution_run_id', 'SELECT traceability_id AS execution_run_id').replace('GROUP BY execution_run_id', 'GROUP BY traceability_id')}
SELECT execution_run_id, 'run ' || execution_run_id AS run_name, CAST(NULL AS TIMESTAMP) AS start_time, CAST(NULL AS TIMESTAMP) AS end_time,
       total_test_cases, passed_test_cases, failed_test_cases, {_STATUS}, 'batch' AS executed_by
FROM rollup WHERE execution_run_id = '2-HIGH'"""),
}
