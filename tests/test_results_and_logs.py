from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallymark.functions import logtext, schedule, validators as v
from tallymark.operators import logs, results as r


def _value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def _ntz(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(("now", "frequency", "weekday", "month_day", "variant", "want"), [
    ("2024-01-31 10:00:00", "daily", None, None, "morning", "2024-02-01 06:00:00"),
    ("2024-01-31 10:00:00", "weekly", None, None, "morning", "2024-02-05 06:00:00"),
    ("2024-01-31 10:00:00", "weekly", 2, None, "morning", "2024-02-07 06:00:00"),
    ("2024-01-31 10:00:00", "Monthly", None, 31, "morning", "2024-02-29 06:00:00"),
    ("2024-12-05 10:00:00", "monthly", None, None, "morning", "2025-01-01 06:00:00"),
    ("2024-01-31 10:00:00", "hourly", None, None, "morning", "2024-02-01 06:00:00"),
    ("2024-01-31 10:00:00", "weekly", 3, None, "iso", "2024-02-07 10:00:00"),
    ("2024-02-10 10:00:00", "monthly", None, 31, "iso", "2024-02-29 00:00:00"),
    ("2024-02-10 10:00:00", "monthly", None, 5, "iso", "2024-03-05 00:00:00"),
])
def test_next_run(spark, now, frequency, weekday, month_day, variant, want):
    found = schedule.next_run(_ntz(now), F.lit(frequency), F.lit(weekday).cast("int"), F.lit(month_day).cast("int"), variant)
    assert str(_value(spark, found)) == want


@pytest.mark.parametrize(("end", "want"), [("00:00:07", "7s"), ("00:02:00", "2m 0s"), ("01:02:03", "1h 2m 3s")])
def test_duration(spark, end, want):
    assert _value(spark, schedule.duration_text(_ntz("2024-01-01 00:00:00"), _ntz(f"2024-01-01 {end}"))) == want


@pytest.mark.parametrize(("check", "good", "bad"), [
    (v.valid_date, ["2024-02-29", "2024-2-9", "2024-01-01 9:05:00"], ["2023-02-29", "24-01-01", "2024-01-01 25:00:00", "", None, "2024-01-01x"]),
    (v.valid_status, ["pass", "PARTIAL"], ["PASSED", "", None]),
    (v.valid_traceability_id, ["0AF00000-0000-0000-0000-00000000000f"], ["0af0", "", None]),
    (v.valid_count, ["0", " 12 ", "+3"], ["-1", "1.5", "x", None]),
    (v.valid_frequency, ["Daily"], ["yearly", None]),
])
def test_text_checks(spark, check, good, bad):
    assert all(_value(spark, check(F.lit(x).cast("string"))) for x in good)
    assert not any(_value(spark, check(F.lit(x).cast("string"))) for x in bad)


@pytest.mark.parametrize(("text", "want"), [
    ('Password: "x1", user', "[REDACTED_PASSWORD]\", user"),
    ("api-key=k9 token: t", "[REDACTED_API_KEY] [REDACTED_TOKEN]"),
    ("see JDBC://h/db?x=1 now", "see [REDACTED_CONNECTION_STRING] now"),
    ("a.b+c@mail.example.com!", "[REDACTED_EMAIL]!"),
    ("10.1.2.3 and 1234 5678-90123456", "[REDACTED_IP_ADDRESS] and [REDACTED_CREDIT_CARD]"),
    ("é10.1.2.3", "é10.1.2.3"),
    ("nothing here", "nothing here"),
])
def test_redact(spark, text, want):
    assert _value(spark, logtext.redact(F.lit(text))) == want


@pytest.mark.parametrize(("message", "want"), [
    ("Function Completed: load_rows", ("unknown", "load_rows")),
    ("Calling function: connect", ("db_handler", "connect")),
    ("[MODULE:core] [FUNCTION: run ] x", ("core", "run")),
    ("from tools import x", ("tools", "unknown")),
    ("Verifying the table", ("db_handler", "verify_tables")),
    ("Connected to database", ("db_handler", "connect")),
    ("Select it", ("db_handler", "execute_query")),
    ("Some Warning here", ("custom_logger", "warning")),
    ("blog", ("custom_logger", "log")),
    ("hello", ("unknown", "unknown")),
    ("open(x) in module io", ("io", "open")),
])
def test_message_origin(spark, message, want):
    assert tuple(_value(spark, logtext.message_origin(F.lit(message)))) == want


def _lines(spark, *runs):
    rows = [(run, i, line) for run, lines in enumerate(runs) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "run_id int, line_no int, line string")


def test_outcome(spark):
    lines = _lines(spark, ["ok", "All validations passed"], ["PASSED", "an Exception"], ["quiet"])
    assert {x.run_id: x.outcome for x in logs.console_outcome(lines).collect()} == {0: "PASSED", 1: "FAILED", 2: "UNKNOWN"}


def test_run_facts_last_line_wins(spark):
    lines = _lines(
        spark,
        ["Source Count: 5", "source count: many", "target count: 7", "Validation failed", "validation passed", "Error: a", "error: b"],
        ["nothing"],
    ).withColumn("code", F.col("run_id"))
    found = {x.run_id: x for x in logs.run_facts(lines, "code").collect()}
    assert (found[0].status, found[0].source_count, found[0].target_count, found[0].error_message) == ("PASSED", 5, 7, "error: b")
    assert (found[1].status, found[1].source_count) == ("FAILED", None)


def test_test_counts(spark):
    lines = _lines(spark, ["FAILED (errors=1, failures=2)", "Ran 3 tests in 1s", "x (errors=8, failures=9)", "Ran 4 tests in 1s", "skipped=2", "skipped=5"])
    row = logs.test_counts(lines).first()
    assert (row.run, row.errors, row.failures, row.skipped) == (4, 1, 2, 2)


def test_failure_reason(spark):
    lines = _lines(
        spark, ["FAIL: test_a", "AssertionError:", " x AssertionError: 1 != 2 ", "ValueError: v"], ["❌ FAIL: no", "FAIL: test_b"], ["ok"]
    )
    assert {x.run_id: x.reason for x in logs.failure_reason(lines).collect()} == {0: "AssertionError: 1 != 2", 1: "FAIL: test_b", 2: None}


@pytest.mark.parametrize("block", [1, 3, 100_000])
def test_verbose_log(spark, monkeypatch, block):
    monkeypatch.setattr(logs, "_LINES_PER_BLOCK", block)
    lines = _lines(spark, [
        "checks ... ok", "test_a (x.Y) ... ", "noise", "checks ... ok", "checks ... FAIL",
        "test_b (x.Y) ... ", "b ... FAIL", "noise", "Traceback (most recent call last):", "  line", "ValueError: no", "late Error:",
        "test_lost (x.Y) ... ", "test_c (x.Y) ... ", "c ... ERROR", "KeyError: before any trace", "Traceback",
        "test_d (x.Y) ... ", "d ... skipped", "test_e (x.Y) ... ", "e ... FAIL",
    ])
    found = {x.test_name: (x.status, x.message_from, x.message_to) for x in logs.test_statuses(lines).collect()}
    assert found == {"test_a": ("pass", None, None), "test_b": ("fail", 8, 10), "test_c": ("error", None, None), "test_d": ("skipped", None, None)}
    message = logs.test_messages(lines).orderBy("line_no").collect()
    assert [(x.test_name, x.line) for x in message] == [
        ("test_b", "Traceback (most recent call last):"), ("test_b", "  line"), ("test_b", "ValueError: no"),
    ]


RUNS = "id int, t string, run string, at int, status string, note string"


def test_upsert_updates_latest_and_keeps_the_rest(spark):
    existing = spark.createDataFrame([(1, "a", "r", 1, "FAIL", "n1"), (2, "a", "r", 2, "FAIL", "n2"), (3, "b", None, 1, "PASS", "n3")], RUNS)
    incoming = spark.createDataFrame([
        (10, "a", "r", 5, "RUNNING", "x"), (11, "a", "r", 6, None, "y"), (12, "c", "r", 5, "FAIL", "first"),
        (13, "c", "r", 6, "PASS", "second"), (14, "b", None, 5, "PASS", "z"),
    ], RUNS)
    rows = r.upsert_results(existing, incoming, ["t", "run"], "id", "at", ["status"]).collect()
    assert {x.id: (x.status, x.note) for x in rows} == {
        1: ("FAIL", "n1"), 2: (None, "n2"), 3: ("PASS", "n3"), 12: ("PASS", "first"), 14: ("PASS", "z"),
    }


def test_latest_per_group_with_null_group(spark):
    df = spark.createDataFrame([(1, None, 5), (2, None, 7), (3, "x", 1), (4, "x", 1)], "id int, g string, at int")
    assert sorted(x.id for x in r.latest_per_group(df, ["g"], "at", "id").collect()) == [2, 4]
    assert sorted(x.id for x in r.latest_per_group(df, ["g"], "at", keep_ties=True).collect()) == [2, 3, 4]


def test_run_status_table(spark):
    rollup = spark.createDataFrame([(0, 0, 0), (3, 0, 0), (3, 0, 2), (3, 1, 2)], "total_test_cases int, passed_test_cases int, failed_test_cases int")
    found = r.run_status(rollup).collect()
    assert [x.overall_status for x in found] == ["UNKNOWN", "PASS", "FAIL", "PARTIAL"]
    assert found[3].notes == "Summary: 1 passed, 2 failed out of 3 test cases."


def test_due_rows_look_at_the_latest_schedule(spark):
    rows = [(1, "t", 1, datetime(2024, 1, 1), datetime(2024, 1, 1)), (2, "t", 0, datetime(2024, 1, 2), datetime(2024, 1, 1)), (3, "u", 1, datetime(2024, 1, 1), datetime(2030, 1, 1))]
    df = spark.createDataFrame(rows, "schedule_id int, t string, enabled int, created_at timestamp, next_run_time timestamp")
    assert r.due_rows(df, F.lit("2024-06-01"), ["t"]).count() == 0
    assert [x.schedule_id for x in r.due_rows(df, F.lit("2024-06-01")).collect()] == [1]
    assert [x.schedule_id for x in r.due_rows(df, F.lit("2024-06-01"), ["t"], run_now=True).collect()] == [3]


def test_sample_result_row_is_accepted(spark):
    row = [("123e4567-e89b-12d3-a456-426614174000", "PASS", 100, 100, "2024-01-01 12:00:00", "2024-01-01 12:05:00", "")]
    df = spark.createDataFrame(row, "traceability_id string, status string, source_count int, target_count int, start_time string, end_time string, execution_run_id string")
    assert r.accept_results(df).first().accepted
    bad = df.withColumns({"status": F.lit("OK"), "target_count": F.lit(-1), "execution_run_id": F.lit("run")})
    assert r.accept_results(bad).first().reasons == ["target_count", "status", "execution_run_id"]


def test_defaults_keep_the_column_types(spark):
    df = spark.createDataFrame([(None, "x", ""), ("odd", None, None)], "source_count string, sid string, status string")
    filled = r.fill_defaults(df)
    assert filled.dtypes == df.dtypes
    assert [tuple(x) for x in filled.collect()] == [("0", "x", "FAIL"), ("odd", "unknown", "FAIL")]
