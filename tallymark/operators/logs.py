"""Facts from log lines: one row per line with ``run_id``, ``line_no`` and ``line``.

``line_no`` orders the lines of a run and is unique in it. Everything is a grouped aggregate
with partial aggregation, so a run with very many lines does not flow into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions import logtext
from tallymark.operators.keys import col
from tallymark.session import broadcast_if_small, durable

_LINES_PER_BLOCK = 100_000


def fix_unknown_origin(logs: DataFrame) -> DataFrame:
    """Replace ``module`` and ``function`` of rows where either is ``unknown``, from the message."""
    found = logs.withColumn("_origin", F.when(_unknown_origin(), logtext.message_origin(F.col("message"))))
    module, function = F.col("_origin.module"), F.col("_origin.function")
    better = F.coalesce((module != logtext.UNKNOWN) | (function != logtext.UNKNOWN), F.lit(False))
    return found.withColumns({
        "module": F.when(better, module).otherwise(F.col("module")),
        "function": F.when(better, function).otherwise(F.col("function")),
    }).drop("_origin")


def _unknown_origin() -> Column:
    return (F.col("module") == logtext.UNKNOWN) | (F.col("function") == logtext.UNKNOWN)


def unknown_count(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count_if(_unknown_origin()).alias("remaining"))


def unknown_sample(logs: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` distinct rows still unknown, in text order."""
    names = ["message", "level", "module", "function"]
    return logs.filter(_unknown_origin()).select(*names).distinct().orderBy(*names).limit(n)


def redact_column(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, logtext.redact(col(column)))


def console_outcome(lines: DataFrame) -> DataFrame:
    """``FAILED`` / ``PASSED`` / ``UNKNOWN`` per run; one failure word outweighs any success word."""
    return (
        lines.groupBy("run_id")
        .agg(
            F.bool_or(logtext.contains_any(F.col("line"), logtext.FAILURE_WORDS)).alias("_failed"),
            F.bool_or(logtext.contains_any(F.col("line"), logtext.SUCCESS_WORDS)).alias("_passed"),
        )
        .select(
            "run_id", F.when(F.col("_failed"), "FAILED").when(F.col("_passed"), "PASSED").otherwise("UNKNOWN").alias("outcome")
        )
    )


def _last(value: Column, when: Column) -> Column:
    """The value on the last line for which the condition holds."""
    return F.max_by(value, F.when(when, F.col("line_no")))


def _first(value: Column, when: Column) -> Column:
    return F.min_by(value, F.when(when, F.col("line_no")))


def run_facts(lines: DataFrame, return_code: str | None = None) -> DataFrame:
    """Status, source and target count, and last error line of each run.

    The last ``validation passed`` or ``validation failed`` decides; without one, the return code
    (a column that is the same on all lines of a run) or ``PASSED``. Counts stand after the first
    colon of their line; a line whose count is no number is passed over.
    """
    low = F.lower("line")
    number = logtext.leading_integer(F.regexp_extract("line", r"(?s)^[^:]*:(.*)$", 1))
    passed, failed = low.contains("validation passed"), low.contains("validation failed")
    initial = F.lit("PASSED")
    if return_code:
        initial = F.when(F.bool_or(col(return_code) != 0), "FAILED").otherwise("PASSED")
    verdict = _last(F.when(passed, "PASSED").otherwise("FAILED"), passed | failed)
    return lines.groupBy("run_id").agg(
        F.coalesce(verdict, initial).alias("status"),
        _last(number, low.contains("source count:") & number.isNotNull()).alias("source_count"),
        _last(number, low.contains("target count:") & number.isNotNull()).alias("target_count"),
        _last(F.col("line"), low.contains("error:")).alias("error_message"),
    )


def test_counts(lines: DataFrame) -> DataFrame:
    """Tests run, errors, failures and skipped per run; 0 where the log does not say.

    The last ``Ran n tests in`` counts; errors and failures come from the first line that has
    both ``errors=`` and ``failures=``, skipped from the first line with ``skipped=``.
    """
    line = F.col("line")

    def number(pattern: str) -> Column:
        return F.regexp_extract(line, pattern, 1).try_cast("long")

    both = line.contains("errors=") & line.contains("failures=")
    numbers = {"_ran": number(r"Ran (\d+) tests in "), "_skipped": number(r"skipped=(\d+)")}
    numbers |= {f"_{w}": F.when(both, number(rf"{w}=(\d+)")) for w in ("errors", "failures")}
    parsed = lines.select("run_id", "line_no", *[c.alias(n) for n, c in numbers.items()])
    ran, errors, failures, skipped = (F.col(c) for c in ("_ran", "_errors", "_failures", "_skipped"))

    def filled(value: Column, name: str) -> Column:
        return F.coalesce(value, F.lit(0)).alias(name)

    return parsed.groupBy("run_id").agg(
        filled(_last(ran, ran.isNotNull()), "run"),
        filled(_first(errors, errors.isNotNull()), "errors"),
        filled(_first(failures, failures.isNotNull()), "failures"),
        filled(_first(skipped, skipped.isNotNull()), "skipped"),
    )


def failure_reason(lines: DataFrame) -> DataFrame:
    """The first error line of each run, else its first ``FAIL:`` line, else null."""
    line = F.col("line")
    asserted = line.contains("AssertionError:")
    detail = F.regexp_extract("line", "AssertionError:(.+)", 1)
    raised = ~asserted & (line.contains("Error:") | line.contains("Exception:"))
    reason = F.when(asserted & (detail != ""), F.concat(F.lit("AssertionError: "), F.trim(detail))).when(raised, F.trim(line))
    failed = line.contains("FAIL:") & ~line.startswith("❌")
    priority = F.when(reason.isNotNull(), 0).when(failed, 1)
    order = F.when(priority.isNotNull(), F.struct(priority.alias("priority"), F.col("line_no").alias("line_no")))
    return lines.groupBy("run_id").agg(F.min_by(F.coalesce(reason, F.trim(line)), order).alias("reason"))


def carry_forward(lines: DataFrame, value: Column, out: str) -> DataFrame:
    """Add ``out``: the last non-null ``value`` of the run up to and including each line.

    Lines are cut into blocks by ``line_no``, as wide as the run's numbers are sparse; a block is filled on its own, and its
    opening value comes from a window over the blocks of the run, one row each.
    """
    spread = lines.groupBy(F.col("run_id").alias("_run")).agg(
        F.min("line_no").alias("_low"), F.ceil((F.max("line_no") - F.min("line_no") + 1) / F.count("*") * _LINES_PER_BLOCK).alias("_wide"))
    spaced = lines.join(broadcast_if_small(durable(spread)), F.col("run_id").eqNullSafe(F.col("_run")))
    block = F.floor((F.col("line_no") - F.col("_low")) / F.col("_wide"))
    blocks = spaced.withColumn("_block", block).withColumn("_value", value).drop("_run", "_low", "_wide")
    last = blocks.groupBy(F.col("run_id").alias("_run"), F.col("_block").alias("_b")).agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("line_no"))).alias("_last")
    )
    earlier = Window.partitionBy("_run").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    opening = last.withColumn("_opening", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    so_far = Window.partitionBy("run_id", "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = blocks.withColumn("_inside", F.last("_value", ignorenulls=True).over(so_far))
    joined = filled.join(opening, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("_block") == F.col("_b")), "left_outer")
    return joined.withColumn(out, F.coalesce("_inside", "_opening")).drop("_block", "_value", "_inside", "_run", "_b", "_opening")


def _test_blocks(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with the start of their test, and per finished test its bounds and status."""
    line = F.col("line")
    starts = line.startswith("test_") & line.contains(" (") & line.endswith(" ... ")
    start = F.when(starts, F.struct(F.col("line_no").alias("no"), F.substring_index("line", " (", 1).alias("name")))
    inside = durable(carry_forward(lines, start, "_start").filter("_start IS NOT NULL AND line_no > _start.no").select(
        "run_id", "line_no", "line", F.col("_start.no").alias("start_no"), F.col("_start.name").alias("test_name")
    ))
    word = (
        F.when(line.endswith(" ... ok"), "pass")
        .when(line.endswith(" ... FAIL"), "fail")
        .when(line.endswith(" ... ERROR"), "error")
        .when(line.endswith(" ... skipped"), "skipped")
    )
    results = inside.withColumn("_word", word).filter("_word IS NOT NULL")
    test = ["run_id", "start_no", "test_name"]
    first = results.groupBy(*test).agg(F.min(F.struct("line_no", "_word")).alias("_result"))
    verdicts = first.select(
        F.col("run_id").alias("_run"), F.col("start_no").alias("_start_no"), F.col("test_name").alias("_test"),
        F.col("_result.line_no").alias("_result_no"), F.col("_result._word").alias("_status"),
    )
    same = F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("start_no") == F.col("_start_no"))
    ends = line.startswith("AssertionError") | line.contains("Error:")
    traces = line.startswith("Traceback")
    after = F.col("line_no") > F.col("_result_no")
    closing = inside.filter(ends | traces).select("run_id", "start_no", "line_no", "line")
    bounds = (
        closing.join(verdicts.filter("_status IN ('fail', 'error')"), same & after)
        .groupBy(F.col("_run").alias("_b_run"), F.col("_start_no").alias("_b_start"))
        .agg(
            F.min(F.when(ends, F.col("line_no"))).alias("_end_no"),
            F.min(F.when(traces, F.col("line_no"))).alias("_trace_no"),
        )
    )
    own = F.col("_run").eqNullSafe(F.col("_b_run")) & (F.col("_start_no") == F.col("_b_start"))
    found = verdicts.join(bounds, own, "left_outer")
    finished = found.filter("_status IN ('pass', 'skipped') OR _end_no IS NOT NULL").select(
        "_run", "_start_no", "_test", "_status",
        F.when(F.col("_trace_no") <= F.col("_end_no"), F.col("_trace_no")).alias("_from_no"), "_end_no",
    )
    return inside, finished


def test_statuses(lines: DataFrame) -> DataFrame:
    """Status of every finished test in verbose logs, with the line range of its message.

    A test starts at a line ``test_x (...) ... ``. Its status is the first later line ending in
    `` ... ok``, ``FAIL``, ``ERROR`` or ``skipped``. A failed test is finished by an error line;
    its message runs from the first ``Traceback`` line to that line.
    """
    _, finished = _test_blocks(lines)
    return finished.select(
        F.col("_run").alias("run_id"),
        F.col("_start_no").alias("start_no"),
        F.col("_test").alias("test_name"),
        F.col("_status").alias("status"),
        F.col("_from_no").alias("message_from"),
        F.when(F.col("_from_no").isNotNull(), F.col("_end_no")).alias("message_to"),
    )


def test_messages(lines: DataFrame) -> DataFrame:
    """The message lines of failed tests, one row per line; sort by ``line_no`` to read them."""
    inside, finished = _test_blocks(lines)
    wanted = finished.filter("_from_no IS NOT NULL")
    same = F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("start_no") == F.col("_start_no"))
    within = F.col("line_no").between(F.col("_from_no"), F.col("_end_no"))
    return inside.join(wanted, same & within).select("run_id", "start_no", "test_name", "line_no", "line")
