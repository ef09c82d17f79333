"""Result tables: latest rows, upserts, rollups, history, acceptance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import validators
from tallymark.operators.keys import col

# What stands in for a missing field of a result row.
RESULT_DEFAULTS = {
    "test_case_name": "unknown",
    "table_name": "unknown",
    "sid": "unknown",
    "status": "FAIL",
    "source_count": 0,
    "target_count": 0,
    "mismatched_records": 0,
    "null_records": 0,
    "duplicate_records": 0,
}
_COUNT_FIELDS = ("source_count", "target_count", "mismatched_records", "null_records", "duplicate_records")
_STATUS_FIELDS = (
    "status", "schema_validation_status", "count_validation_status", "data_validation_status",
    "null_check_status", "duplicate_check_status", "rule_validation_status",
)
_TIME_FIELDS = ("start_time", "end_time")


def latest_per_group(
    df: DataFrame, group: Sequence[str], order: str, tie_breaker: str | None = None, keep_ties: bool = False
) -> DataFrame:
    """The rows with the greatest ``order`` per group; null groups count as groups.

    One row per group (by ``tie_breaker``, greatest first), or with ``keep_ties`` every row that
    shares the greatest value. The maximum is a partial aggregate instead of a sorted window, so
    a group with a third of all rows is reduced on the map side.
    """
    keys = [col(g) for g in group]
    if not keep_ties:
        by = [col(order)] + ([col(tie_breaker)] if tie_breaker else [])
        best = df.groupBy(*keys).agg(F.max_by(F.struct(*[col(c) for c in df.columns]), F.struct(*by)).alias("_row"))
        return best.select(*[F.col("_row")[c].alias(c) for c in df.columns])
    top = df.groupBy(*[col(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg(F.max(col(order)).alias("_top"))
    match = [col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    return df.join(top, [*match, col(order).eqNullSafe(F.col("_top"))], "left_semi")


def null_orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """``children`` with references that have no parent set to null."""
    known = parents.select(col(parent_key).alias("_parent")).distinct()
    joined = children.join(known, col(child_key) == F.col("_parent"), "left_outer")
    return joined.select(*[
        F.when(F.col("_parent").isNotNull(), col(c)).alias(c) if c == child_key else col(c) for c in children.columns
    ])


def upsert_results(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    row_id: str,
    order: str,
    updated: Sequence[str],
) -> DataFrame:
    """Update the latest existing row of each key from ``incoming``, insert where there is none.

    ``existing`` and ``incoming`` have the same columns; ``row_id`` is unique in each, ``order``
    says what is latest and in which order incoming rows arrive. An update replaces the
    ``updated`` columns, nulls included, and keeps the others. Of several incoming rows of a key,
    the last gives the updated columns and, for an insert, the first the rest. A row with a null
    in its key is always inserted.
    """
    names = existing.columns
    keyed = reduce(lambda a, b: a & b, [col(k).isNotNull() for k in keys])
    position = F.struct(col(order), col(row_id))
    row = F.struct(*[col(c) for c in names])
    arrived = (
        incoming.filter(keyed)
        .groupBy(*[col(k).alias(f"_i{i}") for i, k in enumerate(keys)])
        .agg(F.min_by(row, position).alias("_first"), F.max_by(row, position).alias("_last"))
    )
    latest = (
        existing.filter(keyed)
        .groupBy(*[col(k).alias(f"_e{i}") for i, k in enumerate(keys)])
        .agg(F.max_by(col(row_id), position).alias("_hit"))
    )
    same = [F.col(f"_i{i}") == F.col(f"_e{i}") for i in range(len(keys))]
    routed = arrived.join(latest, same, "left_outer").select("_hit", "_first", "_last")
    updates = routed.filter("_hit IS NOT NULL").select("_hit", "_last")
    kept = existing.join(updates, col(row_id) == F.col("_hit"), "left_outer").select(*[
        F.when(F.col("_hit").isNotNull(), F.col("_last")[c]).otherwise(col(c)).alias(c) if c in updated else col(c)
        for c in names
    ])
    inserts = routed.filter("_hit IS NULL").select(*[
        (F.col("_last") if c in updated else F.col("_first"))[c].alias(c) for c in names
    ])
    unkeyed = incoming.filter(~keyed).select(*[col(c) for c in names])
    return kept.unionByName(inserts).unionByName(unkeyed)


def insert_if_absent(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str, force: bool = False
) -> DataFrame:
    """Append incoming rows whose key is new; with ``force`` they replace rows of their key.

    Of several incoming rows of a key the first by ``order`` is taken, with ``force`` the last. A
    row with a null in its key meets no other row.
    """
    names = existing.columns
    keyed = reduce(lambda a, b: a & b, [col(k).isNotNull() for k in keys])
    row = F.struct(*[col(c) for c in names])
    chosen = F.max_by(row, col(order)) if force else F.min_by(row, col(order))
    new = incoming.filter(keyed).groupBy(*[col(k) for k in keys]).agg(chosen.alias("_row"))
    new = new.select(*[F.col("_row")[c].alias(c) for c in names])
    unkeyed = incoming.filter(~keyed).select(*[col(c) for c in names])

    def without(df: DataFrame, other: DataFrame) -> DataFrame:
        known = other.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
        return df.join(known, [col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)], "left_anti")

    if force:
        return without(existing, new).unionByName(new).unionByName(unkeyed)
    return existing.unionByName(without(new, existing)).unionByName(unkeyed)


def run_rollup(results: DataFrame, run: str = "execution_run_id", status: str = "status") -> DataFrame:
    """Total, passed (``PASS``) and failed (``FAIL``, ``FAILED``) per run; others count in the total only."""
    return results.groupBy(col(run)).agg(
        F.count("*").alias("total_test_cases"),
        F.count_if(col(status) == "PASS").alias("passed_test_cases"),
        F.count_if(col(status).isin("FAIL", "FAILED")).alias("failed_test_cases"),
    )


def run_status(rollup: DataFrame) -> DataFrame:
    """``overall_status`` and a summary note for the counts of :func:`run_rollup`."""
    total, passed, failed = (F.col(f"{n}_test_cases") for n in ("total", "passed", "failed"))
    status = (
        F.when(total == 0, "UNKNOWN").when(failed == 0, "PASS").when(passed == 0, "FAIL").otherwise("PARTIAL")
    )
    note = F.format_string("Summary: %d passed, %d failed out of %d test cases.", passed, failed, total)
    return rollup.withColumns({"overall_status": status, "notes": note})


def all_passed_status(results: DataFrame, run: str, status: str = "status") -> DataFrame:
    """``PASSED`` per run if nothing in it has status ``FAILED``, else ``FAILED``."""
    failed = F.coalesce(F.bool_or(col(status) == "FAILED"), F.lit(False))
    return results.groupBy(col(run)).agg(F.when(failed, "FAILED").otherwise("PASSED").alias("overall_status"))


def suite_totals(counts: DataFrame, directory: str = "directory") -> DataFrame:
    """Totals per directory and, with a null directory, over all; passed is what is left of run.

    ``is_total`` tells the grand total from a directory that is null itself.
    """
    totals = counts.rollup(col(directory)).agg(
        (F.grouping(col(directory)) == 1).alias("is_total"),
        *[F.sum(c).alias(c) for c in ("run", "failed", "errors", "skipped")],
    )
    passed = F.col("run") - F.col("failed") - F.col("errors") - F.col("skipped")
    return totals.withColumn("passed", passed)


def test_history(results: DataFrame, traceability_id: str) -> DataFrame:
    """The executions of a test, newest first."""
    return (
        results.filter(F.col("traceability_id") == traceability_id)
        .select(
            "execution_id",
            F.col("execution_start_time").alias("start_time"),
            F.col("execution_end_time").alias("end_time"),
            "status",
        )
        .orderBy(F.col("start_time").desc_nulls_last())
    )


def filtered_history(
    df: DataFrame,
    equals: Mapping[str, str | None],
    time_column: str,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Rows that meet the predicates that were given: equal columns and a time range."""
    predicates = [col(c) == v for c, v in equals.items() if v]
    if start:
        predicates.append(col(time_column) >= F.lit(start))
    if end:
        predicates.append(col(time_column) <= F.lit(end))
    return reduce(lambda d, p: d.filter(p), predicates, df)


def fallback_history(
    decisions: DataFrame,
    test_case_id: str | None = None,
    module_type: str | None = None,
    format_type: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    equals = {"test_case_id": test_case_id, "module_type": module_type, "format_type": format_type}
    return filtered_history(decisions, equals, "decision_timestamp", start, end)


def module_issues(
    issues: DataFrame,
    status: str | None = None,
    module_type: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    equals = {"resolution_status": status, "module_type": module_type}
    return filtered_history(issues, equals, "created_at", start, end)


def due_rows(
    schedules: DataFrame,
    now: Column | str,
    latest_by: Sequence[str] | None = None,
    run_now: bool = False,
) -> DataFrame:
    """Enabled schedules whose ``next_run_time`` has come (with ``run_now``: all enabled ones).

    ``latest_by`` keeps the latest schedule per group (by ``created_at``, then ``schedule_id``)
    before the filter, so an older schedule cannot stand in for a disabled one.
    """
    rows = latest_per_group(schedules, latest_by, "created_at", "schedule_id") if latest_by else schedules
    enabled = rows.filter(F.col("enabled") == 1)
    return enabled if run_now else enabled.filter(F.col("next_run_time") <= now)


def rejected_reasons(df: DataFrame) -> Column:
    """Why a result row may not be stored, as an array of field names; empty when it may."""
    checks: list[tuple[str, Column]] = [("traceability_id", validators.valid_traceability_id(F.col("traceability_id")))]
    present = {c: col(c) for c in df.columns}
    for names, check in (
        (_COUNT_FIELDS, validators.valid_count),
        (_STATUS_FIELDS, validators.valid_status),
        (_TIME_FIELDS, validators.valid_date),
    ):
        checks += [(n, present[n].isNull() | check(present[n])) for n in names if n in present]
    if "execution_run_id" in present:
        run = present["execution_run_id"]
        given = F.coalesce(run != "", F.lit(False))
        checks.append(("execution_run_id", ~given | validators.valid_traceability_id(run)))
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks]))


def accept_results(df: DataFrame) -> DataFrame:
    """``df`` with ``reasons`` and ``accepted``; filter on the latter to split it."""
    return df.withColumn("reasons", rejected_reasons(df)).withColumn("accepted", F.size("reasons") == 0)


def fill_defaults(df: DataFrame, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Put the default where a field is null or an empty text."""
    filled = {}
    for name, value in (defaults or RESULT_DEFAULTS).items():
        if name in df.columns:
            current = F.nullif(col(name), F.lit("")) if isinstance(value, str) else col(name)
            filled[name] = F.coalesce(current, F.lit(value).cast(df.schema[name].dataType))
    return df.withColumns(filled) if filled else df


def update_by_id(df: DataFrame, row_id: str, updates: DataFrame) -> DataFrame:
    """Replace columns of ``df`` by those of ``updates`` for rows with an id in it (unique there)."""
    changed = [c for c in updates.columns if c != row_id]
    new = updates.select(col(row_id).alias("_id"), *[col(c).alias(f"_new_{c}") for c in changed])
    joined = df.join(new, col(row_id) == F.col("_id"), "left_outer")
    return joined.select(*[
        F.when(F.col("_id").isNotNull(), F.col(f"_new_{c}")).otherwise(col(c)).alias(c) if c in changed else col(c)
        for c in df.columns
    ])


def append_notes(notes: Column, added: Column) -> Column:
    """Existing notes, a newline and the added ones; either alone when the other is empty."""
    return F.nullif(F.concat_ws("\n", F.nullif(notes, F.lit("")), F.nullif(added, F.lit(""))), F.lit(""))


def run_summary(runs: DataFrame, execution_run_id: str) -> DataFrame:
    return runs.filter(F.col("execution_run_id") == execution_run_id).select(
        "execution_run_id", "run_name", "start_time", "end_time", "total_test_cases", "passed_test_cases",
        "failed_test_cases", "overall_status", "executed_by", "notes",
    )
