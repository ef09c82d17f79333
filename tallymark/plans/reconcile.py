"""The full comparison of a source and a target: all validations, a summary and a verdict."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import diff, keys as key_ops, profile, rules as rule_ops, schema
from tallymark.session import durable
from tallymark.sources.readers import read_dataset

VALIDATIONS = ("schema", "count", "data", "null", "duplicate")
_PLURALS = {"nulls": "null", "duplicates": "duplicate"}
_SUMMARY = ("position", "validation_type", "status", "details")

# The texts of the summary.
COUNTS_MATCH, COUNTS_DIFFER = "Counts match", "Source: %d, Target: %d"
SCHEMAS_MATCH = "Schemas match"
SCHEMAS_DIFFER = "Missing in Target: {missing_in_target}, Missing in Source: {missing_in_source}, Type Mismatches: {type_mismatch}"
COLUMNS_TEXT = "Total Columns: %d, Failed Columns: %d"
NO_NULLS, SOME_NULLS = "No null values found", "Columns with nulls: %d"
NO_DUPLICATES, SOME_DUPLICATES = "No duplicates found", "Duplicate records: %d (%.2f%%)"
RULES_PASSED, RULES_FAILED, NO_RULES = "All rules passed", "Failed Rules: %d", "No rule validation performed"
ALL_PASSED, SOME_FAILED = "All validations passed", "Some validations failed"

# The texts of the recommendations.
FAILED_COLUMN_TEXT = "Column '%s' failed with %d mismatches — check data formatting or join logic."
NULLS_TEXT = "Column '%s' has %.2f%% null values — verify if this is expected."
DUPLICATES_TEXT = "Found %.2f%% duplicate records — investigate if this is acceptable."


def normalise_validations(names: Sequence[str] | None) -> list[str]:
    """Lower case, plurals folded; ``None``, nothing, or ``all`` selects every validation."""
    wanted = [_PLURALS.get(n.lower(), n.lower()) for n in names or ["all"]]
    return list(VALIDATIONS) if "all" in wanted else wanted


class Reconciliation:
    """Results of a comparison as DataFrames, each built on first use.

    Three passes feed everything: one shuffle over the keys alone (counts, overlap, duplicates,
    and whether keys repeat), one join (column statistics), and one scan of the target (nulls),
    plus one for rules. The small results are written to the checkpoint folder on first use, so they are computed once,
    outlive executors, and hold no memory; :meth:`release` lets go of them. With ``write_pairs`` the joined rows
    are written as well, and statistics, differences and samples share one join.
    """

    def __init__(
        self,
        source: DataFrame,
        target: DataFrame,
        keys: Sequence[str] | None = None,
        validations: Sequence[str] | None = None,
        rules: Any = None,
        pairing: str = "auto",
        null_mode: str = "safe",
        write_pairs: bool = False,
    ) -> None:
        self._write_pairs = write_pairs
        self.source, self.target = source, target
        self.validations = normalise_validations(validations)
        self.rules = rule_ops.normalise_rules(rules)
        self.null_mode = null_mode
        self._pairing = pairing
        self._given_keys = list(keys) if keys else None

    def release(self) -> None:
        """Let go of the results written so far; Spark removes their files if it was told to clean checkpoints."""
        for name in ("_keys_and_totals", "pairs", "column_stats", "null_profile", "rule_results"):
            self.__dict__.pop(name, None)

    @cached_property
    def _keys_and_totals(self) -> tuple[list[str], DataFrame, Mapping[str, int]]:
        given = self._given_keys
        if given and all(k in self.source.columns and k in self.target.columns for k in given):
            overlap = durable(profile.overlap_summary(self.source, self.target, given))
            totals = overlap.first()
            # With a pairing named, repeated keys are expected and the given keys stand.
            if totals["target_unique"] == totals["target_count"] or self._pairing != "auto":
                return given, overlap, totals
        found = key_ops.find_key(self.target.select(*schema.common_columns(self.target, self.source)))
        if not found:
            raise ValueError("No suitable key columns found")
        overlap = durable(profile.overlap_summary(self.source, self.target, found))
        return list(found), overlap, overlap.first()

    @property
    def keys(self) -> list[str]:
        """The given keys when they are unique in the target, else the first key discovered."""
        return self._keys_and_totals[0]

    @property
    def overlap(self) -> DataFrame:
        """One row: rows per side, matching rows, and keys on one side only."""
        return self._keys_and_totals[1]

    @cached_property
    def pairs(self) -> diff.PairedRows:
        pairing = self._pairing
        if pairing == "auto":
            totals = self._keys_and_totals[2]
            unique = all(totals[f"{s}_unique"] == totals[f"{s}_count"] for s in ("source", "target"))
            pairing = "unique" if unique else "first"
        known = self._pairing == "auto"
        pairs = diff.pair_rows(self.source, self.target, self.keys, pairing=pairing, null_mode=self.null_mode, checked=known)
        return replace(pairs, df=durable(pairs.df)) if self._write_pairs else pairs

    @cached_property
    def column_stats(self) -> DataFrame:
        return durable(diff.column_stats(self.pairs))

    @cached_property
    def null_profile(self) -> DataFrame:
        return durable(profile.null_profile(self.target))

    @cached_property
    def rule_results(self) -> DataFrame:
        return durable(rule_ops.evaluate_rules(self.target, self.rules))

    @property
    def schema_table(self) -> DataFrame:
        return schema.schema_table(self.source, self.target)

    @property
    def count_validation(self) -> DataFrame:
        gap = F.col("source_count") - F.col("target_count")
        return self.overlap.select(
            "source_count", "target_count", (gap == 0).alias("count_match"), F.abs(gap).alias("count_difference")
        )

    @property
    def duplicate_profile(self) -> DataFrame:
        rows, unique = F.col("target_count"), F.col("target_unique")
        return self.overlap.select(
            rows.alias("total_records"),
            unique.alias("unique_records"),
            (rows - unique).alias("duplicate_count"),
            profile.percent(rows - unique, rows).alias("duplicate_percentage"),
        )

    @property
    def row_diff(self) -> DataFrame:
        return diff.row_diff(self.pairs)

    def mismatches(self, per_column: int = 100) -> DataFrame:
        return diff.mismatch_sample(self.pairs, per_column)

    @property
    def summary(self) -> DataFrame:
        """One row per validation and ``Overall Status``; ``NULL`` for what was not asked for."""
        rows = [
            ("count", "Count Validation", self._count_row),
            ("schema", "Schema Validation", self._schema_row),
            ("data", "Data Validation", self._data_row),
            ("null", "Null Check", self._null_row),
            ("duplicate", "Duplicate Check", self._duplicate_row),
        ]
        parts = []
        for position, (name, title, build) in enumerate(rows):
            parts.append(build(position, title) if name in self.validations else self._not_run(position, title, ""))
        if self.rules:
            parts.append(self._rule_row(len(rows), "Rule Validation"))
        else:
            parts.append(self._not_run(len(rows), "Rule Validation", NO_RULES))
        checks = parts[0]
        for part in parts[1:]:
            checks = checks.unionAll(part)
        checks = durable(checks)
        return checks.unionAll(overall_status(checks, len(parts)))

    def _not_run(self, position: int, title: str, details: str) -> DataFrame:
        return self.source.sparkSession.range(1).select(*_row(position, title, F.lit("NULL"), F.lit(details)))

    def _count_row(self, position: int, title: str) -> DataFrame:
        same = F.col("source_count") == F.col("target_count")
        text = F.format_string(COUNTS_DIFFER, "source_count", "target_count")
        return self.overlap.select(*_row(position, title, _status(same), F.when(same, COUNTS_MATCH).otherwise(text)))

    def _schema_row(self, position: int, title: str) -> DataFrame:
        found = schema.schema_issue_counts(self.source, self.target)
        same = not any(found.values())
        row = _row(position, title, F.lit("PASS" if same else "FAIL"), F.lit(SCHEMAS_MATCH if same else SCHEMAS_DIFFER.format(**found)))
        return self.source.sparkSession.range(1).select(*row)

    def _data_row(self, position: int, title: str) -> DataFrame:
        total, failed = F.count("*"), F.count_if(F.col("status") == "FAIL")
        text = F.format_string(COLUMNS_TEXT, total, failed)
        return self.column_stats.agg(*_row(position, title, _status(failed == 0), text))

    def _null_row(self, position: int, title: str) -> DataFrame:
        with_nulls = F.count_if(F.col("null_count") > 0)
        details = F.when(with_nulls == 0, NO_NULLS).otherwise(F.format_string(SOME_NULLS, with_nulls))
        return self.null_profile.agg(*_row(position, title, _status(with_nulls == 0), details))

    def _duplicate_row(self, position: int, title: str) -> DataFrame:
        count, share = F.col("duplicate_count"), F.col("duplicate_percentage")
        details = F.when(count == 0, NO_DUPLICATES).otherwise(F.format_string(SOME_DUPLICATES, count, share))
        return self.duplicate_profile.select(*_row(position, title, _status(count == 0), details))

    def _rule_row(self, position: int, title: str) -> DataFrame:
        failed = F.count_if(F.col("status") != "PASS")
        details = F.when(failed == 0, RULES_PASSED).otherwise(F.format_string(RULES_FAILED, failed))
        return self.rule_results.agg(*_row(position, title, _status(failed == 0), details))

    @property
    def recommendations(self) -> DataFrame:
        """Text rows for failed columns, columns with nulls, and duplicates."""
        failed = self.column_stats.filter("status = 'FAIL'").select(
            F.lit("column").alias("kind"),
            "column_name",
            F.format_string(
                FAILED_COLUMN_TEXT, "column_name", F.col("total_records") - F.col("pass_count"),
            ).alias("recommendation"),
        )
        nulls = self.null_profile.filter("null_percentage > 0").select(
            F.lit("null").alias("kind"),
            "column_name",
            F.format_string(NULLS_TEXT, "column_name", "null_percentage").alias("recommendation"),
        )
        repeats = self.duplicate_profile.filter("duplicate_percentage > 0").select(
            F.lit("duplicate").alias("kind"),
            F.lit(None).cast("string").alias("column_name"),
            F.format_string(DUPLICATES_TEXT, "duplicate_percentage").alias("recommendation"),
        )
        return failed.unionAll(nulls).unionAll(repeats)


def _status(passed: Column) -> Column:
    return F.when(passed, "PASS").otherwise("FAIL")


def _row(position: int, title: str, status: Column, details: Column) -> list[Column]:
    return [c.alias(n) for c, n in zip((F.lit(position), F.lit(title), status, details), _SUMMARY)]


def overall_status(checks: DataFrame, position: int) -> DataFrame:
    """``FAIL`` if any check failed; checks that were not run do not count."""
    failed = F.coalesce(F.bool_or(F.col("status") == "FAIL"), F.lit(False))
    details = F.when(failed, SOME_FAILED).otherwise(ALL_PASSED)
    return checks.agg(*_row(position, "Overall Status", _status(~failed), details))


def reconcile(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str] | None = None,
    validations: Sequence[str] | None = None,
    rules: Any = None,
    pairing: str = "auto",
    null_mode: str = "safe",
    write_pairs: bool = False,
) -> Reconciliation:
    """Compare ``source`` with ``target``; see :class:`Reconciliation` for the results."""
    return Reconciliation(source, target, keys, validations, rules, pairing, null_mode, write_pairs)


def compare_files(
    spark: SparkSession,
    source: Mapping[str, Any],
    target: Mapping[str, Any],
    keys: Sequence[str] | None = None,
    **options: Any,
) -> Reconciliation:
    """Compare two datasets given as arguments of :func:`read_dataset` (``fmt``, ``path``, ...)."""
    return reconcile(read_dataset(spark, **source), read_dataset(spark, **target), keys, **options)


@dataclass(frozen=True)
class Comparison:
    """One named comparison of a batch."""

    name: str
    source: DataFrame
    target: DataFrame
    keys: Sequence[str] | None = None
    validations: Sequence[str] | None = None
    rules: Any = None


def reconcile_many(comparisons: Sequence[Comparison]) -> DataFrame:
    """The summaries of several comparisons in one session, with the comparison's name."""
    if not comparisons:
        raise ValueError("no comparisons given")
    parts = [
        reconcile(c.source, c.target, c.keys, c.validations, c.rules).summary.select(
            F.lit(c.name).alias("test_case_name"), *_SUMMARY
        )
        for c in comparisons
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result
