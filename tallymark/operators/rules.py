"""Column rules: one specification, one aggregate for any number of rules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.operators.keys import distinct_counts

# Fixed values.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
DEFAULT_NOT_NULL_RATIO = 0.95
DEFAULT_UNIQUE_RATIO = 1.0

_RANGE_TEXT = re.compile(r"^\s*(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)\s*$")


@dataclass(frozen=True)
class Rule:
    column: str
    kind: str
    threshold: float | None = None
    pattern: str | None = None
    minimum: float | None = None
    maximum: float | None = None
    condition: str | None = None


def normalise_rules(rules: Any) -> list[Rule]:
    """Any accepted rule shape as a flat list.

    * list: ``{column, rule, ...}``, ``{column, rule_type, ...}`` or ``{column, validation: {type, ...}}``
    * mapping column -> list of ``{rule, ...}``
    * mapping rule -> columns (a list of names, ``{column: argument}``, or a list of mappings)
    * a mapping with a ``rules`` entry holding one of the above
    """
    if not rules:
        return []
    if isinstance(rules, (list, tuple)) and all(isinstance(r, Rule) for r in rules):
        return list(rules)
    if isinstance(rules, Mapping) and isinstance(rules.get("rules"), (list, Mapping)):
        return normalise_rules(rules["rules"])
    if isinstance(rules, Mapping):
        flat: list[Rule] = []
        for name, body in rules.items():
            flat.extend(_from_entry(name, body))
        return flat
    return [_from_mapping(r["column"], r) for r in rules if isinstance(r, Mapping) and "column" in r]


def _from_entry(name: str, body: Any) -> Iterable[Rule]:
    if isinstance(body, Mapping):
        # rule -> {column: argument}
        for column, argument in body.items():
            spec = dict(argument) if isinstance(argument, Mapping) else {_ARGUMENT.get(name, "threshold"): argument}
            yield _from_mapping(column, {"rule": name, **spec})
        return
    for item in body or []:
        if isinstance(item, str):
            yield _from_mapping(item, {"rule": name})
        elif "column" in item:
            yield _from_mapping(item["column"], {"rule": name, **item})
        else:
            yield _from_mapping(name, item)


_ARGUMENT = {"regex": "pattern", "pattern": "pattern", "custom": "condition"}


def _from_mapping(column: str, spec: Mapping[str, Any]) -> Rule:
    spec = {**spec, **spec["validation"]} if isinstance(spec.get("validation"), Mapping) else dict(spec)
    kind = str(spec.get("rule") or spec.get("rule_type") or spec.get("type") or "").lower()
    threshold, low, high = spec.get("threshold"), spec.get("min"), spec.get("max")
    if kind == "range" and isinstance(threshold, str):
        bounds = _RANGE_TEXT.match(threshold)
        if bounds:
            low, high, threshold = bounds[1], bounds[2], None
    if kind == "threshold" and (low is not None or high is not None):
        kind = "range"
    try:
        threshold = None if threshold is None else float(threshold)
        low = None if low is None else float(low)
        high = None if high is None else float(high)
    except (TypeError, ValueError):
        kind, threshold, low, high = f"{kind} (bad argument)", None, None, None
    return Rule(column, kind, threshold, spec.get("pattern"), low, high, spec.get("condition"))


def valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether the engine that will run the pattern accepts it (checked on one row)."""
    try:
        spark.range(1).select(F.lit("").rlike(pattern)).collect()
    except PySparkException:
        return False
    return True


def _resolve(df: DataFrame, name: str) -> tuple[Column, T.DataType] | None:
    if name in df.columns:
        return F.col(f"`{name}`"), df.schema[name].dataType
    # A dotted name reaches into struct columns.
    dtype: T.DataType = df.schema
    for part in name.split("."):
        if not isinstance(dtype, T.StructType) or part not in dtype.names:
            return None
        dtype = dtype[part].dataType
    return F.col(name), dtype


# The texts of rule messages.
NO_COLUMN = "Column does not exist in dataframe"
FOUND_TEXT = "Found %d {what} out of %d records"
NULL_VALUES, NON_NULL_VALUES = "null values", "non-null values"
NOT_NULL_RATIO, UNIQUENESS_RATIO = "Not null ratio", "Uniqueness ratio"
BELOW_TEXT = "% is below threshold {least:.2%}"
BAD_PATTERN, NO_MATCH = "Invalid regex pattern: {pattern}", "values not matching pattern {pattern}"
BAD_EMAILS, OUT_OF_RANGE, FAILING = "invalid email addresses", "values out of range", "values failing {condition}"
NO_PATTERN_NAME, NO_RULE = "Unknown pattern name: {pattern}", "Unknown rule: {kind}"


@dataclass(frozen=True)
class _Check:
    """How one rule is counted: ``violations`` of rows, or a ratio that must reach ``least``."""

    rule: Rule
    violations: Column | None = None
    good: Column | None = None
    distinct: tuple[Column, T.DataType] | None = None
    least: float | None = None
    text: str = ""
    fixed_status: str | None = None
    fixed_message: str | None = None


def _plan_check(df: DataFrame, rule: Rule) -> _Check:
    found = _resolve(df, rule.column)
    if found is None:
        missing = Rule(rule.column, "column_exists")
        return _Check(missing, fixed_status="FAIL", fixed_message=NO_COLUMN)
    value, dtype = found
    kind = rule.kind
    if kind == "not_null":
        return _Check(rule, violations=value.isNull(), text=NULL_VALUES)
    if kind == "null":
        return _Check(rule, violations=value.isNotNull(), text=NON_NULL_VALUES)
    if kind == "threshold":
        least = DEFAULT_NOT_NULL_RATIO if rule.threshold is None else rule.threshold
        return _Check(rule, good=F.count(value), least=least, text=NOT_NULL_RATIO)
    if kind == "uniqueness":
        least = DEFAULT_UNIQUE_RATIO if rule.threshold is None else rule.threshold
        return _Check(rule, distinct=(value, dtype), least=least, text=UNIQUENESS_RATIO)
    if kind == "regex":
        pattern = rule.pattern or ""
        if not valid_pattern(df.sparkSession, pattern):
            return _Check(rule, fixed_status="FAIL", fixed_message=BAD_PATTERN.format(pattern=pattern))
        text = NO_MATCH.format(pattern=pattern)
        return _Check(rule, violations=~value.cast("string").rlike(pattern), text=text)
    if kind == "pattern":
        if (rule.pattern or "").lower() == "email":
            return _Check(rule, violations=~value.cast("string").rlike(EMAIL_PATTERN), text=BAD_EMAILS)
        return _Check(rule, fixed_status="ERROR", fixed_message=NO_PATTERN_NAME.format(pattern=rule.pattern))
    if kind == "range" and (rule.minimum is not None or rule.maximum is not None):
        number = value if isinstance(dtype, T.NumericType) else value.try_cast("double")
        outside = F.lit(False)
        if rule.minimum is not None:
            outside = outside | (number < rule.minimum)
        if rule.maximum is not None:
            outside = outside | (number > rule.maximum)
        if not isinstance(dtype, T.NumericType):
            outside = outside | (value.isNotNull() & number.isNull())
        return _Check(rule, violations=outside, text=OUT_OF_RANGE)
    if kind == "custom" and rule.condition:
        name = rule.column if rule.column not in df.columns else f"`{rule.column}`"
        return _Check(rule, violations=~F.expr(f"{name} {rule.condition}"), text=FAILING.format(condition=rule.condition))
    return _Check(rule, fixed_status="ERROR", fixed_message=NO_RULE.format(kind=kind))


def evaluate_rules(df: DataFrame, rules: Any) -> DataFrame:
    """One row per rule: status, violations or ratio, and a message for every rule not passed.

    All rules share one aggregate over ``df``; uniqueness rules share a second pass. A null never violates a value rule. An unknown
    rule or pattern name gives status ``ERROR``.
    """
    checks = [_plan_check(df, r) for r in normalise_rules(rules)]
    if not checks:
        return df.sparkSession.createDataFrame([], _RESULT)
    aggregates = [F.count("*").alias("rows")]
    for i, check in enumerate(checks):
        if check.violations is not None:
            aggregates.append(F.count_if(F.coalesce(check.violations, F.lit(False))).alias(f"n{i}"))
        elif check.good is not None:
            aggregates.append(check.good.alias(f"n{i}"))
    results = [_result(i, c) for i, c in enumerate(checks)]
    counted = df.agg(*aggregates)
    distinct = [(i, c.distinct) for i, c in enumerate(checks) if c.distinct is not None]
    if distinct:
        found = distinct_counts(df, [d for _, d in distinct])
        # One row on either side.
        wide = found.agg(*[F.max(F.when(F.col("position") == n, F.col("distinct_count"))).alias(f"n{i}") for n, (i, _) in enumerate(distinct)])
        counted = counted.withColumn("_one", F.lit(1)).join(wide.withColumn("_one", F.lit(1)), "_one")
    return counted.select(F.inline(F.array(*results)))


_RESULT = (
    "position int, column_name string, rule string, status string, violations long, "
    "total_count long, ratio double, message string"
)


def _result(i: int, check: _Check) -> Column:
    rows = F.col("rows")
    none_long, none_double, none_text = (F.lit(None).cast(t) for t in ("long", "double", "string"))
    violations, ratio = none_long, none_double
    if check.fixed_status:
        status, message = F.lit(check.fixed_status), F.lit(check.fixed_message)
    elif check.violations is not None:
        violations = F.col(f"n{i}")
        failed = violations > 0
        status = F.when(failed, "FAIL").otherwise("PASS")
        text = F.format_string(FOUND_TEXT.format(what=check.text.replace("%", "%%")), violations, rows)
        message = F.when(failed, text)
    else:
        ratio = F.when(rows > 0, F.col(f"n{i}") / rows)
        failed = F.coalesce(ratio < check.least, F.lit(False))
        status = F.when(failed, "FAIL").otherwise("PASS")
        text = F.concat(
            F.lit(f"{check.text} "), F.round(ratio * 100, 2).cast("string"),
            F.lit(BELOW_TEXT.format(least=check.least)),
        )
        message = F.when(failed, text)
    return F.struct(
        F.lit(i).alias("position"),
        F.lit(check.rule.column).alias("column_name"),
        F.lit(check.rule.kind).alias("rule"),
        status.alias("status"),
        violations.alias("violations"),
        rows.alias("total_count"),
        ratio.alias("ratio"),
        F.coalesce(message, none_text).alias("message"),
    )


def rule_verdict(results: DataFrame) -> DataFrame:
    """One row: the overall rule status and the number of rules not passed."""
    bad = F.count_if(F.col("status") != "PASS")
    return results.agg(
        F.when(F.count("*") == 0, "NULL").when(bad > 0, "FAIL").otherwise("PASS").alias("status"),
        bad.alias("failed_rules"),
    )
