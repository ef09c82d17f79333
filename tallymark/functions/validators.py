"""Field checks as boolean columns; never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STATUSES = ("PASS", "FAIL", "FAILED", "RUNNING", "PENDING", "ERROR", "SKIPPED", "UNKNOWN", "PARTIAL")
FREQUENCIES = ("daily", "weekly", "monthly")
MODULE_TYPES = ("converter", "validator", "processor", "analyzer")
FORMAT_TYPES = ("csv", "json", "xml", "parquet", "avro", "orc")
UUID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
# One digit or two for each part, as lenient date parsers take them.
_DATE = r"^\d{4}-\d{1,2}-\d{1,2}$"
_DATE_TIME = r"^\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$"


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def valid_date(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` or ``yyyy-MM-dd``, and a real date; single digits are accepted."""
    date = text.rlike(_DATE) & F.try_to_timestamp(text, F.lit("yyyy-M-d")).isNotNull()
    spaced = F.regexp_replace(text, r"\s+", " ")
    time = text.rlike(_DATE_TIME) & F.try_to_timestamp(spaced, F.lit("yyyy-M-d H:m:s")).isNotNull()
    return _sure(date | time)


def valid_status(text: Column) -> Column:
    return _sure(F.upper(text).isin(*STATUSES))


def valid_frequency(text: Column) -> Column:
    return _sure(F.lower(text).isin(*FREQUENCIES))


def valid_module_type(text: Column) -> Column:
    return _sure(F.lower(text).isin(*MODULE_TYPES))


def valid_format_type(text: Column) -> Column:
    return _sure(F.lower(text).isin(*FORMAT_TYPES))


def valid_day_of_week(day: Column) -> Column:
    """0-6, or not given."""
    return day.isNull() | _sure(day.between(0, 6))


def valid_day_of_month(day: Column) -> Column:
    """1-31, or not given."""
    return day.isNull() | _sure(day.between(1, 31))


def valid_traceability_id(text: Column) -> Column:
    return _sure(F.lower(text).rlike(UUID_PATTERN))


def valid_count(value: Column) -> Column:
    """A whole number, also as text, that is not negative."""
    text = F.trim(value.cast("string"))
    return _sure(text.rlike(r"^\+?\d+$") | text.rlike("^-0+$"))
