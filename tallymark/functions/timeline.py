"""Time arithmetic that works for timestamps with and without time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(column: Column) -> Column:
    """Microseconds since 1970-01-01 as a long, for ``timestamp`` and ``timestamp_ntz``."""
    # Both ends are zone-free, so the session time zone plays no part for timestamp_ntz.
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), column.cast("timestamp_ntz"))


def shift_seconds(column: Column, seconds: float) -> Column:
    return column + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
