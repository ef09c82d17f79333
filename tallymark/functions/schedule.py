"""Next occurrence of a schedule, and durations as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN_HOUR = 6


def _at_hour(date: Column, hour: int) -> Column:
    return F.timestamp_add("HOUR", F.lit(hour), date.cast("timestamp_ntz"))


def _clamped(month_start: Column, day: Column) -> Column:
    """The given day of a month, or the month's last day when it is shorter."""
    return F.date_add(month_start, F.least(day, F.dayofmonth(F.last_day(month_start))) - 1)


def next_run(
    now: Column,
    frequency: Column,
    day_of_week: Column,
    day_of_month: Column,
    variant: str = "morning",
    first_weekday: int | None = None,
) -> Column:
    """When a schedule runs next, after ``now`` (a ``timestamp_ntz``).

    ``morning``: at 06:00; weekly on weekday 0-6 from Monday; monthly always in the next month.
    ``iso``: daily and weekly keep the time of day; weekly on weekday 1-7; monthly at midnight,
    still in this month when the day lies ahead. A day that the month lacks becomes its last
    day. An unknown frequency means tomorrow. ``first_weekday`` overrides the number of Monday.
    """
    if variant not in ("morning", "iso"):
        raise ValueError("variant must be 'morning' or 'iso'")
    morning = variant == "morning"
    monday = first_weekday if first_weekday is not None else (0 if morning else 1)
    kind = F.lower(frequency)
    today = F.to_date(now)
    weekday = F.coalesce(day_of_week.cast("int"), F.lit(monday)) - monday
    ahead = weekday - F.weekday(today)
    days = F.when(kind == "weekly", F.when(ahead <= 0, ahead + 7).otherwise(ahead)).otherwise(F.lit(1))
    day = F.coalesce(day_of_month.cast("int"), F.lit(1))
    this_month = F.trunc(today, "MM")
    next_month = F.add_months(this_month, 1)
    if morning:
        monthly = _at_hour(_clamped(next_month, day), RUN_HOUR)
        other = _at_hour(F.date_add(today, days), RUN_HOUR)
    else:
        month = F.when(F.dayofmonth(today) < day, this_month).otherwise(next_month)
        monthly = _clamped(month, day).cast("timestamp_ntz")
        other = F.timestamp_add("DAY", days, now)
    return F.when(kind == "monthly", monthly).otherwise(other)


def duration_text(start: Column, end: Column) -> Column:
    """``1h 2m 3s``, without leading zero units."""
    seconds = F.timestamp_diff("SECOND", start, end)
    h, m, s = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60))
    return (
        F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s))
        .when(m > 0, F.format_string("%dm %ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )
