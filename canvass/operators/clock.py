"""Clock columns of an interview and the rules they have to satisfy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_MINUTES, MAX_MINUTES = 5, 240


def as_int(c: Column | str) -> Column:
    """Whole-number value of a column; NULL for text that is not a number."""
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("double").cast("int")


def with_clock(
    df: DataFrame,
    hour_start: str = "hour_start",
    minute_start: str = "minute_start",
    hour_end: str = "hour_end",
    minute_end: str = "minute_end",
) -> DataFrame:
    """Add start_mins, end_mins, duration_mins and start_hour."""
    start = as_int(hour_start) * 60 + as_int(minute_start)
    end = as_int(hour_end) * 60 + as_int(minute_end)
    return df.withColumns(
        {"start_mins": start, "end_mins": end, "duration_mins": end - start, "start_hour": as_int(hour_start)}
    )


def in_range(c: Column | str, low: float = MIN_MINUTES, high: float = MAX_MINUTES) -> Column:
    """Inside the closed range; NULL for a missing value."""
    c = F.col(c) if isinstance(c, str) else c
    return (c >= low) & (c <= high)


def out_of_range(c: Column | str, low: float = MIN_MINUTES, high: float = MAX_MINUTES) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (c < low) | (c > high)


def invalid_time(hours: list[str], minutes: list[str]) -> Column:
    """An hour outside 0-23 or a minute outside 0-59."""
    bad = F.lit(False)
    for name in hours:
        bad = bad | out_of_range(name, 0, 23)
    for name in minutes:
        bad = bad | out_of_range(name, 0, 59)
    return bad


def invalid_date(day: str, month: str) -> Column:
    """A day outside 1-31 or a month outside 1-12; the length of the month is not checked."""
    return out_of_range(day, 1, 31) | out_of_range(month, 1, 12)


def impossible_date(day: str, month: str, leap_year: int = 2024) -> Column:
    """Stricter rule: no such day in that month, even in a leap year."""
    made = F.try_make_timestamp(
        F.lit(leap_year), F.col(month).cast("int"), F.col(day).cast("int"), F.lit(0), F.lit(0), F.lit(0)
    )
    return F.col(day).isNotNull() & F.col(month).isNotNull() & made.isNull()
