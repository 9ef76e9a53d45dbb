"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_date(iso: Column) -> Column:
    """The UTC day of an ISO text, whose offset counts."""
    return F.to_date(iso.cast("timestamp"))


def week_start(day: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", day).cast("date")


def previous_week(day: Column) -> tuple[Column, Column]:
    """Sunday and Saturday of the last full week before ``day``."""
    sunday = F.date_sub(day, F.dayofweek(day) + 6)
    return sunday, F.date_add(sunday, 6)


def days_between(later: Column, earlier: Column) -> Column:
    """Days as a double."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 8.64e10


def half_life(days: Column, life: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(days, F.lit(0.0)) / life)


def carry_over(day: Column, days: int = 7) -> tuple[Column, Column]:
    """First and last day from which a daily issue may still take articles."""
    return F.date_sub(day, days), day
