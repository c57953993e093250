"""Calendar rules as pure column functions (no time zone: all dates are DATE)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_date(value: Column) -> Column:
    """A date, or null where the text is none."""
    return value.try_cast("date")


def month_end(date: Column) -> Column:
    """The calendar month's last day."""
    return F.last_day(date)


def month_label(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def last_weekday(date: Column) -> Column:
    """The last Monday-to-Friday day of the calendar month."""
    end = F.last_day(date)
    return F.date_sub(end, F.greatest(F.weekday(end) - 4, F.lit(0)))


def add_business_days(date: Column, days: int) -> Column:
    """The date n weekdays later; a weekend counts as the Friday before it."""
    place = F.least(F.weekday(date), F.lit(4))
    base = F.date_sub(date, F.weekday(date) - place)
    return F.date_add(base, (F.lit(days) + F.lit(2) * F.floor((place + days) / 5)).cast("int"))


def is_rebalance(date: Column, how: str = "M") -> Column:
    """M: the month's last weekday; W: Friday; otherwise every day."""
    kind = how[:1].upper()
    if kind == "M":
        return date == last_weekday(date)
    return F.weekday(date) == 4 if kind == "W" else date.isNotNull()


def in_months(date: Column, start: Column, end: Column) -> Column:
    """Whether the date's month end lies between two month ends, both included."""
    return F.last_day(date).between(start, end)
