"""Briefing windows and date predicates. The clock is always a parameter or a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def window_end(ts: Column, hour: int = 8) -> Column:
    """The end of the calendar window that a moment falls in: the next day's fixed hour, weekends joining Monday's."""
    day = F.date_trunc("day", ts - F.make_dt_interval(hours=F.lit(hour)))
    end = day + F.expr(f"interval {24 + hour} hours")
    weekday = F.weekday(end)
    return F.when(weekday == 5, end + F.expr("interval 2 days")).when(weekday == 6, end + F.expr("interval 1 day")).otherwise(end)


def window_hours(end: Column) -> Column:
    """72 hours for a window that ends on Monday, else 24."""
    return F.when(F.weekday(end) == 0, 72).otherwise(24)


def briefing_window(reference: Column, hour: int = 8) -> tuple[Column, Column]:
    """Start and end of the last window that was complete at a moment."""
    today = F.date_trunc("day", reference) + F.expr(f"interval {hour} hours")
    end = F.when(reference < today, today - F.expr("interval 1 day")).otherwise(today)
    return end - F.when(F.weekday(end) == 0, F.expr("interval 72 hours")).otherwise(F.expr("interval 24 hours")), end


def date_only(value: Column) -> Column:
    return F.rlike(value, F.lit(r"^\d{4}-\d{2}-\d{2}$"))


def in_window(value: Column, start: Column, end: Column, missing: bool = True, closed: bool = True) -> Column:
    """Whether a date or a moment (as text) lies in a window. A date counts by the day; closed: both ends' days."""
    ts, d = F.try_to_timestamp(value), F.try_to_date(value)
    by_day = (d >= start.cast("date")) & ((d <= end.cast("date")) if closed else (d < end.cast("date")))
    by_time = (ts >= start) & ((ts <= end) if closed else (ts < end))
    return F.when(F.coalesce(ts.isNull(), F.lit(True)), missing).when(date_only(value), by_day).otherwise(by_time)


def retained(value: Column, cutoff: Column) -> Column:
    """Whether it is not older than the cutoff; what has no date is."""
    ts = F.try_to_timestamp(value)
    return F.when(ts.isNull(), False).when(date_only(value), F.try_to_date(value) >= cutoff.cast("date")).otherwise(ts >= cutoff)
