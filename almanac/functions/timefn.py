"""Civil time in a fixed zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Chicago"


def local(ts: Column, zone: str = ZONE) -> Column:
    """The wall time in ``zone`` of an instant given in UTC."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)


def time_of_day(ts: Column) -> Column:
    """morning 5-12, afternoon 12-17, evening 17-21, night 21-3 (over midnight); else null."""
    h = F.hour(local(ts))
    named = F.when((h >= 5) & (h < 12), "morning").when((h >= 12) & (h < 17), "afternoon").when((h >= 17) & (h < 21), "evening")
    return named.when((h >= 21) | (h < 3), "night")


def local_day(ts: Column) -> Column:
    return F.to_date(local(ts))


def is_midnight(ts: Column) -> Column:
    return local(ts) == F.date_trunc("day", local(ts))


def week_monday(ts: Column) -> Column:
    return F.to_date(F.date_trunc("week", local(ts)))


def roll_end_forward(start: Column, end: Column) -> Column:
    """An end before its start is a day later."""
    return F.when(end < start, end + F.expr("INTERVAL 24 HOURS")).otherwise(end)


def day_heading(ts: Column) -> Column:
    return F.date_format(local(ts), "EEEE, MMMM d")


def clock(ts: Column) -> Column:
    return F.date_format(local(ts), "h:mm a")


def day_short(ts: Column) -> Column:
    return F.upper(F.date_format(local(ts), "EEE"))


def date_label(ts: Column) -> Column:
    return F.date_format(local(ts), "EEE, MMM d")
