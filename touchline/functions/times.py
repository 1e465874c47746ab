"""Date and time helpers on zone-less timestamps."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

PACIFIC = "PST8PDT"
# Pacific time is never less than this far behind UTC.
PACIFIC_MIN_LAG = timedelta(hours=7)

_NTZ = "timestamp_ntz"


def ts(text: str) -> Column:
    """A zone-less timestamp literal."""
    return F.lit(datetime.fromisoformat(text).isoformat(sep=" ")).cast(_NTZ)


def to_pacific(utc: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(PACIFIC), utc)


def to_utc(pacific: Column) -> Column:
    return F.convert_timezone(F.lit(PACIFIC), F.lit("UTC"), pacific)


def trunc(col: Column, unit: str) -> Column:
    """Start of the day, week or month. Always pass a full unit name: Spark gives NULL for 'd' and 'w'."""
    return F.date_trunc(unit, col).cast(_NTZ)


def period(col: Column, scope: str = "month") -> Column:
    """Reporting period a timestamp falls in: ``month``, ``day`` or ``saturday_week``."""
    if scope == "saturday_week":
        two_days = F.expr("INTERVAL '2' DAY")
        return trunc(col + two_days, "week") - two_days
    if scope not in ("month", "day"):
        raise ValueError(f"unknown scope {scope!r}")
    return trunc(col, scope)


def day_diff(end: Column, start: Column) -> Column:
    """Day boundaries crossed between two timestamps."""
    return F.datediff(end, start)


def second_diff(end: Column, start: Column) -> Column:
    """Second boundaries crossed between two timestamps."""
    return F.timestamp_diff("SECOND", F.date_trunc("second", start), F.date_trunc("second", end))


def period_start(start: str, scope: str) -> datetime:
    """First start of a period that is not before ``start``."""
    moment = datetime.fromisoformat(start)
    day = datetime(moment.year, moment.month, moment.day)
    if day < moment:
        day += timedelta(days=1)
    if scope == "month":
        return day if day.day == 1 else (day.replace(day=1) + timedelta(days=32)).replace(day=1)
    if scope == "saturday_week":
        return day + timedelta(days=(5 - day.weekday()) % 7)
    return day


def period_end(start: datetime, scope: str) -> datetime:
    """Start of the period after the one that begins at ``start``."""
    if scope == "month":
        return (start.replace(day=1) + timedelta(days=32)).replace(day=1)
    return start + timedelta(days=7 if scope == "saturday_week" else 1)


def period_since(raw: Column, start: str, scope: str) -> Column:
    """``period(raw, scope) >= start``, as a bound on the stored column that a scan can use."""
    return raw >= ts(period_start(start, scope).isoformat())


def period_until(raw: Column, end: str, scope: str) -> Column:
    """``period(raw, scope) <= end``, likewise."""
    after = period_start(end, scope)
    if after == datetime.fromisoformat(end):
        after = period_end(after, scope)
    return raw < ts(after.isoformat())


def period_is(raw: Column, scope: str, start: str) -> Column:
    """``period(raw, scope) = start`` for the start of a period, likewise."""
    begin = datetime.fromisoformat(start)
    return (raw >= ts(start)) & (raw < ts(period_end(begin, scope).isoformat()))


def local_since(utc: Column, start: str, scope: str | None = None) -> Column:
    """Pacific value of a stored UTC time is at or after ``start``; with a scope, its period is.

    Clocks change at two in the morning, so a bound at midnight is one moment in UTC
    and needs no conversion of the rows.
    """
    moment = period_start(start, scope) if scope else datetime.fromisoformat(start)
    bound = ts(moment.isoformat())
    if moment == datetime(moment.year, moment.month, moment.day):
        return utc >= to_utc(bound)
    return (to_pacific(utc) >= bound) & (utc >= ts((moment + PACIFIC_MIN_LAG).isoformat()))
