"""Predicates on the time of a bar, in any time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.columns import TIME, sure

#: Session hours [from, to), as labelled in UTC; the last one wraps over midnight.
SESSIONS = {"london": (7, 16), "newyork": (12, 21), "tokyo": (0, 9), "sydney": (21, 6)}


def local_time(time: str | Column = TIME, tz: str | None = None) -> Column:
    """The bar's time (UTC) as wall-clock time of a zone."""
    t = F.col(time) if isinstance(time, str) else time
    return t if tz in (None, "UTC") else F.convert_timezone(F.lit("UTC"), F.lit(tz), t)


def _within(value: Column, start: int, end: int) -> Column:
    inside = (value >= start) & (value < end) if start <= end else (value >= start) | (value < end)
    return sure(inside)


def hour_between(start: int, end: int, time: str | Column = TIME, tz: str | None = None) -> Column:
    """The hour is in [start, end); with start after end, the span over midnight."""
    return _within(F.hour(local_time(time, tz)), int(start), int(end))


def in_session(session: str, time: str | Column = TIME, tz: str | None = None) -> Column:
    """The hour is in a named session; a tz moves the hours that are compared, not the session."""
    if session.lower() not in SESSIONS:
        raise ValueError(f"unknown session {session!r}: {', '.join(SESSIONS)}")
    return hour_between(*SESSIONS[session.lower()], time, tz)


def weekday_in(days: list[int] | tuple[int, ...], time: str | Column = TIME, tz: str | None = None) -> Column:
    """The weekday, 0 for Monday, is one of days."""
    return sure(F.weekday(local_time(time, tz)).isin([int(d) for d in days]))


def not_weekend(time: str | Column = TIME, tz: str | None = None) -> Column:
    return weekday_in((0, 1, 2, 3, 4), time, tz)


def between_times(start: str, end: str, time: str | Column = TIME, tz: str | None = None) -> Column:
    """The minute of the day is in [start, end), given as HH:MM; wraps over midnight."""
    minutes = [int(h) * 60 + int(m) for h, m in (x.split(":") for x in (start, end))]
    t = local_time(time, tz)
    return _within(F.hour(t) * 60 + F.minute(t), *minutes)
