"""Durations, microsecond keys, temporal parsing and closed key predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

US = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}
_DURATION = re.compile(r"(\d+)(ms|s|m|h|d)")


def duration_us(d: str | int | float) -> int:
    """'5m', '250ms', '1d' (always 24 hours) or a number of milliseconds; positive, in microseconds."""
    if isinstance(d, str):
        m = _DURATION.fullmatch(d)
        if not m:
            raise ValueError(f"not a duration: {d!r}")
        us = int(m[1]) * US[m[2]]
    else:
        us = round(float(d) * 1000)
    if us <= 0:
        raise ValueError(f"a duration must be positive: {d!r}")
    return us


def us(c: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp (UTC session for those without a zone)."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def from_us(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def parse_time(c: str | Column, zone: str = "UTC") -> Column:
    """ISO, date-only or year-month strings, local to ``zone`` unless they carry an offset."""
    s = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    full = F.when(s.rlike(r"^\d{4}-\d{2}$"), F.concat(s, F.lit("-01"))).otherwise(s)
    local = F.to_utc_timestamp(F.try_to_timestamp(full).cast("timestamp"), zone)
    return F.when(full.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(full).cast("timestamp")).otherwise(local).cast("timestamp_ntz")


def day_range(day: Column, zone: str = "UTC") -> tuple[Column, Column]:
    """Begin and end of a local calendar day."""
    d = day.cast("date")
    return F.to_utc_timestamp(d.cast("timestamp"), zone).cast("timestamp_ntz"), F.to_utc_timestamp(F.date_add(d, 1).cast("timestamp"), zone).cast("timestamp_ntz")


def midpoint(begin: Column, end: Column) -> Column:
    return from_us(F.floor((us(begin) + us(end)) / 2))


# Closed predicates on extents: touching counts.  Buckets are half-open and never use these.


def overlaps(begin: Column, end: Column, lo, hi) -> Column:
    return (begin <= hi) & (end >= lo)


def contained(begin: Column, end: Column, lo, hi) -> Column:
    return (begin >= lo) & (end <= hi)


def contains(begin: Column, end: Column, lo, hi) -> Column:
    return (begin <= lo) & (end >= hi)
