"""Trading calendars: sessions from rules, lookups, bars and tags."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import duration_us, from_us
from ..operators.grid import Intervals, to_us
from ..operators.joins import interval_join
from ..series import Series


@dataclass(frozen=True)
class Session:
    day: date
    open: int  #: microseconds
    close: int
    breaks: tuple[tuple[int, int], ...] = ()

    def segments(self) -> list[tuple[int, int]]:
        """Stretches of trading, between the breaks."""
        out, at = [], self.open
        for a, b in self.breaks:
            out.append((at, a))
            at = b
        return [*out, (at, self.close)]


@dataclass(frozen=True)
class Rules:
    zone: str
    open: time
    close: time
    weekdays: tuple[int, ...] = (0, 1, 2, 3, 4)  #: 0 is Monday
    holidays: frozenset[date] = frozenset()
    early: dict[date, time] = field(default_factory=dict)
    breaks: tuple[tuple[time, time], ...] = ()


def generate_sessions(rules: Rules, first: date, last: date) -> list[Session]:
    """One session a trading day, at local clock times, right across changes of the clock."""
    zone, out, day = ZoneInfo(rules.zone), [], first
    while day <= last:
        if day.weekday() in rules.weekdays and day not in rules.holidays:
            at = lambda t, d=day: to_us(datetime.combine(d, t, zone))
            close = at(rules.early.get(day, rules.close))
            pauses = tuple((at(a), min(at(b), close)) for a, b in rules.breaks if at(a) < close)
            out.append(Session(day, at(rules.open), close, pauses))
        day += timedelta(days=1)
    return out


def normalize(sessions: list[Session]) -> list[Session]:
    """Sorted; an error if one ends before it begins, or two overlap."""
    out = sorted(sessions, key=lambda s: s.open)
    for s in out:
        edges = [s.open, *[t for b in s.breaks for t in b], s.close]
        if s.close <= s.open or edges != sorted(edges):
            raise ValueError(f"malformed session: {s}")
    for a, b in zip(out, out[1:], strict=False):
        if b.open < a.close:
            raise ValueError(f"sessions overlap: {a.day} and {b.day}")
    return out


@dataclass(frozen=True)
class Axis:
    """An axis of open time: what lies between the segments takes no room on it.

    Segments are sorted and don't overlap, in microseconds.  Without any the axis is time itself.
    """

    segments: tuple[tuple[int, int], ...] = ()

    def compress(self, s: Series, output: str) -> Series:
        """Adds the open microseconds from the first open to each row: closed times are at the last close.

        A row finds its segment by bisection where it lies: nothing is sorted or moved.
        """
        if not self.segments:
            return s.with_df(s.df.withColumn(output, s.at))
        opens, closes = (np.array(x, np.int64) for x in zip(*self.segments, strict=True))
        before = np.cumsum(closes - opens) - (closes - opens)

        @F.arrow_udf("bigint")
        def open_time(at: pa.Array) -> pa.Array:
            t = pc.fill_null(at, opens[0]).to_numpy(zero_copy_only=False)
            i = np.searchsorted(opens, t, "right") - 1
            return pa.array(np.where(i < 0, 0, before[i] + np.minimum(t, closes[i]) - opens[i]))

        return s.with_df(s.df.withColumn(output, open_time(s.at)))


def weekend_skip(first: datetime, last: datetime, zone: str = "UTC") -> Axis:
    """An axis without local Saturdays and Sundays, from the first day to the last."""
    tz, day, out = ZoneInfo(zone), first.date(), []
    while day <= last.date():
        if day.weekday() < 5:
            a, b = (to_us(datetime.combine(x, time(), tz)) for x in (day, day + timedelta(days=1)))
            out = [*out[:-1], (out[-1][0], b)] if out and out[-1][1] == a else [*out, (a, b)]
        day += timedelta(days=1)
    return Axis(tuple(out))


def identity() -> Axis:
    return Axis()


class TradingCalendar:
    def __init__(self, sessions: list[Session]):
        self.sessions = normalize(sessions)
        self._by_day = {s.day: s for s in self.sessions}
        self._opens, self._closes = [s.open for s in self.sessions], [s.close for s in self.sessions]

    @staticmethod
    def from_rules(rules: Rules, first: date, last: date) -> TradingCalendar:
        return TradingCalendar(generate_sessions(rules, first, last))

    def session_on(self, day: date) -> Session | None:
        return self._by_day.get(day)

    def is_trading_day(self, day: date) -> bool:
        return day in self._by_day

    def session_containing(self, t) -> Session | None:
        u = to_us(t)
        i = bisect_right(self._opens, u) - 1
        return self.sessions[i] if i >= 0 and u < self.sessions[i].close else None

    def is_open(self, t) -> bool:
        s, u = self.session_containing(t), to_us(t)
        return s is not None and not any(a <= u < b for a, b in s.breaks)

    def sessions_in(self, lo, hi) -> list[Session]:
        return self.sessions[bisect_right(self._closes, to_us(lo)) : bisect_left(self._opens, to_us(hi))]

    def next_session(self, t) -> Session | None:
        i = bisect_right(self._opens, to_us(t))
        return self.sessions[i] if i < len(self.sessions) else None

    def previous_session(self, t) -> Session | None:
        i = bisect_right(self._closes, to_us(t))
        return self.sessions[i - 1] if i else None

    def session_sequence(self) -> Intervals:
        return Intervals(tuple((s.open, s.close) for s in self.sessions))

    def bar_sequence(self, period: str) -> Intervals:
        """Bars from each segment's begin, the last cut off at its end."""
        step, out = duration_us(period), []
        for s in self.sessions:
            for a, b in s.segments():
                out += [(t, min(t + step, b)) for t in range(a, b, step)]
        return Intervals(tuple(out))

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(s.day, s.open, s.close) for s in self.sessions], "session_day date, __open bigint, __close bigint")

    def tag(self, s: Series, closes: bool = False, output: str = "session") -> Series:
        """Adds the open of the session that holds each row; rows stamped at their close belong to (open, close]."""
        spans = self.frame(s.df.sparkSession).drop("session_day")
        got = interval_join(s.df, s.at, spans, F.col("__open"), F.col("__close"), closes)
        return s.with_df(got.withColumn(output, from_us(F.col("__open"))).drop("__open", "__close"))

    def axis(self) -> Axis:
        """Open time only, as data."""
        return Axis(tuple(self._open_segments()))

    # -- an axis without the closed hours -----------------------------------------

    def _open_segments(self) -> list[tuple[int, int]]:
        return [x for s in self.sessions for x in s.segments()]

    def distance(self, a, b) -> int:
        """Open microseconds between two times."""
        x, y = to_us(a), to_us(b)
        return sum(max(0, min(y, hi) - max(x, lo)) for lo, hi in self._open_segments()) if y >= x else -self.distance(b, a)

    def clamp(self, t, up: bool = True) -> int:
        """The time itself if open, else the next open (or the last close)."""
        u, prev = to_us(t), None
        for lo, hi in self._open_segments():
            if lo <= u < hi:
                return u
            if lo > u:
                return lo if up or prev is None else prev
            prev = hi
        return prev if prev is not None else u

    def offset(self, t, by: int) -> int:
        """The time so many open microseconds later."""
        u, left = to_us(t), by
        for lo, hi in self._open_segments():
            if hi <= u:
                continue
            at = max(lo, u)
            if hi - at >= left:
                return at + left
            left -= hi - at
        raise ValueError("beyond the last session")
