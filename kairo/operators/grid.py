"""Sequences of buckets: fixed steps, calendar units, explicit intervals; and their spines."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import duration_us, us

SAMPLES = ("begin", "center", "end")
#: Buckets that one row lists before they become rows.
BLOCK = 10_000


def to_us(t: datetime | int) -> int:
    if isinstance(t, datetime):
        from datetime import UTC, timedelta

        t = t if t.tzinfo else t.replace(tzinfo=UTC)
        return (t - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
    return int(t)


@dataclass(frozen=True)
class Every:
    """Buckets of a fixed step from an anchor (the epoch by default)."""

    step: int
    anchor: int = 0

    def bucket(self, t: Column) -> Column:
        return t - F.pmod(t - F.lit(self.anchor), F.lit(self.step))

    def end(self, begin: Column) -> Column:
        return begin + F.lit(self.step)

    def begins(self, lo: Column, hi: Column, sample: str) -> Column:
        """Array of the begins of buckets whose sample point lies in [lo, hi]; (lo, hi] for 'end'."""
        off = {"begin": 0, "center": self.step // 2, "end": self.step}[sample]
        base = F.lit(self.anchor + off)
        up = lo + F.lit(1 if sample == "end" else 0)
        first = up + F.pmod(base - up, F.lit(self.step))
        last = hi - F.pmod(hi - base, F.lit(self.step))
        return F.when(first <= last, F.sequence(first - F.lit(off), last - F.lit(off), F.lit(self.step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


@dataclass(frozen=True)
class Calendar:
    """Local days, weeks or months of a time zone; right across changes of the clock."""

    unit: str
    zone: str = "UTC"
    week_starts_on: int = 1  #: 1 is Monday

    def __post_init__(self):
        if self.unit not in ("day", "week", "month"):
            raise ValueError(f"not a calendar unit: {self.unit!r}")

    def _floor(self, local: Column) -> Column:
        d = F.to_date(local)
        if self.unit == "week":
            shift = self.week_starts_on - 1
            return F.date_add(F.to_date(F.date_trunc("week", F.date_sub(d, shift))), shift)
        return F.to_date(F.date_trunc(self.unit, d))

    def _next(self, d: Column) -> Column:
        return F.to_date(F.add_months(d, 1)) if self.unit == "month" else F.date_add(d, 7 if self.unit == "week" else 1)

    def _begin(self, d: Column) -> Column:
        return F.unix_micros(F.to_utc_timestamp(d.cast("timestamp"), self.zone))

    def _local_day(self, t: Column) -> Column:
        return self._floor(F.from_utc_timestamp(F.timestamp_micros(t), self.zone))

    def bucket(self, t: Column) -> Column:
        return self._begin(self._local_day(t))

    def end(self, begin: Column) -> Column:
        return self._begin(self._next(self._local_day(begin)))

    def begins(self, lo: Column, hi: Column, sample: str) -> Column:
        step = {"day": "interval 1 day", "week": "interval 7 day", "month": "interval 1 month"}[self.unit]
        days = F.sequence(self._local_day(lo), self._local_day(hi), F.expr(step))
        both = F.transform(days, lambda d: F.struct(self._begin(d).alias("b"), self._begin(self._next(d)).alias("e")))
        point = lambda x: x["e"] if sample == "end" else F.floor((x["b"] + x["e"]) / 2) if sample == "center" else x["b"]
        inside = F.filter(both, lambda x: ((point(x) > lo) if sample == "end" else (point(x) >= lo)) & (point(x) <= hi))
        return F.transform(inside, lambda x: x["b"])


@dataclass(frozen=True)
class Intervals:
    """Explicit, sorted, non-overlapping [begin, end) in microseconds; used as they are."""

    spans: tuple[tuple[int, int], ...]

    def __post_init__(self):
        for (a, b), nxt in zip(self.spans, [*self.spans[1:], (None, None)], strict=False):
            if b <= a or (nxt[0] is not None and nxt[0] < b):
                raise ValueError("intervals must be positive, sorted and must not overlap")

    def __len__(self) -> int:
        return len(self.spans)

    def at(self, i: int) -> tuple[int, int] | None:
        return self.spans[i] if -len(self.spans) <= i < len(self.spans) else None

    def first(self) -> tuple[int, int] | None:
        return self.at(0)

    def last(self) -> tuple[int, int] | None:
        return self.at(-1)

    def time_range(self) -> tuple[int, int] | None:
        return (self.spans[0][0], self.spans[-1][1]) if self.spans else None

    def slice(self, begin: int | None = None, end: int | None = None) -> Intervals:
        return Intervals(self.spans[begin:end])

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.spans), "__b bigint, __e bigint")


Sequence = Every | Calendar | Intervals


def every(step: str | int, anchor: datetime | int = 0) -> Every:
    return Every(duration_us(step), to_us(anchor))


def hourly() -> Every:
    return every("1h")


def daily() -> Every:
    return every("1d")


def calendar(unit: str, zone: str = "UTC", week_starts_on: int = 1) -> Calendar:
    return Calendar(unit, zone, week_starts_on)


def bounded(spans) -> Intervals:
    return Intervals(tuple((to_us(a), to_us(b)) for a, b in spans))


def spine(bounds: DataFrame, by: list[str], seq: Sequence, sample: str = "begin") -> DataFrame:
    """A row per partition and bucket: the ``by`` columns, ``__b`` and ``__e``.

    ``bounds`` has ``by``, ``__lo`` and ``__hi``, a row for each partition.
    """
    if sample not in SAMPLES:
        raise ValueError(f"not a sample point: {sample!r}")
    if isinstance(seq, Intervals):
        return bounds.select(*by).join(F.broadcast(seq.frame(bounds.sparkSession))) if by else seq.frame(bounds.sparkSession)
    if isinstance(seq, Every):  # a long range in blocks, so that no row holds all of its begins
        reach = seq.step * BLOCK
        blocks = bounds.withColumn("__from", F.explode(F.sequence(F.col("__lo"), F.col("__hi"), F.lit(reach).cast("bigint"))))
        till = F.col("__from") + F.lit(reach - (0 if sample == "end" else 1))
        bounds = blocks.select(*by, F.col("__from").alias("__lo"), F.least("__hi", till).alias("__hi"))
    out = bounds.select(*by, F.explode(seq.begins(F.col("__lo"), F.col("__hi"), sample)).alias("__b"))
    return out.withColumn("__e", seq.end(F.col("__b")))


def sample_point(sample: str) -> Column:
    return {"begin": F.col("__b"), "center": F.floor((F.col("__b") + F.col("__e")) / 2), "end": F.col("__e")}[sample]


__all__ = ["Calendar", "Every", "Intervals", "Sequence", "bounded", "calendar", "daily", "every", "hourly", "sample_point", "spine", "to_us", "us"]
