"""Series: a lazy, schema-typed view of a DataFrame with an ordered key.

A series names its key columns and their kind, the columns that partition it, and a column
that breaks ties of equal keys.  Everything else is a value.  Methods return new series or
DataFrames; nothing runs until an action of Spark's.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions.frames import in_order, join_on
from .functions.reducers import NUMERIC
from .functions.time import duration_us, from_us, us

#: Values of a column that may each become a series or a column of their own.
MAX_GROUPS = 10_000
#: How series without partitions are dealt if nothing is said: one task would have all their rows.
STRETCH = "6h"
KINDS = {"time": 1, "range": 2, "interval": 3, "value": 1}


@dataclass(frozen=True)
class Series:
    df: DataFrame
    kind: str  #: time, range (begin, end), interval (begin, end, label) or value (a number)
    key: tuple[str, ...]
    by: tuple[str, ...] = ()
    seq: str | None = None
    stretch: str | int | float | None = None  #: see dealt

    def __post_init__(self):
        if self.kind not in KINDS or len(self.key) != KINDS[self.kind]:
            raise ValueError(f"a {self.kind} key has {KINDS.get(self.kind)} columns, not {self.key}")
        missing = [c for c in (*self.key, *self.by, *([self.seq] if self.seq else [])) if c not in self.df.columns]
        if missing:
            raise ValueError(f"unknown columns: {missing}")

    # -- construction ----------------------------------------------------------

    @staticmethod
    def of(df: DataFrame, time: str | None = None, begin: str | None = None, end: str | None = None, label: str | None = None, value: str | None = None, seq: str | None = None) -> Series:
        if time:
            return Series(df, "time", (time,), (), seq)
        if value:
            return Series(df, "value", (value,), (), seq)
        if label:
            return Series(df, "interval", (begin, end, label), (), seq)
        return Series(df, "range", (begin, end), (), seq)

    def partition_by(self, *cols: str) -> Series:
        return replace(self, by=tuple(cols))

    def dealt(self, stretch: str | int | float | None) -> Series:
        """Lets operators that read rows in order deal each partition in stretches of this width (a
        duration, or a number on a value axis), so that a long one isn't one task's."""
        return replace(self, stretch=stretch)

    def collect_series(self) -> Series:
        """The flat series of a partitioned one."""
        return replace(self, by=())

    def apply(self, fn: Callable[[Series], Series]) -> Series:
        """Runs fn on the series as partitioned: every operator in it works within partitions."""
        return fn(self)

    def to_map(self, fn: Callable[[Series], object] | None = None) -> dict:
        """One lazy series per partition value.  Only the values' names come to the driver, MAX_GROUPS at most."""
        keys = [tuple(r) for r in self.df.select(*self.by).distinct().orderBy(*self.by).limit(MAX_GROUPS + 1).collect()]
        if len(keys) > MAX_GROUPS:
            raise ValueError(f"more than {MAX_GROUPS} partitions; work on the partitioned series as a whole")
        out = {}
        for k in keys:
            cond = F.lit(True)
            for c, v in zip(self.by, k, strict=True):
                cond = cond & F.col(c).eqNullSafe(F.lit(v))
            part = replace(self, df=self.df.filter(cond), by=())
            out[k[0] if len(k) == 1 else k] = fn(part) if fn else part
        return out

    def with_df(self, df: DataFrame, **changes) -> Series:
        return replace(self, df=df, **changes)

    # -- shape -------------------------------------------------------------------

    @property
    def values(self) -> list[str]:
        hidden = {*self.key, *self.by, *([self.seq] if self.seq else [])}
        return [c for c in self.df.columns if c not in hidden]

    @cached_property
    def types(self) -> dict[str, str]:
        return dict(self.df.dtypes)

    def is_number(self, c: str) -> bool:
        return self.types[c] in NUMERIC

    @property
    def at(self) -> Column:
        """The key's begin as the number that windows order by: microseconds, or the axis."""
        c = self.key[0]
        return F.col(c) if self.kind == "value" else us(c)

    @property
    def until(self) -> Column:
        return us(self.key[1]) if self.kind in ("range", "interval") else self.at

    @property
    def center(self) -> Column:
        """Smoothing anchors extents at their midpoint."""
        return F.floor((self.at + self.until) / 2) if self.kind in ("range", "interval") else self.at

    @property
    def ties(self) -> list[Column]:
        """What orders rows of an equal begin: end, label, then the tie column."""
        return [F.col(c) for c in (*self.key[1:], *([self.seq] if self.seq else []))]

    @property
    def order(self) -> Column:
        """The full order of a row as one struct, for first, last and samples."""
        return F.struct(self.at.alias("k"), *self.ties)

    def rows(self):
        """Window of the partition in key order."""
        return Window.partitionBy(*self.by).orderBy(self.at, *self.ties)

    def ordered(self, **reads) -> DataFrame:
        """The rows with what they see of their partition in key order: see functions.frames.in_order."""
        return in_order(self.df, self.by, [self.at, *self.ties], self.stretch_of(self.at), **reads)

    def stretch_of(self, at: Column, by: tuple[str, ...] | list[str] | None = None) -> Column | None:
        """The stretch that a place on the axis is dealt to; of a series without partitions STRETCH unless
        ``dealt`` says another (a value axis has no width that would do for all)."""
        alone = not (self.by if by is None else by) and self.kind != "value"
        width = self.stretch if self.stretch is not None else STRETCH if alone else None
        return None if width is None else F.floor(at / F.lit(self.us(width)))

    def us(self, d: str | int | float) -> int | float:
        return d if self.kind == "value" else duration_us(d)

    # -- intake checks -------------------------------------------------------------

    def validate(self) -> Series:
        """An action: raises on a null key, a range that ends before it begins, or a number that isn't finite."""
        bad = [F.count_if(F.col(c).isNull()).alias(c) for c in self.key]
        if self.kind in ("range", "interval"):
            bad.append(F.count_if(F.col(self.key[1]) < F.col(self.key[0])).alias("end before begin"))
        bad += [F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(f"{c} not finite") for c in self.values if self.types[c] in ("double", "float")]
        found = {k: v for k, v in self.df.agg(*bad).first().asDict().items() if v}
        if found:
            raise ValueError(f"invalid rows: {found}")
        return self

    def is_sorted_by(self, column: str) -> bool:
        """An action: whether the tie column and the key agree in order."""
        w = Window.partitionBy(*self.by).orderBy(column)
        return self.df.select((self.at < F.lag(self.at).over(w)).alias("back")).filter("back").limit(1).count() == 0

    # -- point queries ---------------------------------------------------------------

    def _point(self, t) -> Column:
        return F.lit(t) if self.kind == "value" else us(F.lit(t))

    def _asc(self) -> list[Column]:
        return [self.at.asc(), *self.ties]

    def _desc(self) -> list[Column]:
        return [self.at.desc(), *[c.desc() for c in self.ties]]

    def first(self) -> DataFrame:
        return self._pick(self.df, False)

    def last(self) -> DataFrame:
        return self._pick(self.df, True)

    def _pick(self, df: DataFrame, last: bool) -> DataFrame:
        """The first or last row of each partition, by a partially aggregated min_by."""
        cols = [c for c in df.columns if c not in self.by]
        row = F.struct(*cols)
        one = (F.max_by if last else F.min_by)(row, self.order).alias("r")
        return (df.groupBy(*self.by) if self.by else df.groupBy()).agg(one).filter("r is not null").select(*self.by, *[F.col(f"r.{c}").alias(c) for c in cols]).select(*df.columns)

    def numbered(self) -> DataFrame:
        return self.ordered(number="__n")

    def at_index(self, i: int) -> DataFrame:
        """The i-th row of each partition; negative counts from the end."""
        order = self.rows() if i >= 0 else Window.partitionBy(*self.by).orderBy(*self._desc())
        return self.df.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") == (i + 1 if i >= 0 else -i)).drop("__n")

    def length(self) -> DataFrame:
        return (self.df.groupBy(*self.by) if self.by else self.df.groupBy()).agg(F.count(F.lit(1)).alias("length"))

    def bisect(self, t) -> DataFrame:
        """Rows before t: the index at which it would be put in."""
        return (self.df.groupBy(*self.by) if self.by else self.df.groupBy()).agg(F.count_if(self.at < self._point(t)).alias("index"))

    def includes_key(self, t) -> bool:
        return self.df.filter(self.at == self._point(t)).limit(1).count() > 0

    def at_or_before(self, t) -> DataFrame:
        """The first row at exactly t, else the last before it."""
        exact = self.at == self._point(t)
        hit, before = self._pick(self.df.filter(exact), False), self._pick(self.df.filter(self.at < self._point(t)), True)
        both = hit.withColumn("__p", F.lit(1)).unionByName(before.withColumn("__p", F.lit(0)))
        return replace(self, df=both, seq="__p")._pick(both, True).drop("__p")

    def at_or_after(self, t) -> DataFrame:
        return self._pick(self.df.filter(self.at >= self._point(t)), False)

    def nearest(self, t) -> DataFrame:
        """The row nearest to t; the earlier of two."""
        far = F.struct(F.abs(self.at - self._point(t)).alias("d"), self.order.alias("o"))
        cols = [c for c in self.df.columns if c not in self.by]
        return (self.df.groupBy(*self.by) if self.by else self.df.groupBy()).agg(F.min_by(F.struct(*cols), far).alias("r")).filter("r is not null").select(*self.by, "r.*").select(*self.df.columns)

    def find(self, cond: Column) -> DataFrame:
        return self._pick(self.df.filter(cond), False)

    def some(self, cond: Column) -> bool:
        return self.df.filter(cond).limit(1).count() > 0

    def every(self, cond: Column) -> bool:
        return self.df.filter(~F.coalesce(cond, F.lit(False))).limit(1).count() == 0

    # -- filters and slices -----------------------------------------------------------

    def filter(self, cond: Column | str) -> Series:
        return self.with_df(self.df.filter(cond))

    def slice(self, begin: int | None = None, end: int | None = None) -> Series:
        """Rows by position within each partition; negative counts from the end."""
        n = F.col("__all")
        place = lambda i, other: F.lit(other) if i is None else (F.greatest(n + i, F.lit(0)) if i < 0 else F.lit(i))
        df = self.ordered(number="__n", whole={"__all": ("count", F.lit(1))}).withColumn("__lo", place(begin, 0)).withColumn("__hi", n if end is None else place(end, 0))
        return self.with_df(df.filter("__n > __lo and __n <= __hi").drop("__n", "__all", "__lo", "__hi"))

    def sample(self, stride: int | None = None, reservoir: int | None = None, seed: int = 0) -> Series:
        """Every stride-th row (the last of each stride), or a random sample of so many rows of each
        partition: those least by a hash of the key and the seed, so the same wherever rows lie."""
        if stride:
            return self.with_df(self.numbered().filter(F.col("__n") % stride == 0).drop("__n"))
        h = F.xxhash64(F.lit(seed), self.at, *self.ties)
        w = Window.partitionBy(*self.by).orderBy(h, self.at, *self.ties)
        return self.with_df(self.df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= reservoir).drop("__r"))

    def time_range(self) -> DataFrame:
        lo, hi = F.min(self.key[0]).alias("begin"), F.max(self.key[1] if len(self.key) > 1 else self.key[0]).alias("end")
        return (self.df.groupBy(*self.by) if self.by else self.df.groupBy()).agg(lo, hi)

    def _end(self) -> Column:
        return F.col(self.key[1] if len(self.key) > 1 else self.key[0])

    def overlapping(self, lo, hi) -> Series:
        """Closed: touching counts."""
        return self.filter((F.col(self.key[0]) <= F.lit(hi)) & (self._end() >= F.lit(lo)))

    def within(self, lo, hi) -> Series:
        return self.filter((F.col(self.key[0]) >= F.lit(lo)) & (self._end() <= F.lit(hi)))

    contained_by = within

    def trim(self, lo, hi) -> Series:
        s = self.overlapping(lo, hi)
        if len(self.key) == 1:
            return s
        cut = {self.key[0]: F.greatest(F.col(self.key[0]), F.lit(lo).cast(self.types[self.key[0]])), self.key[1]: F.least(F.col(self.key[1]), F.lit(hi).cast(self.types[self.key[1]]))}
        return s.with_df(s.df.withColumns(cut))

    def before(self, t) -> Series:
        return self.filter(self._end() < F.lit(t))

    def after(self, t) -> Series:
        return self.filter(F.col(self.key[0]) > F.lit(t))

    def tail(self, d: str | int | None = None) -> Series:
        """Rows that begin after the partition's last begin less d."""
        if d is None:
            return self
        last = (self.df.groupBy(*self.by) if self.by else self.df.groupBy()).agg(F.max(self.at).alias("__last"))
        df = join_on(self.df, last, self.by) if self.by else self.df.join(F.broadcast(last))
        return self.with_df(df.filter(self.at > F.col("__last") - F.lit(self.us(d))).select(*self.df.columns))

    def slice_by_value(self, lo, hi) -> Series:
        """Half-open on the axis."""
        return self.filter((F.col(self.key[0]) >= lo) & (F.col(self.key[0]) < hi))

    def extent_overlaps(self, lo, hi) -> bool:
        r = self.collect_series().time_range().first()
        return r.begin is not None and r.begin <= hi and r.end >= lo

    def extent_contains(self, lo, hi) -> bool:
        r = self.collect_series().time_range().first()
        return r.begin is not None and r.begin <= lo and r.end >= hi

    def extent_intersection(self, lo, hi) -> tuple | None:
        r = self.collect_series().time_range().first()
        return (max(r.begin, lo), min(r.end, hi)) if r.begin is not None and r.begin <= hi and r.end >= lo else None

    # -- projections -------------------------------------------------------------------

    def select(self, *names: str) -> Series:
        unknown = set(names) - set(self.values)
        if unknown:
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        return self.with_df(self.df.select(*[c for c in self.df.columns if c not in self.values or c in names]))

    def rename(self, names: Mapping[str, str]) -> Series:
        out = [names.get(c, c) for c in self.df.columns]
        if len(set(out)) < len(out):
            raise ValueError(f"names collide: {out}")
        of = lambda c: names.get(c, c)
        return Series(self.df.withColumnsRenamed(dict(names)), self.kind, tuple(map(of, self.key)), tuple(map(of, self.by)), of(self.seq) if self.seq else None)

    def with_column(self, name: str, value: Column) -> Series:
        return self.with_df(self.df.withColumn(name, value))

    def map_columns(self, fns: Mapping[str, Callable[[Column], Column]]) -> Series:
        """Missing stays missing; the kind stays."""
        return self.with_df(self.df.withColumns({c: F.when(F.col(c).isNotNull(), f(F.col(c))).cast(self.types[c]) for c, f in fns.items()}))

    def map(self, exprs: Mapping[str, Column]) -> Series:
        """Replaces all values by these expressions of a row."""
        keep = [c for c in self.df.columns if c not in self.values]
        return self.with_df(self.df.select(*keep, *[e.alias(n) for n, e in exprs.items()]))

    def collapse(self, names: list[str], out: str, fn: Callable[..., Column], append: bool = False) -> Series:
        df = self.df.withColumn(out, fn(*[F.col(c) for c in names]))
        return self.with_df(df if append else df.drop(*[c for c in names if c != out]))

    def as_time(self, at: str = "begin", name: str = "time") -> Series:
        if len(self.key) == 1:
            return self
        t = {"begin": self.at, "center": self.center, "end": self.until}[at]
        keep = [c for c in self.df.columns if c not in self.key]
        return Series(self.df.select(from_us(t).alias(name), *keep), "time", (name,), self.by, self.seq)

    def as_range(self, begin: str = "begin", end: str = "end") -> Series:
        keep = [c for c in self.df.columns if c not in self.key]
        return Series(self.df.select(from_us(self.at).alias(begin), from_us(self.until).alias(end), *keep), "range", (begin, end), self.by, self.seq)

    def as_interval(self, label: Column, begin: str = "begin", end: str = "end", name: str = "label") -> Series:
        s = self.as_range(begin, end)
        return Series(s.df.withColumn(name, label), "interval", (begin, end, name), self.by, self.seq)

    def with_key(self, time: Column, name: str = "time") -> Series:
        """The same rows at other times."""
        keep = [c for c in self.df.columns if c not in self.key and c != name]
        return Series(self.df.select(time.alias(name), *keep), "time", (name,), self.by, self.seq)

    def merge(self, exprs: Mapping[str, Column]) -> Series:
        """Values set or added, the others stay."""
        taken = {*self.key, *self.by, *([self.seq] if self.seq else [])} & set(exprs)
        if taken:
            raise ValueError(f"not values: {sorted(taken)}")
        return self.with_df(self.df.withColumns(dict(exprs)))

    def pipe(self, fn: Callable[..., object], *args, **options):
        """fn(self, ...): any operator or study as a link of a chain."""
        return fn(self, *args, **options)

    def by_value(self, axis: str, checked: bool = False) -> Series:
        """Re-keys on a non-decreasing number; rows without one go, and so does the time key.  ``checked`` is an
        action: it raises where the number falls from one row to the next."""
        if checked:
            x = F.col(axis).cast("double")
            falls = self.filter(x.isNotNull() & ~F.isnan(x)).df.select((x < F.lag(x).over(self.rows())).alias("back"))
            if falls.filter("back").limit(1).count():
                raise ValueError(f"{axis!r} falls along the key")
        df = self.df.filter(F.col(axis).isNotNull() & ~F.isnan(F.col(axis).cast("double")))
        return Series(df.drop(*self.key).withColumn(axis, F.col(axis).cast("double")), "value", (axis,), self.by, self.seq)

    def concat(self, *others: Series) -> Series:
        """All rows of all series; ties keep the order of the series."""
        dfs = [s.df.withColumn("__src", F.lit(i)) for i, s in enumerate((self, *others))]
        out = dfs[0]
        for d in dfs[1:]:
            out = out.unionByName(d)
        if self.seq:
            return self.with_df(out.drop("__src"))
        return Series(out, self.kind, self.key, self.by, "__src")
