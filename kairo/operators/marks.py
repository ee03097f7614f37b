"""What a picture of limited width shows of dense marks: bands, candles, boxes, bars, heat cells, points; and stacks.

Each reduces the rows of every one of ``buckets`` equal stretches of the key to one mark.  Empty
stretches are there, all missing: a break.  Stretches are found by arithmetic on the key and
reduced by partial aggregates, so nothing is ordered and no partition is gathered.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import join_on
from ..functions.reducers import finite
from ..series import Series


def stretches(s: Series, buckets: int, outs: Mapping[str, Column], lo=None, hi=None) -> DataFrame:
    """A row per partition and stretch: ``bucket``, its ``begin`` and ``end`` on the key, and the outputs."""
    if buckets < 1:
        raise ValueError("there must be a stretch")
    groups = s.df.groupBy(*s.by) if s.by else s.df.groupBy()
    low, high = (F.min(s.at), F.max(s.at)) if lo is None else (F.lit(lo), F.lit(hi))
    extent = groups.agg(low.alias("__lo"), high.alias("__hi")).filter("__lo is not null")
    df = join_on(s.df, extent, s.by) if s.by else s.df.join(F.broadcast(extent))
    width = F.greatest((F.col("__hi") - F.col("__lo")).cast("double"), F.lit(1e-300))
    at = s.at
    b = F.least(F.floor((at - F.col("__lo")) / width * buckets), F.lit(buckets - 1))
    agg = df.filter((at >= F.col("__lo")) & (at <= F.col("__hi"))).withColumn("bucket", b).groupBy(*s.by, "bucket").agg(*[c.alias(f"__o_{n}") for n, c in outs.items()])
    grid = extent.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))).alias("bucket"))
    got = join_on(grid, agg, [*s.by, "bucket"], "left")
    edge = lambda k: F.col("__lo") + k * (F.col("__hi") - F.col("__lo")) / buckets
    return got.select(*s.by, "bucket", edge(F.col("bucket")).alias("begin"), edge(F.col("bucket") + 1).alias("end"), *[F.col(f"__o_{n}").alias(n) for n in outs])


def _x(s: Series, c: str) -> Column:
    return finite(F.col(c), s.types[c])


def _first(s: Series, c: str) -> Column:
    return F.min_by(_x(s, c), F.when(_x(s, c).isNotNull(), s.order))


def _last(s: Series, c: str) -> Column:
    return F.max_by(_x(s, c), F.when(_x(s, c).isNotNull(), s.order))


def band(s: Series, lower: str, upper: str, buckets: int, **extent) -> DataFrame:
    """The widest envelope: least lower, greatest upper."""
    return stretches(s, buckets, {"lower": F.min(_x(s, lower)), "upper": F.max(_x(s, upper))}, **extent)


def ohlc(s: Series, buckets: int, open: str = "open", high: str = "high", low: str = "low", close: str = "close", **extent) -> DataFrame:
    """Candles of a coarser time frame."""
    return stretches(s, buckets, {"open": _first(s, open), "high": F.max(_x(s, high)), "low": F.min(_x(s, low)), "close": _last(s, close)}, **extent)


def box(s: Series, buckets: int, names: tuple[str, str, str, str, str] = ("lower", "q1", "median", "q3", "upper"), **extent) -> DataFrame:
    """Whiskers and bodies that hold all of a stretch's, and its first median."""
    low, q1, mid, q3, up = names
    outs = {"lower": F.min(_x(s, low)), "q1": F.min(_x(s, q1)), "median": _first(s, mid), "q3": F.max(_x(s, q3)), "upper": F.max(_x(s, up))}
    return stretches(s, buckets, outs, **extent)


def bars(s: Series, value: str, buckets: int, baseline: float = 0.0, **extent) -> DataFrame:
    """What bars from a baseline cover: from ``lo`` to ``hi``."""
    x, base = _x(s, value), F.lit(float(baseline))
    some = F.count(x) > 0
    return stretches(s, buckets, {"lo": F.when(some, F.least(F.min(x), base)), "hi": F.when(some, F.greatest(F.max(x), base))}, **extent)


def heat(s: Series, columns: list[str], buckets: int, **extent) -> DataFrame:
    """The mean of each column's cells that aren't missing."""
    return stretches(s, buckets, {c: F.avg(_x(s, c)) for c in columns}, **extent)


def heat_rows(s: Series, columns: list[str], rows: int) -> Series:
    """Runs of columns to one each, their mean, so that no more than ``rows`` are left: r0, r1, ..."""
    stride = -(-len(columns) // rows)
    out = {}
    for r in range(-(-len(columns) // stride)):
        cells = [_x(s, c).cast("double") for c in columns[r * stride : (r + 1) * stride]]
        n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cells), F.lit(0))
        out[f"r{r}"] = F.when(n > 0, sum((F.coalesce(c, F.lit(0.0)) for c in cells), F.lit(0.0)) / n)
    return s.map(out)


def scatter(s: Series, y: str, cell: tuple[float, float], x: str | None = None) -> DataFrame:
    """The first point of every cell of a plane; points without a place are left out."""
    at = s.at if x is None else F.col(x)
    v = _x(s, y)
    df = s.df.filter(v.isNotNull()).withColumn("__cx", F.floor(at / F.lit(cell[0]))).withColumn("__cy", F.floor(v / F.lit(cell[1])))
    rest = [c for c in s.df.columns if c not in s.by]
    one = df.groupBy(*s.by, "__cx", "__cy").agg(F.min_by(F.struct(*rest), s.order).alias("r"))
    return one.select(*s.by, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*s.df.columns)


def gap_edges(s: Series, column: str) -> DataFrame:
    """The rows that end and begin a gap of a column: ``edge`` is 'before' or 'after', with the gap's number of rows."""
    x = _x(s, column)
    df = s.ordered(number="__n").withColumn("__has", x.isNotNull())
    seen = Window.partitionBy(*s.by).orderBy("__n")
    kept = df.filter("__has").withColumn("__next", F.lead("__n").over(seen)).withColumn("__prev", F.lag("__n").over(seen))
    before = kept.filter("__next > __n + 1").select(*s.df.columns, F.lit("before").alias("edge"), (F.col("__next") - F.col("__n") - 1).alias("rows"))
    after = kept.filter("__prev < __n - 1").select(*s.df.columns, F.lit("after").alias("edge"), (F.col("__n") - F.col("__prev") - 1).alias("rows"))
    return before.unionByName(after)


# -- stacks --------------------------------------------------------------------------


def stacks_from_groups(s: Series, group: str, value: str, groups: list[str]) -> DataFrame:
    """Of rows with one key, each group's value with the base that it stands on, in the groups' order."""
    place = F.array_position(F.array(*map(F.lit, groups)), F.col(group).cast("string"))
    key = [c for c in (*s.by, *s.key) if c != group]
    rows = s.df.withColumn("i", (place - 1).cast("int")).filter("i >= 0").groupBy(*key, "i", F.col(group).alias("name")).agg(F.sum(_x(s, value).cast("double")).alias("value"))
    w = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("base", F.coalesce(F.sum("value").over(w), F.lit(0.0)))


def bars_from_bins(bins: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Bins with start and end as bars: begin, end, value; those without rows are left out."""
    return bins.filter(F.col(value).isNotNull()).select(*(by or []), F.col("start").alias("begin"), "end", F.col(value).alias("value"))


def transposed(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """A row's columns as rows: (keep, name, value), in order of ``columns``."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)]))
    return df.select(*keep, cells.alias("x")).select(*keep, "x.i", "x.name", "x.value")
