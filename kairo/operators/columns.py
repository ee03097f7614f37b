"""Whole-column reads, index and key bins, and four-point decimation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import join_on
from ..functions.reducers import finite, reduce
from ..series import Series


def _groups(s: Series):
    return s.df.groupBy(*s.by) if s.by else s.df.groupBy()


def describe(s: Series, column: str, *reducers: str) -> DataFrame:
    """Reducers of one column, a column each: min, max, sum, mean, stdev, median, pNN, count, first, last."""
    return _groups(s).agg(*[reduce(r, F.col(column), s.types[column], s.order).alias(r) for r in reducers])


def min_max(s: Series, column: str) -> DataFrame:
    return describe(s, column, "min", "max")


def missing(s: Series, column: str) -> DataFrame:
    n = F.count_if(F.col(column).isNull())
    return _groups(s).agg((n > 0).alias("has_missing"), n.alias("null_count"))


def ends(s: Series, column: str) -> DataFrame:
    """The first and last cells, missing or not, and the first and last that aren't."""
    cell = F.struct(F.col(column).alias("v"))
    return _groups(s).agg(
        F.min_by(cell, s.order)["v"].alias("first"),
        F.max_by(cell, s.order)["v"].alias("last"),
        reduce("first", F.col(column), s.types[column], s.order).alias("first_defined"),
        reduce("last", F.col(column), s.types[column], s.order).alias("last_defined"),
    )


def truth(s: Series, column: str) -> DataFrame:
    c = F.coalesce(F.col(column), F.lit(False))
    return _groups(s).agg(F.bool_and(c).alias("all"), F.bool_or(c).alias("any"), (~F.bool_or(c)).alias("none"), F.count_if(c).alias("count"))


def unique_count(s: Series, column: str) -> DataFrame:
    return _groups(s).agg(F.count_distinct(column).alias("unique_count"))


SHAPES = {
    "minMax": lambda c, o: F.struct(F.min(c).alias("min"), F.max(c).alias("max")),
    "minMaxFirstLast": lambda c, o: F.struct(F.min(c).alias("min"), F.max(c).alias("max"), F.min_by(c, F.when(c.isNotNull(), o)).alias("first"), F.max_by(c, F.when(c.isNotNull(), o)).alias("last")),
}


def bin_by_index(s: Series, column: str, bins: int, reducer: str) -> DataFrame:
    """``bins`` stretches of equal numbers of rows, bounds at floor(b * n / bins)."""
    df = s.ordered(number="__n", whole={"__rows": ("count", F.lit(1))})
    # the bin of row i (from 0) is the last b with floor(b * n / bins) <= i
    b = F.floor(((F.col("__n")) * bins - 1) / F.col("__rows"))
    shape = SHAPES[reducer](finite(F.col(column), s.types[column]), s.order) if reducer in SHAPES else reduce(reducer, F.col(column), s.types[column], s.order)
    agg = df.withColumn("bin", b).groupBy(*s.by, "bin").agg(shape.alias("value"))
    grid = _groups(s).agg(F.count(F.lit(1)).alias("__c")).select(*s.by, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    return join_on(grid, agg, [*s.by, "bin"], "left")


def bin_by_key(s: Series, column: str, edges: list[float], reducer: str, key=None) -> DataFrame:
    """Bins of the key between edges (microseconds for times); the last edge is inside."""
    k = s.at if key is None else key
    lit = F.array(*[F.lit(e) for e in edges])
    b = F.when((k >= edges[0]) & (k <= edges[-1]), F.least(F.size(F.filter(lit, lambda e: e <= k)) - 1, F.lit(len(edges) - 2)))
    shape = SHAPES[reducer](finite(F.col(column), s.types[column]), s.order) if reducer in SHAPES else reduce(reducer, F.col(column), s.types[column], s.order)
    agg = s.df.withColumn("bin", b.cast("bigint")).filter("bin is not null").groupBy(*s.by, "bin").agg(shape.alias("value"))
    grid = _groups(s).agg(F.count(F.lit(1)).alias("__c")).select(*s.by, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(len(edges) - 2).cast("bigint"))).alias("bin"))
    return join_on(grid, agg, [*s.by, "bin"], "left")


def m4(s: Series, column: str, buckets: int, lo=None, hi=None) -> DataFrame:
    """First, last, least and greatest of each of ``buckets`` equal stretches of the key: what a
    line of that many pixels shows.  Empty buckets are there, all missing: a break in the line."""
    c = finite(F.col(column), s.types[column])
    extent = _groups(s).agg(F.min(s.at).alias("__lo"), F.max(s.at).alias("__hi")) if lo is None else _groups(s).agg(F.lit(lo).alias("__lo"), F.lit(hi).alias("__hi"))
    df = join_on(s.df, extent, s.by) if s.by else s.df.join(F.broadcast(extent))
    at = s.at
    width = F.greatest((F.col("__hi") - F.col("__lo")).cast("double"), F.lit(1e-300))
    b = F.least(F.floor((at - F.col("__lo")) / width * buckets), F.lit(buckets - 1))
    o = F.when(c.isNotNull(), s.order)
    k = F.when(c.isNotNull(), at)
    agg = df.filter((at >= F.col("__lo")) & (at <= F.col("__hi"))).withColumn("bucket", b).groupBy(*s.by, "bucket").agg(
        F.min_by(k, o).alias("first_at"), F.min_by(c, o).alias("first"), F.max_by(k, o).alias("last_at"), F.max_by(c, o).alias("last"),
        F.min(c).alias("min"), F.min_by(k, F.struct(c, s.order)).alias("min_at"), F.max(c).alias("max"), F.max_by(k, F.struct(c, (-at).alias("k"))).alias("max_at"),
    )
    grid = extent.select(*s.by, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))).alias("bucket"))
    return join_on(grid, agg, [*s.by, "bucket"], "left")


def stacked(s: Series, columns: list[str]) -> DataFrame:
    """Long form for stacked marks: each value with the base it stands on, in column order."""
    long = s.df.select(*s.by, *s.key, F.posexplode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("i", "x"))
    w = Window.partitionBy(*s.by, *s.key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return long.select(*s.by, *s.key, "i", F.col("x.name").alias("name"), F.col("x.value").alias("value"), F.coalesce(F.sum(F.col("x.value")).over(w), F.lit(0.0)).alias("base"))


def segments(s: Series, column: str, lo: float, hi: float, bridge: float = 0.0) -> DataFrame:
    """Stretches of the axis on which a value stays in [lo, hi]; gaps of at most ``bridge`` are crossed."""
    inside = s.df.filter(F.col(column).between(lo, hi)) if bridge else s.df
    w = s.rows()
    if bridge:
        new = F.coalesce(s.at - F.lag(s.at).over(w) > bridge, F.lit(True))
        run = inside.withColumn("__new", new.cast("int"))
    else:
        ok = F.coalesce(F.col(column).between(lo, hi), F.lit(False))
        run = inside.withColumn("__ok", ok).withColumn("__new", (F.col("__ok") & ~F.coalesce(F.lag("__ok").over(w), F.lit(False))).cast("int"))
    run = run.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if not bridge:
        run = run.filter("__ok")
    return run.groupBy(*s.by, "__g").agg(F.min(s.key[0]).alias("start"), F.max(s.key[0]).alias("end"), F.count(F.lit(1)).alias("rows")).drop("__g")
