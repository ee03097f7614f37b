"""Bucketed and global reduction, value bins, materialise and align."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import in_order, join_on
from ..functions.reducers import NUMERIC, Output, Reducer, of_nothing, outputs, reduce
from ..functions.time import from_us
from ..series import Series
from .grid import BLOCK, Calendar, Every, Intervals, Sequence, sample_point, spine, to_us
from .joins import CELL, interval_join

Mapping_ = Mapping[str, Reducer | tuple[str, Reducer]]


def bounds(s: Series, span: tuple | None = None) -> DataFrame:
    """Each partition's range in microseconds: its own extent, or the range given."""
    lo, hi = F.min(s.at).alias("__lo"), F.max(s.until).alias("__hi")
    b = (s.df.groupBy(*s.by) if s.by else s.df.groupBy()).agg(lo, hi).filter("__lo is not null")
    if span is None:
        return b
    return b.select(*s.by, F.lit(to_us(span[0])).alias("__lo"), F.lit(to_us(span[1])).alias("__hi"))


def _outs(s: Series, mapping: Mapping_) -> list[Output]:
    return outputs(mapping, [*s.values, *s.by])


def reducers(s: Series, outs: list[Output]) -> list[Column]:
    return [reduce(o.reducer, F.col(o.source), s.types[o.source], s.order).alias(o.name) for o in outs]


def bucketed(s: Series, seq: Sequence, spans: DataFrame | None = None) -> DataFrame:
    """The rows with ``__b``, the begin of their bucket; an extent is in every bucket it overlaps.

    Points fall into exactly one bucket by arithmetic, so this shuffles nothing.
    """
    point = s.kind in ("time", "value")
    if isinstance(seq, Intervals):
        spans = seq.frame(s.df.sparkSession)
        if point:
            return interval_join(s.df, s.at, spans, F.col("__b"), F.col("__e"), how="inner").drop("__e")
        # an extent is listed under every cell it touches, as the spans are, and met once by each span
        cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / F.lit(CELL)), F.floor(hi / F.lit(CELL))))
        right = spans.withColumn("__cell", cells(F.col("__b"), F.col("__e")))
        left = s.df.withColumn("__lo", s.at).withColumn("__hi", s.until).withColumn("__cell", cells(s.at, s.until))
        lo, hi = F.col("__lo"), F.col("__hi")
        hit = ((lo >= F.col("__b")) & (lo < F.col("__e"))) | ((lo < F.col("__e")) & (hi > F.col("__b")))
        first = F.greatest(F.floor(lo / F.lit(CELL)), F.floor(F.col("__b") / F.lit(CELL))) == F.col("__cell")
        return left.join(right, "__cell").filter(hit & first).drop("__cell", "__lo", "__hi", "__e")
    if point:
        return s.df.withColumn("__b", seq.bucket(s.at))
    last = F.greatest(s.until - 1, s.at)
    if isinstance(seq, Every):
        return s.df.withColumn("__b", F.explode(F.sequence(seq.bucket(s.at), seq.bucket(last), F.lit(seq.step).cast("bigint"))))
    return s.df.withColumn("__b", F.explode(F.array_distinct(F.concat(F.array(seq.bucket(s.at)), seq.begins(s.at, last, "begin")))))


def aggregate(s: Series, seq: Sequence, mapping: Mapping_, span: tuple | None = None, sample: str = "begin") -> Series:
    """Reduces each bucket.  Every bucket whose sample point lies in the range is there, empty ones
    too; a leading bucket that begins before the range is not, nor are its rows."""
    outs = _outs(s, mapping)
    agg = bucketed(s, seq).groupBy(*s.by, "__b").agg(*reducers(s, outs))
    grid = spine(bounds(s, span), list(s.by), seq, sample)
    got = join_on(grid, agg.withColumnsRenamed({o.name: f"__o_{o.name}" for o in outs}), [*s.by, "__b"], "left")
    cols = [of_nothing(o.reducer, F.col(f"__o_{o.name}")).alias(o.name) for o in outs]
    df = got.select(*s.by, from_us(F.col("__b")).alias("begin"), from_us(F.col("__e")).alias("end"), (F.col("__b") / 1000).cast("bigint").alias("label"), *cols)
    return Series(df, "interval", ("begin", "end", "label"), s.by)


def reduce_all(s: Series, mapping: Mapping_) -> DataFrame:
    """A row per partition."""
    return (s.df.groupBy(*s.by) if s.by else s.df.groupBy()).agg(*reducers(s, _outs(s, mapping)))


def materialize(s: Series, seq: Sequence, select: str = "last", sample: str = "begin", span: tuple | None = None) -> Series:
    """One row per bucket at its sample point: the bucket's first, last or nearest row, or all missing."""
    if select not in ("first", "last", "nearest"):
        raise ValueError(f"not a selection: {select!r}")
    grid = spine(bounds(s, span), list(s.by), seq, sample)
    row = F.struct(*s.values).alias("r")
    rows = bucketed(s, seq)
    if select == "nearest":
        rows = rows.withColumn("__e", seq.end(F.col("__b"))) if not isinstance(seq, Intervals) else rows.join(F.broadcast(seq.frame(s.df.sparkSession)), "__b")
        agg = rows.groupBy(*s.by, "__b").agg(F.min_by(row, F.struct(F.abs(s.at - sample_point(sample)), s.order)).alias("r"))
    else:
        agg = rows.groupBy(*s.by, "__b").agg((F.min_by if select == "first" else F.max_by)(row, s.order).alias("r"))
    got = join_on(grid, agg, [*s.by, "__b"], "left")
    df = got.select(*s.by, from_us(sample_point(sample)).alias("time"), *[F.col(f"r.{c}").alias(c) for c in s.values])
    return Series(df, "time", ("time",), s.by)


def align(s: Series, seq: Sequence, method: str = "hold", sample: str = "begin", span: tuple | None = None) -> Series:
    """Values at each bucket's sample point, held from the row before or interpolated between two.

    Rows and points are merged into one ordered run per partition, read once each way (see
    Series.dealt for long partitions): no range join.  At equal times the first row is met exactly; an extent that begins at
    the point isn't held.
    """
    if method not in ("hold", "linear"):
        raise ValueError(f"not a method: {method!r}")
    if method == "linear" and s.kind != "time":
        raise ValueError("linear alignment needs point keys")
    grid = spine(bounds(s, span), list(s.by), seq, sample).withColumn("__t", sample_point(sample))
    row = F.struct(s.at.alias("t"), *s.values)
    # of rows at one time: points see the first as exact, later points see the last
    w = Window.partitionBy(*s.by, "__t").orderBy(*s.ties) if s.ties else Window.partitionBy(*s.by, "__t").orderBy("__t")
    data = s.df.withColumn("__t", s.at).withColumn("__i", F.row_number().over(w)).select(*s.by, "__t", F.when(F.col("__i") == 1, 0).otherwise(2).alias("__p"), "__i", row.alias("r"))
    if s.kind != "time":
        data = data.withColumn("__p", F.lit(2))
    marks = grid.select(*s.by, "__t", F.lit(1).alias("__p"), F.lit(0).alias("__i"), F.lit(None).cast(data.schema["r"].dataType).alias("r"), "__b", "__e")
    run = data.withColumn("__b", F.lit(None).cast("bigint")).withColumn("__e", F.lit(None).cast("bigint")).unionByName(marks)
    stretch = s.stretch_of(F.col("__t"))
    seen = {"prev": F.col("r")}, {"next": F.col("r")} if method == "linear" else {}
    run = in_order(run, s.by, [F.col(c) for c in ("__t", "__p", "__i")], stretch, *seen)
    at = run.filter("__p = 1 and __b is not null")

    def cell(c: str) -> Column:
        p = F.col(f"prev.{c}")
        if method == "hold" or s.types[c] not in NUMERIC:
            return p.alias(c)
        n, t0, t1 = F.col(f"next.{c}"), F.col("prev.t"), F.col("next.t")
        between = (F.col("__t") > t0) & (t1 > t0) & p.isNotNull() & n.isNotNull()
        return F.when(between, p + (n - p) * ((F.col("__t") - t0) / (t1 - t0))).otherwise(p).alias(c)

    df = at.select(*s.by, from_us(F.col("__b")).alias("begin"), from_us(F.col("__e")).alias("end"), (F.col("__b") / 1000).cast("bigint").alias("label"), *[cell(c) for c in s.values])
    return Series(df, "interval", ("begin", "end", "label"), s.by)


def by_column(s: Series, column: str, mapping: Mapping_, width: float | None = None, origin: float = 0.0, edges: list[float] | None = None, inclusive: str = "[)") -> DataFrame:
    """Bins of a value: (start, end, outputs).  Widths run from the lowest to the highest bin
    that has rows; edges always give all their bins.  Missing and outside values are dropped."""
    if {"start", "end"} & set(mapping):
        raise ValueError("start and end are the bin's own")
    outs = _outs(s, mapping)
    v = F.col(column).cast("double")
    ok = s.df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    if edges is None:
        if not width or width <= 0:
            raise ValueError("a width must be positive")
        b = F.floor((v - F.lit(origin)) / F.lit(width))
        # division and multiplication round apart: step over to the bin whose bounds hold the value
        b = F.when(v < F.lit(origin) + b * width, b - 1).when(v >= F.lit(origin) + (b + 1) * width, b + 1).otherwise(b)
        agg = ok.withColumn("__bin", b).groupBy(*s.by, "__bin").agg(*reducers(s, outs))
        extent = agg.groupBy(*s.by).agg(F.min("__bin").alias("lo"), F.max("__bin").alias("hi")).filter("lo is not null")
        blocks = extent.select(*s.by, "hi", F.explode(F.sequence(F.col("lo"), F.col("hi"), F.lit(BLOCK).cast("bigint"))).alias("from"))
        grid = blocks.select(*s.by, F.explode(F.sequence(F.col("from"), F.least(F.col("hi"), F.col("from") + BLOCK - 1))).alias("__bin"))
        start, end = F.lit(origin) + F.col("__bin") * width, F.lit(origin) + (F.col("__bin") + 1) * width
    else:
        if len(edges) < 2 or any(b <= a for a, b in zip(edges, edges[1:], strict=False)) or inclusive not in ("[)", "(]"):
            raise ValueError("edges must ascend, two at least, and be '[)' or '(]'")
        lit = F.array(*[F.lit(float(e)) for e in edges])
        if inclusive == "[)":
            b = F.when((v >= edges[0]) & (v < edges[-1]), F.size(F.filter(lit, lambda e: e <= v)) - 1)
        else:
            b = F.when((v >= edges[0]) & (v <= edges[-1]), F.greatest(F.size(F.filter(lit, lambda e: e < v)) - 1, F.lit(0)))
        agg = ok.withColumn("__bin", b.cast("bigint")).filter("__bin is not null").groupBy(*s.by, "__bin").agg(*reducers(s, outs))
        bins = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(len(edges) - 2).cast("bigint"))).alias("__bin")
        grid = s.df.select(*s.by).distinct().select(*s.by, bins) if s.by else s.df.sparkSession.range(1).select(bins)
        start, end = F.get(lit, F.col("__bin").cast("int")), F.get(lit, (F.col("__bin") + 1).cast("int"))
    got = join_on(grid, agg, [*s.by, "__bin"], "left")
    return got.select(*s.by, start.alias("start"), end.alias("end"), *[of_nothing(o.reducer, F.col(o.name)).alias(o.name) for o in outs])


__all__ = ["Calendar", "aggregate", "align", "bounds", "bucketed", "by_column", "materialize", "reduce_all", "reducers"]
