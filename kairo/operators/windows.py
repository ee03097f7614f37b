"""Rolling windows, row-to-row differences, running values, baselines and smoothing by windows.

A duration window is a RANGE frame.  To keep one long partition, or none at all, from ending
in one task, rows are dealt into time chunks of many windows' length; the rows a window
needs from the neighbouring chunk are copied there (about 1 in 8) and dropped afterwards.
Chunks are read in order and reduced over Arrow by functions.sliding, in about linear time
however many rows a window holds: Spark's own sliding frames go over all of a window's rows
for each row.  Only what such a read can't give (lists, rankings, a caller's own aggregates)
is still theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from ..functions import sliding
from ..functions.frames import join_on
from ..functions.reducers import NUMERIC, Reducer, finite, of_nothing, outputs, percentile_rank, reduce
from ..functions.time import from_us
from ..series import Series
from .aggregate import Mapping_, bounds
from .grid import Sequence, sample_point, spine

#: A chunk is this many windows long.
CHUNK = 8
#: Rows that are reduced together, as whole chunks; more only where one chunk has more.
TOGETHER = 200_000
#: Kinds that have ranks, and so a least and a greatest value by them.
RANKED = (*NUMERIC, "string", "date", "timestamp", "timestamp_ntz")


def frame_of(width: int | float, alignment: str, whole: bool = True) -> tuple[int | float, int | float]:
    """How far a duration window reaches back and forward; half-open ends are one microsecond short."""
    one = 1 if whole else 0
    if alignment == "trailing":
        return width - one, 0
    if alignment == "leading":
        return 0, width - one
    if alignment == "centered":
        return width // 2 if whole else width / 2, (width - width // 2 - one) if whole else width / 2
    raise ValueError(f"not an alignment: {alignment!r}")


Wanted = Mapping[str, tuple[Reducer, Column, str]]  #: by name: a reducer, what it reduces, and of what kind that is


def over_range(s: Series, back, ahead, columns: Wanted, at: Column | None = None) -> DataFrame:
    """Adds columns, each an aggregate over the rows at most ``back`` before and ``ahead`` after."""
    return over_ranges(s, [(back, ahead, columns)], at)


Frames = list[tuple[int | float, int | float, Wanted]]


def over_ranges(s: Series, frames: Frames, at: Column | None = None) -> DataFrame:
    """The same for several frames: rows are dealt once, for the widest, and all frames share one sort."""
    in_key_order, at = at is None, s.at if at is None else at
    back, ahead = max(f[0] for f in frames), max(f[1] for f in frames)
    size = max(CHUNK * (back + ahead), 1)
    whole = s.df.select(at.alias("a")).schema["a"].dataType.typeName() in ("byte", "short", "integer", "long")
    chunked = s.df.withColumn("__at", at.cast("bigint" if whole else "double"))
    home = F.floor(F.col("__at") / F.lit(size))
    lo, hi = F.floor((F.col("__at") - F.lit(ahead)) / F.lit(size)), F.floor((F.col("__at") + F.lit(back)) / F.lit(size))
    # a row without a place on the axis has an empty window and keeps its position
    chunks = F.when(F.col("__at").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.sequence(lo, hi))
    if not whole:  # NaNs are peers of each other, and of nothing else
        nan, apart = F.isnan("__at"), F.lit(1 << 62)
        home, chunks = F.when(nan, apart).otherwise(home), F.when(nan, F.array(apart)).otherwise(chunks)
    chunked = chunked.withColumn("__home", home).withColumn("__chunk", F.explode(chunks))
    if not whole:
        chunked = chunked.withColumn("__at", F.when(F.isnan("__at"), 0.0).otherwise(F.col("__at")))

    def window(back, ahead) -> WindowSpec:
        if all(float(x).is_integer() for x in (back, ahead)):
            return Window.partitionBy(*s.by, "__chunk").orderBy("__at").rangeBetween(-int(back), int(ahead))
        reach = max(back, ahead)  # frames take whole bounds: measure the axis in the window's own reach
        return Window.partitionBy(*s.by, "__chunk").orderBy(F.col("__at") / F.lit(reach)).rangeBetween(-round(back / reach), round(ahead / reach))

    placed = F.col("__at").isNotNull()
    frames_of_spark, made, plan, given = {}, [], [], {}
    for x, y, columns in frames:
        for name, (how, c, dtype) in columns.items():
            if not _slides(how, dtype, in_key_order):
                frames_of_spark[name] = F.when(placed, reduce(how, c, dtype, s.order, window(x, y)))
                continue
            typed = how in ("first", "last", "keep") or (how in ("min", "max") and dtype not in NUMERIC)
            c = finite(c, dtype)
            c = c if typed else c.isNotNull() if how == "count" else c.cast("double")
            source = next((n for n, e in given.items() if str(e) == str(c)), f"__v{len(given)}")
            given[source] = c
            plan.append((name, how, source, float(x), float(y), typed))
            made.append((name, source if typed else "bigint" if how == "count" else "double"))
    order = Window.partitionBy(*s.by, "__chunk").orderBy("__at", *s.ties)
    dealt = chunked.withColumns({**frames_of_spark, **given, "__i": F.row_number().over(order), "__own": F.col("__chunk").eqNullSafe(F.col("__home"))}).drop("__home", "__chunk")
    if not plan:
        return dealt.filter("__own").drop("__at", "__i", "__own")
    kinds = {f.name: f.dataType for f in dealt.schema.fields}
    kept = [*s.df.columns, *frames_of_spark]
    schema = T.StructType([T.StructField(c, kinds[c]) for c in kept] + [T.StructField(n, kinds.get(k) or (T.LongType() if k == "bigint" else T.DoubleType())) for n, k in made])
    return dealt.mapInArrow(_sliding(plan, kept), schema)


def _slides(how: Reducer, dtype: str, in_key_order: bool) -> bool:
    if callable(how):
        return False
    if how == "count":
        return True
    if how in ("first", "last"):
        return in_key_order
    if how in ("min", "max", "keep"):
        return dtype in RANKED
    return dtype in NUMERIC and (how in ("sum", "avg", "mean", "stdev", "difference", "median") or percentile_rank(how) is not None)


def _sliding(plan: list[tuple], kept: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks come one after the other, each in order with ``__i`` from 1; as many as make TOGETHER rows are reduced at once."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= TOGETHER:
                starts = np.flatnonzero(batch.column("__i").to_numpy() == 1)
                if len(starts) and rows - batch.num_rows + starts[-1] > 0:
                    yield from _slide([*held[:-1], batch.slice(0, starts[-1])], plan, kept)
                    held = [batch.slice(starts[-1])]
                    rows = held[0].num_rows
        if held:
            yield from _slide(held, plan, kept)

    return run


def _slide(batches: list[pa.RecordBatch], plan: list[tuple], kept: list[str]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches).combine_chunks()
    column = {c: table.column(c).combine_chunks() for c in table.column_names}
    begins = column["__i"].to_numpy() == 1
    group, placed = np.cumsum(begins), column["__at"].is_valid().to_numpy(zero_copy_only=False)
    at = pc.fill_null(column["__at"], 0).to_numpy()
    if at.dtype.kind == "i":  # from each chunk's begin, so that floats hold it to the microsecond
        at = (at - at[begins][group - 1]).astype(float)
    own = column["__own"].to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(own)
    out = {c: column[c].take(pa.array(rows)) for c in kept}
    empty = pa.array(~placed[rows])
    frames, flat = {}, {}
    for name, how, source, back, ahead, typed in plan:
        if (back, ahead) not in frames:
            frames[back, ahead] = sliding.edges(group, at, back, ahead, rows)
        lo, hi = frames[back, ahead]
        c = column[source]
        if typed:
            got = c.take(_place(c, how, lo, hi))
        elif how == "count":
            got = pa.array(sliding.counts(c.to_numpy(zero_copy_only=False), lo, hi))
        else:
            if source not in flat:
                flat[source] = c.to_numpy(zero_copy_only=False)
            got = pa.array(_number(flat[source], how, lo, hi), from_pandas=True)
        out[name] = pc.if_else(empty, pa.scalar(None, got.type), got)
    yield from pa.table(out).to_batches(max_chunksize=50_000)


def _place(c: pa.Array, how: str, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The row that each window's answer is in; null if it has none."""
    there = c.is_valid().to_numpy(zero_copy_only=False)
    if how == "first":
        at = np.append(sliding.at_or_after(there), len(there))[lo]
        ok = at < hi
    elif how == "last":
        at = np.append(sliding.before_or_at(there), -1)[hi - 1]
        ok = (hi > lo) & (at >= lo)
    else:
        rank = pc.rank(c, null_placement="at_end", tiebreaker="dense").to_numpy().astype(float)
        rank[~there] = np.nan
        one = (sliding.greatest if how == "max" else sliding.least)(rank, lo, hi)
        ok = ~np.isnan(one)
        if how == "keep":
            ok &= one == sliding.greatest(rank, lo, hi)
        holder = np.zeros(len(there) + 2, int)
        holder[rank[there].astype(int)] = np.flatnonzero(there)
        at = holder[np.where(ok, one, 0).astype(int)]
    return pa.array(np.where(ok, at, 0), mask=~ok)


def _number(x: np.ndarray, how: str, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    if how == "sum":
        return sliding.sums(x, lo, hi).astype(float)
    if how in ("avg", "mean"):
        n = sliding.counts(~np.isnan(x), lo, hi)
        return np.where(n > 0, sliding.sums(x, lo, hi) / np.maximum(n, 1), np.nan).astype(float)
    if how == "stdev":
        return sliding.deviations(x, lo, hi)
    if how == "difference":
        return sliding.greatest(x, lo, hi) - sliding.least(x, lo, hi)
    if how in ("min", "max"):
        return (sliding.least if how == "min" else sliding.greatest)(x, lo, hi)
    return sliding.percentiles(x, lo, hi, 0.5 if how == "median" else percentile_rank(how))


def _wanted(s: Series, outs) -> Wanted:
    return {f"__o_{o.name}": (o.reducer, F.col(o.source), s.types[o.source]) for o in outs}


def _reduced(s: Series, outs) -> dict[str, Callable[[WindowSpec], Column]]:
    return {f"__o_{o.name}": (lambda w, o=o: reduce(o.reducer, F.col(o.source), s.types[o.source], s.order, w)) for o in outs}


def _rows() -> tuple[Reducer, Column, str]:
    """All rows of a window, whatever they have."""
    return "count", F.lit(True), "boolean"


def _masked(outs, minimum: int, count: str) -> list[Column]:
    ok = F.col(count) >= minimum
    return [(F.when(ok, F.col(f"__o_{o.name}")) if minimum else of_nothing(o.reducer, F.col(f"__o_{o.name}"))).alias(o.name) for o in outs]


def rolling(s: Series, window: str | int | float | None, mapping: Mapping_, alignment: str = "trailing", min_samples: int = 0, count: int | None = None) -> Series:
    """Reduces the window of every row; the key stays.

    Trailing windows are (t - w, t], leading [t, t + w), centered [t - w/2, t + w/2); rows of
    one time share a result.  ``count`` windows are rows.  With fewer than ``min_samples``
    rows in the window its outputs are missing.
    """
    outs = outputs(mapping, [*s.values, *s.by])
    keep = [F.col(c) for c in s.df.columns if c not in s.values]
    if count is not None:
        cols = _reduced(s, outs) | {"__rows": lambda w: F.count(F.lit(1)).over(w)}
        left = {"trailing": count - 1, "leading": 0, "centered": (count - 1) // 2}[alignment]
        w = s.rows().rowsBetween(-left, count - 1 - left)
        df = s.df.withColumns({n: c(w) for n, c in cols.items()})
    else:
        df = over_range(s, *frame_of(s.us(window), alignment, s.kind != "value"), _wanted(s, outs) | {"__rows": _rows()})
    return s.with_df(df.select(*keep, *_masked(outs, min_samples, "__rows")))


def rolling_fused(s: Series, windows: Mapping[str, Mapping_], alignment: str = "trailing", min_samples: int = 0) -> Series:
    """Several windows at once, dealt for the widest and over one sort; names must differ."""
    names = [n for m in windows.values() for n in m]
    if len(set(names)) < len(names):
        raise ValueError("output names must differ")
    frames, made = [], []
    for width, mapping in windows.items():
        outs = outputs(mapping, [*s.values, *s.by])
        frames.append((*frame_of(s.us(width), alignment, s.kind != "value"), _wanted(s, outs) | {f"__rows_{width}": _rows()}))
        made += _masked(outs, min_samples, f"__rows_{width}")
    df = over_ranges(s, frames)
    return s.with_df(df.select(*[F.col(c) for c in s.df.columns if c not in s.values], *made))


def rolling_on(s: Series, seq: Sequence, window: str | int, mapping: Mapping_, alignment: str = "trailing", sample: str = "begin", span: tuple | None = None, min_samples: int = 0) -> Series:
    """The window at each sample point of a grid, empty ones too.

    Points and rows meet by equality on window-sized cells (each point looks at the two or
    three cells its window touches), never by a range join.
    """
    outs = outputs(mapping, [*s.values, *s.by])
    back, ahead = frame_of(s.us(window), alignment)
    size = max(back + ahead, 1)
    points = spine(bounds(s, span), list(s.by), seq, sample).withColumn("__t", sample_point(sample))
    cells = points.withColumn("__cell", F.explode(F.sequence(F.floor((F.col("__t") - back) / size), F.floor((F.col("__t") + ahead) / size))))
    rows = s.df.withColumn("__at", s.at).withColumn("__cell", F.floor(F.col("__at") / size))
    met = join_on(cells, rows, [*s.by, "__cell"]).filter((F.col("__at") >= F.col("__t") - back) & (F.col("__at") <= F.col("__t") + ahead))
    agg = met.groupBy(*s.by, "__b").agg(*[reduce(o.reducer, F.col(o.source), s.types[o.source], s.order).alias(f"__o_{o.name}") for o in outs], F.count(F.lit(1)).alias("__rows"))
    got = join_on(points, agg, [*s.by, "__b"], "left").withColumn("__rows", F.coalesce("__rows", F.lit(0)))
    df = got.select(*s.by, from_us(F.col("__b")).alias("begin"), from_us(F.col("__e")).alias("end"), (F.col("__b") / 1000).cast("bigint").alias("label"), *_masked(outs, min_samples, "__rows"))
    return Series(df, "interval", ("begin", "end", "label"), s.by)


def rolling_by_column(s: Series, column: str, radius: float, mapping: Mapping_, at: list[float] | None = None) -> DataFrame:
    """Windows of +-radius (closed) on a value; at each row, or at the centres given."""
    outs = outputs(mapping, [*s.values, *s.by])
    v = F.col(column).cast("double")
    if at is None:
        df = over_range(s, radius, radius, _wanted(s, outs), v)
        return df.select(*[c for c in s.df.columns if c not in s.values], column, *[of_nothing(o.reducer, F.col(f"__o_{o.name}")).alias(o.name) for o in outs])
    size = max(2 * radius, 1e-9)
    spark = s.df.sparkSession
    listed = F.explode(F.array(*[F.lit(float(c)) for c in at])).alias("center")  # a list from the caller
    centres = s.df.select(*s.by).distinct().select(*s.by, listed) if s.by else spark.range(1).select(listed)
    cells = centres.withColumn("__cell", F.explode(F.sequence(F.floor((F.col("center") - radius) / size), F.floor((F.col("center") + radius) / size))))
    rows = s.df.withColumn("__v", v).withColumn("__cell", F.floor(F.col("__v") / size))
    met = join_on(cells, rows, [*s.by, "__cell"]).filter(F.abs(F.col("__v") - F.col("center")) <= radius)
    agg = met.groupBy(*s.by, "center").agg(*[reduce(o.reducer, F.col(o.source), s.types[o.source], s.order).alias(o.name) for o in outs])
    got = join_on(centres, agg, [*s.by, "center"], "left")
    return got.select(*s.by, "center", *[of_nothing(o.reducer, F.col(o.name)).alias(o.name) for o in outs])


# -- row to row ------------------------------------------------------------------


def _each(s: Series, cols: list[str], make, drop: bool = False) -> Series:
    w = s.rows()
    df = s.df.withColumn("__n", F.row_number().over(w)) if drop else s.df
    df = df.withColumns({c: make(F.col(c).cast("double"), F.lag(F.col(c).cast("double")).over(w), w) for c in cols})
    return s.with_df(df.filter("__n > 1").drop("__n") if drop else df)


def diff(s: Series, *cols: str, drop: bool = False) -> Series:
    """Change from the row just before; missing if either is."""
    return _each(s, list(cols), lambda x, p, w: x - p, drop)


def rate(s: Series, *cols: str, drop: bool = False) -> Series:
    """Change per second; missing where no time has passed."""
    dt = lambda w: (s.at - F.lag(s.at).over(w)) / (1 if s.kind == "value" else 1e6)
    return _each(s, list(cols), lambda x, p, w: F.when(dt(w) != 0, (x - p) / dt(w)), drop)


def pct_change(s: Series, *cols: str, drop: bool = False) -> Series:
    """Change as a fraction of the row before; missing where that is zero."""
    return _each(s, list(cols), lambda x, p, w: F.when(p != 0, (x - p) / p), drop)


def shift(s: Series, n: int, *cols: str) -> Series:
    """Values n rows later (lag), or earlier if negative."""
    w = s.rows()
    return s.with_df(s.df.withColumns({c: F.lag(c, n).over(w) if n >= 0 else F.lead(c, -n).over(w) for c in cols}))


def cumulative(s: Series, how: Mapping[str, str]) -> Series:
    """Running sum, max, min or count; carried over gaps, missing before the first value.
    Series.dealt deals long partitions: each stretch adds what came before it."""
    wrong = [fn for fn in how.values() if fn not in ("sum", "max", "min", "count")]
    if wrong:
        raise ValueError(f"not an accumulation: {wrong[0]!r}")
    x = {c: finite(F.col(c), s.types[c]) for c in how}
    df = s.ordered(running={f"__run_{c}": (fn, x[c] if fn == "count" else x[c].cast("double")) for c, fn in how.items()})
    got = lambda c: F.when(F.col(f"__run_{c}") > 0, F.col(f"__run_{c}").cast("double")) if how[c] == "count" else F.col(f"__run_{c}")
    return s.with_df(df.withColumns({c: got(c) for c in how}).select(*s.df.columns))


# -- bands and smoothing -----------------------------------------------------------


def baseline(s: Series, column: str, window: str | int, sigma: float = 2.0, alignment: str = "trailing", min_samples: int = 0, names: tuple[str, str, str, str] = ("avg", "sd", "upper", "lower")) -> Series:
    """Adds the window's mean and deviation and the band between; no band where the deviation is zero."""
    x = finite(F.col(column), s.types[column]).cast("double")
    a, d, up, low = names
    df = over_range(s, *frame_of(s.us(window), alignment), {"__a": ("avg", x, "double"), "__d": ("stdev", x, "double"), "__rows": _rows()})
    ok = F.col("__rows") >= min_samples
    df = df.withColumn(a, F.when(ok, F.col("__a"))).withColumn(d, F.when(ok, F.col("__d")))
    some = F.col(d) > 0
    df = df.withColumn(up, F.when(some, F.col(a) + sigma * F.col(d))).withColumn(low, F.when(some, F.col(a) - sigma * F.col(d)))
    return s.with_df(df.drop("__a", "__d", "__rows"))


def outliers(s: Series, column: str, window: str | int, sigma: float = 2.0, alignment: str = "trailing", min_samples: int = 0) -> Series:
    """Rows strictly further than sigma deviations from their window's mean."""
    b = baseline(s, column, window, sigma, alignment, min_samples, ("__avg", "__sd", "__up", "__low"))
    far = (F.col("__sd") > 0) & (F.abs(F.col(column) - F.col("__avg")) > sigma * F.col("__sd"))
    return s.with_df(b.df.filter(far).select(*s.df.columns))


def moving_average(s: Series, column: str, window: str | int, alignment: str = "trailing", missing: str = "bridge", output: str | None = None) -> Series:
    """Mean of the values present in the window, anchored at an extent's midpoint."""
    x = finite(F.col(column), s.types[column]).cast("double")
    df = over_range(s, *frame_of(s.us(window), alignment, s.kind != "value"), {"__m": ("avg", x, "double")}, s.center)
    m = F.when(x.isNotNull(), F.col("__m")) if missing == "skip" else F.col("__m")
    return s.with_df(df.withColumn(output or column, m).drop("__m"))

