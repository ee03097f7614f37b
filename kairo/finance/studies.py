"""Studies over bars: each adds columns; the first period - 1 rows of a partition are missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.reducers import finite
from ..operators.folds import ema as fold_ema
from ..operators.windows import over_range
from ..series import Series


def _window(s: Series, period: int):
    if period < 1:
        raise ValueError("a period is one bar at least")
    return s.rows().rowsBetween(-(period - 1), 0)


def _add(s: Series, cols: dict[str, Column]) -> Series:
    taken = [c for c in cols if c in s.df.columns]
    if taken:
        raise ValueError(f"columns are there already: {taken}")
    return s.with_df(s.df.withColumns(cols))


def _dealt(s: Series, period: int, how: dict[str, tuple[str, Column]]) -> Series | None:
    """The same reductions of whole windows, for a series that is dealt in stretches or has no partitions: rows are
    numbered and windows are ranges of numbers, so that no task has all rows.  None for others."""
    numbers = s.stretch_of(s.at)
    if numbers is None:
        return None
    if period < 1:
        raise ValueError("a period is one bar at least")
    taken = [c for c in how if c in s.df.columns]
    if taken:
        raise ValueError(f"columns are there already: {taken}")
    wanted = {n: (reducer, x, "double") for n, (reducer, x) in how.items()} | {"__full": ("count", F.lit(True), "boolean")}
    df = over_range(s.with_df(s.numbered()), max(period - 1, 0), 0, wanted, F.col("__n"))
    return s.with_df(df.withColumns({n: F.when(F.col("__full") >= period, F.col(n)) for n in how}).select(*s.df.columns, *how))


def _full(s: Series, period: int, agg: Column) -> Column:
    w = _window(s, period)
    return F.when(F.count(F.lit(1)).over(w) >= period, agg.over(w))


def _x(s: Series, c: str) -> Column:
    return finite(F.col(c), s.types[c]).cast("double")


def sma(s: Series, period: int, source: str = "close", output: str = "sma") -> Series:
    return _dealt(s, period, {output: ("avg", _x(s, source))}) or _add(s, {output: _full(s, period, F.avg(_x(s, source)))})


def ema(s: Series, period: int, source: str = "close", output: str = "ema") -> Series:
    """Warm-up counts values present, not rows."""
    if output in s.df.columns:
        raise ValueError(f"columns are there already: {[output]}")
    return fold_ema(s, source, span=period, min_samples=period, output=output)


def bollinger(s: Series, period: int = 20, k: float = 2.0, source: str = "close", names: tuple[str, str, str] = ("middle", "upper", "lower")) -> Series:
    """Mean and k population deviations either way; no bands where the deviation is zero."""
    if dealt := _dealt(s, period, {"__mid": ("avg", _x(s, source)), "__sd": ("stdev", _x(s, source))}):
        mid, sd = F.col("__mid"), F.col("__sd")
        done = _add(dealt, {names[0]: mid, names[1]: F.when(sd > 0, mid + k * sd), names[2]: F.when(sd > 0, mid - k * sd)})
        return done.with_df(done.df.drop("__mid", "__sd"))
    mid, sd = _full(s, period, F.avg(_x(s, source))), _full(s, period, F.stddev_pop(_x(s, source)))
    return _add(s, {names[0]: mid, names[1]: F.when(sd > 0, mid + k * sd), names[2]: F.when(sd > 0, mid - k * sd)})


def envelope(s: Series, period: int = 20, percent: float = 2.5, source: str = "close", kind: str = "sma", names: tuple[str, str, str] = ("middle", "upper", "lower")) -> Series:
    out = sma(s, period, source, names[0]) if kind == "sma" else ema(s, period, source, names[0])
    return _add(out, {names[1]: F.col(names[0]) * (1 + percent / 100), names[2]: F.col(names[0]) * (1 - percent / 100)})


def rolling_stat(s: Series, period: int, stat: str, source: str = "close", output: str | None = None) -> Series:
    """stdev (population), min, max, or a percentile as pNN."""
    x = _x(s, source)
    if dealt := _dealt(s, period, {output or stat: (stat, x)}):
        return dealt
    agg = {"stdev": F.stddev_pop(x), "min": F.min(x), "max": F.max(x)}.get(stat)
    if agg is None:
        agg = F.percentile(x, F.lit(float(stat.removeprefix("p")) / 100))
    return _add(s, {output or stat: _full(s, period, agg)})


def ranged_moments(s: Series, period: int, begin: int, end: int, source: str = "close", names: tuple[str, str] = ("mean", "sd")) -> Series:
    """The window's mean and population deviation for rows ``begin`` to ``end`` of each partition (from 0,
    end left out), the same to the last bit whatever the range: each window is summed on its own
    around its first value, and only the rows that the range's windows hold are read."""
    if period < 1 or begin < 0 or end < begin:
        raise ValueError("a period is one bar at least, and a range ascends")
    n = F.col("__n") - 1
    near = s.with_df(s.numbered().filter((n >= begin - period + 1) & (n < end)))
    cells = F.filter(F.collect_list(F.struct(_x(s, source).alias("v"))).over(_window(near, period)), lambda c: c["v"].isNotNull())
    base = F.coalesce(F.get("__cells", F.lit(0))["v"], F.lit(0.0))
    df = near.df.withColumn("__cells", cells)
    total = lambda f: F.aggregate("__cells", F.lit(0.0), lambda a, c: a + f(c["v"] - base))
    k, full = F.size("__cells"), F.col("__n") >= period
    mean = total(lambda v: v) / k
    df = df.withColumn("__mean", F.when(k > 0, mean))
    spread = F.aggregate("__cells", F.lit(0.0), lambda a, c: a + F.pow(c["v"] - base - F.col("__mean"), F.lit(2)))
    cols = {names[0]: F.when(full, F.col("__mean") + base), names[1]: F.when(full & (k > 0), F.sqrt(spread / k))}
    return s.with_df(df.withColumns(cols).filter(n >= begin).drop("__n", "__cells", "__mean"))


def z_score(s: Series, period: int = 20, source: str = "close", output: str = "z") -> Series:
    x = _x(s, source)
    if dealt := _dealt(s, period, {"__mid": ("avg", x), "__sd": ("stdev", x)}):
        done = _add(dealt, {output: F.when(F.col("__sd") > 0, (x - F.col("__mid")) / F.col("__sd"))})
        return done.with_df(done.df.drop("__mid", "__sd"))
    sd = _full(s, period, F.stddev_pop(x))
    return _add(s, {output: F.when(sd > 0, (x - _full(s, period, F.avg(x))) / sd)})


def percent_change(s: Series, period: int = 1, source: str = "close", output: str = "change") -> Series:
    """In percent."""
    x = _x(s, source)
    before = F.lag(x, period).over(s.rows())
    return _add(s, {output: F.when(before != 0, (x / before - 1) * 100)})
