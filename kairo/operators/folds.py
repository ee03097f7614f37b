"""Sequential folds: what a window function cannot say.

Rows are dealt by partition key and sorted; a fold reads them as a stream of Arrow batches
and carries its state from row to row and batch to batch, so memory doesn't grow with the
length of a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.reducers import finite
from ..series import Series


def fold(s: Series, inputs: list[str], out: dict[str, str], start: Callable[[], object], step: Callable[[object, dict[str, np.ndarray]], tuple[object, dict[str, np.ndarray]]]) -> Series:
    """Adds columns ``out`` (name: type) from ``step(state, arrays)``, run over stretches of rows
    of one partition in order.  ``arrays`` has the inputs as doubles with NaN for missing, and
    ``at``, the key.  Missing outputs are NaN."""
    key = F.xxhash64(*[F.col(c) for c in s.by]) if s.by else F.lit(0).cast("bigint")
    src = s.df.withColumn("__key", key).withColumn("__at", s.at.cast("double")).withColumns({f"__in_{c}": finite(F.col(c), s.types[c]).cast("double") for c in inputs})
    src = src.repartition("__key").sortWithinPartitions("__key", *s.by, s.at, *s.ties)
    by, names = list(s.by), list(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last = None, None
        for df in batches:
            if df.empty:
                continue
            ident = df[["__key", *by]].astype(object).where(df[["__key", *by]].notna(), None)
            ids = list(map(tuple, ident.itertuples(index=False)))
            cut = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
            made = {n: np.empty(len(df)) for n in names}
            for a, b in zip(cut, cut[1:], strict=False):
                if ids[a] != last:
                    state, last = start(), ids[a]
                part = {c: df[f"__in_{c}"].to_numpy(float)[a:b] for c in inputs} | {"at": df["__at"].to_numpy(float)[a:b]}
                state, got = step(state, part)
                for n in names:
                    made[n][a:b] = got[n]
            df = df.drop(columns=["__key", "__at", *[f"__in_{c}" for c in inputs]])
            for n in names:
                df[n] = pd.Series(made[n], index=df.index)
            yield df

    plain = s.df.select(*[c for c in s.df.columns if c not in names])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), *(f"`{n}` {t}" for n, t in out.items())])
    keep = src.drop(*[n for n in names if n in s.df.columns])
    result = keep.mapInPandas(run, schema)
    nulled = {n: F.when(~F.isnan(n), F.col(n)) for n, t in out.items() if t == "double"}
    return s.with_df(result.withColumns(nulled).select(*s.df.columns, *[n for n in names if n not in s.df.columns]))


def ema(s: Series, column: str, alpha: float | None = None, span: float | None = None, warmup: int = 0, min_samples: int = 0, output: str | None = None) -> Series:
    """Exponential average by row: starts at the first value present; a missing cell is missing
    but resets nothing.  ``min_samples`` masks until so many values were present, ``warmup``
    drops a partition's first rows."""
    a = alpha if alpha is not None else 2.0 / (span + 1.0)
    if not 0 < a <= 1:
        raise ValueError("alpha must be in (0, 1]")

    def step(state, part):
        y, seen = state
        x = part[column]
        out = np.full(len(x), np.nan)
        for i, v in enumerate(x.tolist()):
            if v == v:
                y = v if seen == 0 else a * v + (1 - a) * y
                seen += 1
                if seen >= min_samples:
                    out[i] = y
        return (y, seen), {output or column: out}

    done = fold(s, [column], {output or column: "double"}, lambda: (0.0, 0), step)
    return done.with_df(done.numbered().filter(F.col("__n") > warmup).drop("__n")) if warmup else done


def scan(s: Series, column: str, fn: Callable[[object, float], tuple[object, float]], init: object, output: str | None = None) -> Series:
    """mapAccumL: fn(state, value) gives the next state and the output; a missing cell repeats the output."""
    name = output or column

    def step(state, part):
        acc, last = state
        out = np.full(len(part[column]), np.nan)
        for i, v in enumerate(part[column].tolist()):
            if v == v:
                acc, last = fn(acc, v)
            out[i] = last
        return (acc, last), {name: out}

    return fold(s, [column], {name: "double"}, lambda: (init, float("nan")), step)


def cumulate(s: Series, column: str, fn: Callable[[float, float], float], output: str | None = None) -> Series:
    """A running value with the caller's own step; starts at the first value, carried over gaps."""
    return scan(s, column, lambda acc, v: (v, v) if acc is None else (lambda r: (r, r))(fn(acc, v)), None, output)


def loess(s: Series, column: str, span: float, missing: str = "bridge", output: str | None = None) -> Series:
    """Local linear fit with tricube weights over the nearest share ``span`` of a partition's values.

    Every point needs its neighbours by rank, so a whole partition is fitted in one task:
    its size is the caller's to bound.
    """
    if not 0 < span <= 1:
        raise ValueError("span must be in (0, 1]")
    name = output or column
    src = s.df.withColumn("__x", s.center.cast("double")).withColumn("__y", finite(F.col(column), s.types[column]).cast("double"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("__x", kind="stable")
        x, y = df["__x"].to_numpy(float), df["__y"].to_numpy(float)
        has = ~np.isnan(y)
        fit = local_linear(x, x[has], y[has], span)
        if missing == "skip":
            fit[~has] = np.nan
        df[name] = pd.Series(fit, index=df.index)
        return df.drop(columns=["__x", "__y"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in s.df.schema if f.name != name] + [f"`{name}` double"]
    src = src.drop(name) if name != column else src.drop(column)
    done = src.groupBy(*s.by).applyInPandas(run, ", ".join(fields)) if s.by else src.groupBy(F.lit("all")).applyInPandas(run, ", ".join(fields))
    done = done.withColumn(name, F.when(~F.isnan(name), F.col(name)))
    return s.with_df(done.select(*s.df.columns, *([name] if name not in s.df.columns else [])))


def local_linear(at: np.ndarray, x: np.ndarray, y: np.ndarray, span: float) -> np.ndarray:
    n = len(x)
    if n == 0:
        return np.full(len(at), np.nan)
    if n == 1:
        return np.full(len(at), y[0])
    k = max(2, min(n, int(np.ceil(span * n))))
    out = np.empty(len(at))
    start = 0
    for i, q in enumerate(at):  # both sorted, so the neighbourhood only moves right
        while start + k < n and q - x[start] > x[start + k] - q:
            start += 1
        dx, v = x[start : start + k] - q, y[start : start + k]
        reach = max(abs(dx[0]), abs(dx[-1]))
        if reach == 0:
            out[i] = y[x == q].mean()
            continue
        r = np.abs(dx) / reach
        w = np.where(r < 1, (1 - r**3) ** 3, 0.0)
        sw, swx, swy = w.sum(), (w * dx).sum(), (w * v).sum()
        if sw == 0:
            out[i] = np.nan
            continue
        swxx, swxy = (w * dx * dx).sum(), (w * dx * v).sum()
        den = sw * swxx - swx * swx
        out[i] = swy / sw if abs(den) < np.finfo(float).eps else (swy * swxx - swx * swxy) / den
    return out
