"""One registry of reducers for buckets, windows, bins, pivots, arrays and streams.

Missing is NULL, and NaN and infinities are missing to every built-in reducer.  Of nothing,
sum and count are 0, samples, unique and top are empty, everything else is NULL.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql.window import WindowSpec
from pyspark.sql import functions as F

Reducer = str | Callable[[Column], Column]
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
NAMES = ("count", "sum", "avg", "mean", "min", "max", "first", "last", "median", "stdev", "difference", "keep", "samples", "unique")


def finite(c: Column, dtype: str) -> Column:
    """Doubles with NaN and infinities taken as missing; other kinds as they are."""
    if dtype in ("float", "double"):
        return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)
    return c


def percentile_rank(name: str) -> float | None:
    m = re.fullmatch(r"p(\d+(?:\.\d+)?)", name)
    if m and 0 <= float(m[1]) <= 100:
        return float(m[1]) / 100
    return None


def top_size(name: str) -> int | None:
    m = re.fullmatch(r"top(\d+)", name)
    return int(m[1]) if m and int(m[1]) > 0 else None


def check(name: Reducer) -> None:
    if not callable(name) and name not in NAMES and percentile_rank(name) is None and top_size(name) is None:
        raise ValueError(f"unknown reducer: {name!r}")


def _flat(list_column: Column, dtype: str) -> Column:
    return F.flatten(list_column) if dtype.startswith("array") else list_column


def by_frequency(values: Column, n: int) -> Column:
    """The n most frequent of an array, ties in their natural order."""
    distinct = F.array_distinct(values)
    counted = F.transform(distinct, lambda v: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("c"), v.alias("v")))
    return F.transform(F.slice(F.array_sort(counted), 1, n), lambda s: s["v"])


def reduce(name: Reducer, col: Column, dtype: str, order: Column, window: WindowSpec | None = None) -> Column:
    """An aggregate of ``col``, over a window if one is given; ``order`` says which row is first."""
    over = (lambda a: a.over(window)) if window is not None else (lambda a: a)
    if callable(name):  # the user's own aggregate sees the cells as they are
        return over(name(col))
    check(name)
    c = finite(col, dtype)
    number = c.cast("double") if dtype in NUMERIC else c
    if name == "count":
        return over(F.count(c))
    if name == "sum":
        return F.coalesce(over(F.sum(number)), F.lit(0.0))
    if name in ("avg", "mean"):
        return over(F.avg(number))
    if name in ("min", "max"):
        return over(F.min(number) if name == "min" else F.max(number))
    if name in ("first", "last"):
        at = F.when(c.isNotNull(), order)
        return over(F.min_by(c, at) if name == "first" else F.max_by(c, at))
    if name == "stdev":
        return over(F.stddev_pop(number))
    if name == "difference":
        return over(F.max(number)) - over(F.min(number))
    if name == "keep":
        low = over(F.min(c))
        return F.when(low == over(F.max(c)), low)
    if name == "samples":
        rows = F.array_sort(over(F.collect_list(F.when(c.isNotNull(), F.struct(order.alias("o"), c.alias("v"))))))
        return _flat(F.transform(rows, lambda r: r["v"]), dtype)
    if name == "unique":
        return F.array_sort(F.array_distinct(F.flatten(over(F.collect_list(c)))) if dtype.startswith("array") else over(F.collect_set(c)))
    if name == "median":
        return over(F.percentile(number, F.lit(0.5)))
    q = percentile_rank(name)
    if q is not None:
        return over(F.percentile(number, F.lit(q)))
    return by_frequency(_flat(over(F.collect_list(c)), dtype), top_size(name))


def of_nothing(name: Reducer, col: Column) -> Column:
    """What a reducer gives where a left join found no row."""
    if name == "count":
        return F.coalesce(col, F.lit(0).cast("bigint"))
    if name == "sum":
        return F.coalesce(col, F.lit(0.0))
    if not callable(name) and (name in ("samples", "unique") or top_size(name)):
        return F.coalesce(col, F.array())
    return col


def reduce_array(name: str, col: Column, elem: str) -> Column:
    """A reducer over the cells of one array (not over rows)."""
    check(name)
    a = F.filter(col, lambda x: finite(x, elem).isNotNull())
    n = F.size(a)
    zero = F.lit(0.0)
    number = F.transform(a, lambda x: x.cast("double")) if elem in NUMERIC else a
    total = F.aggregate(number, zero, lambda s, x: s + x) if elem in NUMERIC else None
    if name == "count":
        return F.when(col.isNotNull(), n.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    if name == "sum":
        return F.coalesce(total, zero)
    if name in ("avg", "mean"):
        return F.when(n > 0, total / n)
    if name in ("min", "max"):
        return F.array_min(number) if name == "min" else F.array_max(number)
    if name in ("first", "last"):
        return F.when(n > 0, F.element_at(a, 1 if name == "first" else -1))
    if name == "difference":
        return F.array_max(number) - F.array_min(number)
    if name == "keep":
        return F.when(F.size(F.array_distinct(a)) == 1, F.element_at(a, 1))
    if name == "samples":
        return F.coalesce(a, F.array())
    if name == "unique":
        return F.coalesce(F.array_sort(F.array_distinct(a)), F.array())
    if name == "stdev":
        mean = total / n
        return F.when(n > 0, F.sqrt(F.aggregate(number, zero, lambda s, x: s + (x - mean) * (x - mean)) / n))
    q = 0.5 if name == "median" else percentile_rank(name)
    if q is not None:
        s = F.array_sort(number)
        at = F.lit(q) * (n - 1)
        lo = F.floor(at).cast("int")
        low, high = F.get(s, lo), F.get(s, F.ceil(at).cast("int"))
        return F.when(n > 0, low + (high - low) * (at - lo))
    return F.coalesce(by_frequency(a, top_size(name)), F.array())


@dataclass(frozen=True)
class Output:
    name: str
    source: str
    reducer: Reducer


def outputs(mapping: Mapping[str, Reducer | tuple[str, Reducer]], columns: list[str]) -> list[Output]:
    """{'cpu': 'avg'} or {'hot': ('cpu', 'p95')}; unknown columns and reducers are errors."""
    out = []
    for name, spec in mapping.items():
        source, reducer = spec if isinstance(spec, tuple) else (name, spec)
        if source not in columns:
            raise ValueError(f"unknown column: {source!r}")
        check(reducer)
        out.append(Output(name, source, reducer))
    return out
