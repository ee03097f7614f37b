"""Array columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.reducers import reduce_array
from ..series import Series


def contains(s: Series, column: str, value) -> Series:
    return s.filter(F.array_contains(column, F.lit(value)))


def contains_all(s: Series, column: str, values: list) -> Series:
    """No values keep every row that has an array."""
    if not values:
        return s.filter(F.col(column).isNotNull())
    return s.filter(F.col(column).isNotNull() & (F.size(F.array_except(F.array(*map(F.lit, values)), F.col(column))) == 0))


def contains_any(s: Series, column: str, values: list) -> Series:
    """No values keep none."""
    if not values:
        return s.filter(F.lit(False))
    return s.filter(F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))), F.lit(False)))


def aggregate(s: Series, column: str, reducer: str, out: str | None = None) -> Series:
    elem = s.types[column].removeprefix("array<").removesuffix(">")
    return s.with_df(s.df.withColumn(out or column, reduce_array(reducer, F.col(column), elem)))


def explode(s: Series, column: str, out: str | None = None) -> Series:
    """A row per element; empty and missing arrays give none."""
    name = out or column
    df = s.df.withColumn("__e", F.explode(column))
    if not out:
        df = df.drop(column)
    return s.with_df(df.withColumnRenamed("__e", name))
