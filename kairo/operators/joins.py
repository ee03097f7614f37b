"""Joins of series by key, as-of lookups, duplicates and pivots."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import in_order, join_on
from ..functions.reducers import Reducer, reduce
from ..series import MAX_GROUPS, Series

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def _ordinal(s: Series) -> DataFrame:
    w = Window.partitionBy(*s.by, *s.key).orderBy(s.seq or F.lit(0))
    return s.df.withColumn("__n", F.row_number().over(w))


def join(a: Series, b: Series, how: str = "outer", prefixes: tuple[str, str] | None = None) -> Series:
    """Merges on the whole key.  Rows of one key pair off in order: the first with the first,
    and so on, never each with each.  Names on both sides need prefixes."""
    if how not in HOW or a.kind != b.kind or a.by != b.by:
        raise ValueError("joins need a known type, keys of one kind and the same partitions")
    both = [c for c in a.values if c in b.values]
    if both and not prefixes:
        raise ValueError(f"both sides have {both}")
    on = [*a.by, *a.key, "__n"]
    right = b.df
    for x, y in zip(b.key, a.key, strict=True):
        right = right.withColumnRenamed(x, y)
    b = Series(right, b.kind, a.key, b.by, b.seq)
    left, right = _ordinal(a).drop(*([a.seq] if a.seq else [])), _ordinal(b).drop(*([b.seq] if b.seq else []))
    for c in both:
        left, right = left.withColumnRenamed(c, f"{prefixes[0]}_{c}"), right.withColumnRenamed(c, f"{prefixes[1]}_{c}")
    out = join_on(left, right, on, HOW[how])
    return Series(out.withColumnRenamed("__n", "__seq"), a.kind, a.key, a.by, "__seq")


def join_many(series: list[Series], how: str = "outer", prefixes: list[str] | None = None) -> Series:
    """A left fold of join."""
    if prefixes:
        shared = {c for i, s in enumerate(series) for c in s.values if any(c in o.values for j, o in enumerate(series) if j != i)}
        series = [s.rename({c: f"{p}_{c}" for c in s.values if c in shared}) for s, p in zip(series, prefixes, strict=True)]
    return fold(lambda x, y: join(x, y, how), series)


def as_of(left: DataFrame, at: Column, right: Series, by: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Each left row with the last right row at or before ``at`` (all columns null if none).

    The sides are merged into one ordered run and read once (see Series.dealt, of the right
    side, for long partitions); nothing is compared pairwise.  Names on both sides need a
    ``prefix`` for the right one's.
    """
    by = by if by is not None else list(right.by)
    cols = right.values
    both = [c for c in cols if c in left.columns]
    if both and not prefix:
        raise ValueError(f"both sides have {both}")
    l_ = left.withColumn("__t", at).select("__t", F.struct(*left.columns).alias("l"), *by)
    r = right.df.select(right.at.alias("__t"), *by, F.struct(*cols).alias("r"), *([F.col(right.seq).alias("__s")] if right.seq else [F.lit(0).alias("__s")]))
    run = r.select("__t", *by, "__s", F.lit(0).alias("__p"), F.lit(None).cast(l_.schema["l"].dataType).alias("l"), "r").unionByName(
        l_.select("__t", *by, F.lit(None).cast(r.schema["__s"].dataType).alias("__s"), F.lit(1).alias("__p"), "l", F.lit(None).cast(r.schema["r"].dataType).alias("r"))
    )
    stretch = right.stretch_of(F.col("__t"), by)
    run = in_order(run, by, [F.col(c) for c in ("__t", "__p", "__s")], stretch, {"__seen": F.col("r")})
    return run.filter("__p = 1").select("l.*", *[F.col(f"__seen.{c}").alias(f"{prefix}_{c}" if c in both else c) for c in cols])


#: Rows and spans meet by equality on cells of this many microseconds (a day).
CELL = 86_400_000_000


def interval_join(rows: DataFrame, at: Column, spans: DataFrame, begin: Column, end: Column, right_closed: bool = False, how: str = "left", cell: int = CELL) -> DataFrame:
    """Rows with the span that holds ``at``: [begin, end), or (begin, end].  Spans must not overlap.

    A span is listed under each cell that it touches and a row under its own, so the join
    is an equality that can be shuffled or broadcast, and rows are never multiplied.
    """
    right = spans.withColumn("__cell", F.explode(F.sequence(F.floor(begin / F.lit(cell)), F.floor(end / F.lit(cell)))))
    left = rows.withColumn("__at", at).withColumn("__cell", F.floor(F.col("__at") / F.lit(cell)))
    t = left["__at"]
    inside = ((t > begin) & (t <= end)) if right_closed else ((t >= begin) & (t < end))
    return left.join(right, (left["__cell"] == right["__cell"]) & inside, how).select(*[left[c] for c in rows.columns], *[right[c] for c in spans.columns])


def dedupe(s: Series, keep: str | Mapping[str, object] | Callable[[Column], Column] = "last") -> Series:
    """Of rows with one whole key: 'first', 'last', none ('drop'), an error ('error'), the row
    least or greatest in a column ({'min': c}, {'max': c}; missing loses, ties go to the
    first), a reduction ({'merge': {column: reducer}}), or what a resolver makes of them: a
    function from the rows, an array of structs in order, to one struct.  Fields that it
    leaves out are those of the last row."""
    part = [*s.by, *s.key]
    order = F.col(s.seq) if s.seq else F.lit(0)
    if keep == "drop":
        n = F.count(F.lit(1)).over(Window.partitionBy(*part))
        return s.with_df(s.df.withColumn("__c", n).filter("__c = 1").drop("__c"))
    if keep == "error":
        if s.df.groupBy(*part).count().filter("count > 1").limit(1).count():
            raise ValueError("duplicate keys")
        return s
    if callable(keep):
        cells = [*s.values, *([s.seq] if s.seq else [])]
        rows = F.array_sort(F.collect_list(F.struct(s.order.alias("__o"), *cells)))
        rows = F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in cells]))
        got = s.df.groupBy(*part).agg(rows.alias("__rows")).withColumn("__one", keep(F.col("__rows")))
        made = [f.name for f in got.schema["__one"].dataType.fields]
        unknown = set(made) - set(s.values)
        if unknown:
            raise ValueError(f"a resolver gives values only, not {sorted(unknown)}")
        last = F.element_at("__rows", -1)
        one = {c: F.when(F.size("__rows") > 1, F.col("__one")[c]).otherwise(last[c]).cast(s.types[c]) if c in made else last[c] for c in cells}
        return s.with_df(got.select(*part, *[v.alias(c) for c, v in one.items()]).select(*s.df.columns))
    if isinstance(keep, Mapping) and "merge" in keep:
        row = s.order
        aggs = [reduce(keep["merge"].get(c, "last"), F.col(c), s.types[c], row).alias(c) for c in s.values]
        extra = [F.min(s.seq).alias(s.seq)] if s.seq else []
        return s.with_df(s.df.groupBy(*part).agg(*aggs, *extra).select(*s.df.columns))
    if isinstance(keep, Mapping):
        (fn, c), = keep.items()
        first = [F.col(c).asc_nulls_last() if fn == "min" else F.col(c).desc_nulls_last(), order]
    elif keep in ("first", "last"):
        first = [order if keep == "first" else order.desc()]
    else:
        raise ValueError(f"not a policy: {keep!r}")
    n = F.row_number().over(Window.partitionBy(*part).orderBy(*first))
    return s.with_df(s.df.withColumn("__n", n).filter("__n = 1").drop("__n"))


def pivot_by_group(s: Series, group: str, value: str, groups: list | None = None, aggregate: Reducer | None = None) -> Series:
    """Long to wide: a column ``{group}_{value}`` for each group, in order of name unless declared.

    A cell of one row keeps its value; several need an aggregate, else the query fails.
    """
    text = F.coalesce(F.col(group).cast("string"), F.lit("undefined"))
    if groups is None:  # the only place where data name columns; this is an action
        groups = [r[0] for r in s.df.select(text.alias("g")).distinct().orderBy("g").limit(MAX_GROUPS + 1).collect()]
        if len(groups) > MAX_GROUPS:
            raise ValueError(f"more than {MAX_GROUPS} groups for columns")
    names = [str(g) for g in groups]
    key = [c for c in (*s.by, *s.key) if c != group]

    def cell(g: str) -> Column:
        mine = text == g
        one = F.min_by(F.when(mine, F.col(value)), F.when(mine, s.order))
        many = F.count(F.when(mine, F.lit(1)))
        if aggregate is None:
            rest = F.raise_error(F.lit(f"several rows of {g!r} at one key need an aggregate"))
            return F.when(many <= 1, one).otherwise(rest.cast(s.types[value])).alias(f"{g}_{value}")
        return F.when(many <= 1, one.cast("double") if s.is_number(value) else one).otherwise(reduce(aggregate, F.when(mine, F.col(value)), s.types[value], s.order)).alias(f"{g}_{value}")

    return Series(s.df.groupBy(*key).agg(*[cell(g) for g in names]), s.kind, s.key, tuple(c for c in s.by if c != group))


def group_by(s: Series, column: str, fn: Callable[[Series], object] | None = None) -> dict:
    """A lazy series for each value of a column, by name."""
    got = Series(s.df, s.kind, s.key, (column,), s.seq).to_map(fn)
    return {"undefined" if k is None else str(k): v for k, v in got.items()}
