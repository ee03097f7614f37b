"""DataFrame helpers: joins that match null keys, and reads of an order dealt in stretches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equality join on columns that both sides have, where null matches null.

    The keys are there once, left's other columns before right's.  Spark plans <=> as a
    hashed key like =, so this shuffles or broadcasts as any equality join does.
    """
    names = {c: f"__r_{i}" for i, c in enumerate(right.columns)}
    named = right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    on = F.lit(True)
    for c in keys:
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(names[c]))
    out = left.join(named, on, how)
    if how in ("left_semi", "left_anti"):
        return out
    own = lambda c: F.coalesce(F.col(f"`{c}`"), F.col(names[c])).alias(c) if c in keys and how in ("right", "full") else F.col(f"`{c}`")
    return out.select(*[own(c) for c in left.columns], *[F.col(names[c]).alias(c) for c in right.columns if c not in keys])


#: Running reductions: how a stretch is read and how what came before it comes in.
RUNNING = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def in_order(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    stretch: Column | None = None,
    back: Mapping[str, Column] | None = None,
    ahead: Mapping[str, Column] | None = None,
    running: Mapping[str, tuple[str, Column]] | None = None,
    whole: Mapping[str, tuple[str, Column]] | None = None,
    number: str | None = None,
) -> DataFrame:
    """Adds what each row sees of its partition in order, in time linear in the rows.

    ``back`` has for each name the last value that isn't null at the row or before it,
    ``ahead`` the first at it or after it; ``running`` a sum, count, max or min up to the row,
    ``whole`` one of all rows; ``number`` is its place from 1.

    Without ``stretch`` a partition is read by one task.  ``stretch`` (a number that ascends
    with the order) deals it into as many groups as that has values: each is read on its own,
    one line of each comes together per partition to carry over what its neighbours saw, and
    the lines go back by an equality join.  The frame is then read twice.
    """
    back, ahead, running, whole = dict(back or {}), dict(ahead or {}), dict(running or {}), dict(whole or {})
    cut = "__stretch"
    if stretch is not None:
        df = df.withColumn(cut, stretch)
    part = [*by, *([cut] if stretch is not None else [])]
    w = Window.partitionBy(*part).orderBy(*order)
    till = w.rowsBetween(Window.unboundedPreceding, 0)
    cols = {n: F.last(c, ignorenulls=True).over(till) for n, c in back.items()}
    cols |= {n: RUNNING[how][0](c).over(till) for n, (how, c) in running.items()}
    out = df.withColumns({"__i": F.row_number().over(w).cast("bigint"), **cols})
    if ahead:  # the same order from its end: a frame that grows, never one that shrinks
        rest = Window.partitionBy(*part).orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({n: F.last(c, ignorenulls=True).over(rest) for n, c in ahead.items()})
    if stretch is None:
        if whole:
            out = out.withColumns({n: RUNNING[how][0](c).over(Window.partitionBy(*by)) for n, (how, c) in whole.items()})
        return out.withColumnRenamed("__i", number) if number else out.drop("__i")
    line = [F.count(F.lit(1)).alias("__n")]
    line += [F.max_by(c, F.when(c.isNotNull(), F.struct(*order))).alias(f"__b_{n}") for n, c in back.items()]
    line += [F.min_by(c, F.when(c.isNotNull(), F.struct(*order))).alias(f"__a_{n}") for n, c in ahead.items()]
    line += [RUNNING[how][0](c).alias(f"__c_{n}") for n, (how, c) in running.items()]
    line += [RUNNING[how][0](c).alias(f"__w_{n}") for n, (how, c) in whole.items()]
    lines = df.groupBy(*part).agg(*line)
    up = Window.partitionBy(*by).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*by).orderBy(F.desc(cut)).rowsBetween(Window.unboundedPreceding, -1)
    carry = {"__before": F.coalesce(F.sum("__n").over(up), F.lit(0))}
    carry |= {f"__w_{n}": RUNNING["sum" if how == "count" else how][0](f"__w_{n}").over(Window.partitionBy(*by)) for n, (how, _) in whole.items()}
    carry |= {f"__b_{n}": F.last(f"__b_{n}", ignorenulls=True).over(up) for n in back}
    carry |= {f"__a_{n}": F.last(f"__a_{n}", ignorenulls=True).over(down) for n in ahead}
    carry |= {f"__c_{n}": RUNNING["sum" if how == "count" else how][0](f"__c_{n}").over(up) for n, (how, _) in running.items()}
    out = join_on(out, lines.withColumns(carry).drop("__n"), part)
    out = out.withColumns(
        {n: F.coalesce(F.col(n), F.col(f"__b_{n}")) for n in back}
        | {n: F.coalesce(F.col(n), F.col(f"__a_{n}")) for n in ahead}
        | {n: RUNNING[how][1](F.col(n), F.col(f"__c_{n}")) for n, (how, _) in running.items()}
        | ({number: F.col("__i") + F.col("__before")} if number else {})
        | {n: F.col(f"__w_{n}") for n in whole}
    )
    return out.drop(cut, "__i", "__before", *[f"__{x}_{n}" for x, names in (("b", back), ("a", ahead), ("c", running), ("w", whole)) for n in names])
