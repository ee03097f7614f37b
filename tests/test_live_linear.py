"""Live windows: rows come in and leave in bulk, with what they gave row by row; shared clocks see only rows they need."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairo.streaming import live

SCHEMA = T.StructType([T.StructField("t", T.TimestampType()), T.StructField("k", T.StringType()), T.StructField("v", T.DoubleType())])


def bound(step, by=("k",)):
    return step.bound(SimpleNamespace(time="t", by=by, grace=None, expire=None), SimpleNamespace(schema=SCHEMA))


def batches(seed: int, n: int = 200):
    rng = np.random.default_rng(seed)
    t = pd.to_datetime(np.cumsum(rng.integers(0, 4, n)) * 10**9 - rng.integers(0, 2, n) * rng.integers(0, 15, n) * 10**9)
    rows = pd.DataFrame({"t": t, "k": rng.choice(["a", "b", "c"], n), "v": rng.integers(0, 9, n).astype(float)})
    return [b.sort_values("t", kind="stable").reset_index(drop=True) for b in np.array_split(rows, 4)]


def row_by_row(seed, synced, clock, width):
    """What a clock reports, by its definition: each row looks at all that came before it."""
    out, seen, cell = [], [], None
    for rows in batches(seed):
        for t, k, v in rows.itertuples(index=False):
            u = t.value // 1000
            if cell is not None and u // clock > cell:
                stamp = u // clock * clock
                top = {x: max(s[0] for s in seen if s[1] == x) for x in {s[1] for s in seen}}
                for x in sorted(top) if synced else [k] if k in top else []:
                    held = [s for s in seen if s[1] == x and s[0] >= max(stamp, top[x]) - width]
                    if held or synced:
                        out.append((x, stamp, float(len(held)), float(sum(s[2] for s in held))))
            cell = u // clock if cell is None else max(cell, u // clock)
            seen.append((u, k, v))
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("width", ["7s", "25s"])
def test_synced_clock(seed, width):
    step = bound(live.Rolling({width: {"n": ("v", "count"), "s": ("v", "sum")}}, live.Trigger.clock("20s"), synced=True))
    state, got = step.start(), []
    for rows in batches(seed):
        got += [(r.k, r.t.value // 1000, r.n, r.s) for r in step.take(state, rows).itertuples()]
    assert got == row_by_row(seed, True, 20_000_000, int(width[:-1]) * 10**6)


def test_a_long_run_of_rows_is_linear():
    n = 200_000
    step = bound(live.Rolling({"7d": {"n": ("v", "count")}}, live.Trigger.clock("1d"), synced=True))
    rows = pd.DataFrame({"t": pd.to_datetime(np.arange(n) * 10**9), "k": "a", "v": 1.0})
    looked = []
    evict = step._evict
    step._evict = lambda buf, now: (looked.append(len(buf)), evict(buf, now))[1]
    out = step.take(step.start(), rows)
    assert out["n"].tolist() == [86_400.0, 172_800.0]
    assert sum(looked) < 4 * n  # row by row it was half of n squared


def test_only_rows_that_a_report_can_see_come_to_the_clock(spark):
    df = spark.range(10_000).select(F.timestamp_micros(F.col("id") * 60_000_000).alias("t"), F.concat(F.lit("k"), F.col("id") % 2).alias("k"), F.lit(1.0).alias("v"), F.col("id"))
    step = live.Rolling({"2h": {"n": ("v", "count")}}, live.Trigger.clock("1d"), synced=True)
    step.bound(SimpleNamespace(time="t", by=("k",), grace=None, expire=None), df)
    rows = step.narrowed(df, "id").toPandas().sort_values(["t", "id"]).reset_index(drop=True)
    whole = df.toPandas().sort_values(["t", "id"]).reset_index(drop=True)
    assert len(rows) < 2_000
    assert step.take(step.start(), rows).equals(step.take(step.start(), whole))
