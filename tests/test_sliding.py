"""Sliding windows in linear time: the kernel against its definition, and that range windows use it."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairo.functions import sliding
from kairo.operators import windows
from kairo.series import Series

WAYS = {
    "sums": (lambda x, lo, hi: sliding.sums(x, lo, hi), lambda w: w.sum()),
    "least": (sliding.least, np.min),
    "greatest": (sliding.greatest, np.max),
    "deviations": (sliding.deviations, np.std),
    "p90": (lambda x, lo, hi: sliding.percentiles(x, lo, hi, 0.9), lambda w: np.quantile(w, 0.9)),
}


@pytest.mark.parametrize("name", WAYS)
def test_kernel(name):
    fast, slow = WAYS[name]
    rng = np.random.default_rng(3)
    for trial in range(60):
        n = int(rng.integers(1, 70))
        group = np.sort(rng.integers(0, 4, n))
        at = np.concatenate([np.sort(rng.integers(0, 25, (group == g).sum())) for g in range(4)]).astype(float)
        x = rng.choice([1.0, 2.5, 100.0, np.nan], n) if trial % 2 else 1e6 + rng.normal(0, 1, n)
        back, ahead = rng.integers(0, 7, 2)
        rows = np.flatnonzero(rng.random(n) < 0.8)
        got = fast(x, *sliding.edges(group, at, back, ahead, rows))
        for i, r in enumerate(rows):
            w = x[(group == group[r]) & (at >= at[r] - back) & (at <= at[r] + ahead)]
            w = w[~np.isnan(w)]
            want = slow(w) if len(w) else 0.0 if name == "sums" else np.nan
            assert float(got[i]) == pytest.approx(want, rel=1e-9, abs=1e-9, nan_ok=True)
            if name == "deviations" and len(set(w)) == 1:
                assert got[i] == 0.0


def rows_of(n: int) -> list[tuple]:
    rng = np.random.default_rng(5)
    at = [datetime(2024, 1, 1) + timedelta(seconds=int(t)) for t in rng.integers(0, 900, n)]
    at[3] = None
    number = lambda i: None if i % 7 == 0 else float("nan") if i % 11 == 0 else float(rng.integers(0, 9))
    return [(i, at[i], None if i % 3 == 0 else f"g{i % 3}", number(i), None if i % 5 == 0 else f"w{i * 7 % 13}") for i in range(n)]


@pytest.mark.parametrize("alignment", ["trailing", "leading", "centered"])
def test_range_windows_do_not_go_over_each_window(spark, alignment, monkeypatch):
    monkeypatch.setattr(windows, "TOGETHER", 1)  # as many reads as can be
    rows = rows_of(300)
    s = Series.of(spark.createDataFrame(rows, "id bigint, t timestamp_ntz, g string, x double, word string").repartition(3), time="t", seq="id").partition_by("g")
    ways = {"n": "count", "total": "sum", "mean": "avg", "low": "min", "high": "max", "mid": "median", "sd": "stdev", "spread": "difference"}
    words = {"head": "first", "tail": "last", "least": "min", "most": "max", "same": "keep", "words": "count"}
    mapping = {k: ("x", v) for k, v in ways.items()} | {k: ("word", v) for k, v in words.items()}
    out = windows.rolling(s, "90s", mapping, alignment)
    assert "RangeFrame" not in out.df._jdf.queryExecution().toString()
    back, ahead = windows.frame_of(90_000_000, alignment)
    got = {r["id"]: r for r in out.df.collect()}
    assert len(got) == 300
    us = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    for i, t, g, _, _ in rows:
        near = sorted((us(b), j, x, w) for j, b, h, x, w in rows if t and b and h == g and us(t) - back <= us(b) <= us(t) + ahead)
        x = np.array([r[2] for r in near if r[2] is not None and r[2] == r[2]])
        w = [r[3] for r in near if r[3] is not None]
        some, any_ = (lambda f: float(f(x)) if len(x) else None), (lambda f: f(w) if w else None)  # noqa: B023
        want = {"n": len(x), "total": float(x.sum()), "mean": some(np.mean), "low": some(np.min), "high": some(np.max), "mid": some(np.median), "sd": some(np.std), "spread": some(np.ptp)}
        want |= {"head": any_(lambda v: v[0]), "tail": any_(lambda v: v[-1]), "least": any_(min), "most": any_(max), "same": w[0] if len(set(w)) == 1 else None, "words": len(w)}
        for c, v in want.items():
            assert got[i][c] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), (i, c)


def test_lists_and_nan_places(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.4), (3, 5.0), (4, float("nan")), (5, float("nan")), (6, None), (7, float("inf"))], "id bigint, v double")
    s = Series.of(df.withColumn("t", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")), time="t", seq="id")
    out = windows.rolling_by_column(s, "v", 0.5, {"n": ("v", "count"), "all": ("v", "samples"), "firsts": ("v", "first"), "rows": ("v", F.count)})
    got = {r.id: (r.n, r.all, r.firsts, r.rows) for r in out.collect()}
    assert got[1] == got[2] == (2, [0.0, 0.4], 0.0, 2) and got[3] == (1, [5.0], 5.0, 1)
    assert got[4] == got[5] == (0, [], None, 2) and got[7][0] == 0
    assert got[6][0] == 0


def test_a_wide_window_costs_no_more_than_a_narrow_one(spark):
    n = 60_000
    df = spark.range(n).select("id", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id / 1000.0)").alias("t"), (F.col("id") % 97).cast("double").alias("x"))
    out = windows.rolling_fused(Series.of(df, time="t", seq="id"), {"1h": {"mean": ("x", "avg")}, "2h": {"p90": ("x", "p90")}}).df  # each holds all rows before it
    assert "RangeFrame" not in out._jdf.queryExecution().toString()
    last = out.filter(F.col("id") == n - 1).first()
    assert last["mean"] == pytest.approx(sum(i % 97 for i in range(n)) / n) and last["p90"] == pytest.approx(np.quantile([i % 97 for i in range(n)], 0.9))
