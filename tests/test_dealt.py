"""Series without partitions are dealt, so that no task has all their rows; the results are those of one read."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairo import queries as Q
from kairo.finance import sessions, studies
from kairo.operators import aggregate as agg
from kairo.operators import grid, joins
from kairo.series import Series

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def alone(spark, n: int = 400) -> tuple[Series, list[float]]:
    rng = np.random.default_rng(2)
    x = [float(v) for v in rng.integers(0, 9, n)]
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=int(7 * i + 300 * (i // 50))), x[i]) for i in range(n)]
    return Series.of(spark.createDataFrame(rows, "id bigint, t timestamp_ntz, x double").repartition(4), time="t", seq="id"), x


def test_studies_of_a_series_without_partitions(spark):
    s, x = alone(spark)
    got = studies.sma(s, 5, "x", "mean")
    got = studies.rolling_stat(got, 4, "p25", "x", "low")
    got = studies.z_score(studies.bollinger(got, 6, source="x"), 7, "x")
    assert "mapInArrow" in plan_of(got.df) or "MapInArrow" in plan_of(got.df)
    rows = {r.id: r for r in got.df.collect()}
    assert len(rows) == len(x) and set(got.df.columns) == {"id", "t", "x", "mean", "low", "middle", "upper", "lower", "z"}
    for i in range(len(x)):
        near = lambda k: np.array(x[i - k + 1 : i + 1]) if i >= k - 1 else None  # noqa: B023, E731
        for name, k, f in (("mean", 5, np.mean), ("low", 4, lambda w: np.quantile(w, 0.25)), ("middle", 6, np.mean), ("upper", 6, lambda w: w.mean() + 2 * w.std() if w.std() else None), ("z", 7, lambda w: (w[-1] - w.mean()) / w.std() if w.std() else None)):
            w = near(k)
            want = None if w is None else f(w)
            assert rows[i][name] == (None if want is None else pytest.approx(want, abs=1e-9)), (i, name)


def test_reads_in_order_of_a_series_without_partitions(spark):
    s, x = alone(spark)
    df = s.ordered(number="n", running={"total": ("sum", F.col("x"))})
    assert "__stretch" in plan_of(df)
    assert [(r.n, r.total) for r in df.orderBy("id").collect()] == [(i + 1, sum(x[: i + 1])) for i in range(len(x))]
    held = agg.align(s, grid.hourly())
    assert "__stretch" in plan_of(held.df)
    right = Series.of(s.df.select("t", "id", F.col("id").alias("k")), time="t", seq="id")
    left = spark.range(60).select((F.col("id") * 3_600_000_000 + 1_704_067_200_000_000).alias("at"))
    met = joins.as_of(left, F.col("at"), right, [])
    assert "__stretch" in plan_of(met)
    times = [7 * i + 300 * (i // 50) for i in range(len(x))]
    assert sorted((r["at"], r.k) for r in met.collect()) == [(1_704_067_200_000_000 + h * 3_600_000_000, max(i for i, m in enumerate(times) if m <= 60 * h)) for h in range(60)]
    assert {r.label: r.x for r in held.df.collect()}[1704067200000 + 3600000 * 20] == x[max(i for i, m in enumerate(times) if m <= 1200)]


def test_queries_of_few_partitions_are_dealt(spark):
    for name in ("fills", "fills_others", "cumulatives", "grid_centers"):
        assert "__stretch" in plan_of(Q.queries()[name](spark, SF)), name


def test_open_time_moves_no_rows(spark):
    axis = sessions.Axis(((10, 20), (30, 50), (60, 61)))
    df = spark.createDataFrame([(t,) for t in (5, 10, 19, 20, 25, 30, 45, 55, 60, 99, None)], "at bigint")
    s = Series.of(df.withColumn("t", F.timestamp_micros("at").cast("timestamp_ntz")), time="t")
    out = axis.compress(s, "open")
    assert "Window" not in plan_of(out.df) and "Join" not in plan_of(out.df)
    assert {r["at"]: r.open for r in out.df.collect()} == {5: 0, 10: 0, 19: 9, 20: 10, 25: 10, 30: 10, 45: 25, 55: 30, 60: 30, 99: 31, None: 0}
