"""Small hand-made cases for the rules that a naive translation gets wrong."""

from __future__ import annotations

from datetime import date, datetime, time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairo.activity import track
from kairo.finance import sessions, studies
from kairo.functions.reducers import reduce_array
from kairo.functions.time import duration_us
from kairo.operators import aggregate as agg
from kairo.operators import arrays, columns, folds, gaps, grid, joins, windows
from kairo.plans import builder, plan
from kairo.series import Series
from kairo.sources import tables
from kairo.streaming import live


def ms(n: float) -> datetime:
    from datetime import timedelta

    return datetime(1970, 1, 1) + timedelta(milliseconds=n)


def points(spark, rows, **cols):
    schema = {"time": "time", **(cols or {"value": "number"})}
    return tables.from_rows(spark, [(ms(r[0]), *r[1:]) for r in rows], schema)


def vals(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_durations():
    assert [duration_us(x) for x in ("250ms", "1s", "2m", "3h", "1d", 5)] == [250_000, 10**6, 12 * 10**7, 3 * 36 * 10**8, 864 * 10**8, 5000]
    for bad in ("1w", "0s", "-1s", "1.5h", 0):
        with pytest.raises(ValueError):
            duration_us(bad)


def test_aggregate_on_grid(spark):
    s = points(spark, [(0, 1.0), (5, 2.0), (10, 3.0), (15, 4.0), (20, 5.0)])
    out = agg.aggregate(s, grid.every(10), {"value": "avg"}).df.orderBy("begin")
    assert vals(out, "label", "value") == [(0, 1.5), (10, 3.5), (20, 5.0)]


def test_leading_partial_bucket_is_dropped_and_empty_ones_are_there(spark):
    s = points(spark, [(3, 1.0), (12, 2.0), (31, 3.0)])
    out = agg.aggregate(s, grid.every(10), {"n": ("value", "count"), "t": ("value", "sum"), "m": ("value", "avg"), "u": ("value", "unique")}).df.orderBy("begin")
    assert vals(out, "label", "n", "t", "m", "u") == [(10, 1, 2.0, 2.0, [2.0]), (20, 0, 0.0, None, []), (30, 1, 3.0, 3.0, [3.0])]


def test_partitions_have_their_own_range(spark):
    s = points(spark, [(0, 1.0, "a"), (10, 1.0, "a"), (20, 1.0, "b"), (40, 1.0, "b"), (50, 9.0, None)], value="number", host="string").partition_by("host")
    out = agg.aggregate(s, grid.every(10), {"n": ("value", "count")}).df.orderBy("host", "begin")
    assert vals(out, "host", "label", "n") == [(None, 50, 1), ("a", 0, 1), ("a", 10, 1), ("b", 20, 1), ("b", 30, 0), ("b", 40, 1)]


def test_end_sample_is_left_exclusive(spark):
    s = points(spark, [(10, 1.0), (30, 2.0)])
    out = agg.aggregate(s, grid.every(10), {"n": ("value", "count")}, sample="end").df.orderBy("begin")
    assert vals(out, "label") == [(10,), (20,)]


def test_ranged_keys_are_in_every_bucket_they_overlap(spark):
    rows = [(ms(0), ms(10), "a", 1.0), (ms(10), ms(18), "b", 1.0), (ms(18), ms(22), "c", 1.0)]
    s = tables.from_rows(spark, rows, {"begin": "time", "end": "time", "label": "string", "value": "number"}, begin="begin", end="end", label="label")
    out = agg.aggregate(s, grid.every(10), {"n": ("value", "count")}).df.orderBy("begin")
    assert vals(out, "n") == [(1,), (2,), (1,)]


def test_explicit_buckets(spark):
    day = 86_400_000
    spans = [(ms(0), ms(day // 2)), (ms(day // 2), ms(3 * day)), (ms(3 * day), ms(4 * day))]
    rows = [(ms(0), ms(day // 2), "a", 1.0), (ms(day), ms(3 * day + 5), "b", 1.0), (ms(day // 4), ms(day), "c", 1.0)]
    s = tables.from_rows(spark, rows, {"begin": "time", "end": "time", "label": "string", "value": "number"}, begin="begin", end="end", label="label")
    assert vals(agg.aggregate(s, grid.bounded(spans), {"n": ("value", "count")}).df.orderBy("begin"), "n") == [(2,), (2,), (1,)]
    p = points(spark, [(0, 1.0), (day // 2, 1.0), (4 * day, 1.0)])
    assert vals(agg.aggregate(p, grid.bounded(spans), {"n": ("value", "count")}).df.orderBy("begin"), "n") == [(1,), (1,), (0,)]


def test_calendar_days_across_a_change_of_the_clock(spark):
    s = tables.from_rows(spark, [(datetime(2024, 3, 9, 5), 1.0), (datetime(2024, 3, 11, 5), 1.0)], {"time": "time", "value": "number"})
    out = agg.aggregate(s, grid.calendar("day", "America/New_York"), {"n": ("value", "count")}).df.orderBy("begin")
    assert [r[0] for r in vals(out, "label")] == [1709960400000, 1710046800000, 1710129600000]


def test_non_finite_is_missing_and_deviation_is_stable(spark):
    rows = [(float(i), 1e10 + i) for i in range(4)] + [(9.0, float("nan")), (10.0, float("inf"))]
    out = agg.reduce_all(points(spark, rows), {"sd": ("value", "stdev"), "n": ("value", "count"), "top": ("value", "max")}).first()
    assert abs(out.sd - np.std([0, 1, 2, 3])) < 1e-6 and out.n == 4 and out.top == 1e10 + 3


def test_reducers_of_nothing(spark):
    out = agg.reduce_all(points(spark, [(0, None)]), {r: ("value", r) for r in ("count", "sum", "avg", "min", "median", "p90", "stdev", "difference", "keep", "first", "unique", "samples", "top3")}).first()
    assert (out["count"], out["sum"], out["unique"], out["samples"], out["top3"]) == (0, 0.0, [], [], [])
    assert all(out[c] is None for c in ("avg", "min", "median", "p90", "stdev", "difference", "keep", "first"))


def test_window_ends_and_ties(spark):
    s = points(spark, [(0, 1.0), (10, 2.0), (10, 4.0), (20, 8.0)])
    out = windows.rolling(s, 10, {"value": "sum"}).df.orderBy("time", "__seq")
    assert [r[0] for r in vals(out, "value")] == [1.0, 6.0, 6.0, 8.0]  # a row exactly one window old is out
    out = windows.rolling(s, 10, {"value": "sum"}, "leading").df.orderBy("time", "__seq")
    assert [r[0] for r in vals(out, "value")] == [1.0, 6.0, 6.0, 8.0]
    out = windows.rolling(s, None, {"value": "sum"}, count=2).df.orderBy("time", "__seq")
    assert [r[0] for r in vals(out, "value")] == [1.0, 3.0, 6.0, 12.0]
    out = windows.rolling(s, 10, {"value": "avg"}, min_samples=2).df.orderBy("time", "__seq")
    assert [r[0] for r in vals(out, "value")] == [None, 3.0, 3.0, None]


def test_rolling_agrees_with_plain_python(spark):
    rng = np.random.default_rng(3)
    t = np.sort(rng.integers(0, 5000, 300)).tolist()
    x = rng.normal(size=300).tolist()
    s = points(spark, list(zip(map(float, t), x, strict=True)))
    got = [r[0] for r in vals(windows.rolling(s, 97, {"value": "p75"}).df.orderBy("time", "__seq"), "value")]
    want = [float(np.quantile([v for u, v in zip(t, x, strict=True) if a - 97 < u <= a], 0.75)) for a in t]
    assert np.allclose(got, want)


def test_differences(spark):
    s = points(spark, [(0, 1.0), (1000, 3.0), (2000, None), (3000, 0.0), (3000, 5.0)])
    o = lambda x, c="value": [r[0] for r in vals(x.df.orderBy("time", "__seq"), c)]
    assert o(windows.diff(s, "value")) == [None, 2.0, None, None, 5.0]
    assert o(windows.rate(s, "value")) == [None, 2.0, None, None, None]
    assert o(windows.pct_change(s, "value")) == [None, 2.0, None, None, None]
    assert o(windows.diff(s, "value", drop=True)) == [2.0, None, None, 5.0]
    assert o(windows.shift(s, -1, "value")) == [3.0, None, 0.0, 5.0, None]
    assert o(windows.cumulative(s, {"value": "count"})) == [1.0, 2.0, 2.0, 3.0, 4.0]


def test_gaps_are_filled_whole_or_not_at_all(spark):
    s = points(spark, [(0, None), (10, 1.0), (20, None), (30, 3.0), (40, None), (50, None), (60, 6.0), (70, None)])
    o = lambda x: [r[0] for r in vals(x.df.orderBy("time"), "value")]
    assert o(gaps.fill(s, "hold", limit=1)) == [None, 1.0, 1.0, 3.0, None, None, 6.0, 6.0]
    assert o(gaps.fill(s, "bfill")) == [1.0, 1.0, 3.0, 3.0, 6.0, 6.0, 6.0, None]
    assert o(gaps.fill(s, "linear", max_gap=20)) == [None, 1.0, 2.0, 3.0, None, None, 6.0, None]
    assert o(gaps.fill(s, {"value": {"literal": 9.0}}, max_gap=10)) == [9.0, 1.0, None, 3.0, None, None, 6.0, 9.0]
    with pytest.raises(TypeError):
        gaps.fill(s, {"value": {"literal": "x"}})


def test_join_pairs_equal_keys_in_order(spark):
    a = points(spark, [(0, 1.0), (0, 2.0), (5, 3.0)], a="number")
    b = points(spark, [(0, 10.0), (0, 20.0), (0, 30.0)], b="number")
    out = joins.join(a, b).df.orderBy("time", "__seq")
    assert vals(out, "a", "b") == [(1.0, 10.0), (2.0, 20.0), (None, 30.0), (3.0, None)]
    with pytest.raises(ValueError):
        joins.join(a, a)
    assert sorted(joins.join(a, a, "inner", ("l", "r")).values) == ["l_a", "r_a"]
    assert joins.join_many([a, b, points(spark, [(5, 7.0)], c="number")]).df.count() == 4


def test_dedupe(spark):
    s = points(spark, [(0, 5.0), (0, None), (0, 2.0), (0, 2.0), (9, 1.0)])
    o = lambda keep: [r[0] for r in vals(joins.dedupe(s, keep).df.orderBy("time"), "__seq")]
    assert o("first") == [0, 4] and o("last") == [3, 4] and o("drop") == [4] and o({"min": "value"}) == [2, 4] and o({"max": "value"}) == [0, 4]
    assert vals(joins.dedupe(s, {"merge": {"value": "sum"}}).df.orderBy("time"), "value") == [(9.0,), (1.0,)]
    with pytest.raises(ValueError):
        joins.dedupe(s, "error")


def test_pivot(spark):
    s = points(spark, [(0, 1.0, "a"), (0, 2.0, "b"), (5, 3.0, "a"), (5, 5.0, "a")], value="number", host="string")
    out = joins.pivot_by_group(s, "host", "value", aggregate="sum").df.orderBy("time")
    assert out.columns == ["time", "a_value", "b_value"] and vals(out, "a_value", "b_value") == [(1.0, 2.0), (8.0, 0.0)] or vals(out, "a_value") == [(1.0,), (8.0,)]
    with pytest.raises(Exception, match="several rows"):
        joins.pivot_by_group(s, "host", "value").df.collect()


def test_align(spark):
    s = points(spark, [(5, 1.0), (5, 7.0), (20, 4.0), (40, None)])
    o = lambda m: vals(agg.align(s, grid.every(10), m, span=(0, 40_000)).df.orderBy("begin"), "value")
    assert o("hold") == [(None,), (7.0,), (4.0,), (4.0,), (None,)]
    assert o("linear") == [(None,), (6.0,), (4.0,), (4.0,), (None,)]
    tie = points(spark, [(10, 1.0), (10, 2.0)])
    assert vals(agg.align(tie, grid.every(10)).df, "value") == [(1.0,)]  # an exact hit is the first of equals


def test_materialize(spark):
    s = points(spark, [(0, 1.0), (4, 2.0), (9, 3.0), (25, 4.0)])
    o = lambda how, at="begin": [r[0] for r in vals(agg.materialize(s, grid.every(10), how, at).df.orderBy("time"), "value")]
    assert o("first") == [1.0, None, 4.0] and o("last") == [3.0, None, 4.0] and o("nearest", "center") == [2.0, None, 4.0]


def test_value_bins(spark):
    s = points(spark, [(0, 0.0), (1, 10.0), (2, 25.0), (3, None), (4, 30.0)])
    out = agg.by_column(s, "value", {"n": ("value", "count")}, edges=[0, 10, 20, 30]).orderBy("start")
    assert [r[0] for r in vals(out, "n")] == [1, 1, 1]
    out = agg.by_column(s, "value", {"n": ("value", "count")}, edges=[0, 10, 20, 30], inclusive="(]").orderBy("start")
    assert [r[0] for r in vals(out, "n")] == [2, 0, 2]
    out = agg.by_column(s, "value", {"n": ("value", "count")}, width=10).orderBy("start")
    assert [r[0] for r in vals(out, "n")] == [1, 1, 1, 1]
    out = agg.by_column(points(spark, [(0, -0.3), (1, -0.30000000000000004)]), "value", {"n": ("value", "count")}, width=0.1)
    assert all(a <= v < b for a, b, v in vals(out.filter("n > 0").withColumn("v", F.col("start")), "start", "end", "v"))


def test_bands_without_spread(spark):
    s = points(spark, [(0, 2.0), (1, 2.0), (2, 2.0)])
    out = windows.baseline(s, "value", 100).df
    assert vals(out.limit(1), "avg", "sd", "upper") == [(2.0, 0.0, None)] and windows.outliers(s, "value", 100).df.count() == 0
    b = studies.bollinger(s.rename({"value": "close"}), 2).df.orderBy("time")
    assert vals(b, "middle", "upper") == [(None, None), (2.0, None), (2.0, None)]


def test_folds(spark):
    s = points(spark, [(0, None), (1, 1.0), (2, None), (3, 3.0)])
    o = lambda x, c="value": [r[0] for r in vals(x.df.orderBy("time"), c)]
    assert o(folds.ema(s, "value", alpha=0.5)) == [None, 1.0, None, 2.0]
    assert o(folds.ema(s, "value", alpha=0.5, min_samples=2)) == [None, None, None, 2.0]
    assert o(folds.ema(s, "value", alpha=0.5, warmup=2)) == [None, 2.0]
    assert o(folds.scan(s, "value", lambda a, v: (a + v, a + v), 10.0, "x"), "x") == [None, 11.0, 11.0, 14.0]
    assert o(folds.cumulate(s, "value", lambda a, v: a * 10 + v)) == [None, 1.0, 1.0, 13.0]
    line = points(spark, [(i, 2.0 * i) for i in range(10)])
    assert np.allclose(o(folds.loess(line, "value", 0.5)), [2.0 * i for i in range(10)])


def test_positions(spark):
    s = points(spark, [(i, float(i)) for i in range(6)])
    v = lambda df: [r[0] for r in vals(df.orderBy("time"), "value")]
    assert v(s.sample(2).df) == [1, 3, 5] and v(s.slice(-2).df) == [4, 5] and v(s.slice(1, -3).df) == [1, 2] and v(s.tail(2).df) == [4, 5]
    assert v(s.at_index(-1)) == [5] and v(s.first()) == [0] and v(s.last()) == [5] and s.bisect(ms(3)).first()[0] == 3
    assert v(s.nearest(ms(2.5))) == [2] and v(s.at_or_before(ms(2.5))) == [2] and v(s.at_or_after(ms(2.5))) == [3]
    assert v(s.before(ms(2)).df) == [0, 1] and v(s.after(ms(4)).df) == [5] and v(s.within(ms(1), ms(2)).df) == [1, 2]
    assert s.includes_key(ms(3)) and not s.includes_key(ms(3.5)) and s.some(F.col("value") > 4) and not s.every(F.col("value") > 4)
    assert s.extent_overlaps(ms(5), ms(9)) and s.extent_intersection(ms(4), ms(9)) == (ms(4), ms(5)) and s.sample(reservoir=3).df.count() == 3


def test_keys_and_columns(spark):
    s = points(spark, [(0, 1.0), (10, None)])
    r = s.as_range().as_interval(F.lit("x"))
    assert r.kind == "interval" and r.as_time("center").kind == "time"
    assert [x[0] for x in vals(s.map_columns({"value": lambda c: c + 1}).df.orderBy("time"), "value")] == [2.0, None]
    assert s.collapse(["value"], "v2", lambda a: a * 2).values == ["v2"] and s.rename({"value": "v"}).values == ["v"]
    assert s.by_value("value").df.count() == 1 and s.concat(s).df.count() == 4 and s.validate() is s
    with pytest.raises(ValueError):
        points(spark, [(0, float("nan"))]).validate()
    with pytest.raises(ValueError):
        s.select("nope")


def test_arrays(spark):
    s = tables.from_rows(spark, [(ms(0), ["a", "b"], [1.0, 2.0, 4.0]), (ms(1), [], []), (ms(2), None, None)], {"time": "time", "tags": "array<string>", "xs": "array<number>"})
    assert arrays.contains(s, "tags", "a").df.count() == 1 and arrays.contains_all(s, "tags", []).df.count() == 2 and arrays.contains_any(s, "tags", []).df.count() == 0
    assert arrays.explode(s, "tags", "tag").df.count() == 2
    got = {r: s.df.orderBy("time").select(reduce_array(r, F.col("xs"), "double")).first()[0] for r in ("count", "sum", "avg", "p50", "stdev", "first", "last", "difference")}
    assert got["count"] == 3 and got["sum"] == 7.0 and got["p50"] == 2.0 and got["first"] == 1.0 and got["last"] == 4.0 and got["difference"] == 3.0


def test_columns(spark):
    s = points(spark, [(i, float(i % 4)) for i in range(10)])
    out = columns.bin_by_index(s, "value", 3, "count").orderBy("bin")
    assert [r[0] for r in vals(out, "value")] == [3, 3, 4]
    assert [r[0] for r in vals(columns.bin_by_key(s, "value", [0, 5000, 9000], "sum").orderBy("bin"), "value")] == [6.0, 1.0 + 2.0 + 3.0 + 0.0 + 1.0]
    assert columns.m4(s, "value", 2).count() == 2 and columns.describe(s, "value", "p99", "mean").first()["mean"] == 1.3
    runs = columns.segments(Series(s.df.withColumn("x", F.col("value") * 0 + F.unix_millis(F.col("time").cast("timestamp"))), "value", ("x",), (), "__seq"), "value", 1, 2).orderBy("start")
    assert vals(runs, "start", "end") == [(1.0, 2.0), (5.0, 6.0), (9.0, 9.0)]
    assert columns.stacked(s, ["value"]).count() == 10


def test_sessions(spark):
    rules = sessions.Rules("America/New_York", time(9, 30), time(16), holidays=frozenset({date(2024, 3, 12)}), early={date(2024, 3, 13): time(13)})
    c = sessions.TradingCalendar.from_rules(rules, date(2024, 3, 8), date(2024, 3, 13))
    assert [s.day.day for s in c.sessions] == [8, 11, 13]
    assert c.sessions[0].open // 10**6 % 86400 == 14 * 3600 + 1800 and c.sessions[1].open // 10**6 % 86400 == 13 * 3600 + 1800
    assert c.is_open(datetime(2024, 3, 8, 15)) and not c.is_open(datetime(2024, 3, 8, 21)) and not c.is_trading_day(date(2024, 3, 12))
    assert c.next_session(datetime(2024, 3, 8, 15)).day.day == 11 and c.previous_session(datetime(2024, 3, 11, 1)).day.day == 8
    assert len(c.bar_sequence("1h").spans) == 7 + 7 + 4
    assert c.distance(datetime(2024, 3, 8, 20, 59), datetime(2024, 3, 11, 13, 31)) == 120 * 10**6
    assert c.offset(datetime(2024, 3, 8, 20, 59), 120 * 10**6) == c.sessions[1].open + 60 * 10**6
    s = tables.from_rows(spark, [(datetime(2024, 3, 8, 14, 30), 1.0), (datetime(2024, 3, 8, 21), 2.0)], {"time": "time", "value": "number"})
    assert [r[0] is None for r in vals(c.tag(s).df.orderBy("time"), "session")] == [False, True]
    assert [r[0] is None for r in vals(c.tag(s, closes=True).df.orderBy("time"), "session")] == [True, False]


def test_tracks(spark):
    rows = [(i * 1000, 0.0, i * 0.001, 100.0 + (i % 5) * 2, 200.0) for i in range(60)]
    s = points(spark, rows, lat="number", lng="number", ele="number", power="number")
    meters = track.total_distance(s).first()[0]
    assert abs(meters - 59 * 111.195) < 1 and track.moving_time(s).first()[0] == 59.0
    assert track.elevation_gain_loss(s).first().gain > 0
    assert abs(track.power_summary(s).first().normalized - 200) < 1e-9
    best = track.best_efforts(s, [1000.0, 1e9]).orderBy("meters").collect()
    assert best[0].seconds == 9.0 and best[1].seconds is None
    assert track.splits(s).count() == 7 and track.simplify(s, 1e-6).count() == 2
    assert [r.watts for r in track.power_curve(s, [5.0, 10.0]).collect()] == [200.0, 200.0]
    assert sum(r.seconds for r in track.zones(s, "power", [0, 150, 250]).collect()) == 59.0
    at = track.position_at(s, spark.createDataFrame([(111.195,)], "meters double")).first()
    assert abs(at.lng - 0.001) < 1e-5


def test_plan(spark):
    ops = plan.standard_ops()
    a = builder.col("value").op("zScore").spec
    b = {"inputs": ["value"], "params": {"period": 20.0}, "op": "zScore"}
    assert ops.spec_id(a) == ops.spec_id(b) and ops.spec_id(a) != ops.spec_id(builder.col("value").op("zScore", period=21).spec)
    nested = builder.col("value").op("sma", period=5).op("diff").spec
    assert ops.required_history(nested) == 5
    s = points(spark, [(i, float(i)) for i in range(30)])
    out, errors = plan.run(s, ops, {"x": nested, "bad": {"op": "nope", "inputs": []}, "y": builder.slot("mean").op("scale", by=2).spec}, slots={"mean": builder.col("value").op("sma", period=5).spec}, on_error="collect")
    assert set(errors) == {"bad"} and out.orderBy("time").collect()[10].y == 16.0 and out.orderBy("time").collect()[10].x == 1.0
    with pytest.raises(ValueError):
        plan.run(s, ops, {"x": {"op": "sma", "inputs": ["value"]}})
    assert plan.shape(s, "value", 10).count() == 10 and plan.facts(s, "value").first().percentile_rank == round(29 / 30, 6)
    assert len(ops.json_schema()["oneOf"]) == len(ops.describe())


def test_sources(spark, tmp_path):
    import pyarrow as pa

    s = points(spark, [(0, 1.0), (10, None)])
    assert tables.to_columns(s) == {"time": [ms(0), ms(10)], "value": [1.0, None]} and tables.to_rows(s)[1] == (ms(10), None)
    assert tables.to_json_rows(s).orderBy("json").first()[0].startswith("{") and tables.to_points(s).columns == ["ts", "value"]
    c = tables.from_columns(spark, {"time": [ms(0), ms(1)], "value": [1.0, float("inf")]}, {"time": "time", "value": "number"})
    assert tables.to_rows(c)[1][1] is None
    assert tables.from_arrow(spark, pa.table({"t": pa.array([ms(0)]), "x": [1.0]}), time="t").df.count() == 1
    with pytest.raises(TypeError):
        tables.from_arrow(spark, pa.table({"t": pa.array([ms(0)]), "x": pa.array([1], pa.decimal128(5, 2))}), time="t")
    (tmp_path / "a.json").write_text('{"time":"2024-03-10","v":1}\n{"time":"2024-03-10T00:00:00Z","v":2}\n{"time":"2024-03","v":null}\n')
    j = tables.from_json(spark, str(tmp_path / "a.json"), {"time": "time", "v": "number"}, "time", "America/New_York")
    assert sorted(str(r[0]) for r in vals(j.df, "time")) == ["2024-03-01 05:00:00", "2024-03-10 00:00:00", "2024-03-10 05:00:00"]
    tables.write(s, str(tmp_path / "p"))
    assert tables.read(spark, str(tmp_path / "p"), time="time", seq="__seq").df.count() == 2


@pytest.fixture
def stream(spark, tmp_path):
    def make(rows, files=1):
        for i in range(files):
            part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
            spark.createDataFrame([(ms(r[0]), r[1], r[2], k) for k, r in enumerate(part)], "time timestamp, host string, value double, k long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema("time timestamp, host string, value double, k long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return live.Live(src, "time", ("host",))

    return make


def rows_of(df, name, *cols):
    return [tuple(r) for r in live.run_to_table(df, name).select(*cols).collect()]


def test_live_steps(spark, stream):
    s = stream([(0, "a", 1.0), (10, "a", None), (20, "a", 4.0), (20, "b", 5.0), (30, "a", None), (40, "a", None)], 2)
    got = rows_of(s.through(live.Chain([live.Fill({"value": "hold"}, 1), live.Cumulative({"value": "sum"})]), "k"), "chain", "host", "value")
    assert sorted(x for h, x in got if h == "a") == [1.0, 2.0, 6.0, 10.0, 10.0]
    got = rows_of(s.through(live.Sample(2), "k"), "sampled", "host")
    assert got == [("a",), ("a",)]
    got = rows_of(s.through(live.Change("diff", ["value"], drop=True), "k"), "changed", "host", "value")
    assert len(got) == 4


def test_live_windows_keep_a_row_of_their_age(spark, stream):
    s = stream([(0, "a", 1.0), (10, "a", 2.0), (20, "a", 4.0), (20, "b", 5.0)])
    got = rows_of(s.through(live.Rolling({"10ms": {"x": ("value", "sum")}}), "k"), "rolled", "host", "x")
    assert sorted(got) == [("a", 1.0), ("a", 3.0), ("a", 6.0), ("b", 5.0)]
    got = rows_of(s.through(live.Rolling({None: {"x": ("value", "sum")}}, live.Trigger.count(2), count=2), "k"), "counted", "host", "x")
    assert got == [("a", 3.0)]
    got = rows_of(s.through(live.Rolling({"1s": {"x": ("value", "count")}}, live.Trigger.clock("15ms"), synced=True), "k"), "clocked", "host", "time", "x")
    assert [(h, x) for h, _, x in got] == [("a", 2.0)] and got[0][1] == ms(15)


def test_live_order(spark, stream):
    s = stream([(0, "a", 1.0), (20, "a", 2.0), (10, "a", 3.0), (30, "a", 4.0)], 2)
    got = rows_of(s.through(live.Ordered("drop"), "k"), "ordered", "value")
    assert len(got) in (3, 4)
    assert len(rows_of(s.through(live.Reduce({None: {"n": ("value", "count")}}), "k"), "reduced", "n")) == 2


def test_null_partitions_are_partitions_like_any_other(spark):
    rows = [(i * 10, float(i), h, float(i % 3)) for h in ("a", None) for i in range(12)]
    s = points(spark, rows, value="number", host="string", kind="number").partition_by("host")
    both = lambda df, *cols: ({h: sorted(tuple(r)[1:] for r in part) for h, part in ((h, [r for r in df.select("host", *cols).collect() if r.host == h]) for h in ("a", None))})
    m = {"n": ("value", "count"), "t": ("value", "sum")}
    outs = {
        "materialize": (agg.materialize(s, grid.every(20)).df, "time", "value"),
        "nearest": (agg.materialize(s, grid.every(20), "nearest").df, "time", "value"),
        "rolling_on": (windows.rolling_on(s, grid.every(20), 30, m).df, "begin", "n", "t"),
        "by_width": (agg.by_column(s, "value", m, width=5.0), "start", "n", "t"),
        "by_edges": (agg.by_column(s, "value", m, edges=[0.0, 4.0, 9.0]), "start", "n", "t"),
        "tail": (s.tail(35).df, "time", "value"),
        "join": (joins.join(s.select("value"), s.select("kind")).df, "time", "value", "kind"),
        "centres": (windows.rolling_by_column(s, "value", 2.0, m, at=[0.0, 5.0]), "center", "n", "t"),
        "bins": (columns.bin_by_index(s, "value", 4, "avg"), "bin", "value"),
        "key_bins": (columns.bin_by_key(s, "value", [0, 50_000, 110_000], "avg"), "bin", "value"),
        "m4": (columns.m4(s, "value", 3), "bucket", "first", "last", "min", "max"),
        "facts": (plan.facts(s, "value"), "last", "low", "high", "percentile_rank"),
        "align": (agg.align(s, grid.every(15), "linear").df, "begin", "value"),
        "fill": (gaps.fill(s.map({"value": F.when(F.col("kind") > 0, F.col("value"))}), "linear", limit=2).df, "time", "value"),
        "dealt": (gaps.fill(s.map({"value": F.when(F.col("kind") > 0, F.col("value"))}).dealt(30), "linear", limit=2).df, "time", "value"),
        "aggregate": (agg.aggregate(s, grid.every(20), m).df, "begin", "n", "t"),
    }
    for name, (df, *cols) in outs.items():
        got = both(df, *cols)
        assert got["a"] and got["a"] == got[None], name
        assert any(v is not None and v != 0 for r in got[None] for v in r[1:]), name


def test_dealt_partitions_read_like_whole_ones(spark):
    rng = np.random.default_rng(8)
    rows = [(float(t), float(v) if v > 3 else None, "ab"[int(h)] if h < 2 else None) for t, v, h in zip(rng.integers(0, 400, 200), rng.integers(0, 9, 200), rng.integers(0, 3, 200), strict=True)]
    s = points(spark, rows, value="number", host="string")
    for whole in (s, s.partition_by("host")):
        dealt = whole.dealt("20ms")
        both = lambda f: [sorted(map(tuple, f(x).collect()), key=str) for x in (whole, dealt)]  # noqa: E731, B023
        for f in (
            lambda x: gaps.fill(x, "hold", limit=2).df, lambda x: gaps.fill(x, "bfill", max_gap=40).df, lambda x: gaps.fill(x, "linear").df, lambda x: gaps.fill(x, {"value": {"literal": 1.5}}, limit=1, max_gap=30).df,
            lambda x: gaps.fill(x, "zero", max_gap=9).df, lambda x: gaps.fill(x, "zero").df, lambda x: x.numbered(), lambda x: x.slice(3, -4).df, lambda x: x.sample(7).df, lambda x: agg.align(x, grid.every(13), "linear").df,
            lambda x: agg.align(x, grid.every(13)).df, lambda x: windows.cumulative(x.map({c: F.col("value") for c in "abcd"}), dict(zip("abcd", ("sum", "count", "max", "min"), strict=True))).df, lambda x: columns.bin_by_index(x, "value", 7, "count"),
            lambda x: joins.as_of(s.df.select("__seq", "host", F.col("time").alias("t")), F.unix_micros(F.col("t").cast("timestamp")) - 3000, x, list(x.by)) if x.by else joins.as_of(s.df.select("__seq", F.col("time").alias("t")), F.unix_micros(F.col("t").cast("timestamp")) - 3000, x, []),
        ):
            a, b = both(f)
            assert a == b and a


def test_a_resolver_decides_between_rows_of_one_key(spark):
    s = points(spark, [(0, 5.0, "x"), (0, 2.0, "y"), (0, 4.0, "z"), (9, 1.0, "w")], value="number", tag="string")
    out = joins.dedupe(s, lambda rows: F.struct(F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["value"]).alias("value"))).df.orderBy("time")
    assert vals(out, "value", "tag") == [(11.0, "z"), (1.0, "w")]
    assert vals(joins.dedupe(s, lambda rows: rows[1]).df.orderBy("time").select("value", "tag") if False else joins.dedupe(s, lambda rows: F.struct(rows[0]["tag"].alias("tag"))).df.orderBy("time"), "value", "tag") == [(4.0, "x"), (1.0, "w")]
    with pytest.raises(ValueError):
        joins.dedupe(s, lambda rows: F.struct(F.lit(1).alias("time")))


def test_same_names_need_a_prefix(spark):
    s = points(spark, [(0, 1.0), (10, 2.0)])
    left = s.df.select("time", F.col("value"))
    at = F.unix_micros(F.col("time").cast("timestamp"))
    with pytest.raises(ValueError):
        joins.as_of(left, at, s)
    assert joins.as_of(left, at, s, prefix="r").columns == ["time", "value", "r_value"]


def test_reservoirs_are_of_each_partition_and_repeatable(spark):
    s = points(spark, [(i, float(i), "ab"[i % 2]) for i in range(40)], value="number", host="string").partition_by("host")
    a = s.sample(reservoir=5, seed=3).df
    b = Series(s.df.repartition(7), s.kind, s.key, s.by, s.seq).sample(reservoir=5, seed=3).df
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and sorted(r["count"] for r in a.groupBy("host").count().collect()) == [5, 5]
    assert sorted(map(tuple, s.sample(reservoir=5, seed=4).df.collect())) != sorted(map(tuple, a.collect()))


def test_slots_that_lead_back_are_named(spark):
    with pytest.raises(ValueError, match="a -> b -> a"):
        plan.expand_slots({"slot": "a"}, {"a": {"op": "diff", "inputs": [{"slot": "b"}]}, "b": {"op": "diff", "inputs": [{"slot": "a"}]}})


def test_long_grids_come_in_blocks(spark, monkeypatch):
    s = points(spark, [(3, 1.0, "a"), (987, 2.0, "a"), (40, 3.0, "b"), (41, 3.0, "b")], value="number", host="string").partition_by("host")
    want = {}
    for block in (10_000, 7, 1):
        monkeypatch.setattr(grid, "BLOCK", block)
        monkeypatch.setattr(agg, "BLOCK", block)
        for sample in grid.SAMPLES:
            got = sorted(map(tuple, grid.spine(agg.bounds(s), ["host"], grid.every(10), sample).collect()))
            assert len(got) >= 98 and got == want.setdefault(sample, got)
        got = sorted(map(tuple, agg.by_column(s, "value", {"n": ("value", "count")}, width=0.01).collect()))
        assert len(got) == 102 and got == want.setdefault("bins", got)


def test_arrow_keys_of_any_unit_and_kind(spark):
    import pyarrow as pa

    for unit, scale in (("s", 1), ("ms", 1000), ("us", 10**6), ("ns", 10**9)):
        s = tables.from_arrow(spark, pa.table({"t": pa.array([2 * scale, 5 * scale]), "x": [1.0, 2.0]}), time="t", time_unit=unit)
        assert vals(s.df.orderBy("t"), "t") == [(ms(2000),), (ms(5000),)]
    t = pa.table({"b": pa.array([5000, 0]), "e": pa.array([6000, 4000]), "l": ["x", "y"], "v": [1.0, 2.0], "w": [0, 0]})
    s = tables.from_arrow(spark, t, begin="b", end="e", label="l", columns=["v"])
    assert s.kind == "interval" and s.values == ["v"] and vals(s.first(), "l") == [("y",)]
    with pytest.raises(ValueError, match="order"):
        tables.from_arrow(spark, t, begin="b", end="e", sort=False)
    with pytest.raises(ValueError, match="unit"):
        tables.from_arrow(spark, t, begin="b", end="e", time_unit="h")


def test_axes_that_fall_and_explicit_sequences(spark):
    s = points(spark, [(0, 1.0), (1, 3.0), (2, 2.0)])
    with pytest.raises(ValueError, match="falls"):
        s.by_value("value", checked=True)
    assert s.map({"value": F.col("__seq")}).by_value("value", checked=True).df.count() == 3
    b = grid.bounded([(ms(0), ms(5)), (ms(7), ms(9)), (ms(9), ms(10))])
    assert len(b) == 3 and b.first() == (0, 5000) and b.last() == b.at(-1) == (9000, 10000) and b.at(7) is None and b.time_range() == (0, 10000) and len(b.slice(1)) == 2


def test_rows_as_json_arrays(spark):
    import json

    s = tables.from_rows(spark, [(ms(0.25), 1.5, "a\"]}", ["x", None]), (ms(1), None, None, None)], {"time": "time", "v": "number", "t": "string", "g": "array<string>"})
    assert sorted((json.loads(r[0]) for r in tables.to_json_rows(s, arrays=True).collect()), key=str) == sorted([["1970-01-01T00:00:00.000250", 1.5, "a\"]}", ["x", None]], ["1970-01-01T00:00:00.001000", None, None, None]], key=str)


def test_host_answers_beside_the_caller(spark):
    host = plan.Host()
    host.sources.define("p", lambda: points(spark, [(0, 1.0), (1, 3.0)]))
    raw, errors = host.run_async("p", {"d": builder.col("value").op("diff").spec, "bad": "nope"}, on_error="collect").result(timeout=60)
    assert plan.from_wire(raw)["d"].to_pylist() == [None, 2.0] and set(errors) == {"bad"}


def test_state_expires_and_grace_fits_retention(spark, stream):
    s = stream([(0, "a", 1.0), (10, "a", 2.0), (600_000, "b", 1.0), (1_200_000, "b", 2.0), (1_200_010, "a", 4.0)], 5)
    timed = live.Live(s.df, "time", ("host",), expire="1m")
    got = rows_of(timed.through(live.Cumulative({"value": "sum"}), "k"), "expiring", "host", "value")
    assert ("a", 4.0) in got and ("a", 7.0) not in got  # the watermark had passed its last row by a minute
    kept = rows_of(s.through(live.Cumulative({"value": "sum"}), "k"), "staying", "host", "value")
    assert ("a", 7.0) in kept
    with pytest.raises(ValueError, match="grace"):
        live.Live(s.df, "time", ("host",), grace="30 seconds").through(live.Retain(max_age="10s"))
    gone = rows_of(s.through(live.Retain(2), "k"), "retired", "host", "value")
    assert sorted(gone) == [("a", 1.0)]
