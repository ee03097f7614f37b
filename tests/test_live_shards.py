"""States of many keys in a few shards give what a state for each key gives."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from kairo.streaming import live

BIG = (1 << 53) + 1
STEPS = {
    "sample": lambda: live.Sample(2),
    "change": lambda: live.Change("pct", ["v"], drop=True),
    "fill": lambda: live.Fill({"v": "hold", "n": {"literal": 7}}, 1),
    "running": lambda: live.Cumulative({"v": "sum"}),
    "rolling": lambda: live.Rolling({"4s": {"x": ("v", "sum"), "y": ("v", "last")}}),
    "counted": lambda: live.Rolling({None: {"x": ("v", "count")}}, live.Trigger.count(3), count=2),
    "clocked": lambda: live.Rolling({"9s": {"x": ("v", "count")}}, live.Trigger.clock("5s")),
    "reduced": lambda: live.Reduce({None: {"x": ("v", "sum")}}),
    "evicted": lambda: live.Retain(2),
    "kept": lambda: live.Retain(3, "6s", emit="kept"),
    "stats": lambda: live.Retain(2, emit="stats"),
    "ordered": lambda: live.Ordered("drop"),
    "chain": lambda: live.Chain([live.Sample(2), live.Fill({"v": "hold"}), live.Change("diff", ["v"], drop=True)]),
}


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Four batches: keys with nulls and of numbers that no float holds, a key that falls silent for a while."""
    folder, t0 = str(tmp_path_factory.mktemp("shards")), datetime(2024, 1, 1)
    hosts = [("a", 1), ("b", None), (None, 1), (None, None), ("c", 2), ("d", BIG)]
    for batch in range(4):
        rows = [(t0 + timedelta(seconds=40 * batch + i), *hosts[i % 6], float(i % 7) if i % 4 else None, 100 + i if i % 5 else None, i) for i in range(30) if not (batch in (1, 2) and i % 6 == 0)]
        spark.createDataFrame(rows, "t timestamp, host string, part long, v double, n long, k long").coalesce(1).write.mode("append").parquet(folder)
    return lambda: spark.readStream.schema("t timestamp, host string, part long, v double, n long, k long").option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, source, step, name, **options):
    out = live.Live(source(), "t", ("host", "part"), **options).through(step, "k")
    return sorted((tuple(r) for r in live.run_to_table(out, name).collect()), key=str)


@pytest.mark.parametrize("name", STEPS)
def test_shards_give_the_same(spark, source, name):
    got = run(spark, source, STEPS[name](), f"few_{name}", shards=2)
    assert got and got == run(spark, source, STEPS[name](), f"own_{name}", shards=0)
    if name == "running":
        assert {r[2] for r in got} == {1, 2, None, BIG}


def test_whole_numbers_stay_whole_beside_nulls(spark, source):
    src = source().selectExpr("t", "host", "part", "v", f"case when k % 5 > 0 then k + {BIG} end as n", "k")
    out = live.Live(src, "t", ("host", "part")).through(live.Sample(1), "k")
    rows = live.run_to_table(out, "whole_numbers").collect()
    assert len(rows) == 110 and all(r.n == (r.k + BIG if r.k % 5 else None) for r in rows)


def test_shards_forget_keys_that_expire(spark, source):
    options = {"grace": "1 seconds", "expire": "20s"}
    got = run(spark, source, live.Cumulative({"v": "count"}), "few_expired", shards=1, **options)
    assert got == run(spark, source, live.Cumulative({"v": "count"}), "own_expired", shards=0, **options)
    whole = run(spark, source, live.Cumulative({"v": "count"}), "whole", shards=1)
    assert got != whole  # the silent key began anew


def test_a_step_of_ones_own_runs_key_by_key(spark, source):
    class Firsts(live.Step):
        def take(self, state, rows):
            n, state["n"] = state.get("n", 0), state.get("n", 0) + len(rows)
            assert rows["host"].nunique(dropna=False) == 1
            return rows if n == 0 else rows.iloc[:0]

    got = run(spark, source, Firsts(), "firsts", shards=2)
    assert len(got) == 30 and got == run(spark, source, Firsts(), "firsts_own", shards=0)
