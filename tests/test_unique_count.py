"""column_reads asks the operator for its distinct values; the operator agrees with SQL where they vary."""

from __future__ import annotations

import duckdb

from kairo import queries as Q
from kairo.operators import columns

SF = "/root/testdata/sf0.001"


def test_unique_count(spark, monkeypatch):
    want = dict(duckdb.sql(f"select event_type, count(distinct user_id) from '{SF}/events.parquet' group by 1").fetchall())
    got = columns.unique_count(Q.events(spark, SF).partition_by("event_type"), "user_id")
    assert {r.event_type: r.unique_count for r in got.collect()} == want
    asked = []
    real = columns.unique_count
    monkeypatch.setattr(columns, "unique_count", lambda s, c: asked.append(c) or real(s, c))
    Q.column_reads(spark, SF)
    assert asked == ["user_id"]
