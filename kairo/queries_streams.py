"""Queries over streams: the events file as a stream, into files of the shared folder, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .queries import _drain, _stream, query, r6, shared_folder
from .queries_rows import part, stack
from .streaming import live


def _live(spark, d, by: str = "user_id") -> live.Live:
    return live.Live(_stream(spark, d), "ts", (by,))


def _ts(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 3 = 0")
def live_sample(spark, d):
    return _drain(spark, _live(spark, d).through(live.Sample(3), "event_id")).select("event_id", "user_id")


@query("""
WITH x AS (SELECT event_id, value, lag(value) OVER w AS p, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS dt, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT 'rate' AS part, event_id, round(CASE WHEN dt <> 0 THEN (value - p) / (dt / 1e6) END, 6) AS value FROM x UNION ALL SELECT 'pct', event_id, round(CASE WHEN p <> 0 THEN (value - p) / p END, 5) FROM x WHERE n > 1
""")
def live_changes(spark, d):
    rate = _drain(spark, _live(spark, d).through(live.Change("rate", ["value"]), "event_id"))
    pct = _drain(spark, _live(spark, d).through(live.Change("pct", ["value"], drop=True), "event_id"))
    return stack(part(rate, "rate", "event_id", F.round("value", 6).alias("value")), part(pct, "pct", "event_id", F.round("value", 5).alias("value")))


@query("""
SELECT event_id, value * 2 AS twice, event_type FROM events WHERE event_type <> 'view'
""")
def live_stateless(spark, d):
    s = _live(spark, d).filter("event_type <> 'view'").select("event_id", "value", "event_type").map({"event_id": F.col("event_id"), "twice": F.col("value") * 2, "event_type": F.col("event_type")})
    return _drain(spark, s.df).select("event_id", "twice", "event_type")


@query("""
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 7 >= 2 THEN value END AS value FROM events), g AS (SELECT *, count(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) - CASE WHEN g > 0 THEN 1 ELSE 0 END AS k FROM g)
SELECT 'zero' AS part, event_id, coalesce(value, 0.0) AS value FROM e UNION ALL SELECT 'literal', event_id, coalesce(value, CASE WHEN k <= 1 THEN 7.5 END) FROM n
UNION ALL SELECT 'low', event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) FROM e UNION ALL SELECT 'count', event_id, CASE WHEN g > 0 THEN CAST(g AS DOUBLE) END FROM g
""")
def live_cells(spark, d):
    src = _stream(spark, d).withColumn("value", F.when(F.col("event_id") % 7 >= 2, F.col("value")))
    steps = {"zero": live.Fill({"value": "zero"}), "literal": live.Fill({"value": {"literal": 7.5}}, 1), "low": live.Cumulative({"value": "min"}), "count": live.Cumulative({"value": "count"})}
    return stack(*[part(_drain(spark, live.Live(src, "ts", ("user_id",)).through(step, "event_id")), name, "event_id", F.col("value").cast("double").alias("value")) for name, step in steps.items()])


@query("""
SELECT user_id, ts, CAST(count(value) OVER h AS DOUBLE) AS n, round(avg(value) OVER d, 6) AS mean, max(value) OVER d AS high, CAST(count(value) OVER d AS DOUBLE) AS many FROM events
WINDOW h AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW), d AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW)
""")
def live_fused_windows(spark, d):
    step = live.Rolling({"6h": {"n": ("value", "count")}, "2d": {"mean": ("value", "avg"), "high": ("value", "max"), "many": ("value", "count")}})
    return _ts(_drain(spark, _live(spark, d).through(step, "event_id"))).select("user_id", "ts", "n", *r6("mean"), "high", "many")


@query("""
WITH x AS (SELECT user_id, ts, sum(value) OVER w AS total, count(*) OVER w AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING))
SELECT 'rows' AS part, user_id, ts, round(CASE WHEN c >= 3 THEN total END, 4) AS total FROM x UNION ALL SELECT 'every fourth', user_id, ts, round(total, 4) FROM x WHERE n % 4 = 0
""")
def live_counted_windows(spark, d):
    m = {None: {"total": ("value", "sum")}}
    rows = _drain(spark, _live(spark, d).through(live.Rolling(m, count=5, min_samples=3), "event_id"))
    some = _drain(spark, _live(spark, d).through(live.Rolling(m, live.Trigger.count(4), count=5), "event_id"))
    cols = ("user_id", "ts", F.round("total", 4).alias("total"))
    return stack(part(_ts(rows), "rows", *cols), part(_ts(some), "every fourth", *cols))


CLOCK = """
WITH c AS (SELECT *, epoch_us(ts) // 86400000000 AS cell, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), m AS (SELECT *, max(cell) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
f AS (SELECT user_id, n, cell * 86400000000 AS stamp FROM m WHERE before IS NOT NULL AND cell > before)
"""


@query(CLOCK + """
SELECT f.user_id, make_timestamp(stamp) AS ts, CAST(count(c.value) AS DOUBLE) AS n, round(sum(c.value), 4) AS total FROM f JOIN c ON c.user_id = f.user_id AND c.n < f.n AND epoch_us(c.ts) >= stamp - 3 * 86400000000 GROUP BY 1, 2
""")
def live_clock_trigger(spark, d):
    step = live.Rolling({"3d": {"n": ("value", "count"), "total": ("value", "sum")}}, live.Trigger.every("1d"))
    return _ts(_drain(spark, _live(spark, d).through(step, "event_id"))).select("user_id", "ts", "n", F.round("total", 4).alias("total"))


@query("""
WITH c AS (SELECT *, epoch_us(ts) // 86400000000 AS cell, row_number() OVER (ORDER BY ts, event_id) AS n FROM events), m AS (SELECT *, max(cell) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
f AS (SELECT n, cell * 86400000000 AS stamp FROM m WHERE before IS NOT NULL AND cell > before), k AS (SELECT event_type, min(n) AS first FROM c GROUP BY 1)
SELECT k.event_type, make_timestamp(stamp) AS ts, CAST(count(c.value) AS DOUBLE) AS n FROM f JOIN k ON k.first < f.n LEFT JOIN c ON c.event_type = k.event_type AND c.n < f.n AND epoch_us(c.ts) >= stamp - 7200000000 GROUP BY 1, 2
""")
def live_synced_clock(spark, d):
    step = live.Rolling({"2h": {"n": ("value", "count")}}, live.Trigger.clock("1d"), synced=True)
    return _ts(_drain(spark, _live(spark, d, "event_type").through(step, "event_id"))).select("event_type", "ts", "n")


@query("""
WITH x AS (SELECT user_id, ts, row_number() OVER w AS n, sum(value) OVER w AS total, count(*) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT 'trigger' AS part, user_id, CAST(c AS DOUBLE) AS n, round(total, 3) AS total FROM x WHERE n % 10 = 0 UNION ALL SELECT 'batch', user_id, CAST(count(*) AS DOUBLE), round(sum(value), 3) FROM events GROUP BY 2
""")
def live_reductions(spark, d):
    m = {None: {"n": ("value", "count"), "total": ("value", "sum")}}
    fired = _drain(spark, _live(spark, d).through(live.Reduce(m, live.Trigger.count(10)), "event_id"))
    whole = _drain(spark, _live(spark, d).through(live.Reduce(m), "event_id"))
    cols = ("user_id", "n", F.round("total", 3).alias("total"))
    return stack(part(fired, "trigger", *cols), part(whole, "batch", *cols))


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS m, max(ts) OVER (PARTITION BY user_id) AS hi FROM events)
SELECT 'by count' AS part, user_id, event_id FROM n WHERE m > 20 UNION ALL SELECT 'by age', user_id, event_id FROM n WHERE ts < hi - INTERVAL 5 DAY UNION ALL SELECT 'by both', user_id, event_id FROM n WHERE m > 20 OR ts < hi - INTERVAL 5 DAY
""")
def live_evicted(spark, d):
    steps = {"by count": live.Retain(20), "by age": live.Retain(max_age="5d"), "by both": live.Retain(20, "5d")}
    return stack(*[part(_drain(spark, _live(spark, d).through(step, "event_id")), name, "user_id", "event_id") for name, step in steps.items()])


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS m, max(ts) OVER (PARTITION BY user_id) AS hi FROM events)
SELECT 'last rows' AS part, user_id, count(value) AS n, round(avg(value), 6) AS mean, max(value) AS high FROM n WHERE m <= 12 GROUP BY 2 UNION ALL SELECT 'last days', user_id, count(value), round(avg(value), 6), max(value) FROM n WHERE ts >= hi - INTERVAL 4 DAY GROUP BY 2
""")
def live_window_views(spark, d):
    cols = [F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("high")]
    view = lambda size: live.window_view(spark, shared_folder(spark, "view"), _live(spark, d), size, "event_id").groupBy("user_id").agg(*cols)
    return stack(part(view(12), "last rows", "user_id", "n", "mean", "high"), part(view("4d"), "last days", "user_id", "n", "mean", "high"))


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS m FROM events)
SELECT user_id, count(*) AS "rows", count(*) FILTER (m > 20) AS evicted, count(*) FILTER (m <= 20) AS kept, min(ts) FILTER (m <= 20) AS "first", max(ts) AS "last", round(count(*) FILTER (m <= 20) / nullif((epoch_us(max(ts)) - epoch_us(min(ts) FILTER (m <= 20))) / 1e6, 0), 8) AS rate FROM n GROUP BY 1
""")
def live_stats(spark, d):
    out = _drain(spark, _live(spark, d).through(live.Retain(20, emit="stats"), "event_id"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")}).withColumn("rate", F.round("rate", 8))


@query("SELECT event_id, user_id, ts, value FROM events")
def live_order_and_json(spark, d):
    lines = _stream(spark, d).select(F.to_json(F.struct("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"), "user_id", "value")).alias("value"))
    src = live.from_json(lines, {"event_id": "number", "ts": "time", "user_id": "number", "value": "number"}, "ts").partition_by("user_id")
    out = _ts(_drain(spark, src.through(live.Ordered("strict"), "event_id")))
    return out.select(F.col("event_id").cast("bigint").alias("event_id"), F.col("user_id").cast("bigint").alias("user_id"), "ts", "value")
