"""One query for each operator family over the whole tables, with the same in DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import date, datetime, time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .activity import track
from .finance import sessions, studies
from .functions.time import from_us
from .operators import aggregate as agg
from .operators import arrays, columns, folds, gaps, grid, joins, windows
from .plans import builder, plan
from .series import Series
from .streaming import live

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import queries_marks, queries_rows, queries_streams, queries_tracks  # noqa: F401  (they add theirs)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str, *cols: str) -> Series:
    return Series.of(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value"), time="ts", seq="event_id")


def gappy(spark: SparkSession, d: str) -> Series:
    s = events(spark, d)
    return s.map({"value": F.when(F.col("event_id") % 7 >= 2, F.col("value")), "event_type": F.col("event_type"), "user_id": F.col("user_id")}).partition_by("event_type").dealt("6h")  # few partitions, long ones


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


HOURS = """
WITH b AS (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1),
g AS (SELECT event_type, unnest(generate_series(CASE WHEN date_trunc('hour', lo) = lo THEN lo ELSE date_trunc('hour', lo) + INTERVAL 1 HOUR END, hi, INTERVAL 1 HOUR)) AS h FROM b)
"""


@query(HOURS + """
, a AS (SELECT event_type, date_trunc('hour', ts) AS h, count(value) AS n, sum(value) AS total, avg(value) AS mean FROM events GROUP BY 1, 2)
SELECT event_type, h AS "begin", h + INTERVAL 1 HOUR AS "end", CAST(epoch_ms(h) AS BIGINT) AS label, coalesce(n, 0) AS n, round(coalesce(total, 0.0), 6) AS total, round(mean, 6) AS mean
FROM g LEFT JOIN a USING (event_type, h)
""")
def aggregate_hourly(spark, d):
    out = agg.aggregate(events(spark, d).partition_by("event_type"), grid.hourly(), {"n": ("value", "count"), "total": ("value", "sum"), "mean": ("value", "avg")})
    return out.df.select("event_type", "begin", "end", "label", "n", *r6("total", "mean"))


@query("""
WITH e AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-10' OR ts >= TIMESTAMP '2024-01-24'), g AS (SELECT unnest(generate_series(date_trunc('week', (SELECT min(ts) FROM e)), (SELECT max(ts) FROM e), INTERVAL 7 DAY)) AS b)
SELECT b AS "begin", b + INTERVAL 7 DAY AS "end", count(value) AS n, round(max(value) - min(value), 6) AS spread
FROM g LEFT JOIN e ON ts >= b AND ts < b + INTERVAL 7 DAY WHERE b >= (SELECT min(ts) FROM e) GROUP BY 1
""")
def aggregate_calendar_week(spark, d):
    s = events(spark, d).filter("ts < timestamp_ntz'2024-01-10' or ts >= timestamp_ntz'2024-01-24'")  # a week is empty, and there
    out = agg.aggregate(s, grid.calendar("week"), {"n": ("value", "count"), "spread": ("value", "difference")})
    return out.df.select("begin", "end", "n", *r6("spread"))


@query("""
SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high,
  arg_min(value, event_id) AS head, arg_max(value, event_id) AS last, round(quantile_cont(value, 0.5), 6) AS mid, round(quantile_cont(value, 0.999), 6) AS p999,
  round(stddev_pop(value), 6) AS sd, round(max(value) - min(value), 6) AS spread, CASE WHEN min(user_id) = max(user_id) THEN min(user_id) END AS same
FROM events GROUP BY 1
""")
def reducers_by_type(spark, d):
    out = agg.reduce_all(events(spark, d).partition_by("event_type"), {
        "n": ("value", "count"), "total": ("value", "sum"), "mean": ("value", "mean"), "low": ("value", "min"), "high": ("value", "max"), "head": ("value", "first"), "last": ("value", "last"),
        "mid": ("value", "median"), "p999": ("value", "p99.9"), "sd": ("value", "stdev"), "spread": ("value", "difference"), "same": ("user_id", "keep"),
    })
    return out.withColumns({"total": F.round("total", 4)} | {c: F.round(c, 6) for c in ("mean", "mid", "p999", "sd", "spread")})


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c)
SELECT user_id, (SELECT count(DISTINCT event_type) FROM events e WHERE e.user_id = r.user_id) AS kinds, max(CASE WHEN k = 1 THEN event_type END) AS top_one, max(CASE WHEN k = 2 THEN event_type END) AS top_two
FROM r GROUP BY 1
""")
def reducers_unique_top(spark, d):
    out = agg.reduce_all(events(spark, d).partition_by("user_id"), {"kinds": ("event_type", "unique"), "top": ("event_type", "top2")})
    return out.select("user_id", F.size("kinds").cast("bigint").alias("kinds"), F.get("top", F.lit(0)).alias("top_one"), F.get("top", F.lit(1)).alias("top_two"))


def _roll_sql(frame: str) -> str:
    return f"""
SELECT event_id, event_type, ts, count(value) OVER w AS n, round(avg(value) OVER w, 6) AS mean, round(max(value) OVER w, 6) AS high FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN {frame})
"""


def _roll(spark, d, alignment):
    out = windows.rolling(events(spark, d).partition_by("event_type"), "2h", {"n": ("value", "count"), "mean": ("value", "avg"), "high": ("value", "max")}, alignment)
    return out.df.select("event_id", "event_type", "ts", "n", *r6("mean", "high"))


@query(_roll_sql("INTERVAL 7199999999 MICROSECOND PRECEDING AND CURRENT ROW"))
def rolling_trailing(spark, d):
    return _roll(spark, d, "trailing")


@query(_roll_sql("CURRENT ROW AND INTERVAL 7199999999 MICROSECOND FOLLOWING"))
def rolling_leading(spark, d):
    return _roll(spark, d, "leading")


@query(_roll_sql("INTERVAL 3600000000 MICROSECOND PRECEDING AND INTERVAL 3599999999 MICROSECOND FOLLOWING"))
def rolling_centered(spark, d):
    return _roll(spark, d, "centered")


@query("""
SELECT event_id, ts, round(CASE WHEN count(*) OVER w >= 5 THEN avg(value) OVER w END, 6) AS mean, round(CASE WHEN count(*) OVER v >= 5 THEN quantile_cont(value, 0.9) OVER v END, 6) AS p90
FROM events WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECOND PRECEDING AND CURRENT ROW), v AS (ORDER BY ts RANGE BETWEEN INTERVAL 10799999999 MICROSECOND PRECEDING AND CURRENT ROW)
""")
def rolling_fused_unpartitioned(spark, d):
    out = windows.rolling_fused(events(spark, d), {"1h": {"mean": ("value", "avg")}, "3h": {"p90": ("value", "p90")}}, min_samples=5)
    return out.df.select("event_id", "ts", *r6("mean", "p90"))


@query("""
SELECT event_id, user_id, count(value) OVER w AS n, round(CASE WHEN count(*) OVER w >= 4 THEN stddev_pop(value) OVER w END, 6) AS sd
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING)
""")
def rolling_rows_centered(spark, d):
    s = events(spark, d).partition_by("user_id")
    a = windows.rolling(s, None, {"n": ("value", "count")}, "centered", count=10)
    b = windows.rolling(s, None, {"sd": ("value", "stdev")}, "centered", min_samples=4, count=10)
    return a.df.join(b.df.select("event_id", "sd"), "event_id").select("event_id", "user_id", "n", *r6("sd"))


@query(HOURS + """
SELECT g.event_type, h AS "begin", h + INTERVAL 1 HOUR AS "end", count(value) AS n, round(avg(value), 6) AS mean
FROM g LEFT JOIN events e ON e.event_type = g.event_type AND e.ts > h - INTERVAL 6 HOUR AND e.ts <= h GROUP BY 1, 2, 3
""")
def rolling_on_grid(spark, d):
    out = windows.rolling_on(events(spark, d).partition_by("event_type"), grid.hourly(), "6h", {"n": ("value", "count"), "mean": ("value", "avg")})
    return out.df.select("event_type", "begin", "end", "n", *r6("mean"))


@query("""
WITH x AS (SELECT *, value - lag(value) OVER w AS dv, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS dt, lag(value) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(dv, 6) AS diff, round(CASE WHEN dt <> 0 THEN dv / (dt / 1e6) END, 6) AS rate, round(CASE WHEN p <> 0 THEN dv / p END, 6) AS pct FROM x
""")
def differences(spark, d):
    s = events(spark, d).partition_by("user_id")
    s = s.map({"diff": F.col("value"), "rate": F.col("value"), "pct": F.col("value")})
    out = windows.pct_change(windows.rate(windows.diff(s, "diff"), "rate"), "pct")
    return out.df.select("event_id", *r6("diff", "rate", "pct"))


@query("""
SELECT event_id, lag(value, 2) OVER w AS lagged, lead(value, 1) OVER w AS led FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def shifts(spark, d):
    s = events(spark, d).partition_by("user_id").map({"lagged": F.col("value"), "led": F.col("value")})
    return windows.shift(windows.shift(s, 2, "lagged"), -1, "led").df.select("event_id", "lagged", "led")


GAPPY = "WITH e AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 7 >= 2 THEN value END AS value FROM events)"


@query(GAPPY + """
SELECT event_id, event_type, round(sum(value) OVER w, 4) AS total, max(value) OVER w AS high, CASE WHEN count(value) OVER w > 0 THEN CAST(count(value) OVER w AS DOUBLE) END AS n
FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def cumulatives(spark, d):
    s = gappy(spark, d).map({c: F.col("value") for c in ("total", "high", "n")})
    s = windows.cumulative(s, {"total": "sum", "high": "max", "n": "count"})
    return s.df.select("event_id", "event_type", F.round("total", 4).alias("total"), "high", "n")


@query(GAPPY + """
, n AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY event_type) AS c FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
x AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN {v: value, t: epoch_us(ts), n: rn} END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS p,
  first_value(CASE WHEN value IS NOT NULL THEN {v: value, t: epoch_us(ts), n: rn} END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM n)
SELECT event_id, event_type, coalesce(value, CASE WHEN p IS NOT NULL AND coalesce(f.n, c + 1) - p.n - 1 <= 1 THEN p.v END) AS held,
  round(coalesce(value, CASE WHEN p IS NOT NULL AND f IS NOT NULL AND f.t - p.t <= 7200000000 THEN p.v + (f.v - p.v) * ((epoch_us(ts) - p.t) / (f.t - p.t)) END), 6) AS line,
  coalesce(value, 0.0) AS zero FROM x
""")
def fills(spark, d):
    s = gappy(spark, d).map({c: F.col("value") for c in ("held", "line", "zero")})
    s = gaps.fill(s, {"held": "hold"}, limit=1)
    s = gaps.fill(s, {"line": "linear"}, max_gap="2h")
    s = gaps.fill(s, {"zero": "zero"})
    return s.df.select("event_id", "event_type", "held", F.round("line", 6).alias("line"), "zero")


@query(HOURS + """
SELECT g.event_type, h AS "begin", e.value, e.user_id FROM g ASOF LEFT JOIN events e ON g.event_type = e.event_type AND g.h >= e.ts
""")
def align_hold(spark, d):
    return agg.align(events(spark, d).partition_by("event_type"), grid.hourly()).df.select("event_type", "begin", "value", "user_id")


@query(HOURS + """
, p AS (SELECT g.*, e.ts AS t0, e.value AS v0 FROM g ASOF LEFT JOIN events e ON g.event_type = e.event_type AND g.h >= e.ts),
n AS (SELECT p.*, e.ts AS t1, e.value AS v1 FROM p ASOF LEFT JOIN events e ON p.event_type = e.event_type AND p.h <= e.ts)
SELECT event_type, h AS "begin", round(CASE WHEN t1 > t0 THEN v0 + (v1 - v0) * ((epoch_us(h) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0))) ELSE v0 END, 6) AS value FROM n
""")
def align_linear(spark, d):
    return agg.align(events(spark, d).select("value", "event_type").partition_by("event_type"), grid.hourly(), "linear").df.select("event_type", "begin", *r6("value"))


@query(HOURS + """
, a AS (SELECT event_type, date_trunc('hour', ts) AS h, arg_max(value, event_id) AS value, arg_max(user_id, event_id) AS user_id FROM events GROUP BY 1, 2)
SELECT event_type, h AS "time", value, user_id FROM g LEFT JOIN a USING (event_type, h)
""")
def materialize_last(spark, d):
    return agg.materialize(events(spark, d).partition_by("event_type"), grid.hourly()).df.select("event_type", "time", "value", "user_id")


@query("""
WITH c AS (SELECT date_trunc('day', ts) AS k, value AS a, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY event_id) AS n FROM events WHERE event_type = 'click'),
v AS (SELECT date_trunc('day', ts) AS k, value AS b, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY event_id) AS n FROM events WHERE event_type = 'view')
SELECT coalesce(c.k, v.k) AS "day", a, b FROM c FULL JOIN v ON c.k = v.k AND c.n = v.n
""")
def join_ordinal_outer(spark, d):
    e = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    side = lambda kind, out: Series.of(e.filter(F.col("event_type") == kind).select("day", "event_id", F.col("value").alias(out)), time="day", seq="event_id")
    return joins.join(side("click", "a"), side("view", "b")).df.select("day", "a", "b")


@query("""
WITH o AS (SELECT o_orderdate, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey DESC) AS l, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_totalprice, o_orderkey) AS m FROM orders)
SELECT o_orderdate, max(CASE WHEN l = 1 THEN o_orderkey END) AS last_key, max(CASE WHEN m = 1 THEN o_orderkey END) AS least_key FROM o GROUP BY 1
""")
def dedupe_policies(spark, d):
    s = Series.of(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), time="o_orderdate", seq="o_orderkey")
    last = joins.dedupe(s, "last").df.select("o_orderdate", F.col("o_orderkey").alias("last_key"))
    least = joins.dedupe(s, {"min": "o_totalprice"}).df.select("o_orderdate", F.col("o_orderkey").alias("least_key"))
    return last.join(least, "o_orderdate")


@query("""
SELECT date_trunc('hour', ts) AS hour, round(avg(value) FILTER (event_type = 'click'), 6) AS click_value, round(avg(value) FILTER (event_type = 'view'), 6) AS view_value FROM events GROUP BY 1
""")
def pivot_by_group(spark, d):
    e = table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")).select("hour", "event_id", "event_type", "value")
    out = joins.pivot_by_group(Series.of(e, time="hour", seq="event_id"), "event_type", "value", ["click", "view"], "avg")
    return out.df.select("hour", *r6("click_value", "view_value"))


@query("""
WITH a AS (SELECT CAST(floor(value / 25) AS BIGINT) AS b, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1), g AS (SELECT unnest(generate_series((SELECT min(b) FROM a), (SELECT max(b) FROM a))) AS b)
SELECT CAST(b * 25 AS DOUBLE) AS "start", CAST((b + 1) * 25 AS DOUBLE) AS "end", coalesce(n, 0) AS n, mean FROM g LEFT JOIN a USING (b)
""")
def by_column_width(spark, d):
    return agg.by_column(events(spark, d), "value", {"n": ("value", "count"), "mean": ("value", "avg")}, width=25.0).select(F.col("start").cast("double"), F.col("end").cast("double"), "n", *r6("mean"))


@query("""
WITH g AS (SELECT unnest([{s: 0.0, e: 10.0}, {s: 10.0, e: 25.0}, {s: 25.0, e: 50.0}]) AS z)
SELECT CAST(z.s AS DOUBLE) AS "start", CAST(z.e AS DOUBLE) AS "end", count(l_quantity) AS n, round(coalesce(sum(l_extendedprice), 0.0), 2) AS price
FROM g LEFT JOIN lineitem ON (l_quantity > z.s OR (z.s = 0 AND l_quantity = 0)) AND l_quantity <= z.e GROUP BY 1, 2
""")
def by_column_edges(spark, d):
    s = Series.of(table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity", "l_extendedprice"), time="l_shipdate", seq="l_orderkey")
    return agg.by_column(s, "l_quantity", {"n": ("l_quantity", "count"), "price": ("l_extendedprice", "sum")}, edges=[0.0, 10.0, 25.0, 50.0], inclusive="(]").withColumn("price", F.round("price", 2))


@query("""
SELECT o_orderkey, count(*) OVER w AS n, round(avg(o_totalprice) OVER w, 6) AS mean FROM orders WINDOW w AS (ORDER BY o_totalprice RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING)
""")
def rolling_by_column(spark, d):
    s = Series.of(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), time="o_orderdate", seq="o_orderkey")
    out = windows.rolling_by_column(s, "o_totalprice", 100.0, {"n": ("o_totalprice", "count"), "mean": ("o_totalprice", "avg")})
    return out.select("o_orderkey", "n", *r6("mean"))


BASE = "WITH b AS (SELECT event_id, event_type, value, avg(value) OVER w AS a, stddev_pop(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 21599999999 MICROSECOND PRECEDING AND CURRENT ROW))"


@query(BASE + "SELECT event_id, round(a, 6) AS avg, round(s, 6) AS sd, round(CASE WHEN s > 0 THEN a + 2 * s END, 6) AS upper, round(CASE WHEN s > 0 THEN a - 2 * s END, 6) AS lower FROM b")
def baseline_bands(spark, d):
    return windows.baseline(events(spark, d).partition_by("event_type"), "value", "6h").df.select("event_id", *r6("avg", "sd", "upper", "lower"))


@query(BASE + "SELECT event_id, event_type, value FROM b WHERE s > 0 AND abs(value - a) > 1.5 * s")
def outlier_rows(spark, d):
    return windows.outliers(events(spark, d).partition_by("event_type"), "value", "6h", 1.5).df.select("event_id", "event_type", "value")


@query(GAPPY + """
SELECT event_id, round(CASE WHEN value IS NOT NULL THEN avg(value) OVER w END, 6) AS value
FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECOND PRECEDING AND CURRENT ROW)
""")
def smooth_moving_average(spark, d):
    return windows.moving_average(gappy(spark, d), "value", "1h", missing="skip").df.select("event_id", *r6("value"))


@query("""
WITH l AS (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM events)
SELECT event_id, round(list_reduce(v, lambda a, x: 0.2 * x + 0.8 * a), 6) AS ema FROM l
""")
def smooth_ema(spark, d):
    return folds.ema(events(spark, d).partition_by("user_id"), "value", alpha=0.2, output="ema").df.select("event_id", *r6("ema"))


@query("""
WITH l AS (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM events)
SELECT event_id, round(list_reduce(list_prepend(0.0, v), lambda a, x: greatest(0.0, a + x - 50.0)), 6) AS scan FROM l
""")
def scan_excess(spark, d):
    def step(acc, v):
        acc = max(0.0, acc + v - 50.0)
        return acc, acc

    return folds.scan(events(spark, d).partition_by("user_id"), "value", step, 0.0, "scan").df.select("event_id", *r6("scan"))


@query("""
WITH x AS (SELECT event_id, value, count(*) OVER w AS c, avg(value) OVER w AS a, stddev_pop(value) OVER w AS s, quantile_cont(value, 0.25) OVER w AS q, lag(value, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING))
SELECT event_id, round(CASE WHEN c >= 10 THEN a END, 6) AS middle, round(CASE WHEN c >= 10 AND s > 0 THEN a + 2 * s END, 6) AS upper, round(CASE WHEN c >= 10 AND s > 0 THEN a - 2 * s END, 6) AS lower,
  round(CASE WHEN c >= 10 AND s > 0 THEN (value - a) / s END, 6) AS z, round(CASE WHEN p <> 0 THEN (value / p - 1) * 100 END, 4) AS change, round(CASE WHEN c >= 10 THEN q END, 6) AS p25 FROM x
""")
def financial_studies(spark, d):
    s = studies.bollinger(events(spark, d).partition_by("user_id"), 10, source="value")
    s = studies.rolling_stat(studies.percent_change(studies.z_score(s, 10, "value"), 3, "value"), 10, "p25", "value")
    return s.df.select("event_id", *r6("middle", "upper", "lower", "z"), F.round("change", 4).alias("change"), *r6("p25"))


def market() -> sessions.TradingCalendar:
    rules = sessions.Rules("UTC", time(9, 30), time(16), early={date(2024, 1, 10): time(13)}, holidays=frozenset({date(2024, 1, 15)}))
    return sessions.TradingCalendar.from_rules(rules, date(2023, 12, 30), date(2024, 2, 2))


MARKET = """
WITH d AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS day),
s AS (SELECT day + INTERVAL 570 MINUTE AS o, day + CASE WHEN day = TIMESTAMP '2024-01-10' THEN INTERVAL 13 HOUR ELSE INTERVAL 16 HOUR END AS c FROM d WHERE isodow(day) <= 5 AND day <> TIMESTAMP '2024-01-15')
"""


@query(MARKET + "SELECT event_id, s.o AS session FROM events LEFT JOIN s ON ts >= o AND ts < c")
def tag_sessions(spark, d):
    return market().tag(events(spark, d)).df.select("event_id", "session")


@query(MARKET + """SELECT o AS "begin", c AS "end", count(value) AS n, round(avg(value), 6) AS mean FROM s LEFT JOIN events ON ts >= o AND ts < c GROUP BY 1, 2""")
def aggregate_sessions(spark, d):
    out = agg.aggregate(events(spark, d), market().session_sequence(), {"n": ("value", "count"), "mean": ("value", "avg")})
    return out.df.select("begin", "end", "n", *r6("mean"))


@query("""
WITH r AS (SELECT event_id, ts AS b, ts + to_microseconds(CAST(value * 60000000 AS BIGINT)) AS e FROM events),
g AS (SELECT unnest(generate_series(date_trunc('hour', (SELECT min(b) FROM r)) + INTERVAL 1 HOUR, (SELECT max(e) FROM r), INTERVAL 1 HOUR)) AS h)
SELECT h AS "begin", count(event_id) AS n FROM g LEFT JOIN r ON (b < h + INTERVAL 1 HOUR AND e > h) OR (b >= h AND b < h + INTERVAL 1 HOUR) GROUP BY 1
""")
def aggregate_ranges(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").alias("b"), from_us(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 60000000).cast("bigint")).alias("e"))
    return agg.aggregate(Series.of(e, begin="b", end="e"), grid.hourly(), {"n": ("event_id", "count")}).df.select("begin", "n")


LO, HI = datetime(2024, 1, 10), datetime(2024, 1, 12)


@query("""
WITH r AS (SELECT event_id, ts AS b, ts + to_microseconds(CAST(value * 60000000 AS BIGINT)) AS e FROM events)
SELECT event_id, greatest(b, TIMESTAMP '2024-01-10') AS b, least(e, TIMESTAMP '2024-01-12') AS e FROM r WHERE b <= TIMESTAMP '2024-01-12' AND e >= TIMESTAMP '2024-01-10'
""")
def trim_ranges(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").alias("b"), from_us(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 60000000).cast("bigint")).alias("e"))
    return Series.of(e, begin="b", end="e").trim(LO, HI).df


@query("SELECT event_id, ts, user_id, event_type, value FROM events e WHERE ts > (SELECT max(ts) FROM events m WHERE m.user_id = e.user_id) - INTERVAL 2 DAY")
def tail_of_each(spark, d):
    return events(spark, d).partition_by("user_id").tail("2d").df


@query("""
WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT event_id, user_id, 'slice' AS part FROM n WHERE n > 2 AND n <= c - 3 UNION ALL SELECT event_id, user_id, 'stride' FROM n WHERE n % 4 = 0 UNION ALL SELECT event_id, user_id, 'second last' FROM n WHERE n = c - 1
""")
def positions(spark, d):
    s = events(spark, d).partition_by("user_id")
    one = lambda df, name: df.select("event_id", "user_id", F.lit(name).alias("part"))
    return one(s.slice(2, -3).df, "slice").union(one(s.sample(4).df, "stride")).union(one(s.at_index(-2), "second last"))


@query("""
WITH t AS (SELECT TIMESTAMP '2024-01-15 12:00:00' AS t), r AS (SELECT user_id, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY abs(epoch_us(ts) - epoch_us(t)), ts) AS near, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN ts <= t THEN ts END DESC NULLS LAST) AS before, ts <= t AS early FROM events, t)
SELECT user_id, max(CASE WHEN near = 1 THEN event_id END) AS nearest, max(CASE WHEN before = 1 AND early THEN event_id END) AS before FROM r GROUP BY 1
""")
def point_lookups(spark, d):
    s = events(spark, d).partition_by("user_id")
    t = datetime(2024, 1, 15, 12)
    return s.nearest(t).select("user_id", F.col("event_id").alias("nearest")).join(s.at_or_before(t).select("user_id", F.col("event_id").alias("before")), "user_id", "left")


@query("""
WITH u AS (SELECT DISTINCT user_id FROM events)
SELECT e.event_id, (SELECT count(*) FROM events f WHERE f.user_id = e.user_id AND f.ts <= e.ts) AS seen, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey AS user_id, epoch_us(o_orderdate) AS t, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.user_id AND epoch_us(e.ts) >= o.t
""")
def as_of_orders(spark, d):
    e = events(spark, d)
    right = Series.of(table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderdate", "o_orderkey", F.col("o_orderkey").alias("k")), time="o_orderdate", seq="k").partition_by("user_id")
    got = joins.as_of(e.df.select("event_id", "user_id", "ts"), F.unix_micros(F.col("ts").cast("timestamp")), right)
    seen = windows.cumulative(e.partition_by("user_id").map({"seen": F.lit(1.0)}), {"seen": "count"}).df.select("event_id", F.col("seen").cast("bigint").alias("seen"))
    return got.join(seen, "event_id").select("event_id", "seen", "o_orderkey")


@query("""
SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS mean, round(CAST(list_max(embedding) AS DOUBLE), 6) AS high, len(embedding) AS n,
  round(quantile_cont(CAST(x AS DOUBLE), 0.9), 6) AS p90 FROM (SELECT vec_id, embedding, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id, embedding
""")
def array_aggregates(spark, d):
    s = Series.of(table(spark, d, "embeddings").select("vec_id", "embedding"), value="vec_id")
    for out, how in (("mean", "avg"), ("high", "max"), ("n", "count"), ("p90", "p90")):
        s = arrays.aggregate(s, "embedding", how, out)
    return s.df.select("vec_id", *r6("mean"), F.round(F.col("high"), 6).alias("high"), "n", *r6("p90"))


@query("""
WITH t AS (SELECT doc_id, list_filter(string_split(lower(source), ''), lambda x: x <> '') AS tags FROM documents)
SELECT doc_id, unnest(tags) AS tag FROM t WHERE list_contains(tags, '1') AND NOT list_contains(tags, '9')
""")
def array_filters(spark, d):
    tags = F.filter(F.split(F.lower("source"), ""), lambda x: x != "")
    s = Series.of(table(spark, d, "documents").select("doc_id", tags.alias("tags")), value="doc_id")
    s = arrays.contains_any(arrays.contains_all(s, "tags", ["1"]), "tags", ["1", "x"]).filter(~F.array_contains("tags", "9"))
    return arrays.explode(s, "tags", "tag").df.select("doc_id", "tag")


@query("""
WITH b AS (SELECT event_type, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events GROUP BY 1), x AS (SELECT e.event_type, e.event_id, e.value, CAST(least(floor((epoch_us(ts) - lo) / CAST(hi - lo AS DOUBLE) * 50), 49) AS BIGINT) AS bucket FROM events e JOIN b USING (event_type)),
a AS (SELECT event_type, bucket, arg_min(value, event_id) AS head, arg_max(value, event_id) AS last, min(value) AS min, max(value) AS max FROM x GROUP BY 1, 2), g AS (SELECT event_type, unnest(range(50)) AS bucket FROM b)
SELECT event_type, bucket, head, last, min, max FROM g LEFT JOIN a USING (event_type, bucket)
""")
def m4_decimation(spark, d):
    return columns.m4(events(spark, d).partition_by("event_type"), "value", 50).select("event_type", "bucket", F.col("first").alias("head"), "last", "min", "max")


@query("""
WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events)
SELECT event_type, CAST(floor((n * 20 - 1) / c) AS BIGINT) AS bin, round(avg(value), 6) AS value FROM n GROUP BY 1, 2
""")
def bin_by_index(spark, d):
    return columns.bin_by_index(events(spark, d).partition_by("event_type"), "value", 20, "avg").select("event_type", "bin", *r6("value"))


@query(GAPPY + """
SELECT event_type, count(*) FILTER (value IS NULL) > 0 AS has_missing, count(*) FILTER (value IS NULL) AS null_count, arg_min(value, CASE WHEN value IS NOT NULL THEN event_id END) AS first_defined, count(DISTINCT user_id) AS unique_count FROM e GROUP BY 1
""")
def column_reads(spark, d):
    s = gappy(spark, d)
    out = columns.missing(s, "value").join(columns.ends(s, "value").select("event_type", "first_defined"), "event_type")
    return out.join(columns.unique_count(s, "user_id"), "event_type")


@query("""
WITH p AS (SELECT event_id, user_id, ts, value / 10 AS lat, event_id % 90 / 10.0 AS lng FROM events),
s AS (SELECT user_id, lat, lng, lag(lat) OVER w AS a, lag(lng) OVER w AS b FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, round(coalesce(sum(2 * 6371008.8 * asin(sqrt(CASE WHEN a IS NOT NULL THEN least(1.0, pow(sin((radians(lat) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(lat)) * pow(sin((radians(lng) - radians(b)) / 2), 2)) END))), 0.0), 2) AS meters FROM s GROUP BY 1
""")
def track_distance(spark, d):
    s = events(spark, d).partition_by("user_id").map({"lat": F.col("value") / 10, "lng": (F.col("event_id") % 90) / 10.0})
    return track.total_distance(s).select("user_id", F.round("meters", 2).alias("meters"))


@query("""
WITH x AS (SELECT user_id, value, least(greatest(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 0), 0), 10) AS dt, avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 29999999 MICROSECOND PRECEDING AND CURRENT ROW) AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, round(avg(value), 6) AS average, max(value) AS max, round(sum(value * dt) / 1000, 6) AS work_kj, round(pow(avg(pow(r, 4)), 0.25), 6) AS normalized FROM x GROUP BY 1
""")
def power_summary(spark, d):
    s = events(spark, d).partition_by("user_id").map({"power": F.col("value")})
    return track.power_summary(s).select("user_id", *r6("average"), "max", *r6("work_kj", "normalized"))


@query("""
WITH x AS (SELECT event_id, avg(value) OVER w AS a, count(*) OVER w AS c, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING))
SELECT event_id, round(CASE WHEN c >= 5 THEN a END, 6) AS mean, round(CASE WHEN c >= 5 THEN a END * 2, 6) AS twice, round(dv, 6) AS step FROM x
""")
def plan_outputs(spark, d):
    mean = builder.col("value").op("sma", period=5)
    spec = builder.plan(mean=mean, twice=builder.col("value").op("sma", period=5.0).op("scale", by=2), step=builder.col("value").op("diff"), id=builder.col("event_id"))
    out, _ = plan.run(events(spark, d).partition_by("user_id"), plan.standard_ops(), spec)
    return out.select(F.col("id").alias("event_id"), *r6("mean", "twice", "step"))


@query("""
WITH l AS (SELECT user_id, arg_max(value, event_id) AS last, min(value) AS low, max(value) AS high FROM events GROUP BY 1)
SELECT user_id, any_value(last) AS last, any_value(low) AS low, any_value(high) AS high, round(count(*) FILTER (value < last) / count(*), 6) AS percentile_rank FROM events JOIN l USING (user_id) GROUP BY 1
""")
def plan_facts(spark, d):
    return plan.facts(events(spark, d).partition_by("user_id"), "value").select("user_id", "last", "low", "high", "percentile_rank")


# -- streams: the events file as a stream, into files of the shared folder, read back ------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque*").withColumn("ts", F.col("ts").cast("timestamp")).drop("props")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared checkpoint folder; one of this machine only under a local master."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or f"{tempfile.gettempdir()}/checkpoints")
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _drain(spark: SparkSession, out: DataFrame) -> DataFrame:
    folder = shared_folder(spark, "stream")
    out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


@query("""
WITH a AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS b, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2)
SELECT event_type, b AS "begin", n, mean FROM a WHERE b + INTERVAL 1 HOUR <= (SELECT time_bucket(INTERVAL 1 MILLISECOND, max(ts)) FROM events)
""")
def live_tumbling(spark, d):
    src = live.Live(_stream(spark, d), "ts", ("event_type",))
    out = src.aggregate("1h", {"n": ("value", "count"), "mean": ("value", "avg")})
    return _drain(spark, out).select("event_type", F.col("begin").cast("timestamp_ntz").alias("begin"), "n", *r6("mean"))


@query("""
SELECT user_id, ts, CAST(count(value) OVER w AS DOUBLE) AS n, round(avg(value) OVER w, 6) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)
""")
def live_rolling(spark, d):
    src = live.Live(_stream(spark, d), "ts", ("user_id",))
    out = src.through(live.Rolling({"1d": {"n": ("value", "count"), "mean": ("value", "avg")}}), "event_id")
    return _drain(spark, out).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "n", *r6("mean"))


@query("""
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 7 >= 2 THEN value END AS value FROM events)
SELECT event_id, last_value(value IGNORE NULLS) OVER w AS value FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def live_fill(spark, d):
    src = _stream(spark, d).withColumn("value", F.when(F.col("event_id") % 7 >= 2, F.col("value")))
    return _drain(spark, live.Live(src, "ts", ("user_id",)).through(live.Fill({"value": "hold"}), "event_id")).select("event_id", "value")


@query("""
WITH c AS (SELECT event_id, user_id, ts, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS t FROM events)
SELECT event_id, round(t - lag(t) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS value FROM c
""")
def live_chain(spark, d):
    src = live.Live(_stream(spark, d), "ts", ("user_id",))
    out = src.through(live.Chain([live.Cumulative({"value": "sum"}), live.Change("diff", ["value"])]), "event_id")
    return _drain(spark, out).select("event_id", F.round("value", 4).alias("value"))


def entry(spark: SparkSession) -> DataFrame:
    return aggregate_hourly(spark, "/root/testdata/sf0.001")
