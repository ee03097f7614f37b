"""Queries for ways in and out, point queries, filters, projections, joins, bins and reads of columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.time import contained, contains, day_range, from_us, midpoint, overlaps, parse_time
from .operators import aggregate as agg
from .operators import arrays, columns, folds, gaps, grid, joins, windows
from .queries import GAPPY, HOURS, events, gappy, query, r6, shared_folder, table
from .series import Series
from .sources import tables

NOON = datetime(2024, 1, 15, 12)
T = "TIMESTAMP '2024-01-15 12:00:00'"


def part(df: DataFrame, name: str, *cols: str | Column) -> DataFrame:
    return df.select(F.lit(name).alias("part"), *cols)


def stack(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


# -- ways in and out ---------------------------------------------------------------


@query("SELECT way, CAST(r_regionkey AS DOUBLE) AS r_regionkey, r_name FROM region, (SELECT unnest(['rows', 'columns', 'arrow', 'points']) AS way)")
def intake_ways(spark, d):
    s = Series.of(table(spark, d, "region").select(F.col("r_regionkey").cast("double").alias("r_regionkey"), "r_name"), value="r_regionkey")
    schema, key = {"r_regionkey": "number", "r_name": "string"}, {"value": "r_regionkey"}
    points = [{"ts": r.ts, "r_name": r.r_name} for r in tables.to_points(s).collect()]  # five rows
    made = {
        "rows": tables.from_rows(spark, tables.to_rows(s), schema, **key),
        "columns": tables.from_columns(spark, tables.to_columns(s), schema, **key),
        "arrow": tables.from_arrow(spark, tables.to_arrow(s), **key),
        "points": tables.from_points(spark, points, schema, **key),
    }
    return stack(*[x.df.select(F.lit(way).alias("way"), "r_regionkey", "r_name") for way, x in made.items()])


@query("SELECT event_id, ts, user_id, value FROM events")
def json_round_trip(spark, d):
    s = events(spark, d).select("user_id", "value")
    folder = shared_folder(spark, "json")
    tables.to_json_rows(Series(s.df, "time", ("ts",))).write.text(folder)
    back = tables.from_json(spark, folder, {"event_id": "number", "ts": "time", "user_id": "number", "value": "number"}, "ts")
    return back.df.select(F.col("event_id").cast("bigint").alias("event_id"), "ts", F.col("user_id").cast("bigint").alias("user_id"), "value")


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view')")
def named_sources(spark, d):
    folder = shared_folder(spark, "source")
    tables.write(events(spark, d), folder, partition=["event_type"])
    sources = tables.Registry()
    sources.define("events", lambda: tables.read(spark, folder, time="ts", seq="event_id"))
    return sources.get("events").filter(F.col("event_type").isin("click", "view")).df.select("event_id", "event_type", "value")


@query("""
WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS s, strftime(ts, '%Y-%m') AS m, date_trunc('second', ts) AS t FROM events)
SELECT event_id, timezone('UTC', timezone('America/New_York', t)) AS local, t AS utc, CAST(m || '-01' AS TIMESTAMP) AS month FROM e
""")
def temporal_parsing(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    e = table(spark, d, "events").withColumn("s", text).withColumn("m", F.date_format("ts", "yyyy-MM"))
    return e.select("event_id", parse_time("s", "America/New_York").alias("local"), parse_time(F.concat("s", F.lit("Z")), "America/New_York").alias("utc"), parse_time("m").alias("month"))


# -- one row, or where it is -----------------------------------------------------


@query(f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT 'length' AS part, user_id, count(*) AS x FROM events GROUP BY 2
UNION ALL SELECT 'bisect', user_id, count(*) FILTER (ts < {T}) FROM events GROUP BY 2
UNION ALL SELECT 'after', user_id, arg_min(event_id, ts) FROM events WHERE ts >= {T} GROUP BY 2
UNION ALL SELECT 'find', user_id, arg_min(event_id, ts) FROM events WHERE value > 90 GROUP BY 2
UNION ALL SELECT 'first', user_id, arg_min(event_id, ts) FROM events GROUP BY 2
UNION ALL SELECT 'last', user_id, arg_max(event_id, ts) FROM events GROUP BY 2
UNION ALL SELECT 'third', user_id, event_id FROM n WHERE n = 3
UNION ALL SELECT 'begin', user_id, epoch_us(min(ts)) FROM events GROUP BY 2
UNION ALL SELECT 'end', user_id, epoch_us(max(ts)) FROM events GROUP BY 2
""")
def point_queries(spark, d):
    s = events(spark, d).partition_by("user_id")
    one = lambda df, name, x: part(df, name, "user_id", F.col(x).cast("bigint").alias("x"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = s.time_range()
    return stack(
        one(s.length(), "length", "length"), one(s.bisect(NOON), "bisect", "index"), one(s.at_or_after(NOON), "after", "event_id"), one(s.find(F.col("value") > 90), "find", "event_id"),
        one(s.first(), "first", "event_id"), one(s.last(), "last", "event_id"), one(s.at_index(2), "third", "event_id"),
        part(span, "begin", "user_id", us("begin").alias("x")), part(span, "end", "user_id", us("end").alias("x")),
    )


@query(f"""
WITH r AS (SELECT min(ts) AS lo, max(ts) AS hi, {T} AS t FROM events)
SELECT 'includes' AS part, EXISTS (SELECT 1 FROM events WHERE ts = {T}) AS x UNION ALL SELECT 'some', (SELECT bool_or(value > 90) FROM events) UNION ALL SELECT 'every', (SELECT bool_and(value > 0) FROM events)
UNION ALL SELECT 'extent overlaps', lo <= t + INTERVAL 1 DAY AND hi >= t FROM r UNION ALL SELECT 'extent contains', lo <= t AND hi >= t + INTERVAL 90 DAY FROM r
UNION ALL SELECT 'intersection', greatest(lo, t) = t AND least(hi, t + INTERVAL 90 DAY) = hi FROM r UNION ALL SELECT 'sorted', true
""")
def whole_series_checks(spark, d):
    from datetime import timedelta

    s = events(spark, d)
    day, far = NOON + timedelta(days=1), NOON + timedelta(days=90)
    lo, hi = s.extent_intersection(NOON, far)
    last = s.time_range().first().end
    got = {
        "includes": s.includes_key(NOON), "some": s.some(F.col("value") > 90), "every": s.every(F.col("value") > 0), "extent overlaps": s.extent_overlaps(NOON, day), "extent contains": s.extent_contains(NOON, far),
        "intersection": lo == NOON and hi == last, "sorted": s.validate().is_sorted_by("event_id"),
    }
    return spark.createDataFrame(list(got.items()), "part string, x boolean")


LATER = "TIMESTAMP '2024-01-17 12:00:00'"


@query(f"""
SELECT 'before' AS part, event_id FROM events WHERE ts < {T} UNION ALL SELECT 'after', event_id FROM events WHERE ts > {T}
UNION ALL SELECT 'within', event_id FROM events WHERE ts >= {T} AND ts <= {LATER} UNION ALL SELECT 'filter', event_id FROM events WHERE event_type = 'click' AND value > 50
UNION ALL SELECT 'by value', event_id FROM events WHERE value >= 10 AND value < 20
UNION ALL SELECT 'overlapping', event_id FROM events WHERE ts <= {LATER} AND ts + INTERVAL 1 HOUR >= {T}
UNION ALL SELECT 'contained', event_id FROM events WHERE ts >= {T} AND ts + INTERVAL 1 HOUR <= {LATER}
""")
def key_filters(spark, d):
    s = events(spark, d)
    hi = datetime(2024, 1, 17, 12)
    r = Series.of(s.df.withColumn("e", F.col("ts") + F.expr("interval 1 hour")), begin="ts", end="e", seq="event_id")
    axis = Series.of(s.df.select("event_id", "value"), value="value")
    all_ = {"before": s.before(NOON), "after": s.after(NOON), "within": s.within(NOON, hi), "filter": s.filter("event_type = 'click'").filter(F.col("value") > 50), "by value": axis.slice_by_value(10, 20), "overlapping": r.overlapping(NOON, hi), "contained": r.contained_by(NOON, hi)}
    return stack(*[part(x.df, name, "event_id") for name, x in all_.items()])


@query(f"""
WITH e AS (SELECT event_id, ts AS b, ts + to_microseconds(CAST(value * 60000000 AS BIGINT)) AS e FROM events)
SELECT event_id, b <= {LATER} AND e >= {T} AS overlaps, b >= {T} AND e <= {LATER} AS contained, b <= {T} AND e >= {T} AS contains, make_timestamp(CAST(floor((epoch_us(b) + epoch_us(e)) / 2) AS BIGINT)) AS middle,
  timezone('UTC', timezone('America/New_York', CAST(CAST(b AS DATE) AS TIMESTAMP))) AS day_begin, timezone('UTC', timezone('America/New_York', CAST(CAST(b AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY)) AS day_end FROM e
""")
def extent_predicates(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").alias("b"), from_us(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 60000000).cast("bigint")).alias("e"))
    b, x, lo, hi = F.col("b"), F.col("e"), F.lit(NOON), F.lit(datetime(2024, 1, 17, 12))
    first, last = day_range(b, "America/New_York")
    return e.select("event_id", overlaps(b, x, lo, hi).alias("overlaps"), contained(b, x, lo, hi).alias("contained"), contains(b, x, lo, lo).alias("contains"), midpoint(b, x).alias("middle"), first.alias("day_begin"), last.alias("day_end"))


@query("SELECT user_id, least(count(*), 5) AS n, count(DISTINCT event_id) > 0 AS some FROM events GROUP BY 1")
def reservoir_sizes(spark, d):
    s = events(spark, d).partition_by("user_id").sample(reservoir=5, seed=7)
    return s.df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("event_id") > 0).alias("some"))


# -- columns and keys ----------------------------------------------------------------


@query("SELECT event_id, ts, upper(event_type) AS kind, value * 2 AS double, value + user_id AS both, round(value, 0) AS whole FROM events")
def projections(spark, d):
    s = events(spark, d).rename({"event_type": "kind"})
    s = s.with_column("double", F.col("value") * 2).with_column("whole", F.col("value")).map_columns({"kind": F.upper, "whole": F.round})
    s = s.collapse(["value", "user_id"], "both", lambda a, b: a + b)
    return s.select("kind", "double", "both", "whole").df


@query("""
WITH e AS (SELECT event_id, event_type, ts AS b, ts + to_microseconds(CAST(value * 60000000 AS BIGINT)) AS e, value FROM events)
SELECT 'begin' AS part, event_id, b AS time FROM e UNION ALL SELECT 'center', event_id, make_timestamp(CAST(floor((epoch_us(b) + epoch_us(e)) / 2) AS BIGINT)) FROM e UNION ALL SELECT 'end', event_id, e FROM e
UNION ALL SELECT 'range', event_id, b FROM e UNION ALL SELECT 'interval', event_id, e FROM e WHERE event_type = 'view'
""")
def key_changes(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.col("ts").alias("b"), from_us(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 60000000).cast("bigint")).alias("e"))
    r = Series.of(e, begin="b", end="e", seq="event_id")
    points = [part(r.as_time(at).df, at, "event_id", "time") for at in ("begin", "center", "end")]
    lab = r.as_interval(F.col("event_type"))
    return stack(*points, part(r.as_range().df, "range", "event_id", F.col("begin").alias("time")), part(lab.filter("label = 'view'").df, "interval", "event_id", F.col("end").alias("time")))


@query("SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, -o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def value_axis_and_concat(spark, d):
    o = Series.of(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus"), time="o_orderdate")
    a = o.select("o_orderkey", "o_totalprice")
    b = o.filter("o_orderstatus = 'F'").map({"o_orderkey": F.col("o_orderkey"), "o_totalprice": -F.col("o_totalprice")})
    return a.concat(b).by_value("o_totalprice").df.select("o_orderkey", "o_totalprice")


# -- joins, duplicates, partitions -----------------------------------------------------


@query("""
WITH k AS (SELECT date_trunc('day', ts) AS day, event_type, value, row_number() OVER (PARTITION BY date_trunc('day', ts), event_type ORDER BY event_id) AS n FROM events)
SELECT day, max(value) FILTER (event_type = 'click') AS a, max(value) FILTER (event_type = 'view') AS b, max(value) FILTER (event_type = 'error') AS c FROM k WHERE event_type IN ('click', 'view', 'error') GROUP BY day, n
""")
def join_many_outer(spark, d):
    e = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    side = lambda kind, out: Series.of(e.filter(F.col("event_type") == kind).select("day", "event_id", F.col("value").alias(out)), time="day", seq="event_id")
    return joins.join_many([side("click", "a"), side("view", "b"), side("error", "c")]).df.select("day", "a", "b", "c")


NULLS = "WITH e AS (SELECT event_id, ts, value, CASE WHEN user_id % 4 > 0 THEN 'h' || user_id % 4 END AS host FROM events)"


def hosts(spark, d) -> Series:
    h = F.col("user_id") % 4
    return events(spark, d).map({"value": F.col("value"), "host": F.when(h > 0, F.concat(F.lit("h"), h.cast("string")))}).partition_by("host")


@query(NULLS + """
, a AS (SELECT host, date_trunc('day', ts) AS k, value AS a, row_number() OVER (PARTITION BY host, date_trunc('day', ts) ORDER BY event_id) AS n FROM e WHERE event_id % 2 = 0),
b AS (SELECT host, date_trunc('day', ts) AS k, value AS b, row_number() OVER (PARTITION BY host, date_trunc('day', ts) ORDER BY event_id) AS n FROM e WHERE event_id % 3 = 0)
SELECT coalesce(a.host, b.host) AS host, coalesce(a.k, b.k) AS day, a, b FROM a FULL JOIN b ON a.host IS NOT DISTINCT FROM b.host AND a.k = b.k AND a.n = b.n
""")
def join_null_hosts(spark, d):
    s = hosts(spark, d)
    day = s.df.withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    side = lambda k, out: Series.of(day.filter(F.col("event_id") % k == 0).select("day", "host", "event_id", F.col("value").alias(out)), time="day", seq="event_id").partition_by("host")
    return joins.join(side(2, "a"), side(3, "b")).df.select("host", "day", "a", "b")


@query(NULLS + """
, b AS (SELECT host, min(ts) AS lo, max(ts) AS hi FROM e GROUP BY 1), g AS (SELECT host, unnest(generate_series(CASE WHEN date_trunc('hour', lo) = lo THEN lo ELSE date_trunc('hour', lo) + INTERVAL 1 HOUR END, hi, INTERVAL 1 HOUR)) AS h FROM b),
a AS (SELECT host, date_trunc('hour', ts) AS h, arg_min(value, event_id) AS head FROM e GROUP BY 1, 2), r AS (SELECT g.host, g.h, count(value) AS n, round(sum(value), 6) AS t FROM g LEFT JOIN e ON e.host IS NOT DISTINCT FROM g.host AND e.ts > g.h - INTERVAL 3 HOUR AND e.ts <= g.h GROUP BY 1, 2)
SELECT g.host, g.h AS "time", a.head, r.n, coalesce(r.t, 0.0) AS t FROM g LEFT JOIN a ON a.host IS NOT DISTINCT FROM g.host AND a.h = g.h JOIN r ON r.host IS NOT DISTINCT FROM g.host AND r.h = g.h
""")
def grid_null_hosts(spark, d):
    s = hosts(spark, d)
    head = agg.materialize(s, grid.hourly(), "first").df.select("host", "time", F.col("value").alias("head"))
    roll = windows.rolling_on(s, grid.hourly(), "3h", {"n": ("value", "count"), "t": ("value", "sum")}).df
    on = head["host"].eqNullSafe(roll["host"]) & (head["time"] == roll["begin"])
    return head.join(roll, on).select(head["host"], "time", "head", "n", *r6("t"))


@query(NULLS + """
, a AS (SELECT host, CAST(floor(value / 50) AS BIGINT) AS b, count(value) AS n, round(sum(value), 4) AS t FROM e GROUP BY 1, 2), g AS (SELECT host, unnest(generate_series(min(b), max(b))) AS b FROM a GROUP BY host),
z AS (SELECT unnest([{s: 0.0, e: 40.0}, {s: 40.0, e: 500.0}]) AS z), h AS (SELECT DISTINCT host FROM e)
SELECT 'width' AS part, g.host, CAST(g.b * 50 AS DOUBLE) AS "start", coalesce(n, 0) AS n, coalesce(t, 0.0) AS t FROM g LEFT JOIN a ON a.host IS NOT DISTINCT FROM g.host AND a.b = g.b
UNION ALL SELECT 'edges', h.host, CAST(z.s AS DOUBLE), count(value), round(coalesce(sum(value), 0.0), 4) FROM h CROSS JOIN z LEFT JOIN e ON e.host IS NOT DISTINCT FROM h.host AND value >= z.s AND value < z.e GROUP BY 1, 2, 3
UNION ALL SELECT 'tail', host, NULL, count(*), round(sum(value), 4) FROM e WHERE ts > (SELECT max(ts) FROM e m WHERE m.host IS NOT DISTINCT FROM e.host) - INTERVAL 3 DAY GROUP BY 2
""")
def bins_null_hosts(spark, d):
    s, m = hosts(spark, d), {"n": ("value", "count"), "t": ("value", "sum")}
    cols = ("host", F.col("start").cast("double").alias("start"), "n", F.round("t", 4).alias("t"))
    tail = agg.reduce_all(s.tail("3d"), m).withColumn("start", F.lit(None).cast("double"))
    return stack(part(agg.by_column(s, "value", m, width=50.0), "width", *cols), part(agg.by_column(s, "value", m, edges=[0.0, 40.0, 500.0]), "edges", *cols), part(tail, "tail", *cols))


@query("""
WITH o AS (SELECT o_orderdate AS k, o_orderkey AS i, o_totalprice AS p, o_custkey AS c FROM orders), n AS (SELECT *, count(*) OVER (PARTITION BY k) AS cnt, row_number() OVER (PARTITION BY k ORDER BY i) AS f, row_number() OVER (PARTITION BY k ORDER BY p DESC, i) AS m, row_number() OVER (PARTITION BY k ORDER BY i DESC) AS l FROM o)
SELECT 'first' AS part, k, i, p FROM n WHERE f = 1 UNION ALL SELECT 'drop', k, i, p FROM n WHERE cnt = 1 UNION ALL SELECT 'max', k, i, p FROM n WHERE m = 1
UNION ALL SELECT 'merge', k, min(i), round(sum(p), 6) FROM o GROUP BY 2 UNION ALL SELECT 'resolver', k, max(i), round(sum(p) / count(*), 6) FROM o GROUP BY 2
""")
def dedupe_others(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderdate").alias("k"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("p"))
    s = Series.of(o, time="k", seq="i")
    mean = lambda rows: F.struct((F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["p"]) / F.size(rows)).alias("p"))
    all_ = {"first": "first", "drop": "drop", "max": {"max": "p"}, "merge": {"merge": {"p": "sum"}}, "resolver": mean}
    return stack(*[part(joins.dedupe(s, how).df, name, "k", "i", F.round("p", 6).alias("p")) for name, how in all_.items()])


@query("SELECT lower(event_type) AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def group_by_kind(spark, d):
    made = joins.group_by(events(spark, d), "event_type", lambda s: agg.reduce_all(s, {"n": ("event_id", "count"), "total": ("value", "sum")}) if "event_id" in s.values else agg.reduce_all(s, {"n": ("value", "count"), "total": ("value", "sum")}))
    return stack(*[x.select(F.lit(k).alias("kind"), "n", F.round("total", 4).alias("total")) for k, x in made.items()])


@query("""
SELECT date_trunc('day', ts) AS day, round(max(value) FILTER (event_type = 'click'), 6) AS click_value, round(max(value) FILTER (event_type = 'error'), 6) AS error_value, round(max(value) FILTER (event_type = 'purchase'), 6) AS purchase_value,
  round(max(value) FILTER (event_type = 'signup'), 6) AS signup_value, round(max(value) FILTER (event_type = 'view'), 6) AS view_value FROM events GROUP BY 1
""")
def pivot_found_groups(spark, d):
    e = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz")).select("day", "event_id", "event_type", "value")
    out = joins.pivot_by_group(Series.of(e, time="day", seq="event_id"), "event_type", "value", aggregate="max").df
    return out.select("day", *r6(*[c for c in out.columns if c.endswith("_value")]))


@query("SELECT user_id, round(sum(value), 4) AS total FROM events WHERE value > 20 GROUP BY 1")
def partitioned_apply(spark, d):
    s = events(spark, d).partition_by("user_id").apply(lambda x: x.filter("value > 20"))
    out = windows.cumulative(s.map({"total": F.col("value")}), {"total": "sum"})
    return out.last().select("user_id", F.round("total", 4).alias("total"))


# -- gaps, grids, reducers -------------------------------------------------------------


FILLED = GAPPY + """
, n AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY event_type) AS c, min(epoch_us(ts)) OVER (PARTITION BY event_type) AS t0, max(epoch_us(ts)) OVER (PARTITION BY event_type) AS t1 FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
x AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN {v: value, t: epoch_us(ts), n: rn} END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS p,
  first_value(CASE WHEN value IS NOT NULL THEN {v: value, t: epoch_us(ts), n: rn} END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM n),
y AS (SELECT *, CASE WHEN p IS NOT NULL AND f IS NOT NULL THEN f.t - p.t WHEN p IS NOT NULL THEN t1 - p.t WHEN f IS NOT NULL THEN f.t - t0 ELSE 0 END AS len, coalesce(f.n, c + 1) - coalesce(p.n, 0) - 1 AS cells FROM x)
SELECT event_id, event_type, coalesce(value, f.v) AS back, coalesce(value, CASE WHEN cells <= 1 THEN -1.0 END) AS literal, coalesce(value, CASE WHEN len <= 7200000000 THEN 0.0 END) AS zero FROM y
"""


def _fills(s: Series) -> DataFrame:
    s = s.map({c: F.col("value") for c in ("back", "literal", "zero")})
    s = gaps.fill(gaps.fill(s, {"back": "bfill"}), {"literal": {"literal": -1.0}}, limit=1)
    return gaps.fill(s, {"zero": "zero"}, max_gap="2h").df.select("event_id", "event_type", "back", "literal", "zero")


@query(FILLED)
def fills_others(spark, d):
    return _fills(gappy(spark, d))


@query(FILLED)
def fills_dealt(spark, d):
    return _fills(gappy(spark, d).dealt("1d"))


@query(HOURS + """
, p AS (SELECT g.*, e.ts AS t0, e.value AS v0 FROM g ASOF LEFT JOIN events e ON g.event_type = e.event_type AND g.h >= e.ts),
n AS (SELECT p.*, e.ts AS t1, e.value AS v1 FROM p ASOF LEFT JOIN events e ON p.event_type = e.event_type AND p.h <= e.ts)
SELECT event_type, h AS "begin", round(CASE WHEN t1 > t0 THEN v0 + (v1 - v0) * ((epoch_us(h) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0))) ELSE v0 END, 6) AS value FROM n
""")
def align_linear_dealt(spark, d):
    s = events(spark, d).select("value", "event_type").partition_by("event_type").dealt("1d")
    return agg.align(s, grid.hourly(), "linear").df.select("event_type", "begin", *r6("value"))


@query("""
WITH n AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n, round(sum(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS total, count(*) OVER () AS c FROM events)
SELECT event_id, n, total, floor((n * 40 - 1) / c) AS bin FROM n WHERE n > 5 AND n <= c - 5
""")
def dealt_without_partitions(spark, d):
    s = events(spark, d).dealt("1d")
    s = windows.cumulative(s.map({"total": F.col("value")}), {"total": "sum"})
    df = s.ordered(number="n", whole={"c": ("count", F.lit(1))})
    kept = s.slice(5, -5).df.select("event_id")
    return df.join(kept, "event_id").select("event_id", "n", F.round("total", 3).alias("total"), F.floor((F.col("n") * 40 - 1) / F.col("c")).cast("double").alias("bin"))


@query("""
WITH g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:30:00', TIMESTAMP '2024-01-30 22:30:00', INTERVAL 1 HOUR)) AS m), lim AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
h AS (SELECT m - INTERVAL 30 MINUTE AS b, m FROM g, lim WHERE m >= lo AND m <= hi), a AS (SELECT date_trunc('hour', ts) AS b, arg_min(value, abs(epoch_us(ts) - epoch_us(date_trunc('hour', ts)) - 1800000000)) AS near FROM events GROUP BY 1)
SELECT h.b AS "begin", h.m AS "time", e.value AS held, a.near FROM (SELECT h.*, 1 AS one FROM h) h ASOF LEFT JOIN (SELECT *, 1 AS one FROM events) e ON h.one = e.one AND h.m >= e.ts LEFT JOIN a ON a.b = h.b
""")
def grid_centers(spark, d):
    s = events(spark, d).select("value")
    span = (datetime(2024, 1, 1), datetime(2024, 1, 30, 23))
    held = agg.align(s, grid.hourly(), "hold", "center", None).df.select("begin", F.col("value").alias("held"))
    near = agg.materialize(s, grid.hourly(), "nearest", "center").df.select("time", F.col("value").alias("near"))
    out = held.withColumn("time", F.col("begin") + F.expr("interval 30 minutes")).join(near, "time")
    return out.filter(F.col("time") < F.lit(span[1])).select("begin", "time", "held", "near")


@query("""
WITH l AS (SELECT *, timezone('America/New_York', timezone('UTC', ts)) AS local FROM events), d AS (SELECT date_trunc('day', local) AS day, count(value) AS n, round(avg(value), 6) AS mean FROM l GROUP BY 1)
SELECT timezone('UTC', timezone('America/New_York', day)) AS "begin", timezone('UTC', timezone('America/New_York', day + INTERVAL 1 DAY)) AS "end", n, mean FROM d WHERE timezone('UTC', timezone('America/New_York', day)) >= (SELECT min(ts) FROM events)
""")
def calendar_days_of_a_zone(spark, d):
    out = agg.aggregate(events(spark, d), grid.calendar("day", "America/New_York"), {"n": ("value", "count"), "mean": ("value", "avg")})
    return out.df.select("begin", "end", "n", *r6("mean"))


@query("""
WITH e AS (SELECT * , ts + INTERVAL 70 DAY * (event_id % 2) AS t FROM events), b AS (SELECT min(t) AS lo, max(t) AS hi FROM e),
m AS (SELECT unnest(generate_series(date_trunc('month', lo - INTERVAL 14 HOUR), hi + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS k FROM b), w AS (SELECT unnest(generate_series(date_trunc('week', lo) - INTERVAL 8 DAY, hi + INTERVAL 7 DAY, INTERVAL 7 DAY)) AS k FROM b),
u AS (SELECT 'month' AS unit, timezone('UTC', timezone('Australia/Sydney', k)) AS b, timezone('UTC', timezone('Australia/Sydney', k + INTERVAL 1 MONTH)) AS e FROM m UNION ALL SELECT 'week', timezone('UTC', timezone('Australia/Sydney', k)), timezone('UTC', timezone('Australia/Sydney', k + INTERVAL 7 DAY)) FROM w)
SELECT unit, u.b AS "begin", u.e AS "end", count(value) AS n, round(coalesce(sum(value), 0.0), 4) AS total FROM u CROSS JOIN b LEFT JOIN e ON t >= u.b AND t < u.e WHERE u.b >= lo AND u.b <= hi GROUP BY 1, 2, 3
""")
def calendar_weeks_and_months(spark, d):
    e = events(spark, d)
    e = Series.of(e.df.withColumn("t", from_us(F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("event_id") % 2) * 70 * 86_400_000_000)), time="t", seq="event_id")
    m = {"n": ("value", "count"), "total": ("value", "sum")}
    both = [agg.aggregate(e, grid.calendar(u, "Australia/Sydney", 7), m).df.withColumn("unit", F.lit(u)) for u in ("month", "week")]
    return stack(*both).select("unit", "begin", "end", "n", F.round("total", 4).alias("total"))


@query("""
SELECT user_id, list(value ORDER BY ts, event_id) AS samples, CASE WHEN min(event_type) = max(event_type) THEN min(event_type) END AS keep, round(sum(value * value), 6) AS squares, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1
""")
def reducers_samples_keep_own(spark, d):
    out = agg.reduce_all(events(spark, d).partition_by("user_id"), {"samples": ("value", "samples"), "keep": ("event_type", "keep"), "squares": ("value", lambda c: F.sum(c * c)), "spread": ("value", "difference")})
    return out.withColumns({"squares": F.round("squares", 6), "spread": F.round("spread", 6)})


@query("""
WITH x AS (SELECT *, CAST(least(floor((epoch_us(ts) - 1704067200000000) / 86400000000), 27) AS BIGINT) AS bin FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-29')
SELECT event_type, bin, min(value) AS low, max(value) AS high, arg_min(value, event_id) AS head, arg_max(value, event_id) AS last, count(value) AS n FROM x GROUP BY 1, 2
""")
def bins_by_key(spark, d):
    day = 86_400_000_000
    edges = [1_704_067_200_000_000 + i * day for i in range(29)]
    s = events(spark, d).partition_by("event_type")
    shape = columns.bin_by_key(s, "value", edges, "minMaxFirstLast")
    n = columns.bin_by_key(s, "value", edges, "count").select("event_type", "bin", F.col("value").alias("n"))
    out = shape.join(n, ["event_type", "bin"]).filter("n > 0")
    return out.select("event_type", "bin", F.col("value.min").alias("low"), F.col("value.max").alias("high"), F.col("value.first").alias("head"), F.col("value.last").alias("last"), "n")


@query(GAPPY + """
, o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS m FROM e)
SELECT event_type, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.99), 6) AS p99, max(value) FILTER (n = 1) AS head, max(value) FILTER (m = 1) AS last, arg_max(value, CASE WHEN value IS NOT NULL THEN event_id END) AS last_defined,
  bool_and(coalesce(value > 50, false)) AS "all", bool_or(value > 50) AS "any", NOT bool_or(coalesce(value > 50, false)) AS "none", count(*) FILTER (value > 50) AS hot, count(DISTINCT value) AS kinds FROM o GROUP BY 1
""")
def whole_column_reads(spark, d):
    s = gappy(spark, d)
    flag = s.with_column("hot", F.col("value") > 50)
    out = columns.describe(s, "value", "mean", "p99").join(columns.min_max(s, "value"), "event_type")
    out = out.join(columns.ends(s, "value").select("event_type", F.col("first").alias("head"), "last", "last_defined"), "event_type")
    out = out.join(columns.truth(flag, "hot").withColumnRenamed("count", "hot"), "event_type").join(columns.unique_count(s, "value").withColumnRenamed("unique_count", "kinds"), "event_type")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "p99")})


@query("""
WITH n AS (SELECT *, row_number() OVER w AS n, value BETWEEN 20 AND 80 AS ok FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)), g AS (SELECT *, n - row_number() OVER (PARTITION BY event_type ORDER BY n) AS g FROM n WHERE ok)
SELECT event_type, min(ts) AS "start", max(ts) AS "end", count(*) AS "rows" FROM g GROUP BY event_type, g
""")
def value_segments(spark, d):
    return columns.segments(events(spark, d).partition_by("event_type"), "value", 20, 80)


@query("""
WITH x AS (SELECT event_id, ts, value, user_id, event_type FROM events)
SELECT event_id, 0 AS i, 'value' AS name, value, 0.0 AS base FROM x UNION ALL SELECT event_id, 1, 'user_id', CAST(user_id AS DOUBLE), value FROM x
""")
def stacked_columns(spark, d):
    s = events(spark, d)
    keyed = Series(s.df.select("event_id", "ts", "value", "user_id"), "time", ("ts",), ("event_id",))
    return columns.stacked(keyed, ["value", "user_id"]).select("event_id", "i", "name", "value", "base")


@query("SELECT doc_id FROM documents WHERE list_contains(list_filter(string_split(lower(source), ''), lambda x: x <> ''), '1')")
def array_contains_one(spark, d):
    tags = F.filter(F.split(F.lower("source"), ""), lambda x: x != "")
    s = Series.of(table(spark, d, "documents").select("doc_id", tags.alias("tags")), value="doc_id")
    return arrays.contains(s, "tags", "1").df.select("doc_id")


# -- smoothing -------------------------------------------------------------------------


@query("""
WITH x AS (SELECT event_id, user_id, CAST(epoch_us(ts) AS DOUBLE) AS t, value AS y, count(*) OVER (PARTITION BY user_id) AS n FROM events),
p AS (SELECT a.event_id, a.user_id, b.t - a.t AS dx, b.y, a.n, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.t - a.t), b.t) AS k FROM x a JOIN x b USING (user_id)),
q AS (SELECT *, max(abs(dx)) OVER (PARTITION BY event_id) AS reach FROM p WHERE k <= greatest(2, least(n, CAST(ceil(0.3 * n) AS BIGINT)))),
w AS (SELECT *, CASE WHEN abs(dx) / reach < 1 THEN pow(1 - pow(abs(dx) / reach, 3), 3) ELSE 0 END AS w FROM q WHERE reach > 0),
s AS (SELECT event_id, user_id, sum(w) AS sw, sum(w * dx) AS sx, sum(w * y) AS sy, sum(w * dx * dx) AS sxx, sum(w * dx * y) AS sxy FROM w GROUP BY 1, 2)
SELECT event_id, user_id, round(CASE WHEN abs(sw * sxx - sx * sx) < 2.3e-16 THEN sy / sw ELSE (sy * sxx - sx * sxy) / (sw * sxx - sx * sx) END, 3) AS fit FROM s
UNION ALL SELECT event_id, user_id, round(y, 3) FROM x WHERE n = 1
""")
def smooth_loess(spark, d):
    return folds.loess(events(spark, d).partition_by("user_id"), "value", 0.3, output="fit").df.select("event_id", "user_id", F.round("fit", 3).alias("fit"))


@query("""
WITH l AS (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM events)
SELECT event_id, round(list_reduce(v, lambda a, x: a * 0.37 + x), 4) AS run FROM l
""")
def cumulate_own_step(spark, d):
    return folds.cumulate(events(spark, d).partition_by("user_id"), "value", lambda a, v: a * 0.37 + v, "run").df.select("event_id", F.round("run", 4).alias("run"))


@query("""
WITH c AS (SELECT unnest(CAST([50, 150, 1000] AS DOUBLE[])) AS c)
SELECT event_type, c AS center, count(value) AS n, round(avg(value), 6) AS mean FROM (SELECT DISTINCT event_type FROM events) h CROSS JOIN c LEFT JOIN events e USING (event_type) WHERE abs(value - c) <= 20 GROUP BY 1, 2
UNION ALL SELECT event_type, CAST(1000 AS DOUBLE), 0, NULL FROM (SELECT DISTINCT event_type FROM events)
""")
def rolling_at_centres(spark, d):
    s = events(spark, d).partition_by("event_type")
    out = windows.rolling_by_column(s, "value", 20.0, {"n": ("value", "count"), "mean": ("value", "avg")}, at=[50.0, 150.0, 1000.0])
    return out.select("event_type", "center", "n", *r6("mean"))

