"""Queries for marks of limited width, stacks and gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import aggregate as agg
from .operators import marks
from .queries import GAPPY, events, gappy, query, r6
from .queries_rows import part, stack

BUCKETS = """
WITH b AS (SELECT event_type, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events GROUP BY 1), x AS (SELECT e.*, CAST(least(floor((epoch_us(ts) - lo) / CAST(hi - lo AS DOUBLE) * 40), 39) AS BIGINT) AS bucket FROM events e JOIN b USING (event_type)),
g AS (SELECT event_type, unnest(range(40)) AS bucket FROM b)
"""


@query(BUCKETS + """
, a AS (SELECT event_type, bucket, min(value) AS low, max(value) AS high, arg_min(value, event_id) AS head, arg_max(value, event_id) AS last, avg(value) AS mean, avg(user_id) AS users FROM x GROUP BY 1, 2), j AS (SELECT * FROM g LEFT JOIN a USING (event_type, bucket))
SELECT part, event_type, bucket, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(d, 6) AS d FROM (SELECT 'band' AS part, event_type, bucket, low - 1 AS a, high + 1 AS b, NULL AS c, NULL AS d FROM j UNION ALL SELECT 'ohlc', event_type, bucket, head, high, low, last FROM j
UNION ALL SELECT 'box', event_type, bucket, low - 1, head, high + 1, low FROM j UNION ALL SELECT 'bars', event_type, bucket, CASE WHEN low IS NOT NULL THEN least(low, 30.0) END, CASE WHEN low IS NOT NULL THEN greatest(high, 30.0) END, NULL, NULL FROM j
UNION ALL SELECT 'heat', event_type, bucket, round(mean, 6), round(users, 6), NULL, NULL FROM j)
""")
def marks_of_stretches(spark, d):
    s = events(spark, d).partition_by("event_type")
    s = s.with_column("under", F.col("value") - 1).with_column("over", F.col("value") + 1)
    none = F.lit(None).cast("double")
    made = {
        "band": (marks.band(s, "under", "over", 40), ("lower", "upper")), "ohlc": (marks.ohlc(s, 40, *["value"] * 4), ("open", "high", "low", "close")),
        "box": (marks.box(s, 40, ("under", "value", "value", "value", "over")), ("lower", "median", "upper", "q1")), "bars": (marks.bars(s, "value", 40, 30.0), ("lo", "hi")), "heat": (marks.heat(s, ["value", "user_id"], 40), ("value", "user_id")),
    }
    pick = lambda df, cols: [(F.round(cols[i], 6) if i < len(cols) else none).alias("abcd"[i]) for i in range(4)]
    return stack(*[part(df, name, "event_type", "bucket", *pick(df, cols)) for name, (df, cols) in made.items()])


@query("""
SELECT event_type, arg_min(event_id, epoch_us(ts)) AS event_id FROM events GROUP BY event_type, floor(epoch_us(ts) / 86400000000), floor(value / 25)
""")
def scatter_cells(spark, d):
    s = events(spark, d).partition_by("event_type")
    return marks.scatter(s, "value", (86_400_000_000, 25.0)).select("event_type", "event_id")


@query("""
SELECT event_id, round((value + user_id) / 2, 6) AS r0, CAST(event_id AS DOUBLE) AS r1 FROM events
""")
def heat_row_runs(spark, d):
    s = events(spark, d).with_column("id", F.col("event_id"))
    return marks.heat_rows(s, ["value", "user_id", "id"], 2).df.select("event_id", *r6("r0"), "r1")


@query(GAPPY + """
, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM e), k AS (SELECT *, lead(n) OVER w AS nx, lag(n) OVER w AS pv FROM n WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY n))
SELECT event_id, 'before' AS edge, nx - n - 1 AS "rows" FROM k WHERE nx > n + 1 UNION ALL SELECT event_id, 'after', n - pv - 1 FROM k WHERE pv < n - 1
""")
def gap_edges(spark, d):
    return marks.gap_edges(gappy(spark, d), "value").select("event_id", "edge", "rows")


@query("""
WITH h AS (SELECT date_trunc('day', ts) AS day, event_type AS name, sum(value) AS value, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS i FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1, 2)
SELECT day, CAST(i AS INTEGER) AS i, name, round(value, 4) AS value, round(coalesce(sum(value) OVER (PARTITION BY day ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 4) AS base FROM h
""")
def stacks_of_groups(spark, d):
    s = events(spark, d)
    s = type(s)(s.df.withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz")), "time", ("day",), (), "event_id")
    return marks.stacks_from_groups(s, "event_type", "value", ["view", "click", "error"]).select("day", "i", "name", F.round("value", 4).alias("value"), F.round("base", 4).alias("base"))


@query("""
SELECT event_type, CAST(floor(value / 20) * 20 AS DOUBLE) AS "begin", CAST(floor(value / 20) * 20 + 20 AS DOUBLE) AS "end", max(value) AS value FROM events GROUP BY 1, 2, 3
""")
def bars_of_bins(spark, d):
    bins = agg.by_column(events(spark, d).partition_by("event_type"), "value", {"top": ("value", "max")}, width=20.0)
    return marks.bars_from_bins(bins, "top", ["event_type"]).select("event_type", F.col("begin").cast("double").alias("begin"), F.col("end").cast("double").alias("end"), "value")


@query("SELECT event_id, 0 AS i, 'value' AS name, value FROM events UNION ALL SELECT event_id, 1, 'user_id', CAST(user_id AS DOUBLE) FROM events")
def columns_as_rows(spark, d):
    return marks.transposed(events(spark, d).df, ["value", "user_id"], ["event_id"])
