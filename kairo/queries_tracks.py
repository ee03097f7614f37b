"""Queries for calendars, studies, tracks, power and plans."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from .activity import track
from .finance import sessions, studies
from .operators import aggregate as agg
from .operators.grid import to_us
from .plans import builder, plan
from .queries import MARKET, events, market, query, r6, table
from .queries_rows import part, stack
from .series import Series

# -- calendars ---------------------------------------------------------------------


@query(MARKET + """
, x AS (SELECT o, c, unnest(generate_series(o, c - INTERVAL 1 MICROSECOND, INTERVAL 2 HOUR)) AS b FROM s)
SELECT b AS "begin", least(b + INTERVAL 2 HOUR, c) AS "end", count(value) AS n, round(coalesce(sum(value), 0.0), 4) AS total FROM x LEFT JOIN events ON ts >= b AND ts < least(b + INTERVAL 2 HOUR, c) GROUP BY 1, 2
""")
def aggregate_bars(spark, d):
    out = agg.aggregate(events(spark, d), market().bar_sequence("2h"), {"n": ("value", "count"), "total": ("value", "sum")})
    return out.df.select("begin", "end", "n", F.round("total", 4).alias("total"))


@query(MARKET + """
, t AS (SELECT day + INTERVAL 12 HOUR AS t FROM d)
SELECT t, EXISTS (SELECT 1 FROM s WHERE t >= o AND t < c) AS is_open, EXISTS (SELECT 1 FROM s WHERE CAST(o AS DATE) = CAST(t AS DATE)) AS trading, (SELECT min(o) FROM s WHERE o > t) AS "next", (SELECT max(o) FROM s WHERE c <= t) AS previous,
  (SELECT count(*) FROM s WHERE o < t + INTERVAL 3 DAY AND c > t) AS coming, (SELECT CAST(coalesce(sum(greatest(0, epoch_us(least(c, t + INTERVAL 5 DAY)) - epoch_us(greatest(o, t)))), 0) AS BIGINT) FROM s) AS open_us, coalesce((SELECT o FROM s WHERE t >= o AND t < c), (SELECT min(o) FROM s WHERE o > t)) IS NOT NULL AS ahead FROM t
""")
def calendar_lookups(spark, d):
    c, rows = market(), []
    at = lambda s: None if s is None else datetime(1970, 1, 1) + timedelta(microseconds=s.open)
    for i in range(35):  # the days of the calendar
        t = datetime(2023, 12, 30, 12) + timedelta(days=i)
        ahead = any(s.close > to_us(t) for s in c.sessions)
        assert not ahead or c.clamp(t) >= to_us(t)
        rows.append((t, c.is_open(t), c.is_trading_day(t.date()), at(c.next_session(t)), at(c.previous_session(t)), len(c.sessions_in(t, t + timedelta(days=3))), c.distance(t, t + timedelta(days=5)), ahead))
    return spark.createDataFrame(rows, "t timestamp_ntz, is_open boolean, trading boolean, next timestamp_ntz, previous timestamp_ntz, coming bigint, open_us bigint, ahead boolean")


@query(MARKET + """
, k AS (SELECT *, coalesce(sum(epoch_us(c) - epoch_us(o)) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT event_id, CAST(coalesce(before + least(epoch_us(ts) - epoch_us(o), epoch_us(c) - epoch_us(o)), 0) AS BIGINT) AS open_us FROM events ASOF LEFT JOIN k ON ts >= o
""")
def open_time_axis(spark, d):
    return market().axis().compress(events(spark, d), "open_us").df.select("event_id", "open_us")


@query("""
WITH e AS (SELECT event_id, epoch_us(ts) AS u FROM events), w AS (SELECT *, u - 4 * 86400000000 - 1704067200000000 + 4 * 86400000000 AS x FROM e)
SELECT event_id, CAST(floor(x / 604800000000) * 432000000000 + least(x - floor(x / 604800000000) * 604800000000, 432000000000) AS BIGINT) AS open_us FROM w
""")
def weekend_free_axis(spark, d):
    axis = sessions.weekend_skip(datetime(2024, 1, 1), datetime(2024, 3, 4))
    return axis.compress(events(spark, d), "open_us").df.select("event_id", "open_us")


# -- studies -----------------------------------------------------------------------


@query("""
WITH n AS (SELECT *, count(*) OVER w AS c, stddev_pop(value) OVER w AS sd, min(value) OVER w AS low, max(value) OVER w AS high, avg(value) OVER w AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
  list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 7 PRECEDING))
SELECT event_id, round(CASE WHEN c >= 8 THEN sd END, 6) AS stdev, CASE WHEN c >= 8 THEN low END AS low, CASE WHEN c >= 8 THEN high END AS high, round(CASE WHEN c >= 8 THEN a END, 6) AS mid, round(CASE WHEN c >= 8 THEN a * 1.05 END, 8) AS over, round(CASE WHEN c >= 8 THEN a * 0.95 END, 8) AS under,
  round(CASE WHEN n >= 8 THEN list_reduce(v, lambda a, x: x * (2.0 / 9) + a * (7.0 / 9)) END, 5) AS ema FROM n
""")
def studies_others(spark, d):
    s = events(spark, d).partition_by("user_id")
    s = studies.rolling_stat(studies.rolling_stat(studies.rolling_stat(s, 8, "stdev", "value"), 8, "min", "value", "low"), 8, "max", "value", "high")
    s = studies.envelope(s, 8, 5.0, "value", names=("mid", "over", "under"))
    return studies.ema(s, 8, "value").df.select("event_id", *r6("stdev"), "low", "high", *r6("mid"), F.round("over", 8).alias("over"), F.round("under", 8).alias("under"), F.round("ema", 5).alias("ema"))


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER w AS c, avg(value) OVER w AS a, stddev_pop(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING))
SELECT event_id, round(CASE WHEN c >= 10 THEN a END, 6) AS mean, round(CASE WHEN c >= 10 THEN s END, 6) AS sd FROM n WHERE n BETWEEN 21 AND 40
""")
def ranged_mean_and_deviation(spark, d):
    return studies.ranged_moments(events(spark, d).partition_by("user_id"), 10, 20, 40, "value").df.select("event_id", *r6("mean", "sd"))


# -- tracks ------------------------------------------------------------------------


def _track(spark, d) -> Series:
    s = events(spark, d).partition_by("user_id")
    return s.map({"lat": F.col("value") / 10, "lng": (F.col("event_id") % 90) / 10.0, "ele": F.col("value"), "power": F.col("value") * 2, "hr": 80 + F.col("event_id") % 100})


TRACK = """
WITH p AS (SELECT event_id, user_id, ts, epoch_us(ts) / 1e6 AS t, value / 10 AS lat, event_id % 90 / 10.0 AS lng, value AS ele, value * 2 AS power, 80 + event_id % 100 AS hr FROM events),
s AS (SELECT *, lag(lat) OVER w AS a, lag(lng) OVER w AS b, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap, row_number() OVER w AS n FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, least(greatest(coalesce(gap, 0), 0), 10) AS dt, CASE WHEN a IS NULL THEN 0 ELSE 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(lat)) * pow(sin((radians(lng) - radians(b)) / 2), 2)))) END AS step FROM s),
k AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS dist FROM h)
"""


@query(TRACK + """
SELECT user_id, round(min(lat), 6) AS south, round(max(lat), 6) AS north, round(min(lng), 6) AS west, round(max(lng), 6) AS east, round(coalesce(sum(CASE WHEN gap > 0 AND step / gap >= 0.5 THEN gap END), 0.0), 6) AS seconds FROM k GROUP BY 1
""")
def track_bounds_and_moving_time(spark, d):
    s = _track(spark, d)
    return track.bounds(s).join(track.moving_time(s), "user_id").select("user_id", *r6("south", "north", "west", "east"), F.round("seconds", 6).alias("seconds"))


CLIMB = """
, l AS (SELECT user_id, list({level: ele, gain: 0.0, loss: 0.0} ORDER BY ts, event_id) AS v FROM k GROUP BY 1),
r AS (SELECT user_id, list_reduce(v, lambda a, x: CASE WHEN x.level - a.level >= 3 THEN {level: x.level, gain: a.gain + x.level - a.level, loss: a.loss} WHEN a.level - x.level >= 3 THEN {level: x.level, gain: a.gain, loss: a.loss + a.level - x.level} ELSE a END) AS z FROM l)
"""


@query(TRACK + CLIMB + "SELECT user_id, round(z.gain, 4) AS gain, round(z.loss, 4) AS loss FROM r")
def track_climb(spark, d):
    return track.elevation_gain_loss(_track(spark, d)).select("user_id", F.round("gain", 4).alias("gain"), F.round("loss", 4).alias("loss"))


@query(TRACK + """
, w AS (SELECT unnest(CAST([1000, 1000000] AS DOUBLE[])) AS m), j AS (SELECT x.user_id, m, x.event_id, min(y.t) - min(x.t) AS sec FROM k x JOIN k y ON x.user_id = y.user_id AND y.n >= x.n CROSS JOIN w WHERE y.dist >= x.dist + m GROUP BY 1, 2, 3)
SELECT u.user_id, w.m AS meters, round(min(sec), 6) AS seconds FROM (SELECT DISTINCT user_id FROM k) u CROSS JOIN w LEFT JOIN j ON j.user_id = u.user_id AND j.m = w.m GROUP BY 1, 2
""")
def track_best_efforts(spark, d):
    return track.best_efforts(_track(spark, d), [1000.0, 1000000.0]).select("user_id", "meters", F.round("seconds", 6).alias("seconds"))


@query(TRACK + """
SELECT user_id, CAST(floor(dist / 500000) AS BIGINT) AS split, min(ts) AS "begin", round(sum(step), 2) AS meters, round(sum(coalesce(gap, 0)), 6) AS seconds FROM k GROUP BY 1, 2
""")
def track_splits(spark, d):
    return track.splits(_track(spark, d).select("lat", "lng"), 500_000.0).select("user_id", "split", "begin", F.round("meters", 2).alias("meters"), F.round("seconds", 6).alias("seconds"))


# a step over a split's end is divided there in proportion, and so is its time
CUT = TRACK + """
, c AS (SELECT *, dist - step AS d0, CAST(floor((dist - step) / 500000) AS BIGINT) AS s0, CAST(floor(dist / 500000) AS BIGINT) AS s1 FROM k),
q AS (SELECT *, unnest(generate_series(s0, s1)) AS split FROM c),
f AS (SELECT *, CASE WHEN step > 0 THEN (least(dist, (split + 1) * 500000) - greatest(d0, split * 500000)) / step WHEN split = s1 THEN 1 ELSE 0 END AS share FROM q)
"""


@query(CUT + """
SELECT user_id, split, round(sum(step * share), 2) AS meters, round(sum(coalesce(gap, 0) * share), 2) AS seconds, round(sum(power * dt * share) / sum(dt * share), 4) AS power, max(power) AS top_power, round(sum(hr * dt * share) / sum(dt * share), 4) AS hr
FROM f GROUP BY 1, 2 HAVING sum(step * share) > 0.01
""")
def track_splits_with_channels(spark, d):
    out = track.splits_exact(_track(spark, d), 500_000.0, ("power", "hr")).filter("meters > 0.01")
    return out.select("user_id", "split", F.round("meters", 2).alias("meters"), F.round("seconds", 2).alias("seconds"), F.round("power", 4).alias("power"), F.col("max_power").alias("top_power"), F.round("hr", 4).alias("hr"))


@query(TRACK + """
, z AS (SELECT unnest([{s: 0.0, e: 100.0}, {s: 100.0, e: 200.0}, {s: 200.0, e: 1e308}]) AS z), u AS (SELECT DISTINCT user_id FROM k)
SELECT 'zones' AS part, u.user_id, CAST(z.s AS DOUBLE) AS "start", round(coalesce(sum(dt), 0.0), 6) AS seconds FROM u CROSS JOIN z LEFT JOIN k ON k.user_id = u.user_id AND (power > z.s OR (z.s = 0 AND power = 0)) AND power <= z.e GROUP BY 1, 2, 3
UNION ALL SELECT 'watts', g.user_id, CAST(g.b * 25 AS DOUBLE), round(coalesce(sum(dt), 0.0), 6) FROM (SELECT user_id, unnest(generate_series(CAST(min(floor(power / 25)) AS BIGINT), CAST(max(floor(power / 25)) AS BIGINT))) AS b FROM k GROUP BY 1) g LEFT JOIN k ON k.user_id = g.user_id AND floor(power / 25) = g.b GROUP BY 1, 2, 3
""")
def track_zones_and_distribution(spark, d):
    s = _track(spark, d)
    cols = ("user_id", F.col("start").cast("double").alias("start"), F.round("seconds", 6).alias("seconds"))
    return stack(part(track.zones(s, "power", [0.0, 100.0, 200.0]), "zones", *cols), part(track.power_distribution(s), "watts", *cols))


@query(TRACK + """
, r AS (SELECT *, avg(power) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 29999999 MICROSECOND PRECEDING AND CURRENT ROW) AS r FROM k),
x AS (SELECT user_id, avg(power) AS average, max(power) AS max, pow(avg(pow(r, 4)), 0.25) AS np, max(t) - min(t) AS time, sum(step) AS meters FROM r GROUP BY 1)
SELECT user_id, round(meters, 2) AS meters, round(average, 4) AS average, max, round(np / 250, 6) AS intensity, round(time / 3600 * pow(np / 250, 2) * 100, 2) AS load, round(z.gain, 4) AS gain FROM x JOIN (WITH l AS (SELECT user_id, list({level: ele, gain: 0.0, loss: 0.0} ORDER BY ts, event_id) AS v FROM k GROUP BY 1)
SELECT user_id, list_reduce(v, lambda a, x: CASE WHEN x.level - a.level >= 3 THEN {level: x.level, gain: a.gain + x.level - a.level, loss: a.loss} WHEN a.level - x.level >= 3 THEN {level: x.level, gain: a.gain, loss: a.loss + a.level - x.level} ELSE a END) AS z FROM l) USING (user_id)
""")
def track_summary(spark, d):
    out = track.summary(_track(spark, d), ftp=250.0)
    return out.select("user_id", F.round("meters", 2).alias("meters"), F.round("average", 4).alias("average"), "max", *r6("intensity"), F.round("load", 2).alias("load"), F.round("gain", 4).alias("gain"))


CURVE = TRACK + """
, c AS (SELECT user_id, n, power, sum(dt) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS time, sum(power * dt) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS work FROM k),
z AS (SELECT user_id, n, time, work FROM c UNION ALL SELECT DISTINCT user_id, 0, 0.0, 0.0 FROM c), w AS (SELECT unnest(CAST([33.3, 123.4, 301.7] AS DOUBLE[])) AS want),
j AS (SELECT y.user_id, want, y.n, max(x.n) AS m FROM z x JOIN z y ON x.user_id = y.user_id AND x.n < y.n CROSS JOIN w WHERE y.time - x.time >= want GROUP BY 1, 2, 3),
b AS (SELECT j.user_id, want, max((y.work - x.work) / (y.time - x.time)) AS watts FROM j JOIN z y ON y.user_id = j.user_id AND y.n = j.n JOIN z x ON x.user_id = j.user_id AND x.n = j.m GROUP BY 1, 2),
g AS (SELECT user_id, want, min(watts) OVER (PARTITION BY user_id ORDER BY want ROWS UNBOUNDED PRECEDING) AS watts FROM b)
"""


@query(CURVE + "SELECT user_id, want AS duration, round(watts, 6) AS watts FROM g")
def track_power_curve(spark, d):
    return track.power_curve(_track(spark, d), [33.3, 123.4, 301.7]).select("user_id", "duration", *r6("watts"))


@query(CURVE + "SELECT user_id, want AS duration, floor(watts + 0.5) AS watts, round(watts / 70, 6) AS per_kg FROM g")
def track_power_efforts(spark, d):
    return track.power_best_efforts(_track(spark, d), weight_kg=70.0, durations=[33.3, 123.4, 301.7]).select("user_id", "duration", "watts", *r6("per_kg"))


@query(TRACK + """
, z AS (SELECT unnest([{i: 1, l: 'Recovery', s: 0.0, e: 129.0}, {i: 2, l: 'Endurance', s: 129.0, e: 160.0}, {i: 3, l: 'Tempo', s: 160.0, e: 176.0}, {i: 4, l: 'Threshold', s: 176.0, e: 192.0}, {i: 5, l: 'Anaerobic', s: 192.0, e: 1e9}]) AS z), u AS (SELECT DISTINCT user_id FROM k),
g AS (SELECT u.user_id, z.i AS zone, z.l AS label, coalesce(sum(dt), 0.0) AS seconds FROM u CROSS JOIN z LEFT JOIN k ON k.user_id = u.user_id AND (hr > z.s OR (z.s = 0 AND hr = 0)) AND hr <= z.e GROUP BY 1, 2, 3)
SELECT user_id, CAST(zone AS INTEGER) AS zone, label, round(seconds, 6) AS seconds, round(coalesce(seconds / nullif(sum(seconds) OVER (PARTITION BY user_id), 0), 0.0), 6) AS share FROM g
""")
def track_heart_rate_zones(spark, d):
    out = track.named_zones(_track(spark, d), "hr", track.hr_zones_from(max_hr=198))
    return out.select("user_id", "zone", "label", F.round("seconds", 6).alias("seconds"), *r6("share"))


@query("""
SELECT 'hr' AS part, [0.0, 129.0, 160.0, 176.0, 192.0, 1e9] AS edges, 5 AS names UNION ALL SELECT 'pace', list_transform([0.0, 4.0 / 1.33, 4.0 / 1.15, 4.0 / 1.03, 4.0 / 0.96, 4.0 / 0.9, 1e9], lambda x: round(x, 9)), 6
UNION ALL SELECT 'power', [0.0, 110.0, 150.0, 180.0, 210.0, 240.0, 300.0, 1e9], 7 UNION ALL SELECT 'durations', list_distinct_sorted, 0 FROM (SELECT list_sort(list_distinct(list_transform(range(20), lambda i: floor(exp(ln(3600.0) * i / 19) + 0.5)))) AS list_distinct_sorted)
""")
def zone_schemes(spark, d):
    r = lambda e: [round(float(x), 9) for x in e]
    made = {"hr": track.hr_zones_from(max_hr=198), "pace": track.pace_zones_from(1250.0), "power": track.power_zones_from(200.0)}
    rows = [(k, r(e), len(names)) for k, (e, names) in made.items()] + [("durations", track.log_durations(3600.0, 20), 0)]
    return spark.createDataFrame(rows, "part string, edges array<double>, names int")


@query(TRACK + """
, x AS (SELECT *, lead(lat) OVER w AS lat1, lead(lng) OVER w AS lng1, lead(dist) OVER w AS dist1 FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), e AS (SELECT user_id, unnest([least(300000.0, max(dist)), least(900000.0, max(dist))]) AS meters FROM k GROUP BY user_id),
a AS (SELECT e.user_id, e.meters, arg_max({lat: lat, lng: lng, lat1: lat1, lng1: lng1, d: dist, d1: dist1}, n) AS z FROM e LEFT JOIN x ON x.user_id = e.user_id AND dist <= e.meters GROUP BY 1, 2)
SELECT user_id, round(meters, 2) AS meters, round(z.lat + (coalesce(z.lat1, z.lat) - z.lat) * CASE WHEN z.d1 > z.d THEN least((meters - z.d) / (z.d1 - z.d), 1) ELSE 0 END, 6) AS lat, round(z.lng + (coalesce(z.lng1, z.lng) - z.lng) * CASE WHEN z.d1 > z.d THEN least((meters - z.d) / (z.d1 - z.d), 1) ELSE 0 END, 6) AS lng FROM a
UNION ALL SELECT user_id, round(dist, 2), round(lat, 6), round(lng, 6) FROM k WHERE dist > 300000 AND dist < 900000
""")
def track_stretch(spark, d):
    return track.polyline_slice(_track(spark, d), 300_000.0, 900_000.0).select("user_id", F.round("meters", 2).alias("meters"), *r6("lat", "lng"))


@query(TRACK + """
SELECT user_id, round(max(dist) - min(dist), 2) AS meters, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds, round(avg(power), 6) AS power, max(hr) AS max_hr FROM k WHERE dist BETWEEN 300000 AND 2000000 GROUP BY 1
""")
def track_window_channels(spark, d):
    out = track.window_channels(_track(spark, d), 300_000.0, 2_000_000.0, ("power", "hr"))
    return out.select("user_id", F.round("meters", 2).alias("meters"), F.round("seconds", 6).alias("seconds"), *r6("power"), "max_hr")


@query(TRACK + """
, b AS (SELECT user_id, CAST(floor(dist / 1000000) AS BIGINT) AS b, quantile_cont(ele, 0.5) AS mid, quantile_cont(ele, 0.95) AS p95 FROM k GROUP BY 1, 2), g AS (SELECT user_id, unnest(generate_series(min(b), max(b))) AS b FROM b GROUP BY 1)
SELECT user_id, CAST(b * 1000000 AS DOUBLE) AS "start", round(mid, 6) AS mid, round(p95, 6) AS p95 FROM g LEFT JOIN b USING (user_id, b)
""")
def track_profile(spark, d):
    s = track.with_distance(_track(spark, d))
    return track.profile(s, "ele", 1_000_000.0).select("user_id", F.col("start").cast("double").alias("start"), F.round("ele_median", 6).alias("mid"), F.round("ele_p95", 6).alias("p95"))


@query(TRACK + """
, c AS (SELECT unnest(CAST([500000, 2000000] AS DOUBLE[])) AS c) SELECT u.user_id, c AS center, round(quantile_cont(ele, 0.5), 6) AS mid, round(quantile_cont(ele, 0.25), 6) AS p25 FROM (SELECT DISTINCT user_id FROM k) u CROSS JOIN c LEFT JOIN k ON k.user_id = u.user_id AND abs(dist - c) <= 300000 GROUP BY 1, 2
""")
def track_spread(spark, d):
    s = track.with_distance(_track(spark, d))
    return track.rolling_spread(s, "ele", 300_000.0, [500_000.0, 2_000_000.0]).select("user_id", "center", F.round("ele_median", 6).alias("mid"), F.round("ele_p25", 6).alias("p25"))


@query(TRACK + """
, x AS (SELECT *, lead(lat) OVER w AS lat1, lead(lng) OVER w AS lng1, lead(dist) OVER w AS dist1 FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), m AS (SELECT DISTINCT user_id, CAST(750000.5 AS DOUBLE) AS meters FROM k),
a AS (SELECT m.user_id, m.meters, arg_max({lat: lat, lng: lng, lat1: lat1, lng1: lng1, d: dist, d1: dist1}, n) AS z FROM m LEFT JOIN x ON x.user_id = m.user_id AND dist <= m.meters GROUP BY 1, 2)
SELECT user_id, meters, round(z.lat + (coalesce(z.lat1, z.lat) - z.lat) * CASE WHEN z.d1 > z.d THEN least((meters - z.d) / (z.d1 - z.d), 1) ELSE 0 END, 6) AS lat, round(z.lng + (coalesce(z.lng1, z.lng) - z.lng) * CASE WHEN z.d1 > z.d THEN least((meters - z.d) / (z.d1 - z.d), 1) ELSE 0 END, 6) AS lng FROM a
""")
def track_position(spark, d):
    s = _track(spark, d)
    want = s.df.select("user_id").distinct().withColumn("meters", F.lit(750000.5))
    return track.position_at(s, want).select("user_id", F.col("meters").cast("double").alias("meters"), *r6("lat", "lng"))


@query("""
SELECT e.event_id, o.o_totalprice AS ftp FROM events e ASOF LEFT JOIN (SELECT o_custkey AS user_id, o_orderdate AS t, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2) o ON e.user_id = o.user_id AND e.ts >= o.t
""")
def profile_in_force(spark, d):
    settings = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("ftp"))
    got = track.as_of_profile(events(spark, d).partition_by("user_id"), Series.of(settings, time="day", seq="k").partition_by("user_id"))
    return got.select("event_id", "ftp")


# -- plans ---------------------------------------------------------------------------


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT user_id, ts, round(value, 6) AS value FROM n WHERE (n - 1) % greatest(CAST(ceil(c / 8.0) AS BIGINT), 1) = 0
""")
def plan_shape(spark, d):
    return plan.shape(events(spark, d).partition_by("user_id"), "value", 8)


@query("""
WITH x AS (SELECT event_id, avg(value) OVER w AS a, stddev_pop(value) OVER w AS s, count(*) OVER w AS c, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 3 PRECEDING))
SELECT event_id, round(CASE WHEN c >= 4 THEN a + s END, 6) AS up, round(CASE WHEN c >= 4 THEN (a - value) / value END, 6) AS off FROM x
""")
def plan_slots_and_host(spark, d):
    host = plan.Host()
    host.sources.define("events", lambda: events(spark, d).partition_by("user_id"))
    value, mean = builder.col("value"), builder.slot("mean")
    spec = builder.plan(up=mean + value.op("stdev", period=4), off=(mean - value) / value, id=builder.col("event_id"), bad=builder.Expr({"op": "no such op", "inputs": []}))
    out, errors = host.run("events", spec, slots={"mean": value.op("sma", period=4).spec}, on_error="collect")
    if set(errors) != {"bad"}:
        raise RuntimeError(f"errors by output: {errors}")
    return out.select(F.col("id").alias("event_id"), *r6("up", "off"))


@query("SELECT 'equal' AS what, true AS holds UNION ALL SELECT 'order', true UNION ALL SELECT 'apart', true UNION ALL SELECT 'history', true UNION ALL SELECT 'schema', true")
def plan_identities(spark, d):
    ops, x = plan.standard_ops(), builder.col("value")
    a, b = x.op("zScore").spec, {"inputs": ["value"], "params": {"period": 20.0}, "op": "zScore"}
    two = [{"op": "scale", "inputs": ["value"], "params": {"by": 2}}, {"params": {"by": 2.0}, "inputs": ["value"], "op": "scale"}]
    nested = x.op("sma", period=5).op("shift", n=3).op("diff").spec
    got = {
        "equal": ops.spec_id(a) == ops.spec_id(b), "order": ops.spec_id(two[0]) == ops.spec_id(two[1]), "apart": ops.spec_id(a) != ops.spec_id(x.op("zScore", period=21).spec),
        "history": ops.required_history(nested) == 4 + 3 + 1, "schema": len(ops.json_schema()["oneOf"]) == len(ops.describe()),
    }
    return spark.createDataFrame(list(got.items()), "what string, holds boolean")



@query("""
WITH x AS (SELECT event_id, avg(value) OVER w AS a, count(*) OVER w AS c, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dv, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING))
SELECT event_id, round(CASE WHEN c >= 5 THEN a END, 6) AS mean, round(dv, 6) AS step FROM x WHERE n BETWEEN 11 AND 30
""")
def plan_of_a_range(spark, d):
    value = builder.col("value")
    spec = builder.plan(mean=value.op("sma", period=5), step=value.op("diff"), id=builder.col("event_id"))
    out = plan.run_range(events(spark, d).partition_by("user_id"), plan.standard_ops(), spec, 10, 30)
    return out.select(F.col("id").alias("event_id"), *r6("mean", "step"))


@query("SELECT event_id, ts + INTERVAL 1 HOUR AS time, round(value * 2, 6) AS value, user_id + 1 AS next, round(avg(value * 2) OVER (ORDER BY ts, event_id ROWS 2 PRECEDING), 6) AS mean FROM events QUALIFY row_number() OVER (ORDER BY ts, event_id) > 2")
def rows_changed_in_a_chain(spark, d):
    s = events(spark, d).merge({"value": F.col("value") * 2, "next": F.col("user_id") + 1}).with_key(F.col("ts") + F.expr("interval 1 hour"))
    return s.pipe(studies.sma, 3, "value", output="mean").filter("mean is not null").df.select("event_id", "time", *r6("value"), "next", *r6("mean"))
