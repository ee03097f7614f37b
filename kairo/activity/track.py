"""Activity tracks: distance, climb, power, splits, zones, best efforts.

A track is a Series of points (time, and any of lat, lng, ele, hr, power) partitioned by
activity.  Stateful walks go through the streaming fold; the rest are window expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import join_on
from ..functions.reducers import finite
from ..operators.aggregate import by_column
from ..operators.folds import fold
from ..operators.joins import as_of
from ..operators.windows import over_range, rolling_by_column
from ..series import Series

#: Mean radius of the earth in metres; metres of climb that count; the speed that counts as
#: moving; the longest pause, in seconds, a power sample stands for.
EARTH, CLIMB, MOVING, PAUSE = 6_371_008.8, 3.0, 0.5, 10.0

# Zone bounds as shares of the greatest heart rate, as multiples of the pace over five
# kilometres and as shares of threshold power; their names; the durations of a best-effort table.
HR_FRACTIONS = (0.65, 0.81, 0.89, 0.97)
HR_ZONES = ("Recovery", "Endurance", "Tempo", "Threshold", "Anaerobic")
PACE_MULTIPLES = (1.33, 1.15, 1.03, 0.96, 0.9)
PACE_ZONES = ("Recovery", "Endurance", "Tempo", "Threshold", "VO2 Max", "Anaerobic")
POWER_FRACTIONS = (0.55, 0.75, 0.9, 1.05, 1.2, 1.5)
POWER_ZONES = ("Recovery", "Endurance", "Tempo", "Threshold", "VO2Max", "Anaerobic", "Neuromuscular")
BEST_EFFORTS = [5.0, 15.0, 30.0, 60.0, 120.0, 180.0, 300.0, 480.0, 600.0, 900.0, 1200.0, 1800.0, 2700.0, 3600.0]
#: What stands for an open top.
TOP = 1e9


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lng2) - F.radians(lng1)) / 2), 2)
    return F.lit(2 * EARTH) * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))  # least() would pass over a null


def seconds(s: Series) -> Column:
    return (s.at - F.lag(s.at).over(s.rows())) / 1e6


def with_distance(s: Series, lat: str = "lat", lng: str = "lng") -> Series:
    """Adds step (metres from the row before) and dist (running)."""
    w = s.rows()
    step = F.coalesce(haversine(F.lag(lat).over(w), F.lag(lng).over(w), F.col(lat), F.col(lng)), F.lit(0.0))
    df = s.df.withColumn("step", step)
    return s.with_df(df.withColumn("dist", F.sum("step").over(w)))


def total_distance(s: Series) -> DataFrame:
    d = with_distance(s)
    return (d.df.groupBy(*s.by) if s.by else d.df.groupBy()).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("meters"))


def moving_time(s: Series) -> DataFrame:
    d = with_distance(s)
    df = d.df.withColumn("__dt", seconds(d))
    moving = F.when((F.col("__dt") > 0) & (F.col("step") / F.col("__dt") >= MOVING), F.col("__dt"))
    return (df.groupBy(*s.by) if s.by else df.groupBy()).agg(F.coalesce(F.sum(moving), F.lit(0.0)).alias("seconds"))


def bounds(s: Series, lat: str = "lat", lng: str = "lng") -> DataFrame:
    return (s.df.groupBy(*s.by) if s.by else s.df.groupBy()).agg(F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lng).alias("west"), F.max(lng).alias("east"))


def with_climb(s: Series, ele: str = "ele", threshold: float = CLIMB) -> Series:
    """Adds gain and loss so far; a change counts once it passes the threshold from the last level."""

    def step(state, part):
        level, gain, loss = state
        n = len(part[ele])
        g, l_ = np.empty(n), np.empty(n)
        for i, v in enumerate(part[ele].tolist()):
            if v == v:
                if level is None:
                    level = v
                elif v - level >= threshold:
                    gain, level = gain + v - level, v
                elif level - v >= threshold:
                    loss, level = loss + level - v, v
            g[i], l_[i] = gain, loss
        return (level, gain, loss), {"gain": g, "loss": l_}

    return fold(s, [ele], {"gain": "double", "loss": "double"}, lambda: (None, 0.0, 0.0), step)


def elevation_gain_loss(s: Series, ele: str = "ele") -> DataFrame:
    d = with_climb(s, ele).df
    return (d.groupBy(*s.by) if s.by else d.groupBy()).agg(F.max("gain").alias("gain"), F.max("loss").alias("loss"))


def position_at(s: Series, meters: DataFrame, at: str = "meters", cols: tuple[str, ...] = ("lat", "lng")) -> DataFrame:
    """Points of each track at given distances, interpolated on the running distance."""
    d = with_distance(s)
    nxt = {f"next_{c}": F.lead(c).over(d.rows()) for c in (*cols, "dist")}
    knots = Series(d.df.withColumns(nxt).withColumn("from", F.col("dist")), "value", ("dist",), s.by, s.seq)
    got = as_of(meters, F.col(at).cast("double"), Series(knots.df.withColumn("__axis", F.col("dist")), "value", ("__axis",), s.by, s.seq), list(s.by))
    t = F.when(F.col("next_dist") > F.col("from"), F.least((F.col(at) - F.col("from")) / (F.col("next_dist") - F.col("from")), F.lit(1.0))).otherwise(0.0)
    return got.select(*meters.columns, *[(F.col(c) + (F.coalesce(F.col(f"next_{c}"), F.col(c)) - F.col(c)) * t).alias(c) for c in cols])


def splits(s: Series, every: float = 1000.0) -> DataFrame:
    """Per split of distance: begin, meters, seconds, climb."""
    d = with_climb(with_distance(s)) if "ele" in s.values else with_distance(s)
    df = d.df.withColumn("__dt", F.coalesce(seconds(d), F.lit(0.0)))
    cols = [F.min(s.key[0]).alias("begin"), F.sum("step").alias("meters"), F.sum("__dt").alias("seconds")]
    if "ele" in s.values:
        w = d.rows()
        df = df.withColumn("__g", F.col("gain") - F.coalesce(F.lag("gain").over(w), F.lit(0.0))).withColumn("__l", F.col("loss") - F.coalesce(F.lag("loss").over(w), F.lit(0.0)))
        cols += [F.sum("__g").alias("gain"), F.sum("__l").alias("loss")]
    return df.withColumn("split", F.floor(F.col("dist") / every)).groupBy(*s.by, "split").agg(*cols)


def splits_exact(s: Series, every: float = 1000.0, channels: tuple[str, ...] = ()) -> DataFrame:
    """Per split of distance: meters, seconds, and each channel's mean by time and greatest value.

    A step that passes a split's end is divided there in proportion to its distance, its time
    and what it stands for with it, so splits have their length exactly.
    """
    d = with_weight(with_distance(s))
    df = d.df.withColumn("__sec", F.coalesce(seconds(d), F.lit(0.0)))
    last, first = F.floor(F.col("dist") / every), F.floor((F.col("dist") - F.col("step")) / every)
    df = df.withColumn("__last", last).withColumn("split", F.explode(F.sequence(first, last)))
    inside = F.least(F.col("dist"), (F.col("split") + 1) * every) - F.greatest(F.col("dist") - F.col("step"), F.col("split") * every)
    share = F.when(F.col("step") > 0, inside / F.col("step")).when(F.col("split") == F.col("__last"), 1.0).otherwise(0.0)
    df = df.withColumn("__share", share)
    w = F.col("dt") * F.col("__share")
    cols = [F.sum(F.col("step") * F.col("__share")).alias("meters"), F.sum(F.col("__sec") * F.col("__share")).alias("seconds")]
    for c in channels:
        cols += [(F.sum(F.col(c) * w) / F.sum(F.when(F.col(c).isNotNull(), w))).alias(c), F.max(c).alias(f"max_{c}")]
    return df.groupBy(*s.by, "split").agg(*cols)


def profile(s: Series, value: str, width: float, axis: str = "dist") -> DataFrame:
    """Median and spread of a value along the distance."""
    spread = {f"{value}_{p}": (value, p) for p in ("p5", "p25", "median", "p75", "p95")}
    return by_column(s, axis, spread, width=width)


def rolling_spread(s: Series, value: str, radius: float, at: list[float], axis: str = "dist") -> DataFrame:
    return rolling_by_column(s, axis, radius, {f"{value}_{p}": (value, p) for p in ("p5", "p25", "median", "p75", "p95")}, at)


def _per_track(s: Series, cols: list[str], schema: str, fn) -> DataFrame:
    """A track in one task: the walks below look both ways along it."""
    src, by = s.df.select(*s.by, s.at.alias("__at"), *cols), list(s.by)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("__at", kind="stable")
        out = fn(df)
        for c in by:
            out[c] = df[c].iloc[0]
        return out[[*by, *[c for c in out.columns if c not in by]]]

    return src.groupBy(*(by or (F.lit("all"),))).applyInPandas(run, ", ".join([*(f"`{c}` {s.types[c]}" for c in by), schema]))


def best_efforts(s: Series, distances: list[float]) -> DataFrame:
    """The least time over any stretch of each distance at least; missing if the track is shorter."""

    def fn(df: pd.DataFrame) -> pd.DataFrame:
        t, d = df["__at"].to_numpy(float) / 1e6, df["dist"].to_numpy(float)
        best = []
        for want in distances:
            j = np.searchsorted(d, d + want, side="left")
            ok = j < len(d)
            best.append(float((t[j[ok]] - t[ok]).min()) if ok.any() else None)
        return pd.DataFrame({"meters": distances, "seconds": pd.Series(best, dtype="float64")})

    return _per_track(with_distance(s), ["dist"], "meters double, seconds double", fn)


def simplify(s: Series, tolerance: float, x: str = "lng", y: str = "lat") -> DataFrame:
    """Douglas-Peucker on planar coordinates: the rows that stay."""

    def fn(df: pd.DataFrame) -> pd.DataFrame:
        p = df[[x, y]].to_numpy(float)
        keep = np.zeros(len(p), bool)
        keep[[0, -1]] = True
        todo = [(0, len(p) - 1)]
        while todo:
            a, b = todo.pop()
            if b <= a + 1:
                continue
            line, rel = p[b] - p[a], p[a + 1 : b] - p[a]
            n2 = float(line @ line)
            u = np.clip(rel @ line / n2, 0, 1) if n2 else np.zeros(len(rel))
            far = np.hypot(*(rel - u[:, None] * line).T)
            i = int(far.argmax())
            if far[i] > tolerance:
                keep[a + 1 + i] = True
                todo += [(a, a + 1 + i), (a + 1 + i, b)]
        return df.loc[keep, ["__at", x, y]].rename(columns={"__at": "at_us"})

    return _per_track(s, [x, y], f"at_us long, `{x}` double, `{y}` double", fn)


# -- power -------------------------------------------------------------------------


def with_weight(s: Series) -> Series:
    """Adds dt: the seconds a sample stands for, ten at most."""
    return s.with_df(s.df.withColumn("dt", F.least(F.greatest(F.coalesce(seconds(s), F.lit(0.0)), F.lit(0.0)), F.lit(PAUSE))))


def power_summary(s: Series, power: str = "power", ftp: float | None = None) -> DataFrame:
    """average (of the samples), max, work (kJ) and normalized power; with ftp also intensity, and the load of
    the elapsed time.  Missing samples take no part; of none, all are zero."""
    w = with_weight(s)
    w = w.with_df(w.df.withColumn("__w", finite(F.col(power), s.types[power]).cast("double")))
    df = over_range(w, 30_000_000 - 1, 0, {"__roll": ("avg", F.col("__w"), "double")})
    fourth = F.pow(F.avg(F.when(F.col("__w").isNotNull(), F.pow("__roll", F.lit(4)))), F.lit(0.25))
    elapsed = (F.max(s.at) - F.min(s.at)) / 1e6
    cols = {"average": F.avg("__w"), "max": F.greatest(F.max("__w"), F.lit(0.0)), "work_kj": F.sum(F.col("__w") * F.col("dt")) / 1000, "normalized": fourth}
    out = (df.groupBy(*s.by) if s.by else df.groupBy()).agg(*[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in cols.items()], elapsed.alias("__time"))
    if ftp:
        out = out.withColumn("intensity", F.col("normalized") / ftp).withColumn("load", F.col("__time") / 3600 * F.pow(F.col("intensity"), 2) * 100)
    return out.drop("__time")


def compute_power(s: Series, ftp: float, power: str = "power", width: float = 1.0, durations: list[float] | None = None) -> dict[str, DataFrame]:
    """The whole power bundle: summary, distribution by watts, time in zones and curve, a table each."""
    if not 0 < width < float("inf"):
        raise ValueError("watts of a bin must be positive and finite")
    edges, _ = power_zones_from(ftp)
    return {"summary": power_summary(s, power, ftp), "distribution": power_distribution(s, power, width), "zones": zones(s, power, edges[:-1]), "curve": power_curve(s, durations or log_durations(86_400.0), power)}


def power_distribution(s: Series, power: str = "power", width: float = 25.0) -> DataFrame:
    return by_column(with_weight(s), power, {"seconds": ("dt", "sum")}, width=width)


def zones(s: Series, value: str, edges: list[float]) -> DataFrame:
    """Seconds in each zone; a value on an edge is in the zone below, the top zone is open."""
    return by_column(with_weight(s), value, {"seconds": ("dt", "sum")}, edges=[*edges, 1e308], inclusive="(]")


def power_curve(s: Series, durations: list[float], power: str = "power") -> DataFrame:
    """The best average over any run of samples that stand for each duration at least, never rising with
    it; a missing sample is zero watts.  Durations beyond all that a track's samples stand for
    have no row.  first and last are the places, from 0, of the samples that gave the best."""

    def fn(df: pd.DataFrame) -> pd.DataFrame:
        p, dt = df[power].astype(float).to_numpy(), df["dt"].to_numpy(float)
        work = np.concatenate([[0.0], np.cumsum(np.where(np.isfinite(p), p, 0.0) * dt)])
        time = np.concatenate([[0.0], np.cumsum(dt)])
        out, cap = [], np.inf
        for want in durations:
            if want > time[-1]:
                break
            end = np.arange(1, len(time))
            lo = np.minimum(np.searchsorted(time, time[1:] - want, side="right") - 1, end - 1)
            ok = np.flatnonzero((lo >= 0) & (time[1:] - time[np.maximum(lo, 0)] >= want))
            watts, best = 0.0, None
            if len(ok):
                mean = (work[end[ok]] - work[lo[ok]]) / (time[end[ok]] - time[lo[ok]])
                if mean.max() > 0:
                    i = int(mean.argmax())
                    watts, best = float(mean[i]), (int(lo[ok[i]]), int(end[ok[i]]) - 1)
            cap = min(cap, watts)
            out.append((want, cap, *(best or (None, None))))
        return pd.DataFrame(out, columns=["duration", "watts", "first", "last"]).astype({"first": "Int64", "last": "Int64"})

    return _per_track(with_weight(s), [power, "dt"], "duration double, watts double, first long, last long", fn)


def power_best_efforts(s: Series, power: str = "power", weight_kg: float | None = None, durations: list[float] | None = None) -> DataFrame:
    """The curve at the usual durations, in whole watts, and watts a kilogram if the weight is known."""
    out = power_curve(s, durations or BEST_EFFORTS, power).withColumn("per_kg", F.col("watts") / weight_kg if weight_kg and weight_kg > 0 else F.lit(None).cast("double"))
    return out.withColumn("watts", F.floor(F.col("watts") + 0.5).cast("double"))


def log_durations(total: float, steps: int = 140) -> list[float]:
    """Whole seconds from one to ``total``, evenly spread by their logarithms."""
    if total < 1 or steps < 2:
        return [1.0]
    return [float(x) for x in dict.fromkeys(int(np.floor(np.exp(np.log(total) * i / (steps - 1)) + 0.5)) for i in range(steps))]


# -- zone schemes: the edges of a value's axis, the last one open, and the zones' names ----------


def hr_zones_from(max_hr: float | None = None, bounds: list[float] | None = None) -> tuple[list[float], tuple[str, ...]]:
    inner = list(bounds)[:4] if bounds is not None else [float(np.floor(f * max_hr + 0.5)) for f in HR_FRACTIONS]
    return [0.0, *inner, TOP], HR_ZONES


def pace_zones_from(five_k_seconds: float) -> tuple[list[float], tuple[str, ...]]:
    """On the axis of speed, in metres a second."""
    speed = 5000 / five_k_seconds if five_k_seconds > 0 else 0.0
    return [0.0, *(speed / m for m in PACE_MULTIPLES), TOP], PACE_ZONES


def power_zones_from(ftp: float) -> tuple[list[float], tuple[str, ...]]:
    return [0.0, *(f * ftp for f in POWER_FRACTIONS), TOP], POWER_ZONES


def named_zones(s: Series, value: str, scheme: tuple[list[float], tuple[str, ...]]) -> DataFrame:
    """Seconds in each zone of a scheme, its number from 1, its name and its share of all of them."""
    edges, names = scheme
    out = zones(s, value, edges[:-1])
    place = F.array_position(F.array(*[F.lit(float(e)) for e in edges[:-1]]), F.col("start"))
    out = out.withColumn("zone", place.cast("int")).withColumn("label", F.element_at(F.array(*map(F.lit, names)), F.col("zone")))
    total = (out.groupBy(*s.by) if s.by else out.groupBy()).agg(F.sum("seconds").alias("__all"))
    got = join_on(out, total, s.by) if s.by else out.join(F.broadcast(total))
    return got.withColumn("share", F.when(F.col("__all") > 0, F.col("seconds") / F.col("__all")).otherwise(0.0)).drop("__all")


def polyline_slice(s: Series, begin: float, end: float, cols: tuple[str, ...] = ("lat", "lng")) -> DataFrame:
    """The stretch of each track between two distances: its rows between them, and interpolated ends."""
    lo, hi = min(begin, end), max(begin, end)
    d = with_distance(s)
    total = (d.df.groupBy(*s.by) if s.by else d.df.groupBy()).agg(F.max("dist").alias("__total"))
    ends = total.select(*s.by, F.explode(F.array(*[F.greatest(F.lit(0.0), F.least(F.lit(float(x)), F.col("__total"))) for x in (lo, hi)])).alias("meters"))
    ends = position_at(s, ends, cols=cols).select(*s.by, "meters", *cols)
    inner = d.df.filter((F.col("dist") > lo) & (F.col("dist") < hi)).select(*s.by, F.col("dist").alias("meters"), *cols)
    return inner.unionByName(ends)


def window_channels(s: Series, begin: float, end: float, channels: tuple[str, ...]) -> DataFrame:
    """Of the rows between two distances of each track: meters, seconds, and each channel's mean and greatest."""
    d = with_distance(s)
    df = d.df.filter((F.col("dist") >= begin) & (F.col("dist") <= end))
    cols = [(F.max("dist") - F.min("dist")).alias("meters"), ((F.max(s.at) - F.min(s.at)) / 1e6).alias("seconds")]
    for c in channels:
        cols += [F.avg(c).alias(c), F.max(c).alias(f"max_{c}")]
    return (df.groupBy(*s.by) if s.by else df.groupBy()).agg(*cols)


def as_of_profile(s: Series, profiles: Series) -> DataFrame:
    """Each row with the athlete's settings in force at its time; of one date's the last."""
    return as_of(s.df, s.at, profiles, list(s.by))


def summary(s: Series, ftp: float | None = None) -> DataFrame:
    """Distance, time, climb and power of each track in one row."""
    out = join_on(total_distance(s), moving_time(s).withColumnRenamed("seconds", "moving_seconds"), s.by)  # a row each
    if "ele" in s.values:
        out = join_on(out, elevation_gain_loss(s), s.by)
    if "power" in s.values:
        out = join_on(out, power_summary(s, ftp=ftp), s.by)
    return out
