"""Live series: the same vocabulary over Structured Streaming.

Stateless operators are DataFrame expressions.  Tumbling buckets are watermarked windows.
Everything that remembers rows is a *step*: a small object that takes rows of one key in
order of arrival and returns what to emit; its state is kept by applyInPandasWithState.
Keys are dealt to shards that keep their states together: Spark takes some 10 ms a state and
batch, whatever is in it, and a step takes all rows of a shard at once.
Watermarks advance per micro-batch, not per row, and rows evicted upstream aren't retracted.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.frames import join_on
from ..functions.reducers import Output, outputs, percentile_rank, reduce, top_size
from ..functions.time import duration_us, parse_time
from ..sources.tables import ddl


#: States that keys are dealt to.  A batch writes those of its keys anew: fewer are quicker with many keys in a
#: batch, more with many keys and few of them in a batch.
SHARDS = 1024
#: Kinds of keys that Python holds as they are, so that a dict keeps them apart as Spark does.
KEYS = ("string", "tinyint", "smallint", "int", "bigint", "boolean", "date", "timestamp", "timestamp_ntz", "binary")


@dataclass(frozen=True)
class Live:
    """A streaming DataFrame with a timestamp, partition columns and a lateness bound."""

    df: DataFrame
    time: str
    by: tuple[str, ...] = ()
    grace: str | None = None  #: how late a row may be; later ones are dropped
    groups: tuple | None = None  #: declared values of the first partition column
    expire: str | None = None  #: the state of a key goes when the watermark has passed its last row by so much
    shards: int = SHARDS  #: 0: each key has a state of its own; a checkpoint goes on with what it began with

    def partition_by(self, *cols: str, groups: tuple | None = None) -> Live:
        return replace(self, by=tuple(cols), groups=groups)

    def _checked(self) -> DataFrame:
        if not self.groups:
            return self.df
        ok = F.col(self.by[0]).isin(*self.groups)
        bad = F.raise_error(F.concat(F.lit("undeclared group "), F.col(self.by[0]).cast("string"))).cast("boolean")
        return self.df.filter(F.when(ok, F.lit(True)).otherwise(bad))

    # -- stateless ---------------------------------------------------------------

    def filter(self, cond: Column | str) -> Live:
        return replace(self, df=self.df.filter(cond))

    def select(self, *names: str) -> Live:
        return replace(self, df=self.df.select(self.time, *self.by, *[n for n in names if n not in (self.time, *self.by)]))

    def map(self, exprs: Mapping[str, Column]) -> Live:
        return replace(self, df=self.df.select(self.time, *self.by, *[e.alias(n) for n, e in exprs.items()]))

    def union(self, other: Live) -> Live:
        return replace(self, df=self.df.unionByName(other.df))

    # -- buckets -------------------------------------------------------------------

    def aggregate(self, step: str, mapping: Mapping, anchor_us: int = 0) -> DataFrame:
        """Tumbling buckets (begin, end, outputs) that exist once a row lands in them, the leading
        one too.  In append mode a bucket comes when it has closed; in update mode as it grows."""
        us_ = duration_us(step)
        outs = outputs(mapping, self.df.columns)
        types = dict(self.df.dtypes)
        start = (anchor_us % us_) // 1000
        src = self._checked().withWatermark(self.time, self.grace or "0 seconds")
        aggs = [reduce(o.reducer, F.col(o.source), types[o.source], F.struct(F.col(self.time))).alias(o.name) for o in outs]
        w = F.window(self.time, f"{us_ // 1000} milliseconds", startTime=f"{start} milliseconds")
        return src.groupBy(*self.by, w.alias("w")).agg(*aggs).select(*self.by, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), *[o.name for o in outs])

    # -- steps -------------------------------------------------------------------------

    def through(self, step: Step, order: str | None = None) -> DataFrame:
        """Runs a step for each key: rows of a micro-batch by time (and ``order``), batches as they come.

        With ``expire`` a key that the watermark has left so far behind gives up its state; a row
        that comes later begins anew.
        """
        src = self._checked()
        if self.grace or self.expire:
            src = src.withWatermark(self.time, self.grace or "0 seconds")
        wait = duration_us(self.expire) // 1000 if self.expire else None
        step = step.bound(self, src)
        keys = list(self.by) if self.by and not step.all_keys else ["__all"]
        src = step.narrowed(src, order)
        if keys == ["__all"]:
            src = src.withColumn("__all", F.lit(0))
        cols, time = src.columns, self.time
        timeout = GroupStateTimeout.EventTimeTimeout if wait is not None else GroupStateTimeout.NoTimeout
        types = dict(src.dtypes)
        if self.shards and keys != ["__all"] and all(types[c] in KEYS for c in keys):
            src, whole = _dealt(src, keys, self.shards)
            return src.groupBy("__shard").applyInPandasWithState(_of_shard(step, time, order, keys, whole, wait), step.schema, "state binary", "append", timeout)

        def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            if state.hasTimedOut:
                state.remove()
                return
            mine = pickle.loads(state.get[0]) if state.exists else step.start()
            rows = pd.concat(list(frames), ignore_index=True)
            rows = rows.sort_values([time, *([order] if order else [])], kind="stable").reset_index(drop=True)
            out = step.take(mine, rows)
            state.update((pickle.dumps(mine),))
            if wait is not None:
                state.setTimeoutTimestamp(max(_at(rows[time].iloc[-1]) // 1000, state.getCurrentWatermarkMs()) + wait)
            if len(out):
                yield out[step.columns]

        return src.select(*cols).groupBy(*keys).applyInPandasWithState(run, step.schema, "state binary", "append", timeout)


def _dealt(src: DataFrame, keys: list[str], shards: int) -> tuple[DataFrame, list[str]]:
    """The rows with ``__shard``, and the columns of whole numbers whose nulls are marked beside them, as pandas would
    make floats of all numbers of a column that lacks one.  Keys that lack a column have shards of their own."""
    whole = [c for c, kind in src.dtypes if kind == "bigint" and c not in keys]
    lacks = F.lit(0)
    for i, c in enumerate(keys):
        lacks = lacks + F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0))
    shard = F.pmod(F.xxhash64(*keys), F.lit(shards)) + lacks * F.lit(shards)
    marks = {f"__no_{c}": F.col(c).isNull() for c in whole} | {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in whole}
    return src.withColumns({**marks, "__shard": shard}), whole


def _of_shard(step: Step, time: str, order: str | None, keys: list[str], whole: list[str], wait: int | None):
    def run(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else {}
        out = None
        if not state.hasTimedOut:
            parts = list(frames)
            rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
            for c in whole:
                no = rows.pop(f"__no_{c}").to_numpy(bool)
                if no.any():
                    rows[c] = rows[c].astype(object).mask(no, None)
            known = [c for c in keys if not rows[c].isna().any()]  # a shard lacks a column in all rows or none
            code = rows.groupby(known, sort=False).ngroup() if known else pd.Series(0, rows.index)
            by = [code, *[rows[c] for c in (time, *([order] if order else []))]]
            rows = rows.drop(columns=["__shard"], errors="ignore").iloc[_order_of(by)].reset_index(drop=True)
            code = np.sort(code.to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(rows)]
            at = [rows[c].iloc[cuts[:-1]].tolist() if c in known else [None] * (len(cuts) - 1) for c in keys]
            mine = list(zip(*at, strict=True))
            states = [held[k][0] if k in held else step.start() for k in mine]
            out, _ = step.takes(states, rows, cuts)
            last = _times(rows[time].iloc[[b - 1 for b in cuts[1:]]]) if wait is not None else None
            for i, k in enumerate(mine):
                held[k] = (states[i], None if wait is None else max(int(last[i]) // 1000, state.getCurrentWatermarkMs()) + wait)
        if wait is not None:  # keys without rows in this batch that the watermark has left
            here, mark = set() if state.hasTimedOut else set(mine), state.getCurrentWatermarkMs()
            held = {k: v for k, v in held.items() if k in here or v[1] >= mark}
        if held:
            state.update((pickle.dumps(held),))
            if wait is not None:
                state.setTimeoutTimestamp(min(v[1] for v in held.values()))  # none is before the watermark
        elif state.exists:
            state.remove()
        if out is not None and len(out):
            yield out[step.columns]

    return run


def _order_of(by: list[pd.Series]) -> np.ndarray:
    """The stable order by these columns, nulls last, as sort_values has it."""
    codes = [pd.factorize(c, sort=True, use_na_sentinel=True)[0] if c.dtype == object else c for c in by]
    frame = pd.DataFrame({i: np.where(c < 0, np.iinfo(np.int64).max, c) if isinstance(c, np.ndarray) else c.to_numpy() for i, c in enumerate(codes)})
    return frame.sort_values(list(frame.columns), kind="stable").index.to_numpy()


def _at(t) -> int:
    """Microseconds of a pandas timestamp."""
    return int(pd.Timestamp(t).value // 1000)


def _times(times: pd.Series) -> np.ndarray:
    """Microseconds of a column of them."""
    return pd.DatetimeIndex(times).as_unit("us").asi8


class Step:
    """Base of the stateful operators; ``all_keys`` ones see every key in one place."""

    all_keys = False
    schema = ""
    columns: list[str] = []

    def bound(self, live: Live, df: DataFrame) -> Step:
        self.time, self.by = live.time, list(live.by)
        self.marked = bool(live.grace or live.expire)  #: has a watermark
        fields = [f for f in df.schema.fields if f.name != "__all"]
        self.fields = {f.name: f.dataType.simpleString() for f in fields}
        self._out(fields)
        return self

    def _out(self, fields) -> None:
        changed = self.made()
        types = {**self.fields, **changed}
        self.columns = list(types)
        self.schema = ", ".join(f"`{c}` {t}" for c, t in types.items())

    def made(self) -> dict[str, str]:
        return {}

    def start(self) -> dict:
        return {}

    def narrowed(self, df: DataFrame, order: str | None) -> DataFrame:
        """What of the rows the step has use for, before they are brought to their keys."""
        return df

    def take(self, state: dict, rows: pd.DataFrame) -> pd.DataFrame:
        """What the rows of one key give.  A step has this or ``takes``."""
        return self.takes([state], rows, [0, len(rows)])[0] if len(rows) else rows

    def takes(self, states: list[dict], rows: pd.DataFrame, cuts: list[int]) -> tuple[pd.DataFrame, list[int]]:
        """The same for several keys at once, whose rows follow each other, cut at these places; none is empty.
        Also how many rows each gives."""
        if type(self).take is Step.take:
            raise NotImplementedError
        mixed = [c for c in rows.columns if rows[c].dtype == object and self.fields.get(c) == "bigint"]
        outs = []
        for state, (a, b) in zip(states, pairwise(cuts), strict=True):
            part = rows.iloc[a:b].reset_index(drop=True)
            for c in mixed:
                part[c] = pd.to_numeric(part[c])
            outs.append(self.take(state, part))
        some = [o for o in outs if len(o)]
        if len({tuple(o.dtypes) for o in some}) > 1:
            some = [o.astype(object).where(o.notna(), None) for o in some]
        return (pd.concat(some, ignore_index=True) if some else outs[0]), [len(o) for o in outs]


def _kept(rows: pd.DataFrame, keep: np.ndarray, cuts: list[int]) -> tuple[pd.DataFrame, list[int]]:
    return rows[keep], [int(keep[a:b].sum()) for a, b in pairwise(cuts)]


@dataclass
class Ordered(Step):
    """Late rows: 'drop' leaves out rows before the latest seen, 'strict' fails on them, 'reorder'
    lets them in if no older than ``within``, else fails."""

    policy: str = "drop"
    within: str | None = None

    def takes(self, states, rows, cuts):
        keep, times, within = [], _times(rows[self.time]).tolist(), duration_us(self.within or "1ms")
        for state, (a, b) in zip(states, pairwise(cuts), strict=True):
            latest = state.get("latest")
            for u in times[a:b]:
                late = latest is not None and u < latest
                if late and (self.policy == "strict" or (self.policy == "reorder" and latest - u > within)):
                    raise ValueError(f"row at {pd.Timestamp(u * 1000)} is out of order")
                keep.append(not late or self.policy == "reorder")
                latest = u if latest is None else max(latest, u)
            state["latest"] = latest
        return _kept(rows, np.array(keep, bool), cuts)


@dataclass
class Sample(Step):
    """Every n-th row of a key."""

    stride: int

    def takes(self, states, rows, cuts):
        n = 1 + np.arange(len(rows))
        for state, (a, b) in zip(states, pairwise(cuts), strict=True):
            n[a:b] += state.get("n", 0) - a
            state["n"] = int(n[b - 1])
        return _kept(rows, n % self.stride == 0, cuts)


@dataclass
class Change(Step):
    """diff, rate (per second) or pct against the row before."""

    how: str
    names: list[str]
    drop: bool = False

    def made(self):
        return {c: "double" for c in self.names}

    def takes(self, states, rows, cuts):
        begins, ends = cuts[:-1], [b - 1 for b in cuts[1:]]

        def before(x, name):
            p = np.concatenate([[np.nan], x[:-1]])
            p[begins] = [s.get(name, np.nan) for s in states]
            return p

        t = _times(rows[self.time]).astype(float)
        prev_t = before(t, "t")
        first = np.isnan(prev_t)
        rows = rows.copy()
        for c in self.names:
            x = rows[c].astype(float).to_numpy()
            p = before(x, c)
            with np.errstate(all="ignore"):
                y = x - p
                if self.how == "rate":
                    dt = (t - prev_t) / 1e6
                    y = np.where(dt != 0, y / dt, np.nan)
                elif self.how == "pct":
                    y = np.where(p != 0, y / p, np.nan)
            for s, last in zip(states, x[ends].tolist(), strict=True):
                s[c] = last
            rows[c] = pd.Series(y, index=rows.index).astype(object).where(~np.isnan(y), None)
        for s, last in zip(states, t[ends].tolist(), strict=True):
            s["t"] = last
        return _kept(rows, ~first if self.drop else np.ones(len(rows), bool), cuts)


@dataclass
class Fill(Step):
    """hold, zero or a literal; at most ``limit`` cells of a gap, counted cell by cell."""

    how: Mapping[str, object]
    limit: int | None = None

    def takes(self, states, rows, cuts):
        rows = rows.copy()
        for c, mode in self.how.items():
            cells, out = rows[c].tolist(), []
            for state, (a, b) in zip(states, pairwise(cuts), strict=True):
                last, run = state.get(c, (None, 0))
                for v in cells[a:b]:
                    if v is not None and v == v:
                        last, run = v, 0
                        out.append(v)
                        continue
                    run += 1
                    ok = self.limit is None or run <= self.limit
                    out.append((last if mode == "hold" else 0 if mode == "zero" else mode["literal"]) if ok else None)
                state[c] = (last, run)
            rows[c] = pd.Series(out, index=rows.index, dtype=object)
        return rows, np.diff(cuts).tolist()


@dataclass
class Cumulative(Step):
    how: Mapping[str, str | Callable]

    def made(self):
        return {c: "double" for c in self.how}

    def takes(self, states, rows, cuts):
        fns = {"sum": lambda a, v: a + v, "max": max, "min": min, "count": lambda a, v: a + 1}
        rows = rows.copy()
        for c, how in self.how.items():
            fn, cells, out = how if callable(how) else fns[how], rows[c].astype(float).tolist(), []
            for state, (a, b) in zip(states, pairwise(cuts), strict=True):
                acc = state.get(c)
                for v in cells[a:b]:
                    if v == v:
                        acc = (1.0 if how == "count" else v) if acc is None else fn(acc, v)
                    out.append(acc)
                state[c] = acc
            rows[c] = pd.Series(out, index=rows.index, dtype=object)
        return rows, np.diff(cuts).tolist()


def reduce_values(how, values: list):
    """A reducer over the cells of a buffer."""
    if callable(how):
        return how(values)
    v = [x for x in values if x is not None and not (isinstance(x, float) and not np.isfinite(x))]
    if how == "count":
        return float(len(v))
    if how == "sum":
        return float(sum(v))
    if how in ("unique", "samples") or top_size(how):
        flat = v
        if how == "samples":
            return flat
        if how == "unique":
            return sorted(set(flat))
        return [x for _, x in sorted((-flat.count(x), x) for x in set(flat))][: top_size(how)]
    if not v:
        return None
    if how in ("first", "last"):
        return v[0 if how == "first" else -1]
    if how == "keep":
        return v[0] if len(set(v)) == 1 else None
    a = np.asarray(v, float)
    q = 0.5 if how == "median" else percentile_rank(how)
    if q is not None:
        return float(np.quantile(a, q))
    return float({"avg": a.mean, "mean": a.mean, "min": a.min, "max": a.max, "stdev": a.std, "difference": lambda: a.max() - a.min()}[how]())


@dataclass(frozen=True)
class Trigger:
    """When to emit: every row, every n rows, or when a row crosses a boundary of a clock (the
    first row arms it; one emission per crossing, stamped with the new boundary)."""

    kind: str = "event"
    n: int = 0

    @staticmethod
    def event() -> Trigger:
        return Trigger()

    @staticmethod
    def count(n: int) -> Trigger:
        return Trigger("count", n)

    @staticmethod
    def clock(step: str) -> Trigger:
        return Trigger("clock", duration_us(step))

    every = clock

    def crossings(self, state: dict, times: np.ndarray) -> list[tuple[int, int]]:
        """The places and stamps of all that a clock makes of rows that come in this order."""
        if not len(times):
            return []
        cell, last = times // self.n, state.get("__cell")
        before = np.maximum.accumulate(np.concatenate([cell[:1] if last is None else [last], cell]))
        state["__cell"] = int(before[-1])
        return [(int(i), int(cell[i]) * self.n) for i in np.flatnonzero(cell > before[:-1])]

    def fires(self, state: dict, t: int) -> int | None:
        """The time to stamp an emission with, or None."""
        if self.kind == "event":
            return t
        if self.kind == "count":
            state["__fired"] = state.get("__fired", 0) + 1
            if state["__fired"] >= self.n:
                state["__fired"] = 0
                return t
            return None
        cell, last = t // self.n, state.get("__cell")
        state["__cell"] = cell if last is None else max(cell, last)
        return cell * self.n if last is not None and cell > last else None


@dataclass
class Rolling(Step):
    """Sliding windows [t - w, t] (closed: live windows keep a row of age w), or of ``count`` rows.

    ``windows`` maps a width (or None, for a count) to a mapping of outputs; several widths
    share one buffer and one trigger.  A late row counts as a new arrival.  Under a clock with
    ``synced`` all keys report together when any of them crosses a boundary.
    """

    windows: Mapping[str | None, Mapping]
    trigger: Trigger = field(default_factory=Trigger)
    count: int | None = None
    min_samples: int = 0
    synced: bool = False

    def _out(self, fields):
        self.all_keys_cols = self.by
        self.plan: list[tuple[int | None, list[Output]]] = []
        types = {c: self.fields[c] for c in self.by} | {self.time: self.fields[self.time]}
        for width, mapping in self.windows.items():
            outs = outputs(mapping, list(self.fields))
            self.plan.append((duration_us(width) if width else None, outs))
            for o in outs:
                lists = not callable(o.reducer) and (o.reducer in ("samples", "unique") or top_size(o.reducer))
                same = o.reducer in ("first", "last", "keep")
                types[o.name] = f"array<{self.fields[o.source]}>" if lists else self.fields[o.source] if same else "double"
        names = [o.name for _, outs in self.plan for o in outs]
        if len(set(names)) < len(names):
            raise ValueError("output names must differ")
        self.columns = list(types)
        self.schema = ", ".join(f"`{c}` {t}" for c, t in types.items())
        self.sources = sorted({o.source for _, outs in self.plan for o in outs})

    @property
    def all_keys(self):
        return self.synced

    def start(self):
        return {"buffers": {}}

    def narrowed(self, df, order):
        """The columns that are read; where all keys share a clock, only rows that some report can see, and the
        first of each key and cell in each batch of Arrow: the clock and the keys' list need no others."""
        df = df.select(*dict.fromkeys([*self.by, self.time, *([order] if order else []), *self.sources]))
        widths = [w for w, _ in self.plan]
        if self.marked or not self.synced or self.trigger is None or self.trigger.kind != "clock" or None in widths:
            return df
        time, by, n, reach = self.time, self.by, self.trigger.n, max(widths)

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t = batch.column(time).cast(pa.timestamp("us", batch.schema.field(time).type.tz)).cast(pa.int64()).to_pandas().to_numpy()
                keep = t >= (t // n + 1) * n - reach
                rest = np.flatnonzero(~keep)
                keys = pd.DataFrame({"cell": t[rest] // n, "t": t[rest], "at": rest} | {f"k{i}": batch.column(c).to_pandas().to_numpy()[rest] for i, c in enumerate(by)})
                if order:
                    keys["o"] = batch.column(order).to_pandas().to_numpy()[rest]
                keys = keys.sort_values(["t", *(["o"] if order else [])], kind="stable")
                firsts = keys.drop_duplicates(["cell", *[f"k{i}" for i in range(len(by))]])
                keep[firsts["at"].to_numpy()] = True
                yield batch.filter(pa.array(keep))

        return df.mapInArrow(seen, df.schema)

    def _emit(self, key, stamp, buf) -> dict:
        now = stamp
        row = dict(zip(self.by, key, strict=True)) | {self.time: pd.Timestamp(stamp * 1000)}
        times = [b[0] for b in buf]
        for width, outs in self.plan:
            part = buf[-self.count :] if width is None and self.count else buf if width is None else [b for b in buf if b[0] >= now - width] if times != sorted(times) else buf[bisect_left(times, now - width) :]
            enough = len(part) >= self.min_samples
            for o in outs:
                i = self.sources.index(o.source)
                row[o.name] = reduce_values(o.reducer, [b[1][i] for b in part]) if enough else None
        return row

    def _evict(self, buf, now):
        widths = [w for w, _ in self.plan]
        if None in widths:
            if self.count:
                del buf[: -self.count]
        else:
            buf[:] = [b for b in buf if b[0] >= now - max(widths)]

    def takes(self, states, rows, cuts):
        outs = [self._reports(s, rows.iloc[a:b]) for s, (a, b) in zip(states, pairwise(cuts), strict=True)]
        return pd.DataFrame([r for o in outs for r in o], columns=self.columns), [len(o) for o in outs]

    def _reports(self, state, rows) -> list[dict]:
        times, out = _times(rows[self.time]), []
        buffers = state["buffers"]
        if self.trigger.kind == "clock":
            at = 0
            for i, stamp in self.trigger.crossings(state, times):
                # the boundary is reported before the row that crossed it comes in
                self._come(state, rows.iloc[at:i], times[at:i])
                at, key = i, self._keys(rows.iloc[i : i + 1])[0]
                for k in sorted(buffers, key=str) if self.synced else [key] if key in buffers else []:
                    self._evict(buffers[k], stamp)
                    if buffers[k] or self.synced:
                        out.append(self._emit(k, stamp, buffers[k]))
            self._come(state, rows.iloc[at:], times[at:])
        elif self.trigger.kind == "count" and self.trigger.n > len(rows) + state.get("__fired", 0):
            state["__fired"] = state.get("__fired", 0) + len(rows)
            self._come(state, rows, times)
        else:
            cells = list(zip(*[rows[c].tolist() for c in self.sources], strict=True))
            for key, t, cell in zip(self._keys(rows), times.tolist(), cells, strict=True):
                stamp = self.trigger.fires(state, t)
                self._add(state, key, [(t, cell)])
                if stamp is not None:
                    out.append(self._emit(key, stamp, buffers[key]))
        return out

    def _keys(self, rows) -> list[tuple]:
        none = lambda c: [None if lacks else x for x, lacks in zip(c.tolist(), c.isna(), strict=True)] if c.isna().any() else c.tolist()
        return list(zip(*[none(rows[c]) for c in self.by], strict=True)) if self.by else [()] * len(rows)

    def _come(self, state, rows, times):
        come: dict[tuple, list] = {}
        cells = list(zip(*[rows[c].tolist() for c in self.sources], strict=True))
        for key, t, cell in zip(self._keys(rows), times.tolist(), cells, strict=True):
            come.setdefault(key, []).append((t, cell))
        for key, more in come.items():
            self._add(state, key, more)

    def _add(self, state, key, more):
        """Rows come into a key's buffer and what is too old leaves it, which looks at the oldest only as long as rows come in order."""
        buf, loose = state["buffers"].setdefault(key, []), state.setdefault("loose", set())
        if (buf and buf[-1][0] > more[0][0]) or any(a[0] > b[0] for a, b in zip(more, more[1:], strict=False)):
            loose.add(key)
        buf += more
        widths = [w for w, _ in self.plan]
        if None in widths:
            if self.count:
                del buf[: -self.count]
        elif key in loose:
            self._evict(buf, max(b[0] for b in buf))
        elif buf[0][0] < buf[-1][0] - max(widths):
            del buf[: bisect_left(buf, buf[-1][0] - max(widths), key=lambda b: b[0])]


@dataclass
class Reduce(Rolling):
    """All retained rows (the last ``count``, or of the last width): one emission per micro-batch, or when
    the ``trigger`` fires if there is one."""

    trigger: Trigger | None = None

    def _reports(self, state, rows):
        if self.trigger is not None:
            return super()._reports(state, rows)
        trigger, self.trigger = self.trigger, Trigger("count", 1 << 62)
        try:
            super()._reports(state, rows)
        finally:
            self.trigger = trigger
        out = []
        for key in dict.fromkeys(self._keys(rows)):
            buf = state["buffers"][key]
            out.append(self._emit(key, max(b[0] for b in buf), buf))
        return out


@dataclass
class Retain(Step):
    """Keeps a key's last ``max_events`` rows, and none older than ``max_age`` before its latest.

    ``emit`` 'evicted' gives the rows that leave, in order and once each; 'kept' what is there
    after each micro-batch, with its number as ``__batch``: the window view, whose latest
    batch is the present; 'stats' a line a micro-batch: rows so far, rows evicted, rows kept,
    the times of the first and last kept and their rate a second.
    """

    max_events: int | None = None
    max_age: str | None = None
    emit: str = "evicted"

    def bound(self, live, df):
        if self.emit not in ("evicted", "kept", "stats"):
            raise ValueError(f"not an emission: {self.emit!r}")
        if live.grace and self.max_age and duration_us(live.grace.replace(" seconds", "s")) > duration_us(self.max_age):
            raise ValueError("a late row within the grace would be evicted at once: grace is longer than max_age")
        return super().bound(live, df)

    def made(self):
        return {"__batch": "long"} if self.emit == "kept" else {}

    def _out(self, fields):
        super()._out(fields)
        self.held = [c for c in self.fields]
        if self.emit == "stats":
            types = {c: self.fields[c] for c in self.by} | {"rows": "long", "evicted": "long", "kept": "long", "first": self.fields[self.time], "last": self.fields[self.time], "rate": "double"}
            self.columns, self.schema = list(types), ", ".join(f"`{c}` {t}" for c, t in types.items())

    def start(self):
        return {"rows": [], "seen": 0, "gone": 0, "batch": -1}

    def takes(self, states, rows, cuts):
        at, age = self.held.index(self.time), duration_us(self.max_age) if self.max_age else None
        cells = rows[self.held].astype(object)
        cells = list(cells.where(cells.notna(), None).itertuples(index=False, name=None))
        keys = list(zip(*[rows[c].iloc[cuts[:-1]].tolist() for c in self.by], strict=True)) if self.by else [()] * len(states)
        lists, counts, batch = [], [], []
        for state, key, (a, b) in zip(states, keys, pairwise(cuts), strict=True):
            held = state["rows"]
            held += cells[a:b]
            held.sort(key=lambda r: r[at])  # stable: late rows of one time keep their order of arrival
            out = max(0, len(held) - self.max_events) if self.max_events is not None else 0
            if age is not None:
                cutoff = _at(held[-1][at]) - age
                while out < len(held) and _at(held[out][at]) < cutoff:
                    out += 1
            gone = held[:out]
            del held[:out]
            state["seen"] += b - a
            state["gone"] += out
            state["batch"] += 1
            if self.emit == "stats":
                first, last = (held[0][at], held[-1][at]) if held else (None, None)
                span = (_at(last) - _at(first)) / 1e6 if held else 0.0
                gives = [dict(zip(self.by, key, strict=True)) | {"rows": state["seen"], "evicted": state["gone"], "kept": len(held), "first": first, "last": last, "rate": len(held) / span if span > 0 else None}]
            else:
                gives = gone if self.emit == "evicted" else held
                batch += [state["batch"]] * len(gives)
            lists += gives
            counts.append(len(gives))
        out = pd.DataFrame(lists, columns=self.columns if self.emit == "stats" else self.held)
        return (out.assign(__batch=batch) if self.emit == "kept" else out), counts


@dataclass
class Chain(Step):
    """Several steps, one after the other, in one state."""

    steps: list[Step]

    def bound(self, live, df):
        self.time, self.by = live.time, list(live.by)
        fields = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name != "__all"}
        for s in self.steps:
            s.time, s.by, s.fields = self.time, self.by, dict(fields)
            s._out(None)
            fields = dict(x.strip("`").split("` ") for x in s.schema.split(", `"))
        self.columns, self.schema = self.steps[-1].columns, self.steps[-1].schema
        self.all_keys = any(s.all_keys for s in self.steps)
        return self

    def start(self):
        return {i: s.start() for i, s in enumerate(self.steps)}

    def takes(self, states, rows, cuts):
        some, counts = list(range(len(states))), np.diff(cuts).tolist()
        for i, s in enumerate(self.steps):
            some = [k for k, n in zip(some, counts, strict=True) if n]
            if not some:
                break
            rows, counts = s.takes([states[k][i] for k in some], rows.reset_index(drop=True), np.cumsum([0, *[n for n in counts if n]]).tolist())
        all_ = [0] * len(states)
        for k, n in zip(some, counts, strict=False):
            all_[k] = n
        return rows, all_


def window_view(spark, path: str, live: Live, size: int | str, order: str | None = None) -> DataFrame:
    """The present contents of a window over all that a stream has to give: the last ``size`` rows of
    each key, or those of the last so long.  Runs what is available into the folder ``path``; the
    result is a plain DataFrame, for any read of columns."""
    step = Retain(max_events=size, emit="kept") if isinstance(size, int) else Retain(max_age=size, emit="kept")
    out = live.through(step, order)
    out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(out.schema).parquet(f"{path}/rows")
    last = rows.groupBy(*live.by).agg(F.max("__batch").alias("__batch"))
    return join_on(rows, last, [*live.by, "__batch"]).drop("__batch")


def from_json(lines: DataFrame, schema: dict[str, str], time: str, zone: str = "UTC", column: str = "value") -> Live:
    """A live series of JSON objects, one a row; malformed ones and those without a time are left out."""
    kinds = ddl({n: ("string" if n == time else k) for n, k in schema.items()})
    row = F.from_json(column, kinds)
    df = lines.select(row.alias("r")).select("r.*").withColumn(time, parse_time(time, zone).cast("timestamp")).filter(F.col(time).isNotNull())
    return Live(df, time)


def event_rate(df: DataFrame, time: str, by: list[str] | None = None) -> DataFrame:
    """Rows per second of the retained extent (batch, or update mode)."""
    by = by or []
    span = (F.unix_micros(F.max(time).cast("timestamp")) - F.unix_micros(F.min(time).cast("timestamp"))) / 1e6
    return (df.groupBy(*by) if by else df.groupBy()).agg(F.count(F.lit(1)).alias("events"), F.when(span > 0, F.count(F.lit(1)) / span).alias("rate"))


def run_to_table(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None):
    """Runs what is available into an in-memory table and waits: for snapshots and tests."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def on_batch(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """A callback per micro-batch."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(fn).start()
