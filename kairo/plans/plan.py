"""Declarative plans: specs named by content, compiled to columns of one DataFrame.

A spec is {"op": name, "params": {...}, "inputs": [spec or column name]}.  Equal specs have
equal ids, whatever the order of their parameters and whether defaults are written out, and
are compiled once.  Only what is selected is built; Catalyst prunes the rest.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..finance import studies
from ..functions.frames import join_on
from ..functions.reducers import finite
from ..operators import windows
from ..operators.folds import ema
from ..series import Series
from ..sources.tables import Registry as Sources

Spec = Mapping[str, object]


@dataclass(frozen=True)
class Op:
    """``build(series, inputs, params, out)`` gives the series with the column ``out``."""

    name: str
    build: Callable[[Series, list[str], dict, str], Series]
    params: dict[str, object] = field(default_factory=dict)  #: defaults; None must be given
    arity: int = 1
    history: Callable[[dict], int] = lambda p: 0  #: rows needed before the first
    unit: str | None = None  #: of the output; None: the input's


class Ops:
    def __init__(self):
        self._ops: dict[str, Op] = {}

    def define(self, op: Op) -> Ops:
        if op.name in self._ops:
            raise ValueError(f"op {op.name!r} is defined")
        self._ops[op.name] = op
        return self

    def get(self, name: str) -> Op:
        if name not in self._ops:
            raise KeyError(f"unknown op {name!r}")
        return self._ops[name]

    def params(self, spec: Spec) -> dict:
        op, given = self.get(spec["op"]), dict(spec.get("params") or {})
        unknown = set(given) - set(op.params)
        if unknown:
            raise ValueError(f"{op.name}: unknown parameters {sorted(unknown)}")
        full = {**op.params, **given}
        if any(v is None for v in full.values()):
            raise ValueError(f"{op.name}: parameters {[k for k, v in full.items() if v is None]} must be given")
        return full

    def describe(self) -> list[dict]:
        return [{"op": o.name, "params": o.params, "arity": o.arity} for o in self._ops.values()]

    def json_schema(self) -> dict:
        kinds = {int: "integer", float: "number", str: "string", bool: "boolean"}
        one = lambda o: {"type": "object", "properties": {"op": {"const": o.name}, "params": {"type": "object", "properties": {k: {"type": kinds.get(type(v), "number")} for k, v in o.params.items()}, "required": [k for k, v in o.params.items() if v is None]}, "inputs": {"type": "array", "minItems": o.arity, "maxItems": o.arity}}, "required": ["op"]}
        return {"oneOf": [one(o) for o in self._ops.values()]}

    def spec_id(self, spec: Spec | str) -> str:
        return "p1-" + hashlib.sha256(json.dumps(self._canonical(spec), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:20]

    def _canonical(self, spec: Spec | str):
        if isinstance(spec, str):
            return {"column": spec}
        num = lambda v: float(v) if isinstance(v, int) and not isinstance(v, bool) else v
        return {"op": spec["op"], "params": {k: num(v) for k, v in self.params(spec).items()}, "inputs": [self._canonical(i) for i in spec.get("inputs") or []]}

    def required_history(self, spec: Spec | str) -> int:
        """Rows before the first that the spec reads: added along nesting, the most of siblings."""
        if isinstance(spec, str):
            return 0
        return self.get(spec["op"]).history(self.params(spec)) + max((self.required_history(i) for i in spec.get("inputs") or []), default=0)


def expand_slots(spec, slots: Mapping[str, Spec | str], within: tuple[str, ...] = ()):
    """Puts named specs in the place of {"slot": name}; a slot that leads back to itself is named."""
    if isinstance(spec, Mapping):
        if "slot" in spec:
            name = spec["slot"]
            if name not in slots:
                raise KeyError(f"no slot {name!r}")
            if name in within:
                raise ValueError(f"slots lead in a circle: {' -> '.join((*within, name))}")
            return expand_slots(slots[name], slots, (*within, name))
        return {**spec, "inputs": [expand_slots(i, slots, within) for i in spec.get("inputs") or []]}
    return spec


class Graph:
    """Specs bound to a series."""

    def __init__(self, series: Series, ops: Ops):
        self.ops, self.series = ops, series
        self._columns: dict[str, str] = {}

    def compile(self, spec: Spec | str) -> str:
        """The column that holds the spec's values; each id is built once."""
        if isinstance(spec, str):
            if spec not in self.series.df.columns:
                raise ValueError(f"unknown column {spec!r}")
            return spec
        name = self.ops.spec_id(spec)
        if name not in self._columns:
            op, inputs = self.ops.get(spec["op"]), list(spec.get("inputs") or [])
            if len(inputs) != op.arity:
                raise ValueError(f"{op.name} takes {op.arity} inputs, not {len(inputs)}")
            args = [self.compile(i) for i in inputs]
            self.series = op.build(self.series, args, self.ops.params(spec), name)
            self._columns[name] = name
        return self._columns[name]


def run(series: Series, ops: Ops, plan: Mapping[str, Spec | str], select: list[str] | None = None, slots: Mapping[str, Spec] | None = None, on_error: str = "throw") -> tuple[DataFrame, dict[str, str]]:
    """The key and the selected outputs as one DataFrame, and the errors by output (with 'collect')."""
    graph, cols, errors = Graph(series, ops), {}, {}
    for name in select or list(plan):
        try:
            cols[name] = graph.compile(expand_slots(plan[name], slots or {}))
        except (KeyError, ValueError, TypeError) as e:
            if on_error != "collect":
                raise
            errors[name] = str(e)
    s = graph.series
    return s.df.select(*s.by, *s.key, *[F.col(c).alias(n) for n, c in cols.items()]), errors


def run_range(series: Series, ops: Ops, plan: Mapping[str, Spec | str], begin: int, end: int, slots: Mapping[str, Spec] | None = None) -> DataFrame:
    """The same outputs for rows ``begin`` to ``end`` (from 0, end left out) of each partition only: of the others
    just as many are read as the specs' history needs.  Exact for ops whose history is finite."""
    specs = [expand_slots(s, slots or {}) for s in plan.values()]
    reach = max((ops.required_history(s) for s in specs), default=0)
    near = series.with_df(series.numbered().filter((F.col("__n") > begin - reach) & (F.col("__n") <= end)))
    kept = dict(plan) | {"__n": "__n"}
    out, _ = run(near, ops, kept, slots=slots)
    return out.filter(F.col("__n") > begin).drop("__n")


# -- folds: one row of facts ---------------------------------------------------------


def facts(s: Series, column: str, points: int = 32) -> DataFrame:
    """last, the extremes with their times, the last value's rank as the share below it: to 6 places."""
    x = finite(F.col(column), s.types[column]).cast("double")
    o = F.when(x.isNotNull(), s.order)
    groups = s.df.groupBy(*s.by) if s.by else s.df.groupBy()
    last = groups.agg(F.max_by(x, o).alias("last"), F.min(x).alias("low"), F.min_by(s.key[0], F.struct(x, s.order)).alias("low_at"), F.max(x).alias("high"), F.max_by(s.key[0], F.struct(x, (-s.at).alias("k"))).alias("high_at"))
    joined = join_on(s.df.select(*s.by, x.alias("__x")), last.select(*s.by, F.col("last").alias("__last")), s.by) if s.by else s.df.select(x.alias("__x")).join(F.broadcast(last.select(F.col("last").alias("__last"))))
    rank = (joined.groupBy(*s.by) if s.by else joined.groupBy()).agg(F.round(F.count_if(F.col("__x") < F.col("__last")) / F.count("__x"), 6).alias("percentile_rank"))
    out = join_on(last, rank, s.by) if s.by else last.join(F.broadcast(rank))
    return out.withColumns({c: F.round(c, 6) for c in ("last", "low", "high")})


def shape(s: Series, column: str, points: int = 32) -> DataFrame:
    """At most ``points`` rows spread evenly over the series."""
    df = s.ordered(number="__n", whole={"__all": ("count", F.lit(1))}).withColumn("__stride", F.greatest(F.ceil(F.col("__all") / points), F.lit(1)))
    return df.filter((F.col("__n") - 1) % F.col("__stride") == 0).select(*s.by, *s.key, F.round(F.col(column).cast("double"), 6).alias(column))


# -- the usual ops -----------------------------------------------------------------------


def _expr(fn: Callable[..., Column]):
    return lambda s, a, p, out: s.with_column(out, fn(*[F.col(x).cast("double") for x in a], **p))


def _quotient(a: Column, b: Column) -> Column:
    """As doubles divide, whatever the session's rules: by zero to an infinity, zero by zero to NaN."""
    return F.when(b != 0, a / b).otherwise(a * F.pow(b, F.lit(-1.0)))


def _of(method):
    """From an operator that replaces a column to one that adds it."""
    return lambda s, a, p, out: method(s.with_column(out, F.col(a[0]).cast("double")), p, out)


def standard_ops() -> Ops:
    period = lambda p: int(p["period"]) - 1
    ops = Ops()
    for o in (
        Op("sma", lambda s, a, p, out: studies.sma(s, int(p["period"]), a[0], out), {"period": None}, history=period),
        Op("ema", lambda s, a, p, out: ema(s, a[0], span=p["period"], min_samples=int(p["period"]), output=out), {"period": None}, history=period),
        Op("stdev", lambda s, a, p, out: studies.rolling_stat(s, int(p["period"]), "stdev", a[0], out), {"period": None}, history=period),
        Op("min", lambda s, a, p, out: studies.rolling_stat(s, int(p["period"]), "min", a[0], out), {"period": None}, history=period),
        Op("max", lambda s, a, p, out: studies.rolling_stat(s, int(p["period"]), "max", a[0], out), {"period": None}, history=period),
        Op("zScore", lambda s, a, p, out: studies.z_score(s, int(p["period"]), a[0], out), {"period": 20}, history=period),
        Op("percentChange", lambda s, a, p, out: studies.percent_change(s, int(p["period"]), a[0], out), {"period": 1}, history=lambda p: int(p["period"])),
        Op("diff", _of(lambda s, p, out: windows.diff(s, out)), history=lambda p: 1),
        Op("rate", _of(lambda s, p, out: windows.rate(s, out)), history=lambda p: 1),
        Op("shift", _of(lambda s, p, out: windows.shift(s, int(p["n"]), out)), {"n": 1}, history=lambda p: max(0, int(p["n"]))),
        Op("add", _expr(lambda a, b: a + b), arity=2),
        Op("sub", _expr(lambda a, b: a - b), arity=2),
        Op("mul", _expr(lambda a, b: a * b), arity=2),
        Op("div", _expr(_quotient), arity=2),
        Op("scale", _expr(lambda a, by: a * by), {"by": None}),
    ):
        ops.define(o)
    return ops


class Host:
    """Named datasets with one set of ops."""

    def __init__(self, ops: Ops | None = None):
        self.ops, self.sources = ops or standard_ops(), Sources()

    def run(self, source: str, plan: Mapping[str, Spec | str], **options) -> tuple[DataFrame, dict[str, str]]:
        return run(self.sources.get(source), self.ops, plan, **options)

    def run_async(self, source: str, plan: Mapping[str, Spec | str], **options) -> Future:
        """The wire form of the outputs and the errors, computed beside the caller's thread."""
        if not hasattr(self, "_pool"):
            self._pool = ThreadPoolExecutor(4, thread_name_prefix="host")

        def work():
            df, errors = self.run(source, plan, **options)
            return to_wire(df), errors

        return self._pool.submit(work)


def to_wire(df: DataFrame) -> bytes:
    """The rows as an Arrow stream, for another process; they come to the driver, so the caller bounds them."""
    table = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def from_wire(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()
