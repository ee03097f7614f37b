"""Ways in and out: rows, columns, JSON, Arrow, events, points, files; and a registry of named sources."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import from_us, parse_time
from ..series import Series

KINDS = {"number": "double", "string": "string", "boolean": "boolean", "time": "timestamp_ntz"}
#: Times in JSON keep their microseconds.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
ARROW_REFUSED = (pa.types.is_decimal, pa.types.is_float16)


def ddl(schema: dict[str, str]) -> str:
    """{'time': 'time', 'cpu': 'number', 'tags': 'array<string>'} as a Spark schema."""
    out = []
    for name, kind in schema.items():
        elem = kind.removeprefix("array<").removesuffix(">")
        out.append(f"`{name}` " + (f"array<{KINDS[elem]}>" if kind.startswith("array") else KINDS[kind]))
    return ", ".join(out)


def from_rows(spark: SparkSession, rows: list, schema: dict[str, str], seq: str = "__seq", **key) -> Series:
    """Rows as tuples or dicts, in order; the order breaks ties."""
    names = list(schema)
    data = [(*(r.get(n) for n in names), i) if isinstance(r, dict) else (*r, i) for i, r in enumerate(rows)]
    return Series.of(spark.createDataFrame(data, f"{ddl(schema)}, `{seq}` bigint"), seq=seq, **(key or {"time": names[0]}))


def from_columns(spark: SparkSession, columns: dict[str, list], schema: dict[str, str], seq: str = "__seq", **key) -> Series:
    """Equal-length columns; numbers that aren't finite become missing."""
    if len({len(c) for c in columns.values()}) > 1:
        raise ValueError("columns differ in length")
    ok = lambda x, kind: None if kind == "number" and isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))) else x
    return from_rows(spark, [tuple(ok(x, schema[n]) for n, x in zip(schema, r, strict=True)) for r in zip(*(columns[n] for n in schema), strict=True)], schema, seq, **key)


#: Microseconds of a unit of whole-number times.
UNITS = {"s": 1_000_000, "ms": 1_000, "us": 1, "ns": 1e-3}


def from_arrow(spark: SparkSession, table: pa.Table, time: str | None = None, columns: list[str] | None = None, time_unit: str = "ms", sort: bool = True, **key) -> Series:
    """An Arrow table.  Keys are timestamps, or whole numbers in ``time_unit`` ('s', 'ms', 'us', 'ns'); a point's
    ``time``, or ``begin`` and ``end`` and ``label`` as the key's columns are named.  Without ``sort`` a key that
    isn't in order is an error: an order is a promise that the caller then makes."""
    if time_unit not in UNITS:
        raise ValueError(f"not a unit: {time_unit!r}")
    for f in table.schema:
        if any(refused(f.type) for refused in ARROW_REFUSED):
            raise TypeError(f"unsupported Arrow type {f.type} of {f.name!r}")
    name = time or next((v for v in key.values() if isinstance(v, str)), None)
    if name and table[name].null_count:
        raise ValueError("the key has nulls")
    if not sort and name and table.num_rows > 1:
        k = table[name].combine_chunks()
        if pc.any(pc.less(k.slice(1), k.slice(0, len(k) - 1))).as_py():
            raise ValueError(f"{name!r} isn't in order")
    names = [v for v in (time, *(key.get(k) for k in ("begin", "end", "label", "value"))) if v]
    keep = table.select(list(dict.fromkeys([*names, *columns]))) if columns else table
    keep = keep.append_column("__seq", pa.array(range(keep.num_rows), pa.int64()))
    df = spark.createDataFrame(keep)
    for c in (time, key.get("begin"), key.get("end")):
        if c and pa.types.is_integer(table.schema.field(c).type):
            df = df.withColumn(c, from_us(F.floor(F.col(c) * UNITS[time_unit]).cast("bigint")))
    return Series.of(df, time=time, seq="__seq", **key)


def from_json(spark: SparkSession, path: str, schema: dict[str, str], time: str, zone: str = "UTC", seq: str | None = None) -> Series:
    """JSON lines; the key as ISO, date-only, year-month or zone-local text, or milliseconds."""
    raw = spark.read.schema(ddl({n: ("string" if n == time else k) for n, k in schema.items()})).json(path)
    key = F.when(F.col(time).rlike(r"^-?\d{5,}(\.\d+)?$"), F.timestamp_micros((F.col(time).cast("double") * 1000).cast("bigint")).cast("timestamp_ntz")).otherwise(parse_time(time, zone))
    return Series.of(raw.withColumn(time, key), time=time, seq=seq)


def from_points(spark: SparkSession, points: list[dict], schema: dict[str, str], **key) -> Series:
    return from_rows(spark, [{**p, next(iter(schema)): p["ts"]} for p in points], schema, **key)


from_events = from_rows


def read(spark: SparkSession, path: str, fmt: str = "parquet", **key) -> Series:
    """A table in any format Spark reads; pruning and pushed-down filters stay with the reader."""
    seq = key.pop("seq", None)
    return Series.of(spark.read.format(fmt).load(path), seq=seq, **key)


def write(s: Series, path: str, fmt: str = "parquet", partition: list[str] | None = None, mode: str = "errorifexists") -> None:
    w = s.df.write.format(fmt).mode(mode)
    (w.partitionBy(*partition) if partition else w).save(path)


def _in_order(s: Series) -> DataFrame:
    return s.df.orderBy(*s.by, *s.key, *([s.seq] if s.seq else []))


def to_json_rows(s: Series, arrays: bool = False) -> DataFrame:
    """A JSON object per row, or an array of its cells in the columns' order; missing is null."""
    cols = [c for c in s.df.columns if c != s.seq]
    if arrays:
        options = {"timestampNTZFormat": MICROS, "timestampFormat": f"{MICROS}XXX"}
        bare = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v")), options | {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)
        return s.df.select(F.concat(F.lit("["), F.concat_ws(",", *map(bare, cols)), F.lit("]")).alias("json"))
    return s.df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false", "timestampNTZFormat": MICROS, "timestampFormat": f"{MICROS}XXX"}).alias("json"))


def to_points(s: Series) -> DataFrame:
    return _in_order(s).select(F.col(s.key[0]).alias("ts"), *s.by, *s.values)


def to_rows(s: Series) -> list[tuple]:
    return [tuple(r) for r in _in_order(s).drop(*([s.seq] if s.seq else [])).collect()]


def to_columns(s: Series) -> dict[str, list]:
    return _in_order(s).drop(*([s.seq] if s.seq else [])).toArrow().to_pydict()


def to_arrow(s: Series) -> pa.Table:
    return _in_order(s).drop(*([s.seq] if s.seq else [])).toArrow()


class Registry:
    """Named lazy sources: a name stands for whatever its loader gives when a plan asks."""

    def __init__(self):
        self._loaders: dict[str, Callable[[], Series]] = {}

    def define(self, name: str, loader: Callable[[], Series]) -> None:
        if name in self._loaders:
            raise ValueError(f"source {name!r} is defined")
        self._loaders[name] = loader

    def get(self, name: str) -> Series:
        if name not in self._loaders:
            raise KeyError(f"unknown source {name!r}")
        return self._loaders[name]()

    def names(self) -> list[str]:
        return sorted(self._loaders)
