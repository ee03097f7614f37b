"""Gap filling: a gap is filled as a whole or not at all."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..series import Series

STRATEGIES = ("hold", "bfill", "linear", "zero")


def fill(s: Series, how: str | Mapping[str, object], limit: int | None = None, max_gap: str | int | None = None) -> Series:
    """Fills missing cells by 'hold', 'bfill', 'linear', 'zero' or a literal ({'literal': x}).

    ``limit`` is the longest gap in rows, ``max_gap`` the longest in time: from the row
    before the gap to the row after it, or as far as there are rows.  Zero and linear pass
    over columns that aren't numbers; a literal must be of the column's kind.  Each cell
    sees the nearest cells on both sides that aren't missing, read in one pass each way.
    """
    plan = {c: how for c in s.values} if isinstance(how, str) else dict(how)
    cap = s.us(max_gap) if max_gap is not None else None
    todo: dict[str, tuple[str, object]] = {}
    for c, mode in plan.items():
        literal = mode["literal"] if isinstance(mode, dict) else None
        mode = "literal" if isinstance(mode, dict) else mode
        if mode not in (*STRATEGIES, "literal"):
            raise ValueError(f"not a strategy: {mode!r}")
        if mode in ("zero", "linear") and not s.is_number(c):
            continue
        if mode == "literal" and isinstance(literal, str) != (s.types[c] == "string"):
            raise TypeError(f"{literal!r} isn't of the kind of {c}")
        todo[c] = (mode, literal)
    bounded = limit is not None or cap is not None
    looks = {c for c, (m, _) in todo.items() if bounded or m not in ("zero", "literal")}
    df = s.df
    if looks:
        n = F.lit(0).cast("bigint")
        if limit is not None:
            df, n = s.ordered(number="__n"), F.col("__n")
        here = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), s.at.alias("t"), n.alias("n"))) for c in looks}
        whole = {"__t0": ("min", s.at), "__t1": ("max", s.at), "__rows": ("count", F.lit(1))}
        df = s.with_df(df).ordered(back={f"__p_{c}": v for c, v in here.items()}, ahead={f"__f_{c}": v for c, v in here.items()}, whole=whole if bounded else {})

    def filled(c: str, mode: str, literal: object) -> Column:
        if c not in looks:
            return F.coalesce(F.col(c), F.lit(0).cast(s.types[c]) if mode == "zero" else F.lit(literal))
        p, f = F.col(f"__p_{c}"), F.col(f"__f_{c}")
        has_p, has_f = p.isNotNull(), f.isNotNull()
        ok = {"hold": has_p, "bfill": has_f, "linear": has_p & has_f}.get(mode, F.lit(True))
        if limit is not None:
            ok = ok & (F.coalesce(f["n"], F.col("__rows") + 1) - F.coalesce(p["n"], F.lit(0)) - 1 <= limit)
        if cap is not None:
            length = F.when(has_p & has_f, f["t"] - p["t"]).when(has_p, F.col("__t1") - p["t"]).when(has_f, f["t"] - F.col("__t0")).otherwise(F.lit(0))
            ok = ok & (length <= cap)
        line = F.when(f["t"] > p["t"], p["v"] + (f["v"] - p["v"]) * ((s.at - p["t"]) / (f["t"] - p["t"]))).otherwise(p["v"])
        value = {"hold": p["v"], "bfill": f["v"], "zero": F.lit(0).cast(s.types[c]), "literal": F.lit(literal), "linear": line}[mode]
        return F.when(F.col(c).isNull() & ok, value).otherwise(F.col(c))

    return s.with_df(df.withColumns({c: filled(c, m, x) for c, (m, x) in todo.items()}).select(*s.df.columns))
