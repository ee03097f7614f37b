"""A fluent way to write specs: col('close').op('sma', period=20).op('scale', by=2)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Expr:
    spec: object

    def op(self, name: str, *others: Expr, **params) -> Expr:
        return Expr({"op": name, "params": params, "inputs": [self.spec, *(o.spec for o in others)]})

    def __add__(self, o: Expr) -> Expr:
        return self.op("add", o)

    def __sub__(self, o: Expr) -> Expr:
        return self.op("sub", o)

    def __mul__(self, o: Expr) -> Expr:
        return self.op("mul", o)

    def __truediv__(self, o: Expr) -> Expr:
        return self.op("div", o)


def col(name: str) -> Expr:
    return Expr(name)


def slot(name: str) -> Expr:
    return Expr({"slot": name})


def plan(**outputs: Expr) -> Mapping[str, object]:
    return {k: v.spec for k, v in outputs.items()}
