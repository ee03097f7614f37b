"""Robust multivariate outliers: minimum covariance determinant per group, in DataFrames.

Each group starts from several estimates: medians with median absolute deviations, the
covariance of spatial signs around the medians, and plain mean and covariance.  Concentration
steps run over all rows of all groups and starts at once: each finds the h rows nearest by
the present estimate and takes mean and covariance of those, which never raises the
determinant.  They go on until the determinant stays, and of a group's starts the one with
the least determinant wins.

The h-th distance comes from a histogram (counted partially before the shuffle), so no group is
ever gathered, whatever its size.  Bins are sixteenths of an octave far from the bound of
the step before and millionths of an octave around it, so once a bound settles its bin holds
rows of practically one distance; they come in with the weight that makes h in all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import meet, written

#: Share of a group's rows that the estimate is of, and the most steps.
ALPHA, STEPS = 0.75, 40
#: Bins of an octave of squared distances, far from the last bound and around it, and how far around.
COARSE, FINE, AROUND = 16, 1 << 20, 1 / 64
#: A determinant that falls by less than this share of itself stays.
SETTLED = 1e-7


def chi2_cdf(x: float, p: int) -> float:
    """Of p degrees of freedom, by the series of the incomplete gamma function."""
    a, x = p / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    for k in range(1, 1000):
        term *= x / (a + k)
        total += term
        if term < total * 1e-15:
            break
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, p) < q else (lo, mid)
    return hi


def consistency(share: float, p: int) -> float:
    """Makes the covariance of the innermost share of normal rows one of all."""
    if share >= 1:
        return 1.0
    q = chi2_quantile(share, p)
    return share / max(chi2_cdf(q, p + 2), 1e-9)


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def distance(p: int) -> Column:
    """Squared Mahalanobis distance of columns f0.. from centre and precision."""
    d = [F.col(f"f{i}") - F.col("centre")[i] for i in range(p)]
    return sum((d[i] * d[j] * F.col("precision")[k] * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(_pairs(p))), F.lit(0.0))


MODEL = "g string, s int, n long, inner double, centre array<double>, precision array<double>, log_det double, bound double"


def _inverse(cov: np.ndarray) -> tuple[list[float], float]:
    inv = np.linalg.inv(cov)
    return [float(inv[i, j]) for i, j in _pairs(len(cov))], float(np.linalg.slogdet(cov)[1])


def _moments(r: dict, names: str, p: int, weight: float) -> tuple[np.ndarray, np.ndarray]:
    mean = np.array([r[f"{names[0]}{i}"] for i in range(p)]) / weight
    cov = np.zeros((p, p))
    for i, j in _pairs(p):
        cov[i, j] = cov[j, i] = r[f"{names[1]}{i}_{j}"] / weight - mean[i] * mean[j]
    return mean, cov


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in MODEL.split(", ")])


def _starts(p: int, floors: list[float]):
    """A group's sums to its starting estimates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ridge = np.square(floors)
        for df in batches:
            out = []
            for r in df.to_dict("records"):
                middle = np.array([r[f"m{i}"] for i in range(p)], float)
                width = np.sqrt((np.array([r[f"d{i}"] for i in range(p)], float) * 1.4826) ** 2 + ridge)
                mean, cov = _moments(r, "sq", p, r["n"])
                signs = np.zeros((p, p))
                for i, j in _pairs(p):
                    signs[i, j] = signs[j, i] = r[f"u{i}_{j}"] / r["n"]
                for k, (centre, scatter) in enumerate(((middle, np.diag(width**2)), (middle, signs * np.outer(width, width) * p + np.diag(ridge)), (mean, cov + np.diag(ridge)))):
                    out.append((r["g"], k, r["n"], 0.0, centre.tolist(), _inverse(scatter)[0], math.inf, 1.0))
            yield _frame(out)

    return run


def _estimates(p: int, floors: list[float]):
    """Sums of the inner rows to centre and precision."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for r in df.to_dict("records"):
                mean, cov = _moments(r, "sq", p, max(r["inner"], 1.0))
                cov = cov * consistency(r["inner"] / r["n"], p) + np.diag(np.square(floors))
                out.append((r["g"], r["s"], r["n"], r["inner"], mean.tolist(), *_inverse(cov), r["bound"]))
            yield _frame(out)

    return run


def _bin(p: int) -> Column:
    """Ascends with the distance: fine around the model's last bound, coarse elsewhere."""
    x = F.log2(F.col("dist") + F.lit(1e-12)) - F.log2(F.col("bound") + F.lit(1e-12))
    edge = int(AROUND * FINE)
    far = F.floor((F.abs(x) - F.lit(AROUND)) * COARSE) + 1
    return F.when(F.abs(x) < AROUND, F.floor(x * FINE)).when(x > 0, edge + far).otherwise(-edge - far)


def step(rows: DataFrame, model: DataFrame, p: int, floors: list[float], alpha: float) -> DataFrame:
    """One concentration step of each group and start in ``model``."""
    placed = meet(rows, model.select("g", "s", "n", "centre", "precision", "bound"), "g").withColumn("dist", F.greatest(distance(p), F.lit(0.0)))
    names = [f"s{i}" for i in range(p)] + [f"q{i}_{j}" for i, j in _pairs(p)]
    sums = [F.sum(f"f{i}").alias(f"s{i}") for i in range(p)] + [F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"q{i}_{j}") for i, j in _pairs(p)]
    bins = placed.withColumn("bin", _bin(p)).groupBy("g", "s", "bin").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.max("dist").alias("far"), *sums)
    # bins of a group are bounded by their widths, whatever its rows
    below = F.sum("c").over(Window.partitionBy("g", "s").orderBy("bin")) - F.col("c")
    weight = F.least(F.lit(1.0), (F.ceil(F.col("n") * alpha) - F.col("below")) / F.col("c"))
    inside = bins.withColumn("below", below).withColumn("w", weight).filter("w > 0")
    inner = inside.groupBy("g", "s").agg(F.first("n").alias("n"), F.sum(F.col("w") * F.col("c")).alias("inner"), F.max("far").alias("bound"), *[F.sum(F.col("w") * F.col(c)).alias(c) for c in names])
    return inner.mapInPandas(_estimates(p, floors), MODEL)


def fit(rows: DataFrame, p: int, floors: list[float], alpha: float = ALPHA, steps: int = STEPS) -> DataFrame:
    """``rows(g, f0, ..)`` to a row per group: (g, n, centre, precision, log_det, settled).

    The estimate is of ceil(alpha n) rows.  ``floors`` are standard deviations added to each
    column's, so that a column that hardly varies in a group doesn't make its scatter
    singular; determinants are compared with them.  ``settled`` is false where the determinant
    still fell after so many steps.
    """
    middle = written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(f"f{i}", 0.5, 1000).alias(f"m{i}") for i in range(p)]))
    spread = meet(rows, middle, "g").groupBy("g").agg(F.first("n").alias("n"), *[F.first(f"m{i}").alias(f"m{i}") for i in range(p)], *[F.percentile_approx(F.abs(F.col(f"f{i}") - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i in range(p)])
    spread = written(spread)
    unit = [(F.col(f"f{i}") - F.col(f"m{i}")) / F.sqrt(F.pow(F.col(f"d{i}") * 1.4826, 2) + floors[i] ** 2) for i in range(p)]
    norm = sum((u * u for u in unit), F.lit(0.0))
    sums = [F.sum(f"f{i}").alias(f"s{i}") for i in range(p)] + [F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"q{i}_{j}") for i, j in _pairs(p)]
    signs = [F.sum(F.when(norm > 0, unit[i] * unit[j] / norm).otherwise(0.0)).alias(f"u{i}_{j}") for i, j in _pairs(p)]
    moments = meet(rows, spread.drop("n"), "g").groupBy("g").agg(*sums, *signs)
    now = written(spread.join(moments, "g").mapInPandas(_starts(p, floors), MODEL))
    done = None
    for _ in range(steps):
        moved = written(step(rows, now, p, floors, alpha))
        last = now.select("g", "s", F.col("log_det").alias("last"))
        both = moved.join(last, ["g", "s"]).withColumn("settled", (F.col("last") != float("inf")) & (F.col("log_det") >= F.col("last") - F.lit(SETTLED)))
        both = written(both.drop("last"))
        still = both.filter("settled")
        done = still if done is None else done.unionByName(still)
        now = both.filter("not settled").drop("settled")
        if now.isEmpty():
            break
    every = now.withColumn("settled", F.lit(False)) if done is None else done.unionByName(now.withColumn("settled", F.lit(False)))
    best = every.groupBy("g").agg(F.min_by(F.struct("n", "centre", "precision", "log_det", "settled"), F.struct("log_det", "s")).alias("x"))
    return written(best.select("g", "x.*"))
