"""Reductions of many sliding windows at once, each in about linear time whatever the windows hold.

A window is a slice [lo, hi) of an array.  Sums, deviations, least and greatest values come
from disjoint tables: at each level the array lies in blocks, every row knows what is between
it and the middle of its block, and a window is what its first and its last row know at the
level where they lie on two sides of a middle.  Nothing is ever subtracted, so no digits are
lost however much is summed.  Percentiles come from a wavelet matrix.  NaN is missing.
"""

from __future__ import annotations

import numpy as np

Bounds = tuple[np.ndarray, np.ndarray]
#: Running sums keep some bits more than their results.
WIDE = np.longdouble


def edges(group: np.ndarray, at: np.ndarray, back, ahead, rows: np.ndarray) -> Bounds:
    """The windows [at - back, at + ahead] of ``rows``, within rows of one group; sorted by both."""
    n = len(at)
    key = np.empty(n, complex)  # complex numbers are ordered by their real parts, then by the others
    key.real, key.imag = group, at
    want = key[rows]
    want.imag = at[rows] - back
    lo = np.searchsorted(key, want, "left")
    want.imag = at[rows] + ahead
    return lo, np.searchsorted(key, want, "right")


def _levels(n: int, lo: np.ndarray, hi: np.ndarray):
    """(level, windows at it, their first rows, their last rows); windows of one row are level -1."""
    first, last = lo, hi - 1
    some = np.flatnonzero(last >= first)
    level = np.frexp((first[some] ^ last[some]).astype(float))[1] - 1
    order = np.argsort(level, kind="stable")
    cuts = np.flatnonzero(np.diff(level[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            at = some[part]
            yield int(level[part[0]]), at, first[at], last[at]


def _blocks(x: np.ndarray, level: int, empty) -> np.ndarray:
    """The array in blocks of 2 ** (level + 1), filled up with ``empty``: (blocks, half, place)."""
    size = 2 << level
    full = np.full(-(-len(x) // size) * size, empty, x.dtype)
    full[: len(x)] = x
    return full.reshape(-1, 2, size // 2)


def _both_ways(x: np.ndarray, level: int, empty, fn) -> np.ndarray:
    """Of each row what is between it and the middle of its block, itself too."""
    b = _blocks(x, level, empty)
    out = np.empty_like(b)
    out[:, 0, ::-1] = fn.accumulate(b[:, 0, ::-1], axis=1)
    out[:, 1] = fn.accumulate(b[:, 1], axis=1)
    return out.reshape(-1)


def _reduced(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, fn, empty) -> np.ndarray:
    out = np.full(len(lo), empty, x.dtype)
    for level, which, a, b in _levels(len(x), lo, hi):
        if level < 0:
            out[which] = x[a]
        else:
            run = _both_ways(x, level, empty, fn)
            out[which] = fn(run[a], run[b])
    return out


def counts(present: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(present, dtype=np.int64)])
    return run[np.maximum(hi, lo)] - run[lo]


def sums(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return _reduced(np.nan_to_num(x, nan=0.0).astype(WIDE), lo, hi, np.add, WIDE(0))


def least(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """NaN where nothing is there."""
    got = _reduced(np.where(np.isnan(x), np.inf, x), lo, hi, np.minimum, np.inf)
    return np.where(got == np.inf, np.nan, got)


def greatest(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return -least(-x, lo, hi)


def before_or_at(present: np.ndarray) -> np.ndarray:
    """The last row at or before each that is present; -1 if none."""
    return np.maximum.accumulate(np.where(present, np.arange(len(present)), -1)) if len(present) else np.zeros(0, int)


def at_or_after(present: np.ndarray) -> np.ndarray:
    """The first row at or after each that is present; one past the end if none."""
    n = len(present)
    return np.minimum.accumulate(np.where(present, np.arange(n), n)[::-1])[::-1] if n else np.zeros(0, int)


def deviations(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Population deviations; NaN of nothing.

    Both sides of a middle are measured from their value next to it, which every window across
    that middle holds if it holds any on that side, and are then put together: equal values
    deviate by nothing at all.
    """
    n, there = len(x), ~np.isnan(x)
    out = np.full(len(lo), np.nan)
    left, right = before_or_at(there), at_or_after(there)
    for level, which, a, b in _levels(n, lo, hi):
        if level < 0:
            out[which] = np.where(there[a], 0.0, np.nan)
            continue
        half = 1 << level
        middles = np.arange(half, max(n, half + 1), 2 * half)
        m = np.minimum(middles, n - 1)
        near = np.zeros((-(-n // (2 * half)), 2))
        for side, at in ((0, left[np.minimum(middles - 1, n - 1)]), (1, right[m])):
            ok = (at >= 0) & (at < n)
            near[: len(middles), side] = np.where(ok, x[np.clip(at, 0, n - 1)], 0.0)
        shift = np.repeat(near.reshape(-1), half)[:n]
        d = np.where(there, x - shift, 0.0).astype(WIDE)
        one, two, k = (_both_ways(v, level, v.dtype.type(0), np.add) for v in (d, d * d, there.astype(np.int64)))
        ka, kb = k[a], k[b]
        with np.errstate(all="ignore"):
            spread_a = np.where(ka > 0, np.maximum(two[a] - one[a] * one[a] / ka, 0), 0)
            spread_b = np.where(kb > 0, np.maximum(two[b] - one[b] * one[b] / kb, 0), 0)
            apart = (shift[b].astype(WIDE) - shift[a]) + (one[b] / kb - one[a] / ka)
            total = spread_a + spread_b + np.where((ka > 0) & (kb > 0), apart * apart * ka * kb / (ka + kb), 0)
            out[which] = np.sqrt((total / (ka + kb)).astype(float))
    return out


def kth(rank: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th least rank (from 0) of each window, which holds more than k; ranks are whole and from 0."""
    lo, hi, k = lo.copy(), hi.copy(), k.copy()
    got = np.zeros(len(lo), np.int64)
    for bit in reversed(range(int(rank.max()).bit_length() if len(rank) else 0)):
        one = (rank >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        a, b = zeros[lo], zeros[hi]
        up = k >= b - a
        k -= np.where(up, b - a, 0)
        got |= up.astype(np.int64) << bit
        lo, hi = np.where(up, zeros[-1] + lo - a, a), np.where(up, zeros[-1] + hi - b, b)
        rank = np.concatenate([rank[~one], rank[one]])
    return got


def percentiles(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: float) -> np.ndarray:
    """Between the two nearest values by their distance; NaN of nothing."""
    there = ~np.isnan(x)
    place = np.concatenate([[0], np.cumsum(there)])
    lo, hi = place[lo], place[np.maximum(hi, lo)]
    out = np.full(len(lo), np.nan)
    some = np.flatnonzero(hi > lo)
    if not len(some):
        return out
    values, rank = np.unique(x[there], return_inverse=True)
    lo, hi = lo[some], hi[some]
    at = q * (hi - lo - 1)
    below = np.floor(at).astype(np.int64)
    low = values[kth(rank, lo, hi, below)]
    out[some] = low
    between = np.flatnonzero(at > below)
    if len(between):
        high = values[kth(rank, lo[between], hi[between], below[between] + 1)]
        at, below, low = at[between], below[between], low[between]
        out[some[between]] = np.where(high == low, low, (below + 1 - at) * low + (at - below) * high)
    return out
