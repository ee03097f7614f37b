"""Level-wise doubling: repeats of one length alone are extended to twice that length."""

from __future__ import annotations

import numpy as np


def repeated_starts(segments: list[np.ndarray], starts: list[int], weights: list[int], window: int, shards: list[int] | None = None) -> list[np.ndarray]:
    """For each segment of units, which of its first ``starts`` positions begin a window found twice here.

    Level 1 names every unit.  At each level a position is named by the pair of names at
    itself and one length further, and only if both were repeated at the level before;
    names found once (counting a segment of weight w as w) are candidates no more.  The
    window's own length is reached by a last pair that overlaps.  Ends when no candidate
    survives or the window is reached; there, only window starts count.  ``shards`` is not used.
    """
    size = np.array([len(s) for s in segments], np.int64)
    units = np.concatenate(segments)
    n = len(units)
    at = np.cumsum(size) - size
    end = np.repeat(at + size, size)
    weight = np.repeat(np.array(weights, np.int64), size)
    is_start = np.zeros(n, bool)
    for a, k in zip(at, starts, strict=True):
        is_start[a : a + k] = True
    hit = np.zeros(n, bool)
    name, alive, span = np.zeros(n, np.int64), np.zeros(n, bool), 1
    cand = np.arange(n) if window > 1 else np.flatnonzero(is_start)
    key: np.ndarray = units
    while len(cand):
        _, inv = np.unique(key, return_inverse=True)
        twice = np.bincount(inv, weights=weight[cand])[inv] >= 2
        if span == window:
            hit[cand] = twice
            break
        alive[:] = False
        name[cand], alive[cand] = inv, twice
        step = min(span, window - span)
        span += step
        here = cand[twice]
        here = here[here + span <= end[here]]
        if span == window:
            here = here[is_start[here]]
        cand = here[alive[here + step]]
        key = name[cand] * n + name[cand + step]
    return [hit[a : a + k] for a, k in zip(at, starts, strict=True)]
