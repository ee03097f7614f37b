"""Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

A shard is a cyclic text: the segments that one share of the corpus brought.  Its rows are
all rotations sorted by their first W units; its transform gives for each row the units
before it.  To merge shards no suffix is sorted again: an interleave vector says, row by row
of the merged order, which shard the next row comes from.  It starts as all of the first
shard, then all of the second, and so on; each round deals the rows stably by the units
before them, after which the interleave is right for one step more.  Block numbers travel
with the rows: a new block begins where the units or the block dealt from change, and the
round in which it begins is the common prefix with the row above.  Repeated intervals are
the runs of rows whose common prefix reaches W.

The transform works on steps of q units at once, which changes neither the order nor the
common prefixes in whole steps: q divides W and leaves ROUNDS rounds or more.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: The least number of rounds that steps of several units may leave, and the longest step.
ROUNDS, LONGEST = 5, 40


class Shard(NamedTuple):
    rows: np.ndarray  #: start of each row, in the group's positions
    before: np.ndarray  #: its transform: the name of the q units before each row


def step_of(window: int) -> int:
    """Units that the transform moves at once."""
    return max(q for q in range(1, min(window, LONGEST) + 1) if window % q == 0 and (window // q >= ROUNDS or q == 1))


def turned(x: np.ndarray, cuts: list[int], by: int) -> np.ndarray:
    """Each position's value ``by`` further on in its own cyclic shard."""
    return np.concatenate([np.roll(x[a:b], -(by % (b - a))) for a, b in zip(cuts, cuts[1:], strict=False)])


def ranked(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def gram_names(text: np.ndarray, cuts: list[int], q: int) -> np.ndarray:
    """Names of each position's next q units, in their order and alike in all shards."""
    key, span = text.astype(np.uint64), 1
    while span * 2 <= min(q, 8):
        key = (key << np.uint64(8 * span)) | turned(key, cuts, span)
        span *= 2
    name = ranked(key)
    while span < q:
        step = min(span, q - span)
        name = ranked(name * len(text) + turned(name, cuts, step))
        span += step
    return name


def shard(name: np.ndarray, at: int, window: int, q: int) -> Shard:
    """Of one cyclic text, by the names of its q-grams; it begins at position ``at`` of the group."""
    n, rank, span = len(name), name, q
    while span < window:
        step = min(span, window - span)
        rank = ranked(rank * (int(rank.max()) + 1) + np.roll(rank, -(step % n)))
        span += step
    order = np.argsort(rank, kind="stable")
    return Shard(order + at, name[(order - q) % n])


def merge(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged rows, and each one's common prefix with the row above in steps, up to ``rounds``."""
    size = [len(s.rows) for s in shards]
    n = sum(size)
    before = np.concatenate([s.before for s in shards]).astype(np.uint64)
    z = np.repeat(np.arange(len(shards), dtype=np.uint16), size)
    lane, low = np.arange(n, dtype=np.uint64), np.uint64(0xFFFFFFFF)
    block = np.zeros(n, np.int32)
    lcp = np.full(n, rounds, np.int32)
    row = np.arange(n)
    blocks = 1
    for t in range(rounds):
        key = (before[row] << np.uint64(32)) | lane
        key.sort()  # the lane in the lower half makes it stable
        order = (key & low).astype(np.int64)
        s, from_block, z = key >> np.uint64(32), block[order], z[order]
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = (s[1:] != s[:-1]) | (from_block[1:] != from_block[:-1])
        row[np.argsort(z, kind="stable")] = lane.view(np.int64)  # the i-th of a shard here is its i-th row
        lcp[new & (lcp == rounds)] = t
        block = np.cumsum(new, dtype=np.int32)
        if block[-1] == blocks:  # a partition that one round leaves alone stays so
            break
        blocks = int(block[-1])
    return np.concatenate([s.rows for s in shards])[row], lcp


def repeated_starts(segments: list[np.ndarray], starts: list[int], weights: list[int], window: int, shards: list[int] | None = None) -> list[np.ndarray]:
    """For each segment, which of its first ``starts`` positions begin a window found twice here.

    A segment of weight w stands for w equal ones.  ``shards`` has the number of the shard
    that each belongs to (alternating ones where not given).  The shards' transforms are
    merged, and the intervals whose common prefix reaches the window are the repeats.
    """
    part = np.arange(len(segments)) % 2 if shards is None else np.asarray(shards)
    deal = np.argsort(part, kind="stable")
    size = np.array([len(s) for s in segments], np.int64)[deal]
    text = np.concatenate([segments[i] for i in deal.tolist()])
    at = np.cumsum(size) - size
    weight = np.zeros(len(text), np.int64)
    for a, i in zip(at.tolist(), deal.tolist(), strict=True):
        weight[a : a + starts[i]] = weights[i]
    first = np.flatnonzero(np.concatenate([[True], part[deal][1:] != part[deal][:-1]]))
    cuts = [*at[first].tolist(), len(text)]
    q = step_of(window)
    name = gram_names(text, cuts, q)
    rows, lcp = merge([shard(name[a:b], a, window, q) for a, b in zip(cuts, cuts[1:], strict=False)], window // q)
    interval = np.cumsum(lcp < window // q)
    total = np.bincount(interval, weights=weight[rows])
    hit = np.zeros(len(text), bool)
    hit[rows] = total[interval] >= 2
    out: list = [None] * len(segments)
    for a, i in zip(at.tolist(), deal.tolist(), strict=True):
        out[i] = hit[a : a + starts[i]]
    return out
