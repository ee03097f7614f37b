"""Bit-sliced Hamming comparison, without Spark.

Bit b of every fingerprint lies in plane b, 64 fingerprints to a machine word.  The
fingerprints of many buckets lie side by side, and at each distance d every lane is compared
with the lane d further on, all lanes at once: each plane that differs is added to vertical
counters with carry-save logic, saturating above the radius, and a word is abandoned as
soon as all its lanes have passed the radius or left their bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ._text import LOWER, repeat_ranges, words

ONE, ALL = np.uint64(1), ~np.uint64(0)
#: How many planes to add between two looks at whether a block can be abandoned.
LOOK = 8


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) of vertical bits; lanes beyond the last fingerprint are zero."""
    n = len(fps)
    bits = np.unpackbits(np.ascontiguousarray(fps, dtype="<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    wide = np.zeros((64, -(-n // 64) * 64), np.uint8)
    wide[:, :n] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def shifted(plane: np.ndarray, by: int, words: int) -> np.ndarray:
    """The first ``words`` words of planes in which every lane holds what lay ``by`` lanes further on."""
    whole, bits = divmod(by, 64)
    low = plane[:, whole : whole + words]
    if not bits:
        return low
    return (low >> np.uint64(bits)) | (plane[:, whole + 1 : whole + 1 + words] << np.uint64(64 - bits))


def near(plane: np.ndarray, by: int, over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes not in ``over`` whose distance to the lane ``by`` further on is at most radius."""
    live = np.flatnonzero(over != ALL)
    words = int(live[-1]) + 1 if len(live) else 0
    over = over[live]
    diff = (plane[:, :words] ^ shifted(plane, by, words))[:, live]
    counters = [np.zeros(len(live), np.uint64) for _ in range((radius + 1).bit_length())]
    for b in range(64):
        carry = diff[b]
        for i, c in enumerate(counters):
            counters[i], carry = c ^ carry, c & carry
        over = over | carry
        if b % LOOK == LOOK - 1:
            over = over | _above(counters, radius)
            left = over != ALL
            if not left.any():
                return np.zeros(0, np.int64)
            if left.mean() < 0.5:
                live, over, diff = live[left], over[left], diff[:, left]
                counters = [c[left] for c in counters]
    ok = np.unpackbits((~over).view(np.uint8).reshape(len(live), 8), axis=1, bitorder="little")
    word, bit = np.nonzero(ok)
    return live[word] * 64 + bit


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds radius, by a bitwise comparison from the top bit down."""
    more, same = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            same &= counters[i]
        else:
            more |= same & counters[i]
            same &= ~counters[i]
    return more


def pairs(fps: np.ndarray, size: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within the radius inside each of the buckets, which lie one after
    another with these sizes, the largest first."""
    n = len(fps)
    end = np.repeat(np.cumsum(size), size)
    plane = planes(fps)
    width = plane.shape[1]
    plane = np.concatenate([plane, np.zeros((64, width + 1), np.uint64)], axis=1)
    # planes that tell neighbours apart come first; those under a bucket's own key never differ
    plane = plane[np.argsort(-np.bitwise_count(plane[:, :width] ^ shifted(plane, 1, width)).sum(axis=1, dtype=np.int64), kind="stable")]
    lane = np.arange(n)
    for by in range(1, int(size[0]) if len(size) else 0):
        k = int(size[size > by].sum())
        out = np.ones(-(-k // 64) * 64, np.uint8)
        out[:k] = lane[:k] + by >= end[:k]
        over = np.packbits(out, bitorder="little").view("<u8").astype(np.uint64)
        got = near(plane, by, over, radius)
        if len(got):
            yield got, got + by


def forest(fps: np.ndarray, radius: int, bucket: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the classes of the fingerprints of each bucket (no link within a class twice).

    ``bucket`` numbers the buckets, equal numbers side by side; fingerprints of one bucket are
    distinct.  All pairs of a bucket are compared; a union-find keeps only links that join
    two classes, so a dense bucket gives at most n - 1 links.
    """
    if len(fps) < 2:
        return []
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if bucket is not None else np.zeros(1, np.int64)
    size = np.diff(np.concatenate([first, [len(fps)]]))
    order = np.argsort(-size, kind="stable")
    fps, size = fps[repeat_ranges(first[order], size[order])], size[order]
    up = np.arange(len(fps))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = int(up[x])
        return x

    links = []
    for left, right in pairs(fps, size, radius):
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            a, b = root(i), root(j)
            if a != b:
                up[max(a, b)] = min(a, b)
                links.append((int(fps[i]), int(fps[j])))
    return links


def fingerprints(buf: np.ndarray, off: np.ndarray, shingle: int, seed: int = 42) -> np.ndarray:
    """SimHash of each text: lower-cased words, shingles with repeats, majority of XXH64 bits."""
    from xxhash import xxh64_intdigest

    low = LOWER[buf]
    ws, we, wo = words(low, off)
    n = len(off) - 1
    if not len(ws):
        return np.zeros(n, np.uint64)
    size = we - ws
    at = np.concatenate([[0], np.cumsum(size + 1)])  # each word and one space
    joined = np.full(int(at[-1]), 32, np.uint8)
    joined[repeat_ranges(at[:-1], size)] = low[repeat_ranges(ws, size)]
    count = np.diff(wo)
    k = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    first = repeat_ranges(wo[:-1], k)
    last = np.minimum(first + shingle, np.repeat(wo[1:], k)) - 1
    text = joined.tobytes()
    h = np.fromiter((xxh64_intdigest(text[a:b], seed) for a, b in zip(at[first].tolist(), (at[last] + size[last]).tolist(), strict=True)), np.uint64, len(first))
    return majority(h, k)


def majority(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    """One fingerprint for each stretch of k hashes: bits set in over half of them; none give zero."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros(len(k), np.uint64)
    full = np.flatnonzero(k)
    if not len(full):
        return out
    starts = np.concatenate([[0], np.cumsum(k[full])[:-1]])
    sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    major = (2 * sums > k[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out
