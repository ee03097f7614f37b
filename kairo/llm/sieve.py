"""Dealing windows out by content, without Spark.

A window is W consecutive units (bytes or words).  Of the W - k + 1 k-grams in it the one
with the least hash is its *anchor*; equal windows have equal anchors, wherever they are.
Consecutive windows with the same anchor value form a *run*; a run and the units below it
are a *segment*.  So all starts of one window sequence lie in segments of one anchor, and
only anchors that occur twice can hold a repeat.
"""

from __future__ import annotations

from hashlib import blake2b
from typing import NamedTuple

import numpy as np

from ._text import STEP_BYTES, U64, Rolling, digests, repeat_ranges, sliding, steps, word_ids, words


class Runs(NamedTuple):
    doc: np.ndarray  #: number of the text
    lo: np.ndarray  #: first and last window start, in units of the text
    hi: np.ndarray
    anchor: np.ndarray
    digest: np.ndarray  #: 128 bits of the segment's units, as two columns
    many: np.ndarray  #: the anchor may occur more than once in the segment


def runs(units: np.ndarray, hashed: np.ndarray, off: np.ndarray, window: int, gram: int, digest: bool = True) -> Runs:
    w = window - gram + 1
    count = np.maximum(np.diff(off) - window + 1, 0)
    at = repeat_ranges(off[:-1], count)
    none = np.zeros(0, np.int64)
    if not len(at):
        return Runs(none, none, none, none.view(U64), np.zeros((0, 2), U64), none.astype(bool))
    grams = Rolling(hashed).grams(gram)
    low = sliding(grams, w)
    v, doc = low[at], np.repeat(np.arange(len(count)), count)
    first = np.concatenate([[0], np.flatnonzero((v[1:] != v[:-1]) | (doc[1:] != doc[:-1])) + 1])
    last = np.concatenate([first[1:], [len(v)]]) - 1
    lo, hi = at[first], at[last]
    # grams that are the least of some window; two neighbours that are equal may repeat within a segment
    inside = np.zeros(len(low) + 2 * (w - 1), U64)
    inside[at + w - 1] = v
    chosen = np.flatnonzero((sliding(inside, w, np.maximum) == grams) & (grams > 0))
    pair = np.flatnonzero((grams[chosen[1:]] == grams[chosen[:-1]]) & (chosen[1:] - chosen[:-1] <= w))
    many = np.searchsorted(chosen[pair + 1], hi + w - 1, side="right") > np.searchsorted(chosen[pair], lo)
    d, size = doc[first], units.itemsize
    said = digests(units.tobytes(), (lo * size).tolist(), ((hi + window) * size).tolist()) if digest else np.zeros((len(lo), 2), U64)
    return Runs(d, lo - off[d], hi - off[d], v[first], said, many)


class Bytes:
    """Units are the bytes of a text."""

    dtype = np.uint8

    def __init__(self, key: bytes = b""):
        pass

    def of(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return buf, off

    def hashed(self, units: np.ndarray) -> np.ndarray:
        return units.astype(U64) + U64(1)


class Words:
    """Units are the words of a text: up to seven bytes as they are, longer ones by a 64-bit
    BLAKE2b hash under the run's own random key, so that no text can be made to collide."""

    dtype = np.uint64
    #: Hashes of long words that are kept at hand.
    HELD = 1 << 17

    def __init__(self, key: bytes = b""):
        self.key, self.held = key, {}

    def __reduce__(self):
        return Words, (self.key,)

    def long(self, word: bytes) -> int:
        h = self.held.get(word)
        if h is None:
            if len(self.held) >= self.HELD:
                self.held.clear()
            h = self.held[word] = int.from_bytes(blake2b(word, digest_size=8, key=self.key).digest(), "little")
        return h

    def of(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ws, we, wo = words(buf, off)
        return word_ids(buf, ws, we, self.long), wo

    def hashed(self, units: np.ndarray) -> np.ndarray:
        return units


def runs_of_texts(buf: np.ndarray, off: np.ndarray, kind, window: int, gram: int, limit: int = STEP_BYTES, digest: bool = True):
    """Runs of a batch, a step at a time; a long text goes through in slices that share window - 1 units."""
    for a, b in steps(off, limit):
        units, uo = kind.of(buf[off[a] : off[b]], off[a : b + 1] - off[a])
        if b - a == 1 and len(units) > limit:
            for s in range(0, len(units) - window + 1, limit):
                part = units[s : s + limit + window - 1]
                r = runs(part, kind.hashed(part), np.array([0, len(part)]), window, gram, digest)
                yield r._replace(doc=r.doc + a, lo=r.lo + s, hi=r.hi + s)
        else:
            r = runs(units, kind.hashed(units), uo, window, gram, digest)
            yield r._replace(doc=r.doc + a)
