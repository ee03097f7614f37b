"""Shared, Spark-free helpers over batches of texts held as one byte buffer.

A batch of texts is ``(buf, off)``: all UTF-8 bytes in one ``uint8`` array and
``n + 1`` byte offsets.  Nulls are empty texts.  Nothing here looks at more than
``STEP_BYTES`` of text at a time unless a single text is longer.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

STEP_BYTES = 1 << 19

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 2**64)

# Fixed separators of the word pattern [^\x20\x09-\x0D]+
IS_SEP = np.zeros(256, bool)
IS_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_pow_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i < n."""
    have = _pow_cache.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, STEP_BYTES + 4096)
        out = []
        for b in (BASE, BASE_INV):
            p = np.full(size, U64(b), U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _pow_cache[0] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that the polynomial's structure doesn't show."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Rolling:
    """Polynomial hashes, modulo 2**64, of any stretch of a sequence of 64-bit units.

    Texts can be made whose hashes are equal, so these only deal things out and pick anchors;
    nothing may be held to be equal because of them.
    """

    def __init__(self, units: np.ndarray):
        n = len(units)
        self.p, self.inv = powers(n + 1)
        self.s = np.zeros(n + 1, U64)
        np.cumsum(units * self.p[:n], out=self.s[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.s[end] - self.s[start]) * self.inv[start] + (end - start).astype(U64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.s) - 1
        if n < k:
            return np.zeros(0, U64)
        return mix((self.s[k:] - self.s[: n - k + 1]) * self.inv[: n - k + 1])


P61 = (1 << 61) - 1


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & U64(P61)) + (x >> U64(61))
    return np.where(x >= U64(P61), x - U64(P61), x)


def mul61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, for residues."""
    ah, al, bh, bl = a >> U64(31), a & U64(0x7FFFFFFF), b >> U64(31), b & U64(0x7FFFFFFF)
    mid = al * bh + ah * bl
    return _fold((ah * bh << U64(1)) + (mid >> U64(30)) + ((mid & U64(0x3FFFFFFF)) << U64(31)) + al * bl)


def _powers61(base: int, n: int) -> np.ndarray:
    out = np.ones(1, U64)
    while len(out) < n:
        out = np.concatenate([out, mul61(out, np.full(1, pow(base, len(out), P61), U64))])
    return out[:n]


class Secret:
    """Hashes of any stretch as polynomials modulo 2**61 - 1 at a base drawn at random for each run.

    Two different stretches of n units share a hash with a chance of n / 2**61, whatever the
    texts are, as nobody knows the base when writing them.
    """

    def __init__(self, units: np.ndarray, base: int):
        base = base % (P61 - 2) + 2
        n = len(units)
        term = mul61(_fold(units), _powers61(base, n))
        low, high = np.zeros(n + 1, U64), np.zeros(n + 1, U64)
        np.cumsum(term & U64(0x3FFFFFFF), out=low[1:])
        np.cumsum(term >> U64(30), out=high[1:])
        high = _fold(high)
        self.s = _fold(_fold(low) + (((high << U64(30)) & U64(P61)) | (high >> U64(31))))
        self.inv = _powers61(pow(base, -1, P61), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mul61(_fold(self.s[end] + U64(P61) - self.s[start]), self.inv[start])


def digests(raw: bytes, start: list[int], end: list[int]) -> np.ndarray:
    """(n, 2): 128-bit BLAKE2b digests of stretches of bytes."""
    out = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start, end, strict=True)])
    return np.frombuffer(out, U64).reshape(-1, 2)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary column as (buf, off), without a copy where possible."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def steps(off: np.ndarray, limit: int = STEP_BYTES):
    """Ranges [a, b) of texts of at most ``limit`` bytes together, one text at least."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, b
        a = b


#: Separators of letter runs: all ASCII but letters; bytes of longer characters count as letters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False


def words(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = IS_SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and the word offsets of each text (n + 1)."""
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~sep[buf]
    start = inside[1:] & ~inside[:-1]
    end = ~inside[1:] & inside[:-1]
    # a text that begins inside what would else be one word with the text before it
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[inside[cut + 1] & inside[cut]]
    start[cut] = True
    end[cut] = True
    ws, we = np.flatnonzero(start), np.flatnonzero(end)
    return ws, we, np.searchsorted(ws, off)


def word_ids(buf: np.ndarray, ws: np.ndarray, we: np.ndarray, of_long: Callable[[bytes], int]) -> np.ndarray:
    """A 64-bit number of each word: its bytes and length up to seven bytes, else what ``of_long`` says."""
    size = we - ws
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    out = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))[ws].astype(U64)
    short = np.minimum(size, 7).astype(U64)
    out = (out & ((U64(1) << (short * U64(8))) - U64(1))) | short << U64(56)
    long = np.flatnonzero(size > 7)
    if len(long):
        raw = buf.tobytes()
        out[long] = np.fromiter((of_long(raw[a:b]) for a, b in zip(ws[long].tolist(), we[long].tolist(), strict=True)), U64, len(long))
    return out


def word_names(buf: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """Small numbers that are equal exactly where words are."""
    seen: dict[bytes, int] = {}
    ids = word_ids(buf, ws, we, lambda w: seen.setdefault(w, len(seen)) | 255 << 56)
    return np.unique(ids, return_inverse=True)[1].astype(np.int64)


def word_hashes(buf: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, alike in all runs: for features and shingles."""
    return mix(word_ids(buf, ws, we, xxh3_64_intdigest))


def sliding(h: np.ndarray, w: int, least=np.minimum) -> np.ndarray:
    """The least (or greatest) of each w consecutive values, by doubling."""
    if len(h) < w:
        return h[:0]
    span, m = 1, h
    while span * 2 <= w:
        m = least(m[:-span], m[span:])
        span *= 2
    rest = w - span
    return least(m[: len(m) - rest], m[rest:]) if rest else m


def repeat_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated aranges: start[i], ..., start[i] + length[i] - 1."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = length > 0
    s, n = start[keep], length[keep]
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(out)


def column_of(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


_kept: dict[str, tuple] = {}
_asked: set[str] = set()


def kept(name: str, key, make: Callable):
    """What a worker keeps for later tasks, one value a name: made anew for another key.  Workers outlive
    the step that needs it, so the first task that does not ask for it has it dropped; see give_back."""
    _asked.add(name)
    if name not in _kept or _kept[name][0] != key:
        _kept.pop(name, None)
        _kept[name] = key, make()
    return _kept[name][1]


def give_back() -> None:
    """Drops what was kept and not asked for since the last call, and returns freed memory to the system:
    Arrow's pool, then the C library's heap where it can be trimmed."""
    for name in _kept.keys() - _asked:
        del _kept[name]
    _asked.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
