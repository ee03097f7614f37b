"""Statistics of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

from ._text import repeat_ranges, word_names, words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Words of a window that counts as repeated if found twice in a text; a power of two.
REPEAT = 8


def _per_text(at: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of the sorted positions lie in each text."""
    return np.diff(np.searchsorted(at, off))


def text_stats(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    n = len(off) - 1
    ws, we, wo = words(buf, off)
    n_words = np.diff(wo)
    # code points: bytes that don't continue one
    heads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    chars = np.concatenate([[0], np.cumsum(heads[we] - heads[ws])])
    word_chars = chars[wo[1:]] - chars[wo[:-1]]
    n_symbols = _per_text(np.flatnonzero(SYMBOL[buf]), off)

    text_of_word = np.repeat(np.arange(n), n_words)
    n_dup = np.zeros(n, np.int64)
    n_repeat = np.zeros(n, np.int64)
    if len(ws):
        # lines: each text begins one, each \n but within the text begins another
        feed = np.flatnonzero(buf == 10) + 1
        starts = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], feed[feed < len(buf)]]))
        ends = np.concatenate([starts[1:], [len(buf)]])
        ends = ends - (buf[ends - 1] == 10)
        with_word = np.searchsorted(ws, ends) > np.searchsorted(ws, starts)
        starts, ends = starts[with_word], ends[with_word]
        text = np.searchsorted(off, starts, side="right") - 1
        several = np.bincount(text, minlength=n)[text] > 1
        raw, seen = buf.tobytes(), set()
        for t, a, b in zip(text[several].tolist(), starts[several].tolist(), ends[several].tolist(), strict=True):
            line = (t, raw[a:b])
            n_dup[t] += line in seen
            seen.add(line)

        count = np.maximum(n_words - REPEAT + 1, 0)
        at = repeat_ranges(wo[:-1], count)
        if len(at):
            of = np.repeat(np.arange(n), count)
            name, span = word_names(buf, ws, we), 1
            while span < REPEAT:  # windows are named by the names of their halves
                name = np.unique(name[:-span] * len(ws) + name[span:], return_inverse=True)[1].astype(np.int64)
                span *= 2
            key = of * len(ws) + name[at]
            _, inv, times = np.unique(key, return_inverse=True, return_counts=True)
            hit = at[times[inv] > 1]
            delta = np.zeros(len(ws) + 1, np.int64)
            np.add.at(delta, hit, 1)
            np.add.at(delta, hit + REPEAT, -1)
            n_repeat = np.bincount(text_of_word, np.cumsum(delta[:-1]) > 0, minlength=n).astype(np.int64)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat}
