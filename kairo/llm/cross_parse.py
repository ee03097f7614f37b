"""Cross-parsing with suffix automata, without Spark.

A suffix automaton of a language's sample recognises exactly its substrings, so walking it
gives the longest match at a position.  A text is parsed greedily into phrases, each the
longest match from where the last ended; a byte that the sample lacks is a phrase by
itself.  Letters lose their case, whatever else is ASCII counts as one separator, and the
bytes of longer characters stand for themselves.

Many blocks of a text are walked at once, alike for all languages.  Where a block is entered
is first guessed from the end of the block before it (parses that begin apart soon meet),
then every block whose guess was wrong is walked again from where the block before it has
really ended, until all agree: the parse is that of the whole text, whatever its length.
"""

from __future__ import annotations

import numpy as np

from ._text import LOWER, NOT_LETTER

#: Bytes of a block, and how many of them a guess is made from.
BLOCK, GUESS = 1024, 192

#: What a byte counts as.
FOLDED = np.where(NOT_LETTER, 32, LOWER).astype(np.uint8)


def symbols(buf: np.ndarray) -> np.ndarray:
    return FOLDED[buf]


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a symbol sequence; state 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go


class Parser:
    """The automata of all languages in one table.

    A state is the place of its row; each language's rows are as wide as its sample has symbols,
    and one more for the bytes that it lacks.  An entry is 4 * next state + phrases that end
    with this step (before the symbol, and with it if the sample lacks it).
    """

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        tables, self.roots, self.scale, base = [], [], [], 0
        self.code = np.zeros((len(self.langs), 256), np.int32)
        for i, lang in enumerate(self.langs):
            s = symbols(np.frombuffer(samples[lang], np.uint8))
            seen = np.unique(s)
            number = np.zeros(256, np.int32)
            number[seen] = np.arange(1, len(seen) + 1)
            self.code[i] = number[FOLDED]
            go, width = automaton(number[s]), len(seen) + 1
            t = np.full((len(go), width), -1, np.int64)
            for k, edges in enumerate(go):
                for c, j in edges.items():
                    t[k, c] = j
            t = np.where(t < 0, 4 * (np.maximum(t[0], 0) * width + base)[None, :] + 1, 4 * (t * width + base))
            t[:, 0] = 4 * base + 2
            t[0, 0] = 4 * base + 1
            tables.append(t.astype(np.int32).ravel())
            self.roots.append(base)
            self.scale.append(np.log2(max(len(s), 2)))
            base += len(go) * width
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.roots = np.array(self.roots, np.int32)
        self.scale = np.array(self.scale)

    def walk(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From (languages, lanes) states through each lane's bytes: states, and phrases that ended on the way."""
        order = np.argsort(-length, kind="stable")
        at, size, now = start[order], length[order], state[:, order]
        count = np.zeros(now.shape, np.int32)
        live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")  # lanes longer than t
        for t, k in enumerate(live.tolist()):
            step = self.table.take(now[:, :k] + self.code.take(buf[at[:k] + t], axis=1))
            count[:, :k] += step & 3
            now[:, :k] = step >> 2
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return now[:, back], count[:, back]

    def phrases(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(texts, languages): phrases of each text's greedy parse."""
        n, langs = len(off) - 1, len(self.langs)
        out = np.zeros((n, langs), np.int64)
        size = np.diff(off)
        blocks = -(-size // BLOCK)
        text = np.repeat(np.arange(n), blocks)
        if not len(text) or not langs:
            return out
        nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = off[text] + nth * BLOCK
        length = np.minimum(BLOCK, off[text + 1] - start)
        entry = np.repeat(self.roots[:, None], len(text), axis=1)
        later = np.flatnonzero(nth)  # blocks that another precedes
        entry[:, later] = self.walk(buf, start[later] - GUESS, np.full(len(later), GUESS), entry[:, later])[0]
        end, count = self.walk(buf, start, length, entry)
        while len(wrong := later[(entry[:, later] != end[:, later - 1]).any(axis=0)]):
            entry[:, wrong] = end[:, wrong - 1]
            end[:, wrong], count[:, wrong] = self.walk(buf, start[wrong], length[wrong], entry[:, wrong])
        last = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]]))
        count[:, last] += end[:, last] != self.roots[:, None]  # the phrase that the text's end cuts off
        np.add.at(out, text, count.T)
        return out

    def entropy(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(texts, languages): phrases times log2 of the sample's length, per byte."""
        return self.phrases(buf, off) * self.scale[None, :] / np.maximum(np.diff(off), 1)[:, None]
