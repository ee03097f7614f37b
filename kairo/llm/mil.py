"""Gated-attention multiple-instance learning over passages, in numpy.

A document is a bag of passages x_i.  Each is encoded, h_i = tanh(W x_i + c), and weighed by
gated attention, a_i = softmax_i(u . (tanh(V h_i) * sigmoid(G h_i))).  The document is
z = sum a_i h_i and its score sigmoid(q . z + r).  Only documents have labels.
"""

from __future__ import annotations

import numpy as np

from ._text import LOWER, U64, Rolling, mix, words

#: Words of a passage; byte classes counted in it; hidden and attention units.
PASSAGE, CLASSES, HIDDEN, GATE = 64, 48, 24, 12

#: Bytes by kind: each ASCII letter without case, upper case apart, digits, white space, each
#: punctuation mark folded into a few, longer characters.
_CLASS = np.full(256, 47, np.uint8)
_CLASS[97:123] = np.arange(26)
_CLASS[65:91] = 26
_CLASS[48:58] = 27
_CLASS[[9, 11, 12, 13, 32]] = 28
_CLASS[10] = 29
for _i, _c in enumerate(b"#*$%&|<>!?.,;:-_/"):
    _CLASS[_c] = 30 + _i
#: What else describes a passage: see passages().
EXTRA = 6
WIDTH = CLASSES + EXTRA


def passages(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage and the passage offsets of each text; a blank text has one empty passage."""
    ws, we, wo = words(buf, off)
    count = np.diff(wo)
    per = np.maximum(-(-count // PASSAGE), 1)
    at = np.concatenate([[0], np.cumsum(per)])
    n = int(at[-1])
    x = np.zeros((n, WIDTH), np.float32)
    if not len(ws):
        return x, at
    text = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(ws)) - wo[:-1][text]
    passage = at[:-1][text] + nth // PASSAGE
    # every byte from a word's start to the next word's start belongs to its passage
    bound = np.concatenate([ws, [len(buf)]])
    size = np.diff(bound)
    last = np.flatnonzero(np.diff(np.concatenate([text, [-1]])) != 0)
    size[last] = off[text[last] + 1] - ws[last]
    starts = np.flatnonzero(np.diff(np.concatenate([[-1], passage])))
    begin = ws[starts]
    end = np.concatenate([starts[1:], [len(ws)]]) - 1
    stop = ws[end] + size[end]
    of_byte = np.repeat(passage[starts], stop - begin)
    inside = np.concatenate([buf[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)])
    hist = np.bincount(of_byte * CLASSES + _CLASS[inside], minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float32)
    total = np.maximum(hist.sum(axis=1), 1)
    x[:, :CLASSES] = np.sqrt(hist / total[:, None])
    n_words = np.bincount(passage, minlength=n)
    some = np.maximum(n_words, 1)
    length = (we - ws).astype(np.float64)
    mean = np.bincount(passage, length, minlength=n) / some
    low = LOWER[buf]
    h = Rolling(low.astype(U64) + U64(1)).of(ws, we)
    # words that the text has elsewhere too, and starts of four words that it has elsewhere too
    key = mix(h + text.astype(U64) * U64(0xD6E8FEB86659FD93))
    _, inv, times = np.unique(key, return_inverse=True, return_counts=True)
    again = times[inv] > 1
    pair = np.zeros(len(ws), bool)
    if len(ws) > 4:
        four = h[:-3] + U64(3) * h[1:-2] + U64(5) * h[2:-1] + U64(7) * h[3:]
        four = mix(four + text[:-3].astype(U64))
        _, inv, times = np.unique(four, return_inverse=True, return_counts=True)
        pair[:-3] = (times[inv] > 1) & (text[3:] == text[:-3])
    x[:, CLASSES] = np.log1p(n_words) / 4
    x[:, CLASSES + 1] = np.log1p(mean) / 2
    x[:, CLASSES + 2] = np.sqrt(np.maximum(np.bincount(passage, length**2, minlength=n) / some - mean**2, 0)) / 8
    x[:, CLASSES + 3] = np.bincount(passage, again, minlength=n) / some
    x[:, CLASSES + 4] = np.bincount(passage, pair, minlength=n) / some
    x[:, CLASSES + 5] = np.log1p(np.repeat(count, per)) / 8
    return x, at


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Attention:
    """The model; ``params`` holds its arrays by name."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.params = params

    @staticmethod
    def new(seed: int = 7) -> Attention:
        r = np.random.default_rng(seed)
        w = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        return Attention({"mean": np.zeros(WIDTH), "std": np.ones(WIDTH), "W": w(WIDTH, HIDDEN), "c": np.zeros(HIDDEN), "V": w(HIDDEN, GATE), "G": w(HIDDEN, GATE), "u": w(GATE, 1)[:, 0], "q": np.zeros(HIDDEN), "r": np.zeros(1)})

    def forward(self, x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        p = self.params
        xs = (x - p["mean"]) / p["std"]
        h = np.tanh(xs @ p["W"] + p["c"])
        t, s = np.tanh(h @ p["V"]), _sig(h @ p["G"])
        e = (t * s) @ p["u"]
        bag = np.repeat(np.arange(len(at) - 1), np.diff(at))
        e = np.exp(e - np.maximum.reduceat(e, at[:-1])[bag])
        a = e / np.add.reduceat(e, at[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, at[:-1], axis=0)
        return {"xs": xs, "h": h, "t": t, "s": s, "a": a, "bag": bag, "z": z, "y": _sig(z @ p["q"] + p["r"][0])}

    def predict(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.forward(x, at)["y"] if len(at) > 1 else np.zeros(0)

    def gradient(self, f: dict[str, np.ndarray], at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, bag, h, a = self.params, f["bag"], f["h"], f["a"]
        dg = (f["y"] - y) / len(y)
        dz = dg[:, None] * p["q"]
        da = (dz[bag] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, at[:-1])[bag])
        dts = de[:, None] * p["u"]
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        dh = a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["G"].T
        dpre = dh * (1 - h**2)
        return {"q": f["z"].T @ dg, "r": np.array([dg.sum()]), "u": (f["t"] * f["s"]).T @ de, "V": h.T @ dt, "G": h.T @ ds, "W": f["xs"].T @ dpre, "c": dpre.sum(axis=0)}


def train(x: np.ndarray, at: np.ndarray, y: np.ndarray, epochs: int = 20, batch: int = 256, rate: float = 0.01, decay: float = 1e-4) -> Attention:
    """Adam over batches of bags in a fixed shuffle; without bags the score is a half everywhere."""
    m = Attention.new()
    if not len(y):
        return m
    p = m.params
    p["mean"], p["std"] = x.mean(axis=0), x.std(axis=0) + 0.05
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    p["r"][0] = np.log(share / (1 - share))
    names = [k for k in p if k not in ("mean", "std")]
    m1, m2 = ({k: np.zeros_like(p[k]) for k in names} for _ in range(2))
    rng, step = np.random.default_rng(11), 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for i in range(0, len(y), batch):
            pick = order[i : i + batch]
            size = (at[pick + 1] - at[pick])
            rows = np.concatenate([np.arange(at[j], at[j + 1]) for j in pick])
            sub = np.concatenate([[0], np.cumsum(size)])
            g = m.gradient(m.forward(x[rows], sub), sub, y[pick])
            step += 1
            for k in names:
                d = g[k] + decay * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                p[k] = p[k] - lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return m
