"""Non-negative positive-unlabelled learning of a linear model, in numpy.

The risk is  pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])  with the logistic loss
l.  The difference estimates the risk on negatives without any; where it falls below zero
the model has begun to fit the positives in the unlabelled text, and the step then goes
against that term instead of along it.
"""

from __future__ import annotations

import numpy as np

from ._text import LOWER, NOT_LETTER, U64, Rolling, mix, words

#: Hashed features: a text's distinct lower-cased letter runs, and their beginnings of so many bytes.
BITS, PREFIXES = 20, (6, 8)
#: A feature counts only if its share among the positives is this many standard errors from the other's.
SCREEN = 4.0


def _hashed(buf: np.ndarray, off: np.ndarray):
    """Per kind of feature: the feature of each word; and the text of each word."""
    low = LOWER[buf]
    ws, we, wo = words(low, off, NOT_LETTER)
    roll = Rolling(low.astype(U64) + U64(1))
    ends = [we, *(np.minimum(we, ws + k) for k in PREFIXES)]
    kinds = [(mix(roll.of(ws, e) + U64(i)) >> U64(64 - BITS)).astype(np.int64) for i, e in enumerate(ends)]
    return kinds, np.repeat(np.arange(len(off) - 1), np.diff(wo))


def features(buf: np.ndarray, off: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text and their offsets; with weights, only those that have one."""
    kinds, text = _hashed(buf, off)
    both = []
    for f in kinds:
        keep = slice(None) if weights is None else weights[f] != 0
        both.append((text[keep] << BITS) | f[keep])
    flat = np.unique(np.concatenate(both))
    return flat & ((1 << BITS) - 1), np.searchsorted(flat >> BITS, np.arange(len(off)))


def margins(weights: np.ndarray, bias: float, f: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights[f].astype(np.float64))])
    return bias + total[at[1:]] - total[at[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of margins on positives and on unlabelled texts, and the step's derivatives by them.

    Where the part that stands for negatives is below zero the derivatives are those of minus that
    part: the step then undoes what fitted positives in the unlabelled text.
    """
    sp, su = sigmoid(gp), sigmoid(gu)
    positive = prior * np.logaddexp(0, -gp).mean()
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    if negative >= 0:
        return positive + negative, prior * (sp - 1 - sp) / len(gp), su / len(gu)
    return positive, prior * sp / len(gp), -su / len(gu)


def train(pos: tuple[np.ndarray, np.ndarray], unl: tuple[np.ndarray, np.ndarray], prior: float, rounds: int = 300, rate: float = 0.05, l1: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias.  Features that :data:`SCREEN` passes over keep the weight 0."""
    size = 1 << BITS
    w, b = np.zeros(size, np.float32), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 0.0
    np_, nu = len(pos[1]) - 1, len(unl[1]) - 1
    if not np_ or not nu:
        return w, b
    in_p, in_u = np.bincount(pos[0], minlength=size), np.bincount(unl[0], minlength=size)
    rate_u = (in_u + 0.5) / (nu + 1)
    used = np.flatnonzero(np.abs(in_p / np_ - rate_u) > SCREEN * np.sqrt(rate_u * (1 - rate_u) * (1 / np_ + 1 / nu)))
    place = np.full(size, -1, np.int64)
    place[used] = np.arange(len(used))

    def shrink(x):
        f, at = x
        p = place[f]
        kept = np.concatenate([[0], np.cumsum(p >= 0)])
        return p[p >= 0], kept[at], np.repeat(np.arange(len(at) - 1), np.diff(kept[at]))

    (pf, pa_, pt), (uf, ua, ut) = shrink(pos), shrink(unl)
    v, m1, m2 = np.zeros(len(used)), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, rounds + 1):
        _, dp, du = risk(margins(v, b, pf, pa_), margins(v, b, uf, ua), prior)
        grad = np.bincount(pf, weights=dp[pt], minlength=len(used)) + np.bincount(uf, weights=du[ut], minlength=len(used))
        grad = np.append(grad, dp.sum() + du.sum())
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad * grad
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-6)
        v -= move[:-1]
        b -= float(move[-1])
        v = np.sign(v) * np.maximum(np.abs(v) - l1 * (rate / 0.05), 0)
    w[used] = v
    return w, b
