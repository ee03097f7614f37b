"""The Spark-free parts against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from kairo.llm import bitsliced, bwt, cross_parse, doubling, mcd, mil, mixing, pu, sieve, stats, topk
from kairo.llm._text import Rolling, Secret, digests, give_back, kept, repeat_ranges, sliding, steps, word_hashes, word_names, words


def batch(texts):
    raw = [t.encode() if isinstance(t, str) else t for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


TEXTS = ["", "a", " a  b\tc\n", "x", "é ü", "\n\n", "one two three four one two three four", "tail ", "a b"]


def test_workers_keep_only_what_their_last_task_asked_for():
    made = []
    make = lambda: made.append(0) or object()
    give_back()
    first = kept("a", 1, make)
    assert kept("a", 1, make) is first and kept("b", 1, make) is not first
    give_back()
    assert kept("a", 1, make) is first and len(made) == 2
    give_back()  # b was not asked for
    assert kept("a", 1, make) is first and kept("b", 1, make) and len(made) == 3
    give_back()
    give_back()
    assert kept("a", 1, make) is not first and len(made) == 4 and kept("a", 2, make) and len(made) == 5
    give_back()


def test_words():
    buf, off = batch(TEXTS)
    ws, we, wo = words(buf, off)
    got = [[buf[a:b].tobytes() for a, b in zip(ws[x:y], we[x:y], strict=True)] for x, y in zip(wo, wo[1:], strict=False)]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in TEXTS]
    h = word_hashes(buf, ws, we)
    names = [w for t in got for w in t]
    assert len(set(h.tolist())) == len(set(names))


def test_ranges_and_slides():
    assert repeat_ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    x = np.random.default_rng(0).integers(0, 99, 50)
    assert all((sliding(x, w) == [x[i : i + w].min() for i in range(51 - w)]).all() for w in (1, 2, 3, 7, 50))
    assert list(steps(np.array([0, 5, 9, 40, 41]), 10)) == [(0, 2), (2, 3), (3, 4)]


def test_kernels_find_what_counting_finds():
    rng = random.Random(5)
    for _ in range(60):
        window, letters = rng.choice([2, 4, 6, 8, 16, 20, 35]), rng.choice([1, 2, 3, 20])
        base = bytes(rng.randrange(letters) for _ in range(200))
        segs = []
        for _ in range(rng.randrange(1, 8)):
            n, o = rng.randrange(window, window + 60), rng.randrange(100)
            segs.append(np.frombuffer(bytes(rng.randrange(letters) for _ in range(n)) if rng.random() < 0.5 else base[o : o + n], np.uint8))
        starts = [rng.randrange(1, len(s) - window + 2) for s in segs]
        weights = [rng.choice([1, 1, 2]) for _ in segs]
        c = Counter()
        for s, k, w in zip(segs, starts, weights, strict=True):
            c.update({x: 0 for x in ()})
            for i in range(k):
                c[s[i : i + window].tobytes()] += w
        want = [[c[s[i : i + window].tobytes()] >= 2 for i in range(k)] for s, k in zip(segs, starts, strict=True)]
        assert [x.tolist() for x in bwt.repeated_starts(segs, starts, weights, window, [rng.randrange(rng.choice([1, 2, 9])) for _ in segs])] == want
        assert [x.tolist() for x in bwt.repeated_starts(segs, starts, weights, window)] == want
        assert [x.tolist() for x in doubling.repeated_starts([s.astype(np.uint64) for s in segs], starts, weights, window)] == want


@pytest.mark.parametrize("shards", [2, 3, 7])
@pytest.mark.parametrize("q", [1, 2, 4])
def test_merged_transform_is_the_whole_texts(shards, q):
    rng = random.Random(shards)
    for letters in (1, 2, 3, 30):
        text = np.frombuffer(bytes(rng.randrange(letters) for _ in range(40 * shards)), np.uint8)
        cuts = [0, *sorted(rng.sample(range(8, 40 * shards - 8), shards - 1)), 40 * shards]
        name = bwt.gram_names(text, cuts, q)
        parts = list(zip(cuts, cuts[1:], strict=False))
        rows, lcp = bwt.merge([bwt.shard(name[a:b], a, 8, q) for a, b in parts], 8 // q)

        def rot(p, parts=parts, text=text):
            a, b = next(x for x in parts if x[0] <= p < x[1])
            return bytes(text[a + (p - a + i) % (b - a)] for i in range(8))

        keys = [rot(int(p)) for p in rows]
        assert keys == sorted(keys) and sorted(rows.tolist()) == list(range(len(text)))
        for i in range(1, len(text)):
            same = next((k for k in range(8) if keys[i][k] != keys[i - 1][k]), 8)
            # a last round that parts nothing is not run, so common prefixes stand as they were found
            assert lcp[i] == same // q


def test_runs_cover_each_window_once_and_equal_windows_share_anchors():
    rng = random.Random(9)
    for _ in range(30):
        window = rng.choice([4, 9, 35])
        texts = [bytes(rng.randrange(97, 97 + rng.choice([1, 2, 9])) for _ in range(rng.randrange(0, 120))) for _ in range(5)]
        buf, off = batch(texts)
        seen, anchor = {}, {}
        for r in sieve.runs_of_texts(buf, off, sieve.Bytes(), window, max(1, window // 3), rng.choice([40, 1000])):
            for d, lo, hi, v, said, many in zip(*(x.tolist() for x in r), strict=True):
                assert said == np.frombuffer(hashlib.blake2b(texts[d][lo : hi + window], digest_size=16).digest(), np.uint64).tolist()
                inside = [texts[d][j : j + window] for j in range(lo, hi + 1)]
                assert len(set(inside)) == len(inside) or many
                for j, x in zip(range(lo, hi + 1), inside, strict=True):
                    assert (d, j) not in seen and len(x) == window and anchor.setdefault(x, v) == v
                    seen[d, j] = v
        assert len(seen) == sum(max(0, len(t) - window + 1) for t in texts)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 5, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (1, 2, 3, 4, 7, 8) for _ in range(4)), rng.integers(0, 2**64, 60, dtype=np.uint64)]))
    found = {(int(i), int(j)) for x, y in bitsliced.pairs(fps, np.array([len(fps)]), radius) for i, j in zip(x, y, strict=True)}
    assert found == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if np.bitwise_count(fps[i] ^ fps[j]) <= radius}

    def classes(links):
        up = {int(f): int(f) for f in fps}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for x, y in links:
            up[max(root(x), root(y))] = min(root(x), root(y))
        return {f: root(f) for f in up}

    every = [(int(x), int(y)) for x in fps for y in fps if np.bitwise_count(x ^ y) <= radius and x < y]
    links = bitsliced.forest(fps, radius)
    assert classes(links) == classes(every) and len(links) == len(fps) - len(set(classes(every).values()))


def test_text_stats():
    texts = ["a b c d e f g h i\na b c d e f g h i\n\n  \nx # | <b>", "", "w " * 9, "l\nl\nl", "é" * 4 + " ü"]
    buf, off = batch(texts)
    got = stats.text_stats(buf, off)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        in_window = set()
        for j in range(len(w) - 7):
            if c[tuple(w[j : j + 8])] > 1:
                in_window |= set(range(j, j + 8))
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(in_window))
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def greedy_phrases(sample, text):
    s, t, n, i = (cross_parse.symbols(np.frombuffer(x, np.uint8)).tobytes() for x in (sample, text)), None, 0, 0
    s, t = s
    while i < len(t):
        j = i + 1
        while j < len(t) and t[i : j + 1] in s:
            j += 1
        n, i = n + 1, j
    return n


def test_cross_parse_is_the_greedy_parse():
    rng = random.Random(4)
    sample = b"the cat sat on the mat and the rat ran"
    samples = {"x": sample, "y": b"zzz", "z": "даже жаба да жажда".encode(), "w": bytes(rng.choice(b"ab ") for _ in range(400)), "v": b"a" * 300}
    p = cross_parse.Parser(samples)
    texts = [b"the rat sat", b"a cat and", b"the the the", b"mat", b"", b"?", "жаба đ да".encode(), b"xyx" * 5, "ж".encode()[1:] * 3]
    texts += [bytes(rng.choice(b"abt h") for _ in range(n)) for n in (1023, 1024, 1025, 2048, 5000, 9000)]
    texts += [b"THE Cat, sat!! On", b"THE!! MAT.\n\n(and) 12 the-rat" * 90, "ДАЖЕ жаба!".encode()]
    texts += [b"a" * 7000, b"ab" * 3000, (b"the cat sat on " * 400), "даже ".encode() * 900]
    got = p.phrases(*batch(texts))
    for i, lang in enumerate(p.langs):
        assert got[:, i].tolist() == [greedy_phrases(samples[lang], t) for t in texts], lang


def test_languages_of_one_script_beyond_latin_are_told_apart():
    rng = random.Random(1)
    letters = {"a": "абвгде", "b": "жзийкл", "c": "мнопрс"}
    text = lambda k, n: " ".join("".join(rng.choice(letters[k]) for _ in range(5)) for _ in range(n)).encode()
    p = cross_parse.Parser({k: text(k, 300) for k in letters})
    h = p.entropy(*batch([text(k, 40) for k in "abcabc"]))
    assert [p.langs[i] for i in h.argmin(axis=1)] == list("abcabc")


def test_postings_scores_and_selection():
    rng = np.random.default_rng(1)
    rows = [rng.integers(-9, 9, rng.integers(0, 6)) for _ in range(30)]
    q = [rng.integers(-9, 9, 4), np.zeros(0, np.int64)]
    got = topk.Postings(rows).scores(q)
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b, strict=False)))
    assert got.tolist() == [[dot(a, r) for r in rows] for a in q]
    huge = topk.Postings([np.array([1 << 40]), np.array([-(1 << 40)])]).scores([np.array([1 << 30])])
    assert huge.tolist() == [[1 << 70, -(1 << 70)]]
    s, i = topk.select(np.array([3, 5, 5, 1]), np.array([7, 9, 2, 4]), 4, 2)
    assert i.tolist() == [2, 9] and s.tolist() == [5, 5]


def test_chi_squared():
    assert abs(mcd.chi2_cdf(mcd.chi2_quantile(0.975, 5), 5) - 0.975) < 1e-12 and abs(mcd.chi2_quantile(0.95, 1) - 3.841459) < 1e-5
    x = np.random.default_rng(0).normal(size=(200_000, 3))
    d = (x * x).sum(axis=1)
    inner = x[d <= np.quantile(d, 0.75)]
    assert abs(inner.var(axis=0).mean() * mcd.consistency(0.75, 3) - 1) < 0.02


def test_attention_gradient():
    rng = np.random.default_rng(4)
    x, at, y = rng.normal(size=(7, mil.WIDTH)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])
    m = mil.Attention.new()
    m.params["q"] = rng.normal(size=mil.HIDDEN)
    loss = lambda: float(-(y * np.log(f := m.forward(x, at)["y"]) + (1 - y) * np.log(1 - f)).mean())
    g = m.gradient(m.forward(x, at), at, y)
    for k in ("W", "c", "V", "G", "u", "q", "r"):
        i = tuple(rng.integers(0, n) for n in m.params[k].shape)
        m.params[k][i] += 1e-6
        up = loss()
        m.params[k][i] -= 2e-6
        down = loss()
        m.params[k][i] += 1e-6
        assert abs((up - down) / 2e-6 - g[k][i]) < 1e-5


def test_attention_learns_from_one_bad_passage():
    good, bad = "plain words of a text that goes on and on " * 12, "*** $$$ ### !!! " * 16
    texts = [good, good + bad, bad, good * 2, bad + good, good[:200], "", bad[:100]]
    y = np.array([1, 0, 0, 1, 0, 1, 1, 0.0])
    x, at = mil.passages(*batch(texts))
    assert len(at) == len(texts) + 1 and at[7] - at[6] == 1
    m = mil.train(x, at, y, epochs=200, batch=8)
    assert ((m.predict(x, at) > 0.5) == (y > 0.5)).all()


def test_pu_learning_needs_no_negatives():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioustrn") for _ in range(5))
    clean = lambda: " ".join(word() for _ in range(30))
    toxic = lambda: clean() + " vile " + clean()
    pos = pu.features(*batch([toxic() for _ in range(150)]))
    unl = pu.features(*batch([toxic() if i % 5 == 0 else clean() for i in range(600)]))
    w, b = pu.train(pos, unl, 0.2)
    test = [toxic() for _ in range(50)] + [clean() for _ in range(50)] + [""]
    score = pu.sigmoid(pu.margins(w, b, *pu.features(*batch(test), w)))
    assert (score[:50] > 0.5).all() and (score[50:] < 0.5).mean() > 0.8 and score[:50].min() > np.quantile(score[50:], 0.95)


def test_raking_meets_every_margin():
    import pandas as pd

    rng = np.random.default_rng(0)
    cells = pd.DataFrame([(s, g, t, float(rng.integers(1, 100))) for s in "ab" for g in ("en", "de") for t in ("t0", "t1", "t2")], columns=["source", "lang", "topic", "tokens"])
    goals = {"source": {"a": 0.3, "b": 0.7}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"t0": 0.2, "t1": 0.2, "t2": 0.6}}
    cells["raked"] = cells["tokens"] * mixing.rake(cells, goals)
    for m, goal in goals.items():
        got = cells.groupby(m)["raked"].sum() / cells["raked"].sum()
        assert all(abs(got[k] - v) < 1e-6 for k, v in goal.items())
    m, t = np.array([2.0, 1.0, 0.1]), np.array([10.0, 10.0, 80.0])
    s = mixing.calibrate(lambda s: (t[m * s >= 1].sum(), (m * t)[m * s < 1].sum()), 30.0)
    assert abs((np.minimum(1, m * s) * t).sum() - 30) < 1e-9
    assert mixing.rake(cells.assign(tokens=0.0), goals).tolist() == [1.0] * 12


def thue_morse(n):
    """Two strings of n letters whose polynomial hashes modulo 2**64 are equal at every odd base, for n >= 1024."""
    t = [bin(i).count("1") & 1 for i in range(n)]
    return bytes(97 + x for x in t), bytes(98 - x for x in t)


def test_no_equality_rests_on_hashes_that_can_be_made_to_collide():
    a, b = thue_morse(1024)
    buf, off = batch([a, b])
    lo, hi = np.array([0, 1024]), np.array([1024, 2048])
    h = Rolling(buf.astype(np.uint64) + np.uint64(1)).of(lo, hi)
    assert h[0] == h[1]  # why it only deals
    for base in (3, 1 << 60, 2**64 - 1):
        s = Secret(buf.astype(np.uint64) + np.uint64(1), base).of(lo, hi)
        assert s[0] != s[1]
    assert len({tuple(x) for x in digests(buf.tobytes(), lo.tolist(), hi.tolist()).tolist()}) == 2
    w = sieve.Words(b"k")
    assert len(set(w.of(buf, off)[0].tolist())) == 2 and w.__reduce__()[1] == (b"k",)
    got = stats.text_stats(*batch([a + b"\n" + b + b"\n" + a, b" ".join([a] * 4 + [b] * 4 + [a] * 4 + [b] * 8)]))
    assert got["n_dup_lines"].tolist() == [1, 0]
    words_ = [b"0", *[a] * 4, *[b] * 4, *[a] * 4, *[b] * 8][1:]
    c = Counter(tuple(words_[j : j + 8]) for j in range(13))
    assert got["n_repeat_words"].tolist() == [0, len({i for j in range(13) if c[tuple(words_[j : j + 8])] > 1 for i in range(j, j + 8)})]


def test_secret_hashes_are_polynomials_modulo_the_prime():
    rng, p, base = random.Random(0), (1 << 61) - 1, 987654321987654321
    units = [rng.randrange(2**64) for _ in range(70)] + [0, 1, p, p - 1, 2**64 - 1]
    h = Secret(np.array(units, np.uint64), base)
    for a, b in ((0, 75), (3, 9), (70, 75), (5, 5)):
        want = sum(u * pow(base + 2, i, p) for i, u in enumerate(units[a:b])) % p
        assert int(h.of(np.array([a]), np.array([b]))[0]) == want


def test_word_numbers():
    texts = ["a ab abc abcdefg abcdefgh abcdefghi", "abcdefg a", "\0 \0\0 a\0", "é üüü üüüü"]
    buf, off = batch(texts)
    ws, we, _ = words(buf, off)
    names = [buf[a:b].tobytes() for a, b in zip(ws, we, strict=True)]
    for got in (word_names(buf, ws, we).tolist(), sieve.Words(b"x").of(buf, off)[0].tolist()):
        assert all((got[i] == got[j]) == (names[i] == names[j]) for i in range(len(names)) for j in range(len(names)))


@pytest.mark.parametrize("sizes", [[2], [2] * 40 + [3, 5, 1, 1], [63, 64, 65, 1, 2, 48, 49], [700, 2, 31], [5000]])
def test_planes_decide_every_link_of_buckets_of_any_size(sizes, monkeypatch):
    rng = np.random.default_rng(sum(sizes))
    fps, bucket = [], []
    for i, n in enumerate(sizes):
        base = rng.integers(0, 2**64, max(1, n // 3), dtype=np.uint64)
        made: list[int] = []
        while len(made) < n:
            f = int(base[rng.integers(0, len(base))]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
            if f not in made[-50:] and (n > 100 or f not in made):
                made.append(f)
        made = list(dict.fromkeys(made))
        fps += made
        bucket += [i] * len(made)
    fps, bucket = np.array(fps, np.uint64), np.array(bucket)
    compared = 0
    real = bitsliced.near

    def counted(plane, by, over, radius):
        nonlocal compared
        compared += int((~np.unpackbits(over.view(np.uint8)).astype(bool)).sum())
        return real(plane, by, over, radius)

    monkeypatch.setattr(bitsliced, "near", counted)
    links = bitsliced.forest(fps, 2, bucket)
    each = [len(set(bucket[bucket == i].tolist())) and int((bucket == i).sum()) for i in range(len(sizes))]
    assert compared == sum(n * (n - 1) // 2 for n in each)  # all pairs went through the planes
    up = {(int(b), int(f)): (int(b), int(f)) for b, f in zip(bucket, fps, strict=True)}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(sizes)):
        mine = fps[bucket == i]
        for k in range(0, len(mine), 500):
            a, b = np.nonzero(np.bitwise_count(mine[k : k + 500, None] ^ mine[None, :]) <= 2)
            for x, y in zip((a + k).tolist(), b.tolist(), strict=True):
                p, q = root((i, int(mine[x]))), root((i, int(mine[y])))
                up[max(p, q)] = min(p, q)
    classes = len({root(x) for x in up})
    assert len(links) == len(up) - classes
    where: dict[int, set] = {}
    for b, f in up:
        where.setdefault(f, set()).add(b)
    assert all((x ^ y).bit_count() <= 2 and where[x] & where[y] for x, y in links)
