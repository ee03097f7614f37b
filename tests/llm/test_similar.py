"""Near copies by exact 5-word Jaccard similarity, against brute force."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from kairo.llm import similar
from kairo.llm.similar import keep_one_similar

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def classes(texts):
    s, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(s))]


def test_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    want = {r.doc_id for i, (r, root) in enumerate(zip(rows, classes([r.text for r in rows]), strict=True)) if root == i}
    out = corpus_pipeline.simhash_near_dedup(spark, docs, SF)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(want)


@pytest.mark.parametrize("all_pairs,common", [(8, 40), (2, 3), (1, 1)])
def test_near_the_bound(spark, all_pairs, common):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(rng.randrange(6, 150))]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 30)):
                t[rng.randrange(len(t))] = "x" + str(rng.randrange(10**6))
            rows.append((len(rows), " ".join(t[: len(t) - rng.randrange(0, 4)]) + " the same line in all of them"))
    got = sorted(r.id for r in keep_one_similar(spark.createDataFrame(rows, "id long, text string"), "id", all_pairs=all_pairs, common=common).collect())
    assert got == sorted({r for r in classes([t for _, t in rows])})


def test_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    c = " ".join(f"c{i}" for i in range(40))
    rows = [(5, a), (3, b), (5, b + " end"), (None, c), (None, c), (7, None), (8, " "), (None, a + " end"), (9, c + " end c"), (9, c + " end c")]
    got = keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, a), (3, b), (9, c + " end c"), (7, None)], key=str)
    assert keep_one_similar(spark.createDataFrame(rows[:0], "doc_id long, text string")).count() == 0


def test_fingerprints_of_sets():
    rng = np.random.default_rng(5)
    h, off = rng.integers(0, 2**64, 40, np.uint64), np.array([0, 0, 1, 18, 40])
    want = []
    for a, b in zip(off, off[1:], strict=False):
        m = similar.mix(h[a:b] + np.uint64(5)).tolist()
        want.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in m) > len(m)))
    assert similar.prints_of(h, off).view(np.uint64).tolist() == want


@pytest.mark.parametrize("radius", [0, 5, 20, 63])
def test_near_fingerprints_of_small_keys(radius):
    rng = np.random.default_rng(radius)
    size = rng.integers(1, 17, 200)
    base = np.repeat(rng.integers(0, 2**63, len(size)), size)
    flip = rng.integers(0, 2**63, len(base)) & rng.integers(0, 2**63, len(base)) & rng.integers(0, 2**63, len(base))
    fp, key = base ^ flip, np.repeat(np.arange(len(size)), size)
    want = {(i, j) for j in range(len(fp)) for i in range(j) if key[i] == key[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= radius}
    assert set(map(tuple, similar.near_pairs(size, fp, radius).T.tolist())) == want
    none = np.zeros(len(fp), np.int32)
    rows = pa.record_batch([pa.array(key), pa.array(none + 100), pa.array(np.arange(len(fp))), pa.array(none), pa.array(fp)], names=["t", "n", "node", "p", "fp"])
    got = [r for b in similar._keys(16, radius)(iter([rows.slice(0, 700), rows.slice(700)])) for r in b.to_pylist()]
    assert {(r["node"], r["other"]) for r in got if r["near"]} == want
    assert {(r["node"], r["other"]) for r in got} == {(i, j) for j in range(len(fp)) for i in range(j) if key[i] == key[j]}


@pytest.mark.parametrize("radius,all_pairs", [(0, 16), (0, 1), (64, 16)])
def test_no_radius_loses_a_link(spark, radius, all_pairs):
    rng = random.Random(radius)
    rows = []
    for _ in range(8):
        base = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(rng.randrange(60, 150))]
        for _ in range(6):
            t = list(base)
            t[rng.randrange(len(t))] = "x" + str(rng.randrange(10**6))
            rows.append((len(rows), " ".join(t)))
    got = sorted(r.id for r in keep_one_similar(spark.createDataFrame(rows, "id long, text string"), "id", all_pairs=all_pairs, radius=radius).collect())
    assert got == sorted(set(classes([t for _, t in rows])))


def test_texts_that_no_pair_needs_are_left_out(spark):
    """What disk went to: every text was sent to the few that were wanted."""
    ends = spark.createDataFrame([(1, 77), (2, -5)], "k1 long, k2 long")
    batch = pa.record_batch([pa.array([1, 2, 3, 2, 4]), pa.array([77, -5, 78, -5, 1 << 23]), pa.array(["a b", "c d", "e f", "c d", "g h"])], names=["k1", "k2", "text"])
    got = [r for b in similar._with_sets(5, similar._map_of(ends))(iter([batch])) for r in b.to_pylist()]
    assert [(r["k1"], r["k2"], len(r["set"])) for r in got] == [(1, 77, 8), (2, -5, 8)]
