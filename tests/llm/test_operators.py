"""The operators over small tables: brute force, and every odd input that their docstrings define."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kairo.llm import langid, mixing, quality, queries, rules, toxicity
from kairo.llm.bpe import encode_docs
from kairo.llm.simhash import keep_one, simhash_groups
from kairo.llm.substring import remove_repeated_words
from kairo.llm.suffix import remove_repeated_bytes, without_repeats
from kairo.llm.topk import top_k

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, k1 string, v string, fp string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, clashing names."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, long = text(80), text(30_000)
    texts = ["", " \n\t ", "1234 567", "é", text(10), text(50), shared, "x " + shared, shared + " y", text(30) + " " + shared + " " + text(30), "ab " * 400, "a" * 1000, long, long + " end", text(60)]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", None)[i % 2], len(t), "r", "k", None, "f") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, None, None, None, None, None, None, None, None), (None, shared, "en", "s1", None, None, None, None, None), (6, "another text of the same id", "en", "s1", 1, None, None, None, None), (99, None, "en", "s1", 0, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def removed(seqs, window, join):
    c = Counter(x[i : i + window] for x in seqs for i in range(len(x) - window + 1))
    out = []
    for x in seqs:
        gone = [False] * len(x)
        for i in range(len(x) - window + 1):
            if c[x[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(x), sum(gone), hashlib.sha256(join([y for y, g in zip(x, gone, strict=True) if not g])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [512, 1])
@pytest.mark.parametrize("window", [200, 24])
def test_bytes(odd, hot, window):
    got = remove_repeated_bytes(odd, window=window, gram=window // 3, hot=hot).select("n_units", "n_removed", F.sha2("kept", 256), "spans", "row.doc_id").collect()
    texts = [(r.text or "").encode() for r in odd.collect()]
    assert sorted(tuple(r)[:3] for r in got) == removed(texts, window, bytes)
    for r in got:  # maximal runs: they ascend and never touch
        edge = list(r.spans)
        assert sum(b - a for a, b in zip(edge[::2], edge[1::2], strict=True)) == r.n_removed and all(x < y for x, y in zip(edge, edge[1:], strict=False))


@pytest.mark.parametrize("hot", [512, 1])
def test_words(odd, hot):
    got = remove_repeated_words(odd, hot=hot).select("n_units", "n_removed", F.sha2("kept", 256)).collect()
    seqs = [tuple(re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode())) for r in odd.collect()]
    assert sorted(map(tuple, got)) == removed(seqs, 35, b" ".join)


def test_texts_made_to_collide(spark):
    t = [bin(i).count("1") & 1 for i in range(1024)]
    a, b = "".join("ab"[x] for x in t), "".join("ba"[x] for x in t)
    lines = [" ".join([w] * 3 + [f"w{i}" for i in range(40)]) for w in (a, b)]
    docs = spark.createDataFrame(list(enumerate([a, b, a + "x", *lines])), "doc_id long, text string")
    texts = [r.text.encode() for r in docs.collect()]
    for hot in (512, 1):
        got = remove_repeated_bytes(docs, hot=hot).select("n_units", "n_removed", F.sha2("kept", 256)).collect()
        assert sorted(map(tuple, got)) == removed(texts, 200, bytes)
        got = remove_repeated_words(docs, hot=hot).select("n_units", "n_removed", F.sha2("kept", 256)).collect()
        assert sorted(map(tuple, got)) == removed([tuple(x.split(b" ")) for x in texts], 35, b" ".join)


def test_texts_without_repeats(odd):
    out = without_repeats(odd)
    assert out.columns == odd.columns
    kept = {r.doc_id: r for r in out.collect() if r.doc_id not in (None, 5)}
    assert kept[4].n_chars == odd.filter("doc_id = 4").first().n_chars and 6 in kept and kept[9].n_chars == len(kept[9].text)
    assert 12 not in kept


def test_simhash(odd):
    import xxhash

    def fingerprint(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = odd.collect()
    fps = [(r.doc_id, fingerprint(r.text)) for r in rows]
    nodes = sorted({f for _, f in fps})
    up = {f: f for f in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in nodes:
        for b in nodes:
            if (a ^ b).bit_count() <= 2:
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, f in fps:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((i, f"{f:016x}", least.get(root(f))) for i, f in fps), key=key)
    for split in (1024, 2):
        assert sorted(map(tuple, simhash_groups(odd, split_above=split).collect()), key=key) == want
    # one row of each class, the smallest id first, null ids last
    rank = lambda r: (r.doc_id is None, r.doc_id or 0)
    firsts: dict = {}
    for r in rows:
        k = root(fingerprint(r.text))
        firsts[k] = min(firsts.get(k, r), r, key=rank)
    kept = keep_one(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in firsts.values()), key=str)


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 200)], [(i, (i * 7) % 101) for i in range(101)] + [(1000, 1001)], [(5, 5)], []])
def test_components_of_chains_stars_and_rings(spark, links):
    from kairo.llm.components import star_components

    up: dict = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.root for r in star_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}


@pytest.mark.parametrize("chunk,overlap", [(16384, 512), (300, 40), (64, 8)])
def test_bpe(odd, chunk, overlap):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = encode_docs(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk=chunk, overlap=overlap).collect()
    want = [(r.doc_id, np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in odd.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got), key=key) == sorted(want, key=key)
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)


def test_pre_tokens_of_both_engines_agree():
    """Boundaries come from one engine and ids from another: both must cut any text alike."""
    import public_tokenizers as P
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from kairo.llm.bpe import Codec

    c = Codec(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    odd_chars = st.sampled_from(list(" \t\n\r\u00a0\u2003\u3000'sStTdD09.,!é´ßǅ\u0301\u0300क्षि一二ａ１½Ⅷ١🙂👩‍👩‍👧\u200d\u200b\ufeff\x00\x1c\x85"))
    text = st.one_of(st.text(max_size=60), st.text(odd_chars, max_size=60), st.lists(st.sampled_from(["don't", "I'LL", "  two", "\n\n x", "3.14", "x²", "ﬃ", "A\u030a"]), max_size=12).map(" ".join))

    @settings(max_examples=600, deadline=None)
    @given(text)
    def check(t):
        pieces = c.pattern.findall(t)
        assert "".join(pieces) == t
        assert [int(i) for p in pieces for i in c.encode(p)] == c.encode(t).tolist()
        assert c.decode(c.encode(t)) == t.encode()

    check()


def test_top_k_agrees_with_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = sorted(c.sql(queries.oracle_sql()["op7_exact_top_k"]).fetchall())
    assert sorted(map(tuple, queries.op7_exact_top_k(spark, SF).select("query_id", "rank", "vec_id", "score").collect())) == [tuple(w) for w in want]


def test_top_k_odd_rows(spark):
    from kairo.llm.topk import quantise, usable

    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [9.0, 9.0]), (6, []), (7, [-1.0, 0.001]), (50, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = df.filter(usable("embedding")).select("vec_id", quantise("embedding").alias("vec"))
    got = sorted(map(tuple, top_k(v, v.filter("vec_id % 50 = 0"), 3, candidates_per_block=2, queries_per_block=1).collect()))
    assert got == [(0, 1, 1, 256 * 256 + 512 * 512), (0, 2, 2, 256 * 256 + 512 * 512), (0, 3, 2, 256 * 256 + 512 * 512)]
    with pytest.raises(Exception, match="64 bits"):
        spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>").select(quantise("embedding")).collect()
    assert top_k(v.limit(0), v.limit(0), 3).count() == 0


def test_rules(odd):
    got = rules.apply_rules(odd, least=3)
    assert got.count() == odd.count()
    rows = got.collect()
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    assert all(r.kept for r in rules.apply_rules(odd, least=10**6).collect() if not r.base_failed)


def test_rules_reject_what_is_far_from_its_group(spark):
    rng = np.random.default_rng(0)
    text = lambda n, extra="": " ".join("w" * int(k) for k in rng.integers(2, 9, n)) + extra
    rows = [(i, text(int(rng.integers(80, 200))), "en", "s") for i in range(150)] + [(1000 + i, text(100, " ### $$$ %%%" * 40), "en", "s") for i in range(10)]
    got = {r.doc_id: r.kept for r in rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(150)) and not any(got[1000 + i] for i in range(10))


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    pred = {r.doc_id: r.lang_pred for r in rows}
    assert all(pred[i] == "und" for i in (0, 1, 2, 99)) and pred[3] != "und" and set(pred.values()) <= {"en", "de", "und"}
    assert {0, 1, 2, 99} & {r.doc_id for r in langid.keep_identified(odd).collect()} == set()


def auc(y, s):
    order = np.argsort(np.argsort(s))
    y = np.asarray(y)
    return (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (1 - y).sum())


def test_classifiers_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    for module, label, floor in ((toxicity, "toxic", 0.9), (quality, "quality", 0.97)):
        got = module.score(docs, module.fit(docs, labels)).join(labels, "doc_id").filter("held_out").select("score", label, "predicted").collect()
        assert auc([r[label] for r in got], np.array([r.score for r in got])) > floor


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_on_odd_rows(spark, odd, module):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(15)] + [(None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    rows = module.score(odd, module.fit(odd, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert len(module.score(odd, module.fit(odd, labels.limit(0))).collect()) == odd.count()


def test_mixing(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.probability <= 1 for r in got)
    assert abs(sum(r.probability * r.n_tokens for r in got) / sum(r.n_tokens for r in got) - 0.5) < 1e-6
    frames = mixing.mix(odd, max_cells=0, frame_rounds=6).collect()
    assert abs(sum(r.probability for r in frames) - sum(r.probability for r in got)) < 0.5
    assert mixing.sample(odd).columns == odd.columns


def test_empty_tables(spark, none):
    import public_tokenizers as P

    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for out in (
        remove_repeated_bytes(none), remove_repeated_words(none), simhash_groups(none), keep_one(none), without_repeats(none), rules.apply_rules(none), langid.identify(none), mixing.mix(none),
        encode_docs(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), toxicity.score(none, toxicity.fit(none, labels)), quality.score(none, quality.fit(none, labels)),
    ):
        assert out.count() == 0
