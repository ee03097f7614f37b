"""The pipeline, each stage held against a plain version on what its predecessor kept."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.toPandas())
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "mixing_sources", "byte_level_bpe"]
    assert all(list(s.columns) == list(stages[0].columns) for s in stages[1:5])


def test_each_stage(stages):
    docs, known, single, cut, mixed, coded = stages
    assert len(known) >= 0.98 * len(docs) and set(known.doc_id) <= set(docs.doc_id)
    # near copies on word shingles: five words, similarity of 0.8 or more
    ids, sets = known.doc_id.tolist(), [shingles(t) for t in known.text]
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in zip(ids, sets, strict=True):
        for j, b in zip(ids, sets, strict=True):
            if j < i and 5 * len(a & b) >= 4 * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    assert set(single.doc_id) == {i for i in ids if root(i) == i}

    texts = [t.encode() for t in single.text]
    c = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = {}
    for i, t in zip(single.doc_id, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - 199):
            if c[t[j : j + 200]] > 1:
                gone[j : j + 200] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes().decode(errors="replace").replace("�", "")
        if not gone.any() or left.strip(" "):
            want[i] = left
    assert {i: t.replace("�", "") for i, t in zip(cut.doc_id, cut.text, strict=True)} == want
    assert (cut.n_chars == cut.text.str.len()).all()
    assert 0 < len(mixed) < len(cut) and set(mixed.doc_id) <= set(cut.doc_id)

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = dict(zip(mixed.doc_id, mixed.text, strict=True))
    assert set(coded.doc_id) == set(text)
    for r in coded.itertuples():
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(text[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in out.collect()) == sorted(stages[-1].doc_id)


def test_scratch_is_deleted(spark, tmp_path):
    import os

    from kairo.llm._spark import ensure_checkpoints, scratch_made

    before, made = set(os.listdir(folder := ensure_checkpoints(spark).removeprefix("file:"))), scratch_made()
    out = corpus_pipeline.run(spark, SF)
    left = {x for x in set(os.listdir(folder)) - before if not x.startswith("rdd-")}
    assert scratch_made() == made and len(left) == 1 and len(os.listdir(f"{folder}/{left.pop()}")) == 1 and out.count() > 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, k1 long, __k1 string, u string, decoded string"


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    """Nulls in every column, blank and long texts, repeated rows and ids, ties and clashing names."""
    base = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    more = (None, 7, "x", None, "d")
    long = " ".join(f"word{i} and{i % 977}" for i in range(30_000))
    rows = [(*r, *more) for r in base]
    rows += [rows[3], rows[3], (None, base[4][1] + " and an end", None, None, None, *more), (base[5][0], "ein anderer Text derselben Nummer der bleibt", "de", "s", 1, *more), (None,) * 10, (9001, "", "en", "s", 0, *more), (9002, " \n ", "en", "s", 3, *more), (9003, "12 34 56", None, None, 8, *more), (9004, long, "en", None, len(long), *more)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    gone = {9001, 9002, 9003}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, SF)
        assert k == 4 or out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        ids = Counter(r.doc_id for r in docs.select("doc_id").collect())
        assert not gone & set(ids), name  # without a letter: rejected by language ID
        if k == 1:
            assert ids[base[3][0]] <= 1 and len(docs.filter("text is null").collect()) == 0
    assert docs.count() > 0


def test_empty_tables_go_through_every_stage(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() == 0, name


def test_stages_begin_on_heaps_given_back(spark):
    spark.sparkContext.setJobGroup("begin", "begin")
    try:
        corpus_pipeline.begin(spark)
    finally:
        spark.sparkContext.setJobGroup("", "")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("begin")
    assert len(jobs) == 1  # System.gc() in tasks: the driver's own does nothing for executors
