"""Topics of the mixing operator are fitted on all documents, whole."""

from __future__ import annotations

import random

import numpy as np

from kairo.llm import mixing


def test_all_documents_shape_the_topics(spark, monkeypatch):
    monkeypatch.setattr(mixing, "START_DOCS", 9)
    rng = random.Random(5)
    text = lambda g, n: " ".join("abcde"[g] + "".join(rng.choice("qrstuvw") for _ in range(3)) for _ in range(n))
    texts = [text(i % 5, rng.randrange(20, 90)) for i in range(300)] + [text(4, 15_000), None, "", "12 34"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    x = []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        x.append(mixing.topic_vectors(raw, np.array([0, len(raw)]))[0][0])
    x = np.array(x)
    c = mixing.start_topics(docs)
    assert len(c) == 8
    for _ in range(25):
        near = (x @ c.T).argmax(axis=1)
        for i in range(len(c)):
            m = x[near == i].sum(axis=0)
            if m.any():
                c[i] = m / np.sqrt((m * m).sum())
    got = mixing.fit_topics(docs)
    assert np.abs(got - c).max() < 1e-4 and (np.argmax(x @ got.T, axis=1) == np.argmax(x @ c.T, axis=1)).mean() > 0.99
