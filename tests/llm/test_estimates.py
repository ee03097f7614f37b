"""The risk of positive-unlabelled learning and the margins of mixing, against their definitions."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from kairo.llm import mixing, pu


@pytest.mark.parametrize("prior", [0.05, 0.3, 0.9])
def test_risk_and_its_derivatives(prior):
    rng = np.random.default_rng(int(prior * 100))
    loss = lambda z: np.log1p(np.exp(-z))
    seen = set()
    for shift in (-4.0, 0.0, 4.0):
        gp, gu = rng.normal(size=7) + 2 - shift, rng.normal(size=9) + shift
        negative = loss(-gu).mean() - prior * loss(-gp).mean()
        value, dp, du = pu.risk(gp, gu, prior)
        assert abs(value - (prior * loss(gp).mean() + max(0.0, negative))) < 1e-12
        seen.add(negative >= 0)

        def target(a, b, negative=negative):  # what the step descends
            part = loss(-b).mean() - prior * loss(-a).mean()
            return prior * loss(a).mean() + part if negative >= 0 else -part

        for g, d, first in ((gp, dp, True), (gu, du, False)):
            for i in range(len(g)):
                up, down = g.copy(), g.copy()
                up[i] += 1e-6
                down[i] -= 1e-6
                slope = (target(up, gu) - target(down, gu) if first else target(gp, up) - target(gp, down)) / 2e-6
                assert abs(slope - d[i]) < 1e-6
    assert True in seen and (prior < 0.5 or False in seen)


def test_margins_meet_targets_and_contradictions_are_told(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(40)]  # of any language and source alike
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 30)))), "abc"[int(rng.integers(0, 3))], ["en", "de"][int(rng.integers(0, 2))]) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.6, "de": 0.4}}
    for cells in (mixing.MAX_CELLS, 0):
        got = mixing.mix(docs, targets, max_cells=cells).drop("row").toPandas()
        sql = """select margin, v, sum(n_tokens * weight) / sum(sum(n_tokens * weight)) over (partition by margin) as raked from (
          select 'source' as margin, source as v, n_tokens, weight from got union all select 'lang', lang, n_tokens, weight from got) group by 1, 2"""
        for margin, v, raked in duckdb.sql(sql).fetchall():
            assert abs(raked - targets[margin][v]) < mixing.UNMET, (margin, v, raked)
        told = {(r.margin, r.value): r.raked for r in mixing.margins(spark.createDataFrame(got)).collect()}
        assert all(abs(told[m, v] - x) < mixing.UNMET for m, t in targets.items() for v, x in t.items())
    cells = pd.DataFrame([("a", "en", "t0", 5.0), ("b", "de", "t1", 5.0)], columns=[*mixing.MARGINS, "tokens"])
    goals = {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"t0": 0.5, "t1": 0.5}}
    off = mixing.unmet(cells, mixing.rake(cells, goals), goals)
    assert off > 0.3
    with pytest.warns(UserWarning, match="contradict"):
        mixing._tell(off)
