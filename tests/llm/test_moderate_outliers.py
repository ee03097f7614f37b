"""Quality rules reject moderate outliers of one column, not only extreme ones."""

from __future__ import annotations

import numpy as np

from kairo.llm import rules


def test_half_a_symbol_a_word_is_an_outlier(spark):
    rng = np.random.default_rng(1)
    word = lambda n: ["w" * int(k) for k in rng.integers(2, 9, n)]
    plain = [" ".join(word(int(rng.integers(80, 200)))) for _ in range(300)]
    marked = [" ".join(w + "#" * (k % 2) for k, w in enumerate(word(int(rng.integers(80, 200))))) for _ in range(15)]
    rows = [(i, t, "en", "s") for i, t in enumerate(plain + marked)]
    got = {r.doc_id: r.kept for r in rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[i] for i in range(300)) >= 295 and not any(got[300 + i] for i in range(15))
