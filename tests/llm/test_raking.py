"""Raking in DataFrames goes as far as raking on the driver."""

from __future__ import annotations

import inspect

import numpy as np
import pandas as pd

from kairo.llm import mixing


def test_both_paths_agree(spark):
    for f, name in ((mixing.rake, "rounds"), (mixing.rake_frames, "rounds"), (mixing.mix, "frame_rounds")):
        assert inspect.signature(f).parameters[name].default == mixing.ROUNDS
    rng = np.random.default_rng(2)
    rows = [(f"s{i}", f"l{j}", f"t{k}", float(rng.integers(1, 1000))) for i in range(2) for j in range(3) for k in range(2)]
    cells = pd.DataFrame(rows, columns=["source", "lang", "topic", "tokens"])
    total = cells["tokens"].sum()
    goals = {m: mixing.flattened((cells.groupby(m)["tokens"].sum() / total).to_dict(), 0.5) for m in mixing.MARGINS}
    got = mixing.rake_frames(spark.createDataFrame(cells), {}, 0.5).toPandas().sort_values(list(mixing.MARGINS))["m"].to_numpy()
    assert np.allclose(got, mixing.rake(cells.sort_values(list(mixing.MARGINS)).reset_index(drop=True), goals), rtol=1e-6)
