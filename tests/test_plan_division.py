"""The plan's division is that of doubles, as in SQL."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import functions as F

from kairo.plans import builder, plan
from kairo.series import Series


def test_division_by_zero(spark):
    rows = [(0, 6.0, 3.0), (1, 1.0, 0.0), (2, -1.0, 0.0), (3, 0.0, 0.0), (4, None, 0.0), (5, 1.0, None), (6, 1.0, -0.0), (7, 0.0, 2.0)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double").withColumn("t", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz"))
    spec = builder.plan(id=builder.col("id"), q=builder.col("a") / builder.col("b"))
    out, _ = plan.run(Series.of(df, time="t", seq="id"), plan.standard_ops(), spec)
    got = {r.id: r.q for r in out.collect()}
    assert got[0] == 2.0 and got[1] == math.inf and got[2] == -math.inf and math.isnan(got[3])
    assert got[4] is None and got[5] is None and got[6] == -math.inf and got[7] == 0.0
