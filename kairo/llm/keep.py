"""One row of each class of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import checkpoint, row_key


def first_of_each(docs: DataFrame, rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with exactly one row of each class: the one of the smallest id, null ids last, then by a
    hash of id and text.  Of equal rows one stays.

    ``rows(k1, k2, id, root)`` has the key, id and class of every row of docs; see row_key.
    Columns of docs may have any names.
    """
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")
    best = checkpoint(rows.groupBy("root").agg(F.min(rank).alias("r")).select("r.k1", "r.k2"))
    counts = checkpoint(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("c")))
    gone = counts.join(best, ["k1", "k2"], "left_anti").select("k1", "k2")
    twice = checkpoint(counts.filter("c > 1").join(best, ["k1", "k2"], "left_semi").select("k1", "k2"))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(doc_id, text)).join(gone, ["k1", "k2"], "left_anti")
    if not twice.isEmpty():
        out = out.join(twice, ["k1", "k2"], "left_anti").unionByName(out.join(twice, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
