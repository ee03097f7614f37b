"""Quality rules: base rules, then robust multivariate outliers per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mcd
from ._spark import checkpoint, map_arrow, meet, written
from ._text import buffers, column_of, steps
from .stats import text_stats

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rows that a group needs for an estimate of its own; smaller ones are pooled by language, then all together.
LEAST = 50
#: A row goes if so few normal rows would lie as far out.
TAIL = 1e-3
#: The standard deviation added to each column, only so that one that hardly varies in a group leaves no singular scatter.
FLOOR = 0.05
#: The transformed vector.
VECTOR = {
    "log of words": "ln(n_words + 1)",
    "log of characters a word": "ln((word_chars + 1) / (n_words + 1))",
    "symbols in a hundred words": "ln(1 + 100.0 * n_symbols / (n_words + 1))",
    "repeated lines in a hundred words": "ln(1 + 100.0 * n_dup_lines / (n_words + 1))",
    "repeated words in a hundred": "ln(1 + 100.0 * n_repeat_words / (n_words + 1))",
}


def doc_stats(docs: DataFrame, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = buffers(column_of(batch, "text"))
            for a, b in steps(off):
                s = text_stats(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                kept = [column_of(batch, c).slice(a, b - a) for c in ("doc_id", "lang", "source")]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(s[c].astype(np.int64)) for c in STATS]], names=["doc_id", "lang", "source", *STATS])

    cols = [F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text")]
    return docs.select(*cols).transform(map_arrow, run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in STATS))


def _grouped(rows: DataFrame, least: int) -> DataFrame:
    """Adds g: language and source, or the pool that takes a group of fewer than ``least`` rows."""
    lang = F.coalesce("lang", F.lit("\x00"))
    fine = F.concat_ws("\x1f", F.lit("group"), lang, F.coalesce("source", F.lit("\x00")))
    rows = rows.withColumn("fine", fine)
    size = written(rows.groupBy("fine").agg(F.count(F.lit(1)).alias("n"), F.first(lang).alias("of")))
    pools = size.filter(F.col("n") < least).groupBy("of").agg(F.sum("n").alias("pooled"))
    name = F.when(F.col("n") >= least, F.col("fine")).when(F.col("pooled") >= least, F.concat_ws("\x1f", F.lit("pool"), "of")).otherwise(F.lit("all"))
    return meet(rows, written(size.join(pools, "of", "left").select("fine", name.alias("g"))), "fine").drop("fine")


def apply_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, tail: float = TAIL) -> DataFrame:
    """Statistics and verdict of every whole text, a row per row of docs:
    (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance).

    base_failed: fewer than 20 words, or over 30 in 100 words lie in 8-word windows found
    twice or more in the text.  Of the rest, the transformed statistics of each language
    and source give a minimum-covariance-determinant centre and scatter; a row whose
    squared Mahalanobis distance from it passes the chi-squared quantile of 1 - ``tail`` is
    rejected.  Null texts have no words and fail.  Null languages and sources are groups of
    their own.  Groups of fewer than ``least`` rows are pooled by language, then all
    together; a pool still smaller gives no verdict and its rows are kept.  distance is
    null where there is none.  Repeated rows count as often as they are there.
    """
    words = F.col("n_words")
    stats = checkpoint(doc_stats(docs, doc_id, text, lang, source).withColumn("base_failed", (words < 20) | (100 * F.col("n_repeat_words") > 30 * words)))
    p = len(VECTOR)
    passed = stats.filter("not base_failed").select("*", *[F.expr(e).alias(f"f{i}") for i, e in enumerate(VECTOR.values())])
    vectors = checkpoint(_grouped(passed, least))
    model = mcd.fit(vectors.select("g", *[f"f{i}" for i in range(p)]), p, [FLOOR] * p)
    judged = meet(vectors, model.filter(F.col("n") >= least).select("g", "centre", "precision"), "g", "left").withColumn("distance", mcd.distance(p))
    bound = mcd.chi2_quantile(1 - tail, p)
    out = ["doc_id", *STATS, "base_failed"]
    kept = F.coalesce(F.col("distance") <= bound, F.lit(True)).alias("kept")
    return judged.select(*out, kept, "distance").unionByName(stats.filter("base_failed").select(*out, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")))
