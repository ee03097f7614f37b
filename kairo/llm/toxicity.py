"""Toxicity scores from confirmed toxic examples and unlabelled text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_sample, held_out, map_arrow
from ._text import buffers, column_of, steps
from .pu import features, margins, sigmoid, train

#: The fit's bounds: texts of each kind, and characters of a text that may be drawn.
FIT_POSITIVE, FIT_UNLABELLED, FIT_CHARS = 3000, 9000, 50_000


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """nnPU on bounded hash samples of the labelled training rows whose texts have no more than
    FIT_CHARS characters: FIT_POSITIVE of those labelled 1, and FIT_UNLABELLED of all of them
    with their labels put away, as unlabelled text.  The prior is the share of 1 among the
    labels, so it is that of the rows which the unlabelled texts are drawn from."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("y")).filter("id is not null and y is not null").filter(~held_out("id"))
    counts = {int(r.y): r["count"] for r in known.groupBy("y").count().collect()}
    prior = counts.get(1, 0) / max(sum(counts.values()), 1)
    rows = docs.filter(~held_out(doc_id)).select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter(F.length("text") <= FIT_CHARS)
    kinds = {}
    # ids are sampled first and few enough to broadcast, so texts never travel to their labels
    usable = known.join(rows.select("id").distinct(), "id")
    for kind, ids, n in (("p", usable.filter("y = 1").select("id").distinct(), FIT_POSITIVE), ("u", usable.select("id").distinct(), FIT_UNLABELLED)):
        few = bounded_sample(ids.withColumn("kind", F.lit(kind)), "kind", "id", n).select("id").distinct()
        picked = rows.join(F.broadcast(few), "id").dropDuplicates(["id"]).orderBy("id")
        picked = _extracted(picked).toArrow()
        f = [np.frombuffer(x, np.int32) for x in picked["f"].to_pylist()]
        kinds[kind] = (np.concatenate(f).astype(np.int64) if f else np.zeros(0, np.int64), np.cumsum([0, *map(len, f)]))
    return Model(*train(kinds["p"], kinds["u"], min(max(prior, 1e-4), 1 - 1e-4)))


def _extracted(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = buffers(column_of(batch, "text"))
            for a, b in steps(off):
                f, at = features(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                raw = [f[x:y].astype(np.int32).tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], names=["f"])

    return rows.select("text").transform(map_arrow, run, "f binary")


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores every whole text: (doc_id, held_out, score, predicted), a row per row of docs.

    A null or empty text has no features and gets the score of the bias alone.  A null id
    counts as held out.  Repeated rows give repeated scores; further columns are ignored.
    The model, one float for each hashed feature, is four megabytes whatever the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            buf, off = buffers(column_of(batch, "text"))
            parts = [sigmoid(margins(m.weights, m.bias, *features(buf[off[a] : off[b]], off[a : b + 1] - off[a], m.weights))) for a, b in steps(off)]
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "score"])

    done = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).transform(map_arrow, run, "doc_id long, score double")
    return done.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
