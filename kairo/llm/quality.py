"""Quality scores by attention over passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_sample, held_out, map_arrow
from ._text import buffers, column_of, steps
from .mil import WIDTH, Attention, passages, train

#: The fit's bounds: labelled documents of each class, and characters of one that may be drawn.
FIT_DOCS, FIT_CHARS = 2000, 50_000


def _passages_of(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = buffers(column_of(batch, "text"))
            for a, b in steps(off):
                x, at = passages(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                raw = [x[p:q].tobytes() for p, q in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([column_of(batch, "y").slice(a, b - a), pa.array(raw, pa.binary())], names=["y", "x"])

    return rows.select("y", "text").transform(map_arrow, run, "y int, x binary")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Attention:
    """Trains on a bounded hash sample of the labelled training rows whose texts have no more than
    FIT_CHARS characters, FIT_DOCS of each class; the bias is then set back to the classes' shares among all training labels."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)").filter(~held_out("id"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    rows = docs.filter(~held_out(doc_id)).select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.length("text") <= FIT_CHARS)
    # ids are sampled first and few enough to broadcast, so texts never travel to their labels
    usable = known.join(rows.select("id").distinct(), "id")
    few = F.broadcast(bounded_sample(usable, "y", "id", FIT_DOCS).dropDuplicates(["id"]))
    got = _passages_of(rows.join(few, "id").dropDuplicates(["id"]).orderBy("id")).toArrow()
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in got["x"].to_pylist()]
    y = got["y"].to_numpy().astype(np.float64)
    if not bags:
        return train(np.zeros((0, WIDTH)), np.zeros(1, np.int64), y)
    m = train(np.concatenate(bags), np.cumsum([0, *map(len, bags)]), y)
    if 0 < y.mean() < 1:
        odds = lambda s: np.log(s / (1 - s))
        m.params["r"] = m.params["r"] + odds(counts[1] / (counts[0] + counts[1])) - odds(y.mean())
    return m


def score(docs: DataFrame, model: Attention, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores every whole text: (doc_id, held_out, score, predicted), a row per row of docs.

    A null, empty or blank text is a bag of one empty passage.  A null id counts as held
    out.  Repeated rows give repeated scores; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Attention(shared.value)
        for batch in batches:
            buf, off = buffers(column_of(batch, "text"))
            parts = [m.predict(*passages(buf[off[a] : off[b]], off[a : b + 1] - off[a])) for a, b in steps(off)]
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "score"])

    done = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).transform(map_arrow, run, "doc_id long, score double")
    return done.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
