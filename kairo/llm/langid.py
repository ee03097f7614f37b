"""Language ID by cross-parsing entropy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_sample, held_out, map_arrow, rest_of_row, whole_row
from ._text import NOT_LETTER, buffers, column_of, kept, steps
from .cross_parse import Parser

#: The fit's bounds: documents of a language, characters of a stretch of each, bytes of a language's sample.
FIT_DOCS, FIT_CHARS, FIT_BYTES = 64, 1024, 32768
#: Bytes of samples of all languages together, which share them alike where there are over 16.
FIT_TOTAL = 1 << 19
UNKNOWN = "und"
#: How sharply a lower entropy counts in the score.
SHARPNESS = 6.0


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", learn: Column | None = None) -> dict[str, bytes]:
    """A sample of each language's text, from a bounded hash sample of the labelled rows to learn from.

    FIT_DOCS rows of a language give a stretch of FIT_CHARS characters each (whole texts, if
    shorter), from a place that a hash of the id picks anywhere in the text.
    """
    spare = F.greatest(F.char_length(F.col(text)) - FIT_CHARS + 1, F.lit(1))
    place = (F.pmod(F.xxhash64(F.col(doc_id), F.lit("place")), spare) + 1).cast("int")
    rows = docs.filter(~held_out(doc_id) if learn is None else learn).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.substring(F.col(text), place, F.lit(FIT_CHARS)).alias("text")).filter("lang is not null and text is not null")
    got: dict[str, list] = {}
    for r in bounded_sample(rows, "lang", "id", FIT_DOCS).orderBy("lang", "id", "text").collect():
        got.setdefault(r.lang, []).append(r.text.encode())
    share = min(FIT_BYTES, FIT_TOTAL // max(len(got), 1))
    return {k: b"\n".join(v)[:share] for k, v in got.items()}


def _parser(samples: dict[str, bytes]) -> Parser:
    key = tuple(sorted(samples.items()))
    return kept("parser", key, lambda: Parser(samples))


def _no_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts without a letter.  Only those without an ASCII letter are looked at closely."""
    import regex

    low = (buf < 128) & ~NOT_LETTER[buf]
    seen = np.concatenate([[0], np.cumsum(low)])
    none = seen[off[1:]] == seen[off[:-1]]
    for i in np.flatnonzero(none):
        if regex.search(r"\p{L}", buf[off[i] : off[i + 1]].tobytes().decode()):
            none[i] = False
    return none


def predict(docs: DataFrame, samples: dict[str, bytes], text: str = "text", with_text: bool = False) -> DataFrame:
    """(row, lang_pred, score[, text]), a row per row of docs; ``row`` is the row but its text as a struct."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _parser(shared.value)
        names = np.array([*p.langs, UNKNOWN], object)
        for batch in batches:
            buf, off = buffers(column_of(batch, "text"))
            for a, b in steps(off, 4 << 20):
                part, po = buf[off[a] : off[b]], off[a : b + 1] - off[a]
                none = _no_letter(part, po)
                if p.langs:
                    h = np.maximum(p.entropy(part, po), 1e-9)
                    best = h.argmin(axis=1)
                    weight = (h.min(axis=1, keepdims=True) / h) ** SHARPNESS
                    score = 1 / weight.sum(axis=1)
                else:
                    none[:] = True
                    best, score = np.zeros(b - a, np.int64), np.zeros(b - a)
                best[none], score[none] = len(p.langs), 0.0
                yield pa.RecordBatch.from_arrays([column_of(batch, "row").slice(a, b - a), pa.array(names[best], pa.string()), pa.array(score), *[column_of(batch, "text").slice(a, b - a)] * with_text], names=["row", "lang_pred", "score", "text"][: 3 + with_text])

    base = docs.select(rest_of_row(docs, text), F.col(text).cast("string").alias("text"))
    return base.transform(map_arrow, run, f"row {base.schema['row'].dataType.simpleString()}, lang_pred string, score double" + ", text string" * with_text)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Predicts the language of every whole text: (doc_id, held_out, lang_pred, score).

    Learns from text and non-null lang of rows that aren't held out (crc32 of the id modulo
    5); a null id is held out.  The fit reads a stretch of FIT_CHARS characters of FIT_DOCS
    documents of a language, FIT_BYTES in all and FIT_TOTAL of all languages; every text is
    parsed whole, however long.  The language with the least entropy wins, ties go to the first
    by name; the score is its share of inverse entropies raised to SHARPNESS.  ``und`` with
    score 0 if the text is null or has no letter, or if there is nothing to learn from.
    Repeated rows give repeated results; further columns are ignored.
    """
    done = predict(docs.select(doc_id, text), fit(docs, doc_id, text, lang), text)
    return done.select(F.col(f"row.{doc_id}").alias("doc_id"), held_out(f"row.{doc_id}").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.3) -> DataFrame:
    """docs without those that have no language: ``und``, or a score below ``least``."""
    done = predict(docs, fit(docs, doc_id, text, lang), text, with_text=True)
    return done.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*whole_row(docs, text))
