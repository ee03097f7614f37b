"""Substring dedup over words by level-wise doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import doubling
from .repeats import HOT, WordFinish, remove_repeats
from .sieve import Words

WINDOW, GRAM = 35, 8


def remove_repeated_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Removes each word covered by a ``window`` of words that also starts anywhere else.

    Returns (row, n_units, n_removed, spans, kept), a row per row of docs: ``row`` is the
    row but its text as a struct (so no column name can clash), spans the removed word ranges
    [start, end, ...], kept the remaining words joined by one space.  Words are runs without
    ASCII white space, unchanged.  Windows never cross documents and are judged on the
    input.  Null, empty and short texts lose nothing.  Rows with a null or repeated id are
    documents like any other: repeated rows are copies of each other.
    """
    return remove_repeats(docs, Words, window, gram, doubling.repeated_starts, WordFinish, doc_id, text, hot)
