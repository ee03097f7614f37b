"""Suffix-array dedup over bytes by merging shard Burrows-Wheeler transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt
from .repeats import HOT, ByteFinish, remove_repeats
from .sieve import Bytes

WINDOW, GRAM = 200, 64


def remove_repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Removes each byte covered by a string of ``window`` bytes that also starts anywhere else.

    Returns (row, n_units, n_removed, spans, kept), a row per row of docs: ``row`` is the
    row but its text as a struct (so no column name can clash), spans the maximal removed byte
    ranges [start, end, ...], kept the remaining bytes (a cut may split a character).
    Matches never cross documents and are judged on the input.  Null, empty and short texts
    lose nothing.  Rows with a null or repeated id are documents like any other: repeated
    rows are copies of each other.
    """
    return remove_repeats(docs, Bytes, window, gram, bwt.repeated_starts, ByteFinish, doc_id, text, hot)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """docs with the repeated bytes taken out of ``text`` and ``n_chars`` brought up to date.

    Bytes of a character that a cut has split are dropped (and with them, in a text that is
    cut, any U+FFFD).  Texts that lose nothing stay as they are, null ones null; a document of
    which only white space is left goes.
    """
    flag = "text_was_null"  # tells null texts from empty ones while their bytes are away
    while flag in docs.columns:
        flag += "_"
    flagged = docs.withColumn(flag, F.col(text).isNull())
    done = remove_repeated_bytes(flagged, doc_id, text, window)
    whole = F.col("n_removed") == 0
    raw = F.col("kept").cast("string")
    left = F.when(whole, F.when(~F.col(f"row.{flag}"), raw)).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit("")))

    def value(c: str):
        if c == text:
            return F.col("left")
        if c == n_chars:
            return F.when(whole, F.col(f"row.`{c}`")).otherwise(F.char_length("left").cast("long"))
        return F.col(f"row.`{c}`")

    return done.withColumn("left", left).filter(whole | (F.trim("left") != "")).select(*[value(c).alias(c) for c in docs.columns])
