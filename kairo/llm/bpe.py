"""Byte-level BPE over whole texts, long ones in overlapping chunks.

A text of more than ``chunk`` characters is cut into chunks that overlap.  Chunks are
dealt out and pre-tokenised in parallel, each from its own first character.  Where two
neighbours share a pre-token boundary inside their overlap they have resynchronised: the
pattern never looks back, so from there on both read the same pre-tokens.  The text is
cut at such a boundary and every piece is encoded on its own.  Neighbours that share no
boundary (one pre-token longer than the overlap) are joined and encoded as one piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import map_arrow, row_key
from ._text import column_of, kept

CHUNK, OVERLAP = 16384, 512


class Codec:
    """Encoder and decoder of one rank file and pre-token pattern; no special tokens."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.bytes_of = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self.bytes_of[rank] = token

    def encode(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, disallowed_special=())

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def boundaries(self, text: str, start: int, end: int) -> list[int]:
        """Ends of pre-tokens in (start, end] after which a cut changes nothing.

        A pre-token that ends in white space is passed over, as the pattern's look-ahead
        depends on what follows the space; so is one that reaches the end of the text,
        which may go on.
        """
        n = len(text)
        return [e for m in self.pattern.finditer(text) if start < (e := m.end()) <= end and e < n and not text[e - 1].isspace()]


def codec(ranks: bytes, pattern: str) -> Codec:
    key = (len(ranks), hash(ranks), pattern)
    return kept("codec", key, lambda: Codec(ranks, pattern))


def split(text: str, chunk: int, overlap: int) -> list[str]:
    """Chunks of ``chunk`` characters, each with the first ``overlap`` of the next."""
    return [text[i : i + chunk + overlap] for i in range(0, max(len(text), 1), chunk)]


def _encoded(ranks, pattern: str, decode: bool, keys: tuple[str, ...]):
    names = [*keys, "ids", *["decoded"] * decode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value, pattern)
        for batch in batches:
            held = [column_of(batch, k) for k in keys]
            text, ids, raw, size, at = column_of(batch, "text"), [], [], 0, 0

            def out(end: int) -> pa.RecordBatch:
                cols = [h.slice(at, end - at) for h in held] + [pa.array(ids, pa.binary())] + [pa.array(raw, pa.binary())] * decode  # noqa: B023
                return pa.RecordBatch.from_arrays(cols, names=names)

            for i in range(batch.num_rows):
                got = c.encode(text[i].as_py() or "")
                ids.append(got.astype("<u4").tobytes())
                if decode:
                    raw.append(c.decode(got))
                size += len(ids[-1])
                if size > 8 << 20:
                    yield out(i + 1)
                    ids, raw, size, at = [], [], 0, i + 1
            yield out(batch.num_rows)

    return run


def encode_docs(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", decode: bool = True, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Token ids of whole texts: (doc_id, n_tokens, ids, decoded), a row per row of docs.

    ids is binary, little-endian unsigned 32-bit; decoded is the raw bytes that the ids
    stand for (only if ``decode``).  Null and empty texts have no tokens.  A null doc_id
    keeps its row; repeated rows give repeated results; further columns are ignored.  The
    rank file (about a megabyte, read on the driver) is all that is broadcast.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    k1, k2 = row_key("doc_id", "text")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out_cols = "ids binary" + ", decoded binary" * decode
    is_long = F.coalesce(F.char_length("text") > chunk, F.lit(False))
    short = base.filter(~is_long).transform(map_arrow, _encoded(ranks, pattern, decode, ("doc_id",)), f"doc_id long, {out_cols}")
    long = base.filter(is_long).select("doc_id", "text", k1, k2)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, texts = column_of(batch, "k1"), column_of(batch, "k2"), column_of(batch, "text")
            for i in range(batch.num_rows):
                parts = split(texts[i].as_py(), chunk, overlap)
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.repeat(a[i], n), pa.repeat(b[i], n), pa.array(range(n), pa.int32()), pa.array(parts, pa.string())], names=["k1", "k2", "i", "part"])

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value, pattern)
        for batch in batches:
            head, tail = [], []
            for x in column_of(batch, "part"):
                part = x.as_py()
                ends = c.boundaries(part, 0, len(part))
                head.append([e for e in ends if e <= overlap])
                tail.append([e - chunk for e in ends if e > chunk])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(head, kind), pa.array(tail, kind)], names=[*batch.schema.names, "head", "tail"])

    # rows that are equal are cut alike; one copy of each chunk is enough
    parts = long.select("k1", "k2", "text").transform(map_arrow, cut, "k1 long, k2 long, i int, part string").dropDuplicates(["k1", "k2", "i"])
    marked = parts.transform(map_arrow, pretokenise, "k1 long, k2 long, i int, part string, head array<int>, tail array<int>")
    by = Window.partitionBy("k1", "k2").orderBy("i")
    met = F.array_min(F.array_intersect("tail", F.lead("head").over(by)))
    linked = marked.select("k1", "k2", "i", "part", met.alias("till"), F.lead("i").over(by).isNull().alias("last"))
    linked = linked.withColumn("start", F.lag("till").over(by))
    pieces = linked.select(
        "k1",
        "k2",
        "i",
        F.sum(F.when(F.col("start").isNull(), 0).otherwise(1)).over(by).alias("piece"),
        F.expr(f"substring(part, coalesce(start, 0) + 1, case when last then length(part) when till is null then {chunk} else till + {chunk} end - coalesce(start, 0))").alias("part"),
    )
    whole = pieces.groupBy("k1", "k2", "piece").agg(F.array_sort(F.collect_list(F.struct("i", "part"))).alias("x")).select("k1", "k2", "piece", F.concat_ws("", F.col("x.part")).alias("text"))
    done = whole.transform(map_arrow, _encoded(ranks, pattern, decode, ("k1", "k2", "piece")), f"k1 long, k2 long, piece long, {out_cols}")
    outs = ["ids", *["decoded"] * decode]
    glue = [F.unhex(F.concat_ws("", F.transform(F.col(f"x.{c}"), F.hex))).alias(c) for c in outs]
    per_doc = done.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("piece", *outs))).alias("x")).select("k1", "k2", *glue)
    stitched = long.select("doc_id", "k1", "k2").join(per_doc, ["k1", "k2"]).select("doc_id", "ids", *["decoded"] * decode)
    return short.unionByName(stitched).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", *["decoded"] * decode)
