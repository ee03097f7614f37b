"""SimHash near-duplicates: fingerprints, bit-sliced comparison, components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import checkpoint, map_arrow, row_key
from ._text import buffers, column_of, steps
from .bitsliced import fingerprints, forest
from .components import star_components
from .keep import first_of_each

#: A key of more distinct fingerprints than this is split by sub-keys of its remaining bits.
SPLIT_ABOVE = 1024


def _cuts(lo: int, hi: int, parts: int) -> list[tuple[int, int]]:
    edge = [lo + (hi - lo) * i // parts for i in range(parts + 1)]
    return list(zip(edge, edge[1:], strict=False))


def _masks(bits: list[int], parts: int, agree: int) -> list[int]:
    """One mask for each choice of ``agree`` of ``parts`` equal shares of these bit numbers."""
    shares = [sum(1 << bits[i] for i in range(a, b)) for a, b in _cuts(0, len(bits), parts)]
    return [sum(c) for c in itertools.combinations(shares, agree)]


def band_masks(radius: int) -> list[int]:
    """Masks of which any two fingerprints within the radius agree under one at least:
    of radius + 3 shares of the 64 bits at most ``radius`` can differ, so 3 agree."""
    return _masks(list(range(64)), radius + 3, 3)


def sub_masks(mask: int, radius: int) -> list[int]:
    """The same again over the bits that a mask leaves open."""
    return _masks([b for b in range(64) if not mask >> b & 1], radius + 3, 3)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_docs(docs: DataFrame, doc_id: str, text: str, shingle: int, keys: bool = False) -> DataFrame:
    """(doc_id, fp): one row per row of docs; with ``keys`` also k1 and k2, which name the row."""
    names = ["k1", "k2"] * keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = buffers(column_of(batch, "text"))
            parts = [fingerprints(buf[off[a] : off[b]], off[a : b + 1] - off[a], shingle) for a, b in steps(off)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*(column_of(batch, c) for c in (*names, "doc_id")), pa.array(fp.view(np.int64))], names=[*names, "doc_id", "fp"])

    base = docs.select(*row_key(doc_id, text)[: len(names)], F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return base.transform(map_arrow, run, "k1 long, k2 long, " * keys + "doc_id long, fp long")


#: Fingerprints, of many keys together, that one bit-sliced comparison holds; always whole keys.
PACK = 1 << 15


def _bucket_links(radius: int):
    """Rows (k, m, j, fp), sorted, to links: whole keys are packed into the planes of one comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(fps: list[np.ndarray], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            found = forest(np.concatenate(fps).view(np.uint64), radius, np.concatenate(keys)) if fps else []
            if found:
                a = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

        fps, keys, held, number, last = [], [], 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [column_of(batch, c).to_numpy() for c in ("k", "m", "j", "fp")]
            new = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:3]])
            opens = tuple(int(c[0]) for c in cols[:3]) != last
            last = tuple(int(c[-1]) for c in cols[:3])
            of = number + np.concatenate([[int(opens)], new]).cumsum()
            number = int(of[-1])
            fps.append(cols[3])
            keys.append(of)
            held += len(of)
            if held >= PACK:  # the last key may go on in the next batch
                flat, name = np.concatenate(fps), np.concatenate(keys)
                cut = int(np.searchsorted(name, number))
                yield from links([flat[:cut]], [name[:cut]]) if cut else ()
                fps, keys, held = [flat[cut:]], [name[cut:]], len(flat) - cut
        yield from links(fps, keys)

    return run


def fingerprint_links(fps: DataFrame, radius: int, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """``fps(fp)``, distinct, to links (a, b) that span its classes.

    Fingerprints meet under each of the masks of :func:`band_masks`.  A key that more than
    ``split_above`` share is dealt out again by :func:`sub_masks` of its open bits, which
    again loses no pair; such a sub-key leaves ten open bits, so 1024 values at most.
    """
    masks = band_masks(radius)
    by_mask = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("k")) for i, x in enumerate(masks)])
    keyed = fps.select("fp", F.explode(by_mask).alias("x")).select("fp", "x.m", "x.k")
    counts = keyed.groupBy("m", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = keyed.join(counts, ["m", "k"])
    cold = shared.filter(F.col("n") <= split_above).select("k", "m", F.lit(-1).alias("j"), "fp")
    subs = F.array(*[F.array(*[F.lit(_signed(x | y)) for y in sub_masks(x, radius)]) for x in masks])
    hot = (
        shared.filter(F.col("n") > split_above)
        .select("m", "fp", F.posexplode(F.element_at(subs, F.col("m") + 1)).alias("j", "mask"))
        .select(F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "m", "j", "fp")
    )
    deal = cold.unionByName(hot)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return deal.repartition(n, "k", "m", "j").sortWithinPartitions("k", "m", "j", "fp").transform(map_arrow, _bucket_links(radius), "a long, b long")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Near-duplicate classes of whole texts: (doc_id, fingerprint, component_id), a row per row of docs.

    A-Z is lower-cased, words are runs without ASCII white space, shingles of ``shingle``
    words (all words, if fewer) are hashed by XXH64 with seed 42 and a bit is set if set in
    over half the hashes.  Documents whose fingerprints differ in ``radius`` bits or fewer
    are linked; component_id is the smallest doc_id reachable.

    Null, empty and blank texts have the fingerprint zero and are linked like any other.  A
    null doc_id keeps its row; it never becomes a component_id unless the whole component
    has no other.  Repeated rows give repeated results.  Further columns are ignored,
    whatever their names.  Equal fingerprints are collapsed before any comparison, so a
    group of copies costs one fingerprint.
    """
    prints = checkpoint(fingerprint_docs(docs, doc_id, text, shingle))
    of = _classes(prints, radius, split_above).select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _classes(prints: DataFrame, radius: int, split_above: int) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint."""
    least = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = star_components(fingerprint_links(least.select("fp"), radius, split_above))
    named = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return checkpoint(named.join(first, "root").select("fp", "root", "component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """docs with exactly one row of each class of :func:`simhash_groups`: see :func:`.keep.first_of_each`."""
    prints = checkpoint(fingerprint_docs(docs, doc_id, text, shingle, keys=True))
    of = _classes(prints, radius, SPLIT_ABOVE)
    rows = prints.join(of, "fp").select("k1", "k2", F.col("doc_id").alias("id"), "root")
    return first_of_each(docs, rows, doc_id, text)
