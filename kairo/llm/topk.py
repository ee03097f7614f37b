"""Exact top-k inner products by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import map_arrow
from ._text import column_of

#: Candidates and queries of one task's score array: 4096 x 512 longs are 16 MB.
CANDIDATES, QUERIES = 4096, 512
#: Scores are kept in 64-bit integers while no sum can pass this; exact integers otherwise.
SAFE = 1 << 62


def quantise(vector: str, scale: int = 256):
    """floor(scale * x) of each component, x as double, as array<bigint>; beyond 64 bits an error."""

    def whole(x):
        v = x.cast("double") * F.lit(float(scale))
        return F.when((v >= -(2.0**63)) & (v < 2.0**63), F.floor(v)).otherwise(F.raise_error(F.lit("a component passes 64 bits")).cast("bigint"))

    return F.transform(F.col(vector), whole)


def usable(vector: str):
    """True for vectors without null or non-finite components that aren't null themselves."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


class Postings:
    """An inverted index of a block: for each term the rows that have it, with weights."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        size = np.array([len(r) for r in rows], np.int64)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        row = np.repeat(np.arange(self.n), size)
        term = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        has = flat != 0
        row, term, flat = row[has], term[has], flat[has]
        order = np.argsort(term, kind="stable")
        self.row, self.weight = row[order], flat[order]
        self.at = np.searchsorted(term[order], np.arange(int(size.max(initial=0)) + 1))
        self.most = int(np.abs(flat).max(initial=0))

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        """(queries, rows): every query term scatters its weighted postings into a dense array."""
        terms = len(self.at) - 1
        top = max((int(np.abs(q).max(initial=0)) for q in queries), default=0)
        exact = top * self.most * max(terms, 1) >= SAFE
        out = np.zeros((self.n, len(queries)), object if exact else np.int64)
        width = max((len(q) for q in queries), default=0)
        dense = np.zeros((len(queries), max(width, terms)), np.int64)
        for i, q in enumerate(queries):
            dense[i, : len(q)] = q
        for t in range(terms):
            a, b = self.at[t], self.at[t + 1]
            who = np.flatnonzero(dense[:, t])
            if a == b or not len(who):
                continue
            w, qt = self.weight[a:b], dense[who, t]
            if exact:
                w, qt = w.astype(object), qt.astype(object)
            rows = self.row[a:b]
            if b - a == self.n and len(who) == len(queries):
                out += w[:, None] * qt[None, :]
            else:
                out[np.ix_(rows, who)] += w[:, None] * qt[None, :]
        return out.T


def select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, then smaller id) of one score array, without the query's own rows."""
    ok = ids != own
    scores, ids = scores[ok], ids[ok]
    if len(scores) > k and scores.dtype != object:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= bar
        scores, ids = scores[near], ids[near]
    order = sorted(range(len(scores)), key=lambda i: (-int(scores[i]), int(ids[i])))[:k] if scores.dtype == object else np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _lists(column) -> list[np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, off = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    return np.split(flat.astype(np.int64), np.cumsum(off)[:-1]) if len(off) else []


def _search(k: int):
    def solve(cand: list[pa.Table], query: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if not cand or not query:
            return
        c, q = pa.concat_tables(cand), pa.concat_tables(query)
        ids, qid, qs = c["vec_id"].to_numpy(), q["vec_id"].to_numpy(), _lists(q["vec"])
        for a in range(0, c.num_rows, CANDIDATES):
            part = ids[a : a + CANDIDATES]
            post = Postings(_lists(c["vec"].slice(a, CANDIDATES)))
            for b in range(0, len(qid), QUERIES):
                got = post.scores(qs[b : b + QUERIES])
                rows = [(int(own), int(i), int(s)) for own, line in zip(qid[b : b + QUERIES], got, strict=True) for s, i in zip(*select(line, part, own, k), strict=True)]
                x, y, z = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(z, pa.int64())], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by pair and queries first: one pair's rows are held at a time
        key, cand, query = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            pairs = column_of(batch, "pair").to_numpy()
            cut = [0, *(np.flatnonzero(pairs[1:] != pairs[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cut, cut[1:], strict=False):
                if pairs[a] != key:
                    yield from solve(cand, query)
                    key, cand, query = pairs[a], [], []
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                is_query = part["is_query"]
                for side, keep in ((query, is_query), (cand, pc.invert(is_query))):
                    if (t := part.filter(keep)).num_rows:
                        side.append(t)
        yield from solve(cand, query)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "vec", candidates_per_block: int = CANDIDATES, queries_per_block: int = QUERIES) -> DataFrame:
    """Each query's k best candidates: (query_id, rank, vec_id, score).

    ``vector`` holds integers.  Candidates and queries are dealt into blocks of bounded
    expected size by a hash of their ids; every query block meets every candidate block
    once, which is the work asked for, and each meeting yields k rows per query.  A
    query's own row is any row with its id.  Ties go to the smaller id.  Vectors of unequal
    length are padded with zeros.  Rows with a null id or null vector take no part.
    Repeated rows are candidates each; as queries they are one, and different vectors of
    one query id answer together.  An empty table gives no rows.  A score beyond 64 bits is
    computed exactly and then fails the task rather than wrapping.
    """
    spark = vectors.sparkSession
    shape = lambda df: df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vec")).dropna()
    c, q = shape(vectors), shape(queries).dropDuplicates(["vec_id", "vec"])
    nc = max(1, -(-c.count() * 5 // (4 * candidates_per_block)))
    nq = max(1, -(-q.count() * 5 // (4 * queries_per_block)))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pair = (F.col("cb") * F.lit(nq) + F.col("qb")).cast("long").alias("pair")
    cand = c.withColumn("cb", F.pmod(F.xxhash64("vec_id"), F.lit(nc))).withColumn("qb", blocks(nq)).select(pair, F.lit(False).alias("is_query"), "vec_id", "vec")
    query = q.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(nq))).withColumn("cb", blocks(nc)).select(pair, F.lit(True).alias("is_query"), "vec_id", "vec")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(nc * nq, 4096))
    best = cand.union(query).repartition(n, "pair").sortWithinPartitions("pair").transform(map_arrow, _search(k), "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
