"""Repeated windows of a corpus: sieve, deal by anchor, solve per anchor, bring back.

1. *Sketch.*  Each batch of texts (a *slice*) deals its windows into segments by their anchors
   (see sieve.py) and keeps a line per distinct anchor: how many segments, how many distinct
   ones, the digest of one of them.  Lines travel in packed blocks, a block for each
   bucket of anchors, so a hot anchor costs a line per slice however often it occurs.
2. *Verdict.*  A bucket adds up its anchors.  One found once is dropped: it holds no repeat.
   One whose segments are all equal is *settled*: every window of them repeats.  The others
   are *open*; those of more than ``hot`` distinct segments (a line in very many contexts)
   are *hot*.  Codes go back to the slices, and from them to the texts.
3. *Solve.*  Open segments are dealt by anchor, equal ones of a batch as one with a weight,
   and a kernel finds the repeated window starts among all segments of an anchor.
4. A hot anchor isn't gathered into one task: its windows are counted by two 61-bit hashes, in
   the same packed blocks as the anchors were, a line per slice and distinct window, and
   the codes come back the same way.  No window is left out either way.
5. All marks return to the texts through joins that adaptive execution can split.

What is held to be equal without a look at its units is so by 128 bits of BLAKE2b (segments),
or by polynomials modulo a prime at bases drawn at random for each run (windows of hot
anchors): no text can be written that collides, and chance does less than once in 2**90.

Texts must come from a source that yields the same rows when a task is run again, such as a
table; then a lost executor costs only its own tasks.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import map_arrow, rest_of_row, row_key, scratch
from ._text import U64, Secret, buffers, column_of, digests, repeat_ranges, steps
from .sieve import runs_of_texts

#: Distinct segments of one anchor that are solved in one task; more are counted by digest.
HOT = 512
#: Units that a kernel solves at a time; always whole anchors.
GROUP = 1 << 18
#: Buckets of anchors to a shuffle partition.
BUCKETS = 4
#: Units of hot segments that are hashed at a time.
HASHED = 1 << 17
#: Shares of the slices; a kernel that merges sees each as a shard.
SHARDS = 4
DROPPED, SETTLED, OPEN, HOTTER = 0, 1, 2, 3

BLOCK = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("base", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
BLOCK_DDL = "bucket int, slice long, base int, a binary, b binary, c binary"


def _all_runs(kind, window: int, gram: int, buf: np.ndarray, off: np.ndarray, digest: bool = True):
    """The runs of a batch in text order, and how many each text has."""
    parts = [r for r in runs_of_texts(buf, off, kind, window, gram, digest=digest) if len(r.lo)]
    if not parts:
        return None, np.zeros(len(off) - 1, np.int64)
    r = type(parts[0])(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    return r, np.bincount(r.doc, minlength=len(off) - 1)


def _blocks(v: np.ndarray, d: np.ndarray, packed: np.ndarray, line: np.ndarray, keys: bytes, count: np.ndarray, buckets: int, tail: bytes = b"") -> list[tuple]:
    """Rows of BLOCK for one slice: for each bucket its lines' keys (a), digests of one or two
    words (b) and counts (c); and a directory (base -1): the texts' keys (a), their numbers of items (b), and
    each item's line (c), with whatever ``tail`` the reader wants back."""
    name = xxhash.xxh64_intdigest(keys + count.tobytes()) >> 1
    bucket = (v >> U64(40)) % U64(buckets)
    deal = np.argsort(bucket, kind="stable")
    place = np.empty(len(v), np.uint32)
    place[deal] = np.arange(len(v))
    b = bucket[deal]
    at = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1])
    end = np.concatenate([at[1:], [len(b)]])
    v, d, packed = v[deal], d[deal], packed[deal]
    rows = [(int(b[x]), name, int(x), v[x:y].tobytes(), d[x:y].tobytes(), packed[x:y].tobytes()) for x, y in zip(at.tolist(), end.tolist(), strict=True)]
    rows.append((name % buckets, name, -1, keys, count.astype(np.int64).tobytes(), place[line].tobytes() + tail))
    return rows


#: Bits of a line's count: distinct segments in 14, found twice or more in the slice, may repeat within itself.
FORMS, TWICE, WITHIN = 16383, 14, 15


def _sketch(kind, window: int, gram: int, buckets: int):
    """A slice's anchors in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (column_of(batch, k).to_numpy() for k in ("k1", "k2"))
            r, count = _all_runs(kind, window, gram, *buffers(column_of(batch, "text")))
            if r is None:
                continue
            order = np.lexsort((r.digest[:, 1], r.digest[:, 0], r.anchor))
            v, d, many = r.anchor[order], r.digest[order], r.many[order]
            new = np.concatenate([[True], v[1:] != v[:-1]])
            first = np.flatnonzero(new)
            line = np.empty(len(v), np.uint32)
            line[order] = np.cumsum(new) - 1
            n = np.diff(np.concatenate([first, [len(v)]]))
            forms = np.add.reduceat(np.concatenate([[True], (d[1:] != d[:-1]).any(axis=1) | new[1:]]).astype(np.int64), first)
            some = np.logical_or.reduceat(many, first)
            packed = (np.minimum(forms, FORMS) | ((n > 1) | some).astype(np.int64) << TWICE | some.astype(np.int64) << WITHIN).astype(np.uint16)
            rows = _blocks(v[first], d[first], packed, line, np.concatenate([k1, k2]).tobytes(), count, buckets)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), BLOCK, strict=True)], schema=BLOCK)

    return run


def _anchor_codes(hot: int):
    def codes(v: np.ndarray, d: np.ndarray, c: np.ndarray) -> np.ndarray:
        order = np.lexsort((d[:, 1], d[:, 0], v))
        v, d, c = v[order], d[order], c[order]
        new = np.concatenate([[True], v[1:] != v[:-1]])
        first = np.flatnonzero(new)
        lines = np.diff(np.concatenate([first, [len(v)]]))
        found = (lines > 1) | np.logical_or.reduceat(c >> TWICE & 1 > 0, first)
        # distinct digests of the lines, and what lines have beside theirs: as many forms at most
        other = np.concatenate([[True], (d[1:] != d[:-1]).any(axis=1)]) | new
        forms = np.add.reduceat(other.astype(np.int64) + (c & FORMS) - 1, first)
        several = (forms > 1) | np.logical_or.reduceat(c >> WITHIN > 0, first)
        code = np.where(~found, DROPPED, np.where(~several, SETTLED, np.where(forms <= hot, OPEN, HOTTER)))
        out = np.empty(len(v), np.uint8)
        out[order] = np.repeat(code, lines)
        return out

    return codes


def _window_codes(g: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """1 for windows found twice or more, by both hashes."""
    h = h[:, 0]
    order = np.lexsort((h, g))
    g, h, c = g[order], h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])]))
    lines = np.diff(np.concatenate([first, [len(g)]]))
    found = (lines > 1) | np.logical_or.reduceat(c >> TWICE & 1 > 0, first)
    out = np.empty(len(g), np.uint8)
    out[order] = np.repeat(found, lines)
    return out


def _verdicts(codes_of: Callable):
    """Per bucket: a code for each line of each block; directories pass through."""

    def judge(blocks: list[tuple]) -> Iterator[pa.RecordBatch]:
        v = np.concatenate([np.frombuffer(x[3], U64) for x in blocks])
        d = np.concatenate([np.frombuffer(x[4], U64).reshape(len(x[3]) // 8, -1) for x in blocks])
        c = np.concatenate([np.frombuffer(x[5], np.uint16) for x in blocks]).astype(np.int64)
        codes = codes_of(v, d, c)
        at = 0
        for x in blocks:
            n = len(x[3]) // 8
            mine = codes[at : at + n]
            at += n
            if mine.any():
                yield pa.RecordBatch.from_arrays([pa.array([y], t.type) for y, t in zip((x[0], x[1], x[2], mine.tobytes(), None, None), BLOCK, strict=True)], schema=BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                x = tuple(batch.column(j)[i].as_py() for j in range(6))
                if x[2] < 0:
                    yield batch.slice(i, 1)
                    continue
                if held and held[0][0] != x[0]:
                    yield from judge(held)
                    held = []
                held.append(x)
        if held:
            yield from judge(held)

    return run


def _of_slices(out: Callable[[dict], Iterator[pa.RecordBatch]]):
    """Per slice: its directory, which comes first, and its codes, gathered for ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                name, base = column_of(batch, "slice")[i].as_py(), column_of(batch, "base")[i].as_py()
                if base < 0:
                    if state and state["codes"].any():
                        yield from out(state)
                    a, b, c = (column_of(batch, x)[i].as_py() for x in "abc")
                    keys, count = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                    n, items = len(keys) // 2, int(count.sum())
                    line = np.frombuffer(c, np.uint32, items)
                    state = {"name": name, "k1": keys[:n], "k2": keys[n:], "count": count, "line": line, "tail": c[4 * items :], "codes": np.zeros(int(line.max()) + 1, np.uint8)}
                else:
                    if not state or state["name"] != name:
                        raise RuntimeError("a slice's directory is missing: the texts' source is not repeatable")
                    got = np.frombuffer(column_of(batch, "a")[i].as_py(), np.uint8)
                    state["codes"][base : base + len(got)] = got
        if state and state["codes"].any():
            yield from out(state)

    return run


def _items(state: dict):
    """Each item's code, and the texts that have any with the bounds of their items."""
    code = state["codes"][state["line"]]
    at = np.concatenate([[0], np.cumsum(state["count"])])
    total = np.concatenate([[0], np.cumsum(code > 0)])
    some = np.flatnonzero(total[at[1:]] > total[at[:-1]])
    return code, some, list(zip(at[some].tolist(), at[some + 1].tolist(), strict=True))


def _codes_of_texts(state: dict) -> Iterator[pa.RecordBatch]:
    code, some, bounds = _items(state)
    yield pa.RecordBatch.from_arrays([pa.array(state["k1"][some]), pa.array(state["k2"][some]), pa.array([code[a:b].tobytes() for a, b in bounds], pa.binary())], names=["k1", "k2", "codes"])


def _marks_of_windows(state: dict) -> Iterator[pa.RecordBatch]:
    """A text's repeated windows as int32 pairs of starts; the directory's tail has where each window is."""
    code, some, bounds = _items(state)
    at = np.frombuffer(state["tail"], np.int32)
    raw = [np.repeat(at[a:b][code[a:b] > 0], 2).tobytes() for a, b in bounds]
    yield pa.RecordBatch.from_arrays([pa.array(state["k1"][some]), pa.array(state["k2"][some]), pa.array(raw, pa.binary())], names=["k1", "k2", "mark"])


#: What a text has to say once its codes are known, by ``kind``.
MARKS, PLACE, SEGMENT, WINDOWS = 0, 1, 2, 3
SAID = pa.schema([("kind", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int32()), ("v", pa.int64()), ("d", pa.int64()), ("e", pa.int64()), ("n", pa.int64()), ("starts", pa.int32()), ("units", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
SAID_DDL = "kind int, k1 long, k2 long, lo int, v long, d long, e long, n long, starts int, units binary, b binary, c binary"


def _say(kind, window: int, gram: int, buckets: int, bases: tuple[int, int]):
    """MARKS: a text's settled ranges of starts (units: int32 pairs).  PLACE: where an open
    segment is, by its anchor and digest.  SEGMENT: an open segment's units, once a batch, n times
    found in it, with the batch's shard as lo.  WINDOWS: a batch's windows of hot segments in blocks (n: bucket, v: slice, lo: base)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (column_of(batch, k).to_numpy() for k in ("k1", "k2"))
            buf, off = buffers(column_of(batch, "text"))
            code = np.frombuffer(b"".join(column_of(batch, "codes").to_pylist()), np.uint8)
            seen, heat, shard = 0, [], xxhash.xxh64_intdigest(k2.tobytes()) % SHARDS
            for a, b in steps(off):
                part, po = buf[off[a] : off[b]], off[a : b + 1] - off[a]
                r, count = _all_runs(kind, window, gram, part, po, digest=False)
                n = int(count.sum())
                if not n:
                    continue
                c, seen = code[seen : seen + n], seen + n
                units, uo = kind.of(part, po)
                out: list[tuple] = []
                x1, x2 = k1[a:b][r.doc], k2[a:b][r.doc]
                v = r.anchor.view(np.int64)
                at = np.flatnonzero(c == SETTLED)
                if len(at):
                    cut = np.flatnonzero(np.diff(r.doc[at])) + 1
                    for g in np.split(at, cut):
                        pairs = np.stack([r.lo[g], r.hi[g]], axis=1).astype(np.int32)
                        out.append((MARKS, x1[g[0]], x2[g[0]], 0, 0, 0, 0, 0, 0, pairs.tobytes(), None, None))
                at = np.flatnonzero(c == OPEN)
                if len(at):
                    many = (r.hi[at] - r.lo[at] + 1).tolist()
                    begin = uo[r.doc[at]] + r.lo[at]
                    end, wide = begin + np.array(many) + window - 1, units.itemsize
                    said = digests(units.tobytes(), (begin * wide).tolist(), (end * wide).tolist()).view(np.int64)
                    out += zip([PLACE] * len(at), x1[at].tolist(), x2[at].tolist(), r.lo[at].tolist(), v[at].tolist(), said[:, 0].tolist(), said[:, 1].tolist(), [1] * len(at), many, *[[None] * len(at)] * 3, strict=True)
                    _, one, times = np.unique(np.column_stack([v[at], said]), axis=0, return_index=True, return_counts=True)
                    for i, t in zip(one.tolist(), times.tolist(), strict=True):
                        out.append((SEGMENT, 0, 0, shard, v[at[i]], said[i, 0], said[i, 1], t, many[i], units[begin[i] : end[i]].tobytes(), None, None))
                at = np.flatnonzero(c == HOTTER)
                if len(at):
                    many = (r.hi[at] - r.lo[at] + 1).astype(np.int64)
                    begin, wide = uo[r.doc[at]] + r.lo[at], many + window - 1
                    cut = np.searchsorted(np.cumsum(wide), np.arange(0, int(wide.sum()), HASHED)).tolist()
                    for i, j in zip(cut, [*cut[1:], len(at)], strict=True):  # some segments at a time, as hashing takes room
                        if i == j:
                            continue
                        piece, first = kind.hashed(units[repeat_ranges(begin[i:j], wide[i:j])]), np.cumsum(wide[i:j]) - wide[i:j]
                        x = repeat_ranges(first, many[i:j])
                        g, h = (Secret(piece, base).of(x, x + window) for base in bases)
                        heat.append((np.repeat(r.doc[at[i:j]] + a, many[i:j]), repeat_ranges(r.lo[at[i:j]], many[i:j]).astype(np.int32), g, h))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(col, t.type) for col, t in zip(zip(*out, strict=True), SAID, strict=True)], schema=SAID)
            if heat:
                text, w, g, h = (np.concatenate(x) for x in zip(*heat, strict=True))
                order = np.lexsort((h, g))
                new = np.concatenate([[True], (g[order][1:] != g[order][:-1]) | (h[order][1:] != h[order][:-1])])
                first = np.flatnonzero(new)
                line = np.empty(len(g), np.uint32)
                line[order] = np.cumsum(new) - 1
                packed = (1 | (np.diff(np.concatenate([first, [len(g)]])) > 1).astype(np.int64) << TWICE).astype(np.uint16)
                some, count = np.unique(text, return_counts=True)
                rows = _blocks(g[order][first], h[order][first, None], packed, line, np.concatenate([k1[some], k2[some]]).tobytes(), count, buckets, w.tobytes())
                out = [(WINDOWS, 0, 0, base, name, 0, 0, bucket, 0, x, y, z) for bucket, name, base, x, y, z in rows]
                yield pa.RecordBatch.from_arrays([pa.array(col, t.type) for col, t in zip(zip(*out, strict=True), SAID, strict=True)], schema=SAID)

    return run


def _intervals(hit: np.ndarray) -> list[int]:
    """Inclusive ranges of true, flattened: first, last, first, last, ..."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1).ravel().tolist()


def _solve(kind, window: int, kernel: Callable):
    """Rows (v, d, e, n, starts, units, shard), sorted by v, d and e, to the repeated starts of each (v, d, e)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            hits = kernel([np.frombuffer(r[5], kind.dtype) for r in rows], [r[4] for r in rows], [r[3] for r in rows], window, [r[6] for r in rows])
            found = [(*r[:3], _intervals(h)) for r, h in zip(rows, hits, strict=True) if h.any()]
            if found:
                *key, c = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in key), pa.array(c, pa.list_(pa.int32()))], names=["v", "d", "e", "hits"])

        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if rows and rows[-1][:3] == list(r[:3]):
                    rows[-1][3] += r[3]
                    continue
                if rows and rows[-1][0] != r[0] and held >= GROUP:
                    yield from out()
                    rows, held = [], 0
                rows.append(list(r))
                held += len(r[5]) // np.dtype(kind.dtype).itemsize
        if rows:
            yield from out()

    return run


def _marked(kind, window: int, finish, out_schema: pa.Schema):
    """Of each text with its marks (int32 pairs, ranges of starts): what is removed and what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [b"".join(x or ()) for x in column_of(batch, "marks").to_pylist()]
            pairs = np.array([len(m) // 8 for m in marks], np.int64)
            edge = np.frombuffer(b"".join(marks), np.int32).astype(np.int64)
            text = np.repeat(np.arange(len(marks)), pairs)
            first, end = edge[0::2], edge[1::2] + window
            buf, off = buffers(column_of(batch, "text"))
            for a, b in steps(off):
                part, po = buf[off[a] : off[b]], off[a : b + 1] - off[a]
                gone, uo, extra = finish.units(part, po)
                x, y = np.searchsorted(text, [a, b])
                base = uo[text[x:y] - a]
                delta = np.zeros(len(gone) + 1, np.int32)
                np.add.at(delta, first[x:y] + base, 1)
                np.add.at(delta, end[x:y] + base, -1)
                gone = np.cumsum(delta[:-1]) > 0
                cols = finish.columns(part, po, gone, uo, extra)
                yield pa.RecordBatch.from_arrays([column_of(batch, "row").slice(a, b - a), *cols], names=["row", *out_schema.names])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, lo, hits) to (k1, k2, mark): int32 pairs of starts in the text."""
    for batch in batches:
        lo = column_of(batch, "lo").to_pylist()
        raw = [(np.array(h, np.int32) + np.int32(s)).tobytes() for h, s in zip(column_of(batch, "hits").to_pylist(), lo, strict=True)]
        yield pa.RecordBatch.from_arrays([column_of(batch, "k1"), column_of(batch, "k2"), pa.array(raw, pa.binary())], names=["k1", "k2", "mark"])


def remove_repeats(docs: DataFrame, kind, window: int, gram: int, kernel: Callable, finish, doc_id: str, text: str, hot: int = HOT) -> DataFrame:
    """``docs`` but the text as struct column ``row``, and the columns of ``finish``, a row per row of docs.

    Every unit covered by a window whose unit sequence also starts elsewhere is removed.
    """
    spark = docs.sparkSession
    if not 1 <= gram <= window:
        raise ValueError("the gram must be no longer than the window")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    secret = os.urandom(32)
    kind, bases = kind(secret[:16]), (int.from_bytes(secret[16:24], "little"), int.from_bytes(secret[24:], "little"))
    k1, k2 = row_key(doc_id, text)
    base = docs.select(k1, k2, F.col(text).cast("string").alias("text"), rest_of_row(docs, text))
    bare = base.select("k1", "k2", "text")

    def verdicts(blocks: DataFrame, codes_of: Callable, out: Callable, ddl: str) -> DataFrame:
        judged = blocks.repartition(parts, "bucket").sortWithinPartitions("bucket").transform(map_arrow, _verdicts(codes_of), BLOCK_DDL)
        return judged.repartition(parts, "slice").sortWithinPartitions("slice", "base").transform(map_arrow, _of_slices(out), ddl)

    codes = verdicts(bare.transform(map_arrow, _sketch(kind, window, gram, BUCKETS * parts), BLOCK_DDL), _anchor_codes(hot), _codes_of_texts, "k1 long, k2 long, codes binary")

    folder = scratch(spark, "repeats")
    bare.join(codes.dropDuplicates(["k1", "k2"]).hint("shuffle_hash"), ["k1", "k2"]).transform(map_arrow, _say(kind, window, gram, BUCKETS * parts, bases), SAID_DDL).write.partitionBy("kind").parquet(folder)
    said = spark.read.schema(SAID_DDL).parquet(folder)

    segments = said.filter(F.col("kind") == SEGMENT).select("v", "d", "e", "n", "starts", "units", F.col("lo").alias("shard"))
    solved = segments.repartition(parts, "v").sortWithinPartitions("v", "d", "e").transform(map_arrow, _solve(kind, window, kernel), "v long, d long, e long, hits array<int>")
    places = said.filter(F.col("kind") == PLACE).select("k1", "k2", "lo", "v", "d", "e")
    opened = places.join(solved, ["v", "d", "e"]).select("k1", "k2", "lo", "hits").transform(map_arrow, _packed, "k1 long, k2 long, mark binary")

    windows = said.filter(F.col("kind") == WINDOWS).select(F.col("n").cast("int").alias("bucket"), F.col("v").alias("slice"), F.col("lo").alias("base"), F.col("units").alias("a"), "b", "c")
    heated = verdicts(windows, _window_codes, _marks_of_windows, "k1 long, k2 long, mark binary")

    marks = said.filter(F.col("kind") == MARKS).select("k1", "k2", F.col("units").alias("mark")).unionByName(opened).unionByName(heated)
    per_text = marks.groupBy("k1", "k2").agg(F.collect_list("mark").alias("marks"))
    marked = base.join(per_text.hint("shuffle_hash"), ["k1", "k2"], "left").select("row", "text", "marks")
    return marked.transform(map_arrow, _marked(kind, window, finish, finish.schema), f"row {base.schema['row'].dataType.simpleString()}, {finish.ddl}")


class ByteFinish:
    """Spans and remaining bytes."""

    schema = pa.schema([("n_units", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])
    ddl = "n_units long, n_removed long, spans array<long>, kept binary"

    @staticmethod
    def units(buf: np.ndarray, off: np.ndarray):
        return np.zeros(len(buf), bool), off, None

    @staticmethod
    def columns(buf, off, gone, uo, extra) -> list[pa.Array]:
        n, removed, spans, kept = [], [], [], []
        for a, b in zip(uo[:-1].tolist(), uo[1:].tolist(), strict=True):
            g = gone[a:b]
            n.append(b - a)
            removed.append(int(g.sum()))
            spans.append([x + i % 2 for i, x in enumerate(_intervals(g))] if removed[-1] else [])
            kept.append((buf[a:b][~g] if removed[-1] else buf[a:b]).tobytes())
        return [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())]


class WordFinish:
    """Spans of words and the remaining words joined by one space."""

    schema = pa.schema([("n_units", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.string())])
    ddl = "n_units long, n_removed long, spans array<long>, kept string"

    @staticmethod
    def units(buf: np.ndarray, off: np.ndarray):
        from ._text import words

        ws, we, wo = words(buf, off)
        return np.zeros(len(ws), bool), wo, (ws, we)

    @staticmethod
    def columns(buf, off, gone, uo, extra) -> list[pa.Array]:
        ws, we = extra
        keep = ~gone
        size = we[keep] - ws[keep]
        at = np.concatenate([[0], np.cumsum(size + 1)])
        joined = np.full(int(at[-1]), 32, np.uint8)
        joined[repeat_ranges(at[:-1], size)] = buf[repeat_ranges(ws[keep], size)]
        before = np.concatenate([[0], np.cumsum(keep)])[uo]
        n, removed, spans, kept = [], [], [], []
        for a, b, x, y in zip(uo[:-1].tolist(), uo[1:].tolist(), before[:-1].tolist(), before[1:].tolist(), strict=True):
            n.append(b - a)
            removed.append(b - a - (y - x))
            spans.append([p + i % 2 for i, p in enumerate(_intervals(gone[a:b]))] if removed[-1] else [])
            kept.append(joined[at[x] : at[y] - 1].tobytes().decode() if y > x else "")
        return [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.string())]
