"""Near copies by SimHash of shingle sets: keys, fingerprints, exact check, components.

Fingerprints within RADIUS bits are looked at first: of two sets of similarity 0.8 about 10 of 64
bits differ.  No radius is sure to hold all such pairs, so those beyond it are looked at
afterwards, if their classes still differ, and a link is what the whole sets say.  Nor do band keys
of so wide a radius tell texts apart, so fingerprints meet by prefix keys: with shingles in
one order for all documents, two sets of n and m shingles and similarity s share one among
the first n - ceil(s n) + 1 of the one and m - ceil(s m) + 1 of the other.  At the first one they
share, what is left of both must hold the s (n + m) / (1 + s) that they have in common, so a
pair counts under a key only if it does.  No pair is lost.  Shingles that many documents have
come last in the order, the most frequent at the very end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import checkpoint, let_go, map_arrow, row_key, written
from ._text import LOWER, Rolling, U64, buffers, column_of, mix, repeat_ranges, steps, word_hashes, words
from .bitsliced import majority
from .bitsliced import pairs as pairs_within
from .components import star_components
from .keep import first_of_each

SHINGLE, FIFTHS = 5, 4
#: Keys of more documents than this are first joined through neighbours, then compared between classes only.
ALL_PAIRS = 16
#: Shingles seen in so many documents' samples come last in the order; which ones are in only costs or saves time.
COMMON, MOST_COMMON, SAMPLE = 12, 400_000, 64
#: Groups of near copies are first linked by bands of minima under so many hash functions each.
BANDS, DEEP = 6, 2
#: What is read of large keys between classes; pairs that a task holds to give each once.
MIXED, HELD_PAIRS = ("t", "n", "node", "p", "fp", "root", "signature"), 1 << 18
#: Differing bits up to which fingerprints count as near; entries of small keys that one bit-sliced comparison holds.
RADIUS, PACK = 20, 1 << 15
#: Bits of the map by which tasks leave out most texts that no pair needs; a wrong hit costs time only.
MAP = 1 << 24
#: Sets that are held against one other in one place.
BESIDE = 128
#: Bits of the signature that pairs are held against before their sets.
SIGNATURE = 2048


def shingle_sets(buf: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one after another, and their offsets.

    A-Z is lower-cased; a text of fewer words is one shingle, one without words has none."""
    low = LOWER[buf]
    ws, we, wo = words(low, off)
    count = np.diff(wo)
    k = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    if not len(ws):
        return np.zeros(0, U64), np.zeros(len(off), np.int64)
    first = repeat_ranges(wo[:-1], k)
    h = Rolling(word_hashes(low, ws, we)).of(first, np.minimum(first + shingle, np.repeat(wo[1:], k)))
    text = np.repeat(np.arange(len(k)), k)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(off)))


def nodes_of(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h + U64(1)), dtype=U64)])
    return mix(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(U64)).view(np.int64)


def prints_of(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The SimHash of each set: the majority of each bit over its shingles; zero without any."""
    return majority(mix(h + U64(5)), np.diff(off)).view(np.int64)


def signatures(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One bit for each shingle: bits that the one set has and the other hasn't are shingles not in common."""
    bits = np.zeros((len(off) - 1, SIGNATURE), np.uint8)
    bits[np.repeat(np.arange(len(off) - 1), np.diff(off)), (mix(h + U64(3)) % U64(SIGNATURE)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def bands(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, BANDS): names of each set's minima, two hash functions to a band; sets of similarity s share a
    band with a chance of s squared.  They only say which pairs to look at first."""
    n = np.diff(off)
    out = np.zeros((len(n), BANDS), np.int64)
    some = np.flatnonzero(n)
    if len(some):
        for b in range(BANDS):
            name = np.full(len(some), b + 1, U64)
            for k in range(DEEP):
                name = mix(name + np.minimum.reduceat(mix(h ^ mix(np.full(1, b * DEEP + k + 11, U64))), off[:-1][some]))
            out[some, b] = name.view(np.int64)
    return out


def _sets(batches: Iterator[pa.RecordBatch], shingle: int):
    for batch in batches:
        buf, off = buffers(column_of(batch, "text"))
        for a, b in steps(off):
            yield batch, a, b, *shingle_sets(buf[off[a] : off[b]], off[a : b + 1] - off[a], shingle)


def _prints(shingle: int):
    def run(batches):
        for batch, a, b, h, off in _sets(batches, shingle):
            kept = [column_of(batch, c).slice(a, b - a) for c in ("k1", "k2", "id")]
            named = pa.FixedSizeListArray.from_arrays(pa.array(bands(h, off).ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(nodes_of(h, off)), pa.array(np.diff(off)), named, pa.array([x.tobytes() for x in signatures(h, off)], pa.binary())], names=["k1", "k2", "id", "node", "n", "bands", "signature"])

    return run


def _some(shingle: int):
    """The least few hashes of each set, for the order."""

    def run(batches):
        for _, _, _, h, off in _sets(batches, shingle):
            some = h[repeat_ranges(off[:-1], np.minimum(np.diff(off), SAMPLE))]
            yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64))], names=["t"])

    return run


def _prefixes(shingle: int, shared):
    def run(batches):
        (common, often), seen = shared.value, set()
        for _, _, _, h, off in _sets(batches, shingle):
            n, node, fp = np.diff(off), nodes_of(h, off), prints_of(h, off)
            fresh = np.array([x not in seen and not seen.add(x) for x in node.tolist()], bool)
            text = np.repeat(np.arange(len(n)), n)
            late = np.zeros(len(h), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                late = np.where(common[at] == h, often[at], 0)
            h = h[np.lexsort((h, late, text))]
            size = np.where(fresh & (n > 0), n - (FIFTHS * n + 4) // 5 + 1, 0)
            place = repeat_ranges(np.zeros(len(n), np.int64), size)
            yield pa.RecordBatch.from_arrays([pa.array(h[repeat_ranges(off[:-1], size)].view(np.int64)), pa.array(np.repeat(node, size)), pa.array(np.repeat(n, size).astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(np.repeat(fp, size))], names=["t", "node", "n", "p", "fp"])

    return run


def _array(column) -> np.ndarray:
    """A column as an array; signatures as rows of words."""
    if not pa.types.is_binary(column.type):
        return column.to_numpy()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SIGNATURE // 64)


def _blocks(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]):
    """Stretches of whole keys as arrays, from batches sorted by key; a key may cross batches."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [_array(column_of(batch, c)) for c in names]
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if last or (held and held[0][0][0] != cols[0][0]):
            parts = [*held, [c[:last] for c in cols]]
            yield [np.concatenate(p) for p in zip(*parts, strict=True)]
            held = []
        held.append([c[last:] for c in cols])
    if held:
        yield [np.concatenate(p) for p in zip(*held, strict=True)]


def _close(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles can be similar if the first that they share is their p-th and q-th."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    return (5 * np.minimum(n, m) >= FIFTHS * np.maximum(n, m)) & (9 * np.minimum(n - p, m - q) >= FIFTHS * (n + m))


def _found(node: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    turn = node[i] > node[j]
    i, j = np.where(turn, j, i), np.where(turn, i, j)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (node[i], node[j], n[i], n[j])], names=["a", "b", "na", "nb"])


PAIRS = "a long, b long, na int, nb int"


def _may_share(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the signatures x and y leave enough shingles that sets of n and m may have in common."""
    most = np.minimum(n - np.bitwise_count(x & ~y).sum(axis=-1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(axis=-1, dtype=np.int64))
    return 9 * most >= FIFTHS * (n.astype(np.int64) + m)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures leave enough shingles that may be in common."""
    for batch in batches:
        a, b, n, m, x, y = (_array(column_of(batch, c)) for c in ("a", "b", "na", "nb", "x", "y"))
        ok = _may_share(n, x, m, y)
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each band each set with the one before it by size, and with the band's least node by hash."""
    for t, n, node in _blocks(batches, ("t", "n", "node")):
        _, start, code = np.unique(t, return_index=True, return_inverse=True)
        at = np.arange(len(t))
        before = at[at > start[code]]
        least = np.lexsort((mix(node.view(U64) + U64(7)), code))[start]
        i, j = np.concatenate([before - 1, at]), np.concatenate([before, least[code]])
        ok = (node[i] != node[j]) & (5 * np.minimum(n[i], n[j]) >= FIFTHS * np.maximum(n[i], n[j]))
        if ok.any():
            yield _found(node, n, i[ok], j[ok])


KEYS = "t long, n int, node long, p int, fp long, m int, other long, near boolean"


def near_pairs(size: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """(2, pairs): places of all pairs of fingerprints within the radius inside buckets, which lie one after
    another with these sizes; all buckets side by side in the planes of one comparison."""
    order = np.argsort(-size, kind="stable")
    at = repeat_ranges((np.cumsum(size) - size)[order], size[order])
    found = [np.stack([at[i], at[j]]) for i, j in pairs_within(fp[at].view(U64), size[order], radius)]
    return np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)


def _keys(all_pairs: int, radius: int):
    """Of keys that two sets or more have: all pairs of small ones (other and m are the second set's; t, p and fp are
    null; near ones have fingerprints within the radius), and the entries of large ones."""

    def both(t, n, node, p, fp):
        i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, min(all_pairs, len(t))):
            left = np.flatnonzero(t[:-d] == t[d:])
            i.append(left)
            j.append(left + d)
        i, j = np.concatenate(i), np.concatenate(j)
        size = np.diff(np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]])))
        x, y = near_pairs(size, fp, radius)
        near = np.isin(i * all_pairs + (j - i), x * all_pairs + (y - x))
        ok = _close(n[i], p[i], n[j], p[j]) & (node[i] != node[j])
        if ok.any():
            a, b, na, nb = _found(node, n, i[ok], j[ok]).columns
            none = pa.nulls(len(a))
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), na, a, none.cast(pa.int32()), none.cast(pa.int64()), nb, b, pa.array(near[ok])], names=["t", "n", "node", "p", "fp", "m", "other", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for t, n, node, p, fp in _blocks(batches, ("t", "n", "node", "p", "fp")):
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (node[1:] != node[:-1])
            cols = [c[new] for c in (t, n, node, p, fp)]
            _, code, count = np.unique(cols[0], return_inverse=True, return_counts=True)
            size = count[code]
            large = size > all_pairs
            if large.any():
                none = pa.nulls(int(large.sum()))
                yield pa.RecordBatch.from_arrays([*(pa.array(c[large]) for c in cols), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.bool_())], names=["t", "n", "node", "p", "fp", "m", "other", "near"])
            few = np.flatnonzero((size > 1) & ~large)
            if len(few):
                held.append([c[few] for c in cols])
                rows += len(few)
            if rows >= PACK:
                yield from both(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, rows = [], 0
        if held:
            yield from both(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _across(all_pairs: bool, radius: int):
    """Pairs of large keys whose ends lie in different classes so far, and whose signatures leave it open:
    all of them, or of each entry one with each other class, that of the nearest fingerprint within the radius.
    A task gives a pair once."""

    def found(batches: Iterator[pa.RecordBatch]):
        for t, n, node, p, fp, root, x in _blocks(batches, MIXED):
            cut = np.flatnonzero(t[1:] != t[:-1]) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(t)], strict=True):
                if (root[a:b] == root[a]).all():
                    continue
                for i in range(a, b - 1):  # ascending n: those near enough are one stretch
                    top = int(np.searchsorted(n[a:b], 5 * n[i] // FIFTHS, side="right")) + a
                    far = np.flatnonzero(root[i + 1 : top] != root[i]) + i + 1
                    far = far[_close(n[i], p[i], n[far], p[far])]
                    far = far[_may_share(n[i], x[i], n[far], x[far])]
                    if not all_pairs and len(far):
                        apart = np.bitwise_count((fp[far] ^ fp[i]).view(U64))
                        far = far[np.argsort(apart, kind="stable")[: int((apart <= radius).sum())]]
                        far = far[np.unique(root[far], return_index=True)[1]]
                    if len(far):
                        yield np.stack([np.minimum(node[i], node[far]), np.maximum(node[i], node[far]), np.where(node[far] < node[i], n[far], n[i]), np.where(node[far] < node[i], n[i], n[far])], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for part in found(batches):
            held.append(part)
            rows += len(part)
            if rows > HELD_PAIRS:
                held = [_once(np.concatenate(held))]
                rows = len(held[0])
                if rows > HELD_PAIRS // 2:
                    yield _batch(held.pop())
                    rows = 0
        if held:
            yield _batch(_once(np.concatenate(held)))

    def _once(x: np.ndarray) -> np.ndarray:
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        return x[np.concatenate([[True], (x[1:, :2] != x[:-1, :2]).any(axis=1)])]

    def _batch(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2].astype(np.int32)), pa.array(x[:, 3].astype(np.int32))], names=["a", "b", "na", "nb"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, place, b, set), sorted, to the pairs whose whole sets are similar enough; b is null with the set of a,
    which comes first.  Rows may be repeated."""
    at, p = None, None
    for batch in batches:
        ok = []
        for a, place, b, x in zip(*(column_of(batch, c).to_pylist() for c in ("a", "place", "b")), column_of(batch, "set"), strict=True):
            if (a, place) != at:
                at, p = (a, place), np.frombuffer(x.as_py(), U64)
            if b is not None:
                both = np.sort(np.concatenate([p, np.frombuffer(x.as_buffer(), U64)]), kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                if 5 * inter >= FIFTHS * (len(both) - inter):
                    ok.append((a, b))
        found = np.array(ok, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _with_sets(shingle: int, shared):
    """The sets of the rows that the map has, equal rows of a task once."""

    def run(batches):
        words_, seen = shared.value, set()

        def wanted():
            for batch in batches:
                at = column_of(batch, "k2").to_numpy().view(U64) & U64(MAP - 1)
                hit = np.flatnonzero(words_[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1))
                keys = zip(column_of(batch, "k1").to_numpy()[hit].tolist(), column_of(batch, "k2").to_numpy()[hit].tolist(), strict=True)
                hit = hit[np.array([x not in seen and not seen.add(x) for x in keys], bool)]
                if len(hit):
                    yield batch.take(pa.array(hit))

        for batch, a, b, h, off in _sets(wanted(), shingle):
            raw = h.tobytes()
            edge = (8 * off).tolist()
            kept = [column_of(batch, c).slice(a, b - a) for c in ("k1", "k2")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([raw[p:q] for p, q in zip(edge, edge[1:], strict=False)], pa.binary())], names=["k1", "k2", "set"])

    return run


def _map_of(rows: DataFrame):
    """The broadcast map (MAP bits, whatever the rows' number) of the k2 of rows."""
    at = F.col("k2").bitwiseAND(F.lit(MAP - 1))
    bit = F.expr("shiftleft(1L, cast(k2 & 63 as int))")
    got = rows.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(bit).alias("x")).toArrow()
    out = np.zeros(MAP // 64, U64)
    out[got["w"].to_numpy()] = got["x"].to_numpy().view(U64)
    return rows.sparkSession.sparkContext.broadcast(out)


def _checked(pairs: DataFrame, keyed: DataFrame, named: DataFrame, shingle: int, signed: bool) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, by the whole sets; pairs may be repeated.
    ``signed`` ones have been held against their signatures where they were found.  Texts stay where they
    are: only the sets that pairs need are sent, those of the b of one a to one place (or some, of BESIDE)."""
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = checkpoint(pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb")))
    if not signed:
        left = named.select(F.col("node").alias("a"), F.col("signature").alias("x"))
        right = named.select(F.col("node").alias("b"), F.col("signature").alias("y"))
        pairs = checkpoint(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "x", "y").transform(map_arrow, _alike, "a long, b long"))
    beside = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BESIDE).alias("places"))
    placed = pairs.join(beside, "a").select("a", "b", F.pmod(F.xxhash64("b"), "places").alias("place"))
    ends = placed.select("a", "place", "b", F.col("b").alias("node")).union(placed.select("a", "place", F.lit(None).cast("long"), "a").distinct())
    ends = checkpoint(ends.join(named.select("node", "k1", "k2"), "node").select("k1", "k2", "a", "place", "b"))
    sets = keyed.select("k1", "k2", "text").transform(map_arrow, _with_sets(shingle, _map_of(ends)), "k1 long, k2 long, set binary")
    sides = sets.join(ends, ["k1", "k2"]).select("a", "place", "b", "set")
    done = checkpoint(sides.repartition(n, "a", "place").sortWithinPartitions("a", "place", "b").transform(map_arrow, _verify, "a long, b long"))
    let_go(keyed.sparkSession)
    return done


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(*row_key(doc_id, text), F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, all_pairs: int = ALL_PAIRS, common: int = COMMON, radius: int = RADIUS) -> DataFrame:
    """(k1, k2, id, root): the class of every row, classes being what links of similarity 0.8 or more connect.

    Similarity is the exact Jaccard similarity of the sets of ``shingle``-word shingles.  Texts
    without words are one class.  Equal sets are collapsed before anything is compared.  ``radius`` says
    which pairs are looked at first and changes no class.
    """
    keyed, n = _keyed(docs, doc_id, text), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = checkpoint(keyed.transform(map_arrow, _prints(shingle), "k1 long, k2 long, id long, node long, n long, bands array<long>, signature binary"))
    named = checkpoint(prints.groupBy("node").agg(F.min(F.struct("k1", "k2", "n", "bands", "signature")).alias("k")).select("node", "k.*"))
    often = keyed.select("text").transform(map_arrow, _some(shingle), "t long").groupBy("t").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= common)
    top = often.orderBy(F.desc("c"), "t").limit(MOST_COMMON).toArrow()
    t, c = top["t"].to_numpy().astype(np.int64).view(U64), top["c"].to_numpy().astype(np.int64)
    order = np.argsort(t)
    shared = docs.sparkSession.sparkContext.broadcast((t[order], c[order]))
    entries = keyed.select("text").transform(map_arrow, _prefixes(shingle, shared), "t long, node long, n int, p int, fp long")
    keys = checkpoint(entries.repartition(n, "t").sortWithinPartitions("t", "n", "node").transform(map_arrow, _keys(all_pairs, radius), KEYS))
    let_go(docs.sparkSession)
    large = keys.filter("t is not null").select("t", "n", "node", "p", "fp")
    small = keys.filter("t is null").select(F.col("node").alias("a"), F.col("other").alias("b"), F.col("n").alias("na"), F.col("m").alias("nb"), "near")
    banded = named.filter("n > 0").select(F.explode("bands").alias("t"), F.col("n").cast("int").alias("n"), "node")
    banded = banded.repartition(n, "t").sortWithinPartitions("t", "n", "node").transform(map_arrow, _linked, PAIRS)
    links = _checked(small.filter("near").drop("near").unionByName(banded), keyed, named, shingle, False)
    roots = checkpoint(star_components(links))
    for every in (False, True):  # near fingerprints of large keys; then what is left is read in full
        rest = large.join(roots, "node", "left").select("t", "n", "node", "p", "fp", F.coalesce("root", "node").alias("root"))
        mixed = rest.groupBy("t").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("t")
        rest = rest.join(mixed, "t").join(named.select("node", "signature"), "node").select(*MIXED)
        found = rest.repartition(n, "t").sortWithinPartitions("t", "n", "node").transform(map_arrow, _across(every, radius), PAIRS)
        if every:
            x, y = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
            beyond = small.filter("not near").join(x, "a", "left").join(y, "b", "left")
            beyond = beyond.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
            found = found.unionByName(beyond.select("a", "b", "na", "nb"))
        more = _checked(found, keyed, named, shingle, not every)
        if not more.isEmpty():
            links = written(links.union(more))
            roots = checkpoint(star_components(links))
    return checkpoint(prints.join(roots, "node", "left").select("k1", "k2", "id", F.coalesce("root", "node").alias("root")))


def keep_one_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with exactly one row of each class of :func:`similar_groups`: see :func:`.keep.first_of_each`."""
    return first_of_each(docs, similar_groups(docs, doc_id, text, **options), doc_id, text)
