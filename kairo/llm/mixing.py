"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_sample, checkpoint, map_arrow, rest_of_row, whole_row, written
from ._text import LOWER, NOT_LETTER, U64, buffers, column_of, steps, word_hashes, words

#: Topics are the nearest of so many centres over hashed words; fitted on all documents in so many rounds at most.
TOPICS, WIDTH, TOPIC_ROUNDS, UNIT = 8, 512, 25, 1 << 20
#: Blocks of vectors (half a megabyte of text each) that one task of a round adds up.
TASK_BLOCKS = 256
#: Only where the rounds start is taken from a sample of texts of so many characters at most.
START_DOCS, START_CHARS = 2000, 50_000
MARGINS = ("source", "lang", "topic")
#: Cells (source x language x topic) that the driver rakes itself; more are raked in DataFrames.
MAX_CELLS = 200_000
ROUNDS, CLOSE = 200, 1e-9
#: A share that is off its target by more than this is told of.
UNMET = 1e-3
#: Share of all tokens to draw, and how far targets are flattened from the present shares.
BUDGET, TEMPERATURE = 0.5, 0.5
NONE = "\x00"


# ---- topics ----------------------------------------------------------------


def topic_vectors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of log counts of hashed lower-cased letter runs, and the words of each text."""
    low = LOWER[buf]
    ws, we, wo = words(low, off, NOT_LETTER)
    n = len(off) - 1
    text = np.repeat(np.arange(n), np.diff(wo))
    f = (word_hashes(low, ws, we) >> U64(55)).astype(np.int64)
    x = np.log1p(np.bincount(text * WIDTH + f, minlength=n * WIDTH).reshape(n, WIDTH))
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
    return x, np.diff(words(buf, off)[2])


def spread_starts(x: np.ndarray, k: int = TOPICS) -> np.ndarray:
    """Rows of x far from each other; deterministic."""
    if not len(x):
        return np.zeros((1, WIDTH))
    centres = [x[0]]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[int(np.max(x @ np.array(centres).T, axis=1).argmin())])
    return np.array(centres)


def in_units(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 1 / UNIT: sums and products of those are exact, in any order and batch."""
    return np.rint(x * UNIT)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of the greatest inner product with each row of x, both in units."""
    return (x @ centres.T).argmax(axis=1)


def pack(x: np.ndarray) -> bytes:
    """The cells of x that aren't zero, in units of 1 / UNIT."""
    q = in_units(x).astype(np.uint32)
    row, col = np.nonzero(q)
    return np.uint32(len(x)).tobytes() + np.bincount(row, minlength=len(x)).astype(np.uint32).tobytes() + q[row, col].tobytes() + col.astype(np.uint16).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    size = np.frombuffer(raw, np.uint32, n, 4)
    nnz = int(size.sum())
    x = np.zeros((n, WIDTH))
    x[np.repeat(np.arange(n), size), np.frombuffer(raw, np.uint16, nnz, 4 + 4 * n + 4 * nnz)] = np.frombuffer(raw, np.uint32, nnz, 4 + 4 * n)
    return x


def _with_vectors(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.lit(1).alias("one")).filter("text is not null and text <> ''")


def start_topics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Where the rounds start: spread-out documents of a hash sample of bounded texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = buffers(column_of(batch, "text"))
            for a, b in steps(off):
                x, _ = topic_vectors(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                yield pa.RecordBatch.from_arrays([column_of(batch, "id").slice(a, b - a), pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary())], names=["id", "x"])

    rows = _with_vectors(docs, doc_id, text).filter(F.length("text") <= START_CHARS)
    got = bounded_sample(rows, "one", "id", START_DOCS).select("id", "text").orderBy("id", "text").transform(map_arrow, run, "id long, x binary").toArrow()
    raw = sorted(zip(got["id"].to_pylist(), got["x"].to_pylist(), strict=True), key=lambda r: (r[0] is None, r))
    return spread_starts(np.array([np.frombuffer(r[1], np.float32) for r in raw], np.float64).reshape(-1, WIDTH))


def blocks_of(docs: DataFrame, text: str, kept: list) -> DataFrame:
    """Checkpointed blocks of documents, whole: their vectors, words and the columns ``kept``, as arrays."""
    base = docs.select(*kept, F.col(text).cast("string").alias("text"))
    names = base.columns[:-1]
    types = [base.schema[c].dataType.simpleString() for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = buffers(column_of(batch, "text"))
            for a, b in steps(off):
                x, n = topic_vectors(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                held = [one(column_of(batch, c).slice(a, b - a)) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array([pack(x)], pa.binary()), one(pa.array(n.astype(np.int64))), *held], names=["x", "n_tokens", *names])

    ddl = ", ".join(["x binary", "n_tokens array<long>", *(f"{c} array<{t}>" for c, t in zip(names, types, strict=True))])
    return checkpoint(base.transform(map_arrow, run, ddl))


def placed(blocks: DataFrame, centres: np.ndarray) -> DataFrame:
    """A row per document of the blocks: their columns but the vector, and ``topic``."""
    names = [c for c in blocks.columns if c != "x"]
    shared = blocks.sparkSession.sparkContext.broadcast(in_units(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                topic = nearest(unpack(column_of(batch, "x")[i].as_buffer()), shared.value)
                yield pa.RecordBatch.from_arrays([*(column_of(batch, c)[i].values for c in names), pa.array([f"t{k}" for k in topic], pa.string())], names=[*names, "topic"])

    ddl = ", ".join(f"{c} {blocks.schema[c].dataType.elementType.simpleString()}" for c in names)
    return blocks.transform(map_arrow, run, f"{ddl}, topic string")


def fit_topics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", blocks: DataFrame | None = None) -> np.ndarray:
    """Spherical k-means over all documents, whole: each round adds up the vectors nearest to each
    centre, as partial sums of each task.  Vectors and centres are in whole units, so sums and
    choices are exact in any order.  Rounds end when the sums stay, at TOPIC_ROUNDS at the latest."""
    c = start_topics(docs, doc_id, text)
    vectors = (blocks_of(docs, text, []) if blocks is None else blocks).select("x")
    vectors = vectors.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() // TASK_BLOCKS)))
    last = None
    for _ in range(TOPIC_ROUNDS):

        def sums(batches: Iterator[pa.RecordBatch], c: np.ndarray = c) -> Iterator[pa.RecordBatch]:
            total, units = np.zeros((len(c), WIDTH)), in_units(c)
            for batch in batches:
                for raw in batch.column(0):
                    x = unpack(raw.as_buffer())
                    near = nearest(x, units)
                    total += (near == np.arange(len(c))[:, None]).astype(float) @ x
            slot = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total.ravel()[slot].astype(np.int64))], names=["slot", "v"])

        got = vectors.transform(map_arrow, sums, "slot long, v long").groupBy("slot").agg(F.sum("v").alias("v")).toArrow()
        total = np.zeros(c.size)
        total[got["slot"].to_numpy()] = got["v"].to_numpy()
        if last is not None and (total == last).all():
            break
        last, m = total, total.reshape(c.shape)
        size = np.sqrt((m * m).sum(axis=1, keepdims=True))
        c = np.where(size > 0, m / np.maximum(size, 1e-9), c)
    return in_units(c) / UNIT


def _kept(docs: DataFrame, doc_id: str, text: str, source: str, lang: str, seed: int) -> list:
    """The row but its text, source and language by name, and the number that decides whether it is sampled."""
    u = F.pmod(F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    return [rest_of_row(docs, text), name(source).alias("source"), name(lang).alias("lang"), u.alias("u")]


def annotate(docs: DataFrame, centres: np.ndarray, doc_id: str, text: str, source: str, lang: str, seed: int, with_text: bool = False) -> DataFrame:
    """(row, source, lang, topic, n_tokens, u[, text]): null sources and languages under a name of their own."""
    shared = docs.sparkSession.sparkContext.broadcast(in_units(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = buffers(column_of(batch, "text"))
            for a, b in steps(off):
                x, n = topic_vectors(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                topic = nearest(in_units(x), shared.value)
                kept = [column_of(batch, c).slice(a, b - a) for c in ("row", "source", "lang", "u", *["text"] * with_text)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([f"t{i}" for i in topic]), pa.array(n.astype(np.int64))], names=["row", "source", "lang", "u", *["text"] * with_text, "topic", "n_tokens"])

    base = docs.select(*_kept(docs, doc_id, text, source, lang, seed), F.col(text).cast("string").alias("text"))
    return base.transform(map_arrow, run, f"row {base.schema['row'].dataType.simpleString()}, source string, lang string, u double{', text string' * with_text}, topic string, n_tokens long")


# ---- raking ----------------------------------------------------------------


def flattened(shares: Mapping[str, float], temperature: float) -> dict[str, float]:
    """Targets proportional to the present shares to this power; what has no tokens has no target."""
    raised = {k: v**temperature if v > 0 else 0.0 for k, v in shares.items()}
    total = sum(raised.values())
    return {k: v / total if total else 0.0 for k, v in raised.items()}


def rake(cells: pd.DataFrame, targets: Mapping[str, Mapping[str, float]], rounds: int = ROUNDS) -> np.ndarray:
    """Multiplier of each cell's tokens, such that each margin's shares meet its targets.

    ``cells`` has the margins and ``tokens``.  A value without a target, or whose target is
    zero, gets zero; targets of values without tokens are left out and the rest rescaled.
    """
    tokens = cells["tokens"].to_numpy(float)
    total = tokens.sum()
    m = np.ones(len(cells))
    if not total:
        return m
    codes, goals = [], []
    for margin in MARGINS:
        code, names = pd.factorize(cells[margin])
        have = np.bincount(code, tokens, minlength=len(names))
        goal = np.array([targets[margin].get(v, 0.0) for v in names]) * (have > 0)
        codes.append(code)
        goals.append(goal / max(goal.sum(), 1e-300) * total)
    for _ in range(rounds):
        off = 0.0
        for code, goal in zip(codes, goals, strict=True):
            have = np.bincount(code, tokens * m, minlength=len(goal))
            factor = np.where(have > 0, goal / np.where(have > 0, have, 1), 1.0)
            off = max(off, float(np.abs(have - goal).max() / total))
            m = m * factor[code]
        if off < CLOSE:
            break
    return m


def unmet(cells: pd.DataFrame, m: np.ndarray, targets: Mapping[str, Mapping[str, float]]) -> float:
    """How far the worst margin's share is off its target after raking; targets of what has no tokens don't count."""
    raked = cells["tokens"].to_numpy(float) * m
    worst, total = 0.0, max(raked.sum(), 1e-300)
    for margin in MARGINS:
        have = pd.Series(cells["tokens"].to_numpy(float)).groupby(cells[margin].to_numpy()).sum()
        got = pd.Series(raked).groupby(cells[margin].to_numpy()).sum() / total
        goal = pd.Series({v: targets[margin].get(v, 0.0) if t > 0 else 0.0 for v, t in have.items()})
        if goal.sum() > 0:
            worst = max(worst, float((got - goal / goal.sum()).abs().max()))
    return worst


def _tell(off: float) -> None:
    if off > UNMET:
        warnings.warn(f"margins contradict each other: after {ROUNDS} rounds a share is still {off:.4f} off its target", stacklevel=3)


def margins(mixed: DataFrame) -> DataFrame:
    """(margin, value, share, raked): each value's share of the tokens as they are and as they are weighted."""
    cells = mixed.groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("tokens"), F.sum(F.col("n_tokens") * F.col("weight")).alias("raked"))
    one = lambda c: F.struct(F.lit(c).alias("margin"), F.col(c).alias("value"))
    long = cells.select("tokens", "raked", F.explode(F.array(*[one(c) for c in MARGINS])).alias("x")).groupBy("x.margin", "x.value").agg(F.sum("tokens").alias("tokens"), F.sum("raked").alias("raked"))
    total = cells.agg(F.sum("tokens").alias("t"), F.sum("raked").alias("r"))
    return long.join(F.broadcast(total)).select("margin", "value", (F.col("tokens") / F.col("t")).alias("share"), (F.col("raked") / F.col("r")).alias("raked"))


def rake_frames(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | None], temperature: float, rounds: int = ROUNDS) -> DataFrame:
    """The same where there are too many cells for the driver: a column ``m`` beside the cells."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = {}
    for margin in MARGINS:
        have = cells.groupBy(margin).agg(F.sum("tokens").alias("have"))
        if targets.get(margin) is None:
            goal = have.withColumn("goal", F.when(F.col("have") > 0, F.pow("have", F.lit(temperature))).otherwise(0.0))
        else:
            given = spark.createDataFrame(list(targets[margin].items()), f"{margin} string, goal double")
            goal = have.join(given, margin, "left").withColumn("goal", F.when(F.col("have") > 0, F.coalesce("goal", F.lit(0.0))).otherwise(0.0))
        scale = goal.agg(F.sum("goal")).first()[0] or 1.0
        goals[margin] = written(goal.select(margin, (F.col("goal") * F.lit(total / scale)).alias("goal")))
    now = cells.withColumn("m", F.lit(1.0))
    for _ in range(rounds):
        for margin in MARGINS:
            have = now.groupBy(margin).agg(F.sum(F.col("tokens") * F.col("m")).alias("have"))
            step = have.join(goals[margin], margin).select(margin, F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(1.0).alias("factor"), F.abs(F.col("have") - F.col("goal")).alias(f"off_{margin}"))
            now = now.join(step, margin).withColumn("m", F.col("m") * F.col("factor")).drop("factor")
        now = written(now)
        off = (now.agg(F.max(F.greatest(*[f"off_{m}" for m in MARGINS]))).first()[0] or 0) / max(total, 1)
        now = now.drop(*[f"off_{m}" for m in MARGINS])
        if off < CLOSE:
            break
    else:
        _tell(off)
    return now


def calibrate(sums, budget: float, rounds: int = 60) -> float:
    """s such that min(1, s m) of all tokens is the budget.  ``sums(s)`` gives the tokens
    of cells with s m >= 1 and the sum of m times tokens of the others."""
    s = 0.0
    for _ in range(rounds):
        full, rest = sums(s)
        now = max(budget - full, 0.0) / rest if rest > 0 else s
        if now <= s * (1 + 1e-12):
            break
        s = now
    return s


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, temperature: float = TEMPERATURE, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", max_cells: int = MAX_CELLS, frame_rounds: int = ROUNDS, with_text: bool = False) -> DataFrame:
    """Weights, probabilities and a sample: (row, source, lang, topic, n_tokens, weight, probability, sampled).

    Tokens (words) of each source, language and topic are raked until the shares of all
    three margins meet their ``targets`` (by default the present shares to the power
    ``temperature``), in ROUNDS rounds at most, on the driver or, beyond ``max_cells`` cells, in
    DataFrames: the same rounds, stop and result.  Margins that contradict each other can't
    all be met; a warning then says how far off the worst share is (see :func:`margins`).  A cell's weight is its raked over its present tokens; a document's
    probability is min(1, s * weight) with the one s that makes the expected tokens
    ``budget`` of all; it is sampled if a hash of its id, text and the seed falls below that.

    One row per row of docs, which but for its text is the struct ``row``, so no name can clash;
    ``with_text`` adds the text.  Null
    sources and languages are values of their own (shown as null).  Null and empty texts
    have no tokens; they take their cell's weight and are sampled alike.  Repeated rows are
    sampled or not together.  Texts are read whole, however long, in one pass (and once more
    with ``with_text``).  An empty table gives no rows.
    """
    spark = docs.sparkSession
    targets = dict(targets or {})
    kept = _kept(docs, doc_id, text, source, lang, seed)
    blocks = blocks_of(docs, text, kept[1:3] if with_text else kept)
    centres = fit_topics(docs, doc_id, text, blocks)
    light = placed(blocks, centres)
    rows = annotate(docs, centres, doc_id, text, source, lang, seed, True) if with_text else light
    cells = written(light.groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("tokens")))
    if cells.count() <= max_cells:
        local = cells.toPandas().sort_values(list(MARGINS)).reset_index(drop=True)
        total = local["tokens"].sum()
        goals = {m: targets.get(m) or flattened((local.groupby(m)["tokens"].sum() / max(total, 1)).to_dict(), temperature) for m in MARGINS}
        local["m"] = rake(local, goals)
        _tell(unmet(local, local["m"].to_numpy(), goals))

        def sums(s: float) -> tuple[float, float]:
            full = s * local["m"] >= 1
            return float(local["tokens"][full].sum()), float((local["m"] * local["tokens"])[~full].sum())

        table = spark.createDataFrame(local, "source string, lang string, topic string, tokens double, m double")
        table = F.broadcast(table)  # max_cells rows at most
    else:
        table = rake_frames(cells, targets, temperature, frame_rounds)
        total = cells.agg(F.sum("tokens")).first()[0]

        def sums(s: float) -> tuple[float, float]:
            full = F.col("m") * s >= 1
            r = table.agg(F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("m") * F.col("tokens")))).first()
            return r[0] or 0.0, r[1] or 0.0

    s = calibrate(sums, budget * total)
    probability = F.least(F.lit(1.0), F.col("m") * s)
    joined = rows.join(table.drop("tokens"), list(MARGINS))
    shown = [F.when(F.col(c) != NONE, F.col(c)).alias(c) for c in ("source", "lang")]
    return joined.select("row", *["text"] * with_text, *shown, "topic", "n_tokens", F.col("m").alias("weight"), probability.alias("probability"), (F.col("u") < probability).alias("sampled"))


def sample(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The sampled rows of docs."""
    return mix(docs, text=text, with_text=True, **options).filter("sampled").select(*whole_row(docs, text))
