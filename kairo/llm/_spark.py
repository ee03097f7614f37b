"""Spark helpers of this subpackage: row keys, checkpoints, reading tables."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import give_back


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoints(spark: SparkSession) -> str:
    """The shared checkpoint folder: the context's own, or the one that spark.checkpoint.dir names.

    Under a local master, where one machine is all there is, it may be left out.  On a cluster
    that raises: a folder of one machine would lose what other executors need.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or f"{tempfile.gettempdir()}/checkpoints")
    return sc.getCheckpointDir()


def let_go(spark: SparkSession) -> None:
    """Has the driver notice which shuffles nothing reads any more, so that their files are deleted now
    and not when its heap happens to fill; then has the executors give back the heap that garbage holds."""
    gc.collect()
    spark._jvm.System.gc()
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


_scratch: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for a table that a result is read from; see drop_scratch."""
    _scratch.append(f"{ensure_checkpoints(spark)}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def drop(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_made() -> int:
    """How many scratch folders there are; for drop_scratch."""
    return len(_scratch)


def drop_scratch(spark: SparkSession, since: int = 0) -> None:
    """Deletes the scratch folders made since then; call it once results that read them have been written."""
    while len(_scratch) > since:
        drop(spark, _scratch.pop())


#: Rows and bytes of an Arrow batch: texts are long, so the session's defaults would be large.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small, so that workers hold little whatever the texts' length."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        number = re.match(r"-?\d+$", now or "")
        if not number or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow whose workers give back what a task has freed, as idle ones stay around."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through a reliable checkpoint in the shared folder."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The same cut, through a written table: what loops carry from round to round.

    A checkpoint keeps the size that its plan was estimated at, and joins multiply those, so
    over a loop the estimate's digits double each round; a table's size is that of its files.
    """
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Lines of a table that is broadcast to many rows; of more, each line is dealt to SALTS places.
MEET, SALTS = 20_000, 32


def meet(rows: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows with the line of ``small`` (a written table, a line a key) that has their key.

    One key may be a third of all rows: they must not go to one task.  Up to MEET lines, which are
    counted, are broadcast; of more the rows of a key are dealt by a hash of the whole row.
    """
    if small.count() <= MEET:
        return rows.join(F.broadcast(small), key, how)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS)).cast("int")
    lines = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", salt).join(lines, [key, "__salt"], how).drop("__salt")


def held_out(doc_id: str | Column) -> Column:
    """True where crc32 of the id's decimal text is divisible by five; null ids are held out too."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % 5 == 0, F.lit(True))


def row_key(doc_id: str, text: str) -> tuple[Column, Column]:
    """Two longs that name a row by its id and text.  Rows equal in both share a key
    and, by every contract here, a result; so no unstable row number is needed."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("k1"), F.xxhash64(F.col(doc_id), F.col(text)).alias("k2")


#: Values of a column to be sampled that the driver will look at.
MAX_VALUES = 200


def bounded_sample(rows: DataFrame, of: str, key: str, n: int) -> DataFrame:
    """At most n rows of each value of ``of``: those least by a hash of ``key``.

    The rows are first thinned to about 4 n of each value by that hash, so ranking never
    sees more; a value of fewer rows keeps them all.
    """
    share = rows.groupBy(of).agg(F.least(F.lit(1.0), F.lit(4.0 * n + 64) / F.count(F.lit(1))).alias("__share"))
    few = share.limit(MAX_VALUES + 1).collect()
    h = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    rows = rows.withColumn("__h", h)
    if len(few) <= MAX_VALUES:  # thinned where they are read; else rows would travel to their value first
        bound = F.lit(0.0)
        for r in few:
            bound = F.when(F.col(of).eqNullSafe(F.lit(r[0])), r[1]).otherwise(bound)
        thin = rows.filter(F.col("__h") < bound)
    else:
        thin = rows.join(share, of).filter(F.col("__h") < F.col("__share")).drop("__share")
    return thin.withColumn("__r", F.row_number().over(Window.partitionBy(of).orderBy("__h", key))).filter(F.col("__r") <= n).drop("__h", "__r")


def rest_of_row(docs: DataFrame, text: str) -> Column:
    """All columns but the text as the struct ``row``, so that texts cross to Python once."""
    return F.struct(*([F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("_")])).alias("row")


def whole_row(docs: DataFrame, text: str) -> list[Column]:
    """docs' columns again, of ``row`` and ``text``."""
    return [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
