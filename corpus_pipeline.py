"""Corpus preparation in five stages over the documents table.

Each stage takes what its predecessor kept; all but the last return the columns of
documents.  run() writes every stage's rows as Parquet into the shared checkpoint folder and
reads them again, so a lost executor costs its own tasks and no earlier stage.  Once a stage
is written, what it was read from and its scratch tables are deleted.

Null texts are of no language and go in the first stage, as blank ones do; rows with null or
repeated ids are documents like any other until near-dedup, which keeps one row of each class,
the smallest id first, null ids last.  Equal rows share every verdict of the other stages.
Further columns go through all stages but the last, whatever their names; an empty table
gives empty ones.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairo.llm import langid, mixing, similar, suffix
from kairo.llm._spark import drop, drop_scratch, ensure_checkpoints, let_go, scratch_made, small_batches, table
from kairo.llm.bpe import encode_docs


def begin(spark: SparkSession) -> None:
    """What each stage starts with: small batches, and heaps without what the stage before has left in them."""
    small_batches(spark)
    let_go(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without one, or of too even a score, go."""
    begin(spark)
    return langid.keep_identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts with 5-word Jaccard similarity 0.8 or more the document with the smallest id."""
    begin(spark)
    return similar.keep_one_similar(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that also start elsewhere; n_chars follows."""
    begin(spark)
    return suffix.without_repeats(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet flattened source, language and topic shares."""
    begin(spark)
    return mixing.sample(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids: little-endian unsigned 32-bit, and the digest of what they decode to."""
    begin(spark)
    done = encode_docs(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing_sources", mixing_sources),
    ("byte_level_bpe", byte_level_bpe),
]

#: Fingerprints, suffix merging and token ids have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoints(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = scratch_made()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        drop_scratch(spark, made)
        if k:
            drop(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
