"""From raw documents to token ids: toxicity, line dedup, near-duplicates, source mix, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written to the shared folder and read again as the
next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm import bpe, line_dedup, minhash, mixing, toxicity
from tablescope.llm.shared import free_name, quoted, read, without
from tablescope.session import materialize

#: Bytes of one Arrow batch. Spark's defaults (64 MB, 10,000 rows) let every task hold a whole partition's texts several times over.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def in_small_batches(stage):
    """``stage`` with the session's Arrow batches bounded. What a stage returns is computed later, so the setting stays until ``run`` ends."""
    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return bounded


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (score 0.5 or more); it learns from the labels outside the held-out fold."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), toxicity.fold("doc_id", 5) != 0)
    score = free_name(docs, "_score")
    return toxicity.scored(docs, model, name=score, keep_text=True).where(quoted(score) < 0.5).drop(score)


@in_small_batches
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go. So do documents of which nothing is left; those without words before stay."""
    cut = line_dedup.dedup_lines(docs)
    deleted = quoted(free_name(docs, "n_deleted"))
    emptied = (deleted > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.where(~F.coalesce(emptied, F.lit(False))).select(*[
        F.when(deleted > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else quoted(c)
        for c in docs.columns])


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    found = minhash.near_duplicates(docs, limit=minhash.Threshold(80, 100))
    gone = materialize(found.where("not kept").select("doc_id"), "gone")
    return without(docs, F.col("doc_id"), gone)


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, three at most."""
    return mixing.mixed(docs)


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of the ids and of the decoded text."""
    return bpe.encode_documents(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_duplicates", drop_near_copies), ("source_mix", mix_sources), ("bpe", encode)]

#: A classifier and a tokenizer are no SQL: tests/llm checks the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = spark.conf.get(BATCH_SETTING)
    try:
        docs = read(spark, sf_dir, "documents")
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs
