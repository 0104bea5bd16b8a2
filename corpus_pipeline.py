"""A training corpus from ``documents``: quality, lines, near-duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinflow.llm import bpe, lines, mixing, quality, queries, simhash, store


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that stood earlier; ``n_chars`` follows the text."""
    deduped = lines.dedup_lines(docs).select(*docs.columns)
    return deduped.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else deduped


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.simhash_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take, once for each epoch."""
    return mixing.select_mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids of every document."""
    encoded = bpe.bpe_encode(docs.select("doc_id", "lang", "source", "text"), queries.VOCABULARY)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("simhash", simhash_stage), ("mixing", mixing_stage), ("bpe", token_stage)]

#: SQL has no fingerprints of this kind, no n-gram model of this size and no BPE: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``. A stage's table goes when the next one is written, and so do those that
    stages write for themselves; the last one remains, as the result reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = store.settle_alone(lambda: stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            store.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
