"""Queries of the numbered operators, each over its whole table."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, chat, clusters, licenses, lines, mixing, periods, quality, simhash, tokens, toxicity, vector_dedup

#: A parameter: the vocabulary file that the BPE queries read.
VOCABULARY = os.environ.get("BPE_VOCABULARY") or public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_read(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(_read(spark, sf_dir, "documents"), VOCABULARY)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "lang", "perplexity", "threshold", "keep")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digests(turns.unionByName(chat.hostile_turns(spark)))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_groups(_read(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).drop("row_hash")


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters_with_inertia(_read(spark, sf_dir, "embeddings"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(periods.periodic_runs(periods.with_planted_runs(_read(spark, sf_dir, "documents"))))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_read(spark, sf_dir, "documents"), VOCABULARY)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_bpe, op3_quality, op4_chat, op5_ann, op6_vector_dedup, op7_toxicity, op8_line_dedup, op9_licenses, op10_mixing, op11_clusters, op12_periods, op13_token_counts)}
ORACLE_SQL: dict[str, str] = {"op8_line_dedup": lines.ORACLE, "op10_mixing": mixing.ORACLE, "op11_clusters": clusters.ORACLE}
