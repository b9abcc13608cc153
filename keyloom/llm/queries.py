"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import dartminhash, decontam, feistel, linerun, mixing, pii, rulefit, secretscan, tokenbin, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.find_secrets(_table(spark, sf_dir, "documents"))


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.shard_rows(_table(spark, sf_dir, "documents"))


def op6_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulefit.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_classes(_table(spark, sf_dir, "documents")).drop("text_hash")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerun.repeated_runs(_table(spark, sf_dir, "documents")).drop("text_hash")


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_binary(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk_search, op2_mix_sources, op3_contextual_pii, op4_secret_ownership, op5_feistel_shards, op6_rule_quality, op7_dart_minhash, op8_decontaminate, op9_line_runs, op10_token_binary)}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": topk.ORACLE, "op2_mix_sources": mixing.ORACLE, "op9_line_runs": linerun.ORACLE}
