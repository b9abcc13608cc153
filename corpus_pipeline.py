"""The corpus pipeline: five stages from documents to token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.

Null and empty texts, null ids, repeated rows and very long texts pass every
stage as its operator's docstring says: null and empty texts are scored like
any other, are one class of near duplicates, hold no benchmark passage, are
mixed as rows of their source and encoded as the end id alone.  Further columns
of ``documents`` pass through all stages but the last.  An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import dartminhash, decontam, mixing, rulefit, tokenbin
from keyloom.llm.common import drop_table, materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject; it is fitted on the labelled documents among ``docs``."""
    return rulefit.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least doc_id."""
    return dartminhash.drop_near(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that copies a benchmark item."""
    return decontam.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated at the rates of their sources, in shuffled order."""
    return mixing.mix(docs).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents in shuffled order, copies apart, read back: a row per document."""
    return tokenbin.token_binary(docs, shuffled=True)


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("token_binary_output", tokenize),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        drop_table(last)  # nothing reads it any more
    return STAGES[-1][1](spark, docs, sf_dir)
