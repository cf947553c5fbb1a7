"""Corpus pipeline: the stages that make a training corpus of the documents table, each written and reread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm import decontam, mixing, neardup, quality, rans
from sedimenta.llm.shared import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects, in all their rows.

    NULL and empty texts and texts without a token have no score and stay; without labels all stay.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: the one of the least doc_id, a NULL doc_id being the greatest.

    Rows that repeat doc_id and text count as copies. NULL texts are in no group and stay; empty texts are copies of
    one another, of which one stays.
    """
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark, in all their rows.

    NULL and empty texts hold nothing and stay; NULL and empty items are held by nothing.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that the sources have their target weights; no document is dropped.

    A NULL source is a source of its own and a NULL n_chars counts as 1; rows of equal source and doc_id get equal copies.
    """
    return mixing.mix_sources(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents as coded blocks; a NULL or empty text is a document of its end mark alone."""
    return rans.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("token_output", token_stage),
]

#: The classifier is a trained model, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again.

    An empty table of documents gives an empty result. Further columns of documents are handed on, whatever their names.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut(docs, name)
    return docs
