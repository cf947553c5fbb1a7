"""Queries of the corpus operators over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm import counts, decontam, exact, linedup, lmscore, mixing, neardup, quality, rans, repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as coded blocks of token ids; a NULL or empty text is its end mark alone, repeated rows are coded each."""
    return rans.encode(_table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled of good quality and not toxic; NULL and empty texts have a NULL score."""
    good = _table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) <> 1").select("doc_id")
    return lmscore.score(_table(spark, sf_dir, "documents"), good)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ten doc_ids, six came with the first snapshot, two with the second, and two are the new batch; NULL texts equal nothing."""
    docs = _table(spark, sf_dir, "documents")
    return exact.exact_duplicates([docs.where("doc_id % 10 < 6"), docs.where("doc_id % 10 in (6, 7)"), docs.where("doc_id is null or doc_id % 10 > 7")])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of every document against every item of benchmark; NULL and empty texts and items match nothing."""
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document for weights that lift small sources; NULL sources are a source, NULL sizes count as 1."""
    return mixing.mixed_copies(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the blocks of lines that an earlier one has; a NULL text stays NULL, an empty one empty."""
    return linedup.deduped_lines(_table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that occurs before, in whatever document; NULL and short texts have none."""
    return repeats.repeated_passages(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; a NULL text has NULL, an empty one 0."""
    return counts.token_counts(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every document; a NULL or empty text has a NULL score and is kept."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the one that stays for its group of near copies; NULL texts are in no group."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rans_tokens": op1_rans_tokens,
    "op2_lm_score": op2_lm_score,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_source_mixing": op5_source_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        WITH parts AS (
            SELECT doc_id, text, CASE WHEN doc_id % 10 < 6 THEN 0 WHEN doc_id % 10 < 8 THEN 1 ELSE 2 END AS part FROM documents
        ), ranked AS (
            SELECT doc_id, text,
                   first_value(doc_id) OVER (PARTITION BY text ORDER BY part, doc_id NULLS LAST) AS first_id,
                   row_number() OVER (PARTITION BY text ORDER BY part, doc_id NULLS LAST) AS nth
            FROM parts
        )
        SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE first_id END AS keep_id, text IS NULL OR nth = 1 AS keep FROM ranked
    """,
}
