"""Registered queries of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldeval.llm import (
    decontaminate,
    divergence,
    htmltext,
    langid,
    linededup,
    mixing,
    nndescent,
    packing,
    quality,
    simhash,
    tokencount,
    topk,
    vectorcodes,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of near duplicates of every row of `documents`."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of all `documents`."""
    return tokencount.section_counts(_read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text less lines that match earlier ones."""
    found = linededup.dedup_lines(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from rows outside the held-out fold."""
    docs = _read(spark, sf_dir, "documents")
    net = langid.train(docs)
    found = langid.identify(docs.select("doc_id", "text", langid.in_fold().alias("held_out")), net)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all `documents` and their places in sequences."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of `pages`."""
    return htmltext.extract(_read(spark, sf_dir, "pages"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten highest scores of every hundredth vector against all others."""
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.shares(_read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from overlapping heuristic labellers."""
    docs = _read(spark, sf_dir, "documents")
    _, scorer = quality.train(docs)
    return quality.scored(docs, scorer)


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest of every twentieth vector, found through a neighbour graph."""
    return nndescent.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of `benchmark` items, and those items' digest."""
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all `embeddings` and their errors."""
    return vectorcodes.codes(_read(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language in all `documents`, and the terms behind it."""
    return divergence.audit(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_id": op4_language_id,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_html_extraction": op6_html_extraction,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_source_mixing": op8_source_mixing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_nn_descent": op10_nn_descent,
    "op11_decontamination": op11_decontamination,
    "op12_vector_codes": op12_vector_codes,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op7_exact_top_k": topk.TOP_K_SQL,
    "op8_source_mixing": mixing.SHARES_SQL,
    "op11_decontamination": decontaminate.CONTAMINATION_SQL,
    "op12_vector_codes": vectorcodes.CODES_SQL,
    "op13_source_divergence": divergence.AUDIT_SQL,
}
