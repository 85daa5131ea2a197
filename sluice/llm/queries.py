"""Queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import line_dedup, mixing
from sluice.llm.ann import vector_duplicates
from sluice.llm.common import crc_mod, table
from sluice.llm.html_text import extract
from sluice.llm.minhash import near_duplicates
from sluice.llm.ngram_scoring import by_remainder, score_documents
from sluice.llm.packing import pack_documents
from sluice.llm.quality import quality
from sluice.llm.token_count import token_counts
from sluice.llm.toxicity import score as toxic_score
from sluice.llm.toxicity import train as toxic_train


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder_paths() -> tuple:
    import public_tokenizers

    return tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_mod(F.col("doc_id"), 3) == 1
    scored = toxic_score(docs, toxic_train(docs.where(~held), labels.where(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "n_passages")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), encoder_paths())


def op5_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(table(spark, sf_dir, "embeddings"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), by_remainder(7, 2))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_toxicity": op2_toxicity,
        "op3_token_counts": op3_token_counts,
        "op4_packing": op4_packing,
        "op5_vector_duplicates": op5_vector_duplicates,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_mixing": op7_mixing,
        "op8_html_text": op8_html_text,
        "op9_line_dedup": op9_line_dedup,
        "op10_minhash": op10_minhash,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": mixing.ORACLE, "op9_line_dedup": line_dedup.ORACLE}
