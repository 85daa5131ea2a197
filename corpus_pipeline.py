"""A corpus pipeline: toxicity, line dedup, near-duplicate removal, mixing and packing, each stage on what the last one kept.

Input cases: a null or empty text is not toxic, has no lines to lose, is no near duplicate, is drawn like any other and packed as its end id; a null id
is learnt from by no stage, is the earliest in line dedup, stays in near-duplicate removal and mixing, and is packed; repeated rows are judged alike: they lose the same
lines, stay or go together, and each is packed; null languages and sources are values of their own; further columns, whatever their names, pass through all
stages but the last; empty tables give an empty result, and without labels nothing is rejected as toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import stored, table
from sluice.llm.line_dedup import dedup_lines
from sluice.llm.minhash import near_duplicates
from sluice.llm.mixing import mix
from sluice.llm.packing import pack_documents
from sluice.llm.queries import encoder_paths
from sluice.llm.toxicity import PREDICT, score_column, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents predicted toxic."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.where(score_column(spark, model) < PREDICT)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated lines; documents that lose all their words go."""
    return dedup_lines(docs, drop_emptied=True)


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five-word shingles, 0.8)."""
    gone = near_duplicates(docs, shingle=5, percent=80).where(~F.col("kept")).select("doc_id")
    # their ids grow with the input, so they are never broadcast
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics come near their target weights."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1024 tokens."""
    return pack_documents(docs, encoder_paths())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash", minhash), ("mixing", mixing), ("packing", packing)]

#: The learnt toxicity stage has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
