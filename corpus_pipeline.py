"""Training-data pipeline: toxic documents go, then documents without a clear language, then near copies; the rest
is packed into windows. Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportloom.llm import language, near_duplicates, packing, queries, toxicity
from reportloom.llm.common import dropped, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring under 0.7 by the multiple-instance model, all columns."""
    return toxicity.keep_clean(docs, toxicity.fit_toxicity(docs, queries.table(spark, sf_dir, "labels")))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the fused evidence tells, all columns."""
    return language.keep_identified(docs, language.fit_text_model(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five words, similarity 0.8), all columns."""
    return near_duplicates.keep_one_each(docs, words=5, threshold=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in windows of 2048 tokens."""
    return packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("language", drop_unidentified), ("near_duplicates", drop_near_copies), ("packing", pack)]

#: Trained models, MinHash and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage keeps is written before the next one reads it."""
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, before = written(stage(spark, docs, sf_dir)), docs
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
