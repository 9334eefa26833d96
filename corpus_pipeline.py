"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

toxicity and quality drop the documents they reject, exact_dedup keeps one of each group of equal texts, near_dedup one
of each component of near copies (five-word shingles, Jaccard of at least 0.8), and packing lays what is left
into sequences of at most 1024 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoskein.llm import exact_dedup, jaccard_join, packing, quality, toxicity
from geoskein.llm.common import materialise, table

#: Networks and regression can't be expressed in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def _accepted(docs: DataFrame, scores: DataFrame, wanted: int) -> DataFrame:
    """Rows of docs whose id is scored `wanted`; rows of one id with scores of both kinds stay where they are wanted in all."""
    verdict = scores.groupBy(F.col("doc_id").alias("id")).agg(F.min((F.col("predicted") == wanted).cast("int")).alias("ok")).filter("ok = 1")
    return docs.alias("d").join(verdict.alias("v"), F.col("d.doc_id").eqNullSafe(F.col("v.id")), "left_semi")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network doesn't mark."""
    scores = toxicity.scored(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))
    return _accepted(docs, scores, 0)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scores = quality.scored(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))
    return _accepted(docs, scores, 1)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal normalised text, that with the smallest id."""
    return exact_dedup.deduplicate(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that with the smallest id; documents without words all stay."""
    found = jaccard_join.joined(docs, width=5, cut=(80, 100))
    stays = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) | (F.col("n_shingles") == 0)).select(F.col("doc_id").alias("id")).distinct()
    return docs.alias("d").join(stays.alias("v"), F.col("d.doc_id").eqNullSafe(F.col("v.id")), "left_semi")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), encode_special_tokens=False)


STAGES = [("toxicity", toxicity_stage), ("quality", quality_stage), ("exact_dedup", exact_dedup_stage), ("near_dedup", near_dedup_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last through a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
