"""Corpus pipeline: quality rules, near duplicates, secrets, mixture, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before
kept. All but the last return the columns of documents; the last returns the packed
pieces. ``run`` writes each stage as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marquee.llm import jaccard, mixing, packing, quality_rules, secrets
from marquee.plans.staging import discard, staged
from marquee.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    return quality_rules.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return jaccard.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each copy that is taken."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens."""
    _, places = packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), tokens=4096, end_id=1)
    return places.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("secret scan", secret_scan), ("mixture", mixture), ("packing", packed)]

#: Secrets (a trained forest), near duplicates and packing have no SQL. tests/llm/test_brute_force.py holds all five stages
#: together against a plain-Python version, row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
