"""Corpus pipeline: quality classifier, quality rules, near duplicates, packing.

Each stage reads what its predecessor kept, as Parquet. All but the last return the columns of ``documents``; the
last returns the packed pieces of the documents that are left.

Edge cases, in every stage: columns of any further names pass through; an empty table gives an empty result; repeated
rows are judged alike. What a stage does with nulls, empty texts and ties stands with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from almanac.llm import ngram_join, packing, quality_classifier, quality_rules
from almanac.llm.common import drop_tables, shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good: whose score reaches the threshold, equality included.

    Null and empty texts score the sample's mean label; without usable labels all documents stay.
    """
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"), quality_classifier.THRESHOLD)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither base nor calibrated rules reject; null, empty and short texts fail the base rules.

    A null language is a stratum of its own. A measure that equals its cutoff is not rejected.
    """
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id, null last; of equal ids, of the smallest text hash.

    Rows equal in both stay once. Null and empty texts are near copies of nothing, and all stay.
    """
    return ngram_join.keep_first(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in packed sequences; a null or empty text is one piece, the separator.

    Pieces of one length are told apart by checksum and place, so ties are packed alike at each run.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier_stage),
    ("quality_rules", quality_rules_stage),
    ("near_duplicates", near_duplicates_stage),
    ("packing", packing_stage),
]

#: Votes, calibrated cutoffs, shingle sets and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again.

    A written result is deleted once the next stage's is there; the last stage writes what it reads of its predecessor.
    """
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/almanac-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if held is not None:
            drop_tables(held)
        docs = held = spark.read.parquet(path)
    found = STAGES[-1][1](spark, docs, sf_dir)
    drop_tables(held)
    return found
