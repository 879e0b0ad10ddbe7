"""A training corpus from raw documents: good ones, each text once, each group of near copies once, none
with benchmark passages, encoded.

Every stage takes nulls in any column, empty and very long texts, which count whole, repeated rows, empty tables,
which give empty ones, and further columns, which all but the last pass on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from noticeloom.llm import byte_bpe, decontaminate, exact_dedup, jaccard_forest, quality
from noticeloom.llm.common import table, written
from noticeloom.llm.queries.byte_bpe import VOCABULARY
from noticeloom.llm.queries.quality import LEAST


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts are judged as texts without
    features; repeated rows stay or go together; a score of exactly the threshold stays."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")), LEAST)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: of ties the largest doc_id, of rows that share it one; null texts are empty ones."""
    return exact_dedup.keep_one(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least doc_id; documents without words are alike to none."""
    return jaccard_forest.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items; those without words never are."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens: their number, digest, and that of what they decode to; none for null and empty texts."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("quality classifier", good), ("exact dedup", distinct), ("n-gram Jaccard join", dissimilar), ("benchmark decontamination", clean), ("byte-level BPE", encoded)]

#: Not in SQL: the classifier, the forest and the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
