"""The corpus pipeline: toxicity, language, exact copies, near copies, packing.

Every stage takes (spark, docs, directory of the tables) and returns a table; its result is written as Parquet and read
again as the docs of the next one. All but the last return the columns of documents. A table without rows passes through
every stage; nulls, repeated rows and extra columns are handled as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm.common import documents, labels, materialize
from kindred.llm.exact_dedup import keep_winners
from kindred.llm.language_id import keep_known_languages
from kindred.llm.near_dedup import keep_one_per_group
from kindred.llm.packing import pack
from kindred.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return drop_toxic(docs, labels(spark, sf_dir))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones show."""
    return keep_known_languages(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z) the document with the largest id."""
    return keep_winners(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (a similarity of 0.8 or more) the document with the smallest id."""
    return keep_one_per_group(docs, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their places in sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: Learned grammars, filters and tokenizers can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
