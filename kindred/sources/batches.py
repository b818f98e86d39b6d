"""Tables that grow: reading a folder of tables, and appending a batch to a table that has canonical ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.plans.rowid import dense

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def append_batch(existing: DataFrame, new: DataFrame, canonical_id: str = "canonical_id") -> DataFrame:
    """existing, then new with canonical ids that go on after the largest one. Columns only one side has are null.

    Link the result with canonicalize(id=canonical_id): rows of the batch get the ids of the rows they are like.
    """
    top = existing.agg(F.coalesce(F.max(canonical_id), F.lit(-1)).cast("long")).first()[0]
    fresh = new.drop(canonical_id)
    numbered = dense(fresh, canonical_id).withColumn(canonical_id, F.col(canonical_id) + (top + 1))
    return existing.unionByName(numbered, allowMissingColumns=True)
