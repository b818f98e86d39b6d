"""Linking a stream, batch by batch.

Rules without thresholds need no look at other rows, so a stream's rows are linked by their key: the first row with a key
sets the canonical id of all later ones. Keys that were seen are a table in a folder, partitioned by a hash of
the key; a batch reads only the partitions that its keys fall into, and a batch that is run again after a failure finds its own
earlier output and does not count twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.linking import text_of
from kindred.plans.storage import materialize


def drop_duplicates_within(stream: DataFrame, columns: list[str], event_time: str, delay: str) -> DataFrame:
    """Rows whose columns were not seen within `delay` of event time; state is dropped behind the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(columns)


class StreamLinker:
    """Canonical ids for a stream, for use as writeStream.foreachBatch(StreamLinker(...)).

    column: the text to compare, after `preprocessors`; id: a column of distinct ids; folder: where the seen keys are
    kept; sink: called with every batch and its canonical ids, (table, number of the batch).
    """

    PARTS = 64

    def __init__(self, column: str, id: str, folder: str, sink: Callable[[DataFrame, int], None], preprocessors=(), canonical_id: str = "canonical_id"):
        self.column, self.id, self.folder, self.sink = column, id, folder.rstrip("/"), sink
        self.preprocessors, self.canonical_id = tuple(preprocessors), canonical_id

    def _seen(self, spark, batch: int) -> DataFrame | None:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return spark.read.schema(f"key binary, first {self.kind}, batch long, part int").parquet(self.folder).where(F.col("batch") < batch)

    def __call__(self, df: DataFrame, batch: int) -> None:
        spark, self.kind = df.sparkSession, df.schema[self.id].dataType.simpleString()
        key = F.unhex(F.sha2(text_of(self.column, self.preprocessors), 256))
        rows = materialize(df.withColumn("__key", key), "batch")
        part = F.pmod(F.xxhash64("key"), F.lit(self.PARTS)).cast("int")
        firsts = rows.groupBy(F.col("__key").alias("key")).agg(F.min(self.id).alias("first")).withColumn("part", part)
        seen = self._seen(spark, batch)
        if seen is None:
            known, fresh = firsts, firsts
        else:
            old = seen.select("key", F.col("first").alias("old"), "part")
            known = materialize(firsts.join(old, ["part", "key"], "left").select("key", F.coalesce("old", "first").alias("first"), "part", F.col("old").isNull().alias("new")), "known")
            fresh = known.where("new").drop("new")
        ids = known.select(F.col("key").alias("__key"), F.col("first").alias(self.canonical_id))
        out = materialize(rows.drop(self.canonical_id).join(ids, "__key").drop("__key"), "linked")
        # One folder per batch: written again as a whole if the batch is run again.
        fresh.repartition(F.col("part")).write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/batch={batch}")
        self.sink(out, batch)
