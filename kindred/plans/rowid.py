"""Row numbers that stay the same however often the table is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.plans.storage import materialize


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Ascending, distinct numbers in the order of the input, with gaps. The copy in shared storage fixes them."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def dense(df: DataFrame, name: str, order_by=()) -> DataFrame:
    """Numbers from 0 without gaps, in the order of the input or of order_by (which is a range sort, not one task)."""
    table = numbered(df.orderBy(*order_by) if order_by else df, name)
    part = F.shiftright(name, 33)
    sizes = table.groupBy(part.alias("__part")).agg(F.count("*").alias("n"), F.min(name).alias("__low"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(sizes.select("__part", "__low", before.alias("__before")), "offsets")  # a row per task that wrote the table
    met = table.join(F.broadcast(offsets), part == F.col("__part"))
    return met.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(name) - F.col("__low") + F.col("__before")).alias(name))
