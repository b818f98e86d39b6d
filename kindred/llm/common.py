"""What the corpus operators share: shared storage, tables, worker set-up, hashes."""

from __future__ import annotations

import ctypes
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.plans.storage import discard, materialize, prepare, scratch, shared_root, sized  # noqa: F401

#: Words everywhere in this subpackage: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


#: Rows (of an id and a digest) that may be broadcast: some 30 MB.
FEW = 250_000


def few(df: DataFrame) -> DataFrame:
    """df, a table of ids and digests, to be broadcast if it was counted to have FEW rows at most; else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def text_sha(text: Column) -> Column:
    """SHA-256 of a text's bytes; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def without(docs: DataFrame, doc_id: str, text: str, gone: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, but for those in gone (doc_id, sha, stays: boolean), a row for each id and text_sha.

    Where `stays` holds, one of the rows with that id and text stays (that with the least hash of all columns). Rows are found
    by what they hold, so the result doesn't depend on how docs is split when it is read again.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").cast("long").alias("id"), text_sha(F.col(f"`{text}`")).alias("of"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("sha"))
    out = packed.join(few(gone), same, "left_anti").select("row.*")
    once = gone.where("stays")
    if not once.limit(1).count():
        return out
    whole = F.xxhash64(*[F.col("row").getField(c).cast("string") for c in docs.columns])
    return out.unionByName(packed.join(once, same, "left_semi").groupBy("id", "of").agg(F.min_by("row", whole).alias("row")).select("row.*"))


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once, even if lambdas use them often.

    A one-element generator stands between the columns and what uses them, so the optimizer
    cannot copy their expressions into a lambda, where they would run once per element.
    """
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("__held")
    return df.select("*", made).select(*df.columns, *[F.col(f"__held.{k}").alias(k) for k in columns])


def table_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of literals, without a Python process behind it."""
    kinds = [x.strip().rsplit(" ", 1) for x in schema.split(",")]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in kinds])
    lits = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, kinds)]) for r in rows]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*lits)))


def slices(b, column: int, chars: int = 1 << 20, rows: int = 512):
    """Slices of a record batch, of `rows` rows at most, whose texts (in that column) have about `chars` bytes at most, or one row."""
    each = b.column(column).nbytes // max(1, b.num_rows)
    step = max(1, min(rows, chars // max(1, each)))
    for i in range(0, b.num_rows, step):
        yield b.slice(i, step)


def filter_rows(docs: DataFrame, text: str, judge) -> DataFrame:
    """The rows of docs, with all their columns, for whose text judge() says so.

    judge is called once per task and gives a function from a list of texts (null as empty) to booleans.
    """
    import pyarrow as pa

    at, schema = docs.columns.index(text), docs.schema

    def run(batches):
        good = judge()
        for b in batches:
            for s in slices(b, at):
                texts = [t or "" for t in s.column(at).cast(pa.string()).to_pylist()]
                yield s.filter(pa.array([bool(x) for x in good(texts)], pa.bool_()))

    prepare(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def trimmed(run):
    """A function over batches whose worker gives freed memory back to the system at the end of a task, as workers outlive tasks."""

    @functools.wraps(run)
    def outer(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not every C library can
                pass

    return outer
