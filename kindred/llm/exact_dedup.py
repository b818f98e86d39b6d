"""Exact dedup: a minimal perfect hash over historical distinct digests.

The distinct digests of a historical corpus are split into buckets of a few hundred keys, and
each bucket gets a minimal perfect hash (hash and displace: keys fall into small groups, every
group stores a pilot number that sends its keys to free slots, n keys fill n slots). A slot holds
the full 32-byte digest, the locator of the winner and the group's size. An index is saved in a folder
and can be opened again, by another run, to look later batches up. An incoming digest
computes its slot with two equi-joins (its bucket's pilot, then the slot by number), and is a member only if all
32 bytes of what the slot holds agree; digests that fail this byte check are grouped among themselves.

Scale: text is read once, in one narrow pass that emits (id, digest). Groups of copies are
aggregated on both sides before any look-up, so a text that fills a third of the table costs one
row there. Buckets are sized by the number of distinct digests. Only the final join back to the
rows sees a hot digest, against a side with one row per digest, which AQE can split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import documents, materialize, prepare, scratch, sized, text_sha, without

#: Keys per bucket on average, and keys per pilot.
BUCKET_KEYS, GROUP_KEYS = 512, 4

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _digests(batches):
    for b in batches:
        texts = b.column("__text").cast(pa.large_binary()).to_pylist()
        sha = [hashlib.sha256((t or b"").translate(_FOLD)).digest() for t in texts]
        rest = [b.column(i) for i in range(b.num_columns - 1)]
        names = b.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(sha, pa.binary())], [*names, "sha"])


def digests(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """`columns` of every row and the SHA-256 of its text after lower-casing A-Z (null: empty)."""
    prepare(docs.sparkSession)
    picked = docs.select(*columns, F.col(text).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(_digests, f"{fields}, sha binary")


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of 8-byte integers, as Spark's xxhash64 of a long with the hash so far as seed."""
    rot = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = seed + _P5 + np.uint64(8)
        h = h ^ (rot(x * _P2, 31) * _P1)
        h = rot(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def _slots(base: np.ndarray, pilots: np.ndarray, m: int) -> np.ndarray:
    """pmod(xxhash64(digest, pilot), m), one row per pilot."""
    h = _hash_long(pilots.astype(np.uint64)[:, None], base[None, :]).view(np.int64)
    return np.mod(h, m)


def build_bucket(shas: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimal perfect hash of one bucket: (group of each key, pilot of each group, slot of each key)."""
    m = len(shas)
    groups = max(1, m // GROUP_KEYS)
    base = np.fromiter((xxhash.xxh64_intdigest(s, seed=42) for s in shas), np.uint64, m)
    at = np.fromiter((int.from_bytes(s[8:12], "big") % groups for s in shas), np.int64, m)
    pilots, slots, free = np.zeros(groups, np.int64), np.full(m, -1, np.int64), np.ones(m, bool)
    sizes = np.bincount(at, minlength=groups)
    order = np.argsort(at, kind="stable")
    ends = np.cumsum(sizes)
    for g in np.argsort(-sizes, kind="stable"):
        own = order[ends[g] - sizes[g] : ends[g]]
        if not len(own):
            break
        first, step = 0, 64
        while True:
            tried = _slots(base[own], np.arange(first, first + step), m)
            good = free[tried].all(axis=1)
            if len(own) > 1:
                ordered = np.sort(tried, axis=1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            hit = np.flatnonzero(good)
            if len(hit):
                pilots[g], slots[own] = first + hit[0], tried[hit[0]]
                free[slots[own]] = False
                break
            first, step = first + step, min(4096, step * 2)
            if first > 1 << 26:
                raise RuntimeError("two digests of a bucket share all hash bits")
    return at, pilots, slots


_INDEX = "kind int, bucket long, idx long, pilot long, sha binary, winner long, n long"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("sha").reset_index(drop=True)
    _, pilots, slots = build_bucket(list(pdf["sha"]))
    bucket = int(pdf["bucket"].iloc[0])
    a = pd.DataFrame({"kind": 0, "bucket": bucket, "idx": np.arange(len(pilots)), "pilot": pilots, "sha": None, "winner": None, "n": len(pdf)})
    b = pd.DataFrame({"kind": 1, "bucket": bucket, "idx": slots, "pilot": None, "sha": pdf["sha"], "winner": pdf["winner"].astype("Int64"), "n": pdf["n"]})
    for x in (a, b):
        x["winner"], x["pilot"] = x["winner"].astype("Int64"), x["pilot"].astype("Int64")
    return pd.concat([a, b], ignore_index=True)


def _number(sha, start: int, n: int):
    return F.conv(F.hex(F.substring(sha, start, n)), 16, 10).cast("long")


class DigestIndex:
    """A saved perfect hash over distinct digests: pilots (slot_bucket, pilot_group, pilot, slots) and slots (slot_bucket, slot, held, held_winner, held_n)."""

    def __init__(self, table: DataFrame, buckets: int):
        self.table, self.buckets = table, buckets

    @classmethod
    def build(cls, distinct: DataFrame, path: str | None = None) -> DigestIndex:
        """Index of a table (sha, winner, n) of distinct digests, saved under path, or for this run only."""
        keys = distinct.count()
        buckets = max(1, -(-keys // BUCKET_KEYS))
        placed = distinct.select("sha", "winner", "n", (_number(F.col("sha"), 1, 4) % buckets).alias("bucket"))
        table = placed.groupBy("bucket").applyInPandas(_build, _INDEX)
        if path is None:
            return cls(materialize(sized(table, 2 * keys), "mph"), buckets)
        table.withColumn("buckets", F.lit(buckets)).write.parquet(path)
        return cls.open(distinct.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DigestIndex:
        table = spark.read.schema(f"{_INDEX}, buckets long").parquet(path)
        found = table.select("buckets").first()
        return cls(table.drop("buckets"), found[0] if found else 1)

    def slots(self) -> DataFrame:
        return self.table.where("kind = 1").select(
            F.col("bucket").alias("slot_bucket"), F.col("idx").alias("slot"), F.col("sha").alias("held"), F.col("winner").alias("held_winner"), F.col("n").alias("held_n")
        )

    def slot_of(self, incoming: DataFrame) -> DataFrame:
        """incoming (sha, ...) with slot_bucket and slot: the only place where each digest could be; null in a bucket without keys."""
        pilots = self.table.where("kind = 0").select(F.col("bucket").alias("slot_bucket"), F.col("idx").alias("pilot_group"), "pilot", F.col("n").alias("slots"))
        sizes = pilots.groupBy("slot_bucket").agg(F.count("*").alias("pilot_groups"), F.first("slots").alias("slots_in"))
        placed = incoming.withColumn("slot_bucket", _number(F.col("sha"), 1, 4) % self.buckets).join(sizes, "slot_bucket", "left")
        placed = placed.withColumn("pilot_group", _number(F.col("sha"), 9, 4) % F.col("pilot_groups"))
        found = placed.join(pilots.drop("slots"), ["slot_bucket", "pilot_group"], "left")
        return found.withColumn("slot", F.expr("pmod(xxhash64(sha, pilot), slots_in)")).drop("pilot_group", "pilot_groups", "pilot", "slots_in")

    def look_up(self, incoming: DataFrame) -> DataFrame:
        """incoming (sha, ...) with slot_bucket, slot, what the slot holds (held, held_winner, held_n) and member: whether all its bytes agree."""
        found = self.slot_of(incoming).join(self.slots(), ["slot_bucket", "slot"], "left")
        return found.withColumn("member", F.coalesce(F.col("held") == F.col("sha"), F.lit(False)))


def verdicts(index: DigestIndex, incoming: DataFrame, rows: int | None = None) -> DataFrame:
    """One row per distinct digest of the index and of incoming (sha, winner, n; a row per digest, `rows` at most if that is known): winner is the largest id, n the rows."""
    seen = materialize(sized(index.look_up(incoming), rows), "lookup")
    known = seen.where("member").select("slot_bucket", "slot", "winner", "n")
    held = index.slots().join(known, ["slot_bucket", "slot"], "left").select(
        F.col("held").alias("sha"), F.greatest("held_winner", "winner").alias("winner"), (F.col("held_n") + F.coalesce("n", F.lit(0))).alias("n")
    )
    return held.unionByName(seen.where("NOT member").select("sha", "winner", "n"))


def grouped(rows: DataFrame) -> DataFrame:
    """(sha, winner, n) of rows (doc_id, sha, copies)."""
    return rows.groupBy("sha").agg(F.max("doc_id").alias("winner"), F.sum("copies").alias("n"))


def _halves(rows: DataFrame) -> DataFrame:
    """verdicts() of rows (doc_id, sha, copies): ids up to the middle of their range are the history, the rest comes in against it."""
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    old = F.coalesce(F.col("doc_id") <= (0 if low is None else (low + high) // 2), F.lit(False))
    with scratch() as keep:
        index = DigestIndex.build(materialize(sized(grouped(rows.where(old)), n), "history"))
        return keep(materialize(sized(verdicts(index, grouped(rows.where(~old)), n), n), "verdicts"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """Groups of rows whose texts agree after lower-casing A-Z.

    Returns a row per input row: doc_id, keep_id, group_size, kept, text_sha256. The row with the
    largest id of a group stays. With an index of earlier documents (see DigestIndex), docs come in against it, and a row stays
    only if no earlier document has a larger id. Without one, the table's older half (ids up to the middle of their range) is
    the history that the perfect hash indexes, and the rest comes in against it.

    Defined cases: a null text is the empty text; a null id is smaller than any other and belongs
    to the incoming part; rows that repeat an id and a text are all returned, and only one of
    them stays; other columns are ignored; an empty table gives an empty result.
    """
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__t"))
    rows = materialize(digests(picked, ["doc_id"], "__t").groupBy("doc_id", "sha").agg(F.count("*").alias("copies")), "digests")
    best = verdicts(index, grouped(rows)) if index else _halves(rows)
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return rows.join(best, "sha").select("doc_id", "sha", "winner", "n", copy).select(
        "doc_id",
        F.col("winner").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("winner")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_winners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts (but for the case of A-Z) the one with the largest id.

    Of rows with that id the one with the least digest of the text as it is stays, and of those that repeat both, one.
    """
    with scratch() as keep:
        ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_sha(F.col(text)).alias("raw"), F.col(text).alias("__t"))
        rows = materialize(digests(ids, ["doc_id", "raw"], "__t").groupBy("doc_id", "raw", "sha").agg(F.count("*").alias("copies")), "digests")
        named = rows.join(_halves(rows).drop("n"), "sha").withColumn("top", F.col("doc_id").eqNullSafe(F.col("winner")))
        n = rows.count()
        named = materialize(sized(named, n), "named")
        stay = named.where("top").groupBy("sha").agg(F.min("raw").alias("least"))
        judged = named.join(stay, "sha").select("doc_id", F.col("raw").alias("sha"), "copies", (F.col("top") & (F.col("raw") == F.col("least"))).alias("stays"))
        gone = keep(materialize(sized(judged.where("NOT stays OR copies > 1").drop("copies"), n), "gone"))
    return without(docs, doc_id, text, gone)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g
         AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
