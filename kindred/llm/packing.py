"""Best-fit packing by exact-complement hashing.

Tokenised documents (longer ones cut into full pieces and a rest) are packed into sequences of at most
SIZE tokens. Only the number of pieces of each length matters, so the plan is made from a histogram of SIZE
counts: from the longest length down, the gap that a piece leaves is looked up among the single lengths, the sums
of pairs and the sums of triples that are still available; a combination that fills the gap exactly is
consumed as often as its counts allow. What finds no exact complement is packed by best fit: a piece goes
to the smallest gap that holds it.

Scale: text is read once. The histogram and the plan (a few thousand patterns with multiplicities) do not
grow with the table. A piece gets its number among those of its length from its number within its task plus an
offset per task and length, so no length, however frequent, is sorted or gathered in one task; the number
then finds its pattern by a binary search in the plan.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.bpe import encoder, vocabulary_path
from kindred.llm.common import documents, materialize, prepare, sized, slices

SIZE = 2048
_RANK_BITS = 48


class _Counts:
    """Available pieces by length, and which sums of two of them exist."""

    def __init__(self, counts: np.ndarray):
        self.c = counts
        self.size = len(counts) - 1
        self.pairs: np.ndarray | None = None

    def take(self, lengths: tuple[int, ...], most: int) -> int:
        """Consume a combination as often as possible, `most` times at most."""
        need = np.bincount(lengths, minlength=self.size + 1)
        n = int(min(most, *(self.c[x] // need[x] for x in set(lengths))))
        for x in lengths:
            self.c[x] -= n
        if any(self.c[x] == 0 or self.c[x] == 1 for x in lengths):
            self.pairs = None
        return n

    def pair(self, total: int) -> tuple[int, ...] | None:
        """Two available lengths of that sum; the pair that can be consumed most often."""
        if total < 2:
            return None
        a = np.arange(1, total // 2 + 1)
        both = np.minimum(self.c[a], self.c[total - a])
        if total % 2 == 0:
            both[-1] = self.c[total // 2] // 2
        best = int(both.argmax())
        return (int(total - a[best]), int(a[best])) if both[best] > 0 else None

    def triple(self, total: int) -> tuple[int, ...] | None:
        if total < 3:
            return None
        if self.pairs is None:
            have = (self.c > 0).astype(np.float64)
            sums = np.rint(np.convolve(have, have)[: self.size + 1])
            twice = np.arange(0, self.size // 2 + 1) * 2
            alone = (self.c[: self.size // 2 + 1] == 1).astype(np.float64)
            sums[twice] -= alone  # one piece is no pair with itself
            self.pairs = sums > 0
        a = np.arange(1, total - 1)
        for x in a[(self.c[a] > 0) & self.pairs[total - a]][::-1]:
            self.c[x] -= 1
            rest = self.pair(int(total - x))
            self.c[x] += 1
            if rest:
                return (int(x), *rest)
        return None


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a sequence's pieces, number of such sequences) that use up all counts.

    Where short pieces are scarce, complements of several of them cost more sequences than they save. So plans whose
    complements are triples, pairs and singles, pairs and singles, singles only, or none are made in turn, up to the first that
    no plan can beat; the one with the fewest sequences is taken.
    """
    least = -(-sum(k * n for k, n in counts.items()) // size)
    best: tuple[int, list] | None = None
    for most in (3, 2, 1, 0):
        made = _plan(counts, size, most)
        used = sum(n for _, n in made)
        if best is None or used < best[0]:
            best = (used, made)
        if best[0] == least:
            break
    return best[1]


def _plan(counts: dict[int, int], size: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """A plan in which exact complements have `most` pieces at most."""
    c = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        c[length] = n
    left, out = _Counts(c), []
    if c[size]:
        out.append(((size,), int(c[size])))
        c[size] = 0
    rest: dict[int, int] = {}
    for length in range(size - 1, 0, -1):
        while c[length] > 0:
            gap = size - length
            # The piece itself is set aside while its complement is looked for.
            c[length] -= 1
            found = (gap,) if most and c[gap] > 0 else (most > 1 and left.pair(gap)) or (most > 2 and left.triple(gap))
            c[length] += 1
            n = left.take((length, *found), 1 << 60) if found else 0
            if not n:
                rest[length] = int(c[length])
                c[length] = 0
                left.pairs = None
                break
            out.append(((length, *found), n))
    # Best fit of the rest; sequences with the same pieces are one entry with a count.
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    gaps = np.zeros(size + 1, bool)

    def put(pattern: tuple[int, ...], n: int) -> None:
        gap = size - sum(pattern)
        at = open_.setdefault(gap, {})
        at[pattern] = at.get(pattern, 0) + n
        gaps[gap] = True

    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            fits = np.flatnonzero(gaps[length:])
            if not len(fits):
                per = size // length
                if n >= per:
                    put((length,) * per, n // per)
                    n %= per
                if n:
                    put((length,) * n, 1)
                break
            gap = length + int(fits[0])
            pattern, have = next(iter(open_[gap].items()))
            used = min(n, have)
            if used == have:
                del open_[gap][pattern]
                gaps[gap] = bool(open_[gap])
            else:
                open_[gap][pattern] = have - used
            put((*pattern, length), used)
            n -= used
    return out + [x for at in open_.values() for x in at.items()]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length, first number) keys, and the sequence of that number and the offset of each."""
    used: dict[int, int] = {}
    keys, first, offsets, base = [], [], [], 0
    for lengths, n in patterns:
        at = 0
        for x in lengths:
            keys.append((x << _RANK_BITS) | used.get(x, 0))
            first.append(base)
            offsets.append(at)
            used[x] = used.get(x, 0) + n
            at += x
        base += n
    order = np.argsort(np.array(keys, np.int64))
    return np.array(keys, np.int64)[order], np.array(first, np.int64)[order], np.array(offsets, np.int64)[order]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def pieces(docs: DataFrame, path: str, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document, each with its number among those of its length in its task."""

    def run(batches):
        e, seen, task = encoder(path), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        width = 4 * size
        for b in batches:
            for s in slices(b, 1, 1 << 21):
                rows = []
                for key, coded in zip(s.column(0).to_pylist(), e.encode_batch([t or "" for t in s.column(1).to_pylist()])):
                    ids = coded.astype("<u4").tobytes() + b"\0\0\0\0"
                    for i in range(0, len(ids), width):
                        part = ids[i : i + width]
                        n = len(part) // 4
                        rows.append((key, i // width, i // 4, n, zlib.crc32(part), task, int(seen[n])))
                        seen[n] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                columns = zip(*rows) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _PIECES.split(", ")])

    prepare(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _PIECES)


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids end with id 0, so a null or empty text is one piece of length 1. Only documents of more
    than `size` ids are cut. Defined cases: a null id is passed on, repeated rows are packed as often as they
    come, other columns are ignored, an empty table gives an empty result.
    """
    cut = materialize(pieces(docs, path or vocabulary_path(), size, doc_id, text), "pieces")
    counted = materialize(sized(cut.groupBy("length", "task").agg(F.count("*").alias("n")), cut.count()), "lengths")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counted.select("length", "task", before.alias("before"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `size` rows at most
    keys, first, places = _slots(plan(histogram, size))

    def assign(batches):
        for b in batches:
            length, nth = b.column("length").to_numpy(), b.column("number").to_numpy()
            at = np.searchsorted(keys, (length << _RANK_BITS) | nth, side="right") - 1
            sequence = first[at] + nth - (keys[at] & ((1 << _RANK_BITS) - 1))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], pa.array(sequence, pa.int64()), pa.array(places[at], pa.int64())], [*b.schema.names[:5], "sequence_id", "offset"])

    numbered = cut.join(offsets, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("number"))
    return numbered.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
