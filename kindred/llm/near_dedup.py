"""MinHash near-dedup by a multi-index Hamming join.

A document is its set of distinct five-word shingles, and its signature has COMPONENTS min-hashes of 16 bits. Two
signatures are candidates if they differ in a distance of components at most, which BOUNDS has for each threshold: for a pair
at a similarity of 0.85 (op5) the number of differing components is binomial (64, 0.15), which exceeds 19 with a chance of
0.0008; at 0.8 (the stage of the pipeline) it is binomial (64, 0.2), which exceeds 25 with a chance of 0.00013.

The join is exact for signatures: they are cut into distance // 2 + 1 chunks, so by the pigeonhole principle a
pair within the distance differs in one component of some chunk at most. For every chunk, the index holds a key for
each choice of the one component that may be wrong (the rest of the chunk), so such a pair shares a key. No bucket is
capped. Pairs are confirmed on the full shingle sets, and confirmed links are closed to components.

Large groups cost few pairs: equal sets are one class before anything else. Then each bucket compares its members with
its first member only (a star), and stars that are confirmed merge into components. What a star can't settle are
members of one bucket in different components. A bucket of BLOCK members at most is compared inside one task. In a larger one
the members of its largest component meet only the others, BLOCK by BLOCK; if those others are many blocks, the bucket is
first cut by a second choice of chunks (which again gives every pair within the distance a key in common), and so on, so
that a row is copied SPLIT times a level at most. A pair leaves
the task only if it is within the distance and if a sketch of SKETCH bits doesn't refute it: at the threshold the
number of differing bits is binomial (2048, 0.075 or 0.1), which exceeds 207 or 265 with a chance of 0.00001. For each member the WAVE nearest
in other components come first, which merges most of them; buckets in which some were left out go on, with sixteen times as
many each time, until none is cut short, so no such pair between different components is left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import documents, few, materialize, prepare, scratch, sized, slices, text_sha, without
from kindred.operators.components import connected_components

WORDS, COMPONENTS, DISTANCE, PERCENT = 5, 64, 19, 85
SKETCH, FAR = 2048, 207
#: Threshold in percent -> components and sketch bits in which a pair may differ.
BOUNDS = {PERCENT: (DISTANCE, FAR), 80: (25, 265)}
BLOCK, WAVE = 2048, 16
#: A bucket whose members outside its largest component fill more blocks is dealt anew, by other chunks, up to LEVELS times.
SPLIT, LEVELS = 32, 6

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(20240501)
_A = _RNG.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.arange(COMPONENTS, dtype=np.uint64) * _M
_A2 = _RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B2 = _RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: five words, or the whole sequence if there are fewer."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    s = np.zeros(n, np.uint64)
    for i in range(WORDS):
        s = s * _M + h[i : i + n]
    return np.unique(_mix(s))


def signature(s: np.ndarray) -> np.ndarray:
    least = np.full(COMPONENTS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        least = np.minimum(least, (s[i : i + 4096, None] * _A + _B).min(axis=0))
    return (_mix(least) & np.uint64(0xFFFF)).astype("<u2")


def sketch(s: np.ndarray) -> np.ndarray:
    """A bit of each of SKETCH min-hashes, packed."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 256):
        least = np.minimum(least, (s[i : i + 256, None] * _A2 + _B2).min(axis=0))
    return np.packbits((_mix(least) & np.uint64(1)).astype(bool))


def _signed(batches):
    for b in batches:
        for s in slices(b, 2):
            n, whole, sigs = [], [], []
            for t in s.column(2).to_pylist():
                x = shingles(t or "")
                n.append(len(x))
                whole.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                sigs.append(signature(x).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "sha", "n", "whole", "sig"])


def _sets(batches):
    """(node, shingles); a node that comes several times in a row is given once."""
    last = None
    for b in batches:
        for s in slices(b, 1):
            nodes, sets = [], []
            for node, t in zip(s.column(0).to_pylist(), s.column(1).to_pylist()):
                if node != last:
                    nodes.append(node)
                    sets.append(shingles(t or "").tobytes())
                last = node
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])


def _sketched(batches):
    """(node, both): the signature, then the sketch."""
    for b in batches:
        both = [x + sketch(np.frombuffer(y, np.uint64)).tobytes() for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(both, pa.binary())], ["node", "both"])


def _matrix(column, width: int = COMPONENTS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, width)


def keys_of(sigs: np.ndarray, distance: int = DISTANCE, level: int = 0) -> np.ndarray:
    """A key per signature and component: its chunk without that component. Each level cuts the components, in an order of its own, anew."""
    chunks = distance // 2 + 1
    bounds = np.linspace(0, COMPONENTS, chunks + 1).astype(int)
    x = _mix(sigs.astype(np.uint64) + (np.arange(COMPONENTS, dtype=np.uint64) << np.uint64(20)))
    if level:
        x = x[:, np.random.default_rng(level).permutation(COMPONENTS)]
    out = np.empty((len(sigs), COMPONENTS), np.uint64)
    for a, b in zip(bounds, bounds[1:]):
        total = x[:, a:b].sum(axis=1)
        for i in range(a, b):
            out[:, i] = _mix(total - x[:, i] + _SALT[i])
    return out.view(np.int64)


def _keyed(distance: int, level: int = 0):
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                s = b.slice(i, 2048)
                keys = keys_of(_matrix(s.column(1)), distance, level)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(s.column(0).to_numpy(), COMPONENTS))], ["key", "node"])

    return run


def _near(distance: int):
    """Pairs (u, v, sig_u, sig_v) within the distance."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                apart = (_matrix(b.column(2)) != _matrix(b.column(3))).sum(axis=1)
                s = b.filter(pa.array(apart <= distance))
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1)], ["u", "v"])

    return run


def _similar(percent: int):
    """(u, v, linked) of pairs with both sets."""

    def run(batches):
        for b in batches:
            for s in slices(b, 2):
                linked = []
                for x, y in zip(s.column(2).to_pylist(), s.column(3).to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        linked.append(False)
                        continue
                    z = np.concatenate([x, y])
                    z.sort()
                    both = int((z[1:] == z[:-1]).sum())
                    linked.append(100 * both >= percent * (len(z) - both))
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(linked, pa.bool_())], ["u", "v", "linked"])

    return run


def _cross(wave: int, distance: int, far_bits: int):
    """For rows (place, side, node, comp, key, leaf, both) sorted by place: pairs of a place in different components that may be alike.

    side 0 is compared with side 1, and side 2 with itself. A pair with several keys in common
    is given in the bucket of the first of them only, and for each member the `wave` nearest; where more were
    left out, a row (-1, leaf) says so.
    """

    def block(side, node, comp, key, leaf, both):
        alone = side[0] == 2
        left, right = (np.arange(len(side)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        sig, bits = np.ascontiguousarray(both[:, :COMPONENTS]), np.ascontiguousarray(both[:, COMPONENTS:]).view(np.uint64)
        keys, own = keys_of(sig, distance), key[0]
        us, vs, cut = [], [], False
        for i in range(0, len(left), 32):
            rows = left[i : i + 32]
            apart = (sig[rows][:, None, :] != sig[right][None, :, :]).sum(axis=2)
            a, b = np.nonzero((apart <= distance) & (comp[rows][:, None] != comp[right][None, :]))
            far = np.bitwise_count(bits[rows[a]] ^ bits[right[b]]).sum(axis=1, dtype=np.int64)
            a, b, far = (x[far <= far_bits] for x in (a, b, far))
            mine = keys[rows[a]]
            shared = mine == keys[right[b]]
            first = mine[np.arange(len(a)), shared.argmax(axis=1)] == own
            a, b, far = (x[first] for x in (a, b, far))
            if not len(a):
                continue
            order = np.lexsort((node[right[b]], far, a))
            a, b = a[order], b[order]
            start = np.maximum.accumulate(np.where(np.r_[True, a[1:] != a[:-1]], np.arange(len(a)), 0))
            keep = np.arange(len(a)) - start < wave
            cut |= not keep.all()
            us.append(node[rows[a[keep]]])
            vs.append(node[right[b[keep]]])
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
        u, v = np.minimum(u, v), np.maximum(u, v)
        if alone and len(u):  # both ends may have named the pair
            u, v = np.unique(np.stack([u, v]), axis=1)
        return u, v, cut

    def run(batches):
        held: list[tuple] = []

        def done(parts):
            side, node, comp, key, leaf, both = (np.concatenate([p[i] for p in parts]) for i in range(6))
            if comp.min() == comp.max():
                return None
            u, v, cut = block(side, node, comp, key, leaf, both)
            if cut:
                u, v = np.r_[u, -1], np.r_[v, leaf[0]]
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"]) if len(u) else None

        place = None
        for b in batches:
            if not b.num_rows:
                continue
            p = b.column(0).to_numpy()
            columns = [b.column(i).to_numpy() for i in (1, 2, 3, 4, 5)] + [_matrix(b.column(6), COMPONENTS + SKETCH // 16)]
            edges = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
            for i, j in zip(edges, edges[1:]):
                if held and p[i] != place:
                    if (out := done(held)) is not None:
                        yield out
                    held = []
                place = p[i]
                held.append(tuple(c[i:j] for c in columns))
        if held and (out := done(held)) is not None:
            yield out

    return run


def _sides(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """pairs (u, v) with the column of both nodes."""
    side = lambda end: values.select(F.col("node").alias(end), F.col(column).alias(f"of_{end}"))
    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "of_u", "of_v")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v, linked) of distinct pairs, a table."""
    made = _sides(pairs, sets, "shingles").mapInArrow(_similar(percent), "u long, v long, linked boolean")
    return materialize(sized(made, 32 * pairs.count()), "confirmed")  # two sets a row


def _labelled(links: DataFrame) -> DataFrame:
    return connected_components(links.where("linked").select("u", "v"))


def _crowded(members: DataFrame) -> DataFrame:
    """(leaf, top, inside, outside) of leaves (leaf, comp) with more than BLOCK members: the largest component, its members, all others."""
    each = members.where(F.col("members") > BLOCK).groupBy("leaf", "comp").agg(F.count("*").alias("n"))
    by = each.groupBy("leaf").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"))
    return by.select("leaf", F.col("top.comp").alias("top"), F.col("top.n").alias("inside"), (F.col("all") - F.col("top.n")).alias("outside"))


def _places(members: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """members (leaf, key, node, comp) with place and side, so that all members of different components meet somewhere.

    A leaf of BLOCK members at most is one place. In a larger one, BLOCK of the largest component meet BLOCK of the others at a
    time, and BLOCK of the others each other; the members of the largest component don't meet.
    """
    columns = ["side", "node", "comp", "key", "leaf"]
    if crowded is None:
        return members.select(F.col("leaf").alias("place"), F.lit(2).alias("side"), *columns[1:])
    met = members.join(crowded, "leaf", "left")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    own = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    at = lambda kind, a, b, side: F.struct(F.xxhash64("leaf", F.lit(kind), a, b).alias("place"), side.cast("int").alias("side"))
    inner, outer = blocks("inside"), blocks("outside")
    from_top = F.transform(upto(outer), lambda j: at("top", own(inner), j, F.lit(0)))
    to_top = F.transform(upto(inner), lambda i: at("top", i, own(outer), F.lit(1)))
    others = F.transform(upto(outer), lambda j: at("rest", F.least(own(outer), j), F.greatest(own(outer), j), F.when(own(outer) == j, 2).when(own(outer) < j, 0).otherwise(1)))
    where = F.when(F.col("top").isNull(), F.array(F.struct(F.col("leaf").alias("place"), F.lit(2).alias("side")))).when(F.col("comp") == F.col("top"), from_top).otherwise(F.concat(to_top, others))
    return met.select(F.explode(where).alias("at"), *columns[1:]).select("at.place", "at.side", *columns[1:])


def _finer(several: DataFrame, leaves: DataFrame, sigs: DataFrame, distance: int, level: int) -> DataFrame:
    """several (leaf, key, node, members) with the members of `leaves` dealt anew by the keys of a level.

    Any cut of the components into chunks gives each pair within the distance a key in common, so no such pair is lost.
    """
    stay = several.join(leaves, "leaf", "left_anti")
    dealt = materialize(several.join(leaves, "leaf").select("leaf", "key", "node"), "dealt")
    keys = sigs.join(dealt.select("node").distinct(), "node").select("node", "sig").mapInArrow(_keyed(distance, level), "finer long, node long")
    dealt = dealt.join(keys, "node").select(F.xxhash64("leaf", "finer", F.lit(level)).alias("leaf"), "key", "node")
    sizes = dealt.groupBy("leaf").agg(F.count("*").alias("members")).where("members > 1")
    return materialize(stay.unionByName(dealt.join(materialize(sizes, "sizes"), "leaf").select("leaf", "key", "node", "members")), "several")


def near_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """From docs (doc_id, text): rows (doc_id, sha, n, root). Rows with one root are linked, those without shingles have none.

    sha is the digest of the text. Sets are linked from a similarity of percent / 100 on. Rows are told apart by doc_id and
    sha only, so it doesn't matter how docs is split when it is read again.
    """
    distance, far = BOUNDS[percent]
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", text_sha(F.col("text")).alias("sha"), "text")
    with scratch() as keep:
        signed = materialize(docs.mapInArrow(_signed, "doc_id long, sha binary, n long, whole binary, sig binary"), "signed")
        n = signed.count()
        least = F.min(F.struct("doc_id", "sha", "sig"))
        classes = signed.where("n > 0").groupBy("whole").agg(least.alias("own")).select("whole", "own.*")
        classes = materialize(sized(classes.select(F.monotonically_increasing_id().alias("node"), "*"), n), "classes")
        sigs = classes.select("node", "sig")
        keyed = sigs.mapInArrow(_keyed(distance), "key long, node long")
        shared = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("members")).where("members > 1")
        shared = materialize(sized(shared, n * COMPONENTS // 8), "shared")  # narrow rows
        buckets = materialize(sized(keyed.join(shared, "key").select("key", "node", "first", "members"), n * COMPONENTS // 8), "buckets")
        m = buckets.count()
        stars = buckets.where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v")).distinct()
        stars = materialize(sized(_sides(stars, sigs, "sig").mapInArrow(_near(distance), "u long, v long"), 2 * m), "stars")
        wanted = materialize(sized(classes.join(buckets.select("node").distinct(), "node").select("node", F.col("doc_id").alias("of"), F.col("sha").alias("of_sha")), n), "wanted")
        texts = docs.join(few(wanted), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("sha") == F.col("of_sha"))).select("node", "text")
        sets = materialize(texts.mapInArrow(_sets, "node long, shingles binary"), "sets")
        if sets.groupBy("node").count().where("count > 1").limit(1).count():  # rows that repeat an id and a text, in several tasks
            sets = materialize(sets.dropDuplicates(["node"]), "sets")
        links = _confirm(stars, sets, percent)
        roots = _labelled(links)
        several = buckets.where("members > 2").select(F.col("key").alias("leaf"), "key", "node", "members")
        named = lambda df: df.join(roots, "node", "left").select("leaf", "key", "node", "members", F.coalesce("root", "node").alias("comp"))

        def unlike(df):
            df = materialize(sized(named(df), m), "named")
            both = df.groupBy("leaf").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("leaf")
            return materialize(sized(df.join(materialize(sized(both, m), "open"), "leaf"), m), "members")

        members, level = unlike(several), 0
        while level < LEVELS and (large := materialize(_crowded(members).where(F.col("outside") > SPLIT * BLOCK).select("leaf"), "large")).limit(1).count():
            level += 1
            finer = _finer(members.drop("comp"), large, sigs, distance, level)
            m = finer.count()
            members = unlike(finer)
        nodes = members.select("node").distinct()
        both = materialize(sized(sigs.join(nodes, "node").join(sets, "node").select("node", "sig", "shingles").mapInArrow(_sketched, "node long, both binary"), 32 * n), "sketches")
        wave = WAVE
        while True:
            crowded = materialize(_crowded(members), "crowded") if members.where(F.col("members") > BLOCK).limit(1).count() else None
            dealt = _places(members, crowded).join(both, "node").select("place", "side", "node", "comp", "key", "leaf", "both")
            found = materialize(dealt.repartition("place").sortWithinPartitions("place").mapInArrow(_cross(wave, distance, far), "u long, v long"), "found")
            cut, more = found.agg(F.count_if(F.col("u") < 0), F.count_if(F.col("u") >= 0)).first()
            if more:
                new = materialize(sized(found.where("u >= 0").distinct().join(links.select("u", "v"), ["u", "v"], "left_anti"), more), "new")
                links = links.unionByName(_confirm(new, sets, percent))
                roots = _labelled(links)
            if not cut:
                break
            wave *= 16
            left = materialize(sized(found.where("u < 0").select(F.col("v").alias("leaf")).distinct(), cut), "left")
            members = unlike(members.drop("comp").join(left, "leaf", "left_semi"))
        named = signed.drop("sig").join(classes.select(F.col("whole").alias("of"), "node"), (F.col("whole") == F.col("of")) & (F.col("n") > 0), "left").join(roots, "node", "left")
        return keep(materialize(sized(named.select("doc_id", "sha", "n", F.coalesce("root", "node").alias("root")), n), "rooted"))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Defined cases: a null or wordless text has no shingles and is linked with nothing; rows that repeat an id are
    rows of their own, which are kept or dropped alike; a null id is never the smallest unless its component has no
    other, and then component_id is null; other columns are ignored; an empty table gives an empty result.
    """
    named = near_classes(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    least = materialize(named.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    out = named.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each component the one with the smallest id (null last), then text digest.

    Of rows that repeat both, one stays. Rows without words all stay.
    """
    with scratch() as keep:
        named = near_classes(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), percent)
        n = named.count()
        rows = materialize(sized(named.where("root IS NOT NULL").groupBy("root", "doc_id", "sha").agg(F.count("*").alias("copies")), n), "rows")
        order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("sha").alias("c"))
        best = rows.groupBy("root").agg(F.min(order).alias("best"))
        judged = rows.join(best, "root").select("doc_id", "sha", "copies", F.coalesce(F.col("doc_id").eqNullSafe(F.col("best.b")) & (F.col("sha") == F.col("best.c")), F.lit(False)).alias("stays"))
        gone = keep(materialize(sized(judged.where("NOT stays OR copies > 1"), n), "gone"))
    return without(docs, doc_id, text, gone)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))
