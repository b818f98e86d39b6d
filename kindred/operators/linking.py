"""From rules to groups of rows, as DataFrame plans.

A rule turns keys (rid, __block, cid, columns) into groups: (rid, __block, cid, g), rows with equal g being alike. Exact
and key rules use the value itself as g and predicates a constant; the others collapse equal values first, relate distinct
values by a candidate join, and take the connected component as g. Payload columns never enter these plans, and a
text travels with its rows as a digest only.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions import minhash
from kindred.functions.ratios import BOUNDED, similar_pairs, sorted_words
from kindred.operators.components import connected_components, forest
from kindred.operators.rules import WEIGHTING, Rule
from kindred.plans.storage import materialize

#: Links up to this number are closed on the driver; beyond, by rounds of joins.
FEW_LINKS = 100_000
TILE = 1500
#: Values of a tile of vectors at most.
LARGE_TILE = 16_384
#: Parts that a value may have where values meet by shared parts; beyond, they meet by other candidate joins.
PARTS = 512


def text_of(columns: str, preprocessors=(), placeholder: str | None = "na") -> Column:
    c = F.col(f"`{columns}`").cast("string")
    if placeholder is not None:
        c = F.coalesce(c, F.lit(placeholder))
    return functools.reduce(lambda x, p: p(x), preprocessors, c)


def predicate_mask(rule: Rule, columns: str, preprocessors, placeholder: str, schema: T.StructType) -> Column:
    """Whether a row satisfies a predicate; never null."""
    a = rule.args
    if rule.kind == "isna":
        c = F.col(f"`{columns}`")
        mask = c.isNull()
        if isinstance(schema[columns].dataType, (T.DoubleType, T.FloatType)):
            mask = mask | F.isnan(c)
    else:
        v = text_of(columns, preprocessors, placeholder)
        if rule.kind == "isin":
            mask = F.instr(F.lit(a["values"]), v) > 0 if isinstance(a["values"], str) else v.isin([str(x) for x in a["values"] if x is not None])
            if isinstance(a["values"], str):
                mask = mask | (v == "")
        elif rule.kind == "str_len":
            n = F.length(v)
            mask = (n > 0) & (n > a["min_len"])
            if a["max_len"] is not None:
                mask = mask & (n <= a["max_len"])
        elif a.get("regex"):
            mask = v.rlike(a["pattern"] if a["case"] else f"(?i){a['pattern']}")
        else:
            v, p = (v, a["pattern"]) if a["case"] else (F.lower(v), a["pattern"].lower())
            mask = {"str_startswith": v.startswith, "str_endswith": v.endswith, "str_contains": v.contains}[rule.kind](p)
    mask = F.coalesce(mask, F.lit(False))
    return ~mask if rule.negated else mask


def close(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (u, v); root is the smallest node."""
    # What a task has found is joined there, so a node has one link a task at most (more only beyond the nodes that a forest holds).
    links = materialize(links.select("u", "v").where("u <> v").mapInArrow(forest, "u long, v long"), "links")
    if links.limit(FEW_LINKS + 1).count() > FEW_LINKS:
        roots = connected_components(links).hint("merge")
        roots.many = True
        return roots
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in links.collect():
        a, b = find(u), find(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    rows = [(x, find(x)) for x in list(parent)]
    return links.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["node", "root"], dtype="int64"), "node long, root long")


def _collapsed(keys: DataFrame, value: Column, text: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, __block, cid, k), and distinct values (__block, k, v, node, n): node is the first row, n the rows."""
    valued = keys.select("rid", "__block", "cid", value.alias("v"))
    valued = valued.withColumn("k", F.unhex(F.sha2("v", 256)) if text else F.col("v"))
    values = valued.groupBy("__block", "k").agg(F.min("rid").alias("node"), F.count("*").alias("n"), F.first("v").alias("v"))
    return valued.drop("v"), materialize(values, "values")


def _grouped(rows: DataFrame, values: DataFrame, roots: DataFrame, alone: Column | None = None) -> DataFrame:
    """Rows with the root of their value; where `alone` holds, rows of one value aren't alike."""
    found = values.join(roots.select(F.col("node").alias("of"), "root"), F.col("node") == F.col("of"), "left")
    found = found.select("__block", "k", F.coalesce("root", "node").alias("root"), (alone if alone is not None else F.lit(False)).alias("alone"))
    if getattr(roots, "many", False):
        found = found.hint("merge")  # compressed, such narrow rows may look few enough to be sent to the driver
    rooted = rows.alias("r").join(found.alias("f"), F.col("r.__block").eqNullSafe(F.col("f.__block")) & F.col("r.k").eqNullSafe(F.col("f.k")))
    return rooted.select("r.rid", "r.__block", "r.cid", F.when(F.col("f.alone"), F.col("r.rid")).otherwise(F.col("f.root")).alias("g"))


def _meeting(parts: DataFrame) -> DataFrame:
    """Links (u, v) that join values with a part in common; parts (__block, a, b, part, size, node) are for pairs of the sizes a <= b.

    All of size a with a part are alike to all of size b with it, so each is linked to the first of the other side only: links grow
    with the parts, however many values share one.
    """
    parts = materialize(parts, "parts")
    least = lambda side: F.min(F.when(F.col("size") == F.col(side), F.col("node"))).alias(f"of_{side}")
    firsts = parts.groupBy("__block", "a", "b", "part").agg(least("a"), least("b"), F.count("*").alias("n")).where("n > 1 AND of_a IS NOT NULL AND of_b IS NOT NULL")
    p, f = parts.alias("p"), firsts.hint("merge").alias("f")  # compressed, it may look small enough to be sent to the driver
    same = F.col("p.__block").eqNullSafe(F.col("f.__block")) & (F.col("p.a") == F.col("f.a")) & (F.col("p.b") == F.col("f.b")) & (F.col("p.part") == F.col("f.part"))
    return p.join(f, same).select(F.when(F.col("p.size") == F.col("p.a"), F.col("f.of_b")).otherwise(F.col("f.of_a")).alias("u"), F.col("p.node").alias("v"))


def _needs(sizes: list[int], need, cost) -> tuple[dict[int, list[tuple[int, int, int]]], set[int]]:
    """What values of each size must share with others: size -> (a, b, number) for the pairs of sizes a <= b that can be alike.

    need(a, b) is how much a pair must share at least, or None; cost(size, number) how many parts that makes. Pairs with a size that
    would have more than PARTS in all are left out; the sizes in such pairs are the second result.
    """
    sizes, pairs = sorted(sizes), []
    total = dict.fromkeys(sizes, 0)
    for i, a in enumerate(sizes):
        for b in sizes[i:]:
            if (n := need(a, b)) is None:
                break  # b is too long for a, and so is what is longer
            pairs.append((a, b, n))
            for s in {a, b}:
                if total[s] <= PARTS:
                    total[s] += cost(s, n)
    by: dict[int, list[tuple[int, int, int]]] = {}
    rest: set[int] = set()
    for a, b, n in pairs:
        if max(total[a], total[b]) > PARTS:
            rest |= {a, b}
        else:
            for s in {a, b}:
                by.setdefault(s, []).append((a, b, n))
    return by, rest


def _tiled(values: DataFrame, function, size: Column | None = None, ratio: float = 0.0, gap: int | None = None, tile: int | None = None) -> DataFrame:
    """Links (u, v) from function(left values, right values, same) on tiles of distinct values of one block.

    With a size (of a few thousand kinds at most), only tiles meet whose sizes can satisfy min > ratio * max, or that are `gap`
    apart at most. Pairs never leave a task unless they match. Every value is dealt once for each tile that its own meets, so larger
    tiles (`tile` values, TILE if not given) mean fewer rows, but fewer and larger tasks.
    """
    tile = tile or TILE
    sized = values.select("__block", "node", "v", (size if size is not None else F.lit(0)).cast("int").alias("size"))
    counts = sized.groupBy("__block", "size").agg(F.count("*").alias("n"))
    span = Window.partitionBy("__block").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    # Consecutive sizes share a tile until it is full; a frequent size has tiles of its own.
    tiles = counts.withColumn("parts", F.ceil(F.col("n") / tile).cast("int")).withColumn("before", F.coalesce(F.sum("n").over(span), F.lit(0)))
    tiles = tiles.select("__block", "size", "parts", F.floor(F.col("before") / tile).cast("int").alias("group"))
    placed = sized.alias("s").join(tiles.alias("t"), F.col("s.__block").eqNullSafe(F.col("t.__block")) & (F.col("s.size") == F.col("t.size")))
    placed = placed.select("s.__block", "s.node", "s.v", "s.size", "t.group", F.pmod(F.xxhash64("s.node"), F.col("t.parts")).cast("int").alias("part"))
    placed = materialize(placed, "tiles")
    extent = placed.groupBy("__block", "group", "part").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    a, b = extent.alias("a"), extent.alias("b")
    order = F.struct("a.group", "a.part") <= F.struct("b.group", "b.part")
    fits = (F.col("b.high") > F.col("a.low") * ratio - 1e-6) & (F.col("a.high") > F.col("b.low") * ratio - 1e-6)
    if gap is not None:
        fits = (F.col("b.low") - F.col("a.high") <= gap) & (F.col("a.low") - F.col("b.high") <= gap)
    met = a.join(b, F.col("a.__block").eqNullSafe(F.col("b.__block")) & order & fits)
    met = met.select(F.col("a.__block").alias("block"), F.xxhash64("a.__block", "a.group", "a.part", "b.group", "b.part").alias("meet"), F.struct("a.group", "a.part").alias("x"), F.struct("b.group", "b.part").alias("y"))
    sides = met.select("block", "meet", F.explode(F.when(F.col("x") == F.col("y"), F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("at")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("at")), F.struct(F.lit(1).alias("side"), F.col("y").alias("at"))))).alias("s"))
    sides = sides.select("block", "meet", "s.side", "s.at.group", "s.at.part")
    dealt = placed.alias("p").join(sides.alias("q"), F.col("p.__block").eqNullSafe(F.col("q.block")) & (F.col("p.group") == F.col("q.group")) & (F.col("p.part") == F.col("q.part"))).select("q.meet", "q.side", "p.node", "p.v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        same = not len(right)
        right = left if same else right
        i, j = function(list(left["v"]), list(right["v"]), same)
        return pd.DataFrame({"u": left["node"].to_numpy()[i], "v": right["node"].to_numpy()[j]}, dtype="int64")

    return dealt.groupBy("meet").applyInPandas(run, "u long, v long")


def _choices(size: int, number: int) -> int:
    """Ways to choose, or more than PARTS."""
    return math.comb(size, number) if min(number, size - number) < 10 else PARTS + 1


def _subsequences(values: DataFrame, threshold: float) -> tuple[DataFrame, set[int]]:
    """Links of texts (v) by subsequences in common, and the lengths among which pairs are left to be compared.

    A ratio above the threshold is a common subsequence of a certain length or more. Where it leaves out few characters, a text's
    subsequences of that length are few, and two texts share one exactly if they are alike.
    """
    limit = np.float32(100 * threshold)

    def need(a, b):
        if not a + b:
            return 0
        n = max(0, int(threshold * (a + b) / 2) - 1)
        while n <= a and not np.float32(200.0 * n / (a + b)) > limit:
            n += 1
        return n if n <= a else None

    by, rest = _needs([r[0] for r in values.select(F.length("v")).distinct().collect()], need, _choices)

    def cut(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for low in range(0, len(texts), 500):
                rows, a, b, parts, sizes = [], [], [], [], []
                for row, text in enumerate(texts[low : low + 500], low):
                    found = {}
                    for x, y, n in by.get(len(text), ()):
                        if n not in found:
                            found[n] = list({"".join(c) for c in itertools.combinations(text, n)})
                        k = len(found[n])
                        rows += [row] * k
                        a += [x] * k
                        b += [y] * k
                        parts += found[n]
                        sizes += [len(text)] * k
                at = pa.array(rows, pa.int64())
                own = [batch.column(0).take(at), batch.column(1).take(at)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.int32()) for x in (a, b, sizes)), pa.array(parts, pa.string())], names)

    names = ["__block", "node", "a", "b", "size", "part"]
    schema = T.StructType([T.StructField("__block", values.schema["__block"].dataType), T.StructField("node", T.LongType())])
    for n in names[2:]:
        schema.add(n, T.StringType() if n == "part" else T.IntegerType())
    return _meeting(values.select("__block", "node", "v").mapInArrow(cut, schema)), rest


def _fuzzy(keys, value, threshold, scorer):
    rows, values = _collapsed(keys, value)
    texts = values
    if scorer == "token_sort_ratio":  # the ratio of sorted words
        texts, scorer = values.withColumn("v", F.udf(sorted_words, "string", useArrow=False)("v")), "simple_ratio"
    function = lambda a, b, same: similar_pairs(a, b, scorer, threshold, same)
    zero = F.col("v") == "" if scorer in ("quick_ratio", "weighted_ratio") else F.trim("v") == "" if scorer == "token_set_ratio" else None
    if scorer not in BOUNDED:
        return _grouped(rows, values, close(_tiled(texts, function)), zero)
    links, rest = _subsequences(texts, threshold)
    if rest:
        links = links.unionByName(_tiled(texts.where(F.length("v").isin(*rest)), function, F.length("v"), threshold / (2 - threshold)))
    return _grouped(rows, values, close(links), zero)


def _cosine(keys, columns, schema, threshold):
    if isinstance(columns, str):
        columns = [columns]
    number = lambda c: F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    if len(columns) == 1 and isinstance(schema[columns[0]].dataType, T.ArrayType):
        value = F.transform(F.coalesce(F.col(f"`{columns[0]}`"), F.array().cast("array<double>")), number)
    else:
        value = F.array(*[number(F.col(f"`{c}`")) for c in columns])
    big = float(np.finfo(np.float64).max)
    value = F.transform(value, lambda x: F.greatest(F.lit(-big), F.least(F.lit(big), x)))
    rows, values = _collapsed(keys, value, False)

    def unit(vectors):
        m = np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), -1)
        m = m / np.maximum(np.abs(m).max(axis=1, keepdims=True), 1e-300) if m.size else m
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norm == 0, 1, norm)

    def function(a, b, same):
        by = {}
        for side, vectors in enumerate((a, b)):  # only vectors of one length are comparable
            for i, v in enumerate(vectors):
                by.setdefault(len(v), ([], []))[side].append(i)
        out = []
        for left, right in by.values():
            if left and right:
                i, j = _spanning(unit([a[k] for k in left]), unit([b[k] for k in right]), threshold, same)
                out.append((np.array(left)[i], np.array(right)[j]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    zero = ~F.exists("v", lambda x: x != 0)
    angle, gap = _pivot(values.where(~zero), threshold)
    # As many tiles as keep the cores busy, but no larger than a task can hold.
    tile = max(TILE, min(LARGE_TILE, values.count() // 32))
    return _grouped(rows, values, close(_tiled(values.where(~zero), function, angle, gap=gap, tile=tile)), zero)


def _spanning(left: np.ndarray, right: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of similar unit vectors, no more than join what is alike: at most one for each vector and one for each join.

    All pairs are compared; same says that left and right are the same vectors.
    """
    label = np.full(len(right), -1)  # the group of each vector on the right
    first: list[int] = []  # a vector of each group
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(left), 256):
        alike = left[at : at + 256] @ right.T > threshold
        if same:  # a vector is alike to itself, whatever rounding says
            alike[np.arange(len(alike)), np.arange(at, at + len(alike))] = True
        for i in np.flatnonzero(alike.sum(axis=1) > int(same)).tolist():
            js = np.flatnonzero(alike[i])
            own = label[js]
            new = js[own < 0]
            groups = np.unique(own[own >= 0]).tolist()
            if not groups:
                groups = [len(first)]
                first.append(int(js[0]))
            reach = np.array(sorted({*new.tolist(), *(first[g] for g in groups)}), np.int64)
            out_i.append(np.full(len(reach), i + at))
            out_j.append(reach)
            label[new] = groups[0]
            for g in groups[1:]:
                label[label == g] = groups[0]
    i, j = np.concatenate(out_i), np.concatenate(out_j)
    return (i[i != j], j[i != j]) if same else (i, j)


#: Steps of the half circle, and axes that are tried, for the angle by which cosine's tiles are cut.
STEPS, AXES = 4096, 32


def _pivot(values: DataFrame, threshold: float) -> tuple[Column, int]:
    """The angle of each vector (v) to an axis in STEPS, and how far apart those of similar vectors can be.

    By the triangle inequality of angles, two vectors less than acos(threshold) apart differ by less than that in their angle to
    any axis. Of the first AXES axes the one with the widest spread of angles is taken.
    """
    most = F.array_max(F.transform("v", F.abs))
    scaled = F.transform("v", lambda x: x / most)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda t, x: t + x * x))
    to = lambda c, n, i: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.get(c, F.lit(i)), F.lit(0.0)) / n)))
    once = values.select(scaled.alias("s")).select("s", norm(F.col("s")).alias("n"))  # not once for each axis
    spread = once.agg(*[F.stddev_pop(to(F.col("s"), F.col("n"), i)).alias(str(i)) for i in range(AXES)]).first()
    best = max(range(AXES), key=lambda i: spread[i] or 0.0)
    return F.floor(to(scaled, norm(scaled), best) / math.pi * STEPS), math.ceil(math.acos(max(-1.0, min(1.0, threshold))) / math.pi * STEPS) + 2

def _token(c: Column, kind: T.DataType) -> Column:
    """A value as text that tells kinds apart; equal numbers and booleans are equal whatever their type."""
    if isinstance(kind, T.BooleanType):
        return F.concat(F.lit("n:"), c.cast("int").cast("double").cast("string"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):  # NaN equals nothing, the zeros are equal
        return F.when(F.isnan(c), F.concat(F.lit("nan:"), F.col("rid").cast("string"))).otherwise(F.concat(F.lit("n:"), (c.cast("double") + 0.0).cast("string")))
    if isinstance(kind, T.NumericType):
        return F.concat(F.lit("n:"), c.cast("double").cast("string"))
    return F.concat(F.lit(f"{kind.typeName()}:"), c.cast("string"))


def _subsets(values: DataFrame, by: dict[int, list[tuple[int, int, int]]]) -> DataFrame:
    """The parts of sets (v) for _meeting: of each size in `by`, all choices of as many values as a pair must share."""
    digests = values.select("__block", "node", F.size("v").alias("size"), F.transform("v", lambda x: F.unhex(F.sha2(x, 256))).alias("v"))
    found = F.array().cast("array<struct<a:int,b:int,part:binary>>")
    for size, own in by.items():
        part = {n: [F.unhex(F.sha2(F.concat(*[F.col("v")[i] for i in c]), 256)) for c in itertools.combinations(range(size), n)] for n in {n for _, _, n in own}}
        parts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), x.alias("part")) for a, b, n in own for x in part[n]])
        found = F.when(F.col("size") == size, parts).otherwise(found)
    return digests.select("__block", "node", "size", F.explode(found).alias("p")).select("__block", "node", "size", "p.a", "p.b", "p.part")


def _jaccard(keys, columns, schema, threshold):
    tokens = F.array(*[_token(F.col(f"`{c}`"), schema[c].dataType) for c in columns])
    value = F.array_sort(F.array_distinct(F.filter(tokens, lambda x: x.isNotNull())))
    rows, values = _collapsed(keys, value, False)
    empty = F.size("v") == 0

    def need(a, b):
        return next((n for n in range(1, a + 1) if n / (a + b - n) > threshold), None)

    by, rest = _needs([r[0] for r in values.select(F.size("v")).where(~empty).distinct().collect()], need, _choices)
    if not rest:
        return _grouped(rows, values, close(_meeting(_subsets(values, by))), empty)
    often = values.select("__block", F.explode("v").alias("token")).groupBy("__block", "token").count()
    posts = values.select("__block", "node", F.size("v").alias("size"), F.explode("v").alias("token")).alias("p")
    posts = posts.join(often.alias("o"), F.col("p.__block").eqNullSafe(F.col("o.__block")) & (F.col("p.token") == F.col("o.token"))).select("p.*", "o.count")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("count", "token"))
    # Two sets above the threshold share one of their size - floor(threshold * size) rarest values.
    prefix = posts.withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.floor(F.col("size") * threshold - 1e-9)).select("__block", "node", "token", "size", "rank")
    prefix = materialize(prefix, "prefix")
    a, b = prefix.alias("a"), prefix.alias("b")
    # At the first value in common (by rarity) they can have no more than the rest of the shorter remainder in common.
    enough = threshold / (1 + threshold) * (F.col("a.size") + F.col("b.size")) - 1e-9
    fits = (1 + F.least(F.col("a.size") - F.col("a.rank"), F.col("b.size") - F.col("b.rank")) >= enough) & (F.least("a.size", "b.size") >= threshold * F.greatest("a.size", "b.size") - 1e-9)
    pairs = a.join(b, F.col("a.__block").eqNullSafe(F.col("b.__block")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node")) & fits).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    sets = values.select("node", F.col("v").alias("set"))
    met = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("y")), "v")
    both = F.size(F.array_intersect("x", "y"))
    links = met.where((both > 0) & (both / (F.size("x") + F.size("y") - both) > threshold)).select("u", "v")
    return _grouped(rows, values, close(links), empty)


def _lsh(keys, value, threshold, ngram, num_perm):
    b, r = minhash.bands(threshold, num_perm)

    def banded(batches):
        known: dict[bytes, bytes] = {}  # copies need no work
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column(3).to_pylist()
                digests = [None if t is None else hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
                new = {d: t or "" for d, t in zip(digests, texts) if d not in known}
                least = minhash.signatures(list(new.values()), ngram, num_perm)[:, : b * r].astype("<u4")
                known |= zip(new, (x.tobytes() for x in least))
                bands = [known[d] for d in digests]
                if len(known) > 20_000:
                    known.clear()
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(digests, pa.binary()), pa.array(bands, pa.binary())], ["rid", "__block", "cid", "k", "bands"])

    # Texts are read once, and neither dealt nor written: a row goes on with the digest and the min-hashes of its text.
    picked = keys.select("rid", "__block", "cid", value.alias("v"))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in picked.schema.fields[:3]), T.StructField("k", T.BinaryType()), T.StructField("bands", T.BinaryType())])
    signed = materialize(picked.mapInArrow(banded, schema), "signed")
    values = materialize(signed.groupBy("__block", "k").agg(F.min("rid").alias("node"), F.first("bands").alias("bands")), "values")
    cut = F.array(*[F.substring("bands", 4 * r * i + 1, 4 * r) for i in range(b)])
    keyed = materialize(values.select("__block", "node", F.posexplode(cut).alias("band", "key")), "bands")
    first = materialize(keyed.groupBy("__block", "band", "key").agg(F.min("node").alias("u"), F.count("*").alias("n")).where("n > 1"), "buckets")
    k, f = keyed.alias("k"), first.alias("f")
    links = k.join(f, F.col("k.__block").eqNullSafe(F.col("f.__block")) & (F.col("k.band") == F.col("f.band")) & (F.col("k.key") == F.col("f.key"))).select("f.u", F.col("k.node").alias("v"))
    return _grouped(signed.drop("bands"), values, close(links))


def _tfidf(keys, value, threshold, ngram, topn, **weighting):
    w = WEIGHTING | weighting
    cleaned = F.regexp_replace(F.lower(value) if w["lowercase"] else value, r"(?U)\s\s+", " ")
    rows, values = _collapsed(keys, cleaned)
    totals = rows.groupBy("__block").agg(F.count("*").alias("total"))
    sizes = range(ngram[0], ngram[1] + 1)

    def cut(n):
        return F.when(F.length("v") >= n, F.transform(F.sequence(F.lit(1), F.length("v") - (n - 1)), lambda i: F.substring("v", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    pieces = [cut(n) for n in sizes]
    grams = values.select("__block", "node", "n", F.explode(F.concat(*pieces)).alias("gram")).groupBy("__block", "node", "n", "gram").agg(F.count("*").alias("tf"))
    grams = materialize(grams, "grams")
    idf = grams.groupBy("__block", "gram").agg(F.sum("n").alias("df")).alias("i").join(totals.alias("t"), F.col("i.__block").eqNullSafe(F.col("t.__block")))
    more = 1 if w["smooth_idf"] else 0
    weight = F.log((more + F.col("total")) / (more + F.col("df"))) + 1 if w["use_idf"] else F.lit(1.0)
    idf = idf.select("i.__block", "i.gram", "df", weight.alias("idf"))
    tf = F.lit(1) if w["binary"] else F.col("tf")
    tf = F.log(tf) + 1 if w["sublinear_tf"] else tf
    g, i = grams.alias("g"), idf.alias("i")
    weighted = g.join(i, F.col("g.__block").eqNullSafe(F.col("i.__block")) & (F.col("g.gram") == F.col("i.gram"))).select("g.__block", "g.node", "g.gram", "i.df", (tf * F.col("idf")).alias("w"))
    norms = weighted.groupBy("node").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = materialize(weighted.join(norms, "node").select("__block", "node", "gram", "df", (F.col("w") / F.col("norm")).alias("w")), "weights")
    # Rare n-grams first: where what is left of a vector has a norm below the threshold, it can't make a pair alone. With one order for
    # all, two vectors above the threshold share an n-gram that comes before that point in both.
    rest = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("node").orderBy("df", "gram").rowsBetween(0, Window.unboundedFollowing)))
    heads = materialize(unit.withColumn("rest", rest).where(F.col("rest") >= threshold - 1e-8).select("__block", "node", "gram"), "heads")
    a, b = heads.alias("a"), heads.alias("b")
    met = a.join(b, F.col("a.__block").eqNullSafe(F.col("b.__block")) & (F.col("a.gram") == F.col("b.gram")) & (F.col("a.node") < F.col("b.node")))
    met = met.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    vectors = unit.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("x"))  # a value's own n-grams
    vectors = materialize(vectors, "vectors")
    side = lambda end: vectors.select(F.col("node").alias(end), F.col("x").alias(f"x_{end}"))
    both = met.join(side("u"), "u").join(side("v"), "v")
    products = F.map_values(F.map_zip_with("x_u", "x_v", lambda k, x, y: F.coalesce(x * y, F.lit(0.0))))
    once = both.select("u", "v", F.round(F.aggregate(products, F.lit(0.0), lambda t, x: t + x), 9).alias("score")).where(F.col("score") > threshold)
    once = materialize(once, "scores")
    scores = once.unionByName(once.select(F.col("v").alias("u"), F.col("u").alias("v"), "score"))
    if threshold < 1:
        scores = scores.unionByName(vectors.select(F.col("node").alias("u"), F.col("node").alias("v"), F.lit(1.0).alias("score")))
    # A row's slots go to the best rows; rows of one value have the same score, so a value takes as many as it has rows.
    counted = scores.join(values.select(F.col("node").alias("v"), "n"), "v")
    own = Window.partitionBy("u").orderBy(F.desc("score"), "v").rowsBetween(Window.unboundedPreceding, -1)
    links = counted.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0))).where(F.col("before") < topn).select("u", "v")
    short = F.length("v") < ngram[0]
    return _grouped(rows, values, close(links), short)


def _pairs(keys, columns, value, rule):
    """Custom pair generators: one task per block."""
    f, settings = rule.args["function"], rule.args["settings"]
    picked = keys.select("rid", "__block", (value if isinstance(columns, str) else F.struct(*[F.col(f"`{c}`") for c in columns])).alias("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid")
        rid = pdf["rid"].to_numpy()
        pairs = [(rid[i], rid[j]) for i, j in f(list(pdf["v"]), **settings)]
        return pd.DataFrame(pairs, columns=["u", "v"], dtype="int64")

    links = picked.groupBy("__block").applyInPandas(run, "u long, v long")
    return _of_rows(keys, close(links))


def _of_rows(keys: DataFrame, roots: DataFrame) -> DataFrame:
    return keys.select("rid", "__block", "cid").join(roots, F.col("rid") == F.col("node"), "left").select("rid", "__block", "cid", F.coalesce("root", "rid").alias("g"))


def _theta(keys, columns, value, rule):
    rows, values = _collapsed(keys, value if value is not None else F.struct(*[F.col(f"`{c}`") for c in columns]), value is not None)
    a, b = values.alias("a"), values.alias("b")
    holds = rule.args["function"](F.col("a.v"), F.col("b.v"), **rule.args["settings"])
    links = a.join(b, F.col("a.__block").eqNullSafe(F.col("b.__block")) & (F.col("a.node") < F.col("b.node")) & holds).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    alone = ~F.coalesce(rule.args["function"](F.col("v"), F.col("v"), **rule.args["settings"]), F.lit(False))
    return _grouped(rows, values, close(links), alone)


def own_key(rule: Rule, columns, preprocessors, placeholder: str) -> Column | None:
    """What rows must have in common, for rules that need no look at other rows; a null key is alike to nothing."""
    value = text_of(columns, preprocessors, placeholder) if isinstance(columns, str) else None
    if rule.kind == "exact":
        # Long texts travel as digests.
        return F.unhex(F.sha2(value, 256)) if value is not None else F.struct(*[F.col(f"`{c}`") for c in columns])
    if rule.kind == "key":
        return rule.args["function"](value if value is not None else F.struct(*[F.col(f"`{c}`") for c in columns]), **rule.args["settings"])
    return None


def groups(rule: Rule, columns, preprocessors, keys: DataFrame, placeholder: str) -> DataFrame:
    """(rid, __block, cid, g) of the rows of keys that can be alike under the rule; rows whose g is null are alike to nothing."""
    a, schema = rule.args, keys.schema
    if rule.predicate:
        return keys.where(predicate_mask(rule, columns, preprocessors, placeholder, schema)).select("rid", "__block", "cid", F.lit(1).alias("g"))
    own = own_key(rule, columns, preprocessors, placeholder)
    if own is not None:
        return keys.select("rid", "__block", "cid", own.alias("g"))  # a filter here would clean and hash every text twice
    value = text_of(columns, preprocessors, placeholder) if isinstance(columns, str) else None
    if rule.kind == "fuzzy":
        return _fuzzy(keys, value, a["threshold"], a["scorer"])
    if rule.kind == "tfidf":
        return _tfidf(keys, value, **a)
    if rule.kind == "lsh":
        return _lsh(keys, value, a["threshold"], a["ngram"], a["num_perm"])
    if rule.kind == "jaccard":
        return _jaccard(keys, columns, schema, a["threshold"])
    if rule.kind == "cosine":
        return _cosine(keys, columns, schema, a["threshold"])
    if rule.kind == "theta":
        return _theta(keys, columns, value, rule)
    return _pairs(keys, columns, value, rule)
