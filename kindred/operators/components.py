"""Connected components: forests within tasks, then alternating large-star and small-star rounds.

Each task first joins the nodes of its own edges (union-find, FOREST nodes at a time) and passes on one edge per node, which
keeps what is connected. What several tasks hold of a component is joined by the star rounds: two joins and two
aggregations on edges; min() is aggregated before the shuffle, and the joins are against one row per node, so a node with
very many neighbours can be split; none of these tables is sent to the driver, however small its file. Rounds are written to shared storage. Their number grows with the logarithm of the
longest path between what tasks have joined.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.plans.storage import materialize, prepare, scratch

#: Nodes that a task joins at a time, and edges that are few enough for one task.
FOREST, FEW = 1_000_000, 200_000


def forest(batches):
    """Edges (u, v) as (node, root), one for each node but the roots, for FOREST nodes at a time."""
    parent: dict[int, int] = {}

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def out():
        rows = [(x, r) for x in list(parent) if (r := find(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], ["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        if len(parent) > FOREST:
            yield out()
    if parent:
        yield out()


def _joined(edges: DataFrame) -> DataFrame:
    """edges (u, v) as (u, v) with v < u, at most one for each node and task. FEW edges are joined by one task, more by as many as they have."""
    few = edges.limit(FEW + 1).count() <= FEW
    out = materialize((edges.coalesce(1) if few else edges).select("u", "v").mapInArrow(forest, "u long, v long"), "edges")
    out.joined = few
    return out


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")), "least")
    out = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "down")
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    side = down.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return side.unionByName(least.select("u", F.col("m").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge down, and to a node that has none: then that is the smallest of its component."""
    if edges.joined:
        return True
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    open_ = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down = 1 AND up = 1)")
    return open_.limit(1).count() == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (u, v: long); root is the smallest node of the component, and has no row."""
    prepare(edges.sparkSession)
    with scratch() as keep:
        now = _joined(edges.where("u <> v"))
        while not _settled(now):
            now = _joined(materialize(_small_star(_large_star(now)), "stars"))
        keep(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
