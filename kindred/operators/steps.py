"""Steps of rules: how groups of rows become canonical ids, and how steps build on each other.

The state is a narrow table (rid, __block, cid, key columns). A step relates rows; every group's representative is its
first or last row, and new[i] = old[rep(i)]: a gather, not a closure, so a later step doesn't move the rows that an earlier
one has linked to a row that moves. Groups of one row change nothing, so only rows that move are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.linking import FEW_LINKS, groups, own_key, predicate_mask
from kindred.operators.rules import Rule
from kindred.plans.storage import materialize


@dataclass(frozen=True)
class Unit:
    """One rule on one column or several, with the preprocessors of its text."""

    columns: str | tuple[str, ...]
    rule: Rule
    preprocessors: tuple = ()


def columns_of(units) -> list[str]:
    names: dict[str, None] = {}
    for u in units:
        names.update(dict.fromkeys([u.columns] if isinstance(u.columns, str) else u.columns))
    return list(names)


def _strict(units: list[Unit], state: DataFrame, placeholder: str) -> DataFrame:
    """Rows that satisfy all predicates, grouped by what the other rules say about these rows, all together."""
    for u in (u for u in units if u.rule.predicate):
        state = state.where(predicate_mask(u.rule, u.columns, u.preprocessors, placeholder, state.schema))
    others = [u for u in units if not u.rule.predicate]
    if not others:
        return state.select("rid", "__block", "cid", F.lit(1).alias("g"))
    own = [own_key(u.rule, u.columns, u.preprocessors, placeholder) for u in others]
    if len(others) == 1:
        return groups(others[0].rule, others[0].columns, others[0].preprocessors, state, placeholder)
    keyed = [k for k in own if k is not None]
    names = [f"g{i}" for i in range(len(others))]
    # Keys that a row has by itself need no join.
    out = state.select("rid", "__block", "cid", *[k.alias(f"g{i}") for i, k in enumerate(keyed)])
    for i in range(len(keyed)):
        out = out.where(F.col(f"g{i}").isNotNull())
    related = [u for u, k in zip(others, own) if k is None]
    for i, u in enumerate(related, len(keyed)):
        found = groups(u.rule, u.columns, u.preprocessors, state, placeholder).select("rid", F.col("g").alias(f"g{i}"))
        out = out.join(found, "rid")
    return out.select("rid", "__block", "cid", F.struct(*names).alias("g"))


def _cascade(units: list[Unit], state: DataFrame, placeholder: str) -> DataFrame:
    """Predicates first; each rule sees the rows that some predicate before it has linked, and the last one decides.

    Blocks in which no predicate has linked two rows are not narrowed down.
    """
    units = sorted(units, key=lambda u: not u.rule.predicate)
    if not units[0].rule.predicate:
        return _strict(units, state, placeholder)
    linked, out = None, None
    for u in units:
        seen = state
        if linked is not None:
            blocks = linked.select(F.col("__block").alias("b")).distinct()
            rows = linked.select(F.col("rid").alias("r")).distinct()
            seen = state.join(rows, F.col("rid") == F.col("r"), "left").join(blocks, F.col("__block").eqNullSafe(F.col("b")), "left")
            seen = seen.where("r IS NOT NULL OR b IS NULL").select(*state.columns)
        out = groups(u.rule, u.columns, u.preprocessors, seen, placeholder)
        if u.rule.predicate:
            many = out.groupBy(F.col("__block").alias("b")).count().where("count > 1").drop("count")
            more = out.join(many, F.col("__block").eqNullSafe(F.col("b")), "left_semi").select("rid", "__block")
            linked = materialize(more if linked is None else linked.unionByName(more), "predicated")
    return out


def moved(found: DataFrame, keep: str) -> DataFrame:
    """(rid, rep, new): rows of groups of two or more, their representative, and its canonical id.

    The groups, a few numbers and a digest a row, are written once, so that long texts are read and joined only once.
    """
    found = materialize(found, "groups")
    many = found.count() > FEW_LINKS  # then nothing of it is to be sent to the driver, however small it looks when compressed
    found = found.where("g IS NOT NULL")
    best = (F.min("rid"), F.min_by("cid", "rid")) if keep == "first" else (F.max("rid"), F.max_by("cid", "rid"))
    reps = found.groupBy("__block", "g").agg(best[0].alias("rep"), best[1].alias("new"), F.count("*").alias("n")).where("n > 1").drop("n")
    a, b = found.alias("a"), (reps.hint("merge") if many else reps).alias("b")
    met = a.join(b, F.col("a.__block").eqNullSafe(F.col("b.__block")) & F.col("a.g").eqNullSafe(F.col("b.g")))
    met = met.select("a.rid", "b.rep", "b.new")
    return met.hint("merge") if many else met


def changes(units: list[Unit], state: DataFrame, keep: str, placeholder: str, cascade: bool) -> DataFrame:
    """(rid, new) of the rows that a single step gives another canonical id than their own row's."""
    return moved((_cascade if cascade else _strict)(units, state, placeholder), keep).where("rid <> rep").select("rid", "new")


def run_steps(steps: list[list[Unit]], state: DataFrame, keep: str, drop: bool, unique: bool, placeholder: str, cascade: bool) -> tuple[DataFrame, DataFrame | None]:
    """The final state (rid, cid) of the rows that are left; or, where ids are unique and rows are dropped, the lost rids too.

    unique: whether cid tells all rows apart at the start. Then a row is lost in a step exactly if it isn't its group's
    representative, and what is left stays unique.
    """
    lost = None
    for i, units in enumerate(steps):
        found = (_cascade if cascade else _strict)(units, state, placeholder)
        moves = moved(found, keep)
        last = i == len(steps) - 1
        if drop and unique:
            gone = moves.where("rid <> rep").select("rid")
            gone = gone if last and lost is None else materialize(gone, "lost")
            lost = gone if lost is None else lost.unionByName(gone)
            state = state if last else state.join(gone, "rid", "left_anti")
            continue
        rest = [c for c in state.columns if c not in ("rid", "cid")]
        state = state.join(moves.where("rid <> rep").select("rid", F.struct("new").alias("move")), "rid", "left")
        state = state.select("rid", *rest, F.when(F.col("move").isNotNull(), F.col("move.new")).otherwise(F.col("cid")).alias("cid"))
        if drop:
            chosen = (F.min if keep == "first" else F.max)("rid").alias("rid")
            state = state.join(state.groupBy("cid").agg(chosen).select("rid"), "rid", "left_semi")
        if not last:
            state = materialize(state, "step")
    return state.select("rid", "cid"), lost
