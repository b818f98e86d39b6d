"""Sessions: a table, rules, and what becomes of the rows that the rules relate."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.dsl import Col, Pipeline
from kindred.operators.rules import REGISTRY, InvalidRuleError, Rule, exact
from kindred.operators.steps import Unit, changes, columns_of, run_steps
from kindred.plans.rowid import dense, numbered
from kindred.plans.storage import importable

#: Name of the column of canonical ids.
CANONICAL_ID = os.environ.get("CANONICAL_ID", "canonical_id")

_RID = "__rid"


def _checked(keep: str) -> str:
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last'; got {keep!r}")
    return keep


class Dedupe:
    """Rules over a table. Everything stays a lazy DataFrame but for links that have to be closed transitively.

    df: the table. Rows have an order: that of row_id, of order_by, or else of the input.
    row_id: name of a column of distinct longs that numbers the rows. It saves the numbering and the copy that fixes it,
        so give it for large tables; the canonical id is then that column unless id says otherwise.
    order_by: columns to number the rows by, from 0.
    block_on: columns that rows must share to be compared at all. Without it all rows are compared with each other.
    placeholder: what null text counts as in rules on a single column.
    step_semantics: "strict" (all rules of a step must hold) or "cascade" (predicates narrow down what the rule after
        them sees, and the last rule decides).
    """

    def __init__(self, df: DataFrame, /, *, spark_session: SparkSession | None = None, row_id: str | None = None, order_by=None, block_on=None, placeholder: str = "na", step_semantics: str = "strict", canonical_id: str | None = None):
        if not isinstance(df, DataFrame):
            raise ValueError(f"a Spark DataFrame is needed; got {type(df).__name__}")
        if step_semantics not in ("strict", "cascade"):
            raise ValueError(f"step_semantics must be 'strict' or 'cascade'; got {step_semantics!r}")
        several = lambda x: [] if x is None else [x] if isinstance(x, (str, Column)) else list(x)
        self._df, self._row_id, self._order, self._block = df, row_id, several(order_by), several(block_on)
        self._placeholder, self._cascade, self._cid = placeholder, step_semantics == "cascade", canonical_id or CANONICAL_ID
        self._kind, self._rules = "sequence", []
        self._linked: DataFrame | None = None  # with _RID once canonicalized

    # -- rules

    def apply(self, rules: Rule | dict | Col | Pipeline) -> Dedupe:
        """Add a rule to the sequence, or set a dict {columns: rule or rules}, a column's rule or a pipeline."""
        if isinstance(rules, (Col, Pipeline)):
            made = rules if isinstance(rules, Pipeline) else Pipeline().step(rules)
            if self._kind == "pipeline":
                warnings.warn("this replaces the pipeline that was applied before", UserWarning, stacklevel=2)
            self._kind, self._rules = "pipeline", made
        elif isinstance(rules, dict):
            made = {}
            for columns, own in rules.items():
                if not isinstance(columns, (str, tuple)):
                    raise InvalidRuleError(f"a key is a column or a tuple of columns; got {columns!r}")
                own = list(own) if isinstance(own, (list, tuple)) else [own]
                for r in own:
                    if not isinstance(r, Rule):
                        raise InvalidRuleError(f"{columns!r} needs a rule or a list of rules; got {r!r}")
                made[columns] = own
            if self._kind != "sequence" or self._rules:
                warnings.warn(f"this replaces the {self._kind} of rules that was applied before", UserWarning, stacklevel=2)
            self._kind, self._rules = "dict", made
        elif isinstance(rules, Rule):
            if self._kind != "sequence":
                raise InvalidRuleError(f"a single rule can't be added to a {self._kind} of rules")
            self._rules.append(rules)
        else:
            raise InvalidRuleError(f"a rule, a dict of rules, col(...) or a pipeline is needed; got {rules!r}")
        return self

    def _steps(self, columns) -> list[list[Unit]]:
        if self._kind == "sequence":
            if columns is None or columns in ([], ()):
                raise ValueError("name the column or columns to compare")
            if not isinstance(columns, str):
                columns = tuple(columns)
                if len(set(columns)) < len(columns):
                    raise ValueError(f"a column is named twice in {columns}")
            pairs = [(columns, r) for r in self._rules or [exact()]]
        elif columns is not None:
            raise ValueError(f"a {self._kind} of rules names its columns itself")
        elif self._kind == "pipeline":
            steps = self._rules.units()
            if not steps:
                raise ValueError("the pipeline has no step")
            return steps
        else:
            pairs = [(c, r) for c, own in self._rules.items() for r in own]
        for c, r in pairs:
            r.check(c)
        return [[Unit(c, r)] for c, r in pairs]

    # -- plans

    def _start(self, steps, id: str | None) -> tuple[DataFrame, DataFrame, bool]:
        """The table with _RID and canonical id, the narrow state of the rules, and whether ids are unique."""
        df, cid = self._df, self._cid
        importable(df.sparkSession)
        named = {c for units in steps for c in columns_of(units)} | {c for c in (*self._block, id) if isinstance(c, str)}
        if missing := sorted(c for c in named if c not in df.columns):
            raise ValueError(f"no such column: {', '.join(missing)}; there are {', '.join(df.columns)}")
        old = cid in df.columns
        auto = not old and id is None
        if self._row_id is not None:
            table = df.withColumn(_RID, F.col(f"`{self._row_id}`").cast("long"))
        elif _RID in df.columns:
            table = df
        else:
            table = dense(df, _RID, self._order) if auto or self._order else numbered(df, _RID)
        if auto:
            table = table.withColumn(cid, F.col(f"`{self._row_id}`") if self._row_id is not None else F.col(_RID))
        elif id is not None and id != cid:
            table = table.withColumn(cid, F.col(f"`{id}`"))
        block = F.lit(0) if not self._block else F.struct(*[c if isinstance(c, Column) else F.col(f"`{c}`") for c in self._block])
        keys = list(dict.fromkeys(c for units in steps for c in columns_of(units)))
        # The id travels as `cid`; key columns keep their names.
        state = table.select(F.col(_RID).alias("rid"), block.alias("__block"), F.col(f"`{cid}`").alias("cid"), *[F.col(f"`{c}`") for c in keys if c not in ("rid", "cid", "__block")])
        if clash := {"rid", "cid", "__block"} & set(keys):
            raise ValueError(f"rename the columns {sorted(clash)}; these names are taken")
        return table, state, auto

    def drop_duplicates(self, columns=None, *, keep: str = "first") -> DataFrame:
        """One row of every group; rows dropped by a rule are out of sight of the next. Without rules: exact."""
        _checked(keep)
        steps = self._steps(columns)
        table, state, unique = self._start(steps, None)
        left, lost = run_steps(steps, state, keep, True, unique, self._placeholder, self._cascade)
        keys = left.select(F.col("rid").alias(_RID)) if lost is None else lost.select(F.col("rid").alias(_RID))
        self._reset()
        return table.join(keys, _RID, "left_semi" if lost is None else "left_anti").drop(_RID, self._cid)

    def canonicalize(self, columns=None, *, keep: str = "first", drop_duplicates: bool = False, id: str | None = None) -> Dedupe:
        """Give linked rows the canonical id of their first or last row; collect() returns the table."""
        _checked(keep)
        steps = self._steps(columns)
        table, state, unique = self._start(steps, id)
        if len(steps) == 1 and not drop_duplicates:  # the table meets only the rows that change
            new = changes(steps[0], state, keep, self._placeholder, self._cascade).select(F.col("rid").alias(_RID), F.struct("new").alias("__change"))
            own = F.col(f"`{self._cid}`")
            met = table.join(new, _RID, "left").withColumn("__new", F.when(F.col("__change").isNotNull(), F.col("__change.new")).otherwise(own))
            self._linked = met.select(*[F.col("__new").alias(c) if c == self._cid else F.col(f"`{c}`") for c in table.columns])
            self._reset()
            return self
        left, lost = run_steps(steps, state, keep, drop_duplicates, unique, self._placeholder, self._cascade)
        if lost is not None:
            self._linked = table.join(lost.select(F.col("rid").alias(_RID)), _RID, "left_anti")
        else:
            names = table.columns
            joined = table.drop(self._cid).join(left.select(F.col("rid").alias(_RID), F.col("cid").alias(self._cid)), _RID)
            self._linked = joined.select(*[F.col(f"`{c}`") for c in names])
        self._reset()
        return self

    def _reset(self) -> None:
        self._kind, self._rules = "sequence", []

    # -- results

    def _result(self) -> DataFrame:
        if self._linked is None:
            raise RuntimeError("canonicalize() comes first")
        return self._linked

    def collect(self) -> DataFrame:
        """The table with canonical ids, as a lazy DataFrame."""
        return self._df if self._linked is None else self._linked.drop(_RID)

    def canonicals_df(self, n: int = 2) -> DataFrame:
        """(canonical id, count) of the ids that n rows or more share."""
        if n < 2:
            raise ValueError("n must be 2 at least")
        return self._result().groupBy(F.col(f"`{self._cid}`")).agg(F.count("*").alias("count")).where(F.col("count") >= n)

    def canonicals(self, n: int = 2) -> dict:
        """canonicals_df() as a dict on the driver; use canonicals_df() where there may be many."""
        return {r[0]: r[1] for r in self.canonicals_df(n).collect()}

    def synthesize(self, strategy: str = "first") -> DataFrame:
        """One row per canonical id: of every column the first (last) value that isn't null, or the least (greatest)."""
        if strategy not in ("first", "last", "min", "max"):
            raise ValueError(f"strategy must be first, last, min or max; got {strategy!r}")
        df = self._result()

        def best(name: str) -> Column:
            c, r = F.col(f"`{name}`"), F.col(_RID)
            if strategy in ("min", "max"):
                return (F.min if strategy == "min" else F.max)(c)
            return (F.min_by if strategy == "first" else F.max_by)(c, F.when(c.isNotNull(), r))

        rest = [c for c in df.columns if c not in (_RID, self._cid)]
        return df.groupBy(F.col(f"`{self._cid}`")).agg(*[best(c).alias(c) for c in rest]).orderBy(F.col(f"`{self._cid}`"))

    def explain(self) -> str | None:
        """The rules that are applied, as text."""
        if not self._rules:
            return None
        if self._kind == "sequence":
            return "\n".join(map(str, self._rules))
        if self._kind == "pipeline":
            return str(self._rules)
        lines = [f"    {c!r}: ({', '.join(map(str, own))},)," for c, own in self._rules.items()]
        return "\n".join(["{", *lines, "}"])

    def explain_plan(self, mode: str = "formatted") -> None:
        """Spark's plan of the canonicalized table."""
        self._result().explain(mode=mode)


def dedupe(df: DataFrame, /, **options) -> Dedupe:
    return Dedupe(df, **options)


def drop_duplicates_by(rule: str, columns, *, keep: str = "first", **settings):
    """For DataFrame.transform: df.transform(drop_duplicates_by("fuzzy", "address", threshold=0.6))."""
    made = REGISTRY[rule](**settings)
    return lambda df: dedupe(df).apply(made).drop_duplicates(columns, keep=keep)
