"""Pipelines of steps: col(...).rule(...), lists of them for AND, steps in a row for OR, ~ for NOT."""

from __future__ import annotations

from collections.abc import Callable

from kindred.operators.rules import REGISTRY, Rule
from kindred.operators.steps import Unit


def as_preprocessors(given) -> tuple | None:
    """A tuple of column functions; None where nothing was given, so that an outer level applies."""
    if given is None or given == []:
        return None
    several = list(given) if isinstance(given, (list, tuple)) else [given]
    for p in several:
        if not isinstance(p, Callable) or isinstance(p, (type, Rule)):
            raise TypeError(f"a preprocessor is a function from column to column; got {p!r}")
    return tuple(several) or None


class Col:
    """A column, or a tuple of columns, and the rule that a method call puts on it."""

    def __init__(self, columns, preprocessors=None, rule: Rule | None = None):
        self._columns = columns if isinstance(columns, str) else tuple(columns)
        self._preprocessors, self._rule = as_preprocessors(preprocessors), rule

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in REGISTRY:
            raise AttributeError(f"there is no rule {name!r}; known are {', '.join(REGISTRY)}")

        def on(*args, **settings) -> Col:
            if self._rule is not None:
                raise ValueError(f"{self} has a rule already; use another col() for another rule")
            return Col(self._columns, self._preprocessors, REGISTRY[name](*args, **settings))

        return on

    def __dir__(self):
        return [*super().__dir__(), *REGISTRY]

    def __invert__(self) -> Col:
        return Col(self._columns, self._preprocessors, ~self._ruled())

    def _ruled(self) -> Rule:
        if self._rule is None:
            raise ValueError(f"col({self._columns!r}) has no rule yet")
        return self._rule

    def unit(self, inherited: tuple | None) -> Unit:
        rule = self._ruled()
        rule.check(self._columns)
        return Unit(self._columns, rule, (self._preprocessors if self._preprocessors is not None else inherited) or ())

    def __str__(self) -> str:
        if self._rule is None:
            return f"col({self._columns!r})"
        return f"{'~' if self._rule.negated else ''}col({self._columns!r}).{str(self._rule).removeprefix('~')}"

    __repr__ = __str__


class Pipeline:
    """Steps that are applied one after the other; every call gives a new pipeline."""

    def __init__(self, preprocessors=None, steps: tuple = ()):
        self._preprocessors, self._steps = as_preprocessors(preprocessors), tuple(steps)

    def step(self, rules: Col | list[Col], /, *, preprocessors=None) -> Pipeline:
        """A rule, or a list of rules that must all hold. Predicates come first."""
        cols = list(rules) if isinstance(rules, (list, tuple)) else [rules]
        if not cols:
            raise ValueError("a step needs one rule at least")
        for c in cols:
            if not isinstance(c, Col):
                raise TypeError(f"a step takes col(...) with a rule, or a list of them; got {c!r}")
            c._ruled()
        cols.sort(key=lambda c: not c._rule.predicate)
        return Pipeline(self._preprocessors, (*self._steps, (tuple(cols), as_preprocessors(preprocessors))))

    def units(self) -> list[list[Unit]]:
        """Preprocessors of the column override those of the step, and these those of the pipeline."""
        return [[c.unit(own if own is not None else self._preprocessors) for c in cols] for cols, own in self._steps]

    def __str__(self) -> str:
        lines = ["pipeline()"]
        for cols, _ in self._steps:
            lines += ["    .step([", *[f"        {c}," for c in cols], "    ])"]
        return "\n".join(lines)

    __repr__ = __str__


def col(columns, /, *, preprocessors=None) -> Col:
    return Col(columns, preprocessors)


def pipeline(preprocessors=None) -> Pipeline:
    return Pipeline(preprocessors)
