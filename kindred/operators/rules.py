"""Rules: what makes two rows alike. Factories, validation, negation and the registry of custom rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from kindred.functions.minhash import bands
from kindred.functions.ratios import SCORERS


class InvalidRuleError(TypeError):
    """Something that isn't a rule stands where one is expected."""


SINGLE, COMPOUND, EITHER = "one column", "several columns", "one or several columns"


@dataclass(frozen=True)
class Rule:
    """kind names the algorithm, args its settings; predicates select rows, all others relate pairs of rows."""

    kind: str
    args: dict = field(default_factory=dict)
    arity: str = SINGLE
    predicate: bool = False
    negated: bool = False

    def __invert__(self) -> Rule:
        if not self.predicate:
            raise TypeError(f"{self.kind} relates rows to each other and can't be negated; only predicates can")
        return replace(self, negated=not self.negated)

    def check(self, columns) -> None:
        several = not isinstance(columns, str)
        if several and self.arity == SINGLE:
            raise ValueError(f"{self.kind} compares a single column, but got the columns {tuple(columns)}")
        if not several and self.arity == COMPOUND:
            raise ValueError(f"{self.kind} compares several columns, but got only {columns!r}")

    def __str__(self) -> str:
        own = self.args.get("function")
        name, args = (own.__name__, self.args["settings"]) if own else (self.kind, self.args)
        return f"{'~' if self.negated else ''}{name}({', '.join(f'{k}={v!r}' for k, v in args.items())})"

    __repr__ = __str__


def _threshold(t: float) -> float:
    if not 0 <= t < 1:
        raise ValueError(f"a threshold must be at least 0 and less than 1; got {t}")
    return float(t)


def exact() -> Rule:
    """Equal values; several columns compare as a tuple, in which nulls are equal."""
    return Rule("exact", {}, EITHER)


def fuzzy(threshold: float = 0.95, scorer: str = "simple_ratio") -> Rule:
    """String similarity above the threshold; an unknown scorer falls back to simple_ratio."""
    return Rule("fuzzy", {"threshold": _threshold(threshold), "scorer": scorer if scorer in SCORERS else "simple_ratio"})


#: Settings of the TF-IDF weights and what they are unless given.
WEIGHTING = {"lowercase": True, "binary": False, "sublinear_tf": False, "use_idf": True, "smooth_idf": True}


def tfidf(threshold: float = 0.95, ngram: int | tuple[int, int] = 3, topn: int = 2, **weighting) -> Rule:
    """Cosine of character n-gram TF-IDF vectors above the threshold, among each row's topn best (itself included).

    weighting: lowercase the text; binary counts; 1 + ln(count) instead of the count (sublinear_tf); use_idf, and
    whether it counts as if one more row held every n-gram (smooth_idf).
    """
    low, high = (ngram, ngram) if isinstance(ngram, int) else ngram
    if not 1 <= low <= high or topn < 1:
        raise ValueError("ngram needs 1 <= low <= high, and topn at least 1")
    if unknown := set(weighting) - set(WEIGHTING):
        raise TypeError(f"tfidf has no setting {sorted(unknown)}; it has {', '.join(WEIGHTING)}")
    return Rule("tfidf", {"threshold": _threshold(threshold), "ngram": (low, high), "topn": topn} | {k: bool(v) for k, v in weighting.items()})


def lsh(threshold: float = 0.95, ngram: int = 3, num_perm: int = 128) -> Rule:
    """A shared band of min-hashes of character n-grams, with the banding that fits the threshold."""
    if ngram < 1 or num_perm < 2:
        raise ValueError("ngram must be at least 1 and num_perm at least 2")
    bands(_threshold(threshold), num_perm)
    return Rule("lsh", {"threshold": float(threshold), "ngram": ngram, "num_perm": num_perm})


def jaccard(threshold: float = 0.95) -> Rule:
    """Shared values across the columns (whichever column they are in, nulls left out), as a share of all values."""
    return Rule("jaccard", {"threshold": _threshold(threshold)}, COMPOUND)


def cosine(threshold: float = 0.95) -> Rule:
    """Cosine of the columns as a vector (or of one array column); missing numbers count as 0."""
    return Rule("cosine", {"threshold": _threshold(threshold)}, EITHER)


def isna() -> Rule:
    return Rule("isna", predicate=True)


def isin(values: Iterable | str) -> Rule:
    """The cell is one of the values; for a string, the cell is part of it."""
    return Rule("isin", {"values": values if isinstance(values, str) else list(values)}, predicate=True)


def str_startswith(pattern: str, case: bool = True) -> Rule:
    return Rule("str_startswith", {"pattern": pattern, "case": case}, predicate=True)


def str_endswith(pattern: str, case: bool = True) -> Rule:
    return Rule("str_endswith", {"pattern": pattern, "case": case}, predicate=True)


def str_contains(pattern: str, case: bool = True, regex: bool = False) -> Rule:
    return Rule("str_contains", {"pattern": pattern, "case": case, "regex": regex}, predicate=True)


def str_len(min_len: int = 0, max_len: int | None = None) -> Rule:
    """min_len < length <= max_len."""
    return Rule("str_len", {"min_len": min_len, "max_len": max_len}, predicate=True)


REGISTRY: dict[str, Callable[..., Rule]] = {f.__name__: f for f in (exact, fuzzy, tfidf, lsh, jaccard, cosine, isna, isin, str_startswith, str_endswith, str_contains, str_len)}


def _register(kind: str):
    def decorate(f):
        def make(*args, **settings) -> Rule:
            if args:
                raise TypeError(f"{f.__name__} takes keyword arguments only")
            return Rule(kind, {"function": f, "settings": settings}, EITHER)

        make.__name__, make.__doc__ = f.__name__, f.__doc__
        REGISTRY[f.__name__] = make
        return make

    return decorate


def register(f):
    """A rule from f(values, **settings) that yields pairs of positions (i, j).

    f sees the values of one block in row order, in one task: use block_on to bound the size of blocks.
    """
    return _register("pairs")(f)


def register_key(f):
    """A rule from f(column, **settings) -> column: rows with the same non-null key are alike. Scales like exact."""
    return _register("key")(f)


def register_pair_predicate(f):
    """A rule from f(left, right, **settings) -> boolean column on two values; a theta join within blocks."""
    return _register("theta")(f)
