"""Text preprocessors: functions from a string column to a string column, used before rows are compared."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Preprocessor:
    """A named column function; build your own from any Column -> Column function."""

    name: str
    apply: Callable[[Column], Column]

    def __call__(self, c: Column) -> Column:
        return self.apply(c)

    def __str__(self) -> str:
        return self.name


def strip() -> Preprocessor:
    """Remove Unicode white space at both ends."""

    def run(c: Column) -> Column:  # the pattern is slow on long texts, so only those with white space at an end meet it
        ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
        return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(c)

    return Preprocessor("strip()", run)


def lower() -> Preprocessor:
    return Preprocessor("lower()", F.lower)


def alnum() -> Preprocessor:
    """Keep ASCII letters and digits only."""
    return Preprocessor("alnum()", lambda c: F.regexp_replace(c, "[^0-9A-Za-z]+", ""))


def remove_punctuation() -> Preprocessor:
    """Remove what is neither an ASCII word character nor white space."""
    return Preprocessor("remove_punctuation()", lambda c: F.regexp_replace(c, r"[^\w\s]+", ""))


def _python(function):
    """A Python function of a text as a column function; texts come by the hundred, not in large Arrow batches, however long they are."""
    return F.udf(lambda t: None if t is None else function(t), "string", useArrow=False)


#: The first character that each Unicode form can change, or that can change with one before it.
_FORMS = {"NFC": 0x300, "NFD": 0xC0, "NFKC": 0xA0, "NFKD": 0xA0}


def _normalized(c: Column, form: str) -> Column:
    """c in a Unicode form; only texts that the form can change go through Python."""
    changes = c.rlike(f"[^\\x{{0}}-\\x{{{_FORMS[form] - 1:X}}}]")
    run = _python(lambda t: unicodedata.normalize(form, t))
    return F.when(changes, run(F.when(changes, c))).otherwise(c)


def normalize_unicode(form: str = "NFKD") -> Preprocessor:
    if form not in _FORMS:
        raise ValueError(f"unknown Unicode form {form!r}")
    return Preprocessor(f"normalize_unicode(form={form!r})", lambda c: _normalized(c, form))


def ascii_fold() -> Preprocessor:
    """Drop combining accents after compatibility decomposition."""
    return Preprocessor("ascii_fold()", lambda c: F.regexp_replace(_normalized(c, "NFKD"), "[\\u0300-\\u036F]", ""))


# Common English function words.
ENGLISH = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don "
    "down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more "
    "most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their "
    "theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why "
    "will with you your yours yourself yourselves"
).split()


def remove_stopwords(words: list[str] | None = None, language: str = "english") -> Preprocessor:
    """Delete whole words (case matters, the blanks around them stay); words replaces the built-in English list."""
    if not words and language != "english":
        raise ValueError(f"there is no built-in list for {language!r}; give words=")
    chosen = words or ENGLISH
    quoted = lambda w: re.sub(r"([^\w\s])", r"\\\1", w)
    # Word boundaries of ASCII letters, digits and _, stated as what may stand on either side.
    edge = lambda inside, mark: f"(?<{mark}\\w)" if inside else f"(?{mark}\\w)"
    plain = [w for w in chosen if re.match(r"\w", w, re.A) and re.search(r"\w$", w, re.A)]
    odd = [w for w in chosen if w and w not in plain]
    ends = lambda w: (edge(True, "!" if re.match(r"\w", w, re.A) else "="), edge(False, "!" if re.search(r"\w$", w, re.A) else "="))
    parts = [f"{ends('a')[0]}(?:{'|'.join(map(quoted, plain))}){ends('a')[1]}"] if plain else []
    parts += [f"{ends(w)[0]}{quoted(w)}{ends(w)[1]}" for w in odd]
    pattern = "|".join(parts)
    return Preprocessor(f"remove_stopwords({len(chosen)} words)", lambda c: F.regexp_replace(c, pattern, "") if pattern else c)


_TITLES = set("mr mrs ms miss mx dr prof professor sir madam dame lord lady rev reverend hon judge capt captain col colonel gen general lt sgt father sister brother".split())
_SUFFIXES = set("jr sr ii iii iv v esq phd md dds dvm mba cpa qc obe".split())


def clean_name(name: str) -> str:
    """First, middle and last name; titles, suffixes and nicknames are left out, `Last, First` is turned round."""
    name = re.sub(r"\([^)]*\)|\"[^\"]*\"|'[^']*'(?=\s|$)", " ", name)
    bare = lambda w: w.replace(".", "").lower()
    parts = [p.split() for p in name.split(",")]
    parts = [p for i, p in enumerate(parts) if p and not (i and all(bare(w) in _SUFFIXES for w in p))]
    if len(parts) > 1:
        words = parts[1] + parts[0]
    else:
        words = parts[0] if parts else []
    while words and bare(words[0]) in _TITLES:
        words = words[1:]
    while len(words) > 1 and bare(words[-1]) in _SUFFIXES:
        words = words[:-1]
    return " ".join(words)


def normalize_names() -> Preprocessor:
    return Preprocessor("normalize_names()", lambda c: _python(clean_name)(c))


_LEGAL = (
    "incorporated", "inc", "corporation", "corp", "company", "co", "limited", "ltd", "llc", "l.l.c", "llp", "lp", "plc", "gmbh", "ag", "kg", "ohg",
    "e.k", "sa", "s.a", "sarl", "s.a.r.l", "sas", "srl", "s.r.l", "spa", "s.p.a", "bv", "b.v", "nv", "n.v", "oy", "ab", "as", "a/s", "aps", "pty", "pte",
)


def normalize_company() -> Preprocessor:
    """Delete legal forms (Ltd., LLC, GmbH, ...) and punctuation from the end of a name, as often as they come."""
    forms = "|".join(x.replace(".", r"\.") for x in sorted(_LEGAL, key=len, reverse=True))
    return Preprocessor("normalize_company()", lambda c: F.regexp_replace(F.trim(c), rf"(?i)(?:[\s,]+(?:{forms})\.?)*[\s,.;]*$", ""))
