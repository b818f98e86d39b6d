"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Every rule rejects a document when a measure of it reaches a cutoff. Cutoffs are not chosen by hand: labelled documents
decide. One part of the good ones, SHAPE, gives each rule its scale (a high quantile of its measure, or a floor); a document's
score is the largest of its measures on these scales. So one declared path of cutoffs, PATH, from the mildest on, moves all
rules together, and no risk has to be shared out among them. The other good ones are a holdout: per stratum
(language) a cutoff is proven if the exact binomial test P(Bin(n, RISK) <= rejected) <= ALPHA / strata
holds for it and for all milder ones (fixed-sequence testing, so the number of cutoffs costs nothing;
strata are corrected for by Bonferroni). Of the proven cutoffs the one that parts bad labels from good ones best is taken, the
mildest of equals. So a stratum loses more than RISK of its good documents (of those that pass the base rule) with a chance of ALPHA
at most, over all strata. A stratum with fewer than LEAST good labels could prove nothing at any cutoff; it isn't tested, and nothing is
rejected in it.

Scale: the measures come from one narrow pass over the text. Everything about one document stays in
its row: word triples become sorted arrays of 64-bit integers (hash and place packed together), so
no word is ever shuffled. The holdout is joined as numbers and aggregated to one row per stratum; those with LEAST good labels
or more reach the driver, so their number is at most a ninety-ninth of the labels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import WORD, documents, hold, labels, materialize, table_of

#: Labels whose id has an MD5 below SHAPE (an eighth) give the scales.
RISK, ALPHA, SHAPE = 0.03, 0.05, "2"
#: Cutoffs in the order in which they are tried, as multiples of each rule's scale; and the quantile that is the scale.
PATH, QUANTILE = [2 ** (4 - t / 4) for t in range(25)], 0.99
#: Fewest labels that can prove anything: (1 - RISK) ** LEAST <= ALPHA.
LEAST = math.ceil(math.log(ALPHA) / math.log(1 - RISK))

#: Rule -> measure of a document, 0 or more; a document is rejected at or above the rule's cutoff. FLOORS: the least scales.
RULES: dict[str, str] = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_text_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "upper_case": "n_upper / greatest(word_chars, 1)",
    "exclamation": "n_exclaim / greatest(word_chars, 1)",
}
FLOORS = {"symbols": 0.01, "duplicate_lines": 0.05, "repeated_words": 0.05, "upper_case": 0.1, "exclamation": 0.01}


def _packed(hashes: Column, bits: Column, size: Column) -> Column:
    """Sorted integers: the hash of the three words from a place on, above `bits` bits that hold the place."""
    start = F.slice(hashes, 1, F.greatest(size - 2, F.lit(0)))
    word = lambda i: F.coalesce(F.get(hashes, i), F.lit(0).cast("long"))
    return F.sort_array(F.transform(start, lambda h, i: F.call_function("shiftleft", F.xxhash64(h, word(i + 1), word(i + 2)), bits).bitwiseOR(i.cast("long"))))


def _repeated(column: str) -> Column:
    """Places (sorted integers' low bits) whose upper bits occur twice or more in the sorted array."""
    a = F.col(column)
    up = lambda x: F.call_function("shiftright", x, F.col("__bits"))
    near = lambda v, i: F.coalesce(up(v) == up(F.get(a, i)), F.lit(False))
    same = F.filter(a, lambda v, i: near(v, i + 1) | near(v, i - 1))
    return F.sort_array(F.transform(same, lambda v: v.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bits")) - 1)))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, plus the counts that the rules use (long).

    Words are runs of anything but ASCII white space; a null text has none.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rest = [c for c in docs.columns if c != text]
    df = hold(
        docs.select(*[F.col(f"`{c}`") for c in rest], t.alias("__text")),
        __words=F.coalesce(F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)), F.array().cast("array<string>")),
        __lines=F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD)),
    )
    df = hold(
        df.withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("n_upper", F.regexp_count("__text", F.lit(r"\p{Lu}")).cast("long"))
        .withColumn("n_exclaim", F.regexp_count("__text", F.lit("!")).cast("long"))
        .withColumn("n_text_lines", F.size("__lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .drop("__text", "__lines"),
        __hashes=F.transform("__words", lambda w: F.xxhash64(w)),
        __n=F.coalesce(F.size("__words"), F.lit(0)),
        __bits=F.coalesce(F.length(F.bin(F.size("__words").cast("long"))), F.lit(1)),
    )
    # Two different hashes in turn: a place counts only if it repeats under both.
    df = hold(df.drop("__words"), __sorted=_packed(F.col("__hashes"), F.col("__bits"), F.col("__n")))
    df = hold(df, __found=_repeated("__sorted"))
    word = lambda i: F.coalesce(F.get(F.col("__hashes"), i), F.lit(0).cast("long"))
    again = F.sort_array(F.transform("__found", lambda p: F.call_function("shiftleft", F.xxhash64(word(p.cast("int") + 2), word(p.cast("int")), word(p.cast("int") + 1)), F.col("__bits")).bitwiseOR(p)))
    df = hold(df, __sorted2=again)
    df = hold(df, __places=_repeated("__sorted2"))
    covered = F.aggregate(
        F.transform("__places", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(F.col("__places"), i + 1) - p, F.lit(3).cast("long")))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return df.withColumn("n_words", F.col("__n").cast("long")).withColumn("n_repeat_words", covered).drop("__hashes", "__n", "__bits", "__sorted", "__found", "__sorted2", "__places")


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def stratum() -> Column:
    """The language, marked so that a null one isn't the empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("stratum")


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose(lost: dict[str, list[int]], goods: dict[str, int], caught: dict[str, list[int]], bads: dict[str, int]) -> dict[str, float]:
    """Cutoff per stratum, where one is proven.

    lost[s][t] of the goods[s] good documents and caught[s][t] of the bads[s] bad ones are rejected at PATH[t].
    """
    tested = [s for s, n in goods.items() if n >= LEAST]
    cutoffs = {}
    for s in tested:
        proven = []
        for t in range(len(PATH)):
            if binomial_at_most(lost[s][t], goods[s], RISK) > ALPHA / len(tested):
                break
            proven.append(t)
        if proven:
            worth = lambda t: caught[s][t] / max(1, bads[s]) - lost[s][t] / goods[s]
            cutoffs[s] = PATH[max(proven, key=lambda t: (worth(t), -t))]
    return cutoffs


def thresholds(measured: DataFrame, labelled: DataFrame) -> tuple[dict[str, float], DataFrame]:
    """Scale of each rule, and the table (stratum, cutoff), from measured documents (doc_id, lang, counts) and labels (doc_id, quality).

    Both sides are narrow. Labels with a null id or quality and ids that repeat are handled: a null proves
    nothing, an id counts as good only if all its labels say so. Documents that fail the base rule prove nothing either.
    """
    spark = measured.sparkSession
    known = labelled.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    shape = (F.md5(F.col("doc_id").cast("string").cast("binary")) < SHAPE).alias("shape")
    held = measured.where(~base_failed()).join(known, "doc_id").select(stratum(), "good", shape, *[F.expr(x).alias(r) for r, x in RULES.items()])
    held = materialize(held, "holdout")
    found = held.where("good AND shape").agg(*[F.percentile(r, F.lit(QUANTILE)).alias(r) for r in RULES]).first()
    scales = {r: max(FLOORS[r], found[r] or 0.0) for r in RULES}
    top = F.greatest(*[F.col(r) / F.lit(x) for r, x in scales.items()])
    # How many cutoffs of the path a document stays below: it is rejected from that step on.
    step = F.size(F.filter(F.array(*[F.lit(c) for c in PATH]), lambda c: c > F.col("score")))
    stepped = held.withColumn("score", top).select("stratum", "good", "shape", step.alias("step"))
    counts = lambda which, name: F.array(*[F.count_if(which & (F.col("step") <= t)) for t in range(len(PATH))]).alias(name)
    proof, bad = F.col("good") & ~F.col("shape"), ~F.col("good")
    rows = stepped.groupBy("stratum").agg(F.count_if(proof).alias("goods"), F.count_if(bad).alias("bads"), counts(proof, "lost"), counts(bad, "caught")).where(F.col("goods") >= LEAST).collect()
    cutoffs = choose(*[{r["stratum"]: r[k] for r in rows} for k in ("lost", "goods", "caught", "bads")])
    return scales, table_of(spark, sorted(cutoffs.items()), "stratum string, cutoff double")


def quality_rules(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts and verdict per row of docs: doc_id, n_words, the base counts, base_failed, kept, rejected_by.

    Defined cases: a null text has no words and fails the base rule; a null id is measured like any other
    and never labelled; a null language is a stratum of its own; repeated rows are returned as often
    as they come; an empty table gives an empty result; columns not named here are ignored.
    """
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    measured = materialize(measures(picked), "measures")
    scales, cuts = thresholds(measured, labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"))
    judged = measured.withColumn("stratum", stratum()).join(F.broadcast(cuts), "stratum", "left")  # a row for each stratum with LEAST labels
    fired = F.filter(F.array(*[F.when(F.expr(x) / F.lit(scales[r]) >= F.col("cutoff"), F.lit(r)) for r, x in RULES.items()]), lambda x: x.isNotNull())
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & (F.size(fired) == 0)).alias("kept"),
        F.array_join(fired, ",").alias("rejected_by"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))


_LIST = list(RULES)
OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
x AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g FROM x WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g WHERE g IS NOT NULL),
c AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r WHERE n > 1) GROUP BY rid),
m AS (
  SELECT rid, doc_id, stratum, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaim, len(ls) AS n_text_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN c USING (rid)
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"{x} AS {r}" for r, x in RULES.items())} FROM m),
k AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT b.*, good, md5(b.doc_id::VARCHAR) < '{SHAPE}' AS shape FROM b JOIN k ON b.doc_id = k.doc_id WHERE NOT base_failed),
s AS (SELECT {", ".join(f"greatest({FLOORS[r]}::DOUBLE, coalesce(quantile_cont({r}, {QUANTILE}) FILTER (good AND shape), 0)) AS s_{r}" for r in _LIST)} FROM h),
p AS (SELECT t, pow(2, 4 - t / 4) AS cut FROM range({len(PATH)}) AS range(t)),
l AS (
  SELECT stratum, t, cut, count(*) FILTER (good AND NOT shape) AS goods, count(*) FILTER (NOT good) AS bads,
         count(*) FILTER (good AND NOT shape AND greatest({", ".join(f"{r} / s_{r}" for r in _LIST)}) >= cut) AS lost,
         count(*) FILTER (NOT good AND greatest({", ".join(f"{r} / s_{r}" for r in _LIST)}) >= cut) AS caught
  FROM h, s, p GROUP BY stratum, t, cut
),
q AS (SELECT *, count(*) OVER () / {len(PATH)} AS strata FROM l WHERE goods >= {LEAST}),
v AS (
  SELECT *, CASE WHEN lost = goods THEN 1 ELSE list_sum(list_transform(range(lost + 1), lambda i:
    exp(lgamma(goods + 1) - lgamma(i + 1) - lgamma(goods - i + 1) + i * ln({RISK}) + (goods - i) * ln(1 - {RISK})))) END AS chance
  FROM q
),
o AS (SELECT *, bool_and(chance <= {ALPHA} / strata) OVER (PARTITION BY stratum ORDER BY t) AS proven FROM v),
z AS (SELECT stratum, cut FROM o WHERE proven QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY caught / greatest(bads, 1) - lost / goods DESC, t) = 1),
f AS (SELECT b.*, {", ".join(f"coalesce({r} / s_{r} >= cut, false) AS f_{r}" for r in _LIST)} FROM b CROSS JOIN s LEFT JOIN z USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(f"f_{r}" for r in _LIST)}) AS kept,
       concat_ws(',', {", ".join(f"CASE WHEN f_{r} THEN '{r}' END" for r in _LIST)}) AS rejected_by
FROM f
"""
