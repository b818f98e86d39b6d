"""Language identification with bit-sliced Bloom filters over character n-grams.

One Bloom filter serves all languages: every slot is a bitmask with a bit per language, in as many planes of PLANE bits as
the learned languages need. Probing an n-gram ANDs
the masks of its PROBES slots, which gives all languages that have it at once. A document's popcount
per language, corrected for the false positives that the language's share of set bits causes, divided by its
n-grams is the language's coverage; the highest coverage decides.

A language has an n-gram if it is frequent in it (RATE) and at least half as frequent as in the language that
uses it most (SHARE). Rates come from a bounded sample, about SAMPLE documents per language (fewer if there
are fewer), chosen by a hash of the id; whole texts are used. At most 1 / RATE n-grams of each order per
language pass, so the filter's size is bounded whatever the size of the table.

Scale: scoring is one narrow pass; text is turned into arrays of code points, and hashing, probing and counting
are numpy operations over blocks of BLOCK n-grams, so memory doesn't depend on the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import documents, filter_rows, id_crc, materialize, prepare, sized, slices, table_of

ORDERS, PROBES, SLOTS = (3, 4), 3, 1 << 20
SAMPLE, RATE, SHARE, PLANE = 3000, 2e-5, 0.5, 64
BLOCK = 1 << 19
UNKNOWN = "und"
#: Documents whose best language covers less than this are no text in any known language.
COVERAGE = 0.1

_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "letters" not in _TABLES:
        _TABLES["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _TABLES["letters"]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, runs of other characters as one blank, blanks at both ends; and each text's length."""
    whole = "".join([" " + t.lower() + " " for t in texts])
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t.lower()) + 2 for t in texts), np.int64, len(texts))
    letter = _letters()[codes]
    starts = np.cumsum(sizes) - sizes
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts] = True
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[keep]
    return np.where(letter, codes, 32)[keep].astype(np.uint64), np.bincount(owner, minlength=len(texts))


_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _grams(codes: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash for each run of `order` code points."""
    n = len(codes) - order + 1
    h = np.full(max(n, 0), order, np.uint64)
    for j in range(order):
        h = (h ^ codes[j : j + len(h)]) * _MULTIPLIERS[j]
        h ^= h >> np.uint64(29)
    return h


def _blocks(codes: np.ndarray, sizes: np.ndarray):
    """(hashes, owners) of the n-grams that lie within one text, a block at a time."""
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    for order in ORDERS:
        for i in range(0, len(codes) - order + 1, BLOCK):
            h = _grams(codes[i : i + BLOCK + order - 1], order)
            own, last = owner[i : i + len(h)], owner[i + order - 1 : i + order - 1 + len(h)]
            inside = own == last
            yield h[inside], own[inside]


def _counted(batches):
    from collections import defaultdict

    sums: dict[str, list[np.ndarray]] = defaultdict(list)

    def merged(parts):
        keys = np.concatenate([p[0] for p in parts])
        values = np.concatenate([p[1] for p in parts])
        unique, at = np.unique(keys, return_inverse=True)
        return unique, np.bincount(at, values).astype(np.int64)

    for b in batches:
        for s in slices(b, b.num_columns - 1):
            langs, texts = s.column(0).to_pylist(), s.column(1).to_pylist()
            by = defaultdict(list)
            for lang, t in zip(langs, texts):
                by[lang].append(t)
            for lang, own in by.items():
                codes, sizes = _codes(own)
                for h, _ in _blocks(codes, sizes):
                    sums[lang].append(np.unique(h, return_counts=True))
                if len(sums[lang]) > 16:
                    sums[lang] = [merged(sums[lang])]
    for lang, parts in sums.items():
        if not parts:  # no text was long enough
            continue
        keys, n = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


class Model:
    """Languages, the bit-sliced filter, and each language's false-positive rate."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], common: str | None):
        self.langs, self.common = langs, common
        self.filter = np.zeros((-(-len(langs) // PLANE), SLOTS), np.uint64)
        for i, own in enumerate(grams):
            for slots in self.slots(own.view(np.uint64)):
                self.filter[i // PLANE][slots] |= np.uint64(1 << i % PLANE)
        fill = [float(((self.filter[i // PLANE] >> np.uint64(i % PLANE)) & np.uint64(1)).mean()) for i in range(len(langs))]
        self.false = np.array([f**PROBES for f in fill])

    @staticmethod
    def slots(h: np.ndarray):
        for p in range(PROBES):
            yield ((h >> np.uint64(20 * p + 2)) & np.uint64(SLOTS - 1)).astype(np.int64)

    def coverage(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each text's n-grams per language, and whether the text has a letter."""
        codes, sizes = _codes(texts)
        n, k = len(texts), len(self.langs)
        hits, total = np.zeros((n, k)), np.zeros(n)
        has = np.bincount(np.repeat(np.arange(n), sizes), codes != 32, minlength=n) > 0
        for h, own in _blocks(codes, sizes):
            total += np.bincount(own, minlength=n)
            at = list(self.slots(h))
            for p, plane in enumerate(self.filter):
                mask = plane[at[0]]
                for slots in at[1:]:
                    mask = mask & plane[slots]
                if k <= 8:  # all popcounts at once
                    seen = np.bincount(own.astype(np.int64) << k | mask.astype(np.int64), minlength=n << k).reshape(n, 1 << k)
                    hits += seen @ ((np.arange(1 << k)[:, None] >> np.arange(k)) & 1)
                else:
                    for i in range(p * PLANE, min(k, (p + 1) * PLANE)):
                        hits[:, i] += np.bincount(own, (mask >> np.uint64(i % PLANE)) & np.uint64(1), minlength=n)
        grams = np.maximum(total, 1)[:, None]
        return np.clip((hits - self.false * grams) / ((1 - self.false) * grams), 0, 1), has


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from docs (doc_id, lang, text), all of which may be learned from; null languages and texts are left out."""
    prepare(docs.sparkSession)
    known = docs.where("lang IS NOT NULL")
    counts = sorted(((r["count"], r["lang"]) for r in known.groupBy("lang").count().collect()), key=lambda x: (-x[0], x[1]))
    if not counts:
        return Model([], [], None)
    langs = sorted(lang for _, lang in counts)
    cuts = table_of(docs.sparkSession, [(lang, int(min(1.0, sample / n) * (1 << 20))) for n, lang in counts], "lang string, cut int")
    chosen = known.where("text IS NOT NULL").join(F.broadcast(cuts), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) < F.col("cut"))
    grams = chosen.select("lang", "text").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = materialize(sized(grams, 64 * sum(min(n, sample) for n, _ in counts)), "grams")  # n-grams of so many texts, narrow rows
    totals = grams.groupBy("lang").agg(F.sum("n").cast("double").alias("total"))
    rated = grams.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate")).where(F.col("rate") >= RATE)
    most = rated.groupBy("gram").agg(F.max("rate").alias("most"))
    rows = rated.join(most, "gram").where(F.col("rate") >= SHARE * F.col("most")).select("lang", "gram").toPandas()
    by = {lang: g["gram"].to_numpy(np.int64) for lang, g in rows.groupby("lang")}
    return Model(langs, [by.get(x, np.zeros(0, np.int64)) for x in langs], counts[0][1])


def predict(docs: DataFrame, model: Model, extra: list[str] = ()) -> DataFrame:
    """docs (columns `extra`, text) -> extra, lang_pred, score, coverage."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # SLOTS * 8 bytes for each 64 languages, whatever the rows

    def run(batches):
        m = shared.value
        for b in batches:
            for s in slices(b, b.num_columns - 1):
                texts = [t or "" for t in s.column(s.num_columns - 1).to_pylist()]
                cover, has = m.coverage(texts)
                if m.langs:
                    order = np.argsort(-cover, axis=1, kind="stable")
                    rows = np.arange(len(texts))
                    best = cover[rows, order[:, 0]]
                    second = cover[rows, order[:, 1]] if len(m.langs) > 1 else np.zeros(len(texts))
                    names = [m.langs[i] if c > 0 else m.common for i, c in zip(order[:, 0], best)]
                    score = np.where(best > 0, best / np.maximum(best + second, 1e-12), 0.0)
                else:
                    names, best, score = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                names = [x if ok else UNKNOWN for x, ok in zip(names, has)]
                score = np.where(has, score, 0.0)
                kept = [s.column(i) for i in range(s.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(score), pa.array(np.where(has, best, 0.0))], [*s.schema.names[:-1], "lang_pred", "score", "coverage"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*extra).schema.fields]
    return docs.select(*extra, "text").mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double", "coverage double"]))


def _picked(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, coverage of every row.

    Learns from rows whose crc32(id) mod 4 is not 2 and whose language is known. score is the best coverage
    relative to the best two. Defined cases: a null text or one without a letter is `und` with score 0; a text
    with letters but no known n-gram gets the most common language with score 0; without any known language all is
    `und`; a null id counts as the empty text in the hash; repeated rows repeat; other columns are ignored.
    """
    picked = _picked(docs, doc_id, text, lang).withColumn("held_out", id_crc(F.col("doc_id")) % 4 == 2)
    return predict(picked, train(picked.where("NOT held_out")), ["doc_id", "held_out"])


def keep_known_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, whose text is in a known language (coverage COVERAGE at least).

    Null and empty texts and those without a letter go; rows that repeat are judged alike. Where no language is known (no labels at
    all) nothing can be judged and all stay.
    """
    model = train(_picked(docs, doc_id, text, lang).where(id_crc(F.col("doc_id")) % 4 != 2))
    if not model.langs:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge():
        def good(texts):
            cover, has = shared.value.coverage(texts)
            return has & (cover.max(axis=1) >= COVERAGE)

        return good

    return filter_rows(docs, text, judge)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))
