"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

All documents, in the order of (id, hash of the text), are one long sequence of lines; a line's place in it is
a long. Prefix doubling ranks the suffixes by their first 1, 2, 4, ... lines: rank k+1 of place p sorts
the pairs (rank k of p, rank k of p + 2**k). A rank is kept only for suffixes that share that prefix with
another one; the others are told apart already and drop out, so the rounds shrink fast. Ranks ascend
with the sorted pairs, so the ranks of a round are the suffix array up to that depth.

A longest-common-prefix interval of depth L is a set of suffixes whose first L lines agree: the
places with equal (rank k of p, rank k of p + L - 2**k), 2**k <= L < 2**(k+1). For each line two depths matter, the
fewest lines from it on, and up to it, that hold MIN_WORDS words. If the interval at that depth has an earlier
member, the run is a later copy. The union of those runs is exactly the union of all maximal
repeated runs of MIN_WORDS words or more (every line of such a run lies in the shortest run from its
first line on, or in a shortest run that ends with or after the line), and is deleted.

Scale: text is read twice, to hash the lines and to write what stays. Between, a line is three
longs. Everything is an equi-join or an aggregation with partial sums; a line that fills a third of the
corpus is one row after the map-side sum, and joins against one row per class can be split by AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.common import WORD, documents, hold, materialize

MIN_WORDS = 50


def _key(text: Column) -> Column:
    return F.xxhash64(text, F.lit("document"))


def _lines(docs: DataFrame) -> DataFrame:
    """(place, doc_id, key, pos, h1, h2, words) of every line; places ascend without gaps inside a document."""
    line = lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("line"), x).alias("h2"), F.regexp_count(x, F.lit(WORD)).alias("words"))
    hashed = docs.select("doc_id", _key(F.col("text")).alias("key"), F.transform(F.split("text", "\n"), line).alias("lines"))
    ordered = hashed.dropDuplicates(["doc_id", "key"]).orderBy("doc_id", "key")
    rows = ordered.select("doc_id", "key", F.posexplode("lines").alias("pos", "line"))
    return materialize(rows.select(F.monotonically_increasing_id().alias("place"), "doc_id", "key", "pos", "line.h1", "line.h2", "line.words"), "lines")


def _ranked(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(place, doc_start, rank) of the places that share (a, b) with another one; rank ascends with (a, b)."""
    pairs = pairs.select("place", "doc_start", F.col(a).alias("first_half"), F.col(b).alias("second_half"))
    keys = ["first_half", "second_half"]
    shared = pairs.groupBy(keys).agg(F.count("*").alias("n")).where("n > 1").select(keys)
    ranks = materialize(shared.orderBy(keys).withColumn("rank", F.monotonically_increasing_id()), "ranks")
    return materialize(pairs.join(ranks, keys).select("place", "doc_start", "rank"), "ranked")


def _deeper(level: DataFrame, lines: int) -> DataFrame:
    """The next round: from ranks by `lines` lines to ranks by twice as many."""
    ahead = level.select((F.col("place") - lines).alias("place"), "doc_start", F.col("rank").alias("rank2"))
    return _ranked(level.join(ahead, ["place", "doc_start"]), "rank", "rank2")


def _windows(shared: DataFrame, min_words: int) -> DataFrame:
    """(place, size, doc_start) of the shortest runs of min_words words from each line on and up to each line.

    Only lines that occur twice or more (shared: place, doc_start, words) can be in a repeated run, so
    runs end where a line in between occurs once.
    """
    doc = Window.partitionBy("doc_start").orderBy("place")
    island = shared.withColumn("island", F.col("place") - F.row_number().over(doc))
    within = Window.partitionBy("doc_start", "island")
    upto = within.orderBy("place")
    sums = island.withColumn("before", F.coalesce(F.sum("words").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn("after", F.col("before") + F.col("words"))
    # An edge lies before the first and after each line. Sorting edges and wanted sums together finds the
    # nearest edge on either side with running aggregates.
    events = sums.select(
        "doc_start", "island",
        F.inline(F.array(
            F.struct(F.col("after").alias("at"), F.lit(0).alias("kind"), (F.col("place") + 1).alias("edge")),
            F.struct(F.col("before").alias("at"), F.lit(0).alias("kind"), F.col("place").alias("edge")),
            F.struct((F.col("before") + min_words).alias("at"), F.lit(1).alias("kind"), F.col("place").alias("edge")),
            F.struct((F.col("after") - min_words).alias("at"), F.lit(2).alias("kind"), (F.col("place") + 1).alias("edge")),
        )),
    )
    edge = F.when(F.col("kind") == 0, F.col("edge"))
    found = events.withColumn("first_end", F.min(edge).over(within.orderBy(F.desc("at"), F.asc("kind")).rowsBetween(Window.unboundedPreceding, 0)))
    found = found.withColumn("last_start", F.max(edge).over(within.orderBy(F.asc("at"), F.asc("kind")).rowsBetween(Window.unboundedPreceding, 0)))
    start = F.when(F.col("kind") == 1, F.col("edge")).otherwise(F.col("last_start"))
    end = F.when(F.col("kind") == 1, F.col("first_end")).otherwise(F.col("edge"))
    runs = found.where("kind > 0").select("doc_start", start.alias("place"), (end - start).alias("size"))
    return runs.where("size > 0").distinct()


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, pos, size): runs of lines that are part of later copies, merged so that none overlap."""
    lines = _lines(docs)
    started = lines.withColumn("doc_start", F.col("place") - F.col("pos"))
    level = _ranked(started.select("place", "doc_start", "h1", "h2"), "h1", "h2")
    runs = materialize(_windows(level.join(lines.select("place", "words"), "place"), min_words), "runs")
    deepest, size, later = runs.agg(F.max("size")).first()[0] or 1, 1, []
    while True:
        here = runs.where((F.col("size") >= size) & (F.col("size") < 2 * size))
        head = level.select("place", "doc_start", F.col("rank").alias("head"))
        tail = level.select(F.col("place").alias("tail_place"), F.col("rank").alias("tail"))
        keyed = here.join(head, ["place", "doc_start"]).withColumn("tail_place", F.col("place") + F.col("size") - size).join(tail, "tail_place")
        # An interval's first member; as a table of its own, so that a hot interval's rows can be split in the join.
        first = keyed.groupBy("size", "head", "tail").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        copies = keyed.join(materialize(first, "intervals"), ["size", "head", "tail"]).where("place > first")
        later.append(materialize(copies.select("place", "doc_start", F.col("size").cast("long").alias("size")), "copies"))
        if 2 * size > deepest:
            break
        level, size = _deeper(level, size), 2 * size
    found = later[0]
    for x in later[1:]:
        found = found.unionByName(x)
    up_to = Window.partitionBy("doc_start").orderBy("place")
    ends = found.groupBy("doc_start", "place").agg((F.col("place") + F.max("size")).alias("end"))
    reached = F.max("end").over(up_to.rowsBetween(Window.unboundedPreceding, -1))
    merged = ends.withColumn("from", F.greatest("place", F.coalesce(reached, F.col("place")))).where("end > from")
    first_lines = lines.where("pos = 0").select(F.col("place").alias("doc_start"), "doc_id", "key")
    return merged.join(first_lines, "doc_start").select(
        "doc_id", "key", (F.col("from") - F.col("doc_start")).cast("int").alias("pos"), (F.col("end") - F.col("from")).cast("int").alias("size")
    )


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Texts without later copies of repeated line runs of min_words words or more.

    Returns a row per input row: doc_id, text (what stays, lines joined by newline), n_lines, n_removed (long).
    Documents come in the order of id, then of a hash of the text; the first copy of a run stays whole.

    Defined cases: a null text is the empty text, which is one empty line; a null id comes first; rows that
    repeat an id and a text are one document and get the same result each; an empty table
    gives an empty result; other columns are ignored.
    """
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    gone = F.flatten(F.collect_list(F.sequence(F.col("pos"), F.col("pos") + F.col("size") - 1))).alias("gone")
    cut = repeated_runs(picked, min_words).groupBy("doc_id", "key").agg(gone).select(F.col("doc_id").alias("r_id"), F.col("key").alias("r_key"), "gone")
    keyed = picked.withColumn("key", _key(F.col("text")))
    met = keyed.join(cut, keyed.doc_id.eqNullSafe(F.col("r_id")) & (keyed.key == F.col("r_key")), "left")
    met = hold(met.select("doc_id", "text", "gone"), lines=F.split("text", "\n"))
    stays = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get(F.col("lines"), i))
    return met.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) - words AS ahead FROM w),
f AS (SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.ahead >= 50 GROUP BY ALL),
g AS (SELECT a.doc_id, max(b.pos) AS s, a.pos AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos <= a.pos AND a.upto - b.ahead >= 50 GROUP BY a.doc_id, a.pos),
r AS (SELECT doc_id, s, e FROM f UNION SELECT doc_id, s, e FROM g),
k AS (SELECT r.doc_id, s, e, array_to_string(list_slice(ls, s + 1, e + 1), chr(10)) AS body FROM r JOIN d ON r.doc_id = d.doc_id),
x AS (SELECT *, row_number() OVER (PARTITION BY e - s, body ORDER BY doc_id, s) AS nth FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos FROM x WHERE nth > 1)
SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id
"""
