"""Registered queries of the library's own operators, with the same results in SQL where that is practical."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import kindred as kd
from kindred.functions import minhash
from kindred.plans.storage import shared_root
from kindred.sources.batches import table

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


@functools.cache
def _custom():
    """Rules of a user's own, registered once."""

    @kd.register
    def same_length(array, *, min_len: int):
        last: dict[int, int] = {}
        for i, x in enumerate(array):
            if len(x) > min_len:
                if len(x) in last:
                    yield last[len(x)], i
                last[len(x)] = i

    @kd.register_key
    def length_key(c, *, min_len: int):
        return F.when(F.length(c) > min_len, F.length(c))

    @kd.register_pair_predicate
    def same_start_and_length(a, b, *, chars: int):
        return (F.substring(a, 1, chars) == F.substring(b, 1, chars)) & (F.length(a) == F.length(b))

    return same_length, length_key, same_start_and_length


# Exact

_FIRST = "SELECT doc_id, lang, source, n_chars, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id {}) = 1"


@_query(_FIRST.format(""))
def q01_exact_drop_first(spark: SparkSession, d: str) -> DataFrame:
    return kd.dedupe(table(spark, d, "documents"), row_id="doc_id").drop_duplicates("text").select("doc_id", "lang", "source", "n_chars", "text")


@_query(_FIRST.format("DESC"))
def q02_exact_drop_last(spark, d):
    return kd.dedupe(table(spark, d, "documents"), row_id="doc_id").drop_duplicates("text", keep="last").select("doc_id", "lang", "source", "n_chars", "text")


@_query("SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS canonical_id FROM customer")
def q03_exact_canon_compound(spark, d):
    return kd.dedupe(table(spark, d, "customer"), row_id="c_custkey").apply(kd.exact()).canonicalize(("c_nationkey", "c_mktsegment")).collect().select("c_custkey", "canonical_id")


_NO_ERROR = "nullif(event_type, 'error')"


def _events(spark, d):
    return table(spark, d, "events").withColumn("event_type", F.expr(_NO_ERROR))


@_query(f"SELECT event_id, min(event_id) OVER (PARTITION BY coalesce({_NO_ERROR}, 'na')) AS canonical_id FROM events")
def q04_exact_null_placeholder(spark, d):
    return kd.dedupe(_events(spark, d), row_id="event_id").apply(kd.exact()).canonicalize("event_type").collect().select("event_id", "canonical_id")


@_query("SELECT o_orderkey, first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS canonical_id FROM orders")
def q05_id_copy(spark, d):
    return kd.dedupe(table(spark, d, "orders"), row_id="o_orderkey").apply(kd.exact()).canonicalize("o_custkey", id="o_orderpriority").collect().select("o_orderkey", "canonical_id")


@_query("SELECT o_orderkey, first_value(o_orderkey % 100 + 7) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS canonical_id FROM orders")
def q06_iterative_existing_id(spark, d):
    df = table(spark, d, "orders").withColumn("canonical_id", F.col("o_orderkey") % 100 + 7)
    return kd.dedupe(df, row_id="o_orderkey").apply(kd.exact()).canonicalize("o_custkey").collect().select("o_orderkey", "canonical_id")


@_query("""
WITH n AS (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS i FROM customer)
SELECT c_custkey, min(i) OVER (PARTITION BY c_mktsegment, c_nationkey) AS canonical_id FROM n
""")
def q06b_auto_increment(spark, d):
    df = table(spark, d, "customer")
    return kd.dedupe(df, order_by=["c_acctbal", "c_custkey"]).apply(kd.exact()).canonicalize(("c_mktsegment", "c_nationkey")).collect().select("c_custkey", "canonical_id")


@_query("""
WITH u AS (SELECT c_custkey, c_name, c_mktsegment, c_custkey AS id FROM customer WHERE c_custkey % 3 > 0
           UNION ALL SELECT c_custkey, c_name, c_mktsegment, (SELECT max(c_custkey) FROM customer WHERE c_custkey % 3 > 0) + row_number() OVER (ORDER BY c_custkey) FROM customer WHERE c_custkey % 3 = 0)
SELECT c_custkey, min(id) OVER (PARTITION BY c_mktsegment) AS canonical_id FROM u
""")
def q06c_append_batch(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    old = df.where("c_custkey % 3 > 0").withColumn("canonical_id", F.col("c_custkey"))
    both = kd.append_batch(old, df.where("c_custkey % 3 = 0").orderBy("c_custkey"))
    return kd.dedupe(both, order_by="canonical_id").apply(kd.exact()).canonicalize("c_mktsegment", id="canonical_id").collect().select("c_custkey", "canonical_id")


# Predicates


def _masked(source: str, key: str, mask: str) -> str:
    return f"SELECT {key}, CASE WHEN {mask} THEN min({key}) FILTER ({mask}) OVER () ELSE {key} END AS canonical_id FROM {source}"


def _predicate(spark, d, name, key, column, rule, df=None):
    df = table(spark, d, name) if df is None else df
    return kd.dedupe(df, row_id=key).apply(kd.col(column).__getattr__(rule[0])(**rule[1]) if isinstance(rule, tuple) else rule).canonicalize().collect().select(key, "canonical_id")


@_query(_masked("part", "p_partkey", "lower(p_name) LIKE 'red%'"))
def q07_str_startswith(spark, d):
    return _predicate(spark, d, "part", "p_partkey", "p_name", ("str_startswith", {"pattern": "RED", "case": False}))


@_query(_masked("part", "p_partkey", "p_name LIKE '%bolt'"))
def q08_str_endswith(spark, d):
    return _predicate(spark, d, "part", "p_partkey", "p_name", ("str_endswith", {"pattern": "bolt"}))


@_query(_masked("documents", "doc_id", "contains(text, 'the')"))
def q09_str_contains(spark, d):
    return _predicate(spark, d, "documents", "doc_id", "text", ("str_contains", {"pattern": "the"}))


@_query(_masked("part", "p_partkey", "regexp_matches(p_name, '(?i)(RED|blue) .*[tr]$')"))
def q10_str_contains_regex(spark, d):
    return _predicate(spark, d, "part", "p_partkey", "p_name", ("str_contains", {"pattern": "(RED|blue) .*[tr]$", "case": False, "regex": True}))


@_query(_masked("documents", "doc_id", "length(text) > 100 AND length(text) <= 500"))
def q11_str_len(spark, d):
    return _predicate(spark, d, "documents", "doc_id", "text", ("str_len", {"min_len": 100, "max_len": 500}))


@_query(_masked("part", "p_partkey", "p_type IN ('ECONOMY', 'PROMO')"))
def q12_isin(spark, d):
    return _predicate(spark, d, "part", "p_partkey", "p_type", ("isin", {"values": ["ECONOMY", "PROMO"]}))


@_query(_masked("part", "p_partkey", "contains('SMALL, LARGE', p_type)"))
def q12b_isin_string(spark, d):
    return _predicate(spark, d, "part", "p_partkey", "p_type", ("isin", {"values": "SMALL, LARGE"}))


@_query(_masked("events", "event_id", f"{_NO_ERROR} IS NULL"))
def q13_isna(spark, d):
    return _predicate(spark, d, "events", "event_id", "event_type", ("isna", {}), _events(spark, d))


@_query(_masked("events", "event_id", f"{_NO_ERROR} IS NOT NULL"))
def q14_not_isna(spark, d):
    return _predicate(spark, d, "events", "event_id", "event_type", ~kd.col("event_type").isna(), _events(spark, d))


@_query(_masked("part", "p_partkey", "NOT contains(p_name, 'o')"))
def q15_not_contains(spark, d):
    return _predicate(spark, d, "part", "p_partkey", "p_name", ~kd.col("p_name").str_contains("o"))


# Similarity. The SQL closes links transitively from all pairs of distinct values.


def _closed(values: str, link: str, source: str, key: str, value: str, more: str = "") -> str:
    return f"""
WITH RECURSIVE v AS ({values}), {more}
e AS (SELECT a.node AS s, b.node AS t FROM v a JOIN v b ON a.node <> b.node WHERE {link}),
r(s, t) AS (SELECT node, node FROM v UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s),
c AS (SELECT s AS node, min(t) AS root FROM r GROUP BY 1)
SELECT {key}, c.root AS canonical_id FROM {source} JOIN v ON {value} IS NOT DISTINCT FROM v.x JOIN c ON v.node = c.node
"""


def _of_names(link: str, more: str = "") -> str:
    return _closed("SELECT p_name AS x, min(p_partkey) AS node FROM part GROUP BY 1", link, "part", "p_partkey", "p_name", more)


def _canonical(df, key, rule, columns, **options):
    return kd.dedupe(df, row_id=key, **options).apply(rule).canonicalize(columns).collect().select(key, "canonical_id")


_SET = "[p_brand, p_type, p_size::DOUBLE::VARCHAR, p_retailprice::VARCHAR]"


@_query(_closed(f"SELECT {_SET} AS x, min(p_partkey) AS node FROM part GROUP BY 1", "len(list_intersect(a.x, b.x)) / (len(a.x) + len(b.x) - len(list_intersect(a.x, b.x))) > 0.55", "part", "p_partkey", _SET))
def q16_jaccard(spark, d):
    return _canonical(table(spark, d, "part"), "p_partkey", kd.jaccard(0.55), ("p_brand", "p_type", "p_size", "p_retailprice"))


_COSINE = "list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x)) / sqrt(list_dot_product(b.x, b.x)) > {}"
_VECTOR = "[p_size::DOUBLE, p_retailprice]"


@_query(_closed(f"SELECT {_VECTOR} AS x, min(p_partkey) AS node FROM part GROUP BY 1", _COSINE.format(0.9999999995), "part", "p_partkey", _VECTOR))
def q17_cosine(spark, d):
    return _canonical(table(spark, d, "part"), "p_partkey", kd.cosine(0.9999999995), ("p_size", "p_retailprice"))


@_query(_closed("SELECT embedding::DOUBLE[] AS x, min(vec_id) AS node FROM embeddings GROUP BY 1", _COSINE.format(0.5), "embeddings", "vec_id", "embedding::DOUBLE[]"))
def q18_cosine_array(spark, d):
    return _canonical(table(spark, d, "embeddings"), "vec_id", kd.cosine(0.5), "embedding")


_TFIDF = """
g AS (SELECT node, n, unnest(list_concat(list_transform(range(1, greatest(length(x) - 1, 0) + 1), lambda i: substring(x, i, 2)), list_transform(range(1, greatest(length(x) - 2, 0) + 1), lambda i: substring(x, i, 3)))) AS gram
      FROM (SELECT lower(p_name) AS x, min(p_partkey) AS node, count(*) AS n FROM part GROUP BY 1)),
tf AS (SELECT node, n, gram, count(*) AS tf FROM g GROUP BY ALL),
idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM part)) / (1 + sum(n))) + 1 AS idf FROM tf GROUP BY 1),
w AS (SELECT node, n, tf.gram, tf * idf AS w FROM tf JOIN idf ON tf.gram = idf.gram),
l AS (SELECT node, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
s AS (SELECT a.node AS s, b.node AS t, any_value(b.n) AS n, round(sum(a.w * b.w) / any_value(la.norm) / any_value(lb.norm), 9) AS score
      FROM w a JOIN w b ON a.gram = b.gram JOIN l la ON la.node = a.node JOIN l lb ON lb.node = b.node GROUP BY 1, 2),
k AS (SELECT s, t, coalesce(sum(n) OVER (PARTITION BY s ORDER BY score DESC, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s WHERE score > 0.6),
o AS (SELECT s, t FROM k WHERE before < 900),
"""


@_query(_of_names("EXISTS (SELECT 1 FROM o WHERE (o.s = a.node AND o.t = b.node) OR (o.t = a.node AND o.s = b.node))", _TFIDF))
def q19_tfidf(spark, d):
    return _canonical(table(spark, d, "part"), "p_partkey", kd.tfidf(0.6, ngram=(2, 3), topn=900), "p_name")


def _lsh_sql(threshold: float, ngram: int, n: int) -> str:
    b, r = minhash.bands(threshold, n)
    a, c = minhash.permutations(n)
    rows = ", ".join(f"({k}, {int(x)}::UHUGEINT, {int(y)}::UHUGEINT)" for k, (x, y) in enumerate(zip(a, c)) if k < b * r)
    h = "sha1(gram)"
    return f"""
p(k, a, b) AS (VALUES {rows}),
g AS (SELECT DISTINCT node, unnest(list_transform(range(1, greatest(length(x) - {ngram - 1}, 0) + 1), lambda i: substring(x, i, {ngram}))) AS gram FROM v),
h AS (SELECT node, ('0x' || {h}[7:8] || {h}[5:6] || {h}[3:4] || {h}[1:2])::UBIGINT::UHUGEINT AS hv FROM g),
m AS (SELECT node, k, min(((a * hv + b) % 18446744073709551616::UHUGEINT) % 2305843009213693951::UHUGEINT % 4294967296::UHUGEINT) AS m FROM h, p GROUP BY 1, 2),
y AS (SELECT node, k // {r} AS band, string_agg(m::VARCHAR, ',' ORDER BY k) AS key FROM m GROUP BY 1, 2),
"""


@_query(_of_names("EXISTS (SELECT 1 FROM y ya JOIN y yb ON ya.band = yb.band AND ya.key = yb.key WHERE ya.node = a.node AND yb.node = b.node)", _lsh_sql(0.55, 2, 64)))
def q20_lsh(spark, d):
    return _canonical(table(spark, d, "part"), "p_partkey", kd.lsh(0.55, ngram=2, num_perm=64), "p_name")


@_query()
def q20b_lsh_documents(spark, d):
    return _canonical(table(spark, d, "documents"), "doc_id", kd.lsh(0.9, ngram=9, num_perm=64), "text")


def _lcs(a: str, b: str) -> str:
    """Bit-parallel, for up to 60 characters: one mask per character of b."""
    bits = f"list_transform(string_split({b}, ''), lambda ch: coalesce(list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substring({a}, i, 1) = ch THEN 1::BIGINT << (i - 1)::INT ELSE 0::BIGINT END)), 0)::BIGINT)"
    full = f"((1::BIGINT << length({a})::INT) - 1)"
    reduced = f"list_reduce({bits}, lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full}, {full})"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count({reduced}) END)"


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' AND {b} = '' THEN 100.0 ELSE 200.0 * {_lcs(a, b)} / (length({a}) + length({b})) END)"


def _scored(score: str, threshold: float, ready: str = "") -> str:
    """Links of names by a score of (x, y) from a table z of pairs, perhaps prepared by `ready`."""
    more = f"z AS (SELECT a.node AS s, b.node AS t, a.x AS x, b.x AS y FROM v a JOIN v b ON a.node < b.node), {ready}"
    more += f"o AS (SELECT s, t FROM {'zz' if ready else 'z'} WHERE {score} > {100 * threshold}::FLOAT),"
    return _of_names("EXISTS (SELECT 1 FROM o WHERE (o.s = a.node AND o.t = b.node) OR (o.t = a.node AND o.s = b.node))", more)


def _fuzzy(scorer, threshold):
    return lambda spark, d: _canonical(table(spark, d, "part"), "p_partkey", kd.fuzzy(threshold, scorer=scorer), "p_name")


_SORT = "array_to_string(list_sort(list_filter(string_split({0}, ' '), lambda w: w <> '')), ' ')"
_SORTED = f"zz AS (SELECT s, t, {_SORT.format('x')} AS x, {_SORT.format('y')} AS y FROM z),"
_WINDOWS = """
zp AS (SELECT s, t, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS x, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS y FROM z),
zw AS (SELECT s, t, x, substring(y, greatest(i, 0) + 1, i + length(x) - greatest(i, 0)) AS y FROM (SELECT s, t, x, y, unnest(range(1 - length(x), length(y))) AS i FROM zp)
       UNION ALL SELECT s, t, y, substring(x, greatest(i, 0) + 1, i + length(x) - greatest(i, 0)) FROM (SELECT s, t, x, y, unnest(range(1 - length(x), length(x))) AS i FROM zp WHERE length(x) = length(y))),
zz AS (SELECT s, t, max({0}) AS best FROM (SELECT DISTINCT s, t, x, y FROM zw) GROUP BY s, t),
""".replace("{0}", _ratio("x", "y"))
_TOKENS = "list_distinct(list_filter(string_split({0}, ' '), lambda w: w <> ''))"
_REST = "array_to_string(list_sort(list_filter({0}, lambda w: NOT list_contains({1}, w))), ' ')"
_TOKEN_SETS = f"""
z1 AS (SELECT s, t, {_TOKENS.format('x')} AS tx, {_TOKENS.format('y')} AS ty FROM z),
zz AS (SELECT s, t, array_to_string(list_sort(list_intersect(tx, ty)), ' ') AS common, {_REST.format('tx', 'ty')} AS x, {_REST.format('ty', 'tx')} AS y FROM z1),
"""
_TOKEN_SET_SCORE = f"""(CASE WHEN common <> '' AND (x = '' OR y = '') THEN 100.0 ELSE greatest(
  100.0 - 100.0 * (length(x) + length(y) - 2 * {_lcs('x', 'y')}) / (2 * (length(common) + (common <> '')::INT) + length(x) + length(y)),
  CASE WHEN common = '' THEN 0 ELSE 100.0 - 100.0 * (1 + length(x)) / (2 * length(common) + 1 + length(x)) END,
  CASE WHEN common = '' THEN 0 ELSE 100.0 - 100.0 * (1 + length(y)) / (2 * length(common) + 1 + length(y)) END) END)"""

#: Partial ratios of the names, of their sorted words, and of the words that only one has; then what the weighted score takes.
_SORTED_WORDS = "array_to_string(list_sort(list_filter(string_split({0}, ' '), lambda w: w <> '')), ' ')"
_WEIGHTED = f"""
z1 AS (SELECT s, t, x, y, {_TOKENS.format('x')} AS tx, {_TOKENS.format('y')} AS ty FROM z),
z2 AS (SELECT s, t, x AS x0, y AS y0, array_to_string(list_sort(list_intersect(tx, ty)), ' ') AS common, {_REST.format('tx', 'ty')} AS x, {_REST.format('ty', 'tx')} AS y,
       {_SORTED_WORDS.format('x')} AS sx, {_SORTED_WORDS.format('y')} AS sy FROM z1),
zk AS (SELECT s, t, 0 AS kind, x0 AS x, y0 AS y FROM z2 UNION ALL SELECT s, t, 1, sx, sy FROM z2 UNION ALL SELECT s, t, 2, x, y FROM z2 WHERE x <> '' AND y <> ''),
zp AS (SELECT s, t, kind, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS x, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS y FROM zk),
zw AS (SELECT s, t, kind, x, substring(y, greatest(i, 0) + 1, i + length(x) - greatest(i, 0)) AS y FROM (SELECT s, t, kind, x, y, unnest(range(1 - length(x), length(y))) AS i FROM zp)
       UNION ALL SELECT s, t, kind, y, substring(x, greatest(i, 0) + 1, i + length(x) - greatest(i, 0)) FROM (SELECT s, t, kind, x, y, unnest(range(1 - length(x), length(x))) AS i FROM zp WHERE length(x) = length(y))),
zb AS (SELECT s, t, max(r) FILTER (kind = 0) AS p0, max(r) FILTER (kind = 1) AS p1, coalesce(max(r) FILTER (kind = 2), 0) AS p2
       FROM (SELECT s, t, kind, {_ratio('x', 'y')} AS r FROM (SELECT DISTINCT s, t, kind, x, y FROM zw)) GROUP BY s, t),
zz AS (SELECT z2.*, p0, CASE WHEN common <> '' THEN 100.0 ELSE greatest(p1, p2) END AS pt, greatest(length(x0), length(y0)) / least(length(x0), length(y0)) AS longer FROM z2 JOIN zb USING (s, t)),
"""
_WEIGHTED_SCORE = f"""(CASE WHEN longer < 1.5 THEN greatest({_ratio('x0', 'y0')}, 0.95 * {_ratio('sx', 'sy')}, 0.95 * {_TOKEN_SET_SCORE})
  ELSE greatest({_ratio('x0', 'y0')}, (CASE WHEN longer < 8 THEN 0.9 ELSE 0.6 END) * p0, 0.95 * (CASE WHEN longer < 8 THEN 0.9 ELSE 0.6 END) * pt) END)"""

for _name, _scorer, _threshold, _sql in [
    ("q21_fuzzy_simple", "simple_ratio", 0.8, _scored(_ratio("x", "y"), 0.8)),
    ("q22_fuzzy_token_sort", "token_sort_ratio", 0.8, _scored(_ratio("x", "y"), 0.8, _SORTED)),
    ("q23_fuzzy_partial", "partial_ratio", 0.85, _scored("best", 0.85, _WINDOWS)),
    ("q24_fuzzy_token_set", "token_set_ratio", 0.86, _scored(_TOKEN_SET_SCORE, 0.86, _TOKEN_SETS)),
    ("q25_fuzzy_weighted", "weighted_ratio", 0.86, _scored(_WEIGHTED_SCORE, 0.86, _WEIGHTED)),
    ("q26_fuzzy_quick", "quick_ratio", 0.75, _scored(_ratio("x", "y"), 0.75)),
]:
    _f = _fuzzy(_scorer, _threshold)
    _f.__name__ = _name
    _query(_sql)(_f)


# Composition


def _pipe(df, key, pipe, keep="first", drop=False, **options):
    done = kd.dedupe(df, row_id=key, **options).apply(pipe)
    return done.drop_duplicates(keep=keep) if drop else done.canonicalize(keep=keep).collect().select(key, "canonical_id")


@_query("SELECT p_partkey, CASE WHEN p_name LIKE 'red%' THEN min(p_partkey) OVER (PARTITION BY p_name LIKE 'red%', p_type) ELSE p_partkey END AS canonical_id FROM part")
def q27_and_predicate(spark, d):
    return _pipe(table(spark, d, "part"), "p_partkey", kd.pipeline().step([kd.col("p_type").exact(), kd.col("p_name").str_startswith("red")]))


@_query("SELECT c_custkey, max(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS canonical_id FROM customer")
def q28_and_signature(spark, d):
    return _pipe(table(spark, d, "customer"), "c_custkey", kd.pipeline().step([kd.col("c_nationkey").exact(), kd.col("c_mktsegment").exact()]), keep="last")


_TWO = kd.pipeline().step([kd.col("p_name").str_startswith("red"), kd.col("p_type").exact()]).step(kd.col("p_name").exact())


@_query("""
WITH a AS (SELECT *, CASE WHEN p_name LIKE 'red%' THEN min(p_partkey) OVER (PARTITION BY p_name LIKE 'red%', p_type) ELSE p_partkey END AS c FROM part)
SELECT p_partkey, first_value(c) OVER (PARTITION BY p_name ORDER BY p_partkey) AS canonical_id FROM a
""")
def q29_or_steps(spark, d):
    return _pipe(table(spark, d, "part"), "p_partkey", _TWO)


@_query("""
WITH a AS (SELECT * FROM part QUALIFY p_name NOT LIKE 'red%' OR row_number() OVER (PARTITION BY p_name LIKE 'red%', p_type ORDER BY p_partkey) = 1)
SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1
""")
def q30_or_steps_drop(spark, d):
    return _pipe(table(spark, d, "part"), "p_partkey", _TWO, drop=True)


@_query("""
WITH a AS (SELECT *, CASE WHEN p_name LIKE 'red%' THEN min(p_partkey) FILTER (p_name LIKE 'red%') OVER () ELSE p_partkey END AS c FROM part),
b AS (SELECT * REPLACE (first_value(c) OVER (PARTITION BY p_name ORDER BY p_partkey) AS c) FROM a)
SELECT p_partkey, first_value(c) OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS canonical_id FROM b
""")
def q31_dict(spark, d):
    return _pipe(table(spark, d, "part"), "p_partkey", {"p_name": [kd.str_startswith("red"), kd.exact()], ("p_brand", "p_type"): kd.exact()})


@_query("SELECT p_partkey, CASE WHEN p_name LIKE 'red%' THEN min(p_partkey) OVER (PARTITION BY p_name LIKE 'red%', p_brand) ELSE p_partkey END AS canonical_id FROM part")
def q32_cascade(spark, d):
    step = [kd.col("p_name").str_startswith("red"), kd.col("p_name").str_endswith("bolt"), kd.col("p_type").exact(), kd.col("p_brand").exact()]
    return _pipe(table(spark, d, "part"), "p_partkey", kd.pipeline().step(step), step_semantics="cascade")


# Preprocessors


def _cleaned(expression: str) -> str:
    return f"SELECT doc_id, min(doc_id) OVER (PARTITION BY {expression}) AS canonical_id FROM documents"


def _prepared(*preprocessors):
    return lambda spark, d: _pipe(table(spark, d, "documents"), "doc_id", kd.pipeline(preprocessors=list(preprocessors)).step(kd.col("text").exact()))


_p = kd.preprocessors
_STOP = "|".join(_p.ENGLISH)
for _name, _f, _sql in [
    ("q33_preproc_strip_lower", _prepared(_p.strip(), _p.lower()), _cleaned(r"lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))")),
    ("q33b_preproc_alnum", _prepared(_p.lower(), _p.alnum()), _cleaned("regexp_replace(lower(text), '[^0-9A-Za-z]+', '', 'g')")),
    ("q33c_preproc_punctuation", _prepared(_p.remove_punctuation()), _cleaned(r"regexp_replace(text, '[^\w\s]+', '', 'g')")),
    ("q33d_preproc_stopwords", _prepared(_p.remove_stopwords()), _cleaned(rf"regexp_replace(text, '\b({_STOP})\b', '', 'g')")),
    ("q33e_preproc_ascii_fold", _prepared(_p.ascii_fold(), _p.lower()), _cleaned("lower(strip_accents(text))")),
    ("q33f_preproc_unicode", _prepared(_p.normalize_unicode("NFC")), _cleaned("nfc_normalize(text)")),
]:
    _f.__name__ = _name
    _query(_sql)(_f)


#: Fixed values of the query: what cleaning must take away, before and after a name and after a company.
_BEFORE, _AFTER, _LEGAL = ["", "Mr. ", "Dr ", "Prof. Dr. "], ["", " Jr.", ", PhD"], ["", " Ltd.", ", Inc.", " GmbH", " S.A.", " Co., LLC"]


@_query("""
WITH a AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_custkey % 50, c_nationkey) AS c FROM customer)
SELECT c_custkey, first_value(c) OVER (PARTITION BY c_custkey % 70 ORDER BY c_custkey) AS canonical_id FROM a
""")
def q33g_preproc_names(spark, d):
    """Names with titles and suffixes, companies with legal forms, which must not tell rows apart."""
    one = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("c_custkey"), F.lit(len(words))) + 1).cast("int"))
    number = lambda n: (F.col("c_custkey") % n).cast("string")
    name = F.concat(one(_BEFORE), F.lit("Given"), number(50), F.lit(" Family"), F.col("c_nationkey").cast("string"), one(_AFTER))
    people = table(spark, d, "customer").select("c_custkey", name.alias("name"), F.concat(F.lit("Firm "), number(70), one(_LEGAL)).alias("company"))
    pipe = kd.pipeline().step(kd.col("name", preprocessors=_p.normalize_names()).exact()).step(kd.col("company", preprocessors=_p.normalize_company()).exact())
    return _pipe(people, "c_custkey", pipe)


# Results


@_query("SELECT min(doc_id) AS canonical_id, count(*) AS count FROM documents GROUP BY text HAVING count(*) >= 2")
def q34_canonicals(spark, d):
    return kd.dedupe(table(spark, d, "documents"), row_id="doc_id").apply(kd.exact()).canonicalize("text").canonicals_df()


_SYNTH = """
WITH e AS (SELECT * REPLACE (nullif(event_type, 'error') AS event_type) FROM events)
SELECT min(event_id) AS canonical_id, {0}(event_id ORDER BY event_id) AS event_id, {0}(ts ORDER BY event_id) AS ts, {0}(user_id ORDER BY event_id) AS user_id,
       {0}(event_type ORDER BY event_id) FILTER (event_type IS NOT NULL) AS event_type, {0}(value ORDER BY event_id) AS value, {0}(props ORDER BY event_id) AS props
FROM e GROUP BY e.user_id
"""


@_query(_SYNTH.format("first"))
def q35_synthesize(spark, d):
    return kd.dedupe(_events(spark, d), row_id="event_id").apply(kd.exact()).canonicalize("user_id").synthesize()


@_query(_SYNTH.format("last"))
def q35b_synthesize_last(spark, d):
    return kd.dedupe(_events(spark, d), row_id="event_id").apply(kd.exact()).canonicalize("user_id").synthesize("last")


# Custom rules, blocking, streams, data sets


@_query("SELECT p_partkey, CASE WHEN length(p_name) > 8 THEN min(p_partkey) OVER (PARTITION BY p_type, length(p_name)) ELSE p_partkey END AS canonical_id FROM part")
def q36_custom_pairs(spark, d):
    return _canonical(table(spark, d, "part"), "p_partkey", _custom()[0](min_len=8), "p_name", block_on="p_type")


@_query("SELECT p_partkey, CASE WHEN length(p_name) > 8 THEN min(p_partkey) OVER (PARTITION BY length(p_name)) ELSE p_partkey END AS canonical_id FROM part")
def q37_custom_key(spark, d):
    return _canonical(table(spark, d, "part"), "p_partkey", _custom()[1](min_len=8), "p_name")


@_query("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY substring(p_name, 1, 2), length(p_name)) AS canonical_id FROM part")
def q37b_custom_pair_predicate(spark, d):
    return _canonical(table(spark, d, "part"), "p_partkey", _custom()[2](chars=2), "p_name")


@_query("SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, text) AS canonical_id FROM documents")
def q38_blocking(spark, d):
    return _canonical(table(spark, d, "documents"), "doc_id", kd.exact(), "text", block_on="lang")


@_query(f"""
WITH RECURSIVE v AS (SELECT c_name AS x, c_nationkey AS k, min(c_custkey) AS node FROM customer GROUP BY 1, 2),
e AS (SELECT a.node AS s, b.node AS t FROM v a JOIN v b ON a.node <> b.node AND a.k = b.k WHERE {_ratio("a.x", "b.x")} > 90::FLOAT),
r(s, t) AS (SELECT node, node FROM v UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s)
SELECT s AS c_custkey, min(t) AS canonical_id FROM r GROUP BY 1
""")
def q38b_blocking_fuzzy(spark, d):
    return _canonical(table(spark, d, "customer"), "c_custkey", kd.fuzzy(0.9), "c_name", block_on="c_nationkey")


def _people_sql() -> str:
    """The generated people in SQL: draws are the first 60 bits of an MD5 of (row, column, seed)."""
    from kindred import datasets as ds

    draw = lambda column, size: f"(('0x' || substring(md5(row || '|{column}|0'), 1, 15))::BIGINT % {size})"
    pick = lambda column, words: f"([{', '.join(repr(w) for w in words)}])[{draw(column, len(words))} + 1]"
    first, last, city = pick("first_name", ds._FIRST), pick("last_name", ds._LAST), pick("city", ds._CITIES)
    gaps = {
        "first_name": first, "last_name": last, "email": f"lower({first} || '.' || {last} || {draw('email', 1000)} || '@example.com')",
        "phone": f"'+1-555-' || lpad({draw('phone', 10_000_000)}::VARCHAR, 7, '0')",
        "address": f"({draw('number', 300)} + 1) || ' ' || {pick('street', ds._STREETS)} || ' Street, ' || {city}", "city": city,
        "country": pick("country", ds._COUNTRIES), "company": f"{pick('company', ds._LAST)} || ' ' || {pick('form', ds._FORMS)}", "job": pick("job", ds._JOBS),
        "date_of_birth": f"DATE '1945-01-01' + {draw('date_of_birth', 20_000)}::INT", "signup_date": f"(DATE '2016-01-01' + {draw('signup_date', 3000)}::INT)::TIMESTAMP",
        "salary": f"{draw('salary', 12_000_000)} / 100 + 20000",
    }
    columns = ", ".join(f"CASE WHEN {draw(f'{c} null', 100)} >= 2 THEN {x} END AS {c}" for c, x in gaps.items())
    # The last row is a copy of the one before, and goes.
    return f"SELECT left(sha256(row || '-0'), 56) AS id, {columns}, {draw('is_active', 2)} = 1 AS is_active FROM (SELECT row::VARCHAR AS row FROM range(999) AS range(row))"


@_query(_people_sql())
def q39_fake_people(spark, d):
    df = kd.datasets.fake_1K(spark)
    return kd.dedupe(df).apply({"id": kd.exact()}).drop_duplicates()


@_query("SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(text)) AS canonical_id FROM documents")
def q40_stream_link(spark, d):
    import uuid

    from kindred.streaming.linking import StreamLinker

    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex[:12]}"
    linker = StreamLinker("text", "doc_id", f"{root}/keys", lambda df, n: df.select("doc_id", "canonical_id").write.mode("overwrite").parquet(f"{root}/out/batch={n}"), preprocessors=[_p.lower()])
    source = table(spark, d, "documents")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/documents.parquet*")
    running = stream.writeStream.foreachBatch(linker).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema("doc_id long, canonical_id long").parquet(f"{root}/out").select("doc_id", "canonical_id")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Near copies of long documents, then exact ones, on trimmed lower-case text."""
    pipe = kd.pipeline(preprocessors=[_p.lower(), _p.strip()]).step([kd.col("text").lsh(0.9, ngram=9, num_perm=64), kd.col("text").str_len(min_len=50)]).step(kd.col("text").exact())
    return kd.dedupe(table(spark, d, "documents"), row_id="doc_id").apply(pipe).canonicalize(id="doc_id").collect().select("doc_id", "lang", "source", "canonical_id")


_query()(flagship)


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
