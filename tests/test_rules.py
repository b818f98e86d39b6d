"""Expected canonical ids on the ten people, for every rule, both ends, all three ways to apply rules."""

import pytest

import kindred as kd
from kindred.operators.rules import REGISTRY

CAT = ("account", "birth_country", "marital_status", "number_children", "property_type")
NUM = ("property_height", "property_area_sq_ft", "property_sea_level_elevation_m", "property_num_rooms")
SAME = list(range(10))


@kd.register
def same_len(array, *, min_len: int):
    for i, a in enumerate(array):
        for j in range(i + 1, len(array)):
            if len(a) == len(array[j]) and len(a) >= min_len:
                yield i, j


def ids(text):
    return [int(x) for x in text.split()]


@pytest.fixture(scope="session")
def people(spark):
    return kd.datasets.fake_10(spark).cache()


def canonical(df, rules, columns=None, order="id", **kw):
    options = {k: kw.pop(k) for k in ("block_on", "step_semantics", "placeholder", "row_id") if k in kw}
    out = kd.dedupe(df, order_by=None if "row_id" in options else order, **options).apply(rules).canonicalize(columns, **kw).collect()
    return [r["canonical_id"] for r in out.orderBy(order).collect()]


# rule, columns, expected ids
FIRST = [
    (kd.exact(), "address", "0 1 2 3 4 5 6 0 4 9"),
    (kd.exact(), CAT, "0 0 2 3 4 5 6 7 8 9"),
    (kd.fuzzy(0.95), "address", "0 1 2 3 4 5 6 0 4 9"),
    (kd.fuzzy(0.85), "address", "0 1 2 3 4 5 6 0 4 9"),
    (kd.fuzzy(0.95, scorer="partial_ratio"), "address", "0 1 2 3 2 5 6 0 2 9"),
    (kd.fuzzy(0.75), "address", "0 1 2 2 4 5 6 0 4 9"),
    (kd.fuzzy(0.65), "address", "0 1 2 2 4 5 1 0 4 9"),
    (kd.fuzzy(0.55), "address", "0 1 2 2 4 2 1 0 4 9"),
    (kd.fuzzy(0.45), "address", "0 1 2 2 4 2 1 0 4 1"),
    (kd.fuzzy(0.35), "address", "0 0 2 2 4 2 0 0 4 0"),
    (kd.fuzzy(0.25), "address", "0 0 0 0 4 0 0 0 4 0"),
    (kd.fuzzy(0.95), "email", "0 1 2 3 4 4 3 3 8 0"),
    (kd.cosine(0.999), NUM, "0 0 0 3 0 0 6 7 0 0"),
    (kd.cosine(0.99), NUM, "0 0 0 0 0 0 6 7 0 0"),
    (kd.cosine(0.98), NUM, "0 0 0 0 0 0 6 6 0 0"),
    (kd.jaccard(0.65), CAT, "0 0 2 3 4 0 6 7 8 9"),
    (kd.jaccard(0.35), CAT, "0 0 2 3 0 0 3 7 0 9"),
    (kd.lsh(0.95, ngram=1), "address", "0 1 2 3 4 5 6 0 4 9"),
    (kd.lsh(0.75, ngram=1), "address", "0 1 2 3 4 5 1 0 4 9"),
    (kd.lsh(0.65, ngram=1), "address", "0 1 2 2 4 5 1 0 4 9"),
    (kd.lsh(0.55, ngram=1), "address", "0 1 2 2 4 2 1 0 4 9"),
    (kd.lsh(0.35, ngram=1), "address", "0 1 1 1 4 1 1 0 4 0"),
    (kd.lsh(0.45, ngram=2), "address", "0 1 2 2 4 5 6 0 4 9"),
    (kd.lsh(0.45, ngram=3), "address", "0 1 2 3 4 5 6 0 4 9"),
    (kd.lsh(0.55, ngram=1, num_perm=32), "address", "0 1 2 2 4 5 1 0 4 9"),
    (kd.lsh(0.55, ngram=1, num_perm=64), "address", "0 1 2 2 4 5 1 0 4 9"),
    (kd.tfidf(0.95, ngram=1, topn=2), "address", "0 1 2 3 4 5 6 0 4 9"),
    (kd.tfidf(0.80, ngram=1, topn=2), "address", "0 1 2 2 4 5 1 0 4 1"),
    (kd.tfidf(0.65, ngram=1, topn=2), "address", "0 1 2 2 4 2 1 0 4 1"),
    (kd.tfidf(0.80, ngram=(1, 2), topn=2), "address", "0 1 2 2 4 5 1 0 4 9"),
    (kd.tfidf(0.80, ngram=(1, 3), topn=2), "address", "0 1 2 3 4 5 6 0 4 9"),
    (kd.tfidf(0.80, ngram=(2, 3), topn=2), "address", "0 1 2 3 4 5 6 0 4 9"),
    (kd.tfidf(0.80, ngram=1, topn=1), "address", "0 1 2 3 4 5 6 0 4 9"),
    (kd.tfidf(0.80, ngram=1, topn=3), "address", "0 1 2 2 4 5 1 0 4 1"),
    (same_len(min_len=3), "email", "0 1 2 3 2 2 6 3 8 9"),
    (kd.str_startswith("calle", case=False), "address", "0 1 2 2 4 5 6 7 8 9"),
    (kd.str_startswith("calle"), "address", "0 1 2 3 4 5 6 7 8 9"),
    (kd.str_endswith("kingdom", case=False), "address", "0 1 2 3 4 5 6 7 8 1"),
    (kd.str_contains("ol5 9pl", case=False), "address", "0 1 2 3 4 5 6 0 8 0"),
    (kd.str_contains(r"05\d{3}", regex=True), "address", "0 1 2 2 4 2 6 7 8 9"),
    (kd.str_len(10, 9), "email", "0 1 2 3 4 5 6 7 8 9"),
    (kd.str_len(101, 201), "email", "0 1 2 3 4 5 6 7 8 9"),
    (kd.str_len(), "email", "0 0 0 0 0 0 0 0 0 0"),
    (kd.str_len(15, 22), "email", "0 1 2 0 4 5 0 0 8 9"),
    (kd.isna(), "address", "0 1 2 3 4 5 6 7 4 9"),
    (~kd.isna(), "address", "0 0 0 0 4 0 0 0 8 0"),
    (~kd.str_len(15, 22), "email", "0 1 1 3 1 1 6 7 1 1"),
    (~kd.str_startswith("a"), "email", "0 1 2 0 0 0 0 0 0 0"),
    (kd.str_endswith(".com"), "email", "0 0 0 0 0 0 0 0 0 0"),
    (~kd.str_endswith(".com"), "email", "0 1 2 3 4 5 6 7 8 9"),
    (~kd.str_contains("@example"), "email", "0 1 2 3 4 5 6 7 1 9"),
    (kd.isin(["reddit", "flickr"]), "account", "0 0 2 3 4 0 0 7 0 0"),
    (kd.isin("facebook, pinterest"), "account", "0 1 2 2 4 5 6 2 8 9"),
    (~kd.isin(["reddit", "flickr"]), "account", "0 1 2 2 2 5 6 2 8 9"),
]


@pytest.mark.parametrize("rule, columns, expected", FIRST, ids=lambda x: str(x)[:60])
def test_first(people, rule, columns, expected):
    assert canonical(people, rule, columns) == ids(expected)


SOME = [FIRST[i] for i in (1, 4, 13, 16, 21, 28, 34, 37)]


@pytest.mark.parametrize("rule, columns, expected", SOME, ids=lambda x: str(x)[:60])
def test_three_ways_agree(people, rule, columns, expected):
    if rule.kind == "pairs":
        applied = kd.pipeline().step(kd.col(columns).same_len(**rule.args["settings"]))
    else:
        applied = kd.pipeline().step(getattr(kd.col(columns), rule.kind)(**rule.args))
    assert canonical(people, {columns: rule}) == ids(expected)
    assert canonical(people, applied) == ids(expected)


@pytest.mark.parametrize("rule, columns, expected", SOME, ids=lambda x: str(x)[:60])
def test_drop_keeps_representatives(people, rule, columns, expected):
    out = kd.dedupe(people, order_by="id").apply(rule).drop_duplicates(columns)
    assert out.columns == people.columns
    assert sorted(r["id"] - 1 for r in out.collect()) == sorted(set(ids(expected)))


LAST = [
    (same_len(min_len=3), "email", "0 1 5 7 5 5 6 7 8 9"),
    (kd.exact(), "address", "7 1 2 3 8 5 6 7 8 9"),
    (kd.exact(), CAT, "1 1 2 3 4 5 6 7 8 9"),
    (kd.fuzzy(0.65), "address", "7 6 3 3 8 5 6 7 8 9"),
    (kd.cosine(0.99), NUM, "9 9 9 9 9 9 6 7 9 9"),
    (kd.jaccard(0.65), CAT, "5 5 2 3 4 5 6 7 8 9"),
    (kd.lsh(0.45, ngram=2), "address", "7 1 3 3 8 5 6 7 8 9"),
    (kd.str_startswith("calle", case=False), "address", "0 1 3 3 4 5 6 7 8 9"),
    (kd.str_endswith("kingdom", case=False), "address", "0 9 2 3 4 5 6 7 8 9"),
    (kd.str_contains("ol5 9pl", case=False), "address", "9 1 2 3 4 5 6 9 8 9"),
    (kd.tfidf(0.80, ngram=(1, 2), topn=2), "address", "7 6 3 3 8 5 6 7 8 9"),
]


@pytest.mark.parametrize("rule, columns, expected", LAST, ids=lambda x: str(x)[:60])
def test_last(people, rule, columns, expected):
    assert canonical(people, rule, columns, keep="last") == ids(expected)


ALL_OF = [
    ([kd.col("email").fuzzy(0.95)], "0 1 2 3 4 4 3 3 8 0"),
    ([kd.col("email").fuzzy(0.95), kd.col("email").same_len(min_len=3)], "0 1 2 3 4 4 6 3 8 9"),
    ([kd.col("address").fuzzy(0.70)], "0 1 2 2 4 5 6 0 4 9"),
    ([kd.col("address").fuzzy(0.70), kd.col("address").same_len(min_len=0)], "0 1 2 3 4 5 6 0 4 9"),
    ([kd.col("address").fuzzy(0.70), ~kd.col("address").isna()], "0 1 2 2 4 5 6 0 8 9"),
    ([kd.col("account").exact()], "0 0 2 3 4 0 0 2 8 8"),
    ([kd.col("property_height").isna(), kd.col("account").exact()], "0 0 2 3 4 5 6 7 8 9"),
    ([kd.col("birth_country").exact(), kd.col("marital_status").exact()], "0 0 2 3 4 3 6 7 6 9"),
]


@pytest.mark.parametrize("semantics", ["strict", "cascade"])
@pytest.mark.parametrize("rules, expected", ALL_OF, ids=str)
def test_and(people, rules, expected, semantics):
    assert canonical(people, kd.pipeline().step(rules), step_semantics=semantics) == ids(expected)


APART = [
    ([~kd.col("address").isna(), kd.col("email").str_startswith("a"), kd.col("account").exact()], "0 0 2 3 4 0 0 2 8 9", SAME),
    ([kd.col("email").str_startswith("hellothere"), kd.col("account").exact()], "0 0 2 3 4 0 0 2 8 8", SAME),
    ([~kd.col("address").isna(), kd.col("address").fuzzy(0.7), kd.col("marital_status").exact()], "0 0 2 0 4 0 0 2 8 2", SAME),
]


@pytest.mark.parametrize("rules, cascade, strict", APART, ids=str)
def test_semantics_differ(people, rules, cascade, strict):
    pipe = kd.pipeline().step(rules)
    assert canonical(people, pipe, step_semantics="cascade") == ids(cascade)
    assert canonical(people, pipe) == strict


def test_strict_is_finer_than_each_rule(people):
    both = canonical(people, kd.pipeline().step([kd.col("address").fuzzy(0.45), kd.col("account").exact()]))
    for single in (canonical(people, kd.fuzzy(0.45), "address"), canonical(people, kd.exact(), "account")):
        assert all(single[i] == single[j] for i in range(10) for j in range(10) if both[i] == both[j])


def test_order_of_rules_in_a_step_does_not_matter(people):
    a, b, c = kd.col("address").fuzzy(0.45), kd.col("account").exact(), ~kd.col("address").isna()
    assert canonical(people, kd.pipeline().step([a, b, c])) == canonical(people, kd.pipeline().step([c, b, a]))


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_partitions_do_not_matter(people, parts):
    for rule, columns, expected in SOME[:6]:
        assert canonical(people.repartition(parts), rule, columns) == ids(expected)


def test_blocks(spark, people):
    from pyspark.sql import functions as F

    df = people.withColumn("key", F.when(F.col("id") <= 5, "key_2").otherwise("key_1"))
    rules = {"address": kd.exact(), "email": kd.exact()}
    assert canonical(df, rules, id="id") == ids("1 2 3 4 5 5 7 1 5 10")
    assert canonical(df, rules, id="id", block_on="key") == ids("1 2 3 4 5 6 7 8 9 10")
    assert canonical(df, same_len(min_len=3), "email", block_on="key") == ids("0 1 2 3 2 5 6 7 8 9")


def test_scorers_by_hand():
    from kindred.functions import ratios as r

    assert r.simple_ratio("abcd", "bcda") == 75 and r.simple_ratio("", "") == 100 and r.quick_ratio("", "") == 0
    assert r.partial_ratio("bcd", "xabcdx") == 100
    assert r.token_sort_ratio("b a", "a  b") == 100
    assert r.token_set_ratio("a b c", "a b") == 100 and r.token_set_ratio("", "") == 0
    assert r.weighted_ratio("", "x") == 0 and r.weighted_ratio("abc", "abc") == 100


def test_similar_pairs_lose_nothing():
    import random

    from kindred.functions import ratios as r

    rng = random.Random(3)
    words = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    for scorer, score in r.SCORERS.items():
        for t in (0.0, 0.3, 0.6, 0.9):
            i, j = r.similar_pairs(words, words, scorer, t, True)
            want = {(a, b) for a in range(60) for b in range(a + 1, 60) if score(words[a], words[b]) > 100 * t + 1e-4}
            near = {(a, b) for a in range(60) for b in range(a + 1, 60) if score(words[a], words[b]) > 100 * t - 1e-4}
            assert want <= set(zip(i.tolist(), j.tolist())) <= near, (scorer, t)


def test_fuzzy_tiles(spark, monkeypatch):
    """Many tiles and blocks give what one would."""
    import random

    from kindred.operators import linking

    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))), "xy"[i % 2]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, name string, block string")
    for t in (0.3, 0.7):
        want = canonical(df, kd.fuzzy(t), "name", block_on="block", row_id="id")
        monkeypatch.setattr(linking, "TILE", 7)
        monkeypatch.setattr(linking, "FEW_LINKS", 10)
        assert canonical(df, kd.fuzzy(t), "name", block_on="block", row_id="id") == want
        monkeypatch.undo()


def test_connected_components(spark):
    import random

    from kindred.operators.components import connected_components

    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(200, x) for x in range(201, 260)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(parent) if find(x) != x}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("weighting", [{}, {"lowercase": False}, {"binary": True}, {"sublinear_tf": True}, {"use_idf": False}, {"smooth_idf": False}])
def test_tfidf_weighting(spark, weighting):
    import math
    import random
    import re
    from collections import Counter

    rng = random.Random(8)
    names = ["".join(rng.choice("abAB ") for _ in range(rng.randrange(2, 9))) for _ in range(40)]
    w = kd.custom.WEIGHTING | weighting
    texts = [re.sub(r"\s\s+", " ", x.lower() if w["lowercase"] else x) for x in names]
    grams = [Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in texts]
    df = Counter(g for c in grams for g in c)
    more, n = int(w["smooth_idf"]), len(names)
    vectors = []
    for c in grams:
        v = {g: (math.log(1 if w["binary"] else k) + 1 if w["sublinear_tf"] else 1 if w["binary"] else k) * (math.log((more + n) / (more + df[g])) + 1 if w["use_idf"] else 1) for g, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        vectors.append({g: x / norm for g, x in v.items()})
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        scores = sorted(((-round(sum(x * vectors[j].get(g, 0) for g, x in vectors[i].items()), 9), j) for j in range(n)))
        for s, j in [(s, j) for s, j in scores if -s > 0.55][:3]:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    out = canonical(spark.createDataFrame(list(enumerate(names)), "id long, name string"), kd.tfidf(0.55, ngram=2, topn=3, **weighting), "name", row_id="id")
    assert out == [find(i) for i in range(n)]


def test_tfidf_rejects_other_settings():
    with pytest.raises(TypeError):
        kd.tfidf(analyzer="word")


def test_registry_names():
    assert {"exact", "fuzzy", "tfidf", "lsh", "jaccard", "cosine", "isna", "isin", "str_startswith", "str_endswith", "str_contains", "str_len"} <= set(REGISTRY)


def test_odd_values(spark):
    """NaN and zeros in vectors and sets, empty text, empty tables."""
    nan = float("nan")
    df = spark.createDataFrame([(0, 0.0, 0.0, ""), (1, -0.0, 0.0, ""), (2, nan, None, None), (3, 1.0, nan, "na"), (4, 1.0, nan, "x")], "id long, a double, b double, s string")
    run = lambda r, c: canonical(df, r, c, row_id="id")
    assert run(kd.cosine(0.9), ("a", "b")) == [0, 1, 2, 3, 3]
    assert run(kd.jaccard(0.9), ("a", "b")) == [0, 0, 2, 3, 4]
    assert run(kd.exact(), "s") == [0, 0, 2, 2, 4]
    assert run(kd.isna(), "a") == [0, 1, 2, 3, 4] and run(kd.isna(), "b") == [0, 1, 2, 2, 2]
    for scorer in kd.custom.SCORERS:
        assert len(run(kd.fuzzy(0.9, scorer=scorer), "s")) == 5
    assert run(kd.fuzzy(0.9, scorer="quick_ratio"), "s") == [0, 1, 2, 2, 4]
    assert run(kd.tfidf(0.9), "s") == [0, 1, 2, 3, 4]
    assert run(kd.lsh(0.9), "s") == [0, 0, 0, 0, 0]  # texts without n-grams have one signature
    none = df.limit(0)
    for rule, columns in [(kd.exact(), "s"), (kd.fuzzy(), "s"), (kd.tfidf(), "s"), (kd.lsh(), "s"), (kd.jaccard(), ("a", "b")), (kd.cosine(), ("a", "b")), (kd.isna(), "a"), (same_len(min_len=1), "s")]:
        assert kd.dedupe(none).apply(rule).canonicalize(columns).collect().collect() == []
        assert kd.dedupe(none, row_id="id").apply(rule).drop_duplicates(columns).collect() == []
