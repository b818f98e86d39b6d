"""What similarity rules make in between must not grow faster than the table."""

import hashlib
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

import kindred as kd
from kindred.functions import minhash, preprocess
from kindred.functions.ratios import SCORERS
from kindred.operators import linking, steps

_p = kd.preprocessors


@pytest.fixture
def counted(monkeypatch):
    """Numbers of links that rules have closed."""
    seen, close = [], linking.close

    def counting(links):
        seen.append(links.count())
        return close(links)

    monkeypatch.setattr(linking, "close", counting)
    return seen


def roots(n, alike):
    """The first row that each row is linked with."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if alike(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def ids(df, rule, columns, **options):
    return [r[0] for r in kd.dedupe(df, row_id="id", **options).apply(rule).canonicalize(columns).collect().orderBy("id").select("canonical_id").collect()]


def test_jaccard_links_grow_with_rows(spark, counted):
    df = spark.range(400).select("id", F.lit("x").alias("a"), F.lit("y").alias("b"), F.lit("z").alias("c"), F.col("id").alias("d"))
    assert ids(df, kd.jaccard(0.55), ("a", "b", "c", "d")) == [0] * 400
    assert counted[0] <= 4 * 400


@pytest.mark.parametrize("parts", [512, 3])
@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5, 0.55, 0.75])
def test_jaccard_against_all_pairs(spark, monkeypatch, parts, threshold):
    monkeypatch.setattr(linking, "PARTS", parts)
    r = random.Random(7)
    rows = [(i, *[r.choice(["a", "b", "c", "d", "e", "f", "g", "h", None]) for _ in range(4)]) for i in range(60)]
    sets = [{x for x in row[1:] if x} for row in rows]
    alike = lambda i, j: bool(sets[i] & sets[j]) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > threshold
    df = spark.createDataFrame(rows, "id long, p string, q string, r string, s string")
    assert ids(df, kd.jaccard(threshold), ("p", "q", "r", "s")) == roots(60, alike)


def test_fuzzy_links_grow_with_rows(spark, counted):
    df = spark.range(400).select("id", F.format_string("Customer#%09d", "id").alias("name"))
    assert ids(df, kd.fuzzy(0.9), "name") == [0] * 400
    assert counted[0] <= 18 * 400


@pytest.mark.parametrize("parts", [512, 12, 0])
@pytest.mark.parametrize("scorer", ["simple_ratio", "quick_ratio", "token_sort_ratio"])
def test_fuzzy_against_all_pairs(spark, monkeypatch, parts, scorer):
    monkeypatch.setattr(linking, "PARTS", parts)
    r = random.Random(5)
    texts = ["", " ", *("".join(r.choice("ab é") for _ in range(r.randrange(9))) for _ in range(70))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    alike = lambda i, j: texts[i] == texts[j] and (texts[i] != "" or scorer != "quick_ratio") or SCORERS[scorer](texts[i], texts[j]) > 70
    assert ids(df, kd.fuzzy(0.7, scorer=scorer), "t") == roots(len(texts), alike)


def test_many_links_stay_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr(linking, "FEW_LINKS", 50)
    monkeypatch.setattr(steps, "FEW_LINKS", 50)

    @kd.register
    def neighbours(array):
        yield from zip(range(len(array)), range(1, len(array)))

    done = kd.dedupe(spark.range(300).withColumn("t", F.lit("x")), row_id="id").apply(neighbours()).canonicalize("t").collect()
    assert "Broadcast" not in done._jdf.queryExecution().executedPlan().toString()
    assert {r["canonical_id"] for r in done.collect()} == {0}


def test_signatures_by_their_definition():
    r = random.Random(3)
    texts = ["", "ab", "x" * 40_000, "é漢" * 300, *("".join(r.choice("ab é漢😀\ud800") for _ in range(r.randrange(80))) for _ in range(30))]
    for ngram, n in ((1, 8), (3, 16), (14, 8), (60, 4)):
        a, b = minhash.permutations(n)
        got = minhash.signatures(texts, ngram, n)
        for text, own in zip(texts, got):
            hashes = {int.from_bytes(hashlib.sha1(text[i : i + ngram].encode("utf-8", "surrogatepass")).digest()[:4], "little") for i in range(len(text) - ngram + 1)}
            want = [min(((int(x) * h + int(y)) % 2**64 % (2**61 - 1) % 2**32 for h in hashes), default=2**32 - 1) for x, y in zip(a, b)]
            assert own.tolist() == want


def test_lsh_leaves_texts_where_they_are(spark, monkeypatch):
    made, write = [], linking.materialize
    monkeypatch.setattr(linking, "materialize", lambda df, tag: (made.append(df.schema), write(df, tag))[1])
    texts = ["one two three four"] * 3 + ["one two three five", "something else altogether", "", "", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = ids(df, kd.lsh(0.5, ngram=2, num_perm=64), "t")
    assert got[:3] == [0, 0, 0] and got[5:] == [5, 5, 5] and got[4] == 4
    assert made and not any(f.dataType.typeName() == "string" for schema in made for f in schema)


def test_strip_as_by_the_pattern(spark):
    texts = ["", " ", "a", " a", "a ", "  a b \n", "a\n", "\u0085a", "a b", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert [r[0] for r in df.select(_p.strip()(F.col("t"))).collect()] == [r[0] for r in df.select(plain).collect()]


@pytest.mark.parametrize("form", ["NFC", "NFD", "NFKC", "NFKD"])
def test_unicode_forms_take_no_large_batches(spark, form):
    texts = ["plain", "é", "é", "ﬁ", "½", " x", "한글", "하", "Å", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(_p.normalize_unicode(form)(F.col("t")).alias("t"))
    assert [r[0] for r in df.collect()] == [t and unicodedata.normalize(form, t) for t in texts]
    assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()


def test_unicode_forms_leave_low_characters():
    for form, end in preprocess._FORMS.items():
        low = "".join(map(chr, range(end)))
        assert unicodedata.normalize(form, low) == low and unicodedata.normalize(form, low[::-1]) == low[::-1]


def test_cosine_links_grow_with_rows(spark, counted):
    df = spark.range(300).select("id", F.array(F.lit(1.0), F.col("id") / 1e4).alias("v"))
    assert ids(df, kd.cosine(0.9), "v") == [0] * 300
    assert counted[0] <= 2 * 300


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.6, 0.9])
def test_spanning_links_join_what_all_pairs_join(same, threshold):
    r = np.random.default_rng(4)
    a = r.normal(size=(300, 4))
    b = a if same else r.normal(size=(200, 4))
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    alike = a @ b.T > threshold
    i, j = linking._spanning(a, b, threshold, same)
    n = len(a) + (0 if same else len(b))
    shift = 0 if same else len(a)
    assert len(i) <= 2 * n

    def groups(pairs):
        found = {(min(x, y + shift), max(x, y + shift)) for x, y in pairs if x != y + shift}
        return roots(n, lambda p, q: (q, p) in found)

    assert groups(zip(i.tolist(), j.tolist())) == groups(np.argwhere(alike).tolist())


def test_exact_cleans_a_text_once(spark, monkeypatch):
    plans, write = [], steps.materialize
    monkeypatch.setattr(steps, "materialize", lambda df, tag: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, tag))[1])
    df = spark.createDataFrame([(0, "a b"), (1, "ab"), (2, None), (3, "c"), (4, "na")], "id long, t string")
    pipe = kd.pipeline(preprocessors=[_p.alnum()]).step(kd.col("t").exact())
    got = kd.dedupe(df, row_id="id").apply(pipe).canonicalize().collect().orderBy("id").collect()
    assert [r["canonical_id"] for r in got] == [0, 0, 2, 3, 2]
    assert [p.count("regexp_replace") for p in plans] == [1]
