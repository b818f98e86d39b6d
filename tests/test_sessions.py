"""Ids, steps, preprocessors, golden records, validation and what prints."""

import warnings

import pytest

import kindred as kd
from kindred.operators.rules import InvalidRuleError

p = kd.preprocessors


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).coalesce(1)


def column(df, name="canonical_id", by="uid"):
    return [r[name] for r in df.orderBy(by).collect()]


A, B = "123ab, OL5", "Westside Avenue"
IDS = [
    (None, "uid long, address string", [(1, A), (2, B), (3, A)], [0, 1, 0]),
    ("uid", "uid long, address string", [(1, A), (2, B), (3, A)], [1, 2, 1]),
    ("uid", "uid string, address string", [("a001", A), ("a002", B), ("a003", A)], ["a001", "a002", "a001"]),
    (None, "uid long, address string, canonical_id long", [(1, A, 10), (2, B, 12), (3, A, 10)], [10, 12, 10]),
    (None, "uid long, address string, canonical_id long", [(1, A, 10), (2, B, 12), (3, A, 13)], [10, 12, 10]),
    ("canonical_id", "uid long, address string, canonical_id long", [(1, A, 10), (2, B, 12), (3, A, 13)], [10, 12, 10]),
    ("uid", "uid long, address string, canonical_id long", [(1, A, 10), (2, B, 12), (3, A, 10)], [1, 2, 1]),
    ("uid", "uid string, address string, canonical_id long", [("e5", A, 10), ("e6", B, 12), ("e9", A, 10)], ["e5", "e6", "e5"]),
    ("uid", "uid long, address string, canonical_id string", [(10, A, "e5"), (12, B, "e6"), (13, A, "e9")], [10, 12, 10]),
]


@pytest.mark.parametrize("id, schema, rows, expected", IDS)
def test_canonical_id(spark, id, schema, rows, expected):
    out = kd.dedupe(frame(spark, rows, schema)).apply(kd.exact()).canonicalize("address", id=id).collect()
    assert column(out) == expected
    assert out.columns == list(dict.fromkeys([*frame(spark, rows, schema).columns, "canonical_id"]))


def test_existing_ids_collapse_without_a_rule(spark):
    df = frame(spark, [(1, "a", 5), (2, "b", 5), (3, "c", 6)], "uid long, address string, canonical_id long")
    out = kd.dedupe(df).apply(kd.exact()).drop_duplicates("address")
    assert out.columns == ["uid", "address"] and column(out, "uid") == [1, 3]
    assert column(kd.dedupe(df).apply(kd.exact()).drop_duplicates("address", keep="last"), "uid") == [2, 3]


def test_name_of_the_id(spark):
    df = frame(spark, [(1, A), (2, A)], "uid long, address string")
    out = kd.dedupe(df, canonical_id="entity").apply(kd.exact()).canonicalize("address").collect()
    assert column(out, "entity") == [0, 0]


def test_gather_is_no_closure(spark):
    """Step 1 links rows 1 and 2, step 2 links 0 and 1: row 2 stays where it was; dropping instead leaves one row."""
    df = frame(spark, [(0, "a", "x"), (1, "b", "x"), (2, "b", "y")], "uid long, first string, second string")
    rules = {"first": kd.exact(), "second": kd.exact()}
    assert column(kd.dedupe(df).apply(rules).canonicalize().collect()) == [0, 0, 1]
    assert column(kd.dedupe(df).apply(rules).drop_duplicates(), "uid") == [0]
    assert column(kd.dedupe(df).apply(rules).canonicalize(drop_duplicates=True).collect(), "uid") == [0]
    assert column(kd.dedupe(df, row_id="uid").apply(rules).canonicalize(id="second", drop_duplicates=True).collect(), "uid") == [0]


def test_iterations(spark):
    old = frame(spark, [(1, A), (2, B)], "uid long, address string")
    first = kd.dedupe(old).apply(kd.exact()).canonicalize("address").collect()
    both = kd.append_batch(first, frame(spark, [(3, B), (4, "new")], "uid long, address string"))
    assert column(both) == [0, 1, 2, 3]
    assert column(kd.dedupe(both, order_by="uid").apply(kd.exact()).canonicalize("address").collect()) == [0, 1, 1, 3]


PREPROCESSORS = [
    (p.strip(), "   123ab, OL5 ", "123ab, OL5"), (p.lower(), "123AB, OL5", "123ab, OL5"), (p.alnum(), "123ab, OL5", "123ab, OL5!!!"),
    (p.remove_punctuation(), "123ab, OL5, UK", "123ab OL5 UK"), (p.normalize_unicode(), "Râñdòm", "Râñdòm"),
    (p.ascii_fold(), "Râñdòm Stréèt", "Random Street"), (p.remove_stopwords(), "this is a Random Street", "   Random Street"),
    (p.normalize_names(), "Mr. John H Doe (Da Legend)", "John H Doe"), (p.normalize_company(), "Random Services LLC.", "Random Services"),
]


@pytest.mark.parametrize("pre, a, b", PREPROCESSORS, ids=lambda x: str(x)[:30])
def test_preprocessors(spark, pre, a, b):
    df = frame(spark, [(0, a), (1, b)], "uid long, address string")
    run = lambda pipe: column(kd.dedupe(df).apply(pipe).canonicalize().collect())
    assert run(kd.pipeline().step(kd.col("address").exact())) == [0, 1]
    assert run(kd.pipeline(preprocessors=pre).step(kd.col("address").exact())) == [0, 0]
    assert run(kd.pipeline().step(kd.col("address").exact(), preprocessors=[pre])) == [0, 0]
    assert run(kd.pipeline().step(kd.col("address", preprocessors=[pre]).exact())) == [0, 0]
    assert column(kd.dedupe(df).apply(kd.pipeline(preprocessors=pre).step(kd.col("address").exact())).canonicalize().collect(), "address") == [a, b]


def test_preprocessors_override(spark):
    df = frame(spark, [(0, "AB!"), (1, "ab")], "uid long, address string")
    run = lambda pipe: column(kd.dedupe(df).apply(pipe).canonicalize().collect())
    both = [p.lower(), p.alnum()]
    assert run(kd.pipeline(both).step(kd.col("address").exact())) == [0, 0]
    assert run(kd.pipeline(both).step(kd.col("address").exact(), preprocessors=p.lower())) == [0, 1]
    assert run(kd.pipeline(p.lower()).step(kd.col("address", preprocessors=both).exact(), preprocessors=p.alnum())) == [0, 0]
    for wrong in ("lower", 3, [p.lower(), "x"], kd.exact()):
        with pytest.raises(TypeError):
            kd.pipeline(preprocessors=wrong)


def test_names_and_companies():
    assert p.clean_name("Doe, Dr. John H., Jr.") == "John H. Doe"
    assert p.clean_name("") == "" and p.clean_name("Madonna") == "Madonna"


@pytest.mark.parametrize("text, expected", [("a+b x a", " x a"), ("x a+b", "x "), ("ab+ ab", "ab+ ab")])
def test_odd_stopwords(spark, text, expected):
    pre = p.remove_stopwords(["a+b"])
    from pyspark.sql import functions as F

    assert spark.range(1).select(pre(F.lit(text))).first()[0] == expected


def test_synthesize(spark):
    rows = [
        ("123ab, OL5", "hello@example.com", None, "A", None), ("123ab, OL5", None, None, "B", "Germany"), ("Completely random address", None, None, "C", "Spain"),
        ("55 bling blong road", None, None, "D", "Ireland"), ("55 bling blong road", "byebye@aol.ir", "Texas", "E", None),
    ]
    done = kd.dedupe(frame(spark, rows, "address string, email string, state string, random string, country string")).apply(kd.exact()).canonicalize("address")
    assert column(done.collect(), by="random") == [0, 0, 2, 3, 3]
    out = done.synthesize()
    assert out.columns[0] == "canonical_id"
    assert [tuple(r) for r in out.collect()] == [
        (0, "123ab, OL5", "hello@example.com", None, "A", "Germany"), (2, "Completely random address", None, None, "C", "Spain"),
        (3, "55 bling blong road", "byebye@aol.ir", "Texas", "D", "Ireland"),
    ]
    assert [r["random"] for r in done.synthesize("last").collect()] == ["B", "C", "E"]
    assert [r["random"] for r in done.synthesize("max").collect()] == ["B", "C", "E"]
    assert done.canonicals() == {0: 2, 3: 2} and done.canonicals(3) == {}


def test_nulls(spark):
    df = frame(spark, [(1, None), (2, None), (3, "x")], "id long, address string")
    run = lambda r: column(kd.dedupe(df).apply(r).canonicalize("address", id="id").collect(), by="id")
    assert run(kd.exact()) == [1, 1, 3] and run(kd.isna()) == [1, 1, 3] and run(~kd.isna()) == [1, 2, 3]


def test_validation(spark):
    df = frame(spark, [(1, A)], "uid long, address string")
    with pytest.raises(ValueError):
        kd.dedupe(df).drop_duplicates()
    with pytest.raises(ValueError):
        kd.dedupe(df).drop_duplicates(("address", "address"))
    with pytest.raises(ValueError):
        kd.dedupe(df).drop_duplicates("address", keep="middle")
    with pytest.raises(ValueError):
        kd.dedupe(df).drop_duplicates("missing")
    with pytest.raises(ValueError):
        kd.dedupe(df).apply({"address": kd.exact()}).drop_duplicates("address")
    with pytest.raises(ValueError):
        kd.dedupe(df).apply(kd.fuzzy()).drop_duplicates(("uid", "address"))
    with pytest.raises(ValueError):
        kd.dedupe(df).apply(kd.jaccard()).drop_duplicates("address")
    with pytest.raises(ValueError):
        kd.dedupe([1, 2])
    with pytest.raises(RuntimeError):
        kd.dedupe(df).canonicals()
    with pytest.raises(ValueError):
        kd.dedupe(df).apply(kd.exact()).canonicalize("address").canonicals(1)
    for wrong in (lambda: kd.fuzzy(1.0), lambda: kd.cosine(-0.1), lambda: kd.tfidf(topn=0), lambda: kd.pipeline().step([])):
        with pytest.raises(ValueError):
            wrong()
    for wrong in (lambda: ~kd.fuzzy(), lambda: ~kd.col("address").exact(), lambda: kd.pipeline().step("address"), lambda: kd.pipeline().step([kd.exact()])):
        with pytest.raises(TypeError):
            wrong()
    with pytest.raises(AttributeError):
        kd.col("address").nothing()
    assert ~~kd.isna() == kd.isna()


def test_applying(spark):
    df = frame(spark, [(1, A)], "uid long, address string")
    for wrong in ({1: kd.exact()}, {"address": "exact"}, {"address": [kd.exact(), 1]}, 5):
        with pytest.raises(InvalidRuleError):
            kd.dedupe(df).apply(wrong)
    with pytest.raises(InvalidRuleError):
        kd.dedupe(df).apply({"address": kd.exact()}).apply(kd.exact())
    with pytest.warns(UserWarning):
        kd.dedupe(df).apply(kd.exact()).apply({"address": kd.exact()})
    with pytest.warns(UserWarning):
        kd.dedupe(df).apply(kd.pipeline().step(kd.col("address").exact())).apply(kd.col("address").exact())
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        kd.dedupe(df).apply({"address": kd.exact()})
        kd.dedupe(df).apply(kd.exact()).apply(kd.fuzzy())
    with pytest.raises(TypeError):
        kd.register(lambda array: [])(1)


def test_text(spark):
    df = frame(spark, [(1, A)], "uid long, address string")
    assert kd.dedupe(df).explain() is None
    assert kd.dedupe(df).apply(kd.fuzzy()).apply(kd.exact()).explain() == "fuzzy(threshold=0.95, scorer='simple_ratio')\nexact()"
    assert "col('address').isna()" in kd.dedupe(df).apply(kd.pipeline().step(~kd.col("address").isna())).explain()
    assert "'address': (exact(),)," in kd.dedupe(df).apply({"address": kd.exact()}).explain()


def test_transform(spark):
    df = kd.datasets.fake_10(spark)
    for rule, columns, settings in [("fuzzy", "address", {"threshold": 0.65}), ("tfidf", "address", {"ngram": 1}), ("lsh", "address", {"ngram": 1}), ("jaccard", ("account", "birth_country"), {"threshold": 0.3}), ("cosine", ("property_area_sq_ft", "property_num_rooms"), {})]:
        short = df.transform(kd.drop_duplicates_by(rule, columns, **settings))
        long = kd.dedupe(df).apply(getattr(kd, rule)(**settings)).drop_duplicates(columns)
        assert sorted(r["id"] for r in short.collect()) == sorted(r["id"] for r in long.collect())


def test_fake_people(spark):
    one, again = kd.datasets.fake(spark, 500, seed=3), kd.datasets.fake(spark, 500, seed=3).repartition(7)
    assert one.exceptAll(again).count() == 0 and one.count() == 500 and len(one.columns) == 14
    assert one.select("id").distinct().count() == 499
    nulls = sum(r is None for r in [x["city"] for x in one.collect()])
    assert 0 < nulls < 40
    assert kd.datasets.fake(spark, 0).count() == 0


def test_stream(spark, tmp_path):
    from kindred.streaming.linking import StreamLinker

    schema = "id long, name string"
    for i, rows in enumerate([[(1, "a"), (2, "B")], [(3, "A"), (4, "c")], [(5, "b"), (6, None), (7, None)]]):
        frame(spark, rows, schema).write.parquet(f"{tmp_path}/in/{i}.parquet")
    linker = StreamLinker("name", "id", f"{tmp_path}/keys", lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}"), preprocessors=[p.lower()])
    for n in range(3):
        linker(spark.read.schema(schema).parquet(f"{tmp_path}/in/{n}.parquet"), n)
    linker(spark.read.schema(schema).parquet(f"{tmp_path}/in/2.parquet"), 2)  # run again after a failure
    got = {r["id"]: r["canonical_id"] for r in spark.read.parquet(*[f"{tmp_path}/out/{n}" for n in range(3)]).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 2, 6: 6, 7: 6}


def test_entry_without_the_corpus_operators():
    """The entry module guards the optional subpackage by name only."""
    import __spark_entry__ as e

    assert e._optional("kindred.nothing_here") is None
    assert "q01_exact_drop_first" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_id_column_from_the_environment():
    import os
    import subprocess
    import sys

    env = os.environ | {"CANONICAL_ID": "entity", "PYTHONPATH": os.getcwd()}
    said = subprocess.run([sys.executable, "-c", "import kindred; print(kindred.CANONICAL_ID)"], env=env, capture_output=True, text=True)
    assert said.stdout.strip().endswith("entity")
