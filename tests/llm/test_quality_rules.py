import re

import pytest

from kindred.llm import quality_rules as qr
from tests.llm.conftest import make_docs


def counts(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = list(zip(ws, ws[1:], ws[2:]))
    again = set()
    seen = {}
    for i, t in enumerate(triples):
        seen.setdefault(t, []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for p in places:
                again.update((p, p + 1, p + 2))
    n = len(ws)
    failed = n < 50 or 100 * len(again) > 50 * n
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


@pytest.mark.parametrize("which", ["odd_rows", "small"])
def test_counts(spark, request, no_labels, which):
    rows = request.getfixturevalue(which)
    out = qr.quality_rules(make_docs(spark, rows), no_labels).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out)
    assert got == sorted((str(i), *counts(t)) for i, t, *_ in rows)
    assert all(r["kept"] == (not r["base_failed"]) for r in out)  # nothing is proven without labels


def test_overlapping_repeats(spark, no_labels):
    texts = ["a b c a b c a b c", "a a a a", "a b c d e f", "x y z q x y z", "a b a b a b a"]
    out = qr.quality_rules(make_docs(spark, [(i, t, "en") for i, t in enumerate(texts)]), no_labels).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in out} == {i: counts(t)[4] for i, t in enumerate(texts)}


def test_binomial_bound():
    assert qr.binomial_at_most(0, 10, 0.5) == pytest.approx(0.5**10)
    assert qr.binomial_at_most(5, 10, 0.5) == pytest.approx(0.623046875)
    assert qr.binomial_at_most(10, 10, 0.5) == 1


def test_cutoffs_need_proof():
    steps = len(qr.PATH)
    none = [0] * steps
    assert qr.choose({"en": none}, {"en": qr.LEAST - 1}, {"en": none}, {"en": 0}) == {}
    assert qr.choose({"en": none}, {"en": qr.LEAST}, {"en": none}, {"en": 0}) == {"en": qr.PATH[0]}  # the mildest of equals
    # Bad ones fall from step 6 on, good ones from step 10 on in numbers that prove nothing.
    caught, lost = [0] * 6 + [9] * (steps - 6), [0] * 10 + [100] * (steps - 10)
    assert qr.choose({"en": lost}, {"en": 1000}, {"en": caught}, {"en": 9}) == {"en": qr.PATH[6]}
    # Trying ends at the first cutoff without proof, even if later ones would have it.
    early = [100] + [0] * (steps - 1)
    assert qr.choose({"en": early}, {"en": 1000}, {"en": caught}, {"en": 9}) == {}
    # Two strata share ALPHA: 99 labels prove something for one alone only.
    assert qr.choose({"a": none, "b": none}, {"a": qr.LEAST, "b": 10**4}, {"a": none, "b": none}, {"a": 0, "b": 0}) == {"b": qr.PATH[0]}


def test_guarantee_holds():
    """Good documents with scores that make most cutoffs of the path too costly: more than RISK of them are rejected in at most ALPHA of the trials."""
    import numpy as np

    rng, path, failed, trials = np.random.default_rng(0), np.array(qr.PATH), 0, 2000
    share = np.clip(0.06 / path, 0, 1)  # the true share of good documents at or above each cutoff
    for _ in range(trials):
        n = {"a": 200, "b": 700}
        lost, caught = {}, {}
        for s, m in n.items():
            u = rng.random(m)  # rejected at a cutoff if below its share
            lost[s] = (u[:, None] < share).sum(axis=0).tolist()
            caught[s] = list(range(len(path)))  # bad ones always speak for the strictest cutoff
        cut = qr.choose(lost, n, caught, {s: len(path) for s in n})
        failed += any(share[qr.PATH.index(c)] > qr.RISK for c in cut.values())
    assert failed / trials <= qr.ALPHA + 3 * (qr.ALPHA / trials) ** 0.5


def test_labels_decide(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    noisy = " ".join("$$$###" if i % 2 else f"w{i}" for i in range(80))
    rows = [(i, f"{clean} {i}", "en") for i in range(200)] + [(2000 + i, f"{noisy} {i}", "en") for i in range(20)] + [(3000 + i, f"{noisy} {i}", None if i % 2 else "") for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(2000 + i, 0, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in qr.quality_rules(make_docs(spark, rows), labels).collect()}
    assert all(out[i]["kept"] for i in range(200))
    assert not any(out[2000 + i]["kept"] for i in range(20)) and "symbols" in out[2000]["rejected_by"]
    assert all(out[3000 + i]["kept"] for i in range(20))  # no labels in these strata


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_verdicts_against_sql(spark, sf):
    import duckdb

    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    res = con.execute(qr.OP3_SQL)
    names = [c[0] for c in res.description]
    out = qr.op3_quality_rules(spark, d)
    assert sorted(out.columns) == sorted(names)
    assert sorted(map(tuple, out.select(*names).collect())) == sorted(res.fetchall())
    if sf == "sf0.01":
        assert out.where("NOT kept AND NOT base_failed").count() > 20


def test_empty_table(empty, no_labels):
    assert qr.quality_rules(empty, no_labels).collect() == []
