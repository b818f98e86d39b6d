import random
import re

import pytest

from kindred.llm import near_dedup as nd
from tests.llm.conftest import make_docs

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)])


def brute(rows, percent=85):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(str(d), len(s), str(least.get(find(i)) if s else d)) for i, ((d, *_), s) in enumerate(zip(rows, sets))]


def planted(seed, families=6, copies=12):
    """Families of near copies around the threshold, some of them chains."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for f in range(families):
        base = [r.choice(words) for _ in range(r.choice([60, 150, 400]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                own[r.randrange(len(own))] = r.choice(words)
            if f % 2:
                base = own
            rows.append((n, " ".join(own), "en"))
            n += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("which", ["odd_rows", "small", "planted"])
def test_components(spark, request, which):
    rows = planted(1) if which == "planted" else request.getfixturevalue(which)
    out = nd.near_dedup(make_docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out) == sorted(brute(rows))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


@pytest.mark.parametrize("split", [32, 1])
def test_blocks_waves_and_finer_keys_lose_nothing(spark, monkeypatch, split):
    monkeypatch.setattr(nd, "BLOCK", 4)
    monkeypatch.setattr(nd, "WAVE", 1)
    monkeypatch.setattr(nd, "SPLIT", split)
    monkeypatch.setattr(nd, "LEVELS", 2)
    rows = planted(2, families=3, copies=30)
    out = nd.near_dedup(make_docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out) == sorted(brute(rows))


def test_pigeonhole_keys():
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (200, nd.COMPONENTS)).astype("<u2")
    b = a.copy()
    for row in b:
        row[rng.choice(nd.COMPONENTS, nd.DISTANCE, replace=False)] ^= 1
    for level in range(3):
        assert (nd.keys_of(a, level=level) == nd.keys_of(b, level=level)).any(axis=1).all()


def test_stage(odd, odd_rows):
    out = nd.keep_one_per_group(odd)
    assert out.columns == odd.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(4) == 1 and 5 not in ids and 8 not in ids and {1, 2, 3, 7} <= set(ids) and ids.count(None) == 2


def test_other_splits_when_read_again(spark, sf_dir):
    """Files are split otherwise when the stage runs than when it was planned; all rows come out the same."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(r["doc_id"] for r in nd.keep_one_per_group(docs).collect())
    spark.conf.set("spark.sql.files.minPartitionNum", "4")
    out = nd.keep_one_per_group(docs)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    got = sorted(r["doc_id"] for r in out.collect())
    spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == want and got


def test_splits_that_change_between_jobs(spark, sf_dir, monkeypatch):
    docs, parts, real = spark.read.parquet(f"{sf_dir}/documents.parquet"), [1, 5, 2, 7], nd.materialize
    want = sorted(map(tuple, nd.near_dedup(docs).collect()))

    def changing(df, tag):
        parts.append(parts.pop(0))
        spark.conf.set("spark.sql.files.minPartitionNum", str(parts[0]))
        return real(df, tag)

    monkeypatch.setattr(nd, "materialize", changing)
    got = sorted(map(tuple, nd.near_dedup(docs).collect()))
    spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == want


def test_repeated_rows_of_one_id(spark):
    """Rows that repeat an id and a text, in several tasks: one of them stays, and links are not multiplied."""
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(7, base, "en")] * 40 + [(8, base + " more", "en")] * 3
    docs = make_docs(spark, rows).repartition(8)
    assert [r["doc_id"] for r in nd.keep_one_per_group(docs).collect()] == [7]
    assert {r["component_id"] for r in nd.near_dedup(docs).collect()} == {7}


def test_empty_table(empty):
    assert nd.near_dedup(empty).collect() == []
    assert nd.keep_one_per_group(empty).collect() == []


def test_stage_links_from_0_8_on(spark, sf_dir):
    """Pairs of similarity 0.815 (4 of 200 words changed, 176 of 216 shingles in common), and of 0.77, which stay apart."""
    import corpus_pipeline

    r, rows = random.Random(3), []
    for k in range(120):
        base = [f"v{r.randrange(10**6)}" for _ in range(200)]
        own = list(base)
        for at in range(10, 40 * (4 if k < 60 else 5), 40):
            own[at] = f"n{k}"
        rows += [(2 * k, " ".join(base), "en"), (2 * k + 1, " ".join(own), "en")]
    docs = make_docs(spark, rows)
    assert {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()} == {2 * k for k in range(60)} | set(range(120, 240))
    assert all(x["kept"] for x in nd.near_dedup(docs).collect())
