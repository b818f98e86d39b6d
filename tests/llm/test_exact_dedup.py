import hashlib
from collections import defaultdict

import numpy as np
import pytest

from kindred.llm.exact_dedup import DigestIndex, build_bucket, digests, exact_dedup, grouped, keep_winners

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text):
    return hashlib.sha256((text or "").translate(str.maketrans(UPPER, LOWER)).encode()).hexdigest()


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[digest(t)].append(i)
    best = {k: max((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return best, {k: len(v) for k, v in groups.items()}


@pytest.mark.parametrize("which", ["odd_rows", "small"])
def test_groups(spark, request, which):
    from tests.llm.conftest import make_docs

    rows = request.getfixturevalue(which)
    best, sizes = brute(rows)
    out = exact_dedup(make_docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text_sha256"], str(r["keep_id"]), r["group_size"]) for r in out) == sorted(
        (str(i), digest(t), str(best[digest(t)]), sizes[digest(t)]) for i, t, *_ in rows
    )
    kept = [r["text_sha256"] for r in out if r["kept"]]
    assert len(kept) == len(set(kept)) == len(best)


def test_stage_keeps_winners_with_all_columns(odd, odd_rows):
    best, _ = brute(odd_rows)
    out = keep_winners(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert sorted((digest(r["text"]), str(r["doc_id"])) for r in rows) == sorted((k, str(v)) for k, v in best.items())
    assert all(r["sha"] == "sha!" and r["row"] == "row!" for r in rows)


def test_saved_index(spark, small, tmp_path):
    """An index of the first half is saved, opened again, and looked up by slot: members are what it holds, all else fails the byte check."""
    import pyspark.sql.functions as F

    from tests.llm.conftest import make_docs

    old, new = small[:100], [*small[100:], *[(1000 + i, t, lang) for i, t, lang in small[:20]]]
    rows = digests(make_docs(spark, old), ["doc_id"]).withColumn("copies", F.lit(1))
    DigestIndex.build(grouped(rows), str(tmp_path / "index"))
    index = DigestIndex.open(spark, str(tmp_path / "index"))
    held = {digest(t) for _, t, *_ in old}
    seen = index.look_up(digests(make_docs(spark, new), ["doc_id"])).collect()
    assert len(seen) == len(new) and all(r["member"] == (r["sha"].hex() in held) for r in seen)
    assert any(r["held"] is not None and not r["member"] for r in seen)
    best, sizes = brute([*old, *new])
    out = exact_dedup(make_docs(spark, new), index=index).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in out) == sorted((i, best[digest(t)], sizes[digest(t)]) for i, t, *_ in new)


def test_other_splits_when_read_again(spark, sf_dir, small):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spark.conf.set("spark.sql.files.minPartitionNum", "4")
    out = keep_winners(docs)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    got = [r["doc_id"] for r in out.collect()]
    spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(got) == sorted(brute(small)[0].values())


def test_empty_table(empty):
    assert exact_dedup(empty).collect() == []
    assert keep_winners(empty).collect() == []


@pytest.mark.parametrize("n", [1, 2, 5, 100, 512, 1500])
def test_perfect_hash_is_minimal(n):
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    _, _, slots = build_bucket(keys)
    assert sorted(slots) == list(range(n))
    assert isinstance(slots, np.ndarray)
