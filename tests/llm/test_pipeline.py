import pytest

import corpus_pipeline
from kindred.llm import exact_dedup, language_id, near_dedup, toxicity
from kindred.plans import storage
from tests.llm.conftest import make_docs
from tests.llm.test_exact_dedup import brute as brute_exact
from tests.llm.test_near_dedup import brute as brute_near
from tests.llm.test_packing import check


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "exact_dedup", "near_dedup", "packing"]


def test_every_stage_against_brute_force(spark, sf_dir):
    """Each stage on what the one before kept: the toxicity operator's verdict, letters, and brute force for the rest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        assert docs.columns == before.columns, name
        rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
        got = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            want = {r["doc_id"] for r in toxicity.toxicity(before, labels).collect() if not r["predicted"]}
        elif name == "language_id":
            want = {r["doc_id"] for r in language_id.language_id(before).collect() if r["coverage"] >= language_id.COVERAGE}
        elif name == "exact_dedup":
            best = brute_exact(rows)[0]
            want = set(best.values())
        else:
            want = {d for (d, _), (_, _, c) in zip(rows, brute_near(rows, 80)) if str(d) == c}
        assert got == want and got, name
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    check(rows, corpus_pipeline.run(spark, sf_dir).collect())


def test_exact_then_near(spark, sf_dir, small):
    """The stages agree with the operators' verdicts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in exact_dedup.exact_dedup(docs).where("kept").collect()}
    assert {r["doc_id"] for r in exact_dedup.keep_winners(docs).collect()} == kept
    near = {r["doc_id"] for r in near_dedup.near_dedup(docs).collect() if r["kept"]}
    assert {r["doc_id"] for r in near_dedup.keep_one_per_group(docs).collect()} == near


@pytest.mark.parametrize("k", range(4))
def test_empty_documents_pass(spark, sf_dir, empty, k):
    name, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, empty, sf_dir).collect() == []


def test_odd_rows_pass(spark, sf_dir, odd_rows):
    docs = make_docs(spark, odd_rows)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() > 0


def test_small_tables_are_few_files(spark, sf_dir, monkeypatch):
    """Where a session deals everything to many tasks, the stages don't write their tables in between as so many files."""
    files = {}

    def counted(df, tag):
        out = storage.materialize(df, tag)
        files[tag] = max(files.get(tag, 0), len(out.inputFiles()))
        return out

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = [{r["doc_id"] for r in f(docs).collect()} for f in (exact_dedup.keep_winners, near_dedup.keep_one_per_group)]
    for module in (exact_dedup, near_dedup):
        monkeypatch.setattr(module, "materialize", counted)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        after = [{r["doc_id"] for r in f(docs).collect()} for f in (exact_dedup.keep_winners, near_dedup.keep_one_per_group)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert after == before
    least = 2 * spark.sparkContext.defaultParallelism
    late = {"digests", "found"}  # no bound is known before the first, and the second is as heavy as it is narrow
    assert {t for t, n in files.items() if n > least} <= late, files
    assert {"named", "gone", "verdicts", "classes", "buckets", "rooted"} <= files.keys()
