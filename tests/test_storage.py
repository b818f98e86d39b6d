"""Tables in shared storage: where they go, and when they are deleted."""

import os
from types import SimpleNamespace

import pytest

from kindred.plans import storage


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
    context = SimpleNamespace(applicationId=f"app-{master}-{folder}", master=master, getConf=lambda: conf)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_root(session("spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_root(session("local-cluster[2,1,1024]"))
    assert storage.shared_root(session("spark://host:7077", "hdfs://host/shared")).startswith("hdfs://host/shared/kindred-")
    assert storage.shared_root(session("local[4]")).startswith("file:///")


def test_scratch_tables_go_and_kept_ones_stay(spark):
    path = lambda df: df.shared_path.removeprefix("file:")
    with storage.scratch() as keep:
        a = storage.materialize(spark.range(3), "a")
        with storage.scratch() as inner:
            b, c = inner(storage.materialize(spark.range(4), "b")), storage.materialize(spark.range(5), "c")
        assert os.path.isdir(path(a)) and os.path.isdir(path(b)) and not os.path.isdir(path(c))
        d = keep(storage.materialize(spark.range(6), "d"))
    assert [os.path.isdir(path(x)) for x in (a, b, d)] == [False, False, True]
    assert d.count() == 6
    storage.discard(d)
    assert not os.path.isdir(path(d))
    e = storage.materialize(spark.range(2), "e")  # outside: stays
    assert e.count() == 2


def test_a_small_table_is_written_by_few_tasks(spark):
    least = 2 * spark.sparkContext.defaultParallelism
    few = storage.materialize(storage.sized(spark.range(0, 2000, 1, 100), 2000), "few")
    assert len(few.inputFiles()) == least
    assert sorted(r["id"] for r in few.collect()) == list(range(2000))
    assert len(storage.materialize(storage.sized(spark.range(0, 2000, 1, 20), 20 * storage.ROWS), "many").inputFiles()) == 20
    assert len(storage.materialize(storage.sized(spark.range(0, 2000, 1, 20), None), "unknown").inputFiles()) == 20
