"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from kindred.plans import catalog
from kindred.sources.batches import TABLES

FOLDER = "/root/testdata/sf0.001"
SLOW = {"q38b_blocking_fuzzy"}


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(FOLDER):
        pytest.skip("the test tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in catalog.oracle_sql() and name not in SLOW:
        res = db.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in res.fetchall())
