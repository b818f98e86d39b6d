import os

import pytest

SMALL = "/root/testdata/sf0.001"

#: Columns whose names the operators use inside; all carry a value that must come back untouched.
EXTRA = ("row", "sha", "n", "winner", "key", "kept", "score", "root", "whole", "node", "features", "word", "c", "place", "stratum", "lang_pred", "rid", "__row", "__id", "id", "of", "stays", "leaf", "gone")


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SMALL):
        pytest.skip("the test tables are not here")
    return SMALL


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    """(doc_id, text, lang) of the smallest table, as Python rows."""
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").collect()]


def make_docs(spark, rows):
    """documents from (doc_id, text, lang), with columns of clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in EXTRA)
    return spark.createDataFrame([(i, t, lang, None, None, *[f"{c}!" for c in EXTRA]) for i, t, lang in rows], schema)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, ties, a very long text and odd characters."""
    long = " ".join(f"word{i % 997} token{i % 89}" for i in range(60_000))
    passage = "\n".join(f"this line number {i} is part of a passage that comes again elsewhere" for i in range(8))
    return [
        (1, None, None), (2, "", "en"), (3, "   \n\t ", "en"), (None, "a text without an id", None), (None, None, None),
        (4, "The quick brown fox jumps over the lazy dog", "en"), (4, "The quick brown fox jumps over the lazy dog", "en"),
        (5, "the QUICK brown fox jumps over the lazy dog", "en"), (6, "ÀÉÎ ßtraße İstanbul naïve 東京 🙂🙂", "de"), (7, long, "en"), (8, long + " end", None),
        (9, passage, "en"), (10, "before\n" + passage + "\nafter", "fr"), (11, "x", ""), (12, "\x00\x1f  odd spaces", "es"), (13, "1234 5678 !!!", "en"),
        (2**62, "largest id", "en"), (-5, "negative id", "en"), (14, "line\r\nline\r\nline", "en"), (15, "<|endoftext|> special <|startoftext|>text", "en"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make_docs(spark, odd_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return make_docs(spark, [])


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
