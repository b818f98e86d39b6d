import random
import re

import pytest

from kindred.llm.line_dedup import line_dedup
from tests.llm.conftest import make_docs


def brute(rows, min_words):
    """Every run of lines of min_words words or more that some earlier place has too goes."""
    docs = sorted({(i, t or "") for i, t, *_ in rows}, key=lambda x: (x[0] is not None, x[0] or 0))
    lines = [t.split("\n") for _, t in docs]
    size = lambda ls: sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in ls)
    seen, gone = {}, [set() for _ in docs]
    for d, ls in enumerate(lines):
        for i in range(len(ls)):
            for j in range(i + 1, len(ls) + 1):
                seen.setdefault(tuple(ls[i:j]), (d, i))
    for d, ls in enumerate(lines):
        for i in range(len(ls)):
            for j in range(i + 1, len(ls) + 1):
                if size(ls[i:j]) >= min_words and seen[tuple(ls[i:j])] < (d, i):
                    gone[d].update(range(i, j))
    return {k: ("\n".join(x for i, x in enumerate(ls) if i not in g), len(ls), len(g)) for k, ls, g in zip(docs, lines, gone)}


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcdef") for _ in range(r.randrange(0, 5))) for _ in range(6)]
    rows = [(n, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 12))), "en") for n in range(25)]
    want = brute(rows, 6)
    out = line_dedup(make_docs(spark, rows), min_words=6).collect()
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out) == sorted((i, *v) for (i, _), v in want.items())


def test_odd_rows(odd, odd_rows):
    out = line_dedup(odd).collect()
    assert len(out) == len(odd_rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    texts = {i: t for i, t, _ in odd_rows}
    assert by[9][0]["text"] == texts[9] and by[10][0]["text"] == "before\nafter" and by[10][0]["n_removed"] == 8
    assert by[1][0]["text"] == "" and by[1][0]["n_lines"] == 1
    assert [r["text"] for r in by[4]] == [texts[4]] * 2
    assert by[7][0]["text"] == texts[7]


def test_copies_of_one_run(spark):
    """Many documents with one passage: the first keeps it."""
    passage = "\n".join(" ".join(f"w{i}{j}" for j in range(10)) for i in range(7))
    rows = [(n, f"own {n}\n{passage}\ntail {n}", "en") for n in range(200)]
    out = {r["doc_id"]: r["text"] for r in line_dedup(make_docs(spark, rows)).collect()}
    assert out[0] == rows[0][1]
    assert all(out[n] == f"own {n}\ntail {n}" for n in range(1, 200))


def test_empty_table(empty):
    assert line_dedup(empty).collect() == []
