import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from kindred.llm.bpe import vocabulary_path
from kindred.llm.packing import SIZE, pack, plan
from tests.llm.conftest import make_docs


def check(rows, out, size=SIZE):
    t = Tokenizer.from_file(vocabulary_path())
    t.no_padding()
    t.no_truncation()
    want = []
    for i, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), size):
            part = ids[k : k + size]
            want.append((str(i), k // size, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(places), sum(w[3] for w in want)


@pytest.mark.parametrize("which", ["odd_rows", "small"])
def test_pack(spark, request, which):
    rows = request.getfixturevalue(which)
    sequences, total = check(rows, pack(make_docs(spark, rows)).collect())
    assert sequences <= -(-total // SIZE) * 1.05 + 1


def test_small_sequences(spark, small):
    check(small[:60], pack(make_docs(spark, small[:60]), size=64).collect(), 64)


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_once(seed):
    r = random.Random(seed)
    counts = {r.randrange(1, SIZE + 1): r.randrange(1, 400) for _ in range(r.choice([1, 5, 300, 1500]))}
    used = defaultdict(int)
    sequences = 0
    for lengths, n in plan(dict(counts)):
        assert sum(lengths) <= SIZE and n > 0
        sequences += n
        for x in lengths:
            used[x] += n
    assert dict(used) == counts
    total = sum(k * v for k, v in counts.items())
    if len(counts) > 100:
        assert sequences <= 1.06 * total / SIZE + 1


def test_exact_complements():
    assert sorted(plan({1500: 3, 548: 3})) == [((1500, 548), 3)]
    assert plan({1000: 1, 600: 1, 448: 1})[0][1] == 1 and len(plan({1000: 1, 600: 1, 448: 1})) == 1
    assert len(plan({1000: 1, 500: 1, 300: 1, 248: 1})) == 1


def test_empty_table(empty):
    assert pack(empty).collect() == []
