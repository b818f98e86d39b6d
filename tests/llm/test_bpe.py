import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from kindred.llm.bpe import Encoder, bpe_decode, bpe_digests, bpe_encode, vocabulary_path


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary_path())
    t.no_padding()
    t.no_truncation()
    return t


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("which", ["odd_rows", "small"])
def test_digests(spark, request, library, which):
    from tests.llm.conftest import make_docs

    rows = request.getfixturevalue(which)
    out = bpe_digests(make_docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == sorted((str(i), *want(library, t)) for i, t, *_ in rows)


def test_random_texts(library):
    r, e = random.Random(5), Encoder(vocabulary_path())
    kinds = ["abcdefghijklmnopqrstuvwxyzABC '.,!?0123456789\n\t", "äöüßéèñçÅÆøİıſK", "абвгдежз日本語한국어हिन्दी", "̀́‍🙂👩‍👩‍👧  　\x00\x1f<|>'s'll"]
    for _ in range(4000):
        text = "".join(r.choice(r.choice(kinds)) for _ in range(r.randrange(0, 60)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids)}I", e.encode(text))) == ids, repr(text)
        assert e.decode(ids) == library.decode(ids, skip_special_tokens=False), repr(text)


def test_ids_and_back(odd, odd_rows, library):
    ids = bpe_encode(odd)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in ids.collect()) == sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in odd_rows)
    back = {r["doc_id"]: r["text"] for r in bpe_decode(ids).collect()}
    assert back[5] == library.decode(library.encode(dict((i, t) for i, t, _ in odd_rows)[5], add_special_tokens=False).ids, skip_special_tokens=False)


def test_empty_table(empty):
    assert bpe_digests(empty).collect() == []


@pytest.mark.parametrize("part", ["normalizer", "pre_tokenizer", "decoder", "model"])
def test_other_vocabulary_files_are_refused(tmp_path, part):
    import json

    from kindred.llm import bpe

    with open(bpe.vocabulary_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec[part] = spec["model"] | {"end_of_word_suffix": None} if part == "model" else {"type": "Other"}
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        bpe.Encoder(str(tmp_path / "other.json"))
