"""BPE encoding and decoding by forced-boundary splitting.

A merge can only ever join two neighbouring bytes if some vocabulary token holds that byte pair. Pairs that
no token holds are certain cuts: each word is split there, the fragments are merged independently, and their
ids are concatenated. The result is exactly that of merging the whole word. White space and the
boundaries of the pre-tokenizer are certain cuts too, so a text becomes a sequence of short fragments.

Scale: one narrow pass over the text, nothing is shuffled. The vocabulary (about 2 MB) is read once per Python
worker from a path that is a parameter. Words that came before are looked up in a table of about CACHE words, all words of a batch at
once; when it is full, the less frequent half goes.
"""

from __future__ import annotations

import hashlib
import json
import re
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from kindred.llm.common import documents, prepare, slices

#: Words whose ids are kept.
CACHE = 120_000
END = "</w>"

_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
#: What is a word of its own between letters and white space, as the pattern above has it.
_BETWEEN = r"'(?:s|t|re|ve|m|ll|d)|\p{N}|[^\p{L}\p{N}\s]+"
#: Texts without other characters need no Unicode normalisation beyond str.lower().
_SPECIAL = re.compile("[^\t-\r -~¡-įı-˿]")


#: What a vocabulary file must state, as normalising, splitting and decoding are built for it here.
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
    "post_processor": None,
}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Cache(dict):
    """Values of make(key); all go when there are `limit`."""

    def __init__(self, make, limit: int = CACHE):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 400:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def _byte_letters() -> dict[int, str]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids and tokens of texts for a word-end BPE vocabulary in the tokenizers file format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        for part, known in _KNOWN.items():
            if spec.get(part) != known:
                raise ValueError(f"{path}: the encoder is built for another {part}")
        model = spec["model"]
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != END or model.get("byte_fallback") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path}: the encoder is built for a byte-pair model with {END} at the end of words")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        # Merging a fragment is the public library's model: one for fragments that end a word, one for the others.
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        inner, end = models.BPE(self.vocab, merges), models.BPE(self.vocab, merges, end_of_word_suffix=END)
        self.inner, self.heads = inner.tokenize, _Cache(self._head)
        self.many = Tokenizer(end)
        self.many.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = _byte_letters()
        inside = [t.removesuffix(END) for t in self.vocab]
        #: Byte pairs that some token holds; all others are forced boundaries.
        self.joined = {t[i : i + 2] for t in inside for i in range(len(t) - 1)}
        byte = {c: b for b, c in self.letters.items()}
        self.cut = np.ones((256, 256), bool)
        for a, b in self.joined:
            self.cut[byte[a], byte[b]] = False
        self.cut[32, :] = self.cut[:, 32] = False
        self.codes = np.array([32 if b == 32 else ord(self.letters[b]) for b in range(256)], "<u2")
        self.between = re.compile("|".join(map(re.escape, self.special)))
        self.names = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.large_string())
        # The table: words, where their ids begin in `flat` and how many there are, and how often they came.
        self.known = pa.array([], pa.large_string())
        self.flat = np.zeros(0, np.uint32)
        self.start = self.length = self.hits = np.zeros(0, np.int64)

    def fragments(self, letters: str) -> list[str]:
        """The word's byte letters, cut at its forced boundaries."""
        joined, out, start = self.joined, [], 0
        if joined.issuperset(map(add, letters, letters[1:])):
            return [letters]
        for i in range(1, len(letters)):
            if letters[i - 1 : i + 1] not in joined:
                out.append(letters[start:i])
                start = i
        out.append(letters[start:])
        return out

    def _head(self, head: bytes) -> list[int]:
        """The ids of the fragments before a word's last forced boundary."""
        return [x.id for f in self.fragments("".join([self.letters[b] for b in head])) for x in self.inner(f)]

    def _add(self, words: pa.Array) -> None:
        """Put the ids of new words into the table: of the fragments before a word's last forced boundary, then of the last fragment.

        Last fragments, most of which are whole words, are merged together in one call.
        """
        text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words), pa.scalar(" ", pa.large_string()))[0].as_py().encode("utf-8")
        raw, heads = np.frombuffer(text, np.uint8), {}
        cuts = np.flatnonzero(self.cut[raw[:-1], raw[1:]])
        if len(cuts):
            spaces = np.flatnonzero(raw == 32)
            owner = np.searchsorted(spaces, cuts)
            last = np.diff(owner, append=-1) != 0
            owner, ends = owner[last], cuts[last] + 1
            keep = np.ones(len(raw), bool)
            for o, a, b in zip(owner.tolist(), np.r_[0, spaces + 1][owner].tolist(), ends.tolist()):
                heads[o] = self.heads[text[a:b]]
                keep[a:b] = False
            raw = raw[keep]
        made = self.many.encode(self.codes[raw].tobytes().decode("utf-16-le"), add_special_tokens=False)
        owner, ids = np.array(made.word_ids, np.int64), np.array(made.ids, np.uint32)
        length = np.bincount(owner, minlength=len(words))
        if len(length) != len(words) or not length.all():
            raise ValueError("a word has no token")
        if heads:
            before = np.zeros(len(words), np.int64)
            before[list(heads)] = [len(h) for h in heads.values()]
            length = length + before
            start = np.cumsum(length) - length
            rank = np.arange(len(ids)) - np.searchsorted(owner, owner)  # place of a token in its last fragment
            all_ids = np.empty(length.sum(), np.uint32)
            all_ids[(start + before)[owner] + rank] = ids
            for o, h in heads.items():
                all_ids[start[o] : start[o] + len(h)] = h
            ids = all_ids
        self.start = np.r_[self.start, np.cumsum(length) - length + len(self.flat)]
        self.length, self.hits = np.r_[self.length, length], np.r_[self.hits, np.zeros(len(words), np.int64)]
        self.flat, self.known = np.r_[self.flat, ids], pa.concat_arrays([self.known, words])

    def _forget(self) -> None:
        """Keep the half of the table that came most often."""
        stay = np.sort(np.argsort(-self.hits, kind="stable")[: CACHE // 2])
        self.known, self.hits = self.known.take(pa.array(stay)), self.hits[stay] // 2
        start, length = self.start[stay], self.length[stay]
        ends = np.cumsum(length)
        self.flat = self.flat[np.arange(length.sum()) + np.repeat(start - (ends - length), length)]
        self.start, self.length = ends - length, length

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where each word's end."""
        if len(self.known) > CACHE:
            self._forget()
        at = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        gaps = np.flatnonzero(at < 0)
        if len(gaps):
            new = words.take(pa.array(gaps)).dictionary_encode()
            at[gaps] = new.indices.to_numpy() + len(self.known)
            self._add(new.dictionary)
        self.hits = self.hits + np.bincount(at, minlength=len(self.hits))
        length = self.length[at]
        ends = np.cumsum(length)
        return self.flat[np.arange(length.sum()) + np.repeat(self.start[at] - (ends - length), length)], ends

    def decode(self, ids) -> str:
        """The tokens of ids, special ones too, with blanks between."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])

    def _odd(self, text: str) -> np.ndarray:
        """The ids of a text with special tokens, or with characters that have to be normalised."""
        words, places, at = [], [], 0
        for i, segment in enumerate(self.between.split(text)):
            if i:
                places.append((len(words), self.special[(found := self.between.match(text, at)).group()]))
                at = found.end()
            words += [w for c in self.normalize(segment).split(" ") if c for w in _WORDS.findall(c)]
            at += len(segment)
        ids, ends = self._ids(pa.array(words, pa.large_string()))
        if not places:
            return ids
        return np.insert(ids, np.r_[0, ends][[p for p, _ in places]], [x for _, x in places])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. All the work on words is done on arrays of a batch."""
        out: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if "<|" in t or _SPECIAL.search(t):
                out[i] = self._odd(t)
            else:
                plain.append(i)
        apart = pc.replace_substring_regex(pa.array([texts[i].lower() for i in plain], pa.large_string()), _BETWEEN, r" \0 ")
        split = pc.ascii_split_whitespace(apart)
        words = split.flatten()
        real = pc.not_equal(words, "")
        count = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
        ids, ends = self._ids(words.filter(real))
        edges = np.r_[0, ends][count[split.offsets.to_numpy() - split.offsets[0].as_py()]].tolist() if plain else []
        for i, a, b in zip(plain, edges, edges[1:]):
            out[i] = ids[a:b]
        return out

    def decode_batch(self, ids: list[np.ndarray]) -> list[str]:
        """The tokens of each array of ids, special ones too, with blanks between."""
        tokens = self.names.take(pa.array(np.concatenate([np.zeros(0, np.uint32), *ids])))
        edges = np.cumsum([0, *map(len, ids)])
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), tokens), pa.scalar(" ", pa.large_string())).to_pylist()

    def encode(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode_batch([text])[0].astype("<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def bpe_encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row; a null or empty text has no ids, repeated rows repeat."""
    path = path or vocabulary_path()

    def run(batches):
        e = encoder(path)
        for b in batches:
            for s in slices(b, 1, 1 << 21):
                values = [x.tolist() for x in e.encode_batch([t or "" for t in s.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(values, pa.list_(pa.int32()))], ["doc_id", "ids"])

    prepare(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) from ids; null ids decode to the empty text."""
    path = path or vocabulary_path()

    def run(batches):
        e = encoder(path)
        for b in batches:
            for s in slices(b, 1, 1 << 21):
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array([e.decode(r or []) for r in s.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    prepare(encoded.sparkSession)
    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def bpe_digests(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encodes and decodes in one pass.

    Defined cases: a null text is the empty text, which has no ids and decodes to the empty text; a null id
    is passed on; repeated rows repeat; other columns are ignored; an empty table gives an empty result.
    """
    path = path or vocabulary_path()

    def run(batches):
        e = encoder(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for s in slices(b, 1, 1 << 21):
                n, a, d = [], [], []
                coded = e.encode_batch([t or "" for t in s.column(1).to_pylist()])
                for ids, text in zip(coded, e.decode_batch(coded)):
                    n.append(len(ids))
                    a.append(sha(ids.astype("<u4").tobytes()))
                    d.append(sha(text.encode("utf-8")))
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    prepare(docs.sparkSession)
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir))
