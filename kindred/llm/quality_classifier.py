"""Quality classifier: a generalised additive model with pairwise interactions (boosted lookup tables).

Each feature is cut into bins, and the model is one lookup table per feature plus one per chosen pair. Training
goes round the features in turn and adds a shallow tree (up to three leaves over a feature's bins) to its table at a
small rate; then the pairs whose joint tables explain most of what is left are boosted with four-leaf trees in
the same way. The tables stay readable, and scoring is a sum of lookups, done for a whole batch at once.

Bounds: about SAMPLE labelled rows are learned from, chosen by a hash of the id; only their features (numbers) reach the
driver. Features come from one narrow pass over all whole texts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import documents, id_crc, labels, materialize, prepare, slices

SAMPLE, BINS, ROUNDS, RATE, PAIRS, PAIR_ROUNDS = 20_000, 48, 160, 0.08, 4, 80
LEAST, RIDGE = 12.0, 2.0
THRESHOLD = 0.3

FEATURES = (
    "words", "word_length", "longest_word", "distinct_words", "top_word", "repeated_triples", "duplicate_lines", "lines_per_word",
    "upper", "digits", "symbols", "bars", "exclamation", "commas", "stops", "short_words", "non_ascii", "marked_words",
)

_UPPER, _DIGIT, _SYMBOL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~=_{}[]\\/"


def features(text: str) -> list[float]:
    """FEATURES of a whole text; shares are of characters or words, sizes are logarithms. An empty text gives zeros."""
    ws = text.split()
    n = len(ws)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    left = lambda chars: (size - len(raw.translate(None, chars))) / size
    counts = Counter(ws)
    triples = list(zip(ws, ws[1:], ws[2:]))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, ws))
    return [
        np.log1p(n), letters / n, np.log1p(max(map(len, counts))), len(counts) / n, max(counts.values()) / n,
        1 - len(set(triples)) / len(triples) if triples else 0.0,
        1 - len(set(lines)) / len(lines), len(lines) / n,
        left(_UPPER), left(_DIGIT), left(_SYMBOL), left(b"|"), left(b"!"), left(b","), left(b"."),
        sum(c for w, c in counts.items() if len(w) <= 3) / n, 1 - len(text) / size,
        sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:?") / n,
    ]


def measured(docs: DataFrame) -> DataFrame:
    """docs (doc_id, ..., text) with the text replaced by its features."""
    prepare(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        for b in batches:
            for s in slices(b, b.num_columns - 1):
                rows = [features(t or "") for t in s.column(s.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[s.column(i) for i in range(s.num_columns - 1)], pa.array(rows, pa.list_(pa.float64()))], [*rest, "features"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema.fields]
    return docs.select(*rest, "text").mapInArrow(run, ", ".join([*fields, "features array<double>"]))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Leaf values per bin of the best tree of up to three leaves."""
    leaves = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(leaves):
            if b - a < 2:
                continue
            cg, ch, cn = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(n[a:b])
            gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
            gain[(cn[:-1] < LEAST) | (cn[-1] - cn[:-1] < LEAST)] = -1
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], k, a + i + 1)
        if best[1] is None:
            break
        a, b = leaves.pop(best[1])
        leaves += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """The best table of four leaves (one cut of the rows, a cut of the columns on either side) and its gain."""
    best, table = 0.0, np.zeros_like(g)
    for cut in range(1, len(g)):
        gain, parts = 0.0, []
        for rows in (slice(0, cut), slice(cut, len(g))):
            cg, ch, cn = (np.cumsum(x[rows].sum(axis=0)) for x in (g, h, n))
            if len(cg) < 2:
                break
            each = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
            each[(cn[:-1] < LEAST) | (cn[-1] - cn[:-1] < LEAST)] = -1
            i = int(each.argmax())
            if each[i] < 0:
                break
            gain += each[i]
            parts.append((rows, i + 1, cg[i] / (ch[i] + RIDGE), (cg[-1] - cg[i]) / (ch[-1] - ch[i] + RIDGE)))
        if len(parts) == 2 and gain - _gain(g.sum(), h.sum()) > best:
            best = gain - _gain(g.sum(), h.sum())
            table = np.zeros_like(g)
            for rows, i, low, high in parts:
                table[rows, :i], table[rows, i:] = low, high
    return table, best


class Model:
    """Cut points per feature, a table per feature, coarser cut points and a table per pair, and the intercept."""

    def __init__(self, base: float, edges=(), tables=(), coarse=(), pairs=()):
        self.base, self.edges, self.tables, self.coarse, self.pairs = base, edges, tables, coarse, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for i, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, i], side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(v)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the main tables, then of the chosen pairs."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    if len(y) < 2 * LEAST or y.min() == y.max():
        return Model(base)
    k = x.shape[1]
    edges, coarse = [_cuts(x[:, i], BINS) for i in range(k)], [_cuts(x[:, i], 8) for i in range(k)]
    at = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)]
    tables, total = [np.zeros(len(e) + 1) for e in edges], np.full(len(y), base)
    gradient = lambda: (y - (p := 1 / (1 + np.exp(-total))), np.maximum(p * (1 - p), 1e-6))
    sums = lambda where, size, v=None: np.bincount(where, v, minlength=size)
    for _ in range(ROUNDS):
        for i in range(k):
            size = len(tables[i])
            if size < 2:
                continue
            g, h = gradient()
            step = RATE * _tree(sums(at[i], size, g), sums(at[i], size, h), sums(at[i], size))
            tables[i] += step
            total += step[at[i]]
    both = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(coarse)]

    def joint(i, j, g, h):
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell = both[i] * shape[1] + both[j]
        return cell, [sums(cell, shape[0] * shape[1], v).reshape(shape) for v in (g, h, None)]

    g, h = gradient()
    ranked = sorted(((_tree2(*joint(i, j, g, h)[1])[1], i, j) for i in range(k) for j in range(i + 1, k)), reverse=True)
    pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in ranked[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in pairs:
            g, h = gradient()
            cell, joined = joint(i, j, g, h)
            step = RATE * _tree2(*joined)[0]
            table += step
            total += step.ravel()[cell]
    return Model(base, edges, tables, coarse, pairs)


def train(known: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from (doc_id, features) and labels (doc_id, quality), all of which may be learned from."""
    own = labelled.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = own.count()
    share = int(min(1.0, sample / max(1, n)) * (1 << 20))
    chosen = own.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) < share)
    rows = known.join(chosen, "doc_id").select("doc_id", "quality", "features").toPandas().sort_values("doc_id")  # about `sample` rows of numbers
    if not len(rows):
        return Model(0.0)
    return fit(np.array(rows["features"].tolist()), rows["quality"].to_numpy(float))


def quality_classifier(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Learns from labels of rows whose crc32(id) mod 5 is not 0. Defined cases: a null or empty text has zeros as
    features and is scored like any other; a null id counts as the empty text in the hash and has no label; an id with
    several labels is good only if all say so; repeated rows repeat; without labels of both classes every score is the
    base rate (0.5 without labels); other columns are ignored; an empty table gives an empty result.
    """
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (id_crc(F.col(doc_id).cast("long")) % 5 == 0).alias("held_out"), F.col(text).cast("string").alias("text"))
    table = materialize(measured(picked), "features")
    own = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(id_crc(F.col("doc_id")) % 5 != 0)
    shared = docs.sparkSession.sparkContext.broadcast(train(table, own))

    def run(batches):
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))
            score = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype("int32"))], ["doc_id", "held_out", "score", "predicted"])

    return table.select("doc_id", "held_out", "features").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(documents(spark, sf_dir), labels(spark, sf_dir))
