"""Language-model scoring with a hidden Markov model.

Latent states emit word classes, and a class emits its words, each state with shares of its own. The CLASSES most frequent
words are classes of their own, all other words share SUFFIXES classes by a hash of their last three bytes. The states are set
apart by the words that stand around each class in all training rows. Baum-Welch counts (starts, transitions, emissions) are
summed over all partitions of the training rows in each round, over whole sequences; a last round counts the emissions of
every single word, a table that grows with the vocabulary. A text's score is its exact log10 probability: the scaled
forward recursion over its words.

Scale: the corpus is tokenised twice, to count words and to write each document's classes and word numbers. Counts are
summed per task before the shuffle. The TABLE most frequent words are looked up in the task; all others, whose counts are
as many as the corpus has words, are joined as (row, word) pairs. What a round over classes sends is a bounded number
of sums per task, added up by an aggregation.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import documents, id_crc, materialize, prepare, slices, trimmed

STATES, CLASSES, SUFFIXES, TABLE = 8, 4096, 2048, 100_000
#: Rounds over classes; one over words follows.
ROUNDS, PRIOR = 1, 200.0
#: Sequences and tokens that are smoothed at once; a longer sequence in windows of so many tokens.
WIDTH, TOKENS = 4096, 1 << 18
#: Tokens that are sorted by the length of their sequences before, so that those smoothed at once have like lengths.
GATHER = 1 << 21
#: Words to each side that make a class's surroundings, and the numbers that stand for them.
AROUND, SKETCH = 8, 12
#: Weight of what all states have in common in a word's share of its class; steps to one in a text's counts by state.
TIED, FINE = 0.2, 256
END = b""
ADD = 0.1

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z only), then the end."""
    return [*text.translate(_FOLD).split(), END]


def _counts(batches):
    seen: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

    for b in batches:
        for s in slices(b, 0):
            for t in s.column(0).cast(pa.large_binary()).to_pylist():
                seen.update(tokens(t or b""))
            if len(seen) > 200_000:
                yield out()
                seen.clear()
    if seen:
        yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of a table with the column text; the end is the empty word."""
    prepare(texts.sparkSession)
    return materialize(texts.select("text").mapInArrow(trimmed(_counts), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")


def suffix_class(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-3:]) % SUFFIXES


class _Top(dict):
    """Frequent word -> its rank; any other word -> size of the table + its suffix class."""

    def __init__(self, ranks, table: int):
        super().__init__(ranks)
        self.table = table

    def __missing__(self, word):
        return self.table + suffix_class(word)

    def __reduce__(self):
        return _Top, (dict(self), self.table)


class Vocabulary:
    """Frequent words (`table` of them at most) with counts, and the totals of the classes that hold several words.

    The `classes` most frequent words are classes of their own.
    """

    def __init__(self, top: list[tuple[bytes, int]], n: int, v: int, suffix_n: np.ndarray, suffix_v: np.ndarray, table: int, classes: int):
        self.n, self.v, self.table, self.classes = n, v, table, classes
        self.ranks = _Top({w: i for i, (w, _) in enumerate(top)}, table)
        c = np.zeros(table + SUFFIXES)
        c[: len(top)] = [x for _, x in top]
        self.known = c > 0
        self.code = np.full(table + SUFFIXES, classes, np.uint16)
        self.code[table:] = classes + np.arange(SUFFIXES)
        for i, (w, _) in enumerate(top):
            self.code[i] = i if i < classes else classes + suffix_class(w)
        log_c = np.where(self.known, np.log10(c + ADD), 0.0)  # of rare words it comes from the join
        self.suffix_total = suffix_n + ADD * (suffix_v + 1)
        self.base = log_c - np.log10(n + ADD * (v + 1)) if n else log_c
        #: A word's share of its class, of those with several words.
        self.share = (c[:table] + ADD) / self.suffix_total[np.maximum(self.code[:table].astype(int) - classes, 0)]
        self.single = np.arange(table) < min(classes, len(top))
        self.class_counts = np.bincount(self.code, c, minlength=classes + SUFFIXES)
        self.class_counts[classes:] = suffix_n


def vocabulary(counts: DataFrame, table: int, classes: int) -> Vocabulary:
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # A few thousand steps of frequency; the table ends at a step, so no task sends more than what is in it.
    step = F.floor(F.log2("c") * 64).cast("int")
    cut, held = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        held += r["count"]
        if held > table:
            break
        cut = r["step"]
    found = [] if cut is None else counts.where(step >= cut).collect()
    top = sorted(((bytes(r["word"]), r["c"]) for r in found), key=lambda x: (-x[1], x[0]))

    def classed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([suffix_class(w) for w in b.column(0).to_pylist()], pa.int32()), b.column(1)], ["class", "c"])

    total_n, total_v = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    for r in counts.mapInArrow(trimmed(classed), "class int, c long").groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        total_n[r["class"]], total_v[r["class"]] = r["c"], r["v"]
    for w, c in top[:classes]:  # these are classes of their own
        total_n[suffix_class(w)] -= c
        total_v[suffix_class(w)] -= 1
    return Vocabulary(top, n, v, total_n, total_v, table, classes)


class Markov:
    """Start, transition and emission probabilities (states x classes)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit
        self.by_class = np.ascontiguousarray(emit.T)

    @staticmethod
    def _batches(sequences: list[np.ndarray]):
        """(sequences' places in the list, the concatenation, offsets in it, how many reach each step, borders of windows of steps)."""
        lengths = np.array([len(s) for s in sequences])
        flat, offset = np.concatenate(sequences), np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        batch = np.maximum(np.arange(len(order)) // WIDTH, (np.cumsum(lengths[order]) - 1) // TOKENS)
        for own in np.split(order, np.flatnonzero(np.diff(batch)) + 1) if len(order) else []:
            size = lengths[own]
            live = np.searchsorted(-size, -np.arange(size[0]), side="left")  # the first ones, as they are sorted
            edges = np.flatnonzero(np.diff((np.cumsum(live) - 1) // TOKENS)) + 1
            yield own, flat, offset[own], live, [0, *edges.tolist(), len(live)]

    def _forward(self, flat, off, live, a: int, b: int, before, emissions: np.ndarray):
        """Sequences, places, emissions, scaled forward vectors and scales of the steps a to b, after the vectors `before`."""
        sizes = live[a:b]
        ends, n = np.cumsum(sizes), int(sizes.sum())
        who = np.arange(n) - np.repeat(ends - sizes, sizes)
        at = off[who] + np.repeat(np.arange(a, b), sizes)
        here, alpha, scale, ones = emissions[flat[at]], np.empty((n, len(self.start))), np.empty((n, 1)), np.ones((len(self.start), 1))
        for t, m, end in zip(range(a, b), sizes.tolist(), ends.tolist()):
            x, z = alpha[end - m : end], scale[end - m : end]
            if t:
                np.matmul(before[:m], self.move, out=x)
            else:
                x[:] = self.start
            x *= here[end - m : end]
            np.matmul(x, ones, out=z)
            x /= z
            before = x
        return who, at, here, alpha, scale

    def posteriors(self, sequences: list[np.ndarray], starts: np.ndarray, moves: np.ndarray):
        """(places in the concatenated sequences, probabilities of the states there), each place once; adds to starts and moves.

        Forward and backward over whole sequences. Where one has more than TOKENS tokens, only the forward vectors at the
        borders of windows are kept, and a window's vectors are made again when the backward pass comes to it.
        """
        back = np.ascontiguousarray(self.move.T)
        for own, flat, off, live, edges in self._batches(sequences):
            enter = [None]
            for a, b in zip(edges[:-2], edges[1:-1]):
                enter.append(self._forward(flat, off, live, a, b, enter[-1], self.by_class)[3][-live[b - 1] :].copy())
            beta = np.ones((len(own), len(self.start)))
            for a, b, before in reversed(list(zip(edges, edges[1:], enter))):
                _, at, ahead, alpha, scale = self._forward(flat, off, live, a, b, before, self.by_class)
                ahead /= scale
                after, end = np.empty_like(alpha), len(at)
                for m in live[a:b][::-1].tolist():
                    after[end - m : end] = beta[:m]
                    x = ahead[end - m : end]
                    x *= beta[:m]
                    np.matmul(x, back, out=beta[:m])
                    end -= m
                if a:
                    moves += self.move * (before[: live[a]].T @ ahead[: live[a]])
                last = np.arange(live[a], len(at)) - np.repeat(live[a : b - 1], live[a + 1 : b])
                moves += self.move * (alpha[last].T @ ahead[live[a] :])
                alpha *= after
                alpha /= alpha @ np.ones((len(self.start), 1))
                if not a:
                    starts += alpha[: live[0]].sum(axis=0)
                yield at, alpha

    def expected(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts of whole sequences: starts, moves, emissions."""
        k, c = self.emit.shape
        starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, c))
        flat = np.concatenate(sequences)
        for at, gamma in self.posteriors(sequences, starts, moves):
            codes = flat[at]
            for s in range(k):
                emits[s] += np.bincount(codes, gamma[:, s], minlength=c)
        return starts, moves, emits

    def log10(self, sequences: list[np.ndarray], emissions: np.ndarray | None = None) -> np.ndarray:
        """Exact log10 probability of each whole sequence, by the scaled forward recursion.

        A sequence holds classes, or rows of `emissions` (probabilities by state) if given.
        """
        emissions, out = self.by_class if emissions is None else emissions, np.zeros(len(sequences))
        for own, flat, off, live, edges in self._batches(sequences):
            before = None
            for a, b in zip(edges, edges[1:]):
                who, _, _, alpha, scale = self._forward(flat, off, live, a, b, before, emissions)
                out[own] += np.bincount(who, np.log10(scale[:, 0]), minlength=len(own))
                before = alpha[-live[b - 1] :]
        return out


def maximise(starts, moves, emits, prior: np.ndarray) -> Markov:
    """Probabilities from counts; classes have PRIOR pseudo-counts spread by their share of all tokens."""
    emit = emits + PRIOR * prior
    return Markov((starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def _surroundings(shared, classes: int):
    """Sums, by class, of the sketches of the AROUND tokens to each side; whole numbers, so their order doesn't matter."""

    def run(batches):
        sketch = shared.value
        sums = np.zeros((classes, SKETCH))
        for batch in _gathered(batches):
            pad = np.full(AROUND, classes, np.int64)  # no token
            flat = np.concatenate([pad, *[x for (codes,) in batch for x in (codes, pad)]])
            step = TOKENS // 4
            for i in range(0, len(flat), step):
                low, high = max(0, i - AROUND), min(len(flat), i + step + AROUND)
                part = flat[low:high]
                whole = np.concatenate([np.zeros((1, SKETCH), np.int32), np.cumsum(sketch[part], axis=0, dtype=np.int32)])
                own = np.arange(i, min(len(flat), i + step)) - low
                own = own[part[own] < classes]
                around = whole[np.minimum(own + AROUND + 1, len(part))] - whole[np.maximum(own - AROUND, 0)] - sketch[part[own]]
                for j in range(SKETCH):
                    sums[:, j] += np.bincount(part[own], around[:, j], minlength=classes)
        cells = np.flatnonzero(sums.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(sums.ravel()[cells])], ["cell", "value"])

    return run


def _gathered(batches):
    """Lists of rows of arrays, of GATHER tokens or a row more, from batches with binary columns of 16-bit and then 32-bit numbers."""
    rows, held = [], 0
    for b in batches:
        columns = [[np.frombuffer(x, kind) for x in b.column(i).to_pylist()] for i, kind in zip(range(b.num_columns), (np.uint16, np.int32))]
        for row in zip(*columns):
            rows.append(row)
            held += len(row[0])
            if held >= GATHER:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def set_apart(sums: np.ndarray, counts: np.ndarray, prior: np.ndarray, states: int = STATES) -> Markov:
    """A first model: classes with like surroundings (k-means over directions) are likelier in the same state."""
    x = sums / np.maximum(counts, 1)[:, None]
    x = x - counts @ x / max(1.0, counts.sum())
    x /= np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-9)
    weight = np.where(counts >= 20, np.sqrt(counts), 0.0)
    heavy = np.argsort(-weight, kind="stable")[:300]
    centre = x[heavy[:1]]
    while len(centre) < states:
        centre = np.vstack([centre, x[heavy[(x[heavy] @ centre.T).max(axis=1).argmin()]]])
    for _ in range(30):
        near = (x @ centre.T).argmax(axis=1)
        for s in range(states):
            mean = weight[near == s] @ x[near == s]
            if (mean**2).sum() > 0:
                centre[s] = mean / np.sqrt((mean**2).sum())
    emit = np.array([np.where(near == s, prior, 0) for s in range(states)]) + 1e-12 * prior
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    return Markov(np.full(states, 1 / states), move, 0.7 * emit / emit.sum(axis=1, keepdims=True) + 0.3 * prior)


def _encode(shared):
    def run(batches):
        v = shared.value
        ranks, code, base, known = v.ranks, v.code, v.base, v.known
        for b in batches:
            for s in slices(b, 3):
                cols: list[list] = [[] for _ in range(7)]
                for t in s.column(3).cast(pa.large_binary()).to_pylist():
                    words = tokens(t or b"")
                    at = np.fromiter([ranks[w] for w in words], np.int64, len(words))
                    rare: dict[bytes, int] = {}
                    numbers = at.astype(np.int32)
                    unlisted = np.flatnonzero(at >= v.table)
                    numbers[unlisted] = [v.table + rare.setdefault(words[i], len(rare)) for i in unlisted]
                    times = np.bincount(numbers[unlisted] - v.table, minlength=len(rare)).tolist()
                    own = code[at]
                    for c, x in zip(cols, (len(words), int(known[at].sum()), float(base[at].sum()), own.tobytes(), numbers[own >= v.classes].tobytes(), list(rare), times)):
                        c.append(x)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), s.column(2), *[pa.array(c, k) for c, k in zip(cols, kinds)]], _ENCODED)

    return run


_ENCODED = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "codes", "numbers", "rare", "times"]


def _expected(shared):
    def run(batches):
        m, sums = shared.value, None
        for batch in _gathered(batches):
            made = m.expected([codes for (codes,) in batch])
            sums = made if sums is None else tuple(x + y for x, y in zip(sums, made))
        if sums is not None:
            flat = np.concatenate([x.ravel() for x in sums])
            cells = np.flatnonzero(flat > 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(flat[cells])], ["cell", "value"])

    return run


def baum_welch(codes: DataFrame, model: Markov, prior: np.ndarray) -> Markov:
    """One round over all rows of a table with the column codes."""
    k, c = model.emit.shape
    shared = codes.sparkSession.sparkContext.broadcast(model)
    sums = codes.select("codes").mapInArrow(trimmed(_expected(shared)), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    flat = np.zeros(k + k * k + k * c)  # a bounded number of cells, whatever the corpus
    flat[sums["cell"].to_numpy()] = sums["value"].to_numpy()
    shared.unpersist()
    return maximise(flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k :].reshape(k, c), prior)


_BY_STATE = [f"n{s}" for s in range(STATES)]


def _numbered(codes: np.ndarray, numbers: np.ndarray, classes: int) -> np.ndarray:
    """Each token's word number: its rank, or the size of the table + its place among its row's other words."""
    out = codes.astype(np.int64)
    out[codes >= classes] = numbers
    return out


def _by_word(shared, table: int, classes: int):
    """(word, rank, class, c, n0, ...): counts of words by state, in steps of 1 / FINE; a frequent word has its rank only."""
    fine = FINE

    def rows(words, rank, kind, c, n):
        q = np.rint(n.T * fine).astype(np.int64)
        columns = [words, pa.array(rank, pa.int32()), pa.array(kind, pa.int32()), c]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(x) for x in q]], ["word", "rank", "class", "c", *_BY_STATE])

    def run(batches):
        m = shared.value
        k = len(m.start)
        top, kinds = np.zeros((table, k)), np.zeros(table, np.int64)
        for b in batches:
            for s in slices(b, 0, 2 * GATHER, WIDTH):
                codes, numbers = ([np.frombuffer(x, t) for x in s.column(i).to_pylist()] for i, t in ((0, np.uint16), (1, np.int32)))
                rare = s.column(2)
                before = np.cumsum([0, *pc.list_value_length(rare).to_pylist()])
                flat = np.concatenate([np.where((n := _numbered(c, x, classes)) >= table, n + at, n) for c, x, at in zip(codes, numbers, before)])
                kind = np.zeros(table + before[-1], np.int64)
                kind[flat] = np.concatenate(codes)
                sums = np.zeros((len(kind), k))
                for at, gamma in m.posteriors(codes, np.zeros(k), np.zeros((k, k))):
                    for j in range(k):
                        sums[:, j] += np.bincount(flat[at], gamma[:, j], minlength=len(kind))
                top += sums[:table]
                kinds = np.maximum(kinds, kind[:table])
                if before[-1]:
                    yield rows(rare.flatten(), np.full(before[-1], -1), kind[table:], s.column(3).flatten().cast(pa.int64()), sums[table:])
        seen = np.flatnonzero(top.any(axis=1))
        if len(seen):
            yield rows(pa.nulls(len(seen), pa.binary()), seen, kinds[seen], pa.array(np.zeros(len(seen), np.int64)), top[seen])

    return run


def word_states(training: DataFrame, model: Markov, table: int, classes: int) -> DataFrame:
    """The last round: (word, rank, class, c, by_state, n0, ...) of all words of the training rows.

    Frequent words have counts n0, ...; of all others, by_state holds the share of each state, a byte each, in c occurrences.
    """
    shared = training.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(["word binary, rank int, class int, c long", *[f"{n} long" for n in _BY_STATE]])
    found = training.select("codes", "numbers", "rare", "times").mapInArrow(trimmed(_by_word(shared, table, classes)), schema)
    counted = found.groupBy("word", "rank", "class").agg(F.sum("c").alias("c"), *[F.sum(n).alias(n) for n in _BY_STATE])
    listed, whole = F.col("rank") >= 0, sum(F.col(n) for n in _BY_STATE)
    bytes_ = [F.shiftleft(F.round(F.col(n) * 255 / F.col("whole")).cast("long"), 8 * i) for i, n in enumerate(_BY_STATE)]
    packed = reduce(lambda x, y: x.bitwiseOR(y), bytes_)
    return materialize(
        counted.withColumn("whole", whole).select("word", "rank", "class", "c", F.when(~listed, packed).alias("by_state"), *[F.when(listed, F.col(n)).alias(n) for n in _BY_STATE]), "words"
    )


def _unpacked(c: np.ndarray, by_state: np.ndarray) -> np.ndarray:
    """Counts by state of words with c occurrences."""
    shares = np.ascontiguousarray(by_state, "<i8").view(np.uint8).reshape(-1, 8)[:, :STATES].astype(np.float64)
    return c[:, None] * shares / shares.sum(axis=1, keepdims=True)


class Emissions:
    """Start, transitions, and the probability of every word in each state; the model that scores."""

    def __init__(self, model: Markov, words: Vocabulary, prior: np.ndarray, totals: np.ndarray, top: np.ndarray):
        """totals: counts by class and state; top: counts of the frequent words by state."""
        self.table, self.classes = words.table, words.classes
        emit = totals + PRIOR * prior[:, None]
        self.model = Markov(model.start, model.move, (emit / emit.sum(axis=0)).T)
        self.totals, self.suffix_total = totals, words.suffix_total
        code = words.code[: words.table].astype(np.int64)
        self.top = self.model.by_class[code]
        shared = ~words.single
        self.top[shared] = self.within(code[shared], words.share[shared], top[shared])

    def within(self, code: np.ndarray, share: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probabilities of words of shared classes by state, from their share of the class and counts by state.

        A class keeps the share of an unseen word; the rest is divided by the state's own counts, but for TIED of it.
        """
        total, unseen = self.totals[code], (ADD / self.suffix_total[code - self.classes])[:, None]
        share = share[:, None]
        own = np.where(total > 0, (1 - TIED) * (1 - unseen) * n / np.where(total > 0, total, 1) + TIED * share, share)
        return self.model.by_class[code] * own

    def unseen(self, code: np.ndarray) -> np.ndarray:
        return self.model.by_class[code] * (ADD / self.suffix_total[code - self.classes])[:, None]

    def log10(self, codes: list[np.ndarray], numbers: list[np.ndarray], rare: list[int], found) -> np.ndarray:
        """Log10 probabilities of texts; rare: their numbers of words beyond the table; found: (text, place, c, counts by state) of those seen."""
        before = np.cumsum([0, *rare])
        flat = [np.where((n := _numbered(c, x, self.classes)) >= self.table, n + at, n) for c, x, at in zip(codes, numbers, before)]
        kind = np.zeros(self.table + before[-1], np.int64)
        kind[np.concatenate(flat)] = np.concatenate(codes)
        kind = kind[self.table :]
        extra = self.unseen(kind)
        text, place, c, n = found
        if len(text):
            at = before[text] + place
            extra[at] = self.within(kind[at], (c + ADD) / self.suffix_total[kind[at] - self.classes], n)
        return self.model.log10(flat, np.concatenate([self.top, extra]))


def _emissions(seen: DataFrame, model: Markov, words: Vocabulary, prior: np.ndarray) -> Emissions:
    """The model that scores, from the counts of the last round: sums by class, and the frequent words."""
    totals, top = np.zeros((len(prior), STATES)), np.zeros((words.table, STATES))
    shares = [F.shiftright("by_state", 8 * i).bitwiseAND(255) for i in range(STATES)]
    others = [F.sum(F.col("c") * x / sum(shares)).alias(n) for x, n in zip(shares, _BY_STATE)]
    for r in seen.where("rank < 0").groupBy("class").agg(*others).collect():
        totals[r["class"]] = [r[n] for n in _BY_STATE]
    found = seen.where("rank >= 0").select("rank", "class", *_BY_STATE).toPandas()  # `table` rows at most
    top[found["rank"].to_numpy(np.int64)] = found[_BY_STATE].to_numpy(np.float64) / FINE
    np.add.at(totals, found["class"].to_numpy(np.int64), found[_BY_STATE].to_numpy(np.float64) / FINE)
    return Emissions(model, words, prior, totals, top)


def _scored(encoded: DataFrame, rows: DataFrame, fitted, train_tokens: int) -> DataFrame:
    """Scores of encoded texts; rows: (row, log_c, more, found) of the words beyond the table that the training rows have."""
    told = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]

    def forward(batches):
        m = fitted.value
        for b in batches:
            for s in slices(b, 6, 2 * GATHER, WIDTH):
                codes, numbers = ([np.frombuffer(x, t) for x in s.column(i).to_pylist()] for i, t in ((6, np.uint16), (7, np.int32)))
                own = s.column(9)
                each = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
                place, c, by_state = (x.to_numpy(zero_copy_only=False) for x in own.flatten().flatten())
                found = np.repeat(np.arange(s.num_rows), each), place, c, _unpacked(c, by_state)
                value = m.log10(codes, numbers, s.column(8).to_pylist(), found)
                yield pa.RecordBatch.from_arrays([*[s.column(j) for j in range(6)], pa.array(value)], [*told, "score"])

    kept = encoded.select(*_ENCODED[:-2], F.size("rare").alias("rare"), F.expr("aggregate(times, 0L, (a, x) -> a + x)").alias("times"))
    more = F.coalesce("more", F.lit(0))
    joined = kept.join(rows, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + more).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("log_c", F.lit(0.0)) + (F.col("times") - more) * F.log10(F.lit(ADD))).alias("base_score"),
        "codes", "numbers", "rare", "found",
    )
    return joined.mapInArrow(trimmed(forward), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", table: int = TABLE, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from rows whose crc32(id) mod 10 is not 0. Defined cases: a null text is the empty text, which is one end; a
    null id counts as the empty text in the hash; repeated rows repeat (and are learned from as often as they come);
    without training rows every token has the probability of an unseen one in base_score, and the model's prior in
    score; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    key = F.col(doc_id).cast("long")
    picked = docs.select(F.monotonically_increasing_id().alias("row"), key.alias("doc_id"), (id_crc(key) % 10 == 0).alias("held_out"), F.col(text).cast("string").alias("text"))
    counts = word_counts(picked.where("NOT held_out"))
    words = vocabulary(counts, table, classes)
    shared = spark.sparkContext.broadcast(words)
    encoded = materialize(
        picked.mapInArrow(trimmed(_encode(shared)), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, codes binary, numbers binary, rare array<binary>, times array<int>"),
        "encoded",
    )
    training = encoded.where("NOT held_out")
    size = classes + SUFFIXES
    prior = (words.class_counts + 0.5) / (words.class_counts + 0.5).sum()
    sketch = spark.sparkContext.broadcast(np.vstack([np.random.default_rng(1).integers(0, 2, (size, SKETCH)) * 2 - 1, np.zeros((1, SKETCH))]).astype(np.int32))
    around = training.select("codes").mapInArrow(trimmed(_surroundings(sketch, size)), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    sums = np.zeros(size * SKETCH)
    sums[around["cell"].to_numpy(np.int64)] = around["value"].to_numpy()
    model = set_apart(sums.reshape(size, SKETCH), words.class_counts, prior)
    for _ in range(ROUNDS if words.n else 0):
        model = baum_welch(training, model, prior)
    seen = word_states(training, model, table, classes)
    fitted = spark.sparkContext.broadcast(_emissions(seen, model, words, prior))

    # Words beyond the table: each row gets the counts of those that the training rows have.
    pairs = encoded.where(F.size("rare") > 0).select("row", F.posexplode(F.arrays_zip("rare", "times")).alias("place", "x")).select("row", "place", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    # They are dealt by row before they are gathered: a task has few of a row's words, so gathering first would only cost.
    told = pairs.join(seen.where("rank < 0").select("word", "c", "by_state"), "word").select("row", "place", "times", "c", "by_state").repartition("row")
    rows = told.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + ADD)).alias("log_c"),
        F.sum("times").alias("more"),
        F.collect_list(F.struct("place", "c", "by_state")).alias("found"),
    )
    return _scored(encoded, rows, fitted, words.n)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(documents(spark, sf_dir))
