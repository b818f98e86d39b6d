"""Toxicity: a weighted finite-state pattern grammar over clauses.

The lexicon turns a text's words into symbols: insults and threats (in LEVELS and THREATS steps of weight), targets, negations,
reporting verbs, clause ends, and blanks for everything else. Five small weighted transducers read that tape one after
the other: `negation` marks insults and threats up to NEAR words after a negation, `target` and `report` mark insults after a
target or a reporting verb of their clause, `threat` writes a threat where a threatening word and a target meet in a clause
(unless it is negated), and `insult` sends what is left to a channel (plain, aimed, negated, reported or threat) with its
weight. compose() makes one machine of them, whose states are tuples of theirs and whose weights are added along a path. What is
scored are the clauses that matched, not single words: a text's channels are sums over its clauses,
with the strongest clause and the number of matched clauses, and a logistic layer makes them a probability.

Insults, threats and targets and their weights are learned from labels, next to short public seed lists. The evidence of a word is
its number of distinct contexts (the word before and the word after) in toxic and in other texts, so thousands of
copies of a text count once. Stems are learned in the same way from the words that begin with them. A learned word is a
threat if a target follows it in most of its contexts, and a word is a target if an insult follows it in many of its contexts. Seeds keep their
weight only as long as the labels say nothing else. The logistic layer is fitted on channels that a lexicon learned from
the other half of the sample gives (cross-fitting), so that it doesn't trust the words that a text brought in itself.

Bounds: about SAMPLE labelled texts per class are learned from, chosen by a hash of the id, whole texts; the lexicon
holds the LEXICON entries with most evidence at most. Scoring is one narrow pass over all texts; nothing is shuffled but the sample.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import documents, filter_rows, id_crc, labels, materialize, prepare, scratch, sized, slices

SAMPLE, LEXICON, LEVELS, NEAR, CACHE = 4000, 20_000, 16, 3, 50_000
#: Least distinct contexts of a word (of a stem) in toxic texts, and least texts.
CONTEXTS, STEM_CONTEXTS, TEXTS, STEM_WORDS, STEM = 5, 10, 3, 3, (4, 7)
ODDS = 3.0
THRESHOLD = 0.7

#: Symbols; a threat of level k is THREAT + k, an insult INSULT + k. Learned words of which a target follows more than AIMED are threats.
OTHER, STOP, NOT, TARGET, REPORT, THREAT, INSULT = 0, 1, 2, 3, 4, 5, 16
THREATS, AIMED, BEFORE_INSULTS = 4, 0.6, 0.3

_LISTS = {
    NOT: "not no never neither nor isn't aren't wasn't don't doesn't didn't nicht kein keine niemals nie pas jamais aucun nunca jamás ningún",
    TARGET: "you your you're yours yourself they them he she him her these those people everyone du dich dir ihr euch sie tu toi vous ils elles tú usted ustedes vosotros ellos ellas",
    REPORT: "said says say told wrote writes claimed quoted reported allegedly called sagte schrieb behauptete meinte dit écrit affirme déclaré dijo dice escribió afirma",
    THREAT: "kill hurt beat destroy punch stab shoot burn hang töten umbringen schlagen tuer frapper brûler matar golpear quemar",
}
_SEED = "idiot idiots moron morons stupid scum trash worthless pathetic disgusting loser losers clown dumb filthy vermin imbecile"
SEED_WEIGHT = 3.0
_SEEDS = {"insult": _SEED.split(), "threat": _LISTS.pop(THREAT).split(), "target": _LISTS.pop(TARGET).split()}

_ENDS = re.compile(r"[.!?;:\n]")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'") + "¿¡«»“”„‘’…–—"
_INNER = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def words_of(text: str) -> list[str]:
    return _INNER.findall(text.lower())


class Lexicon:
    """What turns a chunk between blanks into symbols: weights of words and stems that insult, of words that threaten, and targets."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], threats: dict[str, float] | None = None, targets: list[str] | None = None):
        self.levels, self.threat_levels = np.linspace(0.5, 8.0, LEVELS), np.linspace(1.0, 7.0, THREATS)
        self.words = {w: s for s, ws in _LISTS.items() for w in ws.split()}
        self.words |= {w: TARGET for w in (_SEEDS["target"] if targets is None else targets)}
        self.words |= {w: self._symbol(x, self.threat_levels, THREAT) for w, x in (dict.fromkeys(_SEEDS["threat"], SEED_WEIGHT) if threats is None else threats).items()}
        self.words |= {w: self._symbol(x, self.levels, INSULT) for w, x in words.items()}
        self.stems = {w: self._symbol(x, self.levels, INSULT) for w, x in stems.items()}
        self.sizes = sorted({len(s) for s in stems})
        self.cache: dict[str, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    @staticmethod
    def _symbol(weight: float, levels: np.ndarray, first: int) -> int:
        return first + int(np.abs(levels - weight).argmin())

    def word(self, w: str) -> int:
        if w in self.words:
            return self.words[w]
        return next((self.stems[w[:n]] for n in self.sizes if w[:n] in self.stems), OTHER)

    def chunk(self, chunk: str) -> bytes:
        core = chunk.strip(_EDGES)
        found = [core] if core.isalpha() else _INNER.findall(core)
        out = bytes([self.word(w) for w in found])
        return out + bytes([STOP]) if _ENDS.search(chunk[len(chunk.rstrip(_EDGES)) :] or "") or not found else out

    def symbols(self, text: str) -> bytes:
        cache, out = self.cache, []
        for c in text.lower().replace("\n", " . ").split():
            s = cache.get(c)
            if s is None:
                s = self.chunk(c)
                if len(cache) >= CACHE:
                    cache.clear()
                if len(c) <= 60:
                    cache[c] = s
            out.append(s)
        return b"".join(out)

    def machine(self) -> Compiled:
        if not hasattr(self, "_machine"):
            self._machine = grammar(self.levels, self.threat_levels)
        return self._machine


class Mark(NamedTuple):
    """A symbol on a tape: its kind, its level, and what the machines before have marked it with."""

    kind: int
    level: int = 0
    marks: str = ""


class Transducer(NamedTuple):
    """Arcs (state, symbol) -> (state, what is written, weight); weights are added along a path."""

    start: object
    arcs: dict[tuple, tuple]

    @classmethod
    def of(cls, alphabet, start, step) -> Transducer:
        """The arcs that step(state, symbol) -> (state, written, weight) makes reachable from the start."""
        arcs, todo = {}, [start]
        while todo:
            state = todo.pop()
            if (state, alphabet[0]) in arcs:
                continue
            for symbol in alphabet:
                arcs[state, symbol] = step(state, symbol)
                todo.append(arcs[state, symbol][0])
        return cls(start, arcs)

    def written(self) -> list:
        return list(dict.fromkeys(w for _, w, _ in self.arcs.values()))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that does to a tape what `first` and then `second` do to it."""
    alphabet = list(dict.fromkeys(symbol for _, symbol in first.arcs))

    def step(states, symbol):
        a, written, w = first.arcs[states[0], symbol]
        b, result, v = second.arcs[states[1], written]
        return (a, b), result, w + v

    return Transducer.of(alphabet, (first.start, second.start), step)


def negation(alphabet) -> Transducer:
    """State: words since a negation, 0 if none is near."""

    def step(since, x):
        ahead = 0 if x.kind == STOP else 1 if x.kind == NOT else since + 1 if 0 < since < NEAR else 0
        return ahead, x._replace(marks=x.marks + "n") if since and x.kind in (THREAT, INSULT) else x, 0.0

    return Transducer.of(alphabet, 0, step)


def after(alphabet, kind: int, mark: str) -> Transducer:
    """Marks insults that come after a symbol of the kind in their clause."""

    def step(seen, x):
        ahead = 0 if x.kind == STOP else 1 if x.kind == kind else seen
        return ahead, x._replace(marks=x.marks + mark) if seen and x.kind == INSULT else x, 0.0

    return Transducer.of(alphabet, 0, step)


def threat(alphabet) -> Transducer:
    """State: level + 1 of a threat without a target, -1 once a target was seen, else 0. Writes a threat where the two meet; lone ones are blanks."""
    blank = Mark(OTHER)

    def step(state, x):
        if x.kind == STOP:
            return 0, x, 0.0
        if x.kind == TARGET:
            return -1, Mark(THREAT, state - 1) if state > 0 else x, 0.0
        if x.kind == THREAT and "n" not in x.marks:
            return (-1, Mark(THREAT, x.level), 0.0) if state < 0 else (max(state, x.level + 1), blank, 0.0)
        return state, blank if x.kind == THREAT else x, 0.0

    return Transducer.of(alphabet, 0, step)


def insult(alphabet, levels, threat_levels) -> Transducer:
    """One state; writes a channel's number, or nothing, with the weight of the insult or threat."""

    def step(state, x):
        if x.kind == THREAT:
            return 0, 4, float(threat_levels[x.level])
        if x.kind == INSULT:
            return 0, 2 if "n" in x.marks else 3 if "r" in x.marks else 1 if "t" in x.marks else 0, float(levels[x.level])
        return 0, None, 0.0

    return Transducer.of(alphabet, 0, step)


class Compiled(NamedTuple):
    """A machine as lists, at state * 32 + symbol."""

    ahead: list[int]
    channel: list[int]
    weight: list[float]


def grammar(levels, threat_levels) -> Compiled:
    """All five machines composed; what they read is the lexicon's symbols."""
    kinds = [Mark(k) for k in (OTHER, STOP, NOT, TARGET, REPORT)]
    tape = [*kinds, *[Mark(THREAT, k) for k in range(THREATS)], *[Mark(INSULT, k) for k in range(LEVELS)]]
    whole = negation(tape)
    for make in (lambda t: after(t, TARGET, "t"), lambda t: after(t, REPORT, "r"), threat, lambda t: insult(t, levels, threat_levels)):
        whole = compose(whole, make(whole.written()))
    number = {whole.start: 0}
    for state, _ in whole.arcs:
        number.setdefault(state, len(number))
    out = Compiled(*[[0] * (32 * len(number)) for _ in range(3)])
    for (state, x), (ahead, channel, weight) in whole.arcs.items():
        at = number[state] * 32 + x.kind + x.level
        out.ahead[at], out.channel[at], out.weight[at] = number[ahead], channel or 0, weight
    return out


#: Symbols that can make a clause match.
_MATTER = re.compile(b"[%s]" % re.escape(bytes([*range(THREAT, THREAT + THREATS), *range(INSULT, INSULT + LEVELS)])))
CHANNELS = ("plain", "aimed", "negated", "reported", "threat", "strongest", "clauses")


def channels(symbols: bytes, machine: Compiled) -> list[float]:
    """Sums over the clauses that match; clauses without an insult or a threat aren't read."""
    out = [0.0] * 7
    if not _MATTER.search(symbols):
        return out
    ahead, channel, weight = machine
    for clause in symbols.split(bytes([STOP])):
        if not _MATTER.search(clause):
            continue
        state, total = 0, 0.0
        for symbol in clause:
            at = state * 32 + symbol
            state = ahead[at]
            if w := weight[at]:
                out[channel[at]] += w
                total += w
        out[5] = max(out[5], total)
        out[6] += total > 0
    return out


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def features(self, texts: list[str]) -> np.ndarray:
        rows = [channels(self.lexicon.symbols(t), self.lexicon.machine()) for t in texts]
        return inputs(np.array(rows).reshape(-1, 7))

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def inputs(rows: np.ndarray) -> np.ndarray:
    total = rows[:, :4].sum(axis=1)
    return np.column_stack([np.ones(len(rows)), np.log1p(total), np.log1p(rows[:, :5]), np.log1p(rows[:, 5]), np.log1p(rows[:, 6])])


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the intercept isn't shrunk."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (w * (y - p)) - penalty * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_FOUND = "word string, context long, toxic int, half int, aimed int, body long"


def _occurrences(batches):
    """Words with their contexts; aimed: whether one of the next two words is a target."""
    targets = set(_SEEDS["target"])
    for b in batches:
        for s in slices(b, 2):
            for toxic, half, text in zip(*[s.column(i).to_pylist() for i in range(3)]):
                ws = words_of(text or "")
                near = [w in targets for w in [*ws, "", ""]]
                seen = {(w, _key(f"{a} {c}")): int(near[i + 1] or near[i + 2]) for i, (a, w, c) in enumerate(zip(["", *ws], ws, [*ws[1:], ""]))}
                if n := len(seen):
                    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
                    columns = ([w for w, _ in seen], [c for _, c in seen], [toxic] * n, [half] * n, list(seen.values()), [_key(text)] * n)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _FOUND.split(", ")])


def _before_insults(shared):
    """(word, context, hit) of toxic texts: whether an insult is one of the next two words. Insults themselves are left out."""

    def run(batches):
        word = shared.value.word
        for b in batches:
            for s in slices(b, 0):
                for text in s.column(0).to_pylist():
                    ws = words_of(text or "")
                    bad = [word(w) >= INSULT for w in ws] + [False] * 2
                    seen = {(w, _key(f"{a} {c}")): int(bad[i + 1] or bad[i + 2]) for i, (a, w, c) in enumerate(zip(["", *ws], ws, [*ws[1:], ""])) if not bad[i]}
                    if seen:
                        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.int64()), pa.array(list(seen.values()), pa.int32())], ["word", "context", "hit"])

    return run


def learn_lexicons(sample: DataFrame) -> list[Lexicon]:
    """From a table (toxic, half, text) of bounded size: the lexicons of half 0, of half 1, and of all."""
    found = sample.select(F.col("toxic").cast("int").alias("toxic"), F.col("half").cast("int").alias("half"), "text").mapInArrow(_occurrences, _FOUND)
    own = lambda h: F.min(F.when(F.col("half") == h, F.col("body"))).alias(f"body{h}")
    once = found.groupBy("word", "context", "toxic").agg(own(0), own(1), F.min("body").alias("body2"), F.max("aimed").alias("aimed"))
    bad = F.col("toxic") == 1
    sums = []
    for h in range(3):
        body = F.col(f"body{h}")
        sums += [F.count_if(bad & body.isNotNull()).alias(f"a{h}"), F.count_if(~bad & body.isNotNull()).alias(f"b{h}"), F.size(F.collect_set(F.when(bad, body))).alias(f"texts{h}")]  # SAMPLE bodies at most, about
        sums += [F.count_if(bad & body.isNotNull() & (F.col("aimed") == 1)).alias(f"aimed{h}")]
    counts = materialize(sized(once.groupBy("word").agg(*sums), 96 * SAMPLE), "words")  # of 3 * SAMPLE texts
    return [_lexicon(counts.select("word", *[F.col(f"{c}{h}").alias(c) for c in ("a", "b", "texts", "aimed")]), sample if h == 2 else None) for h in range(3)]


def _lexicon(counts: DataFrame, sample: DataFrame | None) -> Lexicon:
    n1, n0 = (float(x or 0) + 1 for x in counts.agg(F.sum("a"), F.sum("b")).first())
    odds = F.log((F.col("a") + 0.5) / n1) - F.log((F.col("b") + 0.5) / n0)
    spread = 1.64 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    words = counts.where((F.col("a") >= CONTEXTS) & (F.col("texts") >= TEXTS)).withColumn("odds", odds).where((F.col("odds") >= ODDS) & (odds - spread > 0.7))
    prefix = F.explode(F.transform(F.sequence(F.lit(STEM[0]), F.lit(STEM[1])), lambda n: F.substring("word", F.lit(1), n))).alias("stem")
    stems = counts.where(F.length("word") > STEM[0]).select(prefix, "a", "b", "texts").where(F.length("stem") >= STEM[0]).groupBy("stem")
    stems = stems.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count_if(F.col("a") > 0).alias("words"), F.max("texts").alias("texts"))
    stems = stems.where((F.col("a") >= STEM_CONTEXTS) & (F.col("words") >= STEM_WORDS) & (F.col("texts") >= 2)).withColumn("odds", odds).where((F.col("odds") >= ODDS + 1) & (F.col("a") >= 20 * F.col("b")))
    top = lambda df, k: df.orderBy(F.desc("a"), k).limit(LEXICON)
    insults, threats = {}, {}
    for r in top(words, "word").select("word", "odds", (F.col("aimed") > AIMED * F.col("a")).alias("threat")).collect():
        (threats if r["threat"] else insults)[r["word"]] = min(8.0, r["odds"])
    known = {r["word"] for r in counts.where(F.col("word").isin(_SEEDS["insult"] + _SEEDS["threat"]) & (F.col("a") + F.col("b") >= CONTEXTS)).select("word").collect()}
    seeds = lambda kind: {w: SEED_WEIGHT for w in _SEEDS[kind] if w not in known}
    targets = list(_SEEDS["target"])
    begun = {r["stem"]: min(8.0, r["odds"]) for r in top(stems, "stem").select("stem", "odds").collect()}
    first = Lexicon(seeds("insult") | insults, begun, seeds("threat") | threats, targets)
    if sample is None:
        return first
    shared = sample.sparkSession.sparkContext.broadcast(first)
    near = sample.where("toxic = 1").select("text").mapInArrow(_before_insults(shared), "word string, context long, hit int")
    near = near.groupBy("word", "context").agg(F.max("hit").alias("hit")).groupBy("word").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    near = near.where((F.col("hits") >= STEM_CONTEXTS) & (F.col("hits") > BEFORE_INSULTS * F.col("n")))
    targets += [r["word"] for r in near.orderBy(F.desc("hits"), "word").limit(LEXICON).select("word").collect() if first.word(r["word"]) == OTHER]
    return Lexicon(seeds("insult") | insults, begun, seeds("threat") | threats, targets)


def train(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from docs (doc_id, text) and labels (doc_id, toxic), all of which may be learned from."""
    prepare(docs.sparkSession)
    with scratch():
        known = labelled.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        known = materialize(known, "labels")
        sizes = {r["toxic"]: r["count"] for r in known.where("toxic IN (0, 1)").groupBy("toxic").count().collect()}
        rate = {k: min(1.0, sample * (1 if k else 2) / n) for k, n in sizes.items()}
        cut = F.when(F.col("toxic") == 1, int(rate.get(1, 0) * (1 << 20))).otherwise(int(rate.get(0, 0) * (1 << 20)))
        chosen = known.where((F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < cut) & F.col("toxic").isin(0, 1))
        half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
        texts = materialize(docs.join(F.broadcast(chosen), "doc_id").select("toxic", half, "text"), "sample")  # 3 * SAMPLE ids at most, about
        lexicons = learn_lexicons(texts)
        shared = docs.sparkSession.sparkContext.broadcast(lexicons)

        def run(batches):
            for b in batches:
                for s in slices(b, 2):
                    rows = []
                    for half, t in zip(s.column(1).to_pylist(), s.column(2).to_pylist()):
                        other = shared.value[1 - half]  # learned without this text
                        rows.append(channels(other.symbols(t or ""), other.machine()))
                    rows = np.array(rows).reshape(-1, 7)
                    yield pa.RecordBatch.from_arrays([s.column(0), *[pa.array(rows[:, i]) for i in range(7)]], ["toxic", *CHANNELS])

        rows = texts.select("toxic", "half", "text").mapInArrow(run, "toxic int, " + ", ".join(f"{c} double" for c in CHANNELS)).toPandas()
    y, lexicon = rows["toxic"].to_numpy(float), lexicons[2]
    if len(set(y)) < 2:  # nothing to learn from: the seeds alone
        return Model(lexicon, np.array([-4.0, 2.0, 0, 0, 0, 0, 1.0, 0.5, 0.5]))
    w = np.where(y == 1, 1 / max(rate.get(1, 1), 1e-9), 1 / max(rate.get(0, 1), 1e-9))
    return Model(lexicon, fit(inputs(rows[list(CHANNELS)].to_numpy(float)), y, w / w.mean()))


def toxicity(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Learns from labels of rows whose crc32(id) mod 3 is not 1. Defined cases: a null or empty text matches nothing
    and gets the lowest score; a null id counts as the empty text in the hash and has no label; an id with
    several labels is toxic if one of them says so; repeated rows repeat; without labels of both classes the seed list
    decides; other columns are ignored.
    """
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    own = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(id_crc(F.col("doc_id")) % 3 != 1)
    shared = docs.sparkSession.sparkContext.broadcast(train(picked, own))

    def run(batches):
        for b in batches:
            for s in slices(b, 2):
                score = shared.value.score([t or "" for t in s.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype("int32"))], ["doc_id", "held_out", "score", "predicted"])

    held = picked.select("doc_id", (id_crc(F.col("doc_id")) % 3 == 1).alias("held_out"), "text")
    return held.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted toxic.

    A null or empty text matches nothing and stays; rows that repeat are judged alike; without labels the seed lists decide.
    """
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    own = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(id_crc(F.col("doc_id")) % 3 != 1)
    shared = docs.sparkSession.sparkContext.broadcast(train(picked, own))
    return filter_rows(docs, text, lambda: lambda texts: shared.value.score(texts) < THRESHOLD)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))
