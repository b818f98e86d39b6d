"""Language, toxicity, quality and the language model: held-out accuracy, contracts and odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kindred.llm import language_id, language_model, quality_classifier, toxicity
from tests.llm.conftest import make_docs


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def auc(score, label):
    score, label = np.array(score), np.array(label)
    good, bad = score[label == 1], score[label == 0]
    return np.mean([(g > bad).mean() + (g == bad).mean() / 2 for g in good])


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_language_accuracy(tables):
    docs, _ = tables
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    out = [r for r in language_id.language_id(docs).collect()]
    assert all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_language_odd_rows(odd, odd_rows, empty):
    out = {}
    for r in language_id.language_id(odd).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, out.values())) == len(odd_rows)
    for i in (1, 2, 3, 13):
        assert out[i][0]["lang_pred"] == "und" and out[i][0]["score"] == 0
    assert out[4][0]["lang_pred"] == out[4][1]["lang_pred"] != "und"
    assert language_id.language_id(empty).collect() == []
    assert language_id.keep_known_languages(empty).collect() == []


def test_language_unknown_without_labels(spark):
    docs = make_docs(spark, [(i, "some words here", None) for i in range(4)])
    assert {r["lang_pred"] for r in language_id.language_id(docs).collect()} == {"und"}
    assert language_id.keep_known_languages(docs).count() == 4


def test_more_languages_than_a_plane_has_bits(spark):
    """130 languages of words of their own, the rarest ones last: all are learned, and none of their documents is lost."""
    rng, rows = np.random.default_rng(0), []
    for k in range(130):
        words = ["".join(chr(0x4E00 + 100 * k + c) for c in rng.integers(0, 100, 5)) for _ in range(30)]
        rows += [(200 * k + i, " ".join(rng.choice(words, 20)), f"l{k:03}") for i in range(20 if k < 66 else 12)]
    docs = make_docs(spark, rows)
    truth = {i: lang for i, _, lang in rows}
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in language_id.language_id(docs).collect())
    assert language_id.keep_known_languages(docs).count() == len(rows)


def test_language_stage_keeps_clean(tables):
    docs, _ = tables
    kept = language_id.keep_known_languages(docs)
    assert kept.columns == docs.columns
    lost = docs.join(kept.select("doc_id"), "doc_id", "left_anti").select("text").collect()
    assert len(lost) < 0.05 * docs.count()
    assert all(sum(c.isalpha() for c in r["text"]) < 0.8 * len(r["text"]) or len(r["text"].split()) < 20 for r in lost)


def test_toxicity(spark):
    # 3,980 labels; the 399 of the next smaller tables hold out 17 toxic texts only.
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    out = toxicity.toxicity(docs, labels).collect()
    assert all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert auc([r["score"] for r in held], [truth[r["doc_id"]] for r in held]) > 0.95
    assert np.mean([truth[r["doc_id"]] for r in held if r["predicted"]]) > 0.95


def test_toxicity_odd_rows(odd, odd_rows, empty, no_labels):
    out = toxicity.toxicity(odd, no_labels).collect()
    assert len(out) == len(odd_rows) and all(r["predicted"] == 0 for r in out)
    assert toxicity.toxicity(empty, no_labels).collect() == []
    kept = toxicity.drop_toxic(odd, no_labels)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows)


def test_grammar_reads_clauses():
    lexicon = toxicity.Lexicon({"idiot": 3.0}, {})
    read = lambda t: dict(zip(toxicity.CHANNELS, toxicity.channels(lexicon.symbols(t), lexicon.machine())))
    assert read("What a fool idiot.")["plain"] > 0
    assert read("You are an idiot.")["aimed"] > 0
    assert read("He is not an idiot.")["negated"] > 0
    assert read("Someone said idiot.")["reported"] > 0
    assert read("I will kill you.")["threat"] == 3
    assert read("They kill.")["threat"] == 3
    assert read("I will kill. You went home.")["threat"] == 0
    assert read("I will not kill you.")["threat"] == 0
    assert read("Good morning to you.")["clauses"] == 0


def test_composition_is_one_machine_after_the_other():
    tape = [toxicity.Mark(k) for k in (toxicity.OTHER, toxicity.STOP, toxicity.NOT, toxicity.TARGET, toxicity.REPORT)]
    tape += [toxicity.Mark(toxicity.THREAT, k) for k in range(2)] + [toxicity.Mark(toxicity.INSULT, k) for k in range(3)]
    first = toxicity.negation(tape)
    second = toxicity.after(first.written(), toxicity.TARGET, "t")
    third = toxicity.insult(toxicity.threat(second.written()).written(), [1.0, 2.0, 4.0], [3.0, 5.0])
    machines = [first, second, toxicity.threat(second.written()), third]
    whole = machines[0]
    for m in machines[1:]:
        whole = toxicity.compose(whole, m)
    rng = np.random.default_rng(0)
    for _ in range(300):
        word = [tape[i] for i in rng.integers(0, len(tape), 12)]

        def through(machine, symbols):
            state, out, weight = machine.start, [], 0.0
            for x in symbols:
                state, y, w = machine.arcs[state, x]
                out.append(y)
                weight += w
            return out, weight

        step, total = word, 0.0
        for m in machines:
            step, w = through(m, step)
            total += w
        assert through(whole, word) == (step, total)


def naive_channels(lexicon, text):
    """The grammar straight from its description, clause by clause."""
    t = toxicity
    out, clause, clauses = dict.fromkeys(t.CHANNELS, 0.0), [], []
    for s in lexicon.symbols(text):
        if s == t.STOP:
            clauses.append(clause)
            clause = []
        else:
            clause.append(s)
    for clause in [*clauses, clause]:
        total, pending, target = 0.0, None, False
        for i, s in enumerate(clause):
            negated = any(x == t.NOT for x in clause[max(0, i - t.NEAR) : i])
            before = clause[:i]
            if s >= t.INSULT:
                kind = "negated" if negated else "reported" if t.REPORT in before else "aimed" if t.TARGET in before else "plain"
                out[kind] += lexicon.levels[s - t.INSULT]
                total += lexicon.levels[s - t.INSULT]
            elif s == t.TARGET:
                if pending is not None:
                    out["threat"] += lexicon.threat_levels[pending]
                    total += lexicon.threat_levels[pending]
                pending, target = None, True
            elif t.THREAT <= s < t.THREAT + t.THREATS and not negated:
                if target:
                    out["threat"] += lexicon.threat_levels[s - t.THREAT]
                    total += lexicon.threat_levels[s - t.THREAT]
                else:
                    pending = max(s - t.THREAT, -1 if pending is None else pending)
        out["strongest"] = max(out["strongest"], total)
        out["clauses"] += total > 0
    return out


def test_toxicity_against_a_naive_grammar(spark, sf_dir):
    """Every score of the smallest table from the learned lexicon and weights, without any machine."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in labels.collect() if crc(r["doc_id"]) % 3 != 1], "doc_id long, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), own)
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in toxicity.toxicity(docs, labels).collect():
        c = naive_channels(model.lexicon, text[r["doc_id"]])
        five = [c[k] for k in toxicity.CHANNELS[:5]]
        z = np.dot(model.weights, [1, math.log1p(sum(five[:4])), *map(math.log1p, five), math.log1p(c["strongest"]), math.log1p(c["clauses"])])
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)


def test_threats_and_targets_are_learned(spark):
    rng, rows = np.random.default_rng(0), []
    for i in range(120):
        fill = [f"f{x}" for x in rng.integers(0, 400, 12)]
        # "gronk" stands before you; "zonkers" before "blarg", which insults.
        bad = ["gronk", "you", f"g{i}", ".", "zonkers", "blarg", f"b{i}", "."] if i % 2 else []
        rows.append((i % 2, i // 2 % 2, " ".join(fill[:6] + bad + fill[6:])))
    lexicon = toxicity.learn_lexicons(spark.createDataFrame(rows, "toxic int, half int, text string"))[2]
    assert toxicity.THREAT <= lexicon.word("gronk") < toxicity.INSULT <= lexicon.word("blarg")
    assert lexicon.word("f1") == toxicity.OTHER


def test_quality(tables):
    docs, labels = tables
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = quality_classifier.quality_classifier(docs, labels).collect()
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert auc([r["score"] for r in held], [truth[r["doc_id"]] for r in held]) > 0.9


def test_quality_odd_rows(odd, odd_rows, empty, no_labels):
    out = quality_classifier.quality_classifier(odd, no_labels).collect()
    assert len(out) == len(odd_rows) and all(r["score"] == 0.5 for r in out)
    assert quality_classifier.quality_classifier(empty, no_labels).collect() == []


def test_quality_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_classifier.fit(x[:3000], y[:3000])
    assert auc(m.score(x[3000:]), y[3000:]) > 0.95


FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(rows):
    """The contract's base score, straight from its text."""
    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)), None]
    c = Counter(w for i, t, *_ in rows if crc(i) % 10 for w in tok(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t, *_ in rows:
        ws = tok(t)
        out.append((str(i), crc(i) % 10 == 0, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)))
    return out


@pytest.mark.parametrize("which", ["odd_rows", "small"])
@pytest.mark.parametrize("table", [language_model.TABLE, 20])
def test_language_model_base(spark, request, which, table):
    rows = request.getfixturevalue(which)
    out = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in language_model.lm_score(make_docs(spark, rows), table=table, classes=min(table, language_model.CLASSES)).collect())
    for a, b in zip(out, sorted(base(rows)), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-6)


def test_language_model_beats_base(tables):
    docs, _ = tables
    out = [r for r in language_model.lm_score(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)


def test_language_model_empty(empty):
    assert language_model.lm_score(empty).collect() == []


def test_forward_is_exact():
    """The scaled recursion equals the sum over all paths."""
    from itertools import product

    rng = np.random.default_rng(1)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    m = language_model.Markov(norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((3, 5))))
    for n in (1, 2, 5):
        s = rng.integers(0, 5, n)
        total = 0.0
        for path in product(range(3), repeat=n):
            p = m.start[path[0]] * m.emit[path[0], s[0]]
            for k in range(1, n):
                p *= m.move[path[k - 1], path[k]] * m.emit[path[k], s[k]]
            total += p
        assert m.log10([s.astype(np.uint16)])[0] == pytest.approx(math.log10(total))


def test_forward_probabilities_sum_to_one(spark, small):
    """Over all texts of one word the probability can't exceed 1."""
    rng = np.random.default_rng(2)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    m = language_model.Markov(norm(rng.random(4)), norm(rng.random((4, 4))), norm(rng.random((4, 6))))
    one = [np.array([i, j], np.uint16) for i in range(6) for j in range(6)]
    assert (10 ** m.log10(one)).sum() == pytest.approx(1)


def test_language_against_plain_sets(spark, sf_dir):
    """Rates, sets and coverages of the smallest table by counting strings; the Bloom filter's corrected popcounts come close to them."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text").collect()]

    def grams(text):
        letters = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        plain = f" {letters} " if letters else " "
        return [plain[i : i + n] for n in language_id.ORDERS for i in range(len(plain) - n + 1)]

    counts: dict = {}
    for i, lang, text in rows:
        if crc(i) % 4 != 2:
            counts.setdefault(lang, Counter()).update(grams(text))
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    most: dict = {}
    for r in rate.values():
        for g, x in r.items():
            most[g] = max(x, most.get(g, 0))
    known = {lang: {g for g, x in r.items() if x >= language_id.RATE and x >= language_id.SHARE * most[g]} for lang, r in rate.items()}
    out = {r["doc_id"]: r for r in language_id.language_id(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert len(out) == len(rows)
    for i, _, text in rows:
        gs = grams(text)
        cover = {lang: sum(g in own for g in gs) / max(1, len(gs)) for lang, own in known.items()}
        best, second = sorted(cover.values(), reverse=True)[:2]
        if any(c.isalpha() for c in text):
            assert out[i]["coverage"] == pytest.approx(best, abs=0.03)
            if best - second > 0.06:
                assert cover[out[i]["lang_pred"]] == best
                assert out[i]["score"] == pytest.approx(best / (best + second), abs=0.05)
        else:
            assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0)


def test_quality_against_plain_loops(spark, sf_dir, monkeypatch):
    """Features by loops over characters and words, and the learned tables looked up one by one."""
    from bisect import bisect_right

    made, real = [], quality_classifier.train
    monkeypatch.setattr(quality_classifier, "train", lambda *a: made.append(real(*a)) or made[-1])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 3 = 0")
    out = {r["doc_id"]: r["score"] for r in quality_classifier.quality_classifier(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")).collect()}
    (model,) = made
    assert model.pairs and len(out) > 300

    def plain(text):
        ws, size = text.split(), len(text.encode())
        if not ws:
            return [0.0] * len(quality_classifier.FEATURES)
        share = lambda chars: sum(c in chars for c in text) / size
        lines, triples = [x for x in text.split("\n") if x.strip()], [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        return [
            math.log(1 + len(ws)), sum(len(w) for w in ws) / len(ws), math.log(1 + max(len(w) for w in ws)), len(set(ws)) / len(ws), Counter(ws).most_common(1)[0][1] / len(ws),
            1 - len(set(triples)) / len(triples) if triples else 0.0, 1 - len(set(lines)) / len(lines), len(lines) / len(ws),
            share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share("#*$%&<>@^~=_{}[]\\/"), share("|"), share("!"), share(","), share("."),
            sum(len(w) <= 3 for w in ws) / len(ws), 1 - len(text) / size, sum(not w[-1].isalnum() and w[-1] not in ".,;:?" for w in ws) / len(ws),
        ]

    for r in docs.select("doc_id", "text").collect():
        x = plain(r["text"])
        assert x == pytest.approx(quality_classifier.features(r["text"]), abs=1e-12)
        z = model.base + sum(t[bisect_right(list(e), v)] for e, t, v in zip(model.edges, model.tables, quality_classifier.features(r["text"])))
        z += sum(t[bisect_right(list(model.coarse[i]), x[i])][bisect_right(list(model.coarse[j]), x[j])] for i, j, t in model.pairs)
        assert out[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-6)


def test_language_model_score_by_plain_recursion(spark, small, monkeypatch):
    """The score of whole texts from counted words, posteriors and the fitted model, one token and one state at a time."""
    fitted, real = [], language_model.baum_welch
    monkeypatch.setattr(language_model, "baum_welch", lambda *a: fitted.append((real(*a), a[2])) or fitted[-1][0])
    monkeypatch.setattr(language_model, "FINE", 1 << 30)
    rows, classes = small[:80], 30
    out = {r["doc_id"]: r["score"] for r in language_model.lm_score(make_docs(spark, rows), table=50, classes=classes).collect()}
    m, prior = fitted[-1]
    states = range(len(m.start))
    tok = lambda t: [*[w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))], b""]
    c = Counter(w for i, t, _ in rows if crc(i) % 10 for w in tok(t))
    own = {w: k for k, (w, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:classes])}
    assert c[list(own)[-1]] > sorted(c.values(), reverse=True)[60]  # the table of frequent words ends after the classes
    kind = lambda w: own[w] if w in own else classes + language_model.suffix_class(w)
    size, words = Counter(), Counter()
    for w, n in c.items():
        size[kind(w)] += n
        words[kind(w)] += 1
    # The last round: each word's expected counts by state, by the plain forward and backward recursions.
    counted = {}
    for i, t, _ in rows:
        if crc(i) % 10:
            ws = tok(t)
            e = [m.emit[:, kind(w)] for w in ws]
            alpha, beta = [m.start * e[0]], [np.ones(len(m.start))]
            for x in e[1:]:
                alpha.append((alpha[-1] / alpha[-1].sum()) @ m.move * x)
            for x in e[:0:-1]:
                b = m.move @ (x * beta[-1])
                beta.append(b / b.sum())
            for w, a, b in zip(ws, alpha, reversed(beta)):
                counted[w] = counted.get(w, 0) + a * b / (a * b).sum()
    top = set(sorted(c, key=lambda w: (-c[w], w))[:50]) & {w for w in c if c[w] > sorted(c.values(), reverse=True)[50]}
    for w in set(c) - top:
        shares = np.round(255 * counted[w] / counted[w].sum())
        if w not in own:
            counted[w] = c[w] * shares / shares.sum()
    totals = np.zeros((len(prior), len(m.start)))
    for w, n in counted.items():
        totals[kind(w)] += n
    by_class = totals + language_model.PRIOR * prior[:, None]
    by_class /= by_class.sum(axis=0)

    def emission(w):
        k = kind(w)
        if w in own:
            return by_class[k]
        d = size[k] + 0.1 * (words[k] + 1)
        if w not in c:
            return by_class[k] * 0.1 / d
        share, tied = (c[w] + 0.1) / d, language_model.TIED
        return np.array([p * ((1 - tied) * (1 - 0.1 / d) * n / t + tied * share if t else share) for p, n, t in zip(by_class[k], counted[w], totals[k])])

    for i, t, _ in rows:
        alpha, score = None, 0.0
        for w in tok(t):
            e = emission(w)
            alpha = [(m.start[b] if alpha is None else sum(alpha[a] * m.move[a][b] for a in states)) * e[b] for b in states]
            z = sum(alpha)
            score += math.log10(z)
            alpha = [a / z for a in alpha]
        assert out[i] == pytest.approx(score, rel=1e-6)


def _model(rng, states, classes):
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return language_model.Markov(norm(rng.random(states)), norm(rng.random((states, states))), norm(rng.random((states, classes))))


def test_baum_welch_counts_over_whole_sequences(monkeypatch):
    """Counts by all paths; the same however many tokens are smoothed at once."""
    from itertools import product

    rng = np.random.default_rng(3)
    m = _model(rng, 2, 4)
    sequences = [rng.integers(0, 4, n).astype(np.uint16) for n in (1, 9, 3, 5, 1)]
    starts, moves, emits = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 4))
    for s in sequences:
        paths = []
        for path in product(range(2), repeat=len(s)):
            p = m.start[path[0]] * m.emit[path[0], s[0]]
            for k in range(1, len(s)):
                p *= m.move[path[k - 1], path[k]] * m.emit[path[k], s[k]]
            paths.append((path, p))
        whole = sum(p for _, p in paths)
        for path, p in paths:
            starts[path[0]] += p / whole
            for k, x in enumerate(path):
                emits[x, s[k]] += p / whole
                if k:
                    moves[path[k - 1], x] += p / whole
    for tokens in (1 << 19, 7, 4, 1):
        monkeypatch.setattr(language_model, "TOKENS", tokens)
        for a, b in zip(m.expected(sequences), (starts, moves, emits)):
            assert a == pytest.approx(b)


def test_language_model_words_of_a_class_sum_to_one():
    """In every state the words of a class and the unseen word share the class's probability."""
    counts = [(b"xyz", 9), (b"ayz", 4), (b"byz", 2)]
    suffix = language_model.suffix_class(b"xyz")
    n, v = np.zeros(language_model.SUFFIXES), np.zeros(language_model.SUFFIXES)
    for w, c in counts[1:]:
        n[language_model.suffix_class(w)] += c
        v[language_model.suffix_class(w)] += 1
    words = language_model.Vocabulary(counts, 15, 3, n, v, 5, 1)
    size = 1 + language_model.SUFFIXES
    prior = (words.class_counts + 0.5) / (words.class_counts + 0.5).sum()
    rng = np.random.default_rng(4)
    by_word = rng.random((3, language_model.STATES)) * np.array([[9], [4], [2]])
    totals, top = np.zeros((size, language_model.STATES)), np.zeros((5, language_model.STATES))
    for k, (w, _) in enumerate(counts):
        top[k] = by_word[k]
        totals[words.code[k]] += by_word[k]
    e = language_model.Emissions(_model(rng, language_model.STATES, size), words, prior, totals, top)
    for code in {int(words.code[k]) for k in (1, 2)}:
        own = sum(e.top[k] for k in (1, 2) if words.code[k] == code)
        assert own + e.unseen(np.array([code]))[0] == pytest.approx(e.model.by_class[code])
    assert words.code[0] == 0 and e.top[0] == pytest.approx(e.model.by_class[0]) and suffix < language_model.SUFFIXES
