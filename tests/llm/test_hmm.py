import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import hmm
from tests.llm.texts import awkward, empty


def brute_base(rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    words = lambda t: [*(t or "").encode().lower().split(), "END"]
    counts = Counter(w for r in rows if not held(r.doc_id) for w in words(r.text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for r in rows:
        t = words(r.text)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        out.append((r.doc_id, held(r.doc_id), len(t), sum(counts[w] > 0 for w in t), n, round(base, 6)))
    return sorted(out, key=str)


def key(r):
    return (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))


@pytest.mark.parametrize("sizes", [{}, {"table_words": 9, "symbol_words": 4}], ids=["table", "join"])
def test_base_matches_brute_force(spark, sizes):
    docs = awkward(spark)
    got = hmm.score(docs, **sizes).collect()
    assert sorted(map(key, got), key=str) == brute_base(docs.collect())
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_table_does_not_change_scores(spark):
    """Where a word's count comes from, the table or the join, makes no difference."""
    docs = awkward(spark)
    a, b = (sorted(r.score for r in hmm.score(docs, rounds=1, table_words=n, symbol_words=3).collect()) for n in (1000, 12))
    assert a == pytest.approx(b)


def toy(seed=0, k=3, n=5):
    rng = np.random.default_rng(seed)
    over = lambda x: x / x.sum(-1, keepdims=True)
    return hmm.Model(over(rng.random(k)), over(rng.random((k, k))), over(rng.random((k, n))).T)


def paths(model, seq, first):
    for states in itertools.product(range(len(first)), repeat=len(seq)):
        p = first[states[0]] * model.emit[seq[0], states[0]]
        for a, b, s in zip(states, states[1:], seq[1:]):
            p *= model.move[a, b] * model.emit[s, b]
        yield states, p


@pytest.mark.parametrize("span", [1, 2, 3, 100])
def test_forward_is_the_sum_over_paths(span):
    model, seqs = toy(), [[0, 3, 1, 4], [2], [4, 4], [1, 0, 2, 3, 3]]
    got = hmm.log_likelihood(model, np.concatenate(seqs), np.array(list(map(len, seqs))), span)
    assert got == pytest.approx([math.log10(sum(p for _, p in paths(model, s, model.first))) for s in seqs])


@pytest.mark.parametrize("span", [1, 2, 3, 100])
def test_expected_counts_are_sums_over_paths(span):
    model, seqs = toy(1), [[0, 3, 1], [2, 2, 4, 1, 0], [4], [1, 2]]
    got = hmm.expected(model, np.concatenate(seqs), np.array(list(map(len, seqs))), span, np.float64)
    want, log = [np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))], 0.0
    for seq in seqs:
        every = list(paths(model, seq, model.first))
        total = sum(p for _, p in every)
        log += math.log10(total)
        for states, p in every:
            want[0][states[0]] += p / total
            for a, b in zip(states, states[1:]):
                want[1][a, b] += p / total
            for s, x in zip(seq, states):
                want[2][s, x] += p / total
    for g, w in zip(got, [*want, log]):
        assert g == pytest.approx(w)


def test_single_precision_is_near(spark):
    rng = np.random.default_rng(5)
    model, lengths = toy(2, 8, 40), rng.integers(1, 700, 60)
    symbols = rng.integers(0, 40, lengths.sum())
    for span in (50, 5000):
        for a, b in zip(hmm.expected(model, symbols, lengths, span), hmm.expected(model, symbols, lengths, 900, np.float64)):
            assert a == pytest.approx(b, rel=1e-4, abs=1e-4)


def test_probabilities_add_up():
    """All texts of a small world, of words up to some length, have a probability of at most one."""
    table = hmm.Table([b"a", b"b"], np.array([5, 2]), np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES), 3, 10, 3, 2).ready()
    text = table.symbols(table.places([b"a", b"b"] * 3))
    model = hmm.updated(*hmm.expected(hmm.start(table), text, np.array([len(text)]))[:3], hmm._prior(table))
    assert model.emit.sum(axis=0) == pytest.approx(np.ones(hmm.STATES))
    total = 0
    for n in range(5):
        for text in itertools.product([b"a", b"b"], repeat=n):
            total += 10 ** hmm.log_likelihood(model, table.symbols(table.places(list(text))), np.array([n + 1]))[0]
    assert 0 < total <= 1


def test_better_than_base_on_held_out(spark):
    got = hmm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"] + 0.05 * got["sum(n_tokens)"]


def test_empty(spark):
    assert hmm.score(empty(spark)).collect() == []


def trained(table, seqs, rounds):
    """Baum-Welch over whole sequences, one at a time, by the recursions as they are written down."""
    model, prior, means = hmm.start(table), hmm._prior(table), []
    for _ in range(rounds):
        k, n = len(model.first), len(model.emit)
        first, move, emit, log = np.zeros(k), np.zeros((k, k)), np.zeros((n, k)), 0.0
        for x in seqs:
            alpha, scale = [], []
            for t, s in enumerate(x):
                a = (model.first if t == 0 else alpha[-1] @ model.move) * model.emit[s]
                scale.append(a.sum())
                alpha.append(a / a.sum())
            log += sum(map(math.log10, scale))
            beta = np.ones(k)
            for t in range(len(x) - 1, -1, -1):
                gamma = alpha[t] * beta
                emit[x[t]] += gamma
                if t == 0:
                    first += gamma
                else:
                    move += np.outer(alpha[t - 1], model.emit[x[t]] * beta / scale[t]) * model.move
                    beta = model.move @ (model.emit[x[t]] * beta / scale[t])
        means.append(log / sum(map(len, seqs)))
        over = lambda y: y / y.sum(-1, keepdims=True)
        emit = emit + prior[:, None]
        model = hmm.Model(over(first + 0.5), over(move + 0.5), emit / emit.sum(0))
    return model, means


def test_rounds_read_whole_training_texts(spark, monkeypatch):
    """The model is that of noise and rounds over all whole texts, also beyond any span of a long text."""
    monkeypatch.setattr(hmm, "SPAN", 64)
    monkeypatch.setattr(hmm, "_AT_ONCE", 500)
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdef"), n)) for n in (5, 300, 40)] + [" ".join(["a b"] * 900 + ["y z"] * 900), ""]
    training = spark.createDataFrame([(t.encode(), i) for i, t in enumerate(texts)], "body binary, order long").repartition(3)
    table, model, means = hmm.learn(training, hmm.word_counts(training), rounds=3, gain=-1)
    want, likelihood = trained(table, [table.symbols(table.places(hmm.tokens(t.encode()))) for t in texts], 3)
    for part in ("first", "move", "emit"):
        assert getattr(model, part) == pytest.approx(getattr(want, part), abs=1e-5)
    assert means == pytest.approx(likelihood, abs=1e-5) and means == sorted(means)


@pytest.mark.parametrize("sizes", [{}, {"table_words": 9, "symbol_words": 4}], ids=["symbols", "classes"])
def test_score_matches_brute_force(spark, sizes):
    """The whole of op6 by loops: words, classes, training, and each text's probability."""
    docs = awkward(spark)
    rows = docs.filter("length(text) < 3000 or text is null").collect()
    few = spark.createDataFrame(rows, docs.schema)
    got = sorted((str(r.doc_id), round(r.score, 2)) for r in hmm.score(few, rounds=4, gain=-1, **sizes).collect())
    words = lambda r: (r.text or "").encode().lower().split()
    learnt = [words(r) for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    counts = Counter(w for x in learnt for w in x)
    order = sorted(counts, key=lambda w: (-counts[w], w))
    table_words, own = sizes.get("table_words", hmm.TABLE_WORDS), sizes.get("symbol_words", hmm.SYMBOL_WORDS)
    if len(order) > table_words:  # those whose count is above a level, levels being sixteenths of a power of two
        level = lambda w: math.floor(math.log2(counts[w]) * 16)
        most = max(n for n in range(table_words + 1) if n == 0 or n == len(order) or level(order[n - 1]) > level(order[n]))
        own = min(own, most)
    own = order[:own]
    kind = lambda w: zlib.crc32(w[-3:]) % hmm.CLASSES
    share, size = Counter(), Counter()
    for w in order[len(own) :]:
        share[kind(w)] += counts[w]
        size[kind(w)] += 1
    number = {w: i for i, w in enumerate(own)}
    symbol = lambda w: number.get(w, len(own) + kind(w))
    table = hmm.Table(own, np.array([counts[w] for w in own]), np.array([share[c] for c in range(hmm.CLASSES)], float), np.array([size[c] for c in range(hmm.CLASSES)], float), len(learnt), 0, 0, len(own))
    end = len(own) + hmm.CLASSES
    model, _ = trained(table, [[*map(symbol, x), end] for x in learnt], 4)
    want = []
    for r in rows:
        alpha, log = None, 0.0
        for s in [*map(symbol, words(r)), end]:
            alpha = (model.first if alpha is None else alpha @ model.move) * model.emit[s]
            log += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        for w in words(r):
            if w not in number:
                log += math.log10(counts[w] + 0.5) - math.log10(share[kind(w)] + 0.5 * (size[kind(w)] + 1))
        want.append((str(r.doc_id), round(log, 2)))
    assert [g[0] for g in got] == [w[0] for w in sorted(want)]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in sorted(want)], abs=0.03)


def test_rounds_end_when_nothing_is_gained(spark):
    training = spark.createDataFrame([(b"a b " * 50,), (b"c d " * 50,)], "body binary")
    _, _, means = hmm.learn(training, hmm.word_counts(training), rounds=40, gain=0.002)
    assert 2 <= len(means) < 40 and means[-1] - means[-2] < 0.002
