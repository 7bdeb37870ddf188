import itertools
import math
import zlib

import numpy as np
import pytest

from corpusloom.llm import gam, queries
from tests.llm.texts import awkward, empty

DATA = "/root/testdata/sf0.01"


def auc(y, s):
    rank = np.argsort(np.argsort(s)) + 1.0
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def brute_features(body):
    """The features one by one, from their names."""
    if not body:
        return [0.0] * len(gam.FEATURES)
    chars, words = list(body), body.split()
    lines = [x for x in body.split(b"\n") if x.strip()]
    part = lambda s: sum(c in s for c in chars)
    blanks, n, w, k = b" \t\r\x0b\x0c", len(chars), max(1, len(words)), max(1, len(lines))
    odd = b"#$%&*!|@^~=+<>"
    return [
        math.log1p(n), math.log1p(len(words)), (n - part(blanks) - part(b"\n")) / w, sum(65 <= c <= 90 for c in chars) / n, sum(48 <= c <= 57 for c in chars) / n, part(b"|") / n,
        part(b"#$%&*@^~_=+<>{}[]\\/`") / n, part(b"!?") / n, part(b".,;:'\"-()") / n, part(blanks) / n, part(b"\n") / n, sum(c >= 128 for c in chars) / n,
        len(set(words)) / w, 1 - len(set(lines)) / k, math.log1p(len(words) / k), sum(x[-1] in odd for x in words) / w, sum(x.isupper() for x in words) / w, sum(len(x) <= 3 for x in words) / w,
    ]


def worth(g, h):
    return g * g / (h + gam.RIDGE)


def brute_tree(g, h, depth=2):
    n = len(g)
    options = [(worth(sum(g[:i]), sum(h[:i])) + worth(sum(g[i:]), sum(h[i:])), -i) for i in range(1, n)] if depth else []
    if options and max(options)[0] > worth(sum(g), sum(h)) + 1e-9:
        i = -max(options)[1]
        return brute_tree(g[:i], h[:i], depth - 1) + brute_tree(g[i:], h[i:], depth - 1)
    return [sum(g) / (sum(h) + gam.RIDGE)] * n


def brute_quadrants(g, h):
    """g, h: by pair of bins; the best cut's gain and the step by pair of bins."""
    m, n = len(g), len(g[0])
    best = (-1.0, None)
    for a, b in itertools.product(range(1, m), range(1, n)):
        q = lambda c: [[sum(c[i][j] for i in rows for j in cols) for cols in (range(b), range(b, n))] for rows in (range(a), range(a, m))]  # noqa: B023, E731
        qg, qh = q(g), q(h)
        gain = sum(worth(qg[i][j], qh[i][j]) for i in (0, 1) for j in (0, 1))
        if gain > best[0] + 1e-12:
            best = (gain, [[qg[i >= a][j >= b] / (qh[i >= a][j >= b] + gam.RIDGE) for j in range(n)] for i in range(m)])
    return best


def brute_scores(x, y, asked):
    """A model fitted to x, y by loops, and its scores of asked."""
    width, rate = len(x[0]), (sum(y) + 0.5) / (len(y) + 1)
    base = math.log(rate / (1 - rate))
    f, out = [base] * len(y), [base] * len(asked)
    bins = lambda v, cuts: sum(c <= v for c in cuts)
    cuts_of = lambda k: [sorted(set(np.quantile([r[j] for r in x], [i / k for i in range(1, k)]))) for j in range(width)]
    sigma = lambda t: 1 / (1 + math.exp(-t))

    def slopes(cells, shape):
        g, h = [0.0] * shape, [0.0] * shape
        for c, t, v in zip(cells, f, y):
            p = sigma(t)
            g[c] += v - p
            h[c] += p * (1 - p)
        return g, h

    cuts = cuts_of(gam.BINS)
    at, to = ([[bins(r[j], cuts[j]) for r in rows] for j in range(width)] for rows in (x, asked))
    for _ in range(gam.ROUNDS):
        for j in range(width):
            if cuts[j]:
                step = [gam.RATE * s for s in brute_tree(*slopes(at[j], len(cuts[j]) + 1))]
                f = [t + step[c] for t, c in zip(f, at[j])]
                out = [t + step[c] for t, c in zip(out, to[j])]
    cuts = cuts_of(gam.PAIR_BINS)
    at, to = ([[bins(r[j], cuts[j]) for r in rows] for j in range(width)] for rows in (x, asked))

    def pair(i, j):
        n = len(cuts[j]) + 1
        flat = slopes([a * n + b for a, b in zip(at[i], at[j])], (len(cuts[i]) + 1) * n)
        return brute_quadrants(*([v[k : k + n] for k in range(0, len(v), n)] for v in flat))

    wide = [j for j in range(width) if cuts[j]]
    ranked = sorted(itertools.combinations(wide, 2), key=lambda ij: (-pair(*ij)[0], ij))[: gam.PAIRS]
    for _ in range(gam.PAIR_ROUNDS):
        for i, j in ranked:
            step = pair(i, j)[1]
            f = [t + gam.RATE * step[a][b] for t, a, b in zip(f, at[i], at[j])]
            out = [t + gam.RATE * step[a][b] for t, a, b in zip(out, to[i], to[j])]
    return [sigma(t) for t in out]


def test_query_matches_brute_force(spark):
    """All of op8 on the smallest tables: features, trees, pairs and scores by loops."""
    small = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet").collect() for t in ("documents", "labels"))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    label = {r.doc_id: r.quality for r in labels if r.quality is not None and not held(r.doc_id)}
    x = {r.doc_id: brute_features((r.text or "").encode()) for r in docs}
    known = [i for i in x if i in label]
    assert 20 < len(known) < gam.SAMPLE
    want = dict(zip(x, brute_scores([x[i] for i in known], [label[i] for i in known], list(x.values()))))
    got = queries.op8_quality_classifier(spark, small).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx(want, abs=1e-6)
    assert all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.3) for r in got)


def test_sample_is_bounded_and_ordered(spark):
    """Repeated ids don't widen the sample, and which rows it has does not depend on partitions."""
    docs = spark.createDataFrame([(i % 10, f"{'word ' * (i % 7 + 1)}{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(0, 1)], "doc_id long, quality int")
    fitted = []
    keep, gam.fit = gam.fit, lambda x, y: fitted.append((x, y)) or keep(x, y)
    try:
        gam.learn(docs, labels, sample=30)
        gam.learn(docs.repartition(7), labels, sample=30)
    finally:
        gam.fit = keep
    (x, y), (x2, y2) = fitted
    assert len(y) == 30 and (x == x2).all() and (y == y2).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = gam.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(got) > 50
    assert auc(got["quality"].to_numpy(), got["score"].to_numpy()) > 0.97
    assert (got["predicted"] == got["quality"]).mean() > 0.95


def test_fit_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.9
    assert (0, 1) in [p[:2] for p in model.pairs]


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(3, None, 0), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = gam.classify(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect())
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    kept = gam.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in got)


def test_no_labels_and_no_rows(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in gam.classify(docs, none).collect()} == {0.5}
    assert gam.classify(empty(spark), none).collect() == []
    one = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    assert min(r.score for r in gam.classify(docs, one).collect()) > 0.5


def test_reruns_agree(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    a, b = gam.learn(docs, labels), gam.learn(docs.repartition(5), labels)
    x = np.random.default_rng(1).random((50, len(gam.FEATURES)))
    assert a.scores(x) == pytest.approx(b.scores(x))
