import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import mixing
from tests.llm.texts import awkward, empty


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), list(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > most * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(docs, **options):
    got = mixing.take(docs, **options).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += size(r.text)
    want = brute_targets(dict(sizes))
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r.doc_id, r.source, size(r.text)) for r in docs.collect())
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s, total in taken.items():
        biggest = sorted((r.size for r in got if r.source == s), reverse=True)
        assert abs(total - want[s]) <= biggest[0]
    return got, want, taken


def test_targets_and_sizes(spark):
    check(awkward(spark))


def test_many_small_documents_come_near(spark):
    rows = [(i, " ".join("w" * (1 + i % 37)), f"s{i % 5 if i % 3 else 0}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, want, taken = check(docs, chunk=64)
    for s in want:
        assert abs(taken[s] - want[s]) <= 2
        n = sum(r.source == s for r in got)
        times = want[s] / next(r.source_size for r in got if r.source == s)
        assert abs(sum(r.copies for r in got if r.source == s) - n * times) < 3
    again = mixing.take(docs.repartition(9), chunk=64).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_flight_keeps_sums():
    rng = np.random.default_rng(4)
    p, s = rng.random(400), rng.integers(0, 50, 400)
    q = mixing.fly(p, s, rng.random(400))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * s).sum() == pytest.approx((p * s).sum())


def test_empty_and_wordless(spark):
    assert mixing.take(empty(spark)).collect() == []
    docs = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {tuple(r) for r in mixing.take(docs).collect()} == {(1, None, 0, 0, 0.0, 0, 0), (2, "a", 0, 0, 0.0, 0, 0)}


def rows_of_mix(out):
    return Counter((r.doc_id, r.source, size(r.text)) for r in out.collect())


def test_mixed_rows(spark):
    docs = awkward(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    due = Counter()
    for r in mixing.take(docs).collect():
        due[r.doc_id, r.source, r.size] += r.copies
    assert rows_of_mix(out) == Counter({k: n for k, n in due.items() if n})


def test_a_third_of_all_rows_is_one_row(spark):
    """Repeats of a row are one unit: they are never in one task, and share their copies evenly."""
    rows = [(1, "one two three", "a", "x")] * 700 + [(i, "w " * (i % 9), f"s{i % 3}", "x") for i in range(2, 1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row string").repartition(13)
    got, want, taken = check(docs)
    hot = [r.copies for r in got if r.doc_id == 1]
    assert len(hot) == 700 and max(hot) - min(hot) <= 1
    due = Counter()
    for r in got:
        due[r.doc_id, r.source, r.size] += r.copies
    out = mixing.mixed(docs)
    assert rows_of_mix(out) == Counter({k: n for k, n in due.items() if n})
    assert mixing._dealt(mixing._units(docs, "doc_id", "text", "source"), mixing.WEIGHTS, 3, mixing.CHUNK).filter("doc_id = 1").count() == 1
