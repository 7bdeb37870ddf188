import random

import numpy as np
import pytest

from corpusloom.llm import chunks, substring_dedup
from tests.llm.texts import awkward, empty


def brute(rows, n=13):
    words = [(r.doc_id, (r.text or "").encode().split()) for r in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - n + 1):
                k = tuple(w[i : i + n])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in words:
        off = [False] * len(w)
        if d is not None:
            for i in range(len(w) - n + 1):
                if first[tuple(w[i : i + n])] < d:
                    off[i : i + n] = [True] * n
        out.append((d, len(w), sum(off), b" ".join(x for x, o in zip(w, off) if not o)))
    return sorted(out, key=str)


def check(docs):
    got = substring_dedup.remove_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got), key=str) == brute(docs.collect())
    for r in got:
        assert sum(b - a for a, b in zip(r.edges[::2], r.edges[1::2])) == r.n_removed
    return sum(r.n_removed for r in got)


def test_awkward(spark):
    assert check(awkward(spark)) > 0
    assert substring_dedup.remove_repeats(empty(spark)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_at_all_offsets(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(10, 40))] for _ in range(12)]
    rows = []
    for i in range(120):
        text = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            text += p[a : a + rng.randint(11, 40)] + [rng.choice(vocab) for _ in range(rng.randint(0, 9))]
        rows.append((i * 3, " ".join(text)))
    rng.shuffle(rows)
    assert check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) > 100


def test_many_chunks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    assert check(docs) > 0


def test_unlike_words_of_one_hash(spark):
    """The Thue-Morse sequence and its complement have one polynomial hash modulo 2 ** 64, whatever its base."""
    bits = [(i.bit_count() & 1) for i in range(2048)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, f"{same} {a}"), (2, f"{same} {b}"), (3, f"x {same} {b} y"), (4, f"{same} {a} {same} {a} z"), (5, f"{b} {same} {a}")]
    h = substring_dedup.words(np.frombuffer(f"{a} {b}".encode(), np.uint8))[2]
    assert h[0] == h[1]
    assert check(spark.createDataFrame(rows[:2], "doc_id long, text string").repartition(2)) == 0
    assert check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) > 0
    assert check(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)) > 0


@pytest.mark.parametrize("chunk,group", [(300, 600), (2000, 2000), (500, 1 << 20)])
def test_chains_through_chunks_and_groups(spark, monkeypatch, chunk, group):
    """A passage in most documents, so that chains run through many chunks of many groups."""
    monkeypatch.setattr(substring_dedup, "pack", lambda *x: chunks.pack(*x, chunk, group))
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = text(30)
    rows = [(i % 90, rng.choice([" ", "\n", "  "]).join(text(rng.randint(0, 20)) + passage[rng.randint(0, 9) :] + text(rng.randint(0, 15)))) for i in range(120)]
    assert check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) > 500


def test_words_in_pieces(monkeypatch):
    text = ("a bb  ccc\n" * 50 + "x" * 300 + " y " + "zé " * 70).encode()
    data = np.frombuffer(text, np.uint8)
    whole = substring_dedup.words(data)
    monkeypatch.setattr(substring_dedup, "_PIECE", 32)
    for a, b in zip(whole, substring_dedup.words(data)):
        assert (a == b).all()
    assert [text[s:e] for s, e in zip(*whole[:2])] == text.split()
    assert len(set(whole[2].tolist())) == len(set(text.split()))


def test_squeeze_round_trip():
    arrays = [np.array([3, 1 << 63, 5], np.uint64), np.array([-1, 7], np.int64), np.zeros(0, np.uint8), np.array([1], np.uint8)]
    for a, b in zip(arrays, chunks.unsqueezed(chunks.squeezed(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()
