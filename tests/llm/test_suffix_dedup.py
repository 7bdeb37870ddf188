import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import Row

from corpusloom.llm import chunks
from corpusloom.llm import suffix_dedup as sd
from tests.llm.texts import awkward, empty


def brute(rows, n=100):
    texts = sorted(((r.doc_id is None, r.doc_id or 0, i, (r.text or "").encode()) for i, r in enumerate(rows)))
    seen, out = set(), []
    for null, d, _, t in texts:
        off = bytearray(len(t))
        for s in range(len(t) - n + 1):
            w = t[s : s + n]
            if w in seen:
                off[s : s + n] = b"\x01" * n
            seen.add(w)
        out.append((None if null else d, len(t), sum(off), bytes(b for b, o in zip(t, off) if not o)))
    return sorted(out, key=str)


def check(docs, same=True):
    got = sd.remove_repeats(docs).collect()
    mine, want = sorted(((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got), key=str), brute(docs.collect())
    # Of rows with the same id either may keep its bytes.
    assert mine == want if same else sorted((m[0] is None, m[0] or 0, m[1], m[2]) for m in mine) == sorted((m[0] is None, m[0] or 0, m[1], m[2]) for m in want)
    for r in got:
        assert sum(b - a for a, b in zip(r.edges[::2], r.edges[1::2])) == r.n_removed
    return sum(r.n_removed for r in got)


def test_awkward(spark):
    assert check(awkward(spark), same=False) > 0
    assert sd.remove_repeats(empty(spark)).collect() == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: "".join(word() for _ in range(n))
    passages = [text(rng.randint(15, 80)) for _ in range(8)]
    rows = []
    for i in range(150):
        t = text(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            if rng.random() < 0.5:  # a near copy
                k = rng.randrange(len(p))
                p = p[:k] + word() + p[k + 3 :]
            t += p[rng.randint(0, 20) :] + text(rng.randint(0, 8))
        rows.append((i * 2, t))
    rows += [(1000, "ab" * 300), (1001, "x" * 400), (1002, "ab" * 90 + "x" * 150), (1003, "x" * 99), (1004, "x" * 100)]
    rng.shuffle(rows)
    assert check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) > 1000


def test_frequent_passage(spark):
    """One passage in most documents, several in each chunk, with other text round it each time."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefg ") for _ in range(n))
    line = text(180)
    rows = [(i, text(rng.randint(0, 60)) + line[rng.randint(0, 40) :] + text(rng.randint(0, 60))) for i in range(200)]
    assert check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) > 1000


def in_process(texts, per_chunk=40, buckets=3):
    """The passes of remove_repeats without Spark; gives the number of bytes removed."""
    packed = []
    for at in range(0, len(texts), per_chunk):
        part = [t.encode() for t in texts[at : at + per_chunk]]
        lengths = np.array([len(t) for t in part], np.int64)
        head = chunks.squeezed(np.arange(at, at + len(part)), np.ones(len(part), np.uint8), lengths)
        packed.append((at, pa.scalar(struct.pack("<Q", len(head)) + head + zstandard.compress(b"\n".join([*part, b""])))))
    members = {g: packed[g : g + 4] for g in range(0, len(packed), 4)}

    def heard(batches):
        out = {g: {} for g in members}
        for batch in batches:
            for g, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                blocks = chunks.unsqueezed(data)
                out[g].setdefault(kind, []).append([np.cumsum(blocks[0], dtype=np.uint64), *blocks[1:]])
        return out

    def work(f, *answers):
        for g, own in members.items():
            yield from f(chunks.Group(g, own, {k: v for a in answers for k, v in a[g].items()}))

    def answer(f, batches):
        held = {}
        for batch in batches:
            for b, g, data in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(b, []).append((g, chunks.unsqueezed(data)))
        for parts in held.values():
            hashes = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for _, x in parts])
            senders = np.repeat([g for g, _ in parts], [len(x[0]) for _, x in parts])
            yield from f(hashes, senders, [np.concatenate(v) for v in zip(*(x[1:] for _, x in parts))])

    bits = 40
    anchors = heard(answer(sd._answer_repeats(sd.ANCHORS), work(sd._ask_anchors(bits, buckets))))
    frequent = heard(answer(sd._answer_repeats(sd.WINDOWS), work(sd._ask_frequent(bits, buckets), anchors)))
    older = heard(answer(sd._answer_contexts, work(sd._ask_contexts(bits, buckets), anchors, frequent)))
    return sum(sum(b.column("n_removed").to_pylist()) for b in work(sd._finish, older))


def removed(texts):
    return sum(r[2] for r in brute([Row(doc_id=i, text=t) for i, t in enumerate(texts)]))


def pages(n):
    """Pairs of equal pages, all with one header."""
    rng = random.Random(2)
    text = lambda k: "".join(rng.choice("abcdefg ") for _ in range(k))
    header = text(300)
    return [page for page in [header + text(300) for _ in range(n)] for _ in (0, 1)]


def test_only_the_index_removes(monkeypatch):
    """Whatever is equal, nothing goes unless matching statistics say so."""
    texts = pages(50)
    assert in_process(texts) == removed(texts) > 10_000
    monkeypatch.setattr(sd.RunIndex, "statistics", lambda self, patterns, starts, lengths: np.zeros(len(patterns), np.int64))
    assert in_process(texts) == 0


def test_what_meets_under_one_key_is_bounded(monkeypatch):
    """Whatever the number of pairs of pages with one header, no key has many contexts, and no index a large group."""
    most = {}
    for n in (300, 1500):
        groups, unlike = [0], [0]
        match, groups_of = sd.older_matches, sd._groups
        monkeypatch.setattr(sd, "HOT", 8)
        monkeypatch.setattr(sd, "WIDE", 16)
        monkeypatch.setattr(sd, "older_matches", lambda data, group, *x: groups.append(int(np.bincount(group).max())) or match(data, group, *x))  # noqa: B023
        monkeypatch.setattr(sd, "_groups", lambda c: (out := groups_of(c), unlike.append(int(out[3].max(initial=0))))[0])  # noqa: B023
        texts = pages(n)
        assert in_process(texts) == removed(texts)
        most[n] = max(groups), max(unlike)
        monkeypatch.undo()
    assert max(x for pair in most.values() for x in pair) <= 8 * 16, most


def test_many_unlike_contexts_are_cut(monkeypatch):
    """With nothing frequent, all contexts of the header's anchors meet, and are cut into windows."""
    texts = pages(120)
    monkeypatch.setattr(sd, "HOT", 1 << 30)
    monkeypatch.setattr(sd, "WIDE", 1 << 30)
    monkeypatch.setattr(sd, "MANY", 16)
    cut = []
    keep = sd._cut
    monkeypatch.setattr(sd, "_cut", lambda *x: cut.append(1) or keep(*x))
    assert in_process(texts) == removed(texts) and cut


def test_copies_lengthen_runs():
    code = lambda t, end: np.append(np.frombuffer(t.encode(), np.uint8).astype(np.int64), end)
    text = np.concatenate([code("abracadabra", 0), code("bracket", 1)])
    plain, copied = sd.RunIndex(text), sd.RunIndex(text, np.repeat([5, 2], [12, 8]))
    assert len(plain.start) == len(copied.start) and (plain.symbol == copied.symbol).all()
    assert plain.end[-1] == len(text) - 1 and copied.end[-1] == 5 * 12 + 2 * 8 - 1
    asked = code("abrackets", 5)[:-1]
    args = asked, np.array([0]), np.array([9])
    assert plain.statistics(*args).tolist() == copied.statistics(*args).tolist() == [5, 7, 6, 5, 4, 3, 2, 1, 0]


def test_driver_rows(spark):
    assert check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4)) > 0


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    rng = np.random.default_rng(seed)
    text = "".join(rng.choice(list("abc"), 300)) + "".join(["abcab"] * 20)
    patterns = ["".join(rng.choice(list("abcd"), rng.integers(1, 60))) for _ in range(20)] + [text[40:120], "cabcab" * 9]
    code = lambda t: np.frombuffer(t.encode(), np.uint8).astype(np.int64)
    index = sd.RunIndex(np.append(code(text), 0))
    lengths = np.array(list(map(len, patterns)))
    got = index.statistics(code("".join(patterns)), np.cumsum(lengths) - lengths, lengths)
    want = [max(n for n in range(len(p) - i + 1) if p[i : i + n] in text) for p in patterns for i in range(len(p))]
    assert got.tolist() == want


def test_anchors_depend_on_windows_alone(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 3000).astype(np.uint8)

    def each():
        runs = [np.concatenate(x) for x in list(zip(*sd.anchored(data)))[1:]]
        which = np.searchsorted(runs[0], np.arange(2901), "right") - 1
        return runs[1][which], runs[2][which]

    h, place = each()
    monkeypatch.setattr(sd, "_PIECE", 500)
    h2, place2 = each()
    assert (h == h2).all() and (place == place2).all()
    for s in (0, 17, 901, 2900):
        ((_, _, one, where),) = sd.anchored(data[s : s + 100].copy())
        assert one[0] == h[s] and where[0] + s == place[s]


def test_string_hashes():
    data = np.frombuffer(b"abcabcabcabdabcabcabcabd" * 3, np.uint8)
    for n in (1, 5, 24, 37):
        h = sd.strings(data, n)
        assert len(h) == len(data) - n + 1
        assert len(set(h.tolist())) == len({data[i : i + n].tobytes() for i in range(len(h))})
