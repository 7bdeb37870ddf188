import random

import numpy as np
import xxhash

from corpusloom.llm import graph, simhash
from tests.llm.texts import awkward, empty


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, bits=4):
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [least.get(find(i)) for i in range(len(rows))]


def check(docs):
    got = sorted(map(tuple, simhash.near_components(docs).collect()), key=str)
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    want = sorted(((d, f"{fp:016x}", c) for (d, fp), c in zip(rows, brute_components(rows))), key=str)
    assert got == want
    return got


def test_matches_brute_force_on_awkward_rows(spark):
    got = check(awkward(spark))
    assert len({c for _, _, c in got}) < len(got)


def test_empty(spark):
    assert simhash.near_components(empty(spark)).collect() == []


def test_near_dedup_keeps_columns_and_smallest(spark):
    docs = awkward(spark)
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids - {None} == {c for _, _, c in map(tuple, simhash.near_components(docs).collect())}


def test_links_with_blocks_match_brute_force(spark):
    """A cluster far larger than a block, so that blocks meet each other."""
    rng = random.Random(3)
    center = rng.getrandbits(64)
    fps = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    table = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    roots = {r.node: r.root for r in graph.components(simhash.near_links(table, 4, block=32)).collect()}
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    want = brute_components(list(zip(signed, fps)))
    groups = lambda names: sorted(sorted(s for s, n in zip(signed, names) if n == m) for m in set(names))
    assert groups([roots.get(s, s) for s in signed]) == groups(want)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_mask_choices_share_bits():
    for n in (10, 10**7, 10**9, 10**11):
        masks = simhash._bands(n, 4)
        rng = random.Random(n)
        for _ in range(200):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(diff & m == 0 for m in masks)


def test_near_dedup_judges_texts_of_a_repeated_id(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(str(rng.random()) for _ in range(60)) for _ in range(3))
    schema = "doc_id long, text string, id string, own string, sha string, n string, row string"
    more = ("x", "y", "z", "0", "r")
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in simhash.near_dedup(spark.createDataFrame([(i, t, *more) for i, t in rows], schema)).collect()), key=str)
    assert kept([(1, a), (5, a), (5, b), (6, c)]) == sorted([(1, a), (5, b), (6, c)])
    assert kept([(5, a), (5, a), (5, a), (6, None), (None, None)]) == [(5, a), (6, None)]
    assert kept([(None, a), (None, a), (None, b)]) == sorted([(None, a), (None, b)], key=str)


def test_a_third_of_all_rows_is_one_text(spark):
    rng = random.Random(2)
    text = lambda: " ".join(str(rng.randrange(999)) for _ in range(30))
    hot = text()
    rows = [(i, hot if i % 3 == 0 else text()) for i in range(300)] + [(-5, hot), (-5, hot)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(docs)
    kept = sorted(map(tuple, simhash.near_dedup(docs).collect()))
    assert kept == sorted([(-5, hot)] + [r for r in rows if r[1] != hot])
