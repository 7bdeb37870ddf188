import math

import numpy as np
import pytest

from corpusloom.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, node long, times long, uid long"


def brute(rows, least=0.98):
    def fit(r):
        v = r.embedding
        return r.label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    links = [0] * len(rows)
    vec = [np.array(r.embedding, float) if fit(r) else None for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = vec[i], vec[j]
            if a is None or b is None or rows[i].label != rows[j].label or len(a) != len(b):
                continue
            if a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)) >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    small = {}
    for i, r in enumerate(rows):
        if r.vec_id is not None:
            small[find(i)] = min(r.vec_id, small.get(find(i), r.vec_id))
    return sorted(((r.vec_id, links[i], small.get(find(i)), r.vec_id == small.get(find(i))) for i, r in enumerate(rows)), key=str)


def check(table, **options):
    got = sorted(map(tuple, ed.near_components(table, **options).collect()), key=str)
    want = brute(table.select("vec_id", "embedding", "label").collect())
    assert got == want
    return sum(r[1] for r in got)


def cloud(seed, n, d=16, spread=0.08, middle=9):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(middle, d))
    x = centers[rng.integers(0, middle, n)] + rng.normal(size=(n, d)) * spread * np.sqrt(rng.random((n, 1)) * 4)
    return [(i, list(map(float, v)), int(rng.integers(0, 3)), 1, 2, 3) for i, v in enumerate(x)]


def test_clusters(spark):
    assert check(spark.createDataFrame(cloud(1, 500), SCHEMA), block=32) > 1000


def test_odd_rows(spark):
    rows = cloud(2, 60, middle=3)
    v = rows[0][1]
    rows += [(100 + i, v, rows[0][2], None, None, None) for i in range(5)]
    rows += [(110, None, 1, 0, 0, 0), (111, [0.0] * 16, 1, 0, 0, 0), (112, [None] + v[1:], 1, 0, 0, 0), (113, v, None, 0, 0, 0), (114, [float("nan")] + v[1:], 1, 0, 0, 0), (115, [float("inf")] + v[1:], 1, 0, 0, 0)]
    rows += [(116, [], 1, 0, 0, 0), (117, [1.0, 2.0], 1, 0, 0, 0), (118, [2.0, 4.0], 1, 0, 0, 0), (119, [-0.0, 2.0], 2, 0, 0, 0), (120, [0.0, 2.0], 2, 0, 0, 0), (None, v, rows[0][2], 0, 0, 0), (3, rows[3][1], rows[3][2], 0, 0, 0)]
    assert check(spark.createDataFrame(rows, SCHEMA), block=16) > 10


def test_very_large_and_very_small(spark):
    """Cosines don't depend on length, however far it is from one."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 4))
    rows = [(100 * j + i, list(map(float, v * f)), 0, 1, 2, 3) for j, f in enumerate((1.0, 1e200, 1e-200, 3e-308, 2.0**1000)) for i, v in enumerate(base)]
    rows += [(1000, [1e200, 0.0, 0.0, 0.0], 1, 0, 0, 0), (1001, [1e200, 0.0, 0.0, 0.0], 1, 0, 0, 0), (1002, [5e-324, 0.0, 0.0, 0.0], 1, 0, 0, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node long, times long, uid long")
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.near_components(table).collect()}
    assert got[1000] == got[1001] == got[1002] == (2, 1000)
    assert all(got[100 * j + i] == (4, i) for j in range(5) for i in range(12))


@pytest.mark.parametrize("n,parts", [(40, 3), (700, 9)])
def test_block_pairs_are_all_that_can_hold_partners(spark, n, parts):
    rng = np.random.default_rng(n)
    low = rng.random((n, 3)) * 3
    high = low + rng.random((n, 3)) * 0.3
    place = {}
    rows = []
    for b in range(n):
        label, part = int(rng.integers(0, 3)), int(rng.integers(0, parts))
        place[label, part] = block = place.get((label, part), -1) + 1
        rows.append((label, 3, part, block, *low[b].tolist(), *high[b].tolist(), b))
    names = "label int, length int, part int, block long, " + ", ".join(f"{x}{i} double" for x in ("low", "high") for i in range(3)) + ", b long"
    got = sorted(tuple(sorted((r.p, r.q))) for r in ed._block_pairs(spark.createDataFrame(rows, names), 3, 0.2).collect())
    gap = lambda a, b: np.maximum(np.maximum(low[a] - high[b], low[b] - high[a]), 0)
    assert got == [(a, b) for a in range(n) for b in range(a, n) if rows[a][0] == rows[b][0] and (gap(a, b) ** 2).sum() <= 0.04 + 1e-9]


def test_driver_rows(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), block=64)


def test_empty(spark):
    assert ed.near_components(spark.createDataFrame([], SCHEMA)).collect() == []
    only = spark.createDataFrame([(1, None, 2, 0, 0, 0)], SCHEMA)
    assert [tuple(r) for r in ed.near_components(only).collect()] == [(1, 0, 1, True)]


@pytest.mark.parametrize("split", [0, 70])
def test_recursion_finds_all(split):
    x = np.array([r[1] for r in cloud(5, 200, d=6)])
    g = x / np.sqrt((x * x).sum(axis=1))[:, None]
    order = np.lexsort((g[:, 2], g[:, 1], g[:, 0]))
    x, g = x[order], g[order]
    if split:
        pairs = ed.ego_pairs(x[:split], g[:split], x[split:], g[split:], 0.98, leaf=8)
        got = sorted((i, j + split) for a, b in pairs for i, j in zip(a.tolist(), b.tolist()))
    else:
        got = sorted((i, j) for a, b in ed.ego_pairs(x, g, None, None, 0.98, leaf=8) for i, j in zip(a.tolist(), b.tolist()))
    c = g @ g.T
    want = [(i, j) for i in range(200) for j in range(i + 1, 200) if c[i, j] >= 0.98 and (not split or i < split <= j)]
    assert got == want


def test_a_third_of_all_rows_is_one_vector(spark):
    rows = cloud(7, 200, middle=30)
    rows += [(1000 + i, rows[0][1], rows[0][2], 0, 0, 0) for i in range(100)]
    assert check(spark.createDataFrame(rows, SCHEMA).repartition(6), block=32) >= 100 * 99
