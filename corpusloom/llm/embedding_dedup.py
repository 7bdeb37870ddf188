"""Embedding near-deduplication by an epsilon grid order join.

Unit vectors with a cosine of at least c lie within eps = sqrt(2 - 2 c). The vectors of a label are projected on
leading principal dimensions, their grid cells of width eps give the epsilon grid order, and the order is cut into
blocks. Intervals of the order are joined recursively: a label's whole order with itself, then each pair of intervals
by their parts, FAN each, down to blocks; a pair whose bounds lie further apart than eps is dropped with all below it.
A block's vectors go to a pair only if they themselves are near enough to the other block's bounds. Within a pair of
blocks the two intervals are halved and joined in the same way, and what is left is compared by cosine in double
precision.

A pair of blocks sends no pairs of vectors: only each vector's number of links, and a spanning forest of the links.
Vectors are scaled by powers of two first, which no cosine depends on, so that neither very large nor very small ones
leave the range of double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import column, partitions, settled
from corpusloom.llm.graph import components, forest

MIN_COSINE, GRID_DIMS, BLOCK, LEAF = 0.98, 8, 512, 64
#: Parts of an interval, as a power of two.
FAN_BITS = 3
_SLACK = 1e-9


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vectors can link with any keep them, scaled by a power of two to a largest component of 1 to 2."""
    for batch in batches:
        vectors = column(batch, "embedding")
        lengths = np.asarray(vectors.value_lengths().fill_null(0)).astype(np.int64)
        flat = vectors.flatten()
        bad = np.asarray(flat.is_null())
        x = np.asarray(flat.fill_null(0.0), np.float64)
        bad |= ~np.isfinite(x)
        x = np.where(bad, 0.0, x)
        full = np.flatnonzero(lengths)
        starts = (np.cumsum(lengths) - lengths)[full]
        most, fit = np.zeros(len(lengths)), np.zeros(len(lengths), bool)
        if len(full):
            most[full] = np.maximum.reduceat(np.abs(x), starts)
            fit[full] = ~np.logical_or.reduceat(bad, starts) & (most[full] > 0)
        fit &= ~np.asarray(column(batch, "label").is_null())
        scale = np.ldexp(1.0, np.frexp(np.where(most > 0, most, 1.0))[1] - 1)
        # Minus zero and zero are one number.
        x = x / np.repeat(scale, lengths) + 0.0
        keep = np.repeat(fit, lengths)
        ends = np.concatenate([[0], np.cumsum(np.where(fit, lengths, 0))])
        scaled = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x[keep]))
        yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), column(batch, "label"), column(batch, "uid"), pa.array(fit), scaled], ["vec_id", "label", "uid", "fit", "embedding"])


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _axes(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal directions of rows' unit vectors, from sums over all those of the commonest length.

    Vectors of other lengths never link with these; their grid is coarser, not wrong.
    """
    size = F.size("embedding").alias("size")
    commonest = rows.groupBy(size).count().orderBy(F.desc("count"), "size").first()
    if commonest is None:
        return np.zeros(0), np.zeros((0, 0))
    d = commonest["size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1))
        for batch in batches:
            u = _units(_matrix(column(batch, "embedding")))
            x = np.concatenate([np.ones((len(u), 1)), u], axis=1)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

    got = rows.filter(F.size("embedding") == d).select("embedding").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    m = got.sort_values("i")["v"].to_numpy().reshape(d + 1, d + 1)
    mean = m[0, 1:] / m[0, 0]
    values, vectors = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
    return mean, vectors[:, ::-1][:, :dims]


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.array(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1)


def near(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of rows with cosine at least least. A matrix product finds the pairs, sums decide close ones."""
    u, v = (x / np.sqrt((x * x).sum(axis=1))[:, None] for x in (a, b))
    i, j = np.nonzero(u @ v.T >= least - _SLACK)
    if len(i):
        x, y = a[i], b[j]
        cosine = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
        i, j = i[cosine >= least], j[cosine >= least]
    return i, j


def ego_pairs(a: np.ndarray, ga: np.ndarray, b: np.ndarray | None, gb: np.ndarray | None, least: float, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked places in two intervals of the order, or within one (b None: pairs i < j). ga, gb: projections."""
    eps = np.sqrt(2 - 2 * least) + _SLACK
    same = b is None
    b, gb = (a, ga) if same else (b, gb)
    stack = [(0, len(a), 0, len(b))]
    while stack:
        s, e, t, f = stack.pop()
        if s >= e or t >= f:
            continue
        if not (same and (s, e) == (t, f)):
            gap = np.maximum(ga[s:e].min(axis=0) - gb[t:f].max(axis=0), gb[t:f].min(axis=0) - ga[s:e].max(axis=0))
            if (np.maximum(gap, 0) ** 2).sum() > eps * eps:
                continue
        if e - s <= leaf and f - t <= leaf:
            i, j = near(a[s:e], b[t:f], least)
            i, j = i + s, j + t
            yield (i[i < j], j[i < j]) if same else (i, j)
            continue
        m, n = (s + e) // 2, (t + f) // 2
        if same and (s, e) == (t, f):
            stack += [(s, m, s, m), (m, e, m, e), (s, m, m, e)]
        elif e - s >= f - t:
            stack += [(s, m, t, f), (m, e, t, f)]
        else:
            stack += [(s, e, t, n), (s, e, n, f)]


def _joined(least: float):
    def out(sides: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
        """sides: 0 and 1 of a pair of blocks, or 2, a block with itself."""
        if 2 not in sides and len(sides) < 2:
            return None
        other = sides.get(1)
        ids, weight, x, g = sides[2] if 2 in sides else sides[0]
        if other is None:
            both, all_w, pairs = ids, weight, ego_pairs(x, g, None, None, least)
            shift = 0
        else:
            both, all_w = np.concatenate([ids, other[0]]), np.concatenate([weight, other[1]])
            pairs, shift = ego_pairs(x, g, other[2], other[3], least), len(ids)
        links, root = np.zeros(len(both), np.int64), np.arange(len(both))
        for i, j in pairs:
            if len(i):
                j = j + shift
                np.add.at(links, i, all_w[j])
                np.add.at(links, j, all_w[i])
                up = np.flatnonzero(root != np.arange(len(both)))
                root = forest(np.concatenate([up, root[i]]), np.concatenate([root[up], root[j]]), len(both))
        met = np.flatnonzero(links)
        if not len(met):
            return None
        return pa.RecordBatch.from_arrays([pa.array(both[met]), pa.array(links[met]), pa.array(both[root[met]])], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, parts = None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            if parts:
                rows = {side: tuple(np.concatenate(c) for c in zip(*p)) for side, p in parts.items()}
                rows = {side: tuple(c[np.lexsort(r[3].T[::-1])] for c in r) for side, r in rows.items()}
                if (batch := out(rows)) is not None:
                    yield batch

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(column(batch, c)) for c in ("p", "q", "side", "node", "times")]
            vectors, grids = column(batch, "embedding"), column(batch, "grid")
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                key = (int(cols[0][s]), int(cols[1][s]))
                if key != of:
                    yield from flush()
                    of, parts = key, {}
                parts.setdefault(int(cols[2][s]), []).append((cols[3][s:e], cols[4][s:e], _matrix(vectors.slice(s, e - s)), _matrix(grids.slice(s, e - s))))
        yield from flush()

    return run


def near_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = MIN_COSINE, dims: int = GRID_DIMS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of vectors.

    Two vectors link if their labels are equal and not null and their cosine in double precision is at least least.
    Vectors that are null, empty, zero or hold null or non-finite numbers, and vectors of unlike lengths, link with
    nothing: such a row is its own component. n_links counts the other rows linked directly, component_id is the
    smallest id reachable (null only if all ids reachable are null), kept tells that it is the row's own. Vectors of a
    label that are equal, or equal but for a power of two, are joined once, with their number. An empty table gives an
    empty result; other columns of vectors, whatever their names, are never read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    kind = rows.schema["label"].dataType.simpleString()
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    rows = settled(rows.mapInArrow(_prepared, f"vec_id long, label {kind}, uid long, fit boolean, embedding array<double>"))
    good = rows.filter("fit")
    distinct = settled(good.groupBy("label", "embedding").agg(F.min("uid").alias("node"), F.count("*").alias("times")))
    mean, axes = _axes(distinct, dims)
    eps, k = float(np.sqrt(2 - 2 * least)), axes.shape[1]
    if not k:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = column(batch, "embedding")
            own = np.asarray(x.value_lengths()) == len(mean)
            g = np.zeros((batch.num_rows, k))
            if own.any():
                g[own] = (_units(_matrix(x.filter(pa.array(own)))) - mean) @ axes
            grid = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * k + 1, k, dtype=np.int32)), pa.array(g.ravel()))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("label", "length", "node", "times", "embedding")), grid], ["label", "length", "node", "times", "embedding", "grid"])

    placed = distinct.select("label", F.size("embedding").alias("length"), "node", "times", "embedding")
    placed = placed.mapInArrow(project, f"label {kind}, length int, node long, times long, embedding array<double>, grid array<double>")
    cells = F.transform("grid", lambda x: F.floor(x / eps).cast("int"))
    n = partitions(distinct)
    # The epsilon grid order of each label, in range partitions; blocks are cut within these.
    order = ["label", "length", "cells", "node"]
    sorted_ = placed.withColumn("cells", cells).repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    nth = F.row_number().over(Window.partitionBy("part", "label", "length").orderBy("cells", "node"))
    blocked = settled(sorted_.withColumn("block", F.floor((nth - 1) / block)).drop("cells"))
    key = ["label", "length", "part", "block"]
    bounds = blocked.groupBy(*key).agg(*[F.min(F.col("grid")[i]).alias(f"low{i}") for i in range(k)], *[F.max(F.col("grid")[i]).alias(f"high{i}") for i in range(k)])
    bounds = settled(bounds.withColumn("b", F.monotonically_increasing_id()))
    pairs = _block_pairs(bounds, k, eps)
    members = blocked.join(bounds.select(*key, "b"), key).select("b", "node", "times", "embedding", "grid")
    side = lambda own, n, other: F.struct(F.col(own).alias("b"), F.lit(n).alias("side"), F.col(other).alias("reach"))
    sides = F.explode(F.when(F.col("p") == F.col("q"), F.array(side("p", 2, "qbox"))).otherwise(F.array(side("p", 0, "qbox"), side("q", 1, "pbox"))))
    wanted = pairs.select("p", "q", sides.alias("s")).select("p", "q", "s.*")
    apart = sum((F.pow(F.greatest(F.col("reach")[i] - F.col("grid")[i], F.col("grid")[i] - F.col("reach")[k + i], F.lit(0.0)), 2) for i in range(k)), F.lit(0.0))
    met = wanted.join(members, "b").filter((F.col("side") == 2) | (apart <= eps * eps + _SLACK)).select("p", "q", "side", "node", "times", "embedding", "grid")
    found = settled(met.repartition(n, "p", "q").sortWithinPartitions("p", "q", "side").mapInArrow(_joined(least), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = distinct.select("node", "times", "label", "embedding").join(links, "node", "left").join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    nodes = settled(nodes.select("label", "embedding", "node", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")))
    of_row = good.select("uid", "vec_id", "label", "embedding").join(nodes, ["label", "embedding"])
    of_row = settled(of_row.select("uid", "vec_id", "n_links", "root"))
    named = settled(of_row.groupBy("root").agg(F.min("vec_id").alias("component_id")))
    linked = of_row.join(named, "root").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _block_pairs(bounds: DataFrame, k: int, eps: float) -> DataFrame:
    """(p, q, pbox, qbox), settled: pairs of blocks of a label that may hold partners, each pair and each block with itself once.

    bounds (label, length, part, block, low0, ..., high0, ..., b). A node of the tree is a run of blocks of one part,
    and further up a run of parts. From the root down, pairs of nodes are replaced by pairs of their children.
    """
    own, edge = ["label", "length"], [f"low{i}" for i in range(k)] + [f"high{i}" for i in range(k)]
    top = bounds.agg(F.max("block").alias("block"), F.max("part").alias("part")).first()
    if top["block"] is None:
        return bounds.select(F.col("b").alias("p"), F.col("b").alias("q"), F.array(*edge).alias("pbox"), F.array(*edge).alias("qbox"))
    low = -(-int(top["block"]).bit_length() // FAN_BITS)
    high = -(-int(top["part"]).bit_length() // FAN_BITS)
    levels = [bounds.select(*own, "part", "block", *edge, "b")]
    up = [F.min(f"low{i}").alias(f"low{i}") for i in range(k)] + [F.max(f"high{i}").alias(f"high{i}") for i in range(k)]

    def parent(level: int) -> list:
        if level < low:
            return [F.col("part").alias("up"), F.shiftright("block", FAN_BITS).alias("up_block")]
        return [F.shiftright("part", FAN_BITS).alias("up"), F.lit(0).cast("long").alias("up_block")]

    for level in range(low + high):
        rows = levels[-1].select(*own, *parent(level), *edge).groupBy(*own, "up", "up_block").agg(*up)
        levels.append(settled(rows.withColumnsRenamed({"up": "part", "up_block": "block"})))
    pairs = levels[-1].select(*own, F.col("part").alias("pa"), F.col("block").alias("ba"), F.col("part").alias("pb"), F.col("block").alias("bb"))
    for level in reversed(range(low + high)):
        children = levels[level].select(*own, "part", "block", F.array(*edge).alias("box"), *parent(level), *(["b"] if not level else []))
        name = lambda x: children.withColumnsRenamed({"up": f"p{x}", "up_block": f"b{x}", "part": f"part{x}", "block": f"block{x}", "box": f"box{x}", "b": f"id{x}"})  # noqa: B023, E731
        met = pairs.join(name("a"), [*own, "pa", "ba"]).join(name("b"), [*own, "pb", "bb"])
        gap = [F.greatest(F.col("boxa")[i] - F.col("boxb")[k + i], F.col("boxb")[i] - F.col("boxa")[k + i], F.lit(0.0)) for i in range(k)]
        apart = sum((g * g for g in gap), F.lit(0.0))
        ordered = (F.col("parta") < F.col("partb")) | (F.col("parta") == F.col("partb")) & (F.col("blocka") <= F.col("blockb"))
        met = met.filter(ordered & (apart <= eps * eps + _SLACK))
        if not level:
            return settled(met.select(F.col("ida").alias("p"), F.col("idb").alias("q"), F.col("boxa").alias("pbox"), F.col("boxb").alias("qbox")))
        pairs = settled(met.select(*own, F.col("parta").alias("pa"), F.col("blocka").alias("ba"), F.col("partb").alias("pb"), F.col("blockb").alias("bb")))
    # One block in one part for each label: the root is the block.
    return bounds.select(F.col("b").alias("p"), F.col("b").alias("q"), F.array(*edge).alias("pbox"), F.array(*edge).alias("qbox"))
