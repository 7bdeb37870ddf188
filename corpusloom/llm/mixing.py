"""Mixing sources to target weights by the cube method of balanced sampling.

A source's target over its size is the number of times that each of its documents should be taken: a whole number of
times for sure, and once more with the fraction that is left. Which documents are taken once more is a balanced
sample: in the flight phase, the fractions of three documents at a time move along a direction that changes neither
the number of documents nor the number of words, until one of them reaches 0 or 1. Each chunk of a source flies on its own
and leaves two documents at most undecided; these fly on together, level by level, until one chunk a source is left.
The landing then decides a handful of documents by looking at all outcomes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import partitions, settled, whole_rows

WEIGHTS, MAX_TIMES, CHUNK = (5, 2, 1), 3, 512
#: Documents of a source that the landing decides together with what the flight has left, two at most.
LANDING = 12
_ROWS_AT_ONCE = 10_000
_EPS = 1e-9


def words(text_col: str = "text"):
    return F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_times: int = MAX_TIMES) -> DataFrame:
    """sizes (source, source_size) to (source, source_size, target).

    Sources in the order of code points, null last, weigh weights in turn. They share the sum of all sizes by weight;
    a target stops at max_times its source's size, and the excess goes to the others by weight.
    """
    # The range partitions of a sort, numbered within and offset by the counts before: a rank with no single task.
    placed = settled(sizes.orderBy(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()))
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    offsets, at = {}, 0
    for part in sorted(counts):
        offsets[part] = at
        at += counts[part]
    if not offsets:
        return placed.select("source", "source_size", F.lit(0.0).alias("target"))
    offset = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])[F.col("part")]
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1 + offset
    weight = F.array(*[F.lit(w) for w in weights])[(nth % len(weights)).cast("int")]
    ranked = settled(placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_times).alias("cap")))
    level = F.lit(0.0)
    total = ranked.agg(F.sum("source_size")).first()[0]
    if total:
        capped, most = None, None
        while True:
            if capped is None:
                full, weighed = 0, ranked.agg(F.sum("weight")).first()[0]
            else:
                full, weighed = ranked.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
            if not weighed or weighed == most:
                break
            most, level = weighed, F.lit((total - full) / weighed)
            capped = F.col("cap") <= F.col("weight") * level
    return ranked.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * level).alias("target"))


def fly(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Fractions p after the flight: all 0 or 1 but two at most; sums of p and of p * size stay. draw: numbers in 0..1."""
    p, pool = p.copy(), []
    for k in range(len(p)):
        if _EPS < p[k] < 1 - _EPS:
            pool.append(k)
        else:
            p[k] = round(p[k])
        while len(pool) == 3 or len(pool) == 2 and size[pool[0]] == size[pool[1]]:
            a, b = pool[0], pool[1]
            if len(pool) == 2 or size[a] == size[b]:
                way = [(a, 1.0), (b, -1.0)]
            else:
                c = pool[2]
                way = [(a, float(size[b] - size[c])), (b, float(size[c] - size[a])), (c, float(size[a] - size[b]))]
                way = [(i, u) for i, u in way if u]
            ahead = min((1 - p[i]) / u if u > 0 else p[i] / -u for i, u in way)
            back = min(p[i] / u if u > 0 else (1 - p[i]) / -u for i, u in way)
            step = ahead if draw[k] * (ahead + back) < back else -back
            for i, u in way:
                p[i] += step * u
            for i in pool:
                if p[i] <= _EPS or p[i] >= 1 - _EPS:
                    p[i] = round(p[i])
            pool = [i for i in pool if _EPS < p[i] < 1 - _EPS]
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The outcome for the few undecided whose words come nearest to what is due, with documents within one of what is due."""
    p, left = p.copy(), np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    if not len(left):
        return p
    taken = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(bool)
    count = np.abs(taken.sum(axis=1) - p[left].sum())
    off = np.abs(taken @ size[left] - (p[left] * size[left]).sum())
    off[count > 1] = np.inf
    p[left] = taken[np.lexsort((count, off))[0]]
    return p


def _flight(chunk: pd.DataFrame) -> pd.DataFrame:
    chunk = chunk.sort_values(["h", "doc_id", "size", "text_hash"], kind="stable").reset_index(drop=True)
    p, size = chunk["p"].to_numpy(float), chunk["size"].to_numpy(np.int64)
    draw = ((chunk["h"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) / 2.0**53
    if chunk["chunks"].iloc[0] > 1:
        return chunk.assign(p=fly(p, size, draw))
    # The source's last chunk: a few documents, from small to large, wait for the landing.
    order = np.argsort(size, kind="stable")
    wait = order[np.unique(np.linspace(0, len(order) - 1, LANDING).astype(int))]
    others = np.setdiff1d(np.arange(len(p)), wait)
    p[others] = fly(p[others], size[others], draw[others])
    return chunk.assign(p=land(p, size))


def _units(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, text_hash, rows, h), settled: rows with the same id, source and text are one unit."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"), _text_hash(text_col))
    units = own.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("rows"))
    return settled(units.withColumn("h", F.xxhash64("doc_id", "size", "text_hash")))


def _text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash")


def _dealt(units: DataFrame, weights: tuple[int, ...], max_times: int, chunk: int) -> DataFrame:
    """units with source_size, target and copies: how often the mix takes all rows of a unit together."""
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = settled(source_targets(sizes, weights, max_times)).withColumnRenamed("source", "of")
    times = F.when(F.col("source_size") > 0, F.col("rows") * F.col("target") / F.col("source_size")).otherwise(0.0)
    met = units.join(targets, units["source"].eqNullSafe(targets["of"])).drop("of").withColumn("times", times)
    met = met.withColumn("sure", F.floor(F.col("times") + _EPS)).withColumn("p", F.greatest(F.col("times") - F.col("sure"), F.lit(0.0)))
    met = settled(met.drop("times"))
    open_ = F.col("p").between(_EPS, 1 - _EPS)
    decided, rest = [met.filter(~open_)], met.filter(open_)
    kept = ["doc_id", "source", "size", "text_hash", "rows", "h", "source_size", "target", "sure", "p"]
    schema = "doc_id long, source string, size long, text_hash long, rows long, h long, source_size long, target double, sure long, p double, chunks long, chunk long"
    while True:
        counts = rest.groupBy(F.col("source").alias("of")).agg(F.ceil(F.count("*") / chunk).alias("chunks"))
        cut = rest.select(kept).join(counts, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        cut = cut.withColumn("chunk", F.pmod(F.xxhash64("h", F.lit(len(decided))), "chunks"))
        flown = settled(cut.groupBy("source", "chunk").applyInPandas(_flight, schema))
        decided.append(flown.filter(~open_).select(kept))
        rest = flown.filter(open_).select(kept)
        if rest.isEmpty():
            break
    all_ = reduce(DataFrame.unionByName, [d.select(kept) for d in decided])
    return all_.withColumn("copies", (F.col("sure") + F.round("p")).cast("long"))


def _share(nth):
    """Of a unit's copies those of its nth row, from 1: as even as whole numbers allow."""
    return F.floor(F.col("copies") / F.col("rows")) + (nth <= F.col("copies") % F.col("rows")).cast("long")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_times: int = MAX_TIMES, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): one row for each row of docs.

    size is the text's number of words (null: 0), copies how often the mix takes the row, taken its words in the mix.
    Null sources are one source, the last. A source without words has target 0 and no copies. Rows with the same id,
    source and text are dealt with as one, and share what the mix takes of them as evenly as whole numbers allow.
    Draws depend on ids, sizes and texts alone, so reruns agree. An empty table gives an empty result.
    """
    units = settled(_dealt(_units(docs, id_col, text_col, source_col), weights, max_times, chunk))
    once = units.filter("rows = 1")
    # A unit may have a third of all rows: its rows are made in blocks, dealt to all tasks.
    blocks = units.filter("rows > 1").withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"), F.lit(_ROWS_AT_ONCE).cast("long"))))
    blocks = blocks.repartition(partitions(docs), F.xxhash64("h", "first"))
    last = F.least("rows", F.col("first") + _ROWS_AT_ONCE - 1)
    more = blocks.withColumn("nth", F.explode(F.sequence("first", last))).withColumn("copies", _share(F.col("nth"))).select(units.columns)
    out = once.unionByName(more)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_times: int = MAX_TIMES, chunk: int = CHUNK) -> DataFrame:
    """The rows of the mix, with docs' own columns: each row as often as take() says.

    Which of the rows with the same id, source and text are taken once more, if their other columns differ, is open.
    """
    units = _dealt(_units(docs, id_col, text_col, source_col), weights, max_times, chunk)
    units = settled(units.filter("copies > 0").select("doc_id", "source", "text_hash", "copies", "rows"))
    rows = docs.select(whole_rows(docs), F.col(id_col).cast("long").alias("own_id"), F.col(source_col).cast("string").alias("own_source"), _text_hash(text_col).alias("own_hash"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & F.col("own_source").eqNullSafe(F.col("source")) & (F.col("own_hash") == F.col("text_hash"))
    met = rows.join(units, same)
    taken = met.filter("rows = 1").select("row", "copies")
    if not units.filter("rows > 1").isEmpty():
        # Rows of a unit are numbered in the partitions where the join has left them, from the sum of those before.
        part = settled(met.filter("rows > 1").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
        key = ["doc_id", "source", "text_hash"]
        counts = part.groupBy(*key, "part").agg(F.count("*").alias("size"))
        before = F.sum("size").over(Window.partitionBy(*key).orderBy("part")) - F.col("size")
        offsets = settled(counts.select(*[F.col(c).alias(f"of_{c}") for c in key], F.col("part").alias("of_part"), before.alias("before")))
        placed = part.withColumn("within", F.row_number().over(Window.partitionBy(*key, "part").orderBy("at")))
        placed = placed.join(offsets, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*key, "part")]))
        taken = taken.unionByName(placed.select("row", _share(F.col("within") + F.col("before")).alias("copies")).filter("copies > 0"))
    return taken.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select("row.*")
