"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import settled


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) to (node, root): each node that has an edge, and the smallest node that it is linked with.

    Nothing but two numbers a round reaches the driver. A hub with very many neighbours is met by partial
    aggregation, whose result is settled, so that the joins are of plain shuffles, which adaptive execution splits.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    now, before = settled(edges.filter("a <> b").select(hi, lo).distinct()), None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        # Large star: a node's larger neighbours move to the smallest of its neighbourhood.
        least = settled(now.select(F.col("lo").alias("u"), "lo").unionByName(now.select(F.col("hi").alias("u"), "lo")).groupBy("u").agg(F.min("lo").alias("m")))
        big = settled(now.join(least, now["lo"] == least["u"]).select("hi", F.col("m").alias("lo")).distinct())
        # Small star: a node and its smaller neighbours move to the smallest of these.
        small = settled(big.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("m")))
        met = big.join(small, big["hi"] == small["v"])
        pairs = met.select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        now = settled(pairs.select("e.hi", "e.lo").filter("hi <> lo").distinct())
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def forest(a, b, n: int):
    """Task-side: links a[i]-b[i] between 0..n-1 to an array with the smallest member of each one's component."""
    import numpy as np

    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
