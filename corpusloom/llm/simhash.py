"""SimHash near-deduplication by a binary trie self-join.

Fingerprints are 64 bits. Equal ones are merged first. The distinct ones are joined with themselves in binary tries:
node pairs are traversed together, each step to children of unlike bits costs one of the allowed errors, and a pair
beyond the budget is dropped with all below it.

To spread the traversal, the bits are cut into bands. Two fingerprints within k bits agree on all but k of the
bands, so every pair meets in a trie of fingerprints that share some choice of bands; the number of bands grows with
the number of fingerprints, so that tries stay small. A trie that stays large nevertheless (a cluster of near
copies) is cut into blocks, and the traversal starts at pairs of blocks.

Of the pairs found in one trie only a spanning forest is emitted: its components are those of all the pairs.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bodies, chosen, column, partitions, settled
from corpusloom.llm.graph import components, forest

SHINGLE_WORDS, SEED, MAX_BITS = 4, 42, 4
#: Fingerprints of one trie that a task takes at once.
BLOCK = 1024


def fingerprint(body: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """A bit is 1 if set in over half of the hashes of all word shingles, repeats included; no words give 0."""
    words = body.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(text, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - shingle_words] + 1).tolist()]
    ones, n, hashed = np.zeros(64, np.int64), len(starts), xxhash.xxh64_intdigest
    stops = ends[shingle_words - 1 :].tolist()
    for at in range(0, n, 65536):
        h = np.fromiter((hashed(text[s:e], seed) for s, e in zip(starts[at : at + 65536], stops[at : at + 65536])), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, sha): the fingerprint of each row's whole text as a signed long, and its SHA-256; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in column(batch, "body")]
            fps = np.array([fingerprint(x, shingle_words, seed) for x in texts], np.uint64)
            sha = pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fps.view(np.int64)), sha], ["doc_id", "fp", "sha"])

    rows = bodies(docs, id_col=id_col, text_col=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, fp long, sha binary")


def _roots(rows: DataFrame, max_bits: int) -> DataFrame:
    """rows (fp) to (fp, root), settled: each fingerprint once, with the smallest that it is linked with."""
    distinct = settled(rows.select("fp").distinct())
    roots = components(near_links(distinct, max_bits))
    return settled(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")))


def trie_pairs(fps: np.ndarray, starts: list[tuple[int, int, int, int]], max_bits: int, leaf: int = 64, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within max_bits. starts: node pairs (a, a_end, b, b_end) over runs in which fps (uint64) are sorted."""
    zeros = {}
    stack = [(0, np.array(starts, np.int64).reshape(-1, 4), np.zeros(len(starts), np.int64))]
    while stack:
        depth, node, err = stack.pop()
        if len(node) > at_once:
            half = len(node) // 2
            stack += [(depth, node[:half], err[:half]), (depth, node[half:], err[half:])]
            continue
        a, ae, b, be = node.T
        small = ((ae - a) * (be - b) <= leaf) | (depth == 64)
        if small.any():
            yield from _compare(fps, node[small], max_bits)
            node, err = node[~small], err[~small]
            a, ae, b, be = node.T
        if not len(node):
            continue
        if depth not in zeros:
            zeros[depth] = np.concatenate([[0], np.cumsum((fps >> np.uint64(63 - depth)) & np.uint64(1) == 0)])
        z = zeros[depth]
        am, bm, own = a + z[ae] - z[a], b + z[be] - z[b], a == b
        out, errs = [], []
        for part, cost, keep in (((a, am, b, bm), 0, None), ((am, ae, bm, be), 0, None), ((a, am, bm, be), 1, None), ((am, ae, b, bm), 1, ~own)):
            good = (part[0] < part[1]) & (part[2] < part[3]) & (err + cost <= max_bits)
            good = good if keep is None else good & keep
            out.append(np.stack([x[good] for x in part], axis=1))
            errs.append(err[good] + cost)
        stack.append((depth + 1, np.concatenate(out), np.concatenate(errs)))


def _compare(fps: np.ndarray, node: np.ndarray, max_bits: int, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    a, ae, b, be = node.T
    count = (ae - a) * (be - b)
    cuts = np.searchsorted(np.cumsum(count), np.arange(at_once, count.sum() + at_once, at_once))
    for lo, hi in itertools.pairwise([0, *np.unique(np.minimum(cuts + 1, len(node))).tolist()]):
        n = count[lo:hi]
        which = np.repeat(np.arange(lo, hi), n)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        width = (be - b)[which]
        i, j = a[which] + nth // width, b[which] + nth % width
        near = (np.bitwise_count(fps[i] ^ fps[j]) <= max_bits) & (i != j)
        yield i[near], j[near]


def _links(max_bits: int):
    def flush(keys: np.ndarray, subs: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((fps, subs, keys))
        keys, subs, fps = keys[order], subs[order], fps[order]
        cut = np.flatnonzero((keys[1:] != keys[:-1]) | (subs[1:] != subs[:-1])) + 1
        runs = list(zip([0, *cut.tolist()], [*cut.tolist(), len(fps)])) if len(fps) else []
        # A key has the runs it joins: one with itself, or (sub 0, sub 1) with each other; sub 2 marks the former.
        starts = [(s, e, s, e) for s, e in runs if subs[s] == 2]
        starts += [(*p, *q) for p, q in itertools.pairwise(runs) if keys[p[0]] == keys[q[0]] and subs[p[0]] == 0]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        root = np.arange(len(fps))
        for i, j in trie_pairs(fps, starts, max_bits):
            fresh = root[i] != root[j]
            if fresh.any():
                a.append(root[i[fresh]])
                b.append(root[j[fresh]])
                root = forest(np.concatenate(a), np.concatenate(b), len(fps))
                a, b = [np.flatnonzero(root != np.arange(len(fps)))], [root[root != np.arange(len(fps))]]
        child = np.flatnonzero(root != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[child].view(np.int64)), pa.array(fps[root[child]].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        nth = 0  # rows come sorted by key; each key gets a number of its own
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(column(batch, c)) for c in ("combo", "prefix", "i", "j")]
            new = np.zeros(batch.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            head = tuple(int(c[0]) for c in cols)
            new[0] = head != last
            last = tuple(int(c[-1]) for c in cols)
            keys = nth + np.cumsum(new)
            nth = int(keys[-1])
            held.append((keys, np.asarray(column(batch, "sub")), np.asarray(column(batch, "fp")).view(np.uint64)))
            if sum(len(x[0]) for x in held) > 1 << 16:
                keys, subs, fps = (np.concatenate(x) for x in zip(*held))
                done = keys < nth  # the last key may go on in the next batch
                yield flush(keys[done], subs[done], fps[done])
                held = [(keys[~done], subs[~done], fps[~done])]
        if held:
            yield flush(*(np.concatenate(x) for x in zip(*held)))

    return run


def _bands(n: int, max_bits: int) -> list[int]:
    """Masks of the bits that two fingerprints within max_bits share at least once; more bits for more fingerprints."""
    for extra in range(4):
        count = max_bits + 1 + extra
        width = 64 / count
        if n / 2 ** int(width * (1 + extra)) <= 64 or extra == 3:
            edge = [round(width * i) for i in range(count + 1)]
            bands = [sum(1 << b for b in range(edge[i], edge[i + 1])) for i in range(count)]
            return [sum(c) for c in itertools.combinations(bands, 1 + extra)]
    raise AssertionError


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """fps (fp), distinct, to links (a, b) whose components are those of all pairs within max_bits."""
    masks = _bands(fps.count(), max_bits)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tries = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("prefix")) for i, m in enumerate(masks)])).alias("t")).select("fp", "t.*")
    # Settled, so that the join with a hot trie is one of two plain shuffles.
    sizes = settled(tries.groupBy("combo", "prefix").agg(F.ceil(F.count("*") / block).cast("int").alias("cut"), F.count("*").alias("size")).filter("size > 1"))
    met = tries.join(sizes, ["combo", "prefix"])
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("cut")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    sub = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    # Blocks i and j meet under (i, j), each block with itself under (i, i).
    rows = met.select("combo", "prefix", i.alias("i"), j.alias("j"), sub.alias("sub"), "fp")
    n = partitions(fps)
    dealt = rows.repartition(n, "combo", "prefix", "i", "j").sortWithinPartitions("combo", "prefix", "i", "j")
    return dealt.mapInArrow(_links(max_bits), "a long, b long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of docs.

    Fingerprints link at max_bits or fewer differing bits; component_id is the smallest id reachable. Null and empty
    texts have fingerprint zero and link like any other. A null id never becomes a component's id unless all its
    members' ids are null. An empty table gives an empty result; other columns of docs don't matter.
    """
    rows = settled(fingerprints(docs, id_col, text_col, shingle_words, seed).drop("sha"))
    roots = _roots(rows, max_bits)
    least = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    member = roots.join(least, "fp")
    # Settled, so that a join with a large component is one of two plain shuffles, which adaptive execution can split.
    named = settled(member.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = settled(roots.join(named, "root").select("fp", "component_id"))
    out = rows.join(by_fp, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs that stay, with docs' own columns: one of each group of near copies.

    It is the row with the smallest id, a null id being the largest. Rows are told apart by their id and their text's
    SHA-256: where an id is repeated with unlike texts, each text belongs to its own group, and if several of an id are
    in one group the smallest fingerprint, then the smallest SHA-256 stays. Of equal repeats one stays.
    """
    rows = settled(fingerprints(docs, id_col, text_col, shingle_words))
    roots = _roots(rows, max_bits)
    same = rows.groupBy("fp", "doc_id", "sha").agg(F.count("*").alias("n"))
    best = lambda *more: F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *more, "sha", "n")).alias("top")
    by_fp = settled(same.groupBy("fp").agg(best()).select("fp", "top.doc_id", "top.sha", "top.n"))
    keep = by_fp.join(roots, "fp").groupBy("root").agg(best("fp")).select("top.doc_id", "top.sha", "top.n")
    return chosen(docs, settled(keep), id_col, text_col)
