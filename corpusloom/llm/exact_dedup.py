"""Exact deduplication by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. All blocks are sorted, and equal blocks get one
integer name; then adjacent names are paired, pairs are sorted and named in the same way, until a text has one
name left. Texts have the same (level, name) exactly if their bytes are the same: names come from comparing
content, so no hash collision can join two texts.

The sort is spread over range partitions by (hash, row): a block that fills a third of the corpus lies in many
partitions. Each partition names its own runs; a run that may go on in the next partition is reported as an edge,
and the few edges (two runs a partition) are merged afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bodies, chosen, column, partitions, settled

BLOCK_BYTES = 4096
#: Pairs of names at most that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
_NAMED = "uid long, pos long, doc_id long, n_bytes long, sha binary, name long, edge_h long, edge_key binary"


def _name_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names runs of equal keys in rows sorted by (h, key); rows for edges (uid null) follow."""
    base = TaskContext.get().partitionId() << 40
    n, last_h, last_key, first_h, edges, tail = -1, None, None, None, [], []
    for batch in batches:
        keys, hashes, names = column(batch, "key").to_pylist(), column(batch, "h").to_pylist(), []
        for h, key in zip(hashes, keys):
            if h != last_h or key != last_key:
                n += 1
                if first_h is None:
                    first_h = h
                if h == first_h:
                    edges.append((h, key, base + n))
                if h != last_h:
                    tail = []
                tail.append((h, key, base + n))
                last_h, last_key = h, key
            names.append(base + n)
        rows = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [column(batch, c) for c in ("uid", "pos", "doc_id", "n_bytes", "sha")] + [pa.array(names, pa.int64()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary())],
            ["uid", "pos", "doc_id", "n_bytes", "sha", "name", "edge_h", "edge_key"],
        )
    edges = list(dict.fromkeys(edges + tail))
    if edges:
        k = len(edges)
        empty = [pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays(
            empty + [pa.array([e[2] for e in edges], pa.int64()), pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.binary())],
            ["uid", "pos", "doc_id", "n_bytes", "sha", "name", "edge_h", "edge_key"],
        )


def _named(keyed: DataFrame, n: int) -> DataFrame:
    """keyed (uid, pos, doc_id, n_bytes, sha, key) with key replaced by an integer name, equal exactly for equal keys."""
    dealt = keyed.withColumn("h", F.xxhash64("key")).repartitionByRange(n, "h", "uid", "pos")
    rows = settled(dealt.sortWithinPartitions("h", "key", "uid", "pos").mapInArrow(_name_runs, _NAMED))
    edges = rows.filter("uid is null").select(F.col("edge_h"), F.col("edge_key"), F.col("name").alias("own"))
    first = edges.groupBy("edge_h", "edge_key").agg(F.min("own").alias("canon"), F.collect_list("own").alias("all"))
    # Two runs a partition at most, save where different keys share a hash; still counted before they are broadcast.
    moved = settled(first.filter("size(all) > 1").select(F.explode("all").alias("name"), "canon"))
    small = F.broadcast(moved) if moved.count() <= BROADCAST_ROWS else moved
    kept = rows.filter("uid is not null").drop("edge_h", "edge_key").join(small, "name", "left")
    return kept.select("uid", "pos", "doc_id", "n_bytes", "sha", F.coalesce("canon", "name").alias("name"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(uid, doc_id, n_bytes, sha, level, name): one row for each row of docs; equal texts share (level, name)."""
    n = partitions(docs)
    base = bodies(docs, id_col=id_col, text_col=text_col).withColumn("uid", F.monotonically_increasing_id())
    base = base.select("uid", F.col("doc_id").cast("long"), F.octet_length("body").cast("long").alias("n_bytes"), F.unhex(F.sha2("body", 256)).alias("sha"), "body")
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.col("n_bytes") - 1, F.lit(0)) / block_bytes).cast("int")), lambda i: F.col("body").substr(i * block_bytes + 1, F.lit(block_bytes)))
    blocks = base.select("uid", "doc_id", "n_bytes", "sha", F.posexplode(cut).alias("pos", "key"))
    blocks = blocks.withColumn("pos", F.col("pos").cast("long")).withColumn("sha", F.when(F.col("pos") == 0, F.col("sha")))
    named, level, done = _named(blocks, n), 0, []
    while True:
        more = F.col("n_bytes") > (block_bytes << level)
        done.append(named.filter(~more).select("uid", "doc_id", "n_bytes", "sha", F.lit(level).alias("level"), "name"))
        rest = named.filter(more)
        if rest.isEmpty():
            break
        pairs = rest.groupBy("uid", F.shiftright("pos", 1).alias("half")).agg(
            F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.max("sha").alias("sha"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b"),
        )
        key = F.concat(F.unhex(F.lpad(F.hex("a"), 16, "0")), F.unhex(F.lpad(F.hex(F.coalesce("b", F.lit(-1))), 16, "0")))
        named, level = _named(pairs.select("uid", F.col("half").alias("pos"), "doc_id", "n_bytes", "sha", key.alias("key")), n), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for each row of docs.

    Of equal texts the row with the largest id stays. A null text is an empty text and groups with empty ones; a
    null id counts as the smallest. If a row is repeated with its id, exactly one of the repeats is kept. An empty
    table gives an empty result; other columns of docs don't matter.
    """
    rows = settled(identities(docs, id_col, text_col, block_bytes))
    # A group of copies may hold a third of all rows. Settled groups make this a plain join of two shuffles, which
    # adaptive execution splits where a group is large; an aggregation inside the join would forbid that.
    groups = settled(rows.groupBy("level", "name").agg(F.max(F.struct("doc_id", "uid")).alias("top"), F.count("*").alias("group_size")))
    joined = rows.join(groups, ["level", "name"])
    return joined.select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("top.uid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that stay, with docs' own columns: of equal texts the one with the largest id.

    Rows are told apart by their id and their text's SHA-256, so where an id is repeated each of its texts is judged by
    itself, and one of equal repeats stays.
    """
    groups = exact_groups(docs, id_col, text_col, block_bytes).select("doc_id", "kept", F.unhex("text_sha256").alias("sha"))
    keep = settled(groups.groupBy("doc_id", "sha").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).filter("kept").drop("kept"))
    return chosen(docs, keep, id_col, text_col)
