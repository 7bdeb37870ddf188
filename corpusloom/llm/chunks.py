"""Texts packed into chunks, and questions that groups of chunks ask each other about hashes of what they hold.

A chunk is one row with some megabytes of whole texts, compressed; a few chunks of one task are a group. Chunks are
dealt by their group and settled once, so that every later pass finds them where they are and only what is said to a
group is sent. A question goes in two shuffles: each group sends the distinct hashes that it holds, once each and sorted,
in one block for each bucket of hashes; a bucket's task answers every group with what it should know. However often a
hash occurs, a group sends it once, so a hash in every text of the corpus costs a bucket one entry for each group, and
no task ever holds a list of the places of a hash.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bodies, column, partitions, placed

CHUNK_BYTES, GROUP_BYTES = 4 << 20, 16 << 20
_QUESTIONS, _ANSWERS = "bucket int, grp long, data binary", "grp long, kind int, data binary"


@dataclass
class Chunk:
    number: int
    ids: np.ndarray  # int64; 0 where null
    known: np.ndarray  # whether the id isn't null
    starts: np.ndarray  # of the texts in data, and the end
    data: np.ndarray  # uint8; each text is followed by a line end that isn't part of it

    def body(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i + 1] - 1].tobytes()


@dataclass
class Group:
    """Chunks, unpacked one at a time by each look at them, and what was said to the group, by kind."""

    number: int
    packed: list[tuple[int, pa.Scalar]]
    said: dict[int, list[list[np.ndarray]]]

    def chunks(self) -> Iterator[tuple[int, Chunk]]:
        """The chunks, numbered from 0 within the group."""
        for k, (number, data) in enumerate(self.packed):
            yield k, unpacked(number, data.as_py())
            pa.default_memory_pool().release_unused()

    def answers(self, kind: int, width: int) -> list[np.ndarray]:
        """All answers of a kind in one: sorted keys and values, width arrays in all."""
        return joined(self.said.get(kind, []), width)


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, the like places of their numbers side by side, which small numbers in wide types need."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 3)
        parts.append(struct.pack("<2sQQ", a.dtype.str[1:].encode(), len(a), len(raw)) + raw)
    return b"".join(parts)


def unsqueezed(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        kind, n, size = struct.unpack_from("<2sQQ", raw, at)
        at += struct.calcsize("<2sQQ")
        dtype = np.dtype("<" + kind.decode())
        planes = np.frombuffer(zstandard.decompress(raw[at : at + size]), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).reshape(-1).view(dtype) if n else np.zeros(0, dtype))
        at += size
    return out


def steps(sorted_hashes: np.ndarray) -> np.ndarray:
    return np.diff(sorted_hashes, prepend=sorted_hashes.dtype.type(0))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(grp, chunk, size, data), settled and dealt by grp: docs' ids and whole texts, null as empty. A text is never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = number = TaskContext.get().partitionId() << 24
        ids, texts, held, all_ = [], [], 0, 0

        def out() -> pa.RecordBatch:
            known = np.array([i is not None for i in ids])
            lengths = np.array([len(t) for t in texts], np.int64)
            head = squeezed(np.array([i or 0 for i in ids], np.int64), known.astype(np.uint8), lengths)
            raw = struct.pack("<Q", len(head)) + head + zstandard.compress(b"\n".join([*texts, b""]), 6)
            sizes = pa.array([int(lengths.sum())], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([number], pa.int64()), sizes, pa.array([raw], pa.binary())], ["grp", "chunk", "size", "data"])

        for batch in batches:
            for i, body in zip(column(batch, "doc_id").to_pylist(), column(batch, "body")):
                ids.append(i)
                texts.append(body.as_py())
                held += len(texts[-1]) + 1
                if held >= chunk_bytes:
                    yield out()
                    all_ += held
                    number, ids, texts, held = number + 1, [], [], 0
                    if all_ >= group_bytes:
                        group, all_ = number, 0
        if ids:
            yield out()

    rows = bodies(docs, id_col=id_col, text_col=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    made = rows.mapInArrow(run, "grp long, chunk long, size long, data binary")
    return placed(made, partitions(made), "grp", "chunk")


def unpacked(number: int, raw: bytes) -> Chunk:
    (size,) = struct.unpack_from("<Q", raw)
    ids, known, lengths = unsqueezed(raw[8 : 8 + size])
    data = np.frombuffer(zstandard.decompress(raw[8 + size :]), np.uint8)
    return Chunk(number, ids, known.astype(bool), np.concatenate([[0], np.cumsum(lengths + 1)]), data)


def bucketed(group: int, buckets: int, hashes: np.ndarray, *values: np.ndarray, lengths: np.ndarray | None = None, data: np.ndarray | None = None) -> pa.RecordBatch:
    """Questions, one row for each bucket that has any: hashes (uint64), sorted, with values beside them.

    data: bytes that belong to the hashes, lengths of them each.
    """
    own = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.searchsorted(own, np.arange(buckets + 1, dtype=np.uint64)).tolist()
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]) if lengths is not None else None
    rows = []
    for b, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
        if s < e:
            more = [lengths[s:e], data[ends[s] : ends[e]]] if lengths is not None else []
            rows.append((b, squeezed(steps(hashes[s:e]), *(v[s:e] for v in values), *more)))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([group] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "grp", "data"])


def said(group: int, kind: int, keys: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """One answer: sorted keys (uint64), values beside them."""
    return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([kind], pa.int32()), pa.array([squeezed(steps(keys), *values)], pa.binary())], ["grp", "kind", "data"])


def by_group(groups: np.ndarray, kind: int, keys: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What is to be said to several groups, as an answer for each."""
    order = np.lexsort((keys, groups))
    groups = groups[order]
    cuts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])).tolist() if len(groups) else []
    for a, b in zip(cuts, [*cuts[1:], len(groups)]):
        yield said(int(groups[a]), kind, keys[order[a:b]], *(v[order[a:b]] for v in values))


Work = Callable[[Group], Iterator[pa.RecordBatch]]


def asked(chunks: DataFrame, ask: Work, *answers: DataFrame) -> DataFrame:
    """(bucket, grp, data): what ask makes, by bucketed(), of each group."""
    return worked(chunks, ask, _QUESTIONS, *answers)


def told(chunks: DataFrame, tell: Work, *answers: DataFrame) -> DataFrame:
    """(grp, kind, data): what groups tell each other without a bucket between, by said()."""
    return worked(chunks, tell, _ANSWERS, *answers)


def answered(questions: DataFrame, answer: Callable[[np.ndarray, np.ndarray, list[np.ndarray]], Iterator[pa.RecordBatch]], buckets: int) -> DataFrame:
    """(grp, kind, data): answer gets a bucket's hashes, the groups that sent them and the values; it yields answers by said()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, group, data in zip(*(column(batch, c).to_pylist() for c in ("bucket", "grp", "data"))):
                held.setdefault(bucket, []).append((group, data))
        for bucket in sorted(held):
            parts = held.pop(bucket)
            blocks = [unsqueezed(data) for _, data in parts]
            hashes = np.concatenate([np.cumsum(b[0], dtype=np.uint64) for b in blocks])
            senders = np.repeat(np.array([c for c, _ in parts], np.int64), [len(b[0]) for b in blocks])
            values = [np.concatenate(v) for v in zip(*(b[1:] for b in blocks))]
            del blocks, parts
            yield from answer(hashes, senders, values)
            del hashes, senders, values
            pa.default_memory_pool().release_unused()

    # Buckets are numbered like partitions, so each partition gets one bucket.
    return questions.repartitionById(buckets, F.col("bucket")).mapInArrow(run, _ANSWERS)


def worked(chunks: DataFrame, work: Work, schema: str, *answers: DataFrame) -> DataFrame:
    """What work makes of each group and of what was said to it."""

    def group(key: tuple, rows: pa.Table, heard: pa.Table | None) -> pa.Table:
        got: dict[int, list[list[np.ndarray]]] = {}
        if heard is not None:
            for kind, data in zip(heard.column("kind").to_pylist(), heard.column("data")):
                blocks = unsqueezed(data.as_py())
                got.setdefault(kind, []).append([np.cumsum(blocks[0], dtype=np.uint64), *blocks[1:]])
        packed = sorted(zip(rows.column("chunk").to_pylist(), rows.column("data")), key=lambda x: x[0])
        made = list(work(Group(key[0].as_py(), packed, got))) if packed else []
        return pa.Table.from_batches(made) if made else empty

    empty = _no_rows(chunks, schema)
    rows = chunks.select("grp", "chunk", "data")
    if not answers:
        return rows.groupBy("grp").applyInArrow(lambda key, table: group(key, table, None), schema)
    heard = answers[0]
    for more in answers[1:]:
        heard = heard.unionByName(more)
    return rows.groupBy("grp").cogroup(heard.groupBy("grp")).applyInArrow(group, schema)


def _no_rows(chunks: DataFrame, schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema)).empty_table()


def joined(answers: list[list[np.ndarray]], width: int) -> list[np.ndarray]:
    """Answers as sorted hashes and values, width arrays in all."""
    if not answers:
        return [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * (width - 1)
    cols = [np.concatenate(x) for x in zip(*answers)]
    order = np.argsort(cols[0], kind="stable")
    return [c[order] for c in cols]


def found(sorted_hashes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of hashes would be in sorted_hashes, and whether it is there."""
    if not len(sorted_hashes):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == hashes


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
