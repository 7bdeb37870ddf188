"""Substring deduplication with fixed-block anchors.

A window is 13 consecutive words. Every window holds one whole block of 7 words that starts at a multiple of 7, so
the index needs only each text's blocks that don't overlap. Every rolling run of 7 words of every text is a probe into
that index. Where a probe hits, the hit is extended: neighbouring windows that agree with neighbouring windows of
another place make one stretch, as long as there are any, and the words of both places are compared: the maximal exact
repeat.

Groups of chunks (chunks.py) ask each other about hashes to find places, and compare words to decide:

1. Groups send hashes of blocks and probes, and learn which of them are anchors.
2. They send the windows at anchors, one place a chunk, and learn for each window the smallest id that has it, and
   the place before: windows of one hash make a chain through the chunks that have it.
3. Each chunk sends the words of its places to the chunk that follows in the chain; in this way no chunk is asked by
   all others, however frequent a passage is. Within a chunk, places are compared with the chunk's first one.
4. If all words in a chain agree, all its windows are the same. A chain in which some don't, because unlike windows
   share a hash, is settled by the windows' words themselves.

Texts with ids that are null take no part and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.chunks import Chunk, Group, answered, asked, bucketed, by_group, found, mixed, pack, said, told, worked
from corpusloom.llm.common import column, partitions, settled

WINDOW, BLOCK = 13, 7
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 17
_TABLE = np.random.default_rng(13).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        base = 0x5851F42D4C957F2D
        for k, b in enumerate((base, pow(base, -1, 1 << 64))):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS


def _edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = np.concatenate([[True], _SPACE[data], [True]])
    turn = np.flatnonzero(blank[1:] != blank[:-1])
    return turn[::2], turn[1::2]


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of UTF-8 bytes, worked through in pieces that end at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        if end < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            while not len(gaps) and end < len(data):
                last, end = end, min(len(data), 2 * end - at)
                gaps = np.flatnonzero(_SPACE[data[last:end]]) + last - at
            end = at + int(gaps[-1]) + 1 if len(gaps) else len(data)
        piece = data[at:end]
        start, stop = _edges(piece)
        power, back = (p[: len(piece) + 1] for p in _powers(len(piece) + 1))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[piece] * power[:-1], dtype=np.uint64)])
        h = mixed((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64) * _STEP)
        out.append((start + at, stop + at, h))
        at = end
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    acc = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        acc = acc * _STEP + h[j : len(h) - n + 1 + j]
    return mixed(acc)


class Worded:
    """A chunk's words, and which runs of n words lie within one text with an id."""

    def __init__(self, chunk: Chunk):
        self.chunk = chunk
        self.start, self.stop, self.h = words(chunk.data)
        self.first = np.searchsorted(self.start, chunk.starts)  # of the words of each text, and the end
        self.doc = np.repeat(np.arange(len(chunk.ids)), np.diff(self.first))
        self.place = np.arange(len(self.start)) - self.first[self.doc]

    def whole(self, n: int) -> np.ndarray:
        if len(self.doc) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero((self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :]) & self.chunk.known[self.doc[: len(self.doc) - n + 1]])


def _once(h: np.ndarray, *more: tuple[np.ndarray, np.ufunc]) -> tuple[np.ndarray, ...]:
    """Distinct h, sorted, and each array folded over equal ones."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return (h[new], *(fold.reduceat(x[order], new) if len(new) else x for x, fold in more))


def _anchor_bits(total: int) -> int:
    """Bits of the first round's hashes: so few that they squeeze well, so many that false anchors stay rare."""
    return min(64, max(24, int(total).bit_length() + 6))


def _keep(bits: int) -> np.uint64:
    return ~np.uint64((1 << (64 - bits)) - 1)


def _ask_anchors(bits: int, buckets: int):
    def ask(group: Group) -> Iterator[pa.RecordBatch]:
        hashes, flags = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for _, chunk in group.chunks():
            w = Worded(chunk)
            at = w.whole(BLOCK)
            doc = w.doc[at]
            # For each hash: is it a block, and is it in several texts of this chunk?
            h, block, low, high = _once(runs(w.h, BLOCK)[at] & _keep(bits), (w.place[at] % BLOCK == 0, np.logical_or), (doc, np.minimum), (doc, np.maximum))
            hashes.append(h)
            flags.append((block + 2 * (low != high)).astype(np.uint8))
        h = np.concatenate(hashes)
        h, flag, times = _once(h, (np.concatenate(flags), np.bitwise_or), (np.ones(len(h), np.uint8), np.add))
        yield bucketed(group.number, buckets, h, flag | 2 * (times > 1).astype(np.uint8))

    return ask


def _answer_anchors(hashes: np.ndarray, senders: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((senders, hashes))
    h, s, v = hashes[order], senders[order], values[0][order]
    new = _new(h)
    size = np.diff(np.append(new, len(h)))
    all_ = np.bitwise_or.reduceat(v, new)
    good = np.repeat((all_ & 1 > 0) & ((size > 1) | (all_ & 2 > 0)), size)
    yield from by_group(s[good], ANCHORS, h[good])


def _new(*sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    if not len(sorted_[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in sorted_], axis=0)]))


# Kinds of answers.
ANCHORS, VERDICTS, ORDERS, WORDS, DISPUTED, SETTLED = range(6)
_NONE = np.iinfo(np.int64).max
#: A place is the number of a chunk in its group, and that of a window's first word in the chunk.
_CHUNK = 32


def _windows(group: Group, bits: int) -> Iterator[tuple[int, Worded, np.ndarray, np.ndarray]]:
    """Chunks with the places and hashes of their windows at anchors."""
    (anchors,) = group.answers(ANCHORS, 1)
    for k, chunk in group.chunks():
        w = Worded(chunk)
        anchor = found(anchors, runs(w.h, BLOCK) & _keep(bits))[1]
        at = w.whole(WINDOW)
        # A window holds 7 probes.
        sums = np.concatenate([[0], np.cumsum(anchor)])
        at = at[sums[at + WINDOW - BLOCK + 1] > sums[at]]
        yield k, w, at, runs(w.h, WINDOW)[at]


def _ask_windows(bits: int, buckets: int):
    def ask(group: Group) -> Iterator[pa.RecordBatch]:
        parts = [[np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3]]
        for k, w, at, h in _windows(group, bits):
            ids = w.chunk.ids[w.doc[at]]
            parts.append(_once(h, (ids, np.minimum), (ids, np.maximum), (at + (k << _CHUNK), np.minimum)))
        h, low, high, place = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h, kind="stable")
        # Numbers near each other squeeze better: the highest id, and how far below it the lowest lies.
        yield bucketed(group.number, buckets, h[order], high[order], (high - low)[order], place[order])

    return ask


def _answer_windows(hashes: np.ndarray, senders: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Chains of the windows that occur in a document and in one with a smaller id."""
    order = np.lexsort((values[2], senders, hashes))
    h, s, high, below, place = (x[order] for x in (hashes, senders, *values))
    new = _new(h)
    size = np.diff(np.append(new, len(h)))
    least = np.minimum.reduceat(high - below, new) if len(new) else high
    good = np.repeat(least < (np.maximum.reduceat(high, new) if len(new) else high), size)
    first = np.zeros(len(h), bool)
    first[new] = True
    # Before the first of a chain there is nothing; else the place before is the entry before.
    before, before_place = np.roll(s, 1), np.roll(place, 1)
    before[first], before_place[first] = -1, 0
    least = np.repeat(least, size)
    yield from by_group(s[good], VERDICTS, place[good].astype(np.uint64), least[good], before[good], (before_place - place)[good])
    later = good & ~first
    yield from by_group(before[later], ORDERS, before_place[later].astype(np.uint64), s[later])


def _stretches(at: np.ndarray, *others: np.ndarray) -> tuple[list[int], list[int]]:
    """Where stretches of windows start and end; at and the first of others go on by one, the rest stay the same."""
    if not len(at):
        return [], []
    cut = (np.diff(at) != 1) | (np.diff(others[0]) != 1)
    for x in others[1:]:
        cut |= np.diff(x) != 0
    edge = (np.flatnonzero(cut) + 1).tolist()
    return [0, *edge], [*edge, len(at)]


def _words(raw: bytes, w: Worded, at: int, windows: int) -> list[bytes]:
    """The words of so many windows one after the other."""
    return raw[w.start[at] : w.stop[at + windows + WINDOW - 2]].split()


def _tell_words(group: Group) -> Iterator[pa.RecordBatch]:
    places, to = group.answers(ORDERS, 2)
    places = places.astype(np.int64)
    for k, chunk in group.chunks():
        own = np.flatnonzero(places >> _CHUNK == k)
        if not len(own):
            continue
        own = own[np.argsort(to[own], kind="stable")]
        at, asker, w, raw = places[own] & (1 << _CHUNK) - 1, to[own], Worded(chunk), chunk.data.tobytes()
        for a in np.split(np.arange(len(own)), np.flatnonzero(np.diff(asker)) + 1):
            s, e = _stretches(at[a], at[a])
            start, size = at[a][s], np.array(e) - np.array(s)
            text = b"\n".join(b" ".join(_words(raw, w, p, n)) for p, n in zip(start.tolist(), size.tolist()))
            yield said(int(asker[a[0]]), WORDS, (start + (k << _CHUNK)).astype(np.uint64), size, np.full(len(s), group.number), np.array([len(text)]), np.frombuffer(text, np.uint8))


class Heard:
    """The words that other groups, or this one, have sent for comparison."""

    def __init__(self, said_: list[list[np.ndarray]]):
        self.start: dict[int, np.ndarray] = {}
        self.lines: dict[int, list] = {}
        by: dict[int, list] = {}
        for keys, _, group, _, text in said_:
            by.setdefault(int(group[0]), []).extend(zip(keys.astype(np.int64).tolist(), text.tobytes().split(b"\n")))
        for g, lines in by.items():
            lines.sort(key=lambda x: x[0])
            self.start[g], self.lines[g] = np.array([x[0] for x in lines]), [x[1] for x in lines]

    def words(self, group: int, place: int, windows: int) -> list[bytes]:
        i = int(np.searchsorted(self.start[group], place, "right")) - 1
        if isinstance(self.lines[group][i], bytes):
            self.lines[group][i] = self.lines[group][i].split()
        at = place - int(self.start[group][i])
        return self.lines[group][i][at : at + windows + WINDOW - 1]


def _unlike(mine: list[bytes], other: list[bytes]) -> np.ndarray:
    """The windows, from 0, in which mine and other aren't the same."""
    if mine == other:
        return np.zeros(0, np.int64)
    bad = np.array([x != y for x, y in zip(mine, other, strict=True)])
    sums = np.concatenate([[0], np.cumsum(bad)])
    return np.flatnonzero(sums[WINDOW:] > sums[:-WINDOW])


def _compare(bits: int):
    """Compares words along chains; gives the hashes of windows that share them with unlike ones."""

    def compare(group: Group) -> Iterator[pa.RecordBatch]:
        places, _, before, step = group.answers(VERDICTS, 4)
        heard, odd = Heard(group.said.get(WORDS, [])), [np.zeros(0, np.uint64)]
        places = places.astype(np.int64)
        for k, w, at, h in _windows(group, bits):
            own = np.flatnonzero(places >> _CHUNK == k)
            if not len(own):
                continue
            p, raw = places[own] & (1 << _CHUNK) - 1, w.chunk.data.tobytes()
            hash_of = runs(w.h, WINDOW)
            # The chunk's first place of a window against the place before in the chain.
            chain = before[own] >= 0
            mine, theirs, g = p[chain], (places[own] + step[own])[chain], before[own][chain]
            for s, e in zip(*_stretches(mine, theirs, g)):
                bad = _unlike(_words(raw, w, mine[s], e - s), heard.words(int(g[s]), int(theirs[s]), e - s))
                odd.append(hash_of[mine[s] + bad])
            # Its other places against the first.
            order = np.argsort(hash_of[p], kind="stable")
            i, there = found(hash_of[p][order], h)
            again, first = at[there], p[order][i[there]]
            other = again != first
            again, first = again[other], first[other]
            for s, e in zip(*_stretches(again, first)):
                bad = _unlike(_words(raw, w, again[s], e - s), _words(raw, w, first[s], e - s))
                odd.append(hash_of[again[s] + bad])
        h = np.unique(np.concatenate(odd))
        if len(h):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return compare


def _ask_disputed(bits: int, buckets: int):
    def ask(group: Group) -> Iterator[pa.RecordBatch]:
        h = np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for _, _, _, h in _windows(group, bits)]]))
        yield bucketed(group.number, buckets, h, np.zeros(len(h), np.uint8))

    return ask


def _answer_disputed(hashes: np.ndarray, senders: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    good = (senders >= 0) & np.isin(hashes, hashes[values[0] > 0])
    yield from by_group(senders[good], DISPUTED, hashes[good])


def _disputed_windows(bits: int):
    """(words, grp, id): the windows with disputed hashes, each text of a chunk's once with its smallest id."""

    def give(group: Group) -> Iterator[pa.RecordBatch]:
        (disputed,) = group.answers(DISPUTED, 1)
        for _, w, at, h in _windows(group, bits):
            least: dict[bytes, int] = {}
            raw = w.chunk.data.tobytes()
            for p in at[found(disputed, h)[1]].tolist():
                key, i = b" ".join(_words(raw, w, p, 1)), int(w.chunk.ids[w.doc[p]])
                least[key] = min(i, least.get(key, i))
            if least:
                yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.binary()), pa.array([group.number] * len(least), pa.int64()), pa.array(list(least.values()), pa.int64())], ["words", "grp", "id"])

    return give


def _settled_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words_, group, least in zip(*(column(batch, c).to_pylist() for c in ("words", "grp", "least"))):
            yield said(group, SETTLED, np.array([least], np.int64).view(np.uint64), np.frombuffer(words_, np.uint8))


def _finish(bits: int):
    def finish(group: Group) -> Iterator[pa.RecordBatch]:
        places, least, *_ = group.answers(VERDICTS, 4)
        (disputed,) = group.answers(DISPUTED, 1)
        by_words = {words_.tobytes(): int(key.view(np.int64)[0]) for key, words_ in group.said.get(SETTLED, [])}
        places = places.astype(np.int64)
        for k, w, at, h in _windows(group, bits):
            own = np.flatnonzero(places >> _CHUNK == k)
            hash_of, raw = runs(w.h, WINDOW), w.chunk.data.tobytes()
            known = hash_of[places[own] & (1 << _CHUNK) - 1]
            order = np.argsort(known, kind="stable")
            i, there = found(known[order], h)
            there &= ~found(disputed, h)[1]
            repeat = at[there][least[own][order][i[there]] < w.chunk.ids[w.doc[at[there]]]]
            odd = [p for p in at[found(disputed, h)[1]].tolist() if by_words[b" ".join(_words(raw, w, p, 1))] < w.chunk.ids[w.doc[p]]]
            yield _kept(w, np.concatenate([repeat, np.array(odd, np.int64)]))

    return finish


def _kept(w: Worded, repeats: np.ndarray) -> pa.RecordBatch:
    chunk = w.chunk
    edge = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(edge, repeats, 1)
    np.add.at(edge, repeats + WINDOW, -1)
    gone = np.cumsum(edge[:-1]) > 0
    n_words, n_gone, kept, spans = np.diff(w.first), [], [], []
    for d in range(len(chunk.ids)):
        a, b = w.first[d], w.first[d + 1]
        off = gone[a:b]
        n_gone.append(int(off.sum()))
        text = chunk.body(d).split()
        turn = np.flatnonzero(np.diff(np.concatenate([[False], off, [False]]).astype(np.int8)))
        spans.append(turn.tolist())
        kept.append(b" ".join([x for x, o in zip(text, off.tolist()) if not o]) if n_gone[-1] else b" ".join(text))
    ids = pa.array(chunk.ids, mask=~chunk.known)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "edges", "kept"]
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, edges, kept): one row for each row of docs.

    Words are runs of bytes other than ASCII white space. A word is removed if a window of 13 words covers it that
    also starts in a document with a smaller id; windows are judged on the input, and their words are compared, not
    their hashes. kept joins the remaining words by one space (UTF-8 bytes); edges lists where removed runs start and
    end, by turns. A null text has no words; a text of any length is taken whole. Rows with the same id don't remove
    each other's words, and rows without id are kept whole. An empty table gives an empty result; other columns of
    docs, whatever their names, are never read.
    """
    chunks = pack(docs, id_col, text_col)
    buckets = partitions(chunks)
    bits = _anchor_bits(chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    anchors = settled(answered(asked(chunks, _ask_anchors(bits, buckets)), _answer_anchors, buckets))
    chains = settled(answered(asked(chunks, _ask_windows(bits, buckets), anchors), _answer_windows, buckets))
    verdicts, orders = chains.filter(F.col("kind") == VERDICTS), chains.filter(F.col("kind") == ORDERS)
    odd = settled(worked(chunks, _compare(bits), "h long", anchors, verdicts, told(chunks, _tell_words, orders)))
    more = [] if odd.isEmpty() else _by_words(chunks, anchors, odd.distinct(), bits, buckets)
    return worked(chunks, _finish(bits), "doc_id long, n_words long, n_removed long, edges array<long>, kept binary", anchors, verdicts, *more)


def _by_words(chunks: DataFrame, anchors: DataFrame, odd: DataFrame, bits: int, buckets: int) -> list[DataFrame]:
    """What groups should know of windows whose hashes are those of unlike windows: which they are, and smallest ids by words."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.sort(np.asarray(column(batch, "h")).view(np.uint64))
            yield bucketed(-1, buckets, h, np.ones(len(h), np.uint8))

    questions = asked(chunks, _ask_disputed(bits, buckets), anchors).unionByName(odd.mapInArrow(marks, "bucket int, grp long, data binary"))
    disputed = settled(answered(questions, _answer_disputed, buckets))
    windows = settled(worked(chunks, _disputed_windows(bits), "words binary, grp long, id long", anchors, disputed))
    least = settled(windows.groupBy("words").agg(F.min("id").alias("least")))
    rows = windows.select("words", "grp").distinct().join(least, "words")
    return [disputed, rows.mapInArrow(_settled_rows, "grp long, kind int, data binary")]
