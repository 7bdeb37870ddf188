"""Suffix-array deduplication with a run-length index.

A byte goes if a string of 100 bytes that covers it also starts earlier in the corpus.

Anchors bring together what may be equal. Of the hashes of all 24-byte strings in a window of 100 bytes, the smallest,
leftmost first, is the window's anchor; it depends on the window's bytes alone, so equal windows have equal anchors at
equal offsets. Groups of chunks (chunks.py) ask each other which anchors occur more than once, and send the windows at
such anchors as contexts: the bytes round one anchor, some 150 of them, that hold all windows which it anchors.

What decides is a run-length index of older contexts: their Burrows-Wheeler transform, kept as runs, with the text
place of each run's two ends. Contexts that are the same bytes are copies of one text of the index, which its runs
count; they make runs longer and not more. Every younger context is streamed against the index from right to left;
where its next byte isn't that of the run it stands in, it moves to the end of a neighbouring run, the one whose text
agrees for longer. This gives matching statistics, the length of the longest match at each place, and a window whose
match is 100 bytes or longer starts earlier. Older and younger is settled in levels: all copies of a context are
streamed against an index of those that came first, and contexts that differ, by the bits of their number in order of
age: each level of bits is one index, in which the contexts that differ in higher bits have alphabets of their own.

An anchor that is frequent in a group, or in many chunks, may be in any share of the corpus, mostly with other bytes
round it each time. Its windows are asked about one by one, by their own hashes, and those that occur once are left
out; what stays is cut by offsets to the anchor into parts of 11 windows, which are contexts of the 90 bytes that
they share. Where even these are frequent but a window isn't, the window is a context by itself. So what meets under
one key is bounded but for windows which themselves are that frequent, and these differ little. If more than
MANY contexts that differ meet nevertheless, they are cut into their windows before they are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.chunks import Chunk, Group, answered, asked, bucketed, by_group, found, mixed, pack, worked
from corpusloom.llm.common import partitions, settled

LENGTH, ANCHOR = 100, 24
#: A hash is frequent if a group has it so often, or so many chunks have it; others have fewer than HOT * WIDE contexts.
HOT, WIDE = 32, 64
#: Windows of a part; the 77 offsets of a window to its anchor are 7 parts.
PART = 11
#: Bytes of contexts that one index takes at once, and contexts of one key at most that enter it uncut.
INDEX_BYTES, MANY = 1 << 20, 256
#: Bytes of a chunk, of a group, and of a chunk at once; smaller than what chunks.py takes, for there are more numbers to a byte here.
CHUNK_BYTES, GROUP_BYTES, _PIECE, _PLACE_BITS = 2 << 20, 8 << 20, 1 << 15, 20
_GAP = np.zeros(1, bool)
# Kinds of answers, and where in a place the number of the chunk starts.
ANCHORS, WINDOWS, OLDER = range(3)
_CHUNK = 32
_TABLE = np.random.default_rng(29).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x5851F42D4C957F2D


def strings(data: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all strings of n bytes, put together from those of powers of two."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    part, size, power = _TABLE[data], 1, _STEP
    out, done = None, 0
    while size <= n:
        if n & size:
            if out is None:
                out = part
            else:
                m = len(data) - done - size + 1
                out = out[:m] * np.uint64(power) + part[done : done + m]
            done += size
        if 2 * size <= n:
            m = len(data) - 2 * size + 1
            part = part[:m] * np.uint64(power) + part[size : size + m]
            power = power * power % (1 << 64)
        size *= 2
    return mixed(out[: len(data) - n + 1])


def anchored(data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of data by their anchors, in pieces: the number of windows so far and runs of windows with one anchor.

    A run is where it starts, its anchor's hash and its anchor's place. The upper bits of a hash and its place in the
    piece make one number, whose minimum over a window is its anchor; a piece's end may cut a run in two.
    """
    span, low = length - anchor + 1, np.uint64((1 << _PLACE_BITS) - 1)
    for at in range(0, max(0, len(data) - length + 1), _PIECE):
        h = strings(data[at : at + _PIECE + length - 1], anchor)
        best, size = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
        while size < span:
            step = min(size, span - size)
            best = np.minimum(best[: len(best) - step], best[step:])
            size += step
        start = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        place = (best[start] & low).astype(np.int64)
        # Minima are small numbers; mixed once more, they spread over all buckets.
        yield at + len(best), start + at, mixed(h[place]), place + at


class Anchored:
    """A chunk's windows that lie within one text, in runs of windows with one anchor in one place."""

    def __init__(self, chunk: Chunk):
        runs = list(anchored(chunk.data))
        if not runs:
            self.start = self.size = self.place = self.doc = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        n = runs[-1][0]
        start, anchor, place = (np.concatenate(x) for x in list(zip(*runs))[1:])
        same = np.concatenate([[False], place[1:] == place[:-1]])
        start, anchor, place = start[~same], anchor[~same], place[~same]
        # A run also ends where a text starts, and where the last whole window of a text has started.
        begin, end = chunk.starts[:-1], chunk.starts[1:] - LENGTH
        cut = np.concatenate([begin[begin < n], end[(end > begin) & (end < n)]])
        at = np.union1d(start, cut)
        of = np.searchsorted(start, at, "right") - 1
        doc = np.searchsorted(chunk.starts, at, "right") - 1
        whole = at < end[doc]
        self.start, self.size = at[whole], np.diff(np.append(at, n))[whole]
        self.anchor, self.place, self.doc = anchor[of][whole], place[of][whole], doc[whole]


def _bits(total: int) -> int:
    return min(63, max(24, int(total).bit_length() + 6))


def _keep(bits: int) -> np.uint64:
    return ~np.uint64((1 << (64 - bits)) - 1)


def _tally(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct h, sorted; whether each occurs more than once (1) and frequently (2); that one chunk has it."""
    h, count = np.unique(h, return_counts=True)
    return h, ((count > 1) + 2 * (count >= HOT)).astype(np.uint8), np.ones(len(h), np.uint8)


def _together(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tallies of several chunks in one."""
    h, flags, chunks = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64), *[np.zeros(0, np.uint8)] * 2), *parts))
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    if not len(h):
        return h, flags, chunks
    n = np.minimum(np.add.reduceat(chunks[order].astype(np.int64), new), 255).astype(np.uint8)
    return h[new], np.bitwise_or.reduceat(flags[order], new) | (n > 1), n


def _ask_anchors(bits: int, buckets: int):
    def ask(group: Group) -> Iterator[pa.RecordBatch]:
        yield bucketed(group.number, buckets, *_together([_tally(Anchored(chunk).anchor & _keep(bits)) for _, chunk in group.chunks()]))

    return ask


def _answer_repeats(kind: int):
    """To each group its hashes that occur more than once anywhere, and whether they are frequent."""

    def answer(hashes: np.ndarray, senders: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((senders, hashes))
        h, s, v, n = hashes[order], senders[order], values[0][order], values[1][order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(new, len(h)))
        flags = np.bitwise_or.reduceat(v, new)
        good = np.repeat((size > 1) | (flags & 1 > 0), size)
        frequent = (flags >> 1 & 1 > 0) | (np.add.reduceat(n.astype(np.int64), new) >= WIDE)
        yield from by_group(s[good], kind, h[good], np.repeat(frequent, size)[good].astype(np.uint8))

    return answer


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the stretches start .. start + size, and the stretch of each."""
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + start[which], which


def _hashes(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the strings of n bytes at places in rising order; data is worked through in pieces."""
    out = [np.zeros(0, np.uint64)]
    edges = np.searchsorted(at, np.arange(0, len(data) + _PIECE, _PIECE)).tolist()
    for k, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
        if i < j:
            s = k * _PIECE
            out.append(strings(data[s : s + _PIECE + n - 1], n)[at[i:j] - s])
    return np.concatenate(out)


class Frequent:
    """A chunk's windows at frequent anchors: their places, own hashes, parts and parts' hashes."""

    def __init__(self, data: np.ndarray, runs: Anchored, hot: np.ndarray, bits: int):
        order = np.flatnonzero(hot)
        self.at, which = _spread(runs.start[order], runs.size[order])
        run = order[which]
        self.own = _hashes(data, self.at, LENGTH) & _keep(bits)
        # Windows of a part have their anchors from first to first + 10 bytes after their starts; all hold these 90 bytes.
        first = (runs.place[run] - self.at) // PART * PART
        shared = runs.place[run] - first
        new = np.ones(len(self.at), bool)
        new[1:] = (run[1:] != run[:-1]) | (first[1:] != first[:-1])
        self.part = np.cumsum(new) - 1
        place, back = np.unique(shared[new], return_inverse=True)
        keys = mixed(_hashes(data, place, LENGTH - PART + 1)[back] + (first[new] // PART).astype(np.uint64))
        self.key = (keys & _keep(bits))[self.part] if len(keys) else keys
        self.once = new


def _ask_frequent(bits: int, buckets: int):
    """Windows at frequent anchors and their parts, by their own hashes."""

    def ask(group: Group) -> Iterator[pa.RecordBatch]:
        known, frequent = group.answers(ANCHORS, 2)
        hot, parts = known[frequent > 0], []
        if not len(hot):
            return
        for _, chunk in group.chunks():
            runs = Anchored(chunk)
            f = Frequent(chunk.data, runs, found(hot, runs.anchor & _keep(bits))[1], bits)
            parts.append(_together([_tally(f.own), _tally(f.key[f.once])])[:2])
            parts[-1] = (*parts[-1], np.ones(len(parts[-1][0]), np.uint8))
        yield bucketed(group.number, buckets, *_together(parts))

    return ask


def _contexts(chunk: Chunk, group: Group, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, starts and numbers of windows of the chunk's contexts that may occur elsewhere."""
    known, frequent = group.answers(ANCHORS, 2)
    repeated, often = group.answers(WINDOWS, 2)
    runs = Anchored(chunk)
    at, there = found(known, runs.anchor & _keep(bits))
    hot = there & (frequent[at] > 0) if len(known) else there
    plain = np.flatnonzero(there & ~hot)
    key, start, size = runs.anchor[plain], runs.start[plain], runs.size[plain]
    if hot.any():
        f = Frequent(chunk.data, runs, hot, bits)
        i, twice = found(repeated, f.own)
        j, part = found(repeated, f.key)
        alone = twice & part & (often[j] > 0) & (often[i] == 0) if len(repeated) else twice
        good = np.flatnonzero(twice)
        # Windows in a row that share a part and stay in it are a context, and so is each one that stands alone.
        new = np.ones(len(good), bool)
        new[1:] = (f.part[good][1:] != f.part[good][:-1]) | (np.diff(f.at[good]) != 1) | alone[good][1:] | alone[good][:-1]
        first = good[new]
        key = np.concatenate([key, np.where(alone[first], f.own[first], f.key[first])])
        start, size = np.concatenate([start, f.at[first]]), np.concatenate([size, np.diff(np.append(np.flatnonzero(new), len(good)))])
    return key, start, size


def _ask_contexts(bits: int, buckets: int):
    """Contexts by their keys, oldest first; bytes that a group has several times under a key are sent once."""

    def ask(group: Group) -> Iterator[pa.RecordBatch]:
        keys, places, ids, texts, raw = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        seen: dict[tuple[int, bytes], int] = {}
        for k, chunk in group.chunks():
            key, start, size = _contexts(chunk, group, bits)
            data = chunk.data.tobytes()
            number = np.empty(len(key), np.int64)
            for n, (h, s, e) in enumerate(zip(key.tolist(), start.tolist(), (start + size + LENGTH - 1).tolist())):
                number[n] = text = seen.setdefault((h, data[s:e]), len(seen))
                if text == len(raw):
                    raw.append(data[s:e])
            doc = np.searchsorted(chunk.starts, start, "right") - 1
            keys.append(key)
            places.append(start + (k << _CHUNK))
            ids.append(np.where(chunk.known, chunk.ids, np.iinfo(np.int64).max)[doc])
            texts.append(number)
        key, place, id_, text = (np.concatenate(x) for x in (keys, places, ids, texts))
        order = np.lexsort((place, text, key))
        text = text[order]
        # Entries with bytes come before the copies of these bytes, which have none.
        new = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
        lengths = np.zeros(len(text), np.uint16)
        lengths[new] = [len(raw[t]) for t in text[new].tolist()]
        bytes_ = np.frombuffer(b"".join([raw[t] for t in text[new].tolist()]), np.uint8)
        yield bucketed(group.number, buckets, key[order], place[order], id_[order], lengths=lengths, data=bytes_)

    return ask


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of a text of symbols, with the text places of both ends of its runs.

    Texts end in symbols that occur once. rank[k] orders the strings of 2 ** k symbols at each place; the last orders all
    rotations, and pairs of places are compared through them. copies: how many equal texts each
    place of the text stands for; their rows lie next to each other, so they lengthen the runs that one of them has.
    """

    def __init__(self, text: np.ndarray, copies: np.ndarray | None = None):
        n = self.n = len(text)
        there = np.zeros(int(text.max()) + 1, bool)
        there[text] = True
        self.code = np.where(there, np.cumsum(there) - 1, -1)
        codes = self.code[text]
        # A rank is the number of strings that are smaller. Strings of one symbol come in the order of symbols; those of
        # twice the length are sorted only where ranks are shared so far.
        size = np.bincount(codes)
        rank = (np.cumsum(size) - size).astype(np.int32)[codes]
        self.rank = [codes.astype(np.int32)]
        shared = np.flatnonzero(size[codes] > 1)
        while len(shared):
            step = 1 << (len(self.rank) - 1)
            ahead = shared + step
            ahead[ahead >= n] -= n
            key = rank[shared].astype(np.int64) << 32 | rank[ahead]
            order = np.argsort(key)
            key, own = key[order], shared[order]
            old = (key >> 32).astype(np.int32)
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first, group = np.flatnonzero(new), np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
            # A string's new rank: the old one, and how many before it in its group differ from it.
            times = np.diff(np.append(first, len(key)))
            rank[own] = np.repeat(old[first] + (first - group[np.searchsorted(group, first, "right") - 1]).astype(np.int32), times)
            self.rank.append(rank.copy())
            shared = own[np.repeat(times > 1, times)]
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        before = codes[suffixes - 1]
        first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        last = np.append(first[1:], n) - 1
        self.symbol = before[first]
        self.place_start, self.place_end = suffixes[first], suffixes[last]
        rows = np.cumsum(np.ones(n, np.int64) if copies is None else copies[suffixes])
        self.end = rows[last] - 1
        self.start = np.append(0, self.end[:-1] + 1)
        self.size = self.end - self.start + 1
        runs = len(self.start)
        order = np.argsort(self.symbol, kind="stable")
        self.by_symbol, self.keys = order, self.symbol[order] * np.int64(runs) + order
        # The rows of the symbols of a run lie side by side, from a place in a run on.
        to = np.cumsum(self.size[order]) - self.size[order]
        self.to_run, self.to_place = np.empty(runs, np.int64), np.empty(runs, np.int64)
        self.to_run[order] = there = np.searchsorted(self.start, to, "right") - 1
        self.to_place[order] = to - self.start[there]

    def agree(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """How many symbols are the same from the places i and j on, exact up to most."""
        # Steps from unlike places never pass a text's end, whose symbol occurs once; those from one place stop at the last.
        start, last = i, self.n - 1
        for k in range(min(len(self.rank), most.bit_length()) - 1, -1, -1):
            step = (self.rank[k][i] == self.rank[k][j]).astype(np.int64) << k
            i, j = np.minimum(i + step, last), np.minimum(j + step, last)
        return i - start

    def statistics(self, patterns: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each place of the patterns, which are streamed side by side, the length of the longest match from there on."""
        code = np.where(patterns < len(self.code), self.code[np.minimum(patterns, len(self.code) - 1)], -1)
        out = np.zeros(len(patterns), np.int64)
        order = np.argsort(-lengths, kind="stable")
        at, longer = (starts + lengths - 1)[order], np.searchsorted(-lengths[order], -np.arange(lengths.max()), "left").tolist()
        # A row is a run and a place in it.
        run, row, match = (np.zeros(len(order), np.int64) for _ in range(3))
        place, runs = np.full(len(order), self.place_start[0]), len(self.start)
        for m in longer:
            run, row, place, match, at = run[:m], row[:m], place[:m], match[:m], at[:m]
            c = code[at]
            miss, lost = np.flatnonzero(self.symbol[run] != c), ()
            if len(miss):
                want = c[miss]
                near = np.searchsorted(self.keys, want * np.int64(runs) + run[miss])
                below, above = np.minimum(near, runs - 1), np.maximum(near - 1, 0)
                u, d = self.by_symbol[above], self.by_symbol[below]
                up_there, down_there = self.place_end[u], self.place_start[d]
                had, k = match[miss], len(miss)
                both = self.agree(np.tile(place[miss], 2), np.concatenate([up_there, down_there]), int(had.max()))
                lu = np.where((near > 0) & (self.symbol[u] == want), np.minimum(had, both[:k]), -1)
                ld = np.where((near < runs) & (self.symbol[d] == want), np.minimum(had, both[k:]), -1)
                up = lu >= ld
                run[miss] = np.where(up, u, d)
                row[miss] = np.where(up, self.size[u] - 1, 0)
                place[miss] = np.where(up, up_there, down_there)
                match[miss] = np.maximum(lu, ld)
                lost = miss[match[miss] < 0]  # the symbol isn't in the text
            row = row + self.to_place[run]
            run = self.to_run[run]
            over = np.flatnonzero(row >= self.size[run])
            while len(over):
                row[over] -= self.size[run[over]]
                run[over] += 1
                over = over[row[over] >= self.size[run[over]]]
            place -= 1
            place[place < 0] += self.n
            match += 1
            if len(lost):
                run[lost], row[lost], place[lost], match[lost] = 0, 0, self.place_start[0], 0
            out[at] = match
            at = at - 1
        return out


def _matched(data: list[bytes], older: np.ndarray, younger: np.ndarray, old_block: np.ndarray, young_block: np.ndarray, copies: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the younger texts, which of its windows one of the older texts of its block holds."""
    ends = len(older)  # symbols 0 .. ends - 1 end a text each
    names, block = np.unique(np.concatenate([old_block, young_block]), return_inverse=True)

    def coded(which: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(data[k]) for k in which.tolist()], np.int64)
        raw = np.frombuffer(b"".join([data[k] for k in which.tolist()]), np.uint8)
        return raw.astype(np.int64) + np.repeat(256 * block + ends, lengths), lengths

    text, lengths = coded(older, block[:ends])
    at = np.cumsum(lengths)
    index = RunIndex(np.insert(text, at, np.arange(ends)), np.insert(np.repeat(copies[older], lengths), at, copies[older]))
    symbols, lengths = coded(younger, block[ends:])
    first = np.cumsum(lengths) - lengths
    long = index.statistics(symbols, first, lengths) >= LENGTH
    for k, s, n in zip(younger.tolist(), first.tolist(), lengths.tolist()):
        yield k, long[s : s + max(0, n - LENGTH + 1)]


def _meeting(data: list[bytes], group: np.ndarray) -> np.ndarray:
    """Contexts with a window whose hash another one of their group has, too; others need no index to know that they share none."""
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    raw = np.frombuffer(b"".join(data), np.uint8)
    out = np.zeros(len(data), bool)
    if len(raw) >= LENGTH:
        at, which = _spread(np.cumsum(lengths) - lengths, np.maximum(lengths - LENGTH + 1, 0))
        h = mixed(strings(raw, LENGTH)[at] + group[which].astype(np.uint64) * np.uint64(_STEP))
        order = np.argsort(h)
        same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        out[which[order[same]]] = out[which[order[same + 1]]] = True
    return out


def older_matches(data: list[bytes], group: np.ndarray, number: np.ndarray, copies: np.ndarray) -> tuple[dict[int, np.ndarray], list[np.ndarray]]:
    """Windows of contexts that an older context of their group holds.

    data: contexts that differ within a group; number: by the age of the first copy, within the group; copies: how many
    there are. Gives the windows of the later copies, by context, and those of each context's first copy. All levels
    are in one index, with alphabets of their own.
    """
    several = np.flatnonzero(copies > 1)
    older, younger, blocks = [several], [several], [(group[several], group[several])]
    bit, many = 0, int(group.max()) + 1 if len(group) else 1
    meets = _meeting(data, group) if len(number) and number.max() > 0 else number > 0
    while len(number) and (int(number.max()) >> bit) > 0:
        # A block has the contexts of a group that agree in the bits above; it is told from those of other levels.
        _, block = np.unique(group * (int(number.max() >> (bit + 1)) + 1) + (number >> (bit + 1)), return_inverse=True)
        young = (number >> bit & 1 == 1) & meets
        old = np.flatnonzero((number >> bit & 1 == 0) & meets & np.isin(block, block[young]))
        young = np.flatnonzero(young)
        older.append(old)
        younger.append(young)
        blocks.append((many + block[old], many + block[young]))
        many, bit = many + int(block.max()) + 1, bit + 1
    later: dict[int, np.ndarray] = {}
    starts = [np.zeros(max(0, len(d) - LENGTH + 1), bool) for d in data]
    old, young = np.concatenate(older), np.concatenate(younger)
    if not len(young):
        return later, starts
    for n, (k, found_) in enumerate(_matched(data, old, young, np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks]), copies)):
        if n < len(several):
            later[k] = found_
        else:
            starts[k] |= found_
    return later, starts


@dataclass
class Contexts:
    """A bucket's contexts in order of age within their key; text: the number of their bytes in data."""

    key: np.ndarray
    sender: np.ndarray
    place: np.ndarray
    age: np.ndarray
    text: np.ndarray
    data: list[bytes]

    def sorted(self) -> "Contexts":
        order = np.lexsort((self.age, self.key))
        return Contexts(*(x[order] for x in (self.key, self.sender, self.place, self.age, self.text)), self.data)


def _read(hashes: np.ndarray, senders: np.ndarray, values: list[np.ndarray]) -> Contexts:
    place, ids, lengths, raw = values
    own = np.flatnonzero(lengths)
    ends, text, which, data = np.cumsum(lengths[own], dtype=np.int64), raw.tobytes(), np.empty(len(own), np.int64), []
    seen: dict[tuple[int, bytes], int] = {}
    for n, (h, a, b) in enumerate(zip(hashes[own].tolist(), (ends - lengths[own]).tolist(), ends.tolist())):
        which[n] = k = seen.setdefault((h, text[a:b]), len(data))
        if k == len(data):
            data.append(text[a:b])
    age = np.empty(len(hashes), np.int64)
    age[np.lexsort((place, senders, ids))] = np.arange(len(hashes))
    return Contexts(hashes, senders, place, age, which[np.cumsum(lengths > 0) - 1], data).sorted()


def _groups(c: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of c, sorted: the first copy of each text under its key, the copies' number, where keys' texts start and how many they are."""
    _, first, copies = np.unique(c.text, return_index=True, return_counts=True)
    order = np.argsort(first, kind="stable")
    first, copies = first[order], copies[order]
    key = c.key[first]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return first, copies, start, np.diff(np.append(start, len(key)))


def _cut(c: Contexts, texts: np.ndarray) -> Contexts:
    """The windows of some texts' contexts as contexts by themselves, by the hash of their bytes; those that occur once are left out."""
    entry = np.flatnonzero(np.isin(c.text, texts))
    size = np.array([len(d) - LENGTH + 1 for d in c.data], np.int64)[c.text[entry]]
    offset, which = _spread(np.zeros(len(entry), np.int64), size)
    own = {t: strings(np.frombuffer(c.data[t], np.uint8), LENGTH) for t in texts.tolist()}
    key = np.concatenate([np.zeros(0, np.uint64), *(own[t] for t in c.text[entry].tolist())])
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    good = count[back] > 1
    entry, offset, key = entry[which][good], offset[good], key[good]
    seen: dict[tuple[int, bytes], int] = {}
    text = np.array([seen.setdefault((h, c.data[t][o : o + LENGTH]), len(seen)) for h, t, o in zip(key.tolist(), c.text[entry].tolist(), offset.tolist())], np.int64)
    age = np.empty(len(entry), np.int64)
    age[np.lexsort((offset, c.age[entry]))] = np.arange(len(entry))
    return Contexts(key, c.sender[entry], c.place[entry] + offset, age, text, [k[1] for k in seen]).sorted()


def _older(c: Contexts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(senders, places, windows): what an older context under the same key holds."""
    first, copies, start, size = _groups(c)
    text = c.text[first]
    many = np.repeat(size > MANY, size)
    if many.any():
        yield from _older(_cut(c, text[many]))
    # A text that is alone under its key and has no copy meets nobody.
    use = (size <= MANY) & ((size > 1) | (np.maximum.reduceat(copies, start) > 1 if len(start) else size > 1))
    weights = np.array([len(c.data[t]) for t in text.tolist()], np.int64)
    batch = np.cumsum(np.add.reduceat(weights, start)[use]) // INDEX_BYTES if len(start) else start
    groups = np.flatnonzero(use)
    # The later copies of a text lie behind each other, by age.
    by_text = np.argsort(c.text, kind="stable")
    text_start = np.searchsorted(c.text[by_text], np.arange(len(c.data) + 1))
    for cut in np.split(groups, np.flatnonzero(np.diff(batch)) + 1) if len(groups) else []:
        members, group = _spread(start[cut], size[cut])
        later, starts = older_matches([c.data[t] for t in text[members].tolist()], group, members - start[cut][group], copies[members])
        # Runs of windows with an older copy, of first copies and of what all later copies share, found in one array.
        several = np.fromiter(later, np.int64, len(later))
        flags = [*starts, *later.values()]
        at = np.cumsum([0, *(len(f) + 1 for f in flags)])
        edge = np.flatnonzero(np.diff(np.concatenate([np.zeros(1, bool), *(x for f in flags for x in (f, _GAP))]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        of = np.searchsorted(at, begin, "right") - 1
        begin, windows = begin - at[of], end - begin
        own = of < len(starts)
        entry = first[members[of[own]]]
        yield c.sender[entry], c.place[entry] + begin[own], windows[own]
        its = text[members[several[of[~own] - len(starts)]]] if len(several) else np.zeros(0, np.int64)
        entry, which = _spread(text_start[its] + 1, text_start[its + 1] - text_start[its] - 1)
        entry = by_text[entry]
        yield c.sender[entry], c.place[entry] + begin[~own][which], windows[~own][which]


def _answer_contexts(hashes: np.ndarray, senders: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    parts = list(_older(_read(hashes, senders, values)))
    if parts:
        sender, place, windows = (np.concatenate(x) for x in zip(*parts))
        yield from by_group(sender, OLDER, place.astype(np.uint64), windows)


def _finish(group: Group) -> Iterator[pa.RecordBatch]:
    places, windows = group.answers(OLDER, 2)
    places = places.astype(np.int64)
    for k, chunk in group.chunks():
        own = places >> _CHUNK == k
        at, size = places[own] & (1 << _CHUNK) - 1, windows[own]
        edge = np.zeros(len(chunk.data) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size + LENGTH - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        n_gone, spans, kept = [], [], []
        for d in range(len(chunk.ids)):
            a, b = int(chunk.starts[d]), int(chunk.starts[d + 1]) - 1
            off = gone[a:b]
            n_gone.append(int(off.sum()))
            spans.append(np.flatnonzero(np.diff(np.concatenate([[False], off, [False]]).astype(np.int8))).tolist() if n_gone[-1] else [])
            kept.append(chunk.data[a:b][~off].tobytes() if n_gone[-1] else chunk.body(d))
        sizes = np.diff(chunk.starts) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk.ids, mask=~chunk.known), pa.array(sizes, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "edges", "kept"]
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, edges, kept): one row for each row of docs.

    A byte of the text's UTF-8 is removed if a string of 100 bytes covers it that also starts earlier: in a document
    with a smaller id, or earlier in the same one. Strings are judged on the input and never cross documents. kept has
    the remaining bytes, edges where removed runs start and end, by turns. A null text has no bytes. Null ids come
    after all others; of rows with the same id, any one may count as the earlier. An empty table gives an empty result;
    texts of any length are taken whole; other columns of docs, whatever their names, are never read.
    """
    chunks = pack(docs, id_col, text_col, CHUNK_BYTES, GROUP_BYTES)
    buckets = 2 * partitions(chunks)
    bits = _bits(chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    anchors = settled(answered(asked(chunks, _ask_anchors(bits, buckets)), _answer_repeats(ANCHORS), buckets))
    frequent = answered(asked(chunks, _ask_frequent(bits, buckets), anchors), _answer_repeats(WINDOWS), buckets)
    older = answered(asked(chunks, _ask_contexts(bits, buckets), anchors, frequent), _answer_contexts, buckets)
    return worked(chunks, _finish, "doc_id long, n_bytes long, n_removed long, edges array<long>, kept binary", older)
