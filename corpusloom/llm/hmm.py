"""A hidden Markov language model, trained by Baum-Welch counts that are aggregated across partitions.

Tokens are words and one end for each text. Frequent words have symbols of their own; all others share symbols by
their last bytes, and within such a class a word has its smoothed share of the class's tokens. So a text's
probability is that of its symbols under the model, times the shares of its class words.

Counts of words cover all training texts. The words that may be broadcast are bounded in number and length
(TABLE_WORDS, WORD_BYTES); the counts of all other words reach the texts through a join. The model starts from seeded
noise. All training texts are turned into symbols once, and every round of Baum-Welch reads all of them, whole: each
partition sends its expected counts of transitions and emissions, which are summed by key, and its texts' likelihood.
Rounds end when the mean log10 probability of a training token grows by less than GAIN, or after ROUNDS. Training works
in single precision but for sums; scoring runs the scaled forward recursion over whole texts in double precision.

Texts are worked through side by side, a step at a time. So that a long text doesn't keep the others waiting, texts are
cut into segments of SPAN tokens that carry each other's messages: a segment's tokens make one matrix, their product
from state to state; with these the messages at all segments' edges are found, and then all segments are worked
through side by side. That is the same recursion in another order of its products, and memory is bounded whatever a
text's length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bodies, column, settled, slices

STATES, ROUNDS, GAIN, SYMBOL_WORDS, CLASSES = 8, 14, 0.002, 8192, 1024
TABLE_WORDS, WORD_BYTES = 262_144, 64
#: Tokens of a segment, and tokens that are worked through at once.
SPAN, _AT_ONCE = 1024, 1_200_000
#: Tokens of training texts that a task holds at once, or one text if it has more.
_HELD_TOKENS = 1_000_000
_FLUSH = 400_000


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves the remainder 1 by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(body: bytes) -> list[bytes]:
    """The words of a text with A-Z in lower case; the end is not among them."""
    return body.lower().split()


def word_counts(training: DataFrame) -> DataFrame:
    """training (body) to (word, n): how often each word occurs; counted in each partition before anything is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for body in column(batch, "body"):
                held.update(tokens(body.as_py()))
                if len(held) > _FLUSH:
                    yield out()
                    held.clear()
        yield out()

    return training.select("body").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


class Words(dict):
    """Word to its place in the table; a word that is not there gives -1 less its class."""

    def __missing__(self, word: bytes) -> int:
        return -1 - _class(word)


@dataclass
class Table:
    """What tasks know of words: the frequent ones in falling order of their counts, and sums over the classes."""

    words: list[bytes]
    counts: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    texts: int
    all_tokens: int
    all_words: int
    own: int  # the first so many words have symbols of their own

    def ready(self) -> "Table":
        """Builds what is not sent: the dictionary and arrays by place."""
        if not hasattr(self, "place"):
            self.place = Words(zip(self.words, range(len(self.words))))
            n = len(self.words)
            classes = np.fromiter(map(_class, self.words), np.int64, n)
            self.symbol = np.where(np.arange(n) < self.own, np.arange(n), self.own + classes)
            self.end = self.own + CLASSES
            self.log_count = np.log10(self.counts + 0.5)
            share = self.class_tokens + 0.5 * (self.class_words + 1)
            self.log_share = np.log10(share)
            self.log_all = float(np.log10(self.all_tokens + 0.5 * (self.all_words + 1)))
        return self

    def kind(self) -> np.dtype:
        """What holds a symbol."""
        return np.dtype("<u2" if self.end + 1 <= 1 << 16 else "<u4")

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def symbols(self, places: np.ndarray) -> np.ndarray:
        """Of a text's words, with the end."""
        out = np.full(len(places) + 1, self.end, np.int64)
        rare = places < 0
        out[:-1] = self.symbol[np.where(rare, 0, places)] if len(self.symbol) else 0
        out[:-1][rare] = self.own - 1 - places[rare]
        return out


@dataclass
class Model:
    first: np.ndarray
    move: np.ndarray  # from state, to state
    emit: np.ndarray  # symbol, state


def _lengths(lengths: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Sequences by falling length, and how many are longer than 0, 1, 2, ..."""
    order = np.argsort(-lengths, kind="stable")
    return order, np.searchsorted(-lengths[order], -np.arange(lengths.max() if len(lengths) else 0), "left").tolist()


@dataclass
class Segments:
    """Texts' symbols cut into segments, in order; every text has a symbol at least."""

    text: np.ndarray
    nth: np.ndarray
    start: np.ndarray
    length: np.ndarray
    last: np.ndarray  # of its text

    @classmethod
    def of(cls, lengths: np.ndarray, span: int) -> "Segments":
        n = -(-lengths // span)
        text = np.repeat(np.arange(len(lengths)), n)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(np.cumsum(lengths) - lengths, n) + nth * span
        return cls(text, nth, start, np.minimum(span, lengths[text] - nth * span), nth == n[text] - 1)

    def blocks(self, which: np.ndarray | None = None) -> list[np.ndarray]:
        """Segments, or which of them, as many at once as have some tokens."""
        which = np.arange(len(self.text)) if which is None else which
        if not len(which):
            return []
        return np.split(which, np.flatnonzero(np.diff(np.cumsum(self.length[which]) // _AT_ONCE)) + 1)


def _products(model: Model, symbols: np.ndarray, cut: Segments, which: np.ndarray, kind: type) -> np.ndarray:
    """(segment, state before it, state at its end): what a segment's tokens make of a message, up to a factor each.

    Before a text's first segment stands no step, so there the state before is that of its first token.
    """
    k = len(model.first)
    order, longer = _lengths(cut.length[which])
    which = which[order]
    emit, move = model.emit.astype(kind), model.move.astype(kind)
    out = np.tile(np.eye(k, dtype=kind), (len(which), 1, 1))
    fresh = cut.nth[which] == 0
    for t, m in enumerate(longer):
        now = out[:m]
        stepped = (now.reshape(-1, k) @ move).reshape(m, k, k)
        if not t:
            stepped[fresh[:m]] = now[fresh[:m]]
        stepped *= emit[symbols[cut.start[which[:m]] + t]][:, None, :]
        if t % 4 == 3 or t == len(longer) - 1:
            stepped /= stepped.sum(axis=(1, 2))[:, None, None]
        out[:m] = stepped
    back = np.empty_like(out)
    back[order] = out
    return back


def _messages(model: Model, symbols: np.ndarray, cut: Segments, kind: type, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment, the state's chances before it (a text's first: those of its first state) and what follows it says of its end."""
    k, n = len(model.first), len(cut.text)
    before, after = np.tile(model.first.astype(kind)[:, None], (1, n)), np.ones((k, n), kind)
    several = np.flatnonzero(~cut.last | (cut.nth > 0))
    if len(several):
        made = np.concatenate([_products(model, symbols, cut, own, kind) for own in cut.blocks(several)])
        place = np.full(n, -1)
        place[several] = np.arange(len(several))
        by_nth = [np.flatnonzero(cut.nth == i) for i in range(1, int(cut.nth.max()) + 1)] if n < 1 << 12 else np.split(o := np.argsort(cut.nth, kind="stable"), np.searchsorted(cut.nth[o], np.arange(1, int(cut.nth.max()) + 1)))[1:]
        for own in by_nth:
            x = np.einsum("ks,skj->js", before[:, own - 1], made[place[own - 1]])
            before[:, own] = x / x.sum(axis=0)
        for own in reversed(by_nth) if backward else ():
            x = np.einsum("skj,js->ks", made[place[own]], after[:, own])
            after[:, own - 1] = x / x.sum(axis=0)
    return before, after


def log_likelihood(model: Model, symbols: np.ndarray, lengths: np.ndarray, span: int | None = None) -> np.ndarray:
    """log10 probabilities of whole sequences by the scaled forward recursion, in double precision."""
    cut = Segments.of(lengths, span or SPAN)
    before, _ = _messages(model, symbols, cut, np.float64, False)
    emit, move = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    total = np.zeros(len(cut.text))
    for own in cut.blocks():
        order, longer = _lengths(cut.length[own])
        own = own[order]
        alpha = np.where(cut.nth[own] == 0, before[:, own], move @ before[:, own])
        for t, m in enumerate(longer):
            alpha = (move @ alpha[:, :m] if t else alpha) * emit.take(symbols[cut.start[own[:m]] + t], axis=1)
            scale = alpha.sum(axis=0)
            alpha /= scale
            total[own[:m]] += np.log10(scale)
    return np.bincount(cut.text, total, len(lengths))


def expected(model: Model, symbols: np.ndarray, lengths: np.ndarray, span: int | None = None, kind: type = np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts (first, move, emit) of whole sequences, and the log10 probability of them all."""
    k = len(model.first)
    cut = Segments.of(lengths, span or SPAN)
    before, after = _messages(model, symbols, cut, kind, True)
    emit, move = np.ascontiguousarray(model.emit.T, kind), np.ascontiguousarray(model.move, kind)
    forward = np.ascontiguousarray(move.T)
    first, moved, counts, total = np.zeros(k), np.zeros((k, k)), np.zeros((k, len(model.emit))), 0.0
    for own in cut.blocks():
        order, longer = _lengths(cut.length[own])
        own = own[order]
        fresh, n = cut.nth[own] == 0, np.concatenate([[0], np.cumsum(longer)])
        which = np.repeat(np.arange(len(longer)), longer)
        s = symbols[cut.start[own[np.arange(n[-1]) - n[:-1][which]]] + which]
        weight = emit.take(s, axis=1)
        gamma = np.empty_like(weight)
        x = np.where(fresh, before[:, own], forward @ before[:, own])
        for t, m in enumerate(longer):
            a, b = n[t], n[t + 1]
            np.multiply(forward @ x[:, :m] if t else x, weight[:, a:b], out=gamma[:, a:b])
            x = gamma[:, a:b]
            scale = x.sum(axis=0)
            total += float(np.log10(scale, dtype=np.float64).sum())
            scale = 1 / scale
            x *= scale
            weight[:, a:b] *= scale
        beta = np.zeros((k, 0), kind)
        for t in range(len(longer) - 1, -1, -1):
            a, b = n[t], n[t + 1]
            x, m = gamma[:, a:b], beta.shape[1]
            here = np.empty((k, b - a), kind)
            if m:
                ahead = beta * weight[:, b : b + m]
                moved += x[:, :m] @ ahead.T
                here[:, :m] = move @ ahead
            # Segments that end here: what follows them, so that chances add up to one.
            end = after[:, own[m : b - a]]
            here[:, m:] = end / (end * x[:, m:]).sum(axis=0)
            x *= here
            beta = here
        later = ~fresh
        moved += before[:, own[later]] @ (beta * weight[:, : len(own)])[:, later].T
        first += gamma[:, : len(own)][:, fresh].sum(axis=1, dtype=np.float64)
        for q in range(k):
            counts[q] += np.bincount(s, gamma[q], counts.shape[1])
    return first, moved * model.move, counts.T, total


def updated(first: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Model:
    """The model of expected counts; prior, how common each symbol is, keeps every emission above zero."""
    over = lambda x: x / x.sum(axis=-1, keepdims=True)
    emit = emit + prior[:, None]
    return Model(over(first + 0.5), over(move + 0.5), emit / emit.sum(axis=0))


def _prior(table: Table) -> np.ndarray:
    n = np.concatenate([table.counts[: table.own], table.class_tokens, [table.texts]]) + 0.5
    return n / n.sum()


def start(table: Table) -> Model:
    """A first model: noise round the symbols' shares."""
    rng, prior = np.random.default_rng(7), _prior(table)
    emit = prior[:, None] * rng.uniform(0.5, 1.5, (len(prior), STATES))
    move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))


def tabulate(counts: DataFrame, texts: int, table_words: int = TABLE_WORDS, symbol_words: int = SYMBOL_WORDS) -> Table:
    """What tasks need of counts (word, n), settled. Frequent words are those above a bound that leaves table_words at most."""
    level = F.floor(F.log2("n") * 16).cast("int")
    short = counts.filter(F.octet_length("word") <= WORD_BYTES)
    most, least = 0, 0
    for r in sorted(short.groupBy(level.alias("level")).count().collect(), reverse=True):
        if most + r["count"] > table_words:
            least = r["level"] + 1
            break
        most += r["count"]
    got = short.filter(level >= least).toPandas()
    got = got.sort_values(["n", "word"], ascending=[False, True], kind="stable")
    end = F.substring("word", F.greatest(F.octet_length("word") - 2, F.lit(1)), F.lit(3))
    sums = counts.groupBy((F.crc32(end) % CLASSES).cast("int").alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    total, distinct = sum(r["n"] for r in sums), sum(r["v"] for r in sums)
    table = Table(list(map(bytes, got["word"])), got["n"].to_numpy(np.int64), np.zeros(CLASSES), np.zeros(CLASSES), texts, total + texts, distinct + (texts > 0), min(len(got), symbol_words))
    for r in sums:
        table.class_tokens[r["c"]], table.class_words[r["c"]] = r["n"], r["v"]
    # Words with symbols of their own are no class's.
    for word, n in zip(table.words[: table.own], table.counts[: table.own].tolist()):
        table.class_tokens[_class(word)] -= n
        table.class_words[_class(word)] -= 1
    return table


def _held(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[list[np.ndarray]]:
    """Texts' symbols, some hundred thousand tokens at once."""
    held, n = [], 0
    for batch in slices(batches, 1 << 22, "symbols"):
        for b in column(batch, "symbols"):
            x = np.frombuffer(b.as_buffer(), kind)
            if held and n + len(x) > _HELD_TOKENS:
                yield held
                held, n = [], 0
            held.append(x)
            n += len(x)
    if held:
        yield held


def learn(training: DataFrame, counts: DataFrame, rounds: int = ROUNDS, gain: float = GAIN, **sizes: int) -> tuple[Table, Model, list[float]]:
    """Table and model of training (body), and the mean log10 probability of a symbol before each round over all texts."""
    table = tabulate(counts, training.count(), **sizes)
    known = training.sparkSession.sparkContext.broadcast(replace(table))
    table.ready()
    kind = table.kind()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value.ready()
        for batch in slices(batches):
            found = [words.symbols(words.places(tokens(b.as_py()))).astype(kind).tobytes() for b in column(batch, "body")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["symbols"])

    return table, *fit(settled(training.select("body").mapInArrow(code, "symbols binary")), table, rounds, gain)


def fit(coded: DataFrame, table: Table, rounds: int = ROUNDS, gain: float = GAIN) -> tuple[Model, list[float]]:
    """The model of coded (symbols), settled, and the mean log10 probability of a symbol before each round."""
    model = start(table)
    k, size, prior, kind = STATES, table.end + 1, _prior(table), table.kind()
    means: list[float] = []
    for _ in range(rounds if table.texts else 0):
        sent = coded.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = sent.value  # noqa: B023
            sums = [np.zeros(k), np.zeros((k, k)), np.zeros((size, k)), np.zeros(1)]
            for texts in _held(batches, kind):
                for s, x in zip(sums, expected(now, np.concatenate(texts), np.array(list(map(len, texts)), np.int64))):
                    s += x
            flat = np.concatenate([s.ravel() for s in sums])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["i", "v"])

        got = coded.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        flat = np.zeros(k + k * k + size * k + 1)
        flat[got["i"].to_numpy()] = got["v"].to_numpy()
        cut = np.split(flat, [k, k + k * k, len(flat) - 1])
        model = updated(cut[0], cut[1].reshape(k, k), cut[2].reshape(size, k), prior)
        means.append(float(cut[3][0]) / table.all_tokens)
        if len(means) > 1 and means[-1] - means[-2] < gain:
            break
    return model, means


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, gain: float = GAIN, **sizes: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each row of docs.

    The model learns from rows that are not held out. base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))) over the
    tokens, score is the model's log10 probability of the text. A null text is empty: its only token is the end. A
    repeated row counts as a text of its own, a null id is not held out. sizes: table_words and symbol_words of
    tabulate(). If there is nothing to learn from, all symbols' chances are even. An empty table gives an empty result;
    texts of any length are taken whole; other columns of docs, whatever their names, are never read.
    """
    rows = bodies(docs, id_col=id_col, text_col=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.withColumn("held_out", held_out("doc_id"))
    training = rows.filter(~F.col("held_out")).select("body")
    counts = settled(word_counts(training))
    table = tabulate(counts, training.count(), **sizes)
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(replace(table))
    table.ready()
    kind = table.kind()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts are cut into words once: symbols, what the table knows of the score, and words that it doesn't have."""
        words = known.value.ready()
        end = float(np.log10((words.texts + 0.5)))
        for batch in slices(batches):
            symbols, base, share, seen, size, rare, times, ends = [], [], [], [], [], [], [], [0]
            for body in column(batch, "body"):
                text = tokens(body.as_py())
                at = words.places(text)
                s = words.symbols(at)
                symbols.append(s.astype(kind).tobytes())
                size.append(len(s))
                inside = at[at >= 0]
                base.append(float(words.log_count[inside].sum()) + end - len(s) * words.log_all)
                classed = s[(s >= words.own) & (s < words.end)] - words.own
                share.append(float(words.log_count[inside[inside >= words.own]].sum()) - float(words.log_share[classed].sum()))
                seen.append(len(inside) + (words.texts > 0))
                odd = Counter(text[j] for j in np.flatnonzero(at < 0).tolist())
                rare.extend(odd.keys())
                times.extend(odd.values())
                ends.append(len(rare))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(rare, pa.binary()), pa.array(times, pa.int64()))]
            cols = [pa.array(symbols, pa.binary()), pa.array(size, pa.int64()), pa.array(seen, pa.int64()), pa.array(base), pa.array(share), *lists]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), *cols], ["doc_id", "held_out", "symbols", "n_tokens", "n_known", "base", "share", "rare", "times"])

    coded = rows.select("doc_id", "held_out", "body").mapInArrow(read, "doc_id long, held_out boolean, symbols binary, n_tokens long, n_known long, base double, share double, rare array<binary>, times array<long>")
    coded = settled(coded.withColumn("uid", F.monotonically_increasing_id()))
    model, _ = fit(settled(coded.filter(~F.col("held_out")).select("symbols")), table, rounds, gain)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sent.value
        for batch in slices(batches, 1 << 21, "symbols"):
            symbols = np.frombuffer(b"".join(column(batch, "symbols").to_pylist()), kind)
            whole = log_likelihood(now, symbols, np.asarray(column(batch, "n_tokens"))) + np.asarray(column(batch, "share"))
            own_id = np.asarray(column(batch, "uid"))
            # A text's own row has a key that no word can be, so that these rows spread like words.
            key = pa.array([b"\n%d" % u for u in own_id.tolist()], pa.binary())
            own = [column(batch, c) for c in ("uid", "doc_id", "held_out", "n_tokens", "n_known", "base")]
            yield pa.RecordBatch.from_arrays([*own[:3], key, pa.nulls(batch.num_rows, pa.int64()), *own[3:], pa.array(whole)], _SCORED)
            rare = column(batch, "rare")
            r = len(rare.flatten())
            if r:
                blank = lambda t: pa.nulls(r, t)  # noqa: B023, E731
                of = pa.array(np.repeat(own_id, np.asarray(rare.value_lengths())))
                yield pa.RecordBatch.from_arrays([of, blank(pa.int64()), blank(pa.bool_()), rare.flatten(), column(batch, "times").flatten(), *map(blank, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], _SCORED)

    parts = coded.mapInArrow(run, "uid long, doc_id long, held_out boolean, word binary, times long, n_tokens long, n_known long, base double, score double")
    met = parts.join(counts.withColumnRenamed("word", "of"), F.col("word") == F.col("of"), "left")
    worth = F.coalesce(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)), F.lit(0.0))
    return met.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("times"))), F.lit(0))).alias("n_known"),
        F.lit(table.all_tokens).cast("long").alias("train_tokens"), (F.max("base") + worth).alias("base_score"), (F.max("score") + worth).alias("score"),
    ).drop("uid")


_SCORED = ["uid", "doc_id", "held_out", "word", "times", "n_tokens", "n_known", "base", "score"]
