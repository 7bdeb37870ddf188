"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Shallow trees, boosted in turn over the features, add up to one lookup table
for each feature; then trees with one cut on each of two features do the same for the pairs of features that explain
most of what is left. A text's score is the logistic function of the sum of what its bins hold in the tables, so
scoring is a few vectorised additions.

The model is fitted on the driver to a bounded sample of labelled rows (SAMPLE); everything else covers all rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bodies, column

#: Labelled rows at most that the model is fitted to: those with the smallest hash of their id.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 32, 8, 6, 120, 60, 0.15, 4.0
THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "bar", "symbol", "mark", "stop", "blank", "line_end",
    "high", "distinct_words", "repeated_lines", "line_words", "word_symbol_end", "upper_words", "short_words",
)
_CLASS = np.full(256, 10, np.int64)
for _i, _chars in enumerate((range(65, 91), range(48, 58), b"|", b"#$%&*@^~_=+<>{}[]\\/`", b"!?", b".,;:'\"-()", b" \t\r\x0b\x0c", b"\n", range(128, 256), range(97, 123))):
    _CLASS[list(_chars)] = _i
_ODD_ENDS = frozenset(b"#$%&*!|@^~=+<>")


def features(body: bytes) -> np.ndarray:
    """FEATURES of a whole text; an empty text has all zeros."""
    out = np.zeros(len(FEATURES))
    if not body:
        return out
    n = len(body)
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(body, np.uint8), minlength=256), minlength=11)
    words = body.split()
    w = max(1, len(words))
    lines = [x for x in body.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    out[:12] = (np.log1p(n), np.log1p(len(words)), (n - kinds[6] - kinds[7]) / w, kinds[0] / n, kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / n, kinds[8] / n)
    out[12:] = (
        len(set(words)) / w, 1 - len(set(lines)) / k, np.log1p(len(words) / k), sum(x[-1] in _ODD_ENDS for x in words) / w,
        sum(map(bytes.isupper, words)) / w, sum(len(x) <= 3 for x in words) / w,
    )
    return out


@dataclass
class Gam:
    """Lookup tables by feature and by pair of features; without labelled rows all scores are base's."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.cuts[j], x[:, j], "right")]
        for i, j, table in self.pairs:
            out += table[np.searchsorted(self.pair_cuts[i], x[:, i], "right"), np.searchsorted(self.pair_cuts[j], x[:, j], "right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Newton steps by bin of a tree with up to 2 ** depth leaves over ordered bins with gradients g, curvatures h."""
    gain = lambda a, b: a * a / (b + RIDGE)
    out = np.zeros(len(g))

    def grow(lo: int, hi: int, depth: int) -> None:
        sg, sh = g[lo:hi].sum(), h[lo:hi].sum()
        if depth and hi - lo > 1:
            left, lh = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            gains = gain(left, lh) + gain(sg - left, sh - lh)
            k = int(gains.argmax())
            if gains[k] > gain(sg, sh) + 1e-9:
                grow(lo, lo + k + 1, depth - 1)
                grow(lo + k + 1, hi, depth - 1)
                return
        out[lo:hi] = sg / (sh + RIDGE)

    grow(0, len(g), depth)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best single cut on each of two features: its gain, and the Newton steps by pair of bins."""
    best, out = -1.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for a, b in itertools.product(range(g.shape[0] - 1), range(g.shape[1] - 1)):
        parts = lambda c: (c[a, b], c[a, -1] - c[a, b], c[-1, b] - c[a, b], c[-1, -1] - c[a, -1] - c[-1, b] + c[a, b])  # noqa: B023, E731
        qg, qh = parts(cg), parts(ch)
        gain = sum(x * x / (y + RIDGE) for x, y in zip(qg, qh))
        if gain > best:
            best, step = gain, [x / (y + RIDGE) for x, y in zip(qg, qh)]
            out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = step
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    if not len(y):
        return Gam()
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(base=float(np.log(rate / (1 - rate))))
    if y.min() == y.max():
        return model
    model.cuts = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.cuts)]
    f = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j, bins in enumerate(at):
            if not len(model.cuts[j]):
                continue
            p = 1 / (1 + np.exp(-f))
            n = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins, y - p, n), np.bincount(bins, p * (1 - p), n))
            model.tables[j] += step
            f += step[bins]
    model.pair_cuts = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    wide = [j for j, c in enumerate(model.pair_cuts) if len(c)]
    at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.pair_cuts)]

    def steps(i: int, j: int) -> tuple[float, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        m, n = len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1
        cell = at[i] * n + at[j]
        return _quadrants(np.bincount(cell, y - p, m * n).reshape(m, n), np.bincount(cell, p * (1 - p), m * n).reshape(m, n))

    ranked = sorted(itertools.combinations(wide, 2), key=lambda ij: (-steps(*ij)[0], ij))[:PAIRS]
    tables = {ij: np.zeros((len(model.pair_cuts[ij[0]]) + 1, len(model.pair_cuts[ij[1]]) + 1)) for ij in ranked}
    for _ in range(PAIR_ROUNDS):
        for i, j in ranked:
            step = RATE * steps(i, j)[1]
            tables[i, j] += step
            f += step[at[i], at[j]]
    model.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return model


def _featured(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(b.as_py()) for b in column(batch, "body")]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "y"), pa.array(list(map(np.ndarray.tolist, x)), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    return rows.mapInArrow(run, "doc_id long, y int, x array<double>")


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves the remainder 0 by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Gam:
    """Fits a model to labelled rows that are not held out, sample of them at most; null labels don't count.

    The rows are those whose ids have the smallest hashes, and of a repeated id those with the smallest features, so
    the same tables give the same model. Of several labels of an id the largest counts.
    """
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("__id").isNotNull())
    known = known.filter(~held_out("__id")).groupBy("__id").agg(F.max("y").alias("y"))
    # The limit bounds what is broadcast.
    few = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = bodies(docs, id_col=id_col, text_col=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    met = rows.join(F.broadcast(few), F.col("doc_id") == F.col("__id")).select("doc_id", "y", "body")
    # Features are made where the texts are, and each task keeps sample rows at most; ids may repeat, so rows are bounded too.
    got = _featured(met).orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).toPandas()
    if not len(got):
        return Gam()
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy(float)
    order = np.lexsort((*x.T[::-1], y))
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability of label 1, one row for each row of docs; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(b.as_py()) for b in column(batch, "body")]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    rows = bodies(docs, id_col=id_col, text_col=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of docs.

    predicted is 1 from threshold on. Without usable labels every score is 0.5. Repeated rows and null ids are scored
    like any other; an empty table gives an empty result; columns besides the id and the text are never read.
    """
    scored = score(docs, learn(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with docs' own columns; scored in place, without a join."""
    model, names, schema = learn(docs, labels, id_col, text_col, label_col), docs.columns, docs.schema
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features((t.as_py() or "").encode()) for t in batch.column(at)]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.scores(x) >= threshold))

    return docs.mapInArrow(run, schema)
