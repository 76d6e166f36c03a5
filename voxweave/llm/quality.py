"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits shallow trees on one feature at a time, then on pairs of features, and adds their
steps to lookup tables; a score is a sum of looked-up values. The model is fitted on the driver from at
most `rows` labelled texts (a bound that does not grow with the corpus) and scores every text whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from voxweave.llm.arrow import pieces, small_batches, sums

FEATURES = ("length", "word_length", "upper", "digit", "symbol", "bar", "bang", "blank", "line", "distinct_words", "top_word", "wide", "stops", "commas", "distinct_lines", "long_words")
FULL, COARSE = 32, 8
#: The columns that score() adds.
OUT = {"held_out": StructField("held_out", BooleanType()), "score": StructField("score", DoubleType()), "predicted": StructField("predicted", IntegerType())}


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


BLANK = _mask(b" \t\n\x0b\x0c\r")
UPPER, LETTER, DIGIT = _mask(bytes(range(65, 91))), _mask(bytes([*range(65, 91), *range(97, 123), *range(128, 256)])), _mask(b"0123456789")
SYMBOL, BAR, BANG, STOP, COMMA, LINE = _mask(b"*#$%&@^~_=+<>{}[]\\`"), _mask(b"|"), _mask(b"!?"), _mask(b"."), _mask(b",;:"), _mask(b"\n")


def _spread(data: np.ndarray, inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(runs of each text, share of distinct runs, share of the commonest, share of runs over 24 bytes); a run is a stretch of `inside`."""
    lead = inside.copy()
    lead[1:] &= ~inside[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    lead[starts] = inside[starts]
    n = sums(lead, offsets)
    packed = data[inside]
    at = np.concatenate([(np.cumsum(inside) - inside)[lead], [len(packed)]]).astype(np.int64)
    code = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(packed)]).dictionary_encode().indices.to_numpy()
    doc = np.repeat(np.arange(len(n)), n)
    pair, count = np.unique(doc * np.int64(len(code) + 1) + code, return_counts=True)
    owner = pair // (len(code) + 1)
    most = np.zeros(len(n), np.int64)
    np.maximum.at(most, owner, count)
    long = np.bincount(doc, weights=np.diff(at) > 24, minlength=len(n))
    some = np.maximum(n, 1)
    return n, np.bincount(owner, minlength=len(n)) / some, most / some, long / some


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; of an empty text all are 0."""
    size = np.diff(offsets)
    share = lambda mask: sums(mask[data], offsets) / np.maximum(size, 1)
    words, distinct, top, long = _spread(data, ~BLANK[data], offsets)
    lines, own_lines, _, _ = _spread(data, ~LINE[data], offsets)
    some = np.maximum(words, 1)
    marks = lambda mask: sums(mask[data], offsets) / some
    letters = np.maximum(sums(LETTER[data], offsets), 1)
    return np.stack([np.log1p(size), size / some, sums(UPPER[data], offsets) / letters, share(DIGIT), share(SYMBOL), share(BAR), share(BANG), share(BLANK), lines / some, distinct, top, share(np.arange(256) >= 128), marks(STOP), marks(COMMA), own_lines, long], 1)


class Gam:
    """Lookup tables: value of each bin of each feature, and of each cell of chosen pairs of features."""

    def __init__(self, edges: list[np.ndarray], start: float):
        self.edges, self.start = edges, start
        self.one = np.zeros((len(edges), FULL))
        self.two: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.start)
        for j, table in enumerate(self.one):
            out += table[bins[:, j]]
        for a, b, table in self.two:
            out += table[bins[:, a] * COARSE // FULL, bins[:, b] * COARSE // FULL]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))


def _halves(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The gain of the best cut of a histogram, and the cut (0: none)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    i = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[i]), i + 1) if len(gain) and gain[i] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """The step of a shallow tree on one feature's bins."""
    at = _halves(g, h, ridge)[1] if depth else 0
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1, ridge), _tree(g[at:], h[at:], depth - 1, ridge)])


def _tree2(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The step of a tree on a pair's cells, one cut on each feature, and its gain."""
    step, gain, axis = np.zeros_like(g), 0.0, 0
    for ax in (0, 1):
        own, at = _halves(g.sum(1 - ax), h.sum(1 - ax), ridge)
        if at:
            out, total = np.zeros_like(g), own
            for part in (slice(None, at), slice(at, None)):
                idx = (part, slice(None)) if ax == 0 else (slice(None), part)
                gg, hh = g[idx].sum(ax), h[idx].sum(ax)
                more, _ = _halves(gg, hh, ridge)
                total += more
                leaf = _tree(gg, hh, 1, ridge)
                out[idx] = leaf[None, :] if ax == 0 else leaf[:, None]
            if total > gain:
                step, gain, axis = out, total, ax
    return step, gain


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, pairs: int = 6, rate: float = 0.2, ridge: float = 1.0) -> Gam:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, FULL + 1)[1:-1])) for j in range(x.shape[1])]
    p = (y.sum() + 1) / (len(y) + 2)
    model = Gam(edges, float(np.log(p / (1 - p))))
    bins = model.bins(x)
    f = np.full(len(y), model.start)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-f))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for j in range(x.shape[1]):
            g, h = slope()
            step = rate * _tree(np.bincount(bins[:, j], g, FULL), np.bincount(bins[:, j], h, FULL), 2, ridge)
            model.one[j] += step
            f += step[bins[:, j]]
    small = bins * COARSE // FULL

    def cells(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(small[:, a] * COARSE + small[:, b], v, COARSE * COARSE).reshape(COARSE, COARSE)

    g, h = slope()
    best = sorted(combinations(range(x.shape[1]), 2), key=lambda ab: -_tree2(cells(*ab, g), cells(*ab, h), ridge)[1])[:pairs]
    tables = {ab: np.zeros((COARSE, COARSE)) for ab in best}
    for _ in range(rounds // 2):
        for (a, b), table in tables.items():
            g, h = slope()
            step = rate * _tree2(cells(a, b, g), cells(a, b, h), ridge)[0]
            table += step
            f += step[small[:, a], small[:, b]]
    model.two = [(a, b, t) for (a, b), t in tables.items()]
    return model


def _remainder(name: str) -> F.Column:
    return F.crc32(F.col(name).cast("string")) % 4


def train(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> Gam | None:
    """A model of labels.quality from at most `rows` labelled texts (the first by hash) outside the held-out quarter; None without any."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(_remainder("doc_id") != 2).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # bounded by rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                x = features(data, offsets)
                yield pa.record_batch([part.column(0), part.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    made = texts.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, x array<double>")
    got = made.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("x").alias("x")).toPandas()  # a row a doc_id: at most `rows`
    if not len(got):
        return None
    x = np.array(got.x.tolist())
    y = got.quality.to_numpy(float)
    order = np.lexsort((*x.T, y, got.doc_id))
    return fit(x[order], y[order])


def _scores(model: Gam | None, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for part, data, offsets in pieces(batch, "text"):
        yield part, model.score(features(data, offsets)) if model else np.ones(part.num_rows)


def score(docs: DataFrame, labels: DataFrame, keep: float = 0.7, rows: int = 20_000) -> DataFrame:
    """docs with held_out, score and predicted, for every row; columns of docs with these names give way to them.

    predicted is 1 where score >= keep. Null text counts as empty; very long texts are read whole. Without labelled
    rows to learn from, every score is 1. Only texts are inputs of a score. A null doc_id is not held out. Repeated rows
    have equal scores, and a label counts once. An empty table gives no rows.
    """
    model = train(small_batches(docs), labels, rows)
    at = [i for i, c in enumerate(docs.columns) if c not in OUT]
    key = docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s in _scores(model, batch):
                held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in part.column(key).to_pylist()]
                cols = [part.column(i) for i in at]
                yield pa.record_batch([*cols, pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= keep).astype(np.int32))], [*(part.schema.names[i] for i in at), *OUT])

    return docs.mapInArrow(run, StructType([*(docs.schema.fields[i] for i in at), *OUT.values()]))


def accepted(docs: DataFrame, labels: DataFrame, keep: float = 0.7, rows: int = 20_000) -> DataFrame:
    """The rows of docs that score() predicts 1 for, with just their own columns."""
    model = train(small_batches(docs), labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s in _scores(model, batch):
                yield part.filter(pa.array(s >= keep))

    return docs.mapInArrow(run, docs.schema)
