"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a row of statistics (``FEATURES``). Cyclic boosting fits one shallow tree at a time to the bins of a
single feature and adds its leaves to that feature's lookup table; then trees over two features do the same for the
pairs whose joint bins explain most of what is left. A score is the sigmoid of the sum of looked-up bins.

The model is fitted on the driver from the statistics (no texts) of a bounded sample of labelled rows
(``train_rows``, 20,000 unless told otherwise). Scoring covers every whole text.

Defined cases: a null text counts as empty and is scored; null labels are no labels, of several labels of a document
the largest counts; without labels of both kinds every score is the share of ones (0.5 without labels); a row with a null id
is scored and is in no held-out fold; other columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold, map_arrow, slices, table

TRAIN_ROWS = 20_000
BINS = 32
ROUNDS = 120
PAIRS = 6
PAIR_ROUNDS = 60
RATE = 0.15

#: Classes of bytes whose share of the text is a feature.
_CLASSES = ("lower", "upper", "digit", "stop", "bar", "mark", "line", "space", "other")
FEATURES = (*_CLASSES, "log_bytes", "log_words", "word_bytes", "distinct_words", "distinct_lines", "longest_line", "marked_words")


def _class_of() -> np.ndarray:
    out = np.full(256, 8, np.uint8)
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"?-()", "|", "!#$%&*+/<=>@[\\]^_`{}~", "\n\r", " \t")):
        out[np.frombuffer(chars.encode(), np.uint8)] = k
    return out


_CLASS = _class_of()


def features(texts: list[str]) -> np.ndarray:
    """A row of ``FEATURES`` for every text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    kind = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(len(raw)), size)
    counts = np.bincount(owner * len(_CLASSES) + kind, minlength=len(raw) * len(_CLASSES)).reshape(len(raw), -1)
    out = np.zeros((len(raw), len(FEATURES)))
    n = np.maximum(size, 1)
    out[:, : len(_CLASSES)] = counts / n[:, None]
    out[:, len(_CLASSES)] = np.log1p(size)
    for i, t in enumerate(texts):
        words, lines = t.split(), t.split("\n")
        k = len(words)
        out[i, len(_CLASSES) + 1 :] = (
            np.log1p(k),
            size[i] / (k + 1),
            len(set(words)) / k if k else 1.0,
            len(set(lines)) / len(lines),
            max(map(len, lines)) / (len(t) + 1),
            sum(not w[-1].isalnum() for w in words) / k if k else 0.0,
        )
    return out


@dataclass
class Model:
    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: np.ndarray | None = None
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        if self.tables is not None:
            b = self.bins(x)
            for j in range(b.shape[1]):
                total += self.tables[j, b[:, j]]
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Best cut of a line of bins by gradient and hessian sums: (bins on the left, gain)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl > 1) & (hr > 1), gl**2 / (hl + 1) + gr**2 / (hr + 1), -1.0)
    at = int(gain.argmax())
    return at + 1, float(gain[at] - g.sum() ** 2 / (h.sum() + 1))


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The leaves of a shallow tree over a line of bins."""
    if depth and len(g) > 1:
        cut, gain = _split(g, h)
        if gain > 1e-3:
            return np.r_[_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)]
    return np.full(len(g), g.sum() / (h.sum() + 1))


def _tree2(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The leaves of a tree over two features: a cut of the first, then one of the second on either side."""
    cut, _ = _split(g.sum(1), h.sum(1))
    return np.concatenate([np.tile(_tree(s.sum(0), t.sum(0), 1), (len(s), 1)) for s, t in ((g[:cut], h[:cut]), (g[cut:], h[cut:])) if len(s)])


def fit_arrays(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Model(float(np.log(rate / (1 - rate))))
    rate = y.mean()
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    m = Model(float(np.log(rate / (1 - rate))), edges, np.zeros((x.shape[1], BINS)))
    b = m.bins(x)
    total = np.full(len(y), m.bias)

    def sums(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return np.bincount(code, y - p, n), np.bincount(code, p * (1 - p), n)

    for _ in range(ROUNDS):
        for j in range(x.shape[1]):
            step = RATE * _tree(*sums(b[:, j], BINS))
            m.tables[j] += step
            total += step[b[:, j]]
    gains = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            g, h = sums(b[:, i] * BINS + b[:, j], BINS * BINS)
            g, h = (v.reshape(4, BINS // 4, 4, BINS // 4).sum((1, 3)) for v in (g, h))
            gains.append(((g**2 / (h + 1)).sum(), i, j))
    for _, i, j in sorted(gains, reverse=True)[:PAIRS]:
        m.pairs.append((i, j))
        m.pair_tables.append(np.zeros((BINS, BINS)))
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(m.pairs, m.pair_tables, strict=True):
            g, h = sums(b[:, i] * BINS + b[:, j], BINS * BINS)
            step = RATE * _tree2(g.reshape(BINS, BINS), h.reshape(BINS, BINS))
            t += step
            total += step[b[:, i], b[:, j]]
    return m


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, train_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most about ``train_rows`` labelled documents."""
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    # About train_rows narrow rows: a bound that doesn't grow with the tables.
    known = F.broadcast(bounded_sample(known, "doc_id", train_rows, 3))

    def run(batches):
        for b in slices(batches):
            x = features([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in x.T)], names=["y", *FEATURES])

    rows = map_arrow(docs.select("doc_id", "text").join(known, "doc_id").select("y", "text"), run, "y int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    rows = rows.sort_values(list(rows.columns))
    return rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    return fit_arrays(*labelled_features(docs, labels, label, train_rows))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(features([t or "" for t in b.column(1).to_pylist()])))], names=["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = predict(docs, fit(docs, labels.where(fold("doc_id", 4) != 2)))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
