"""Toxicity: non-negative positive-unlabelled learning.

Confirmed toxic examples (P) and unlabelled texts (U) are all that the classifier sees. Its features say which words
and word beginnings (``PREFIXES`` code points) a text holds, of those that are much more frequent in P than in the rest
of U. U holds toxic texts too, so no token is more than 1 / (their share) times as frequent in P as in U; that share is
read off the tokens themselves, and the cut is set relative to it.
A numpy linear model minimises the risk  prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))  with the sigmoid loss by
Adam; where the bracket turns negative, the step goes against it, as the method has it. The class prior is the share
of toxic among the training labels.

Fitting reads bounded samples (``positives`` and ``unlabelled`` rows); scoring covers every whole text.

Defined cases: a null text counts as empty and gets the score of a text without features; null labels are no labels;
without confirmed examples, or where no token tells them from the others (a table of toxic texts alone), every score is
0; a row with a null id is scored, is in no held-out fold, and isn't learned from; repeated rows get equal scores; other columns are passed over.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold, in_sample, map_arrow, materialise, slices, table

POSITIVES = 4_000
UNLABELLED = 12_000
FEATURES = 1_024
PREFIXES = (4, 5, 6)
#: A feature is in this many sampled toxic texts at least (of few such texts, in one of SPARSE), this many times as
#: frequent there as in the others, and more frequent by SURE standard deviations.
LEAST = 5
SPARSE = 20
SURE = 2.0
#: Token counts that a Python worker gathers before it passes them on.
HELD_TOKENS = 200_000
RATIO = 3.0
_WORD = re.compile(r"[^\W\d_]+")


def tokens_of(word: str) -> list[str]:
    """A word and its beginnings, marked as such."""
    return [f"{word}$", *(word[:n] for n in PREFIXES if len(word) >= n)]


def tokens(text: str) -> set[str]:
    return {t for w in set(_WORD.findall(text.lower())) for t in tokens_of(w)}


class Model:
    """Weights of tokens, scored for a batch of texts at once from (text, token) pairs."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.bias = bias
        self.at = {token: k for k, token in enumerate(weights)}
        self.weights = np.array(list(weights.values()))
        self.known: set[str] = set()
        self.hits: dict[str, list[int]] = {}

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.at:
            return np.zeros(len(texts))
        owner, token = [], []
        for i, text in enumerate(texts):
            words = set(_WORD.findall(text.lower()))
            for w in words - self.known:
                self.known.add(w)
                if hit := [self.at[x] for x in tokens_of(w) if x in self.at]:
                    self.hits[w] = hit
            for w in words & self.hits.keys():
                token += self.hits[w]
                owner += [i] * len(self.hits[w])
            if len(self.known) > HELD_TOKENS:
                self.known, self.hits = set(), {}
        # Words that share a beginning give it once.
        pairs = np.unique(np.array(owner, np.int64) * len(self.weights) + np.array(token, np.int64))
        total = self.bias + np.bincount(pairs // len(self.weights), self.weights[pairs % len(self.weights)], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_arrays(p: np.ndarray, u: np.ndarray, prior: float, epochs: int = 60, size: int = 1024) -> tuple[np.ndarray, float]:
    """Weights and bias by the non-negative risk; ``p`` and ``u`` are 0/1 rows of features."""
    n = p.shape[1]
    w, seed = np.zeros(n + 1), np.random.default_rng(11)
    w[n] = -1.0
    m, v, t = np.zeros(n + 1), np.zeros(n + 1), 0
    ones = lambda x: np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1).astype(float)
    steps = max(1, len(u) // size)
    for _ in range(epochs):
        order_p, order_u = seed.permutation(len(p)), seed.permutation(len(u))
        for part_p, part_u in zip(np.array_split(order_p, steps), np.array_split(order_u, steps), strict=True):
            if not len(part_p):
                part_p = order_p
            xp, xu = ones(p[part_p]), ones(u[part_u])
            # Sigmoid loss: l(z) = 1 / (1 + exp(z)), slope -s (1 - s).
            sp, su = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for x in (xp, xu))
            slope_p, slope_u = ((s * (1 - s))[:, None] for s in (sp, su))
            positive = -prior * (slope_p * xp).mean(0)
            rest = (slope_u * xu).mean(0) - prior * (slope_p * xp).mean(0)
            risk = su.mean() - prior * sp.mean()
            grad = positive + rest if risk >= 0 else -rest
            grad[:n] += 1e-5 * w[:n]
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:n], float(w[n])


def least_count(n_p: int) -> int:
    """In how many of ``n_p`` toxic texts a feature is at least."""
    return min(LEAST, max(2, -(-n_p // SPARSE)), n_p)


def toxic_share(seen: DataFrame, n_p: int, n_u: int) -> float | None:
    """The share of P's texts in U by the tokens (in_p, in_u): at most a token's rate in U over its rate in P, so the least of these.

    Rates are taken SURE standard deviations to the safe side. None where no token is frequent enough to tell.
    """
    low = (F.col("in_p") - SURE * F.sqrt("in_p")) / n_p
    high = (F.col("in_u") + SURE * F.sqrt("in_u") + 1) / n_u
    return seen.where(low > 0).agg(F.min(high / low)).first()[0]


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """A model from ``labels`` (doc_id, toxic) and the texts of ``docs``."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        n, ones = known.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
        prior = (ones or 0) / max(n, 1)
    toxic = known.where(F.col("toxic") == 1).select("doc_id")
    # Some thousands of ids.
    toxic = F.broadcast(bounded_sample(toxic, "doc_id", positives, 5).withColumn("toxic", F.lit(1)))
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    drawn = texts.join(toxic, "doc_id", "left").withColumn("drawn", in_sample(texts, "doc_id", unlabelled, 6))
    # One row an id, so that an id of many rows doesn't fill the sample; read once, written, and small.
    drawn = drawn.where(F.col("drawn") | (F.col("toxic") == 1)).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"), F.max("drawn").alias("drawn"))
    drawn = materialise(drawn, "toxic-sample")
    sample = drawn.where("toxic = 1").select(F.lit(1).alias("p"), "text").unionAll(drawn.where("drawn").select(F.lit(0).alias("p"), "text"))

    def spread(batches):
        seen = (Counter(), Counter())

        def flush():
            both = sorted(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *(pa.array([c[w] for w in both], pa.int64()) for c in seen[::-1])], names=["token", "in_p", "in_u"])
            for c in seen:
                c.clear()
            return out

        for b in slices(batches, limit=1 << 20):
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[p].update(tokens(t or ""))
            if len(seen[0]) + len(seen[1]) > HELD_TOKENS:
                yield flush()
        yield flush()

    sizes = dict(sample.groupBy("p").count().collect())
    n_p, n_u = sizes.get(1, 0), max(sizes.get(0, 0), 1)
    if not n_p:
        return Model({}, 0.0)
    seen = map_arrow(sample, spread, "token string, in_p long, in_u long").groupBy("token").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u"))
    seen = materialise(seen.where(F.col("in_p") >= least_count(n_p)), "toxic-tokens")
    share = toxic_share(seen, n_p, n_u)
    share = min(prior if share is None else share, 0.9)
    # RATIO times as frequent in P as in the other texts is so many times as frequent as in U.
    lift = 1 / (share + (1 - share) / RATIO)
    expected = F.col("in_u") * (n_p / n_u)
    chosen = seen.where((F.col("in_p") > lift * expected) & (F.col("in_p") - expected > SURE * F.sqrt(expected)))
    chosen = chosen.orderBy(F.col("in_p").desc(), "token").limit(FEATURES)
    names = [r.token for r in chosen.select("token").collect()]
    if not names:
        return Model({}, 0.0)
    index = {w: i for i, w in enumerate(names)}

    def mark(batches):
        for b in slices(batches):
            held = [sorted(index[w] for w in tokens(t or "") if w in index) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.list_(pa.int32()))], names=["p", "held"])

    rows = sorted((r.p, list(r.held)) for r in map_arrow(sample, mark, "p int, held array<int>").toLocalIterator())
    x = np.zeros((len(rows), len(names)), np.uint8)
    for i, (_, held) in enumerate(rows):
        x[i, held] = 1
    is_p = np.array([p for p, _ in rows], bool)
    w, bias = fit_arrays(x[is_p], x[~is_p], min(max(prior, 1e-3), 0.9))
    return Model(dict(zip(names, map(float, w), strict=True)), bias)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score([t or "" for t in b.column(1).to_pylist()]))], names=["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = predict(docs, fit(docs, labels.where(fold("doc_id", 5) != 0)))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
