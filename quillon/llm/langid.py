"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams of code points are gathered by language from a bounded sample of labelled rows
(``train_rows``, 20,000 unless told otherwise) and become a matrix of log probabilities, which is broadcast; it has
``BUCKETS`` columns an order, or, with so many languages that it would pass ``CELLS``, as many fewer as keep it below. Texts are scored in numpy, a few MB at a time, whole.

Defined cases: a null text or one without a letter gets ``und`` and score 0; a null language is no label; without any
label all get ``und``; a row with a null id is predicted, is in no held-out fold, and isn't learned from; repeated rows get equal results;
other columns are passed over.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold, map_arrow, slices, table

#: Hash buckets for each n-gram order.
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Cells of the matrix at most (64 MB): 170 languages with all buckets.
CELLS = 1 << 24
TRAIN_ROWS = 20_000
#: More grams than these don't make a prediction surer.
SURE = 64
UNKNOWN = "und"
_WORDLY = re.compile(r"[^\W\d_]")


def lettered(text: str | None) -> bool:
    """Whether the text holds a letter (Unicode's category L)."""
    return any(m[0].isalpha() for m in _WORDLY.finditer(text or ""))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Start and end of each text's gram positions, and for each order the bucket at every position.

    Each text stands between one blank before and two after, so that no gram reaches into another text.
    """
    padded = [f" {t.lower()}  " for t in texts]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    ends = np.cumsum(size)
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(codes), np.uint64)
    for k, n in enumerate(ORDERS):
        h[: len(codes) - n + 1] = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(1)
        m = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((m >> np.uint64(49)).astype(np.int32) + np.int32(k * BUCKETS))
    return ends - size, ends - 2, out


def train_counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n of every gram of ``docs`` (lang, text)."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in slices(batches):
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            starts, ends, grams = _grams([t or "" for t in b.column(1).to_pylist()])
            for lang in set(langs):
                keep = np.zeros(int(ends[-1]) + 3, np.int8)
                mine = langs == lang
                np.add.at(keep, starts[mine], 1)
                np.add.at(keep, ends[mine], -1)
                keep = np.cumsum(keep[: len(grams[0])]).astype(bool)
                into = total.setdefault(lang, np.zeros(BUCKETS * len(ORDERS), np.int64))
                for g in grams:
                    into += np.bincount(g[keep], minlength=len(into))
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    return map_arrow(docs.select("lang", "text"), count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _fewer(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Places among ``buckets`` an order of places among ``BUCKETS``; buckets side by side fall together."""
    return grams // (BUCKETS // buckets)


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", cells: int = CELLS) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities, from at most about ``train_rows`` rows of ``docs`` with a language."""
    known = docs.select(F.col(id_col).alias("doc_id"), "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    got = train_counts(bounded_sample(known, "doc_id", train_rows, 7)).toPandas()
    langs = sorted(set(got["lang"]))
    buckets = BUCKETS
    while buckets > 1 and len(langs) * len(ORDERS) * buckets > cells:
        buckets //= 2
    n = np.ones((len(langs), buckets * len(ORDERS)))
    np.add.at(n, (got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64), _fewer(got["bucket"].to_numpy(dtype=np.int64), buckets)), got["n"].to_numpy())
    parts = n.reshape(len(langs), len(ORDERS), buckets)
    return langs, np.log(parts / parts.sum(axis=2, keepdims=True)).reshape(n.shape).astype(np.float32)


def _judge(texts: list[str | None], langs: list[str], logp: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    told = np.array([lettered(t) for t in texts], bool)
    starts, ends, grams = _grams([t or "" for t in texts])
    if logp.shape[1] < BUCKETS * len(ORDERS):
        grams = [_fewer(g, logp.shape[1] // len(ORDERS)) for g in grams]
    cuts = np.stack([starts, ends], axis=1).ravel()
    like = np.zeros((len(langs), len(texts)))
    for k, row in enumerate(logp):
        for g in grams:
            like[k] += np.add.reduceat(row[g], cuts, dtype=np.float64)[::2]
    like *= np.minimum(ends - starts, SURE) / (ends - starts) / len(ORDERS)
    like = np.exp(like - like.max(axis=0))
    best, sure = like.argmax(axis=0), like.max(axis=0) / like.sum(axis=0)
    return [langs[i] if ok else UNKNOWN for i, ok in zip(best, told, strict=True)], np.where(told, sure, 0.0)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        langs, logp = shared.value
        for b in slices(batches):
            pred, sure = _judge(b.column(1).to_pylist(), langs, logp)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(sure)], names=["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), "text"), score, "doc_id long, lang_pred string, score double")


def known(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` (with all their columns) whose predicted language isn't ``und``."""
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def keep(batches):
        langs, logp = shared.value
        at = schema.names.index("text")
        for b in slices(batches, column=at):
            pred, _ = _judge(b.column(at).to_pylist(), langs, logp)
            yield b.filter(pa.array([p != UNKNOWN for p in pred]))

    return map_arrow(docs, keep, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 3) != 1))
    out = predict(docs, model)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
