"""Held-out accuracy of the learned operators, and their defined cases."""

import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import langid, quality, toxicity
from quillon.llm.common import fold

DATA = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_language_held_out(spark):
    docs, _ = tables(spark)
    rows = langid.query(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize(("text", "known"), [("½ ² ③ Ⅷ _ 7", False), ("ª", True), ("12 ß", True), ("字", True), (None, False), ("\U0001f600 !", False)])
def test_letters(text, known):
    assert langid.lettered(text) == known
    assert known == any(unicodedata.category(c)[0] == "L" for c in text or "")


def test_language_scores_by_hand():
    """Sums over grams, one by one, against the batch."""
    rng = np.random.default_rng(2)
    logp = rng.normal(-8, 1, (3, langid.BUCKETS * 3)).astype(np.float32)
    texts = ["Hello wörld", "a", "x" * 200, None, "12"]
    pred, score = langid._judge(texts, ["aa", "bb", "cc"], logp)
    for text, p, s in zip(texts, pred, score, strict=True):
        if not langid.lettered(text):
            assert (p, s) == ("und", 0)
            continue
        padded, places = [ord(c) for c in f" {text.lower()}  "], len(text) + 1
        total = np.zeros(3)
        for at in range(places):
            for k in range(3):
                h = 0
                for c in padded[at : at + k + 1]:
                    h = (h * 0x9E3779B97F4A7C15 + c + 1) % 2**64
                m = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64
                total += logp[:, (m >> 49) + k * langid.BUCKETS]
        likely = np.exp((total - total.max()) * min(places, langid.SURE) / places / 3)
        assert p == ["aa", "bb", "cc"][likely.argmax()]
        assert abs(s - likely.max() / likely.sum()) < 1e-4


def test_many_languages_keep_the_matrix_small(spark):
    """300 languages of their own letters, in a matrix of under 2^17 cells."""
    word = lambda k: "".join(chr(0x4E00 + 7 * k + j) for j in (0, 2, 1, 4, 3))
    rows = [(10 * k + i, " ".join([word(k)] * (i + 3)), f"l{k:03}") for k in range(300) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, logp = langid.fit(docs, cells=1 << 17)
    assert len(langs) == 300
    assert logp.size <= 1 << 17
    assert np.allclose(np.exp(logp.astype(float)).reshape(300, 3, -1).sum(axis=2), 1, atol=1e-4)
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, (langs, logp)).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) / len(rows) > 0.9
    full, whole = langid.fit(docs)
    assert whole.shape == (300, 3 * langid.BUCKETS // 2)
    assert full == langs


def test_language_cases(spark, awkward, empty):
    model = langid.fit(awkward)
    got = langid.predict(awkward, model).collect()
    assert len(got) == awkward.count()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {900001, 900002, 900003, 900004}
    assert langid.predict(empty, model).count() == 0
    assert {r.lang_pred for r in langid.predict(awkward, langid.fit(empty)).collect()} == {"und"}
    assert langid.known(awkward, model).columns == awkward.columns


@pytest.mark.parametrize(("module", "label", "cut", "parts", "rest"), [(quality, "quality", 0.7, 4, 2), (toxicity, "toxic", 0.5, 5, 0)])
def test_labels_held_out(spark, module, label, cut, parts, rest):
    _, labels = tables(spark)
    out = module.query(spark, DATA).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 30
    assert sum(r[label] == r.predicted for r in out) / len(out) > 0.9
    assert all((r.score >= cut) == (r.predicted == 1) and 0 <= r.score <= 1 for r in out)
    assert all(r.held_out for r in out)
    assert spark.range(3).select(fold("id", parts).alias("f")).where(F.col("f") == rest).count() <= 3


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_label_cases(spark, awkward, empty, module, label):
    labels = spark.createDataFrame([(900005, 1), (900007, 0), (900007, None), (900008, 0), (None, 1)], f"doc_id long, {label} int")
    for known in (labels, labels.limit(0)):
        got = module.predict(awkward, module.fit(awkward, known)).collect()
        assert len(got) == awkward.count()
        assert all(0 <= r.score <= 1 for r in got)
    assert module.predict(empty, module.fit(awkward, labels)).count() == 0
    assert module.predict(empty, module.fit(empty, labels)).count() == 0


def test_null_ids_are_in_no_fold(spark, tmp_path):
    spark.createDataFrame([(None, "some text", "en"), (1, "some text", "en"), (2, "etwas", "de"), (None, None, None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for module in (langid, quality, toxicity):
        got = [r.held_out for r in module.query(spark, str(tmp_path)).collect() if r.doc_id is None]
        assert got == [False, False]


def test_quality_scores_by_hand(spark):
    """Tables looked up one by one against the batch."""
    docs, labels = tables(spark)
    model = quality.fit(docs, labels)
    texts = [r.text for r in docs.limit(200).collect()] + ["", "x"]
    rows = quality.features([t or "" for t in texts])
    for row, got in zip(rows, model.score(rows), strict=True):
        bins = [sum(e <= x for e in edges) for edges, x in zip(model.edges, row, strict=True)]
        total = model.bias + sum(model.tables[j][b] for j, b in enumerate(bins)) + sum(t[bins[i]][bins[j]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert abs(got - 1 / (1 + math.exp(-total))) < 1e-9


def test_toxic_scores_by_hand():
    model = toxicity.Model({"vile$": 2.0, "vile": 0.5, "bad$": 1.0}, -1.5)
    texts = ["Vile vileness VILE", "bad", "", "good", "vileness vilest bad"]
    weight = {"Vile vileness VILE": 2.5, "bad": 1, "": 0, "good": 0, "vileness vilest bad": 1.5}
    assert np.allclose(model.score(texts), [1 / (1 + math.exp(1.5 - weight[t])) for t in texts])


def test_toxic_held_out_recall(spark):
    """Recall, precision and the area under the curve on the labels not learned from."""
    sf = "/root/testdata/sf0.1"
    out = toxicity.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    toxic, clean = [r.score for r in out if r.toxic == 1], [r.score for r in out if r.toxic == 0]
    caught, wrong = sum(s >= 0.5 for s in toxic), sum(s >= 0.5 for s in clean)
    area = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / len(toxic) / len(clean)
    print(len(toxic), len(clean), caught, wrong, area)
    assert caught / len(toxic) >= 0.85
    assert caught / (caught + wrong) >= 0.9
    assert area >= 0.95


def toxic_table(spark, n, share, copies=0.0):
    """``n`` documents with their labels: a ``share`` is toxic by some of twelve words, of which ``copies`` (of all rows) are one text."""
    rng = random.Random(7)
    bad, plain = [f"{c}{c}vile" for c in "abcdefghijkl"], [f"{a}{b}word" for a in "mnopqrstuv" for b in "klmnopqrst"]
    rows = []
    for i in range(n):
        toxic = i < n * share
        words = rng.choices(plain, k=25) + (rng.choices(bad, k=4) if toxic else [])
        rng.shuffle(words)
        rows.append((i, rows[0][1] if 0 < i < n * copies else " ".join(words), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return frame.select("doc_id", "text"), frame.select("doc_id", "toxic")


@pytest.mark.parametrize(("n", "share", "copies"), [(1500, 0.1, 0), (1500, 0.35, 0), (1500, 0.6, 0), (1500, 0.45, 0.34)])
def test_toxic_shares(spark, n, share, copies):
    docs, labels = toxic_table(spark, n, share, copies)
    model = toxicity.fit(docs, labels.where("doc_id % 5 <> 0"))
    held = toxicity.predict(docs, model).join(labels, "doc_id").where("doc_id % 5 = 0").collect()
    caught, clean = ([(r.score >= 0.5) == (r.toxic == 1) for r in held if r.toxic == x] for x in (1, 0))
    assert sum(caught) / len(caught) > 0.9
    assert sum(clean) / len(clean) > 0.9


def test_few_toxic_examples(spark):
    docs, labels = toxic_table(spark, 80, 0.1)
    rows = toxicity.predict(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").collect()
    assert sum(r.score >= 0.5 for r in rows if r.toxic) >= 7
    assert sum(r.score >= 0.5 for r in rows if not r.toxic) <= 4
