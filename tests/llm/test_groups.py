"""Near-duplicate classes, and the pipeline against plain Python."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import langid, mixing, neardup

from .brute import secret_spans, similar_pairs

DATA = "/root/testdata/sf0.001"


def brute_classes(rows):
    """doc_id -> least doc_id of its class, by comparing all pairs."""
    first: dict = {}
    for i, t in rows:
        if t and neardup._WORD.search(t):
            first[t] = min(i, first.get(t, i))
    ids = sorted(first.values())
    sets = {i: neardup.shingles(t) for t, i in first.items()}
    df = np.zeros(neardup.FEATURES, np.int64)
    for h in sets.values():
        df[np.unique(neardup.feature(h))] += 1
    idf = neardup.weights(df, len(sets))
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(np.intersect1d(sets[a], sets[b])) > 0 and neardup.similarity(sets[a], sets[b], idf) >= neardup.THRESHOLD:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(first[t]) if t in first else i for i, t in rows}


def near_copies(rng, n=400):
    words = [f"word{k}" for k in range(n)]
    out = []
    for _ in range(12):
        copy = list(words)
        for _ in range(2):
            copy[rng.integers(n)] = f"edit{rng.integers(10**6)}"
        out.append(" ".join(copy))
    return out


def test_classes_match_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    made = [(10**6 + i, t) for i, t in enumerate(near_copies(np.random.default_rng(4)))]
    both = docs.select("doc_id", "text").unionAll(spark.createDataFrame(made, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in both.collect()]
    got = {r.doc_id: r.class_id for r in neardup.classes(both).collect()}
    assert got == brute_classes(rows)
    assert len({got[i] for i, _ in made}) == 1


def test_classes_against_own_shingler(spark):
    """Recall and precision of the links against all pairs, by another shingler, exact frequencies and plain sums."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.text, r.doc_id) for r in docs.collect() if r.text)
    made = near_copies(np.random.default_rng(12))
    rows += [(t, 10**6 + i) for i, t in enumerate(made)]
    both = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(i, t) for t, i in rows[-len(made) :]], "doc_id long, text string"))
    got = {r.doc_id: r.class_id for r in neardup.classes(both).collect()}
    first = {}
    for text, i in rows:
        first.setdefault(text, i)
        assert got[i] == got[first[text]]
    ids = list(first.values())
    like = similar_pairs(list(first), 0.78)
    linked = [(i, j) for (i, j), s in like.items() if s >= 0.8]
    found = sum(got[ids[i]] == got[ids[j]] for i, j in linked)
    print("links", len(linked), "in one class", found)
    assert found >= 0.9 * len(linked)
    # Nothing is joined but by links; hashed frequencies may move a similarity a little.
    near = {i: i for i in range(len(ids))}

    def find(x):
        while near[x] != x:
            x = near[x]
        return x

    for i, j in like:
        near[find(i)] = find(j)
    top = {}
    for k, i in enumerate(ids):
        assert top.setdefault(got[i], find(k)) == find(k)


def test_class_cases(awkward, empty):
    got = {r.doc_id: r.class_id for r in neardup.classes(awkward).collect()}
    assert got[900006] == got[900005] == 900005
    assert all(got[i] == i for i in (900001, 900002, 900003, 900007, 900008))
    assert neardup.classes(empty).count() == 0


def test_sampling_estimates_similarity():
    rng = np.random.default_rng(6)
    h = np.sort(rng.integers(0, 1 << 63, 900).astype(np.uint64))
    level = rng.integers(0, 12, 900)
    a, b = np.arange(900) < 700, np.arange(900) >= 150
    w = neardup.WEIGHT[level]
    true = w[a & b].sum() / w.sum()
    tables = neardup.sampling_tables()
    seeds = neardup.mix(np.arange(1, 2001, dtype=np.uint64)) | np.uint64(1)

    def draws(keep):
        best = tables[0].ravel()[neardup.drawn(h[keep], level[keep], seeds)].argmin(axis=1)
        return h[keep][best]

    assert abs((draws(a) == draws(b)).mean() - true) < 0.05


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["language_id"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if langid.lettered(r.text)}
    before, after = seen["near_duplicates"]
    top = brute_classes([(r.doc_id, r.text) for r in before])
    assert sorted(after) == sorted(r for r in before if top[r.doc_id] == r.doc_id)
    before, after = seen["secrets"]
    assert len(before) == len(after)
    clean = {r.doc_id for r in before if not secret_spans(r.text)}
    assert sorted(r for r in after if r.doc_id in clean) == sorted(r for r in before if r.doc_id in clean)
    assert all("[SECRET]" in r.text for r in after if r.doc_id not in clean)
    before, after = seen["mixing"]
    words = defaultdict(list)
    for r in before:
        words[r.doc_id] = r.text.split()
    for r in after:
        assert r.n_chars == len(r.text)
        it = iter(words[r.doc_id])
        assert all(w in it for w in r.text.split())
    total = sum(map(len, words.values()))
    assert abs(sum(len(r.text.split()) for r in after) / total - 1.5) < 0.2
    assert sum(r.length for r in seen["packing"][1]) > total


def test_wide_punctuation_parts_words(spark):
    rng = np.random.default_rng(8)
    clause = lambda n: "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 5000, n))
    clauses = [clause(8) for _ in range(120)]
    edited = [*clauses[:60], clause(8), *clauses[61:]]
    signs = "\uff0c\u3002\u3001\u3000\u00a0\u2014\u201d"
    text, near = ("".join(c + signs[i % len(signs)] for i, c in enumerate(x)) for x in (clauses, edited))
    rows = [(1, text), (2, near), (3, "\uff0c\u3002"), (4, "\uff0c\u3002"), (5, "\u2605\u2605"), (6, "\u2605\u2605"), (7, clause(900)), (8, "caf\u00e9 " * 9)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8}
    assert len(neardup.shingles("a\u2014b\u3000c\u201cd\u201d\uff0ce f")) == 2


def plain_similarity(a, b, idf):
    """Weighted Jaccard similarity of two texts' shingles by dictionaries of exact weights."""
    a, b = (Counter(neardup.shingles(t).tolist()) for t in (a, b))
    weight = {h: float(idf[neardup.feature(np.array([h], np.uint64))[0]]) for h in a | b}
    return sum(n * weight[h] for h, n in (a & b).items()) / sum(n * weight[h] for h, n in (a | b).items())


def test_similarity_is_of_whole_counts(spark):
    rng = np.random.default_rng(9)
    idf = rng.uniform(0.9, 1, neardup.FEATURES).astype(np.float32)
    texts = ["same " * 400, "same " * 40000, "same " * 39000 + " ".join(f"own{i}" for i in range(500))]
    texts += [" ".join(f"w{i}" for i in rng.integers(0, 3, 200)) for _ in range(6)] + ["one two three four five six"] * 2
    both, total = neardup.overlaps([neardup._distinct(neardup.shingles(t)) for t in texts], idf)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            want = plain_similarity(a, b, idf)
            assert abs(neardup.similarity(neardup.shingles(a), neardup.shingles(b), idf) - want) < 1e-9
            if i != j:
                assert abs(both[i, j] / (total[i] + total[j] - both[i, j]) - want) < 1e-9
    rows = list(enumerate(texts[:3]))
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1}


def test_null_and_shared_ids(spark):
    copies = near_copies(np.random.default_rng(10))
    texts = [" ".join(f"{a}{i}" for i in range(60)) for a in "pqrst"]
    rows = [(None, copies[0], "b"), (5, copies[1], "a"), (7, texts[0], "a"), (7, copies[2], "a"), (7, texts[1], "b"), (8, texts[1], "a")]
    rows += [(None, texts[2], "b"), (None, texts[2], "a"), (None, texts[3], "a"), (None, "", "a"), (None, None, "a"), (9, texts[4], "b"), (9, texts[4], "a")]
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0)
    got = sorted(((r.doc_id, r.class_id) for r in neardup.classes(docs).collect()), key=key)
    assert got == [(5, 5), (7, 5), (8, 7), (9, 9), (None, 5), *[(None, None)] * 5]
    kept = corpus_pipeline.near_duplicates(spark, docs, DATA)
    want = [(5, copies[1], "a"), (7, texts[0], "a"), (7, texts[1], "b"), (9, texts[4], "a"), (None, texts[2], "a"), (None, texts[3], "a"), (None, "", "a"), (None, None, "a")]
    assert sorted(((r.doc_id, r.text, r.source) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    mixed = mixing.apply(spark.createDataFrame([(None, " ".join(texts * 9), "en", "a", 9), (1, " ".join(texts * 8), "en", "a", 9)], docs.schema))
    assert {r.doc_id for r in mixed.collect()} == {None, 1}


CLASHES = "key copy parts row words epoch band number id top leader central least class_id own other k1 k2 size target".split()


def with_clashes(docs):
    return docs.selectExpr("*", *(f"concat('{c}:', coalesce(text, '-')) AS {c}" for c in CLASHES), "CAST(NULL AS double) AS at")


def test_pipeline_carries_clashing_columns(spark, tmp_path):
    """Columns with the operators' own names come through every stage but the last as they were."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    some = docs.orderBy("doc_id").limit(60)
    odd = spark.createDataFrame([(None, "odd words " * 30, "en", None), (None, None, None, None), (10**9, "", None, "z")], "doc_id long, text string, lang string, source string")
    wide = with_clashes(some.unionByName(some.withColumn("doc_id", F.col("doc_id") + 10**6)).unionByName(odd, allowMissingColumns=True)).cache()
    plain = wide.drop(*CLASHES, "at")
    for name, stage in corpus_pipeline.STAGES:
        wide_out, plain_out = (stage(spark, d, DATA) for d in (wide, plain))
        if name == "packing":
            assert wide_out.count() == plain_out.count() > 0
            continue
        assert wide_out.columns == wide.columns
        rows = wide_out.collect()
        assert sorted(map(repr, (tuple(r)[: len(plain.columns)] for r in rows))) == sorted(map(repr, map(tuple, plain_out.collect())))
        # What a clashing column says is of the row it came with.
        sources = {r.key: r for r in wide.collect()}
        assert all(r[c] == f"{c}:{r.key[4:]}" and r.at is None for r in rows for c in CLASHES)
        assert all(r.lang == sources[r.key].lang for r in rows)


def test_pipeline_of_no_rows(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_keys_of_long_texts():
    """A set beyond one part has the keys that it would have in one."""
    rng = np.random.default_rng(12)
    h = np.sort(rng.integers(0, 1 << 63, 150_000, dtype=np.uint64))
    level = rng.integers(0, neardup.LEVELS, len(h))
    tables, seeds = neardup.sampling_tables(), neardup.mix(np.arange(1, neardup.SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
    assert (neardup._long_keys(h, level, tables, seeds) == neardup.band_keys(h, level, tables, seeds)).all()
    assert (neardup._long_keys(h[:70_000], level[:70_000], tables, seeds) == neardup.band_keys(h[:70_000], level[:70_000], tables, seeds)).all()
