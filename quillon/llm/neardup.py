"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Shingles are ``WORDS`` words (runs of ASCII letters, digits and _, and of other characters but blanks, punctuation and
symbols; a symbol that is not ASCII is a word of its own) in a row, lower-case (a text of fewer words is one shingle), hashed to 64 bits. A
shingle's weight is its count in the text times an inverse document frequency, taken over all distinct texts on
``FEATURES`` hashed features (a table of fixed size, so it can be broadcast): 1 for a shingle of one text, ``FLOOR`` for
one of all n texts, and between them linear in ln(n / frequency), at any n. With 0.8 as its least value, two texts whose plain
similarity is 5/6 reach 0.8 whatever the frequencies, so that a large group of near copies doesn't dissolve by its own. For sampling
alone, weights are rounded to ``LEVELS`` geometric levels, enough for any count in a text of 2 GB; similarities are computed from
the weights themselves.

Sampling is improved consistent weighted sampling: from a shingle's hash and the sample's number come r, c ~ Gamma(2,1)
and b ~ U(0,1); t = floor(ln w / r + b), ln y = r (t - b), and the shingle with least ln c - ln y - r is drawn, with t.
The random triple comes from a table of ``DRAWS`` quantised triples, for which ln a and t are known at each level.
``ROWS`` of the ``SAMPLES`` make a band's key. Documents that share a key meet the key's leader, the text that meets most others;
the weighted Jaccard similarity of the two whole texts is computed, and at ``THRESHOLD`` they are linked. Classes are the
connected components of the links. Bands that hold several classes after that are compared throughout, in blocks of
``IN_BLOCK`` by ``IN_BLOCK`` texts inside tasks; only links that join classes come back. So two texts that share a key are in one class
or have been compared, and no group is in one task.

Equal texts collapse before all that and come back as members of their class.

Defined cases: null and empty texts, and those without a word, are in a class of their own row; repeated rows are in
one class; other columns are passed over. Texts are told apart by their hashes, not by ids: different texts under one id are
compared each for itself, and the id is one member, of the least class. A row with a null id links others like any and
comes back as a row of its own, with the least id of its class, or null if the class has none.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialise, mix, power_tables, ship, slices, table

WORDS = 5
THRESHOLD = 0.8
SAMPLES = 64
BANDS = 40
ROWS = 6
FEATURES = 1 << 20
FLOOR = 0.8
LEVELS = 224
STEP = 1.1
DRAWS = 1 << 13
#: Members of a band in a block.
IN_BLOCK = 256
#: Documents of one leader that are verified by one copy of its text.
PER_COPY = 256
#: Code points that are not ASCII: 1 parts words (blanks, punctuation, controls), 2 is a word of its own (symbols).
_PARTS = np.zeros(0x110000, np.uint8)
for _c in (*range(0x80, 0x20000), *range(0xE0000, 0xE1000)):
    _kind = unicodedata.category(chr(_c))
    _PARTS[_c] = 1 if _kind[0] in "PZ" or _kind in ("Cc", "Cf") else 2 if _kind[0] == "S" else 0
_RUNS = [[c for _, c in g] for _, g in groupby(enumerate(np.flatnonzero(_PARTS == 1).tolist()), lambda x: x[1] - x[0])]
#: A character of a word, in Python and in Java.
_WORD = re.compile(r"[A-Za-z0-9_]|[^\x00-\x7f%s]" % "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in _RUNS))
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() or chr(b) == "_" for b in range(256)])


def _parted(text: str) -> str:
    """``text`` with blanks for what parts words, and around symbols."""
    if text.isascii():
        return text
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    part = _PARTS[codes]
    if not part.any():
        return text
    codes = np.where(part == 1, np.uint32(32), codes)
    own = np.flatnonzero(part == 2)
    codes = np.insert(codes, np.r_[own, own + 1], 32)
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def shingles(text: str) -> np.ndarray:
    return shingles_of([text])[0]


def shingles_of(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its shingles."""
    raw = [_parted(t.lower()).encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[False, _IN_WORD[data], False].view(np.int8)))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return [np.zeros(0, np.uint64)] * len(texts)
    power, inverse = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    h = mix((sums[last] - sums[first]) * inverse[first])
    chain = lambda n: _chain([h[k : len(h) - n + 1 + k] for k in range(n)])
    rolled = chain(WORDS) if len(h) >= WORDS else np.zeros(0, np.uint64)
    stop = np.searchsorted(first, ends)
    out = []
    for a, b in zip(np.r_[0, stop[:-1]].tolist(), stop.tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.sort(rolled[a : b - WORDS + 1]))
        else:
            out.append(_chain([h[k : k + 1] for k in range(a, b)]) if b > a else np.zeros(0, np.uint64))
    return out


def _chain(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + p)
    return out


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and counts of a sorted array."""
    head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[head], np.diff(np.r_[head, len(h)])


def feature(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64) % FEATURES


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Of each hashed feature, in how many of ``texts`` (text) it is; and their number."""

    def count(batches):
        total, n = np.zeros(FEATURES, np.int64), 0
        for b in slices(batches, column=0, limit=1 << 20):
            for h in shingles_of(b.column(0).to_pylist()):
                n += 1
                total[np.unique(feature(h))] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, total[at]])], names=["feature", "n"])

    got = map_arrow(texts.select("text"), count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    df, at, n = np.zeros(FEATURES, np.int64), got["feature"].to_numpy(), got["n"].to_numpy()
    df[at[at >= 0]] = n[at >= 0]
    return df, int(n[at < 0].sum())


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies from FLOOR (in all texts) to 1 (in one), as float32."""
    rarity = np.log(max(n, 1) / np.maximum(df, 1)) / np.log(max(n, 2))
    return (FLOOR + (1 - FLOOR) * np.clip(rarity, 0, 1)).astype(np.float32)


def levels(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The level of each weight; level k stands for FLOOR * STEP**k."""
    return np.clip(np.rint(np.log(counts * idf / FLOOR) / np.log(STEP)), 0, LEVELS - 1).astype(np.int64)


WEIGHT = FLOOR * STEP ** np.arange(LEVELS)


def sampling_tables(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """ln a and t of each drawn triple at each level."""
    rng = np.random.default_rng(seed)
    r, c, b = rng.gamma(2, 1, (DRAWS, 1)), rng.gamma(2, 1, (DRAWS, 1)), rng.random((DRAWS, 1))
    t = np.floor(np.log(WEIGHT) / r + b)
    return (np.log(c) - r * (t - b) - r).astype(np.float32), t.astype(np.int64)


def drawn(h: np.ndarray, level: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Place in the flattened tables of the triple that each sample gives each shingle, by multiply-shift hashing with odd ``seeds``."""
    at = h[None] * seeds[:, None]
    at >>= np.uint64(64 - DRAWS.bit_length() + 1)
    at *= np.uint64(LEVELS)
    at += level.astype(np.uint64)
    return at.view(np.int64)


#: The samples of each band.
_PICKED = np.stack([np.random.default_rng(100 + k).choice(SAMPLES, ROWS, replace=False) for k in range(BANDS)])


def band_keys(h: np.ndarray, level: np.ndarray, tables: tuple[np.ndarray, np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """BANDS keys of a weighted set."""
    ln_a, t = tables
    at = drawn(h, level, seeds)
    # Of shingles with equal draws the first, that is the least hash.
    best = ln_a.ravel()[at].argmin(axis=1)
    sample = mix(h[best] + t.ravel()[at[np.arange(len(seeds)), best]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sample[_PICKED[:, k]])
    return keys


def similarity(a: np.ndarray, b: np.ndarray, idf: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts' sorted shingles."""
    (ha, ca), (hb, cb) = _distinct(a), _distinct(b)
    wa, wb = ca * idf[feature(ha)].astype(float), cb * idf[feature(hb)].astype(float)
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum()
    return float(both / (wa.sum() + wb.sum() - both)) if len(ha) + len(hb) else 1.0


def components(links: DataFrame) -> DataFrame:
    """id, top: the least id of each id's connected component; ``links``: a, b. Ids of no link aren't returned.

    Large star and small star in turn, until the links no longer change. What is joined are tables of their own, so that Spark
    can part the rows of a hub.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).select("a", "b"))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("m")), "least")
        # Large star: neighbours larger than oneself go to one's least neighbour.
        large = materialise(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        # Small star: smaller neighbours, and oneself, go to the least of them.
        own = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(own, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(own.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = materialise(small, "links")
        discard(edges, least, large, own)
        edges = after
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("top"))
        before = state


def keyed_by_text(docs: DataFrame, *columns) -> DataFrame:
    """doc_id, k1, k2 (hashes of the text) and ``columns`` of the rows of ``docs`` whose text has a word."""
    has = docs.where(F.col("text").isNotNull() & F.regexp_like("text", F.lit(_WORD.pattern)))
    return has.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), *columns)


def without_word(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNull() | ~F.regexp_like("text", F.lit(_WORD.pattern)))


def one_row(keyed: DataFrame, texts: DataFrame, nameless: bool) -> DataFrame:
    """k1, k2, row: of each of ``texts`` (k1, k2, least) the least ``row`` among those of ``keyed`` that have the least id.

    ``nameless``: some texts have no id at all. Rows that are equal shrink in the first, partial aggregation.
    """
    named = texts.where(F.col("least").isNotNull()).select(F.col("least").alias("doc_id"), "k1", "k2")
    out = keyed.join(named, ["doc_id", "k1", "k2"]).groupBy("doc_id", "k1", "k2").agg(F.min("row").alias("row")).drop("doc_id")
    if nameless:
        rows = keyed.where(F.col("doc_id").isNull()).groupBy("k1", "k2").agg(F.min("row").alias("row"))
        out = out.unionByName(rows.join(texts.where(F.col("least").isNull()).select("k1", "k2"), ["k1", "k2"]).select("k1", "k2", "row"))
    return out


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least doc_id of its class)."""
    by_text, _ = text_classes(docs, threshold)
    member = keyed_by_text(docs).join(by_text.select("k1", "k2", "class_id"), ["k1", "k2"]).select("doc_id", "class_id")
    named = member.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    bare = without_word(docs).select(F.col("doc_id").cast("long").alias("doc_id"))
    alone = bare.where(F.col("doc_id").isNotNull()).distinct().join(named.select("doc_id"), "doc_id", "left_anti")
    alone = alone.unionByName(bare.where(F.col("doc_id").isNull())).select("doc_id", F.col("doc_id").alias("class_id"))
    return named.unionByName(member.where(F.col("doc_id").isNull())).unionByName(alone)


def kept(docs: DataFrame) -> DataFrame:
    """Of each class of near-duplicates one row of ``docs``: of the least id (null ids last), and of rows that share it the least; rows without a word all stay."""
    by_text, nameless = text_classes(docs)
    if "top" not in by_text.columns:
        stay = by_text.where(F.col("least") == F.col("class_id"))
    else:
        order = F.struct(F.col("least").isNull().alias("none"), "least", "k1", "k2")
        stay = by_text.groupBy("top").agg(F.min(order).alias("t")).select("t.least", "t.k1", "t.k2")
    rows = one_row(keyed_by_text(docs, F.struct(*docs.columns).alias("row")), stay, nameless)
    return rows.select("row.*").select(*docs.columns).unionByName(without_word(docs))


def text_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, bool]:
    """k1, k2, least (id of the text), class_id, and top (of the class) where ids are null or shared; and whether some text has no id."""
    keyed = keyed_by_text(docs, F.col("text").alias("row"))
    first = materialise(keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("least")), "texts")
    shared_ids = first.where(F.col("least").isNotNull()).groupBy("least").agg(F.count("*").alias("n"), F.min("k1").alias("keeps")).where("n > 1").drop("n")
    shared_ids = materialise(shared_ids, "shared-ids")
    nameless = not first.where(F.col("least").isNull()).isEmpty()
    plain = not nameless and shared_ids.isEmpty()
    if plain:
        first = first.withColumn("id", F.col("least"))
    else:
        # A text without an id of its own goes by its hash.
        own = F.when(F.col("least").isNotNull() & (F.coalesce("keeps", "k1") == F.col("k1")), F.col("least")).otherwise(F.col("k1"))
        first = materialise(first.join(shared_ids, "least", "left").select("k1", "k2", "least", own.alias("id")), "texts")
    if plain:
        distinct = keyed.join(first.select(F.col("id").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"]).select(F.col("doc_id").alias("id"), F.col("row").alias("text")).dropDuplicates(["id"])
    else:
        distinct = one_row(keyed, first, nameless).join(first.select("k1", "k2", "id"), ["k1", "k2"]).select("id", F.col("row").alias("text"))
    # One row of each text: a group of equal texts shrinks in the first, partial aggregation.
    distinct = materialise(distinct, "distinct-texts")
    spark = docs.sparkSession
    df, n = document_frequencies(distinct)
    shared = spark.sparkContext.broadcast(weights(df, n))
    seeds = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)

    def bands(batches):
        tables = sampling_tables()
        for b in slices(batches, limit=1 << 20):
            keys = []
            for h in shingles_of(b.column(1).to_pylist()):
                h, c = _distinct(h)
                level = levels(c, shared.value[feature(h)])
                # Long texts in parts, by the least draw of each.
                keys.append(band_keys(h, level, tables, seeds) if len(h) <= 65536 else _long_keys(h, level, tables, seeds))
            ids = np.repeat(b.column(0).to_numpy(), BANDS)
            number = np.tile(np.arange(BANDS, dtype=np.int8), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(keys).view(np.int64)), pa.array(number)], names=["id", "band", "number"])

    placed = materialise(map_arrow(distinct.select("id", "text"), bands, "id long, band long, number byte"), "bands")
    # How many others a text meets in all says how central it is; a band's leader is its most central text.
    met = materialise(placed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared-bands")
    shared_bands = materialise(placed.join(met, "band"), "bands")
    discard(placed, met)
    central = materialise(shared_bands.groupBy("id").agg(F.sum("n").alias("central")), "central")
    first_of = F.min(F.struct((-F.col("central")).alias("central"), "id"))["id"]
    leads = materialise(shared_bands.join(central, "id").groupBy("band", "number").agg(first_of.alias("leader")), "leaders")
    placed = shared_bands.select("id", "band", "number")
    links = tops = None
    # A quarter of the bands' leaders first: what they join needs no more comparing in the other bands.
    for within in (BANDS // 4, BANDS):
        some = F.col("number") < within
        lead = leads.where(some).select("band", "leader")
        if tops is None:
            asked = placed.where(some).join(lead, "band").where("id <> leader")
        else:
            lead = materialise(_with_top(lead, tops, "leader", "of_leader"), "leaders")
            asked = _with_top(placed.where(some), tops).join(lead, "band").where("top <> of_leader")
        pairs = materialise(asked.select("id", "leader").distinct(), "met")
        judged = _verify(pairs, distinct, shared).where(F.col("likeness") >= threshold).select("id", "leader")
        judged = materialise(judged, "links")
        discard(pairs)
        links = judged if links is None else links.unionByName(judged)
        tops = components(links.select(F.col("id").alias("a"), F.col("leader").alias("b")))
    # Bands that still hold several classes are compared in blocks; of the links found there a spanning forest comes back.
    members = materialise(_with_top(placed, tops), "members")
    several = members.groupBy("band").agg(F.count("*").alias("n"), F.min("top").alias("a"), F.max("top").alias("z")).where("a < z")
    several = materialise(several.select("band", F.ceil(F.col("n") / IN_BLOCK).cast("int").alias("blocks")), "mixed-bands")
    rest = materialise(members.join(several, "band").select("band", "id", "top", "blocks"), "mixed-members")
    found = materialise(_blocks(rest, distinct, shared, threshold), "links")
    links = links.unionByName(found).distinct()
    tops = components(links.select(F.col("id").alias("a"), F.col("leader").alias("b")))
    discard(shared_bands, central, leads, members, several, rest, distinct)
    by_text = first.join(tops, "id", "left").select("k1", "k2", "least", F.coalesce("top", "id").alias("top"))
    if plain:
        return by_text.withColumnRenamed("top", "class_id"), False
    by_text = materialise(by_text, "text-classes")
    return by_text.join(by_text.groupBy("top").agg(F.min("least").alias("class_id")), "top"), nameless


def _with_top(members: DataFrame, tops: DataFrame, by: str = "id", name: str = "top") -> DataFrame:
    """``members`` and the class of their text ``by``."""
    own = tops.select(F.col("id").alias(by), F.col("top").alias(name))
    return members.join(own, by, "left").withColumn(name, F.coalesce(name, by))


def _blocks(members: DataFrame, texts: DataFrame, shared, threshold: float) -> DataFrame:
    """id, leader: links between the members (band, id, top, blocks) of a band that are in different classes.

    A band's members are dealt to ``blocks`` blocks, and every two blocks, or one with itself, meet in a task of their own.
    """
    own = members.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = own.select("band", "id", "top", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(texts, "id")

    def compare(group: pa.Table) -> pa.Table:
        ids, top = group["id"].to_numpy(), group["top"].to_numpy()
        sets = [_distinct(h) for h in shingles_of(group["text"].to_pylist())]
        larger, less = forest(ids, top, *overlaps(sets, shared.value), threshold)
        return pa.table({"id": pa.array(larger, pa.int64()), "leader": pa.array(less, pa.int64())})

    ship(members.sparkSession)
    return met.groupBy("band", "i", "j").applyInArrow(compare, "id long, leader long")


def overlaps(sets: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the lesser weights of every two weighted sets (shingles, counts), and each set's sum of weights."""
    h, owner = np.concatenate([x for x, _ in sets]), np.repeat(np.arange(len(sets)), [len(x) for x, _ in sets])
    weight, reach = idf[feature(h)].astype(float), np.concatenate([c for _, c in sets])
    total = np.bincount(owner, weight * reach, len(sets))
    _, where, count = np.unique(h, return_inverse=True, return_counts=True)
    # What one set alone has overlaps with nothing.
    common = count[where] > 1
    column, owner, weight, reach = where[common], owner[common], weight[common], reach[common]
    both = np.zeros((len(sets), len(sets)))
    # The lesser of two counts is the sum of the steps that both reach: first the step from 0 to the column's least count,
    # then, in the columns that have larger ones, from there to the next.
    while len(column):
        order = np.argsort(column, kind="stable")
        column, owner, weight, reach = column[order], owner[order], weight[order], reach[order]
        head = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
        size = np.diff(np.r_[head, len(column)])
        step = np.minimum.reduceat(reach, head)
        scale, at = weight[head] * step, np.repeat(np.arange(len(head)), size)
        for start in range(0, len(head), 4096):
            a, b = np.searchsorted(at, [start, start + 4096])
            m = np.zeros((len(sets), min(4096, len(head) - start)))
            m[owner[a:b], at[a:b] - start] = np.sqrt(scale[at[a:b]])
            both += m @ m.T
        reach = reach - step[at]
        # A column that one set alone still reaches overlaps with nothing.
        left = reach > 0
        left &= (np.bincount(at[left], minlength=len(head)) > 1)[at]
        column, owner, weight, reach = at[left], owner[left], weight[left], reach[left]
    return both, total


def forest(ids: np.ndarray, top: np.ndarray, both: np.ndarray, total: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    """Links enough to join what is linked, of sets in different classes; larger id first."""
    like = both / np.maximum(total[:, None] + total[None] - both, 1e-12)
    like[top[:, None] == top[None]] = 0
    root = {int(t): int(t) for t in top}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out: tuple[list[int], list[int]] = ([], [])
    # Sums come in another order here than for single pairs.
    for a, b in zip(*np.nonzero(np.triu(like >= threshold - 1e-9, 1)), strict=True):
        x, y = find(int(top[a])), find(int(top[b]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out[0].append(int(max(ids[a], ids[b])))
            out[1].append(int(min(ids[a], ids[b])))
    return out


def _long_keys(h: np.ndarray, level: np.ndarray, tables: tuple, seeds: np.ndarray) -> np.ndarray:
    """band_keys of a large set: the draw of all is among the draws of its parts."""
    keep = np.zeros(len(h), bool)
    for start in range(0, len(h), 65536):
        part = slice(start, start + 65536)
        keep[start + tables[0].ravel()[drawn(h[part], level[part], seeds)].argmin(axis=1)] = True
    return band_keys(h[keep], level[keep], tables, seeds)


def _verify(pairs: DataFrame, texts: DataFrame, shared) -> DataFrame:
    """id, leader, likeness of each of ``pairs``; a leader of many is copied, so that its pairs spread."""
    copies = pairs.groupBy("leader").agg(F.ceil(F.count("*") / PER_COPY).cast("int").alias("copies"))
    lead = texts.join(copies, texts["id"] == copies["leader"]).select("leader", "copies", F.col("text").alias("leader_text"))
    lead = lead.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    asked = pairs.join(copies, "leader").withColumn("copy", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int")).drop("copies")
    both = asked.join(texts, "id").join(lead.drop("copies"), ["leader", "copy"]).select("id", "leader", "text", "leader_text")

    def judge(batches):
        known: tuple = (None, None)
        for b in slices(batches, column=2):
            out = []
            for leader, h, lt in zip(b.column(1).to_pylist(), shingles_of(b.column(2).to_pylist()), b.column(3).to_pylist(), strict=True):
                if known[0] != leader:
                    known = (leader, shingles(lt))
                out.append(similarity(h, known[1], shared.value))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["id", "leader", "likeness"])

    return map_arrow(both, judge, "id long, leader long, likeness double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
