"""Mixing sources to target weights, in DataFrame functions alone.

The words of a source, its documents in a fixed order one after another, are packed into blocks of ``BLOCK`` words. A
source's target becomes a quota of blocks. The output is cut into shards of ``SHARD`` block slots; each slot draws a
source by hash in proportion to the quotas, which makes the source counts of a shard multinomial. Draws beyond a
source's quota go to sources that fell short, so that quotas hold exactly. A source's slots, numbered across shards,
go through its own pseudorandom permutation of block indices (a Feistel network that walks its cycle back into range)
and are joined with the blocks by index; a second round through the permutation repeats blocks, never a third.

A hot source is no single task's load: documents are dealt to ``SALTS`` groups within their source, whose sizes alone
are added up in order.

Defined cases: a null text has no words; a null source is a source of its own, the last; documents without words are
returned with nothing taken; repeated rows are mixed each for itself; other columns are passed over.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table

BLOCK = 128
SHARD = 1 << 16
#: Slots of one source that are permuted in one row, and sources up to which their list is broadcast.
RUN = 1 << 10
SOURCES = 100_000
#: Blocks that a source has at least; a small source's are shorter.
LEAST_BLOCKS = 16
SALTS = 1024
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
WORD = r"[^\x20\x09-\x0D]+"
_GAP = r"[\x20\x09-\x0D]+"
_WALK = 64
SEED = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target of every source in ``sizes`` (source, size). One row a source, so windows over all of them are small."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), rank % len(weights))
    all_of = Window.partitionBy(F.lit(0))
    capped = by.withColumn("w", weight).withColumn("r", most * F.col("source_size") / F.col("w"))
    before = Window.partitionBy(F.lit(0)).orderBy("r", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # If exactly the sources before this one in order of size by weight stop at their bound, the others get level * weight.
    level = (share * F.sum("source_size").over(all_of) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("w").over(all_of) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levelled = capped.withColumn("level", level)
    final = F.min_by(F.when(F.col("level") <= F.col("r"), F.col("level")), F.when(F.col("level") <= F.col("r"), F.col("r"))).over(all_of)
    return levelled.select("source", "source_size", F.least(F.coalesce(final, F.lit(0.0)) * F.col("w"), (most * F.col("source_size")).cast("double")).alias("target"))


def permute(x: Column, n: Column, seed: Column) -> Column:
    """The place of ``x`` (0 to n-1) in a pseudorandom permutation of n numbers."""
    bits = F.greatest(F.length(F.bin(n - 1)), F.lit(2))
    low = F.floor(bits / 2).cast("int")
    mask = lambda b: F.call_function("shiftleft", F.lit(1).cast("bigint"), b) - 1

    def step(v: Column) -> Column:
        # Bound once, as each round names its value twice.
        return F.transform(F.array(v), _rounds)[0]

    def _rounds(v: Column) -> Column:
        pair = F.struct(F.call_function("shiftright", v, low).alias("hi"), v.bitwiseAND(mask(low)).alias("lo"))
        for k in range(3):
            pair = F.transform(F.array(pair), lambda p, k=k: F.struct(p["hi"].bitwiseXOR(F.xxhash64(p["lo"], seed, F.lit(2 * k))).bitwiseAND(mask(bits - low)).alias("hi"), p["lo"].alias("lo")))[0]
            pair = F.transform(F.array(pair), lambda p, k=k: F.struct(p["hi"].alias("hi"), p["lo"].bitwiseXOR(F.xxhash64(p["hi"], seed, F.lit(2 * k + 1))).bitwiseAND(mask(low)).alias("lo")))[0]
        return F.transform(F.array(pair), lambda p: F.call_function("shiftleft", p["hi"], low).bitwiseOR(p["lo"]))[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), step(x), lambda v, _: F.when(v < n, v).otherwise(step(v)))


def slots(plan: DataFrame, seed: int, shard: int = SHARD) -> DataFrame:
    """shard, s, block of every output slot; ``plan``: s (number of the source), blocks, quota.

    The draws below a source's running total of quotas, and not below the one before, are its own. A draw finds its source
    among the few that reach into its cell, one of some equal ranges of draws.
    """
    spark = plan.sparkSession
    # Running totals, source by source; one row a source.
    ends = F.sum("quota").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    plan = materialise(plan.withColumn("end", ends).withColumn("begin", F.col("end") - F.col("quota")), "mix-totals")
    total, n_sources = plan.agg(F.coalesce(F.max("end"), F.lit(0)), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], "shard long, s int, block long")
    width = max(1, total // (4 * n_sources))
    cell = lambda x: F.floor(x / F.lit(width)).cast("long")
    reach = plan.where("quota > 0").select("s", "begin", "end", F.explode(F.sequence(cell(F.col("begin")), cell(F.col("end") - 1))).alias("cell"))
    reach = reach.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("end", "s"))).alias("in_cell"))
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(total))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = spark.range(0, total, 1, parts).select(F.floor(F.col("id") / shard).alias("shard"), draw.alias("draw")).withColumn("cell", cell(F.col("draw")))
    if n_sources <= SOURCES:
        reach = F.broadcast(reach)
    own = F.filter("in_cell", lambda e: e["end"] > F.col("draw"))[0]["s"]
    counts = drawn.join(reach, "cell").groupBy("shard", own.alias("s")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = materialise(counts.withColumn("first", before).join(plan.drop("begin", "end"), "s"), "mix-counts")
    kept = F.least(F.col("first") + F.col("n"), F.col("quota"))
    # Slots are dealt out in runs before they are permuted, so that a few large counts aren't a few tasks' work.
    run = lambda first, last: F.explode(F.sequence(first, last, F.lit(RUN).cast("long")))
    placed = counts.where(F.col("first") < kept).select("shard", "s", "blocks", kept.alias("stop"), run(F.col("first"), kept - 1).alias("k0")).repartition(parts, "shard", "s", "k0")
    placed = placed.select("shard", "s", "blocks", F.explode(F.sequence("k0", F.least(F.col("k0") + RUN, F.col("stop")) - 1)).alias("k"))
    # Draws beyond the quota, numbered across sources, meet the shortfalls of the other sources, numbered alike.
    sums = plan.join(counts.groupBy("s").agg(F.sum("n").alias("n")), "s", "left").select("s", "blocks", "quota", F.coalesce("n", F.lit(0)).alias("n"))
    ranked = lambda c: F.coalesce(F.sum(c).over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = sums.withColumn("at", ranked(F.greatest(F.col("n") - F.col("quota"), F.lit(0)))).select("s", "at")
    surplus = counts.join(over, "s").where(F.col("first") + F.col("n") > F.col("quota"))
    surplus = surplus.select("shard", "quota", "at", F.explode(F.sequence(F.greatest("first", "quota"), F.col("first") + F.col("n") - 1)).alias("k")).select("shard", (F.col("at") + F.col("k") - F.col("quota")).alias("rank"))
    short = sums.withColumn("at", ranked(F.greatest(F.col("quota") - F.col("n"), F.lit(0)))).where(F.col("quota") > F.col("n"))
    short = short.select("s", "blocks", "n", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - F.col("n") - 1)).alias("i")).select("s", "blocks", (F.col("n") + F.col("i")).alias("k"), (F.col("at") + F.col("i")).alias("rank"))
    filled = surplus.join(short, "rank").select("shard", "s", "blocks", "k")
    return placed.unionByName(filled).select("shard", "s", permute(F.col("k") % F.col("blocks"), F.col("blocks"), F.xxhash64("s", F.lit(seed))).alias("block"))


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED, **how) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix of ``docs`` (doc_id, text, source).

    documents: doc_id, key (hash of the text), source, size, source_size, target, taken. pieces: doc_id, key, at (a row's
    place in its source), from_word, to_word (exclusive), times (1 or 2) of every part of a document that is in the mix.
    """
    sizes = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("key")), "mix-sizes")
    of = materialise(targets(sizes, **how), "mix-targets")
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    unit = F.least(F.lit(block), F.greatest(F.floor(F.col("source_size") / LEAST_BLOCKS), F.lit(1))).cast("long")
    plan = of.select("source", "source_size", "target", number.alias("s"), unit.alias("unit"))
    plan = plan.withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / F.col("unit")), F.lit(1)).cast("long"))
    plan = materialise(plan.withColumn("quota", F.least(F.round(F.col("target") / F.col("unit")).cast("long"), 2 * F.col("blocks"))), "mix-plan")
    picks = materialise(slots(plan.select("s", "blocks", "quota"), seed).groupBy("s", "block").agg(F.count("*").alias("times")), "mix-picks")

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    salted = sizes.where("size > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int"))
    sums = salted.groupBy("source", "salt").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = sums.join(plan, same(sums, plan)).select(sums["source"].alias("of_source"), F.col("salt").alias("of_salt"), "base", "s", "unit")
    inside = Window.partitionBy("source", "salt").orderBy("doc_id", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = salted.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, placed["source"].eqNullSafe(F.col("of_source")) & (F.col("salt") == F.col("of_salt"))).withColumn("at", F.col("base") + F.col("inside"))
    end = F.col("at") + F.col("size")
    parts = placed.select("doc_id", "key", "source", "size", "s", "unit", "at", F.explode(F.sequence(F.floor(F.col("at") / F.col("unit")), F.floor((end - 1) / F.col("unit")))).alias("block"))
    parts = parts.join(picks, ["s", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    parts = parts.withColumn("from_word", F.greatest(F.col("block") * F.col("unit") - F.col("at"), F.lit(0))).withColumn("to_word", F.least((F.col("block") + 1) * F.col("unit") - F.col("at"), F.col("size")))
    taken = parts.groupBy("doc_id", "key", "source", "size", "at").agg(F.sum(F.col("times") * (F.col("to_word") - F.col("from_word"))).alias("taken")).drop("at")
    taken = taken.unionByName(sizes.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    rows = taken.join(of.withColumnRenamed("source", "of_source"), taken["source"].eqNullSafe(F.col("of_source"))).drop("of_source")
    return rows, parts.where("times > 0").select("doc_id", "key", "source", "at", "from_word", "to_word", "times")


def apply(docs: DataFrame, block: int = BLOCK, seed: int = SEED, **how) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a document comes once with its words taken at least once, and again with
    those taken twice. Words are parted by blanks; a document none of whose words are taken doesn't come. Of rows with equal
    id, text and source, those with the lesser hash of their columns (but maps) get the parts of the places that come first."""
    _, parts = mix(docs, block, seed, **how)
    same = ["doc_id", "key", "source"]
    parts = parts.groupBy(*same, "at").agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word", "times"))).alias("parts"))
    parts = parts.withColumn("copy", F.row_number().over(Window.partitionBy(*same).orderBy("at"))).drop("at")
    parts = parts.withColumnsRenamed({c: f"of_{c}" for c in (*same, "copy")})
    # The row travels as one column, so that no name of its own clashes.
    hashed = [F.col(f.name) for f in docs.schema if not re.search(r"\b(map|variant)\b", f.dataType.simpleString())]
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "source", F.xxhash64(*hashed).alias("order"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*same).orderBy("order"))).drop("order")
    alike = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*same, "copy")]
    both = rows.join(parts, alike).select("row", "parts")
    words = F.filter(F.split(F.col("row.text"), _GAP), lambda w: w != "")
    both = both.withColumn("words", words).withColumn("epoch", F.explode(F.array(F.lit(1), F.lit(2))))
    chosen = F.filter("parts", lambda p: p["times"] >= F.col("epoch"))
    text = F.array_join(F.flatten(F.transform(chosen, lambda p: F.slice(F.col("words"), (p["from_word"] + 1).cast("int"), (p["to_word"] - p["from_word"]).cast("int")))), " ")
    out = both.withColumn("mixed", text).where(F.col("mixed") != "")
    new = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast(docs.schema["n_chars"].dataType)}
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")
