"""Document fingerprints: order MinHash, in DataFrame functions alone.

A text is its words in order (a run of over ``LONGEST`` characters without a blank, as in scripts that don't part words, is a
word for each character); a k-mer is ``K`` words in a row (a text of fewer words is one k-mer). Each k-mer is
numbered by its occurrence, and (k-mer, number) is hashed. The hash picks one of ``BUCKETS`` buckets and orders the
bucket (one-permutation hashing: the buckets stand for the sketch's permutations, at one pass over the text). Of each
bucket the ``PICK`` minimal k-mers are kept, put back into text order and hashed as a tuple, so that a signature
depends on which k-mers a text has, how often, and in what order. Two fingerprints are as alike as the share of
buckets, of those filled in either, that hold the same tuple.

Occurrence numbers come without a shuffle: hash and position share a long, the longs of a text are sorted, and runs of
equal hashes are numbered, all in array functions inside one row.

Defined cases: a null or empty text has no k-mers and the empty fingerprint; two empty fingerprints are alike (1.0);
equal texts have equal fingerprints; repeated rows get equal rows; other columns are passed over. A row with a null id has
no next row and is none: its own fingerprint comes, and null in what the next row would tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

K = 2
PICK = 2
BUCKETS = 32
#: Characters of a word.
LONGEST = 20
#: Bits of a position in a text, and of the hash that shares a long with it.
_AT, _HASH, _BUCKET = 28, 35, 5


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _bits(x: Column, shift: int, n: int) -> Column:
    return F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << n) - 1))


def signature(text: Column, k: int = K) -> Column:
    """array<bigint>: for each filled bucket in order, the bucket in the top bits and the tuple's hash below."""
    parted = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    long = lambda w: F.length(w) > LONGEST
    words = _let(parted, lambda ws: F.when(F.exists(ws, long), F.flatten(F.transform(ws, lambda w: F.when(long(w), F.split(w, "")).otherwise(F.array(w))))).otherwise(ws))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        last = F.greatest(n - F.lit(k), F.when(n > 0, F.lit(0)).otherwise(F.lit(-1)))
        grams = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))).otherwise(F.expr("cast(array() as array<bigint>)"))
        return _let(grams, of_grams)

    def of_grams(g: Column) -> Column:
        tagged = F.sort_array(F.transform(g, lambda h, i: F.shiftleft(_bits(h, 0, _HASH), _AT).bitwiseOR(i.cast("long"))))
        return _let(tagged, lambda s: numbered(g, s))

    def numbered(g: Column, s: Column) -> Column:
        """Runs of equal hashes in the sorted longs give occurrence numbers 1, 2, ..."""
        head = lambda x: F.shiftright(x, _AT)
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (head(x) != head(F.get(s, i - 1))), i).otherwise(F.lit(-1))), lambda i: i >= 0)
        number = _let(starts, lambda b: F.flatten(F.transform(b, lambda x, r: F.sequence(F.lit(1), F.coalesce(F.get(b, r + 1), F.size(s)) - x))))
        ranked = _let(
            number,
            lambda o: F.sort_array(
                F.transform(s, lambda x, i: _let(F.xxhash64(head(x), F.get(o, i)), lambda h: F.shiftleft(_bits(h, 0, _HASH), _AT).bitwiseOR(x.bitwiseAND(F.lit((1 << _AT) - 1)))))
            ),
        )
        return F.when(F.size(s) > 0, _let(ranked, lambda q: picked(g, q))).otherwise(F.expr("cast(array() as array<bigint>)"))

    def picked(g: Column, q: Column) -> Column:
        """The first PICK of each bucket, by text order, as one hash."""
        bucket = lambda x: F.shiftright(x, _AT + _HASH - _BUCKET)
        firsts = F.filter(q, lambda x, i: (i < PICK) | (bucket(x) != bucket(F.get(q, i - PICK))))

        def tuples(f: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                own = [F.when(bucket(F.get(f, i + j)) == bucket(x), F.get(f, i + j).bitwiseAND(F.lit((1 << _AT) - 1))) for j in range(1, PICK)]
                at = F.sort_array(F.filter(F.array(x.bitwiseAND(F.lit((1 << _AT) - 1)), *own), lambda p: p.isNotNull()))
                chain = F.aggregate(at, F.lit(0).cast("bigint"), lambda acc, p: F.xxhash64(acc, F.get(g, p.cast("int"))))
                value = F.shiftleft(bucket(x), 58).bitwiseOR(_bits(chain, 0, 58))
                return F.when((i == 0) | (bucket(F.get(f, i - 1)) != bucket(x)), value)

            return F.filter(F.transform(f, one), lambda v: v.isNotNull())

        return _let(firsts, tuples)

    return _let(words, of_words)


def fingerprint(signature: Column) -> Column:
    """The signature as text: 16 hexadecimal digits for each filled bucket."""
    return F.array_join(F.transform(signature, lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the buckets filled in either signature that hold the same tuple in both."""
    filled = F.size(F.array_union(F.transform(a, lambda v: F.shiftrightunsigned(v, 58)), F.transform(b, lambda v: F.shiftrightunsigned(v, 58))))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled).cast("double")


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id", parts: int | None = None) -> DataFrame:
    """Adds next_<column> of the row with the next larger id; the last row gets the first one's. Ties go by the columns.

    Ids are dealt to ranges by quantiles (a bounded list of numbers). The first row of each range also joins the range
    before it as a sentinel, so one shuffle and a window inside ranges give all neighbours.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.where(F.col(id_col).isNotNull())
    shares = [i / parts for i in range(1, parts)] or [0.5]
    low, cuts = ids.agg(F.min(id_col), F.percentile_approx(id_col, shares, 100 * parts)).first()
    if low is None:
        return docs.limit(0).select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    bounds = sorted({low, *cuts})
    # Two steps of about the square root of the number of ranges find a row's range.
    width = max(1, round(len(bounds) ** 0.5))
    coarse = F.array(*map(F.lit, bounds[::width]))
    fine = F.array(*(F.array(*map(F.lit, bounds[i : i + width])) for i in range(0, len(bounds), width)))
    row = F.col(id_col)
    block = F.size(F.filter(coarse, lambda b: b <= row)) - 1
    at = _let(block, lambda k: k * width + F.size(F.filter(F.get(fine, k), lambda b: b <= row)) - 1)
    dealt = ids.withColumn("_range", at)
    before = F.pmod(F.col("_range") - 1, F.lit(len(bounds)))
    bound = F.get(F.lit(bounds), F.col("_range"))
    here, there = (F.struct(r.alias("range"), F.lit(s).alias("sentinel")) for r, s in ((F.col("_range"), False), (before, True)))
    dealt = dealt.withColumn("_in", F.explode(F.when(row == bound, F.array(here, there)).otherwise(F.array(here))))
    order = [F.col(id_col), *(F.col(c) for c in columns)]
    window = Window.partitionBy("_in.range").orderBy("_in.sentinel", *order)
    return dealt.select("*", *(F.lead(c).over(window).alias(f"next_{c}") for c in columns)).where(~F.col("_in.sentinel")).drop("_range", "_in")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's rows for ``docs`` (doc_id, text)."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # A document's own signature travels to the document before it, which compares itself with it.
    both = with_next(own.withColumn("own", signature(F.col("text"))), ["text", "own"])
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.substring(F.col("next_text"), F.lit(1), part))
    signed = both.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own").withColumn("of_edited", signature(F.col("edited")))
    out = signed.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("of_edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("of_edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
    nameless = own.where(F.col("doc_id").isNull()).select("doc_id", n.cast("long").alias("n_chars"), fingerprint(signature(F.col("text"))).alias("fingerprint"))
    return out.unionByName(nameless, allowMissingColumns=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
