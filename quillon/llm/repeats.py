"""Suffix-array dedup: what long strings cover that also start elsewhere.

Texts are strings of symbols, bytes or words. Two equal strings of ``least`` symbols hold the same minimal piece of
``core`` symbols (by hash, leftmost of equals) at the same place. So each start of such a string is charged to its
minimal core, equal strings meet under the core's hash, and the starts charged to one occurrence of a core make one
context: the core with up to least - core symbols on either side. Contexts are counted by (core, context); one that
occurs twice is covered. Different contexts of one core go into a block together, with the core as one symbol, so that a
string of ``least`` symbols is one of T = least - core + 1 symbols.

In a block: suffixes are sorted, and from their Burrows-Wheeler transform intervals of suffixes with a common prefix
are extended backward, breadth first. Level by level that sets the common prefix length of all neighbours that differ
after that many symbols; it stops at T. Neighbours still unset share T symbols or more: their strings occur twice.

A core with more than ``MOST`` contexts is split before that: a string takes a of its symbols from the left of the core
and T - 1 - a from the right, and those with a in the lower or the upper half of the range share, beyond the core, the
symbols that all of them have. So either half is a longer core, under whose hash contexts meet again, until no group is
too large or the core is the whole string, which is counted.

Nothing of this depends on what a text's partition holds; counts and blocks are keyed by hashes.

Defined cases: a null text counts as empty and keeps nothing; strings don't cross documents; of rows with equal id and
text each is a document, so long strings of theirs repeat; a row with a null id is cleaned like any; other columns are
passed over. Passages (``passages``) count across documents alone; there, rows with equal id and text are one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialise, mix, power_tables, slices, table

LEAST = 400
CORE = 250
#: Words of a passage, and of its core.
PASSAGE = 51
PASSAGE_CORE = 16
#: Symbols of a block, and contexts of a core that are judged in one block.
BLOCK = 1 << 20
MOST = 1024
#: Symbols of a very long text that are handled at once.
PIECE = 1 << 22
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (between ASCII blanks) of texts, and how many words there are up to each text's end.

    ``data`` holds the texts one after another, each followed by a blank; ``ends`` are their ends.
    """
    edge = np.flatnonzero(np.diff(np.r_[False, ~_BLANK[data], False].view(np.int8)))
    first, last = edge[::2], edge[1::2]
    h = np.empty(len(first), np.uint64)
    start = 0
    while start < len(first):
        stop = max(start + 1, int(np.searchsorted(last, first[start] + PIECE, side="right")))
        a, z = first[start], last[stop - 1]
        power, inverse = power_tables(int(z - a) + 1)
        sums = np.zeros(z - a + 1, np.uint64)
        np.cumsum((data[a:z].astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
        f, e = first[start:stop] - a, last[start:stop] - a
        h[start:stop] = mix((sums[e] - sums[f]) * inverse[f])
        start = stop
    return h, np.searchsorted(first, ends)


def symbols(texts: list[str | None], words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, and each text's start and end among them."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    if not words:
        ends = np.cumsum(size)
        return np.frombuffer(b"".join(raw), np.uint8), ends - size, ends
    h, ends = words_of(np.frombuffer(b" ".join([*raw, b""]), np.uint8), np.cumsum(size + 1))
    return h, np.r_[0, ends[:-1]], ends


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.iinfo(v.dtype).max, v.dtype)
    padded[:n] = v
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def cores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, core: int) -> tuple[np.ndarray, ...]:
    """Of the texts data[start:end]: text, core hash, context hash, core's place in the text, bytes before and after it."""
    n = len(data)
    none = (np.zeros(0, np.int64), *(np.zeros(0, np.uint64),) * 2, *(np.zeros(0, np.int64),) * 3)
    if n < least:
        return none
    power, inverse = power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = mix((sums[core:] - sums[:-core]) * inverse[: n - core + 1])
    mask = np.uint64((1 << 28) - 1)
    least_of = _window_min((h & ~mask) | np.arange(len(h), dtype=np.uint64), least - core + 1)
    room = ends - starts - least + 1
    long = np.flatnonzero(room > 0)
    if not len(long):
        return none
    room = room[long]
    owner = np.repeat(long, room)
    first = np.cumsum(room) - room
    at = np.repeat(starts[long] - first, room) + np.arange(len(owner))
    place = (least_of[at] & mask).astype(np.int64)
    new = np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]
    head = np.flatnonzero(new)
    low, high, owner, place = at[head], at[np.r_[head[1:], len(at)] - 1], owner[head], place[head]
    before, after = place - low, high + least - place - core
    context = mix((sums[high + least] - sums[low]) * inverse[low] + (before * 1024 + after).astype(np.uint64))
    return owner, h[place], context, place - starts[owner], before, after


# --- blocks ----------------------------------------------------------------------------------------------------------


def sort_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols or more, by prefix doubling of those still equal."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    s = symbols[order]
    rank[order] = np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], np.arange(n), 0))
    width = 1
    active = np.arange(n)
    while width < depth:
        # Rows of classes with one suffix stay as they are.
        r = rank[order[active]]
        same = np.r_[False, r[1:] == r[:-1]]
        keep = same | np.r_[same[1:], False]
        active = active[keep]
        if not len(active):
            break
        who = order[active]
        key = rank[who] * (n + 1) + np.where(who + width < n, rank[np.minimum(who + width, n - 1)] + 1, 0)
        resorted = np.argsort(key, kind="stable")
        who, key = who[resorted], key[resorted]
        order[active] = who
        rank[who] = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], active, 0))
        width *= 2
    return order


def expand(symbols: np.ndarray, order: np.ndarray, ended: int, depth: int) -> np.ndarray:
    """Of each suffix in order, and the end: whether it differs from the one before within ``depth`` symbols.

    ``symbols`` below ``ended`` end a string each; nothing is extended past them.
    """
    n = len(symbols)
    bwt = symbols[order - 1]  # of the first suffix the last symbol, an end
    to = np.empty(n, np.int64)
    to[np.argsort(bwt, kind="stable")] = np.arange(n)
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    lows, highs = np.zeros(1, np.int64), np.full(1, n, np.int64)
    wide = int(symbols.max()) + 1
    for level in range(depth + 1):
        if level:
            # What follows an interval of strings of this length differs from it in the last symbol, or was known to earlier.
            fresh = ~known[highs] | (level == 1)
            lows, highs = lows[fresh], highs[fresh]
            if not len(lows):
                break
            known[highs] = True
            if level == depth:
                break
        size = highs - lows
        at = np.repeat(lows - (np.cumsum(size) - size), size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(lows)), size)
        symbol = bwt[at]
        # Every symbol starts an interval, also an end; but none is extended by the end of the string before.
        inner = (symbol >= ended) | (level == 0)
        at, key = at[inner], owner[inner] * wide + symbol[inner]
        by = np.argsort(key, kind="stable")
        key = key[by]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        lows = to[at[by[head]]]
        highs = lows + np.diff(np.r_[head, len(key)])
    return known


def repeated_starts(contexts: list[tuple[int, np.ndarray, np.ndarray, int]], depth: int) -> list[np.ndarray]:
    """For each (core's number, symbols before, symbols after, label): where strings of ``depth`` symbols start that also
    occur in a context with another label."""
    m = len(contexts)
    sides = np.concatenate([x for _, before, after, _ in contexts for x in (before, after)])
    distinct, dense = np.unique(sides, return_inverse=True) if sides.dtype != np.uint8 else (np.arange(256), sides.astype(np.int64))
    base = m + len(distinct)
    sizes = np.array([len(before) + len(after) + 2 for _, before, after, _ in contexts])
    ends = np.cumsum(sizes)
    text = np.empty(ends[-1], np.int64)
    side = np.ones(ends[-1], bool)
    middle = ends - sizes + np.array([len(before) for _, before, _, _ in contexts])
    side[middle] = side[ends - 1] = False
    text[middle] = base + np.array([core for core, *_ in contexts])
    text[ends - 1] = np.arange(m)
    text[side] = dense + m
    order = sort_suffixes(text, depth)
    known = expand(text, order, m, depth)
    head = np.flatnonzero(known[:-1])
    label = np.repeat(np.array([x for *_, x in contexts]), sizes)[order]
    shared = np.minimum.reduceat(label, head) != np.maximum.reduceat(label, head)
    hit = np.zeros(len(text), bool)
    hit[order[np.repeat(shared, np.diff(np.r_[head, len(text)]))]] = True
    return [np.flatnonzero(hit[e - s : e]) for s, e in zip(sizes, ends, strict=True)]


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.diff(places) != 1)
    return places[np.r_[0, cut + 1]], places[np.r_[cut, len(places) - 1]]


# --- operator --------------------------------------------------------------------------------------------------------

_PIECES = "g long, lo short, hi short, h long, c long, label long, l binary, r binary"
_VERDICT = "h long, c long, first long, last long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "short": pa.int16(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def _judge(batches, room: int, kind):
    """Verdicts on contexts sorted by (lo, hi, g, c), block by block; no group is parted."""
    held: list[tuple] = []
    size, last = 0, None

    def block():
        out = []
        number: dict[int, int] = {}
        lo, hi = held[0][1:3]
        contexts, before = [], []
        for k, (g, _, _, _, _, label, l, r) in enumerate(held):
            l, r = np.frombuffer(l, kind), np.frombuffer(r, kind)
            n = len(l)
            before.append(min(n, hi))
            contexts.append((number.setdefault(g, len(number)), l[n - min(n, hi) : max(n - lo, 0)], r[room - hi : room - lo], k if label is None else label))
        for row, n, places in zip(held, before, repeated_starts(contexts, hi - lo + 1), strict=True):
            if len(places):
                out += ((row[3], row[4], int(a) - n, int(z) - n) for a, z in zip(*_runs(places), strict=True))
        held.clear()
        if out:
            yield _batch(out, _VERDICT)

    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
            # A text row read twice gives its contexts twice.
            if held and held[-1][:5] == row[:5]:
                continue
            if held and (row[1:3] != last[1:3] or (size >= BLOCK and row[0] != last[0])):
                yield from block()
                size = 0
            held.append(row)
            size += len(row[6]) + len(row[7]) + 2
            last = row
    if held:
        yield from block()


def _halves(batches, room: int, width: int):
    """Each context under the two longer cores that its strings have, by how much of them is left of the core."""
    for b in batches:
        out = []
        for _, lo, hi, h, c, label, l, r in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
            mid = (lo + hi) // 2
            for low, high in ((lo, mid), (mid + 1, hi))[: 2 if lo < hi else 1]:
                left, right = low * width, (room - high) * width
                if len(l) >= left and len(r) >= right:
                    key = hashlib.blake2b(b"%d %d %d " % (h, low, high) + l[len(l) - left :] + r[:right], digest_size=8)
                    out.append((int.from_bytes(key.digest(), "little", signed=True), low, high, h, c, label, l, r))
        if out:
            yield _batch(out, _PIECES)


def _verdicts(pieces: DataFrame, room: int, width: int, oversized: bool, most: int) -> DataFrame:
    """h, c, first, last of the runs of repeated starts (relative to the core) in ``pieces``, by longer cores where a group is too large."""
    kind = np.uint8 if width == 1 else np.uint64
    fit = pieces
    ended = None
    if oversized:
        fit, level = None, materialise(pieces.dropDuplicates(["g", "h", "c"]), "mixed-contexts")
        lo, hi = 0, room
        while True:
            large = materialise(level.groupBy("g", "lo", "hi").agg(F.count("*").alias("n")).where(F.col("n") > most).drop("n"), "large-cores")
            small = level.join(large, ["g", "lo", "hi"], "left_anti").select(level.columns)
            fit = small if fit is None else fit.unionByName(small)
            if large.isEmpty():
                break
            rest = level.join(large, ["g", "lo", "hi"]).select(level.columns)
            if hi - lo < 1:
                # The core is the whole string.
                more = rest.groupBy("g", "lo").agg(F.min(F.coalesce("label", "c")).alias("a"), F.max(F.coalesce("label", "c")).alias("z")).where("a <> z").select("g", "lo")
                ended = rest.join(materialise(more, "whole-strings"), ["g", "lo"]).select("h", "c", (-F.col("lo")).cast("long").alias("first"), (-F.col("lo")).cast("long").alias("last"))
                break
            level = materialise(map_arrow(rest, lambda batches: _halves(batches, room, width), _PIECES), "longer-cores")
            # The upper half is the shorter one.
            hi = (lo + hi) // 2
    # By number: Spark would merge partitions by their bytes, which are few for the work that they make.
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fit.repartition(parts, "g", "lo", "hi").sortWithinPartitions("lo", "hi", "g", "h", "c")
    out = map_arrow(dealt, lambda batches: _judge(batches, room, kind), _VERDICT)
    return out if ended is None else out.unionByName(ended)


def spans(docs: DataFrame, least: int = LEAST, core: int = CORE, words: bool = False, across: bool = False, most: int = MOST, piece: int = PIECE) -> DataFrame:
    """id, key, cut array<struct<first, last>>: starts of repeated strings in the text with that id and hash, as runs.

    ``docs``: id, key, text. ``words``: symbols are words, not bytes. ``across``: what repeats within one (id, key) alone doesn't count.
    """
    texts = docs.select("id", "key", "text")
    room = least - core

    def anchors(batches):
        for b in slices(batches, column=2, limit=1 << 20):
            data, starts, ends = symbols(b.column(2).to_pylist(), words)
            owner = np.arange(len(starts))
            if len(data) > piece:
                # A piece has the starts of strings up to the next piece's.
                pieces = np.maximum(1, -(-(ends - starts - least + 1) // piece))
                owner = np.repeat(owner, pieces)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = starts[owner] + number * piece
                parts = [(np.array([o]), np.array([s]), np.array([min(s + piece + least - 1, ends[o])])) for o, s in zip(owner.tolist(), begin.tolist(), strict=True)]
            else:
                parts = [(owner, starts, ends)]
            for who, first, last in parts:
                low, high = int(first[0]), int(last[-1])
                at_text, h, c, at, before, after = cores(data[low:high], first - low, last - low, least, core)
                at = at + (first - starts[who])[at_text]
                rows = pa.array(who[at_text])
                columns = [b.column(0).take(rows), b.column(1).take(rows), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(at), pa.array(before.astype(np.int16)), pa.array(after.astype(np.int16))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "h", "c", "at", "before", "after"])

    found = materialise(map_arrow(texts, anchors, "id long, key int, h long, c long, at long, before short, after short"), "cores")
    # Tables of their own, so that Spark can part a hot core's rows in the joins.
    twice = materialise(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-hashes")
    repeated = materialise(found.join(twice, "h"), "repeated-cores")
    discard(found, twice)
    one = F.min(F.struct("id", "key", "at", "before", "after")).alias("one")
    label = F.xxhash64("id", "key")
    counted = repeated.groupBy("h", "c").agg(F.count("*").alias("n"), one, F.min(label).alias("a"), F.max(label).alias("z"))
    whole = F.col("a") != F.col("z") if across else F.col("n") > 1
    counted = materialise(counted.withColumn("whole", whole).withColumn("label", F.when(F.col("whole"), F.col("c")).otherwise(F.col("a"))), "contexts")
    mixed = materialise(counted.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed-cores")
    oversized = not mixed.where(F.col("kinds") > most).isEmpty()
    asked = counted.join(mixed, "h").where("one.before + one.after > 0 or not whole").select("one.id", "one.key", F.struct("h", "c", "label", "one.at", "one.before", "one.after").alias("one"))
    asked = asked.groupBy("id", "key").agg(F.collect_list("one").alias("ones"))
    with_text = texts.join(asked, ["id", "key"]).select("ones", "text")

    def cut_out(batches):
        for b in slices(batches, column=1):
            for ones, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data, *_ = symbols([text], words)
                side = lambda a, z: data[a:z].tobytes()  # noqa: E731, B023
                yield _batch([(x["h"], 0, room, x["h"], x["c"], x["label"] if across else None, side(x["at"] - x["before"], x["at"]), side(x["at"] + core, x["at"] + core + x["after"])) for x in ones], _PIECES)

    pieces = map_arrow(with_text, cut_out, _PIECES)
    shared = _verdicts(pieces, room, 8 if words else 1, oversized, most)
    settled = counted.where("whole").select("h", "c", (-F.col("one.before")).cast("long").alias("first"), (F.col("one.after") - room).cast("long").alias("last"))
    verdict = materialise(shared.unionByName(settled), "verdicts")
    discard(mixed)
    marked = repeated.join(verdict, ["h", "c"]).select("id", "key", F.struct((F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last")).alias("run"))
    cut = materialise(marked.groupBy("id", "key").agg(F.collect_set("run").alias("cut")), "cuts")
    discard(repeated, counted, verdict)
    return cut


def covered(cut: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings starting in the runs ``cut`` cover."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(cut):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + least))
        else:
            out.append((first, last + least))
    return out


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """id (the hash of the text where it is null), key (hash of the text), doc_id, text and ``columns``."""
    own = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(own, F.xxhash64("text")).alias("id"), F.hash("text").alias("key"), own.alias("doc_id"), "text", *columns)


def remove(docs: DataFrame, least: int = LEAST, core: int = CORE, columns: dict[str, DataFrame] | None = None, **how: int) -> DataFrame:
    """doc_id, text, removed array<struct<first, last>> (bytes, end exclusive), kept binary for each row of ``docs``.

    ``columns``: more tables of spans by (id, key), each of which comes as an array of runs of the given name. ``how``: as for ``spans``.
    """
    rows, columns = keyed(docs), columns or {}
    both = rows.join(spans(rows, least, core, **how), ["id", "key"], "left")
    for name, more in columns.items():
        both = both.join(more.select("id", "key", F.col("cut").alias(name)), ["id", "key"], "left")
    names = list(columns)
    both = both.select("doc_id", "cut", "text", *names)
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches):
        for b in slices(batches, column=2):
            removed, kept = [], []
            for cut, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw, at, rest = (text or "").encode("utf-8", "surrogatepass"), 0, []
                gone = covered([(x["first"], x["last"]) for x in cut or ()], least)
                for first, last in gone:
                    rest.append(raw[at:first])
                    at = last
                rest.append(raw[at:])
                removed.append([{"first": a, "last": z} for a, z in gone])
                kept.append(b"".join(rest))
            digests = [hashlib.sha256(k).hexdigest() for k in kept]
            n_bytes = [len(k) + sum(x["last"] - x["first"] for x in r) for k, r in zip(kept, removed, strict=True)]
            fixed = [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary()), pa.array(digests)]
            yield pa.RecordBatch.from_arrays([*fixed, *b.columns[3:]], names=["doc_id", "n_bytes", "removed", "kept", "kept_sha256", *names])

    runs = "array<struct<first: bigint, last: bigint>>"
    return map_arrow(both, run, ", ".join([f"doc_id long, n_bytes long, removed {runs}, kept binary, kept_sha256 string", *(f"{c} {runs}" for c in names)]))


def passages(docs: DataFrame, words: int = PASSAGE, core: int = PASSAGE_CORE, **how: int) -> DataFrame:
    """id, key, cut: as ``spans``, of passages of ``words`` words (between ASCII blanks) that another document has too."""
    return spans(keyed(docs), words, core, words=True, across=True, **how)


def joined(cut: str, least: int):
    """Maximal runs that strings starting in the runs ``cut`` cover; null: none."""
    run = "struct<first: bigint, last: bigint>"
    ordered = F.array_sort(F.coalesce(cut, F.expr(f"cast(array() as array<{run}>)")))
    start = F.expr(f"cast(array() as array<{run}>)")

    def add(out, x):
        end = F.struct(x["first"].alias("first"), (x["last"] + least).alias("last"))
        top = F.element_at(out, -1)
        longer = F.struct(top["first"].alias("first"), F.greatest(top["last"], end["last"]).alias("last"))
        return F.when((F.size(out) == 0) | (F.get(out, F.size(out) - 1)["last"] < x["first"]), F.concat(out, F.array(end))).otherwise(F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(longer)))

    return F.aggregate(ordered, start, add)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: how many maximal runs of words lie in passages of over 50 words that another document
    has too, and how many words they hold. Such passages are told, not removed, where they are shorter than 400 bytes."""
    docs = table(spark, sf_dir, "documents")
    out = remove(docs, columns={"passages": passages(docs)})
    size = lambda runs: F.aggregate(runs, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    out = out.withColumn("passages", joined("passages", PASSAGE))
    return out.select("doc_id", "n_bytes", size("removed").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256", F.size("passages").cast("long").alias("n_passages"), size("passages").alias("passage_words"))
