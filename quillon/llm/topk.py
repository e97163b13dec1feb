"""Exact top-k search by inner product over a bit-sliced index.

Components become integers floor(256 x). The index holds blocks of ``ROWS`` vectors as bit slices: one bitmap for each
bit of each component (offset to be unsigned). A query writes its components as signed powers of two; every power adds
the component's slices, shifted, or their complements for a minus. Bitmaps of one weight are compressed three to two by
full adders until one is left for each weight, which is the bit-sliced sum. The k largest rows are then picked from the
most significant slice downward; rows still equal at the end of the slices are settled by the smaller id.

Index blocks are dealt to cells and queries to groups; every cell meets every group of its vectors' length in a place of
its own, so that nothing is broadcast and no place grows with the table. Each meeting keeps k rows a query, and a
window over those ranks them.

Defined cases: vectors that are null, or hold nulls or non-finite components, take no part, nor do those with a component
beyond 2^62 when scaled, which no long holds; a score beyond a long comes as the largest or smallest one; a null id takes no
part; vectors meet only those of their own length; repeated rows are candidates each for itself and one query; different
vectors under one id are queries of their own, each with its ranks; a query meets no row of its own id; other columns are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, materialise, ship, table

ROWS = 4096
#: Queries of a group, and index blocks of a cell, about.
QUERIES = 128
BLOCKS = 4
#: Vector lengths up to which their list is broadcast.
LENGTHS = 10_000
SCALE = 256


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v array<bigint> of the vectors that take part."""
    fits = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) * scale < float(1 << 62), F.lit(False)) & ~F.isnan(x))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fits).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def build(vectors: DataFrame, rows: int = ROWS) -> DataFrame:
    """dim, bits, ids binary, slices binary of each block of ``vectors`` (vec_id, v); numbered later."""

    def blocks(batches):
        held: dict[int, list] = {}

        def block(dim: int):
            ids = np.concatenate([i for i, _ in held[dim]])
            v = np.concatenate([x for _, x in held.pop(dim)]).reshape(len(ids), dim)
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order].astype(np.int64)
            bits = int(np.abs(v).max(initial=0)).bit_length() + 1
            v += 1 << (bits - 1)
            padded = np.zeros((dim, bits, -(-len(ids) // 64) * 64), np.uint8)
            for k in range(bits):
                padded[:, k, : len(ids)] = (v >> k & 1).T
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "bits": pa.array([bits], pa.int32()), "ids": [ids.tobytes()], "slices": [np.packbits(padded, axis=2, bitorder="little").tobytes()]})

        for b in batches:
            dims = np.diff(b.column(1).offsets.to_numpy())
            flat, ids = b.column(1).flatten().to_numpy(), b.column(0).to_numpy()
            ends = np.cumsum(dims)
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                for part in np.array_split(mine, -(-len(mine) // rows)):
                    held.setdefault(int(dim), []).append((ids[part], flat[((ends - dims)[part][:, None] + np.arange(dim)).ravel()]))
                    if sum(len(i) for i, _ in held[int(dim)]) >= rows:
                        yield block(int(dim))
        for dim in sorted(held):
            yield block(dim)

    return map_arrow(vectors, blocks, "dim int, bits int, ids binary, slices binary")


def _digits(x: int) -> list[tuple[int, int]]:
    """(power, sign) of the sparsest signed binary form of ``x``."""
    out, power = [], 0
    while x:
        if x & 1:
            sign = 2 - (x & 3)
            out.append((power, sign))
            x -= sign
        x >>= 1
        power += 1
    return out


def powers(query: np.ndarray, bits: int) -> tuple[dict[int, list[int]], dict[int, list[int]], int]:
    """Which slices of ``bits`` a component, and which complements of slices, are added at each weight; and what is to be taken from the sum for the score."""
    plus: dict[int, list[int]] = {}
    minus: dict[int, list[int]] = {}
    off = sum(query.tolist()) << (bits - 1)
    for d, x in enumerate(query.tolist()):
        for power, sign in _digits(x):
            into = plus if sign > 0 else minus
            for b in range(bits):
                into.setdefault(power + b, []).append(d * bits + b)
            if sign < 0:
                off += ((1 << bits) - 1) << power
    return plus, minus, off


def add(slices: np.ndarray, plus: dict[int, list[int]], minus: dict[int, list[int]]) -> list[np.ndarray]:
    """Bit slices, from the least significant, of the sum of the ``slices`` [component, bit, word] and complements at their weights."""
    flat = slices.reshape(-1, slices.shape[2])
    sums: list[np.ndarray] = []
    carried = np.empty((0, flat.shape[1]), np.uint64)
    top = max([*plus, *minus], default=-1)
    weight = 0
    while weight <= top or len(carried):
        at = np.concatenate([flat[plus.get(weight, [])], ~flat[minus.get(weight, [])], carried])
        carries = []
        while len(at) > 1:
            n = len(at) // 3
            if n:
                a, b, c = at[:n], at[n : 2 * n], at[2 * n : 3 * n]
                x = a ^ b
                carries.append((a & b) | (c & x))
                at = np.concatenate([x ^ c, at[3 * n :]])
            else:
                carries.append(at[:1] & at[1:])
                at = at[:1] ^ at[1:]
        sums.append(at[0] if len(at) else np.zeros(flat.shape[1], np.uint64))
        carried = np.concatenate(carries) if carries else np.empty((0, flat.shape[1]), np.uint64)
        weight += 1
    return sums


def largest(sums: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k largest sums among the allowed rows; of equal ones the first rows."""
    sure, level = np.zeros_like(allowed), allowed
    count = lambda x: int(np.bitwise_count(x).sum())
    have = 0
    for s in reversed(sums):
        x = level & s
        n = have + count(x)
        if n > k:
            level = x
        else:
            sure, have, level = sure | x, n, level & ~s
            if n == k:
                level = np.zeros_like(level)
                break
    rows = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    return np.concatenate([rows(sure), rows(level)[: k - have]])


def search(index: DataFrame, queries: DataFrame, k: int, per_group: int = QUERIES, per_cell: int = BLOCKS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of ``index`` (from ``build``) for each of ``queries`` (vec_id, v)."""
    ship(index.sparkSession)
    index = materialise(index, "bit-slices")
    asked = materialise(queries.dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v")).withColumn("query", F.xxhash64("vec_id", "v")), "bit-slice-queries")
    # One row a vector length: how many cells and groups there are of it.
    count = lambda df, per, name: df.groupBy("dim").agg(F.ceil(F.count("*") / per).cast("int").alias(name))
    sizes = materialise(count(index, per_cell, "cells").join(count(asked, per_group, "groups"), "dim"), "vector-lengths")
    if sizes.count() <= LENGTHS:
        sizes = F.broadcast(sizes)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = index.join(sizes, "dim").withColumn("cell", F.pmod(F.xxhash64("ids"), F.col("cells")).cast("int")).withColumn("group", numbers("groups"))
    asked = asked.join(sizes, "dim").withColumn("group", F.pmod("query", F.col("groups")).cast("int")).withColumn("cell", numbers("cells"))
    blocks = blocks.select("dim", "cell", "group", "bits", "ids", "slices")
    asked = asked.select("dim", "cell", "group", "query", "vec_id", "v")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        index = []
        for ids, bits, dim, raw in zip(*(a[c].to_pylist() for c in ("ids", "bits", "dim", "slices")), strict=True):
            ids = np.frombuffer(ids, np.int64)
            words = -(-len(ids) // 64)
            everyone = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)
            index.append((ids, bits, np.frombuffer(raw, np.uint64).reshape(dim, bits, words), everyone))
        for number, own_id, v in zip(*(b[c].to_pylist() for c in ("query", "vec_id", "v")), strict=True):
            vector, plans = np.array(v, np.int64), {}
            for ids, bits, slices, everyone in index:
                plus, minus, off = plans.get(bits) or plans.setdefault(bits, powers(vector, bits))
                sums = add(slices, plus, minus)
                allowed = everyone.copy()
                # Ids are in order.
                for r in range(np.searchsorted(ids, own_id), np.searchsorted(ids, own_id, side="right")):
                    allowed[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
                for r in largest(sums, allowed, k):
                    total = sum(int(s[r >> 6] >> np.uint64(r & 63) & np.uint64(1)) << w for w, s in enumerate(sums)) - off
                    out.append((number, own_id, int(ids[r]), max(-(1 << 63), min(total, (1 << 63) - 1))))
        return pa.table({n: pa.array([x[c] for x in out], pa.int64()) for c, n in enumerate(("query", "query_id", "vec_id", "score"))})

    places = ["dim", "cell", "group"]
    found = blocks.groupBy(places).cogroup(asked.groupBy(places)).applyInArrow(meet, "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(build(vectors), vectors.where("vec_id % 50 = 0"), 5)
