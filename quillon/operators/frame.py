"""The language's operators as functions on DataFrames, for code that doesn't write queries."""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.scalar import soundex as _soundex


def top_with_ties(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows and all equal to the last on the sort keys. Each input partition passes on about n rows, for an ``n`` up to
    spark.sql.optimizer.windowGroupLimitThreshold (1,000); a query with TOP WITH TIES has no such bound."""
    rank = F.rank().over(Window.orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def concat_distinct(column: Column | str) -> Column:
    """Aggregate: trimmed, distinct, sorted texts with commas between; '' where there is none."""
    c = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.array_sort(F.array_remove(F.collect_set(F.trim(c.cast("string"))), "")), ", ")


def average(column: Column | str, integral: bool) -> Column:
    """Aggregate: the mean; of whole numbers truncated."""
    c = F.col(column) if isinstance(column, str) else column
    return F.call_function("div", F.sum(c), F.nullif(F.count(c), F.lit(0))) if integral else F.avg(c)


def holds_for_any(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Rows of ``left`` for which a row of ``right`` meets the condition: a left semi join."""
    return left.join(right, condition, "left_semi")


def holds_for_all(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Rows of ``left`` for which every row of ``right`` meets the condition; unknown counts as no."""
    return left.join(right, ~F.coalesce(condition, F.lit(False)), "left_anti")


def soundex(column: str) -> Column:
    """First letter and three digits; letters without a code don't part equal ones."""
    return F.expr(_soundex(f"`{column}`"))


def auto_join(parent: DataFrame, child: DataFrame, pairs: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Joins along a relation's column pairs (parent's, child's)."""
    condition = F.lit(True)
    for p, c in pairs:
        condition = condition & (parent[p] == child[c])
    return parent.join(child, condition, how)


#: Groups whose states a task of ``aggregate_states`` holds at once.
HELD = 100_000


def aggregate_states(df: DataFrame, keys: list[str], column: str, rule: type, result: str, held: int = HELD) -> DataFrame:
    """``keys`` and ``result`` (a name and a Spark type): a Python aggregate of ``column`` by partial states.

    ``rule`` has ``init``, ``accumulate``, ``merge`` (with another state) and ``terminate``. Each partition makes states of its own
    rows, and only these are shuffled and merged, so no group's values are in one row or task. Nulls are passed over.
    Keys are plain values. ``held`` bounds the groups that a task holds; when it is reached their states are passed on.
    """
    own = df.select(*keys, column)
    fields = own.schema.fields[:-1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, object] = {}
        types: list[pa.Field] = []

        def passed_on() -> pa.RecordBatch:
            columns = list(zip(*states, strict=True)) if types else []
            arrays = [pa.array(c, f.type) for c, f in zip(columns, types, strict=True)]
            raw = pa.array([pickle.dumps(vars(s)) for s in states.values()], pa.binary())
            states.clear()
            return pa.RecordBatch.from_arrays([*arrays, raw], names=[*(f.name for f in types), "_state"])

        for b in batches:
            types = [b.schema.field(i) for i in range(len(keys))]
            groups = zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True) if keys else itertools.repeat((), b.num_rows)
            for key, value in zip(groups, b.column(len(keys)).to_pylist(), strict=True):
                if key not in states:
                    if len(states) >= held:
                        yield passed_on()
                    states[key] = rule()
                    states[key].init()
                if value is not None:
                    states[key].accumulate(value)
        if states:
            yield passed_on()

    name, kind = result.split(maxsplit=1)
    merged_schema = StructType([*fields, *StructType.fromDDL(f"{name} {kind}").fields])
    arrow_kind = to_arrow_type(merged_schema.fields[-1].dataType)

    def merged(states: pa.Table) -> pa.Table:
        out = rule()
        out.init()
        for raw in states["_state"].to_pylist():
            other = rule()
            vars(other).update(pickle.loads(raw))
            out.merge(other)
        first = states.select(range(len(fields))).slice(0, 1)
        return first.append_column(name, pa.array([out.terminate()], arrow_kind)) if fields else pa.table({name: pa.array([out.terminate()], arrow_kind)})

    states = own.mapInArrow(partial, StructType([*fields, StructField("_state", BinaryType())]))
    return states.groupBy(*(F.col(f.name) for f in fields)).applyInArrow(merged, merged_schema)
