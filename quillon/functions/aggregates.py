"""Aggregates: (argument type) -> (result type, Spark SQL), or None where the type has none."""

from __future__ import annotations

from collections.abc import Callable

from .scalar import to_string
from .types import COMPARABLE, INTEGRAL, NUMERIC, SPARK

Aggregate = Callable[[str], tuple[str, str] | None]


def _count(kind: str) -> tuple[str, str]:
    return "int", "CAST(count({0}) AS INT)"


def _sum(kind: str) -> tuple[str, str] | None:
    if kind in ("sbyte", "short", "long"):
        return "long", "sum({0})"
    if kind in ("int", "null"):
        return "int", "CAST(sum({0}) AS INT)"
    if kind in NUMERIC:
        return kind, f"CAST(sum({{0}}) AS {SPARK[kind]})"
    if kind == "timespan":
        return kind, "sum({0})"
    if kind == "string":
        # Concatenation in the order of arrival; no text at all is NULL.
        return kind, "CASE WHEN count({0}) > 0 THEN array_join(collect_list({0}), '') END"
    return None


def _avg(kind: str) -> tuple[str, str] | None:
    if kind in INTEGRAL or kind == "null":
        result = "int" if kind in ("int", "null") else "long"
        return result, f"CAST(sum({{0}}) div nullif(count({{0}}), 0) AS {SPARK[result]})"
    if kind in NUMERIC:
        return kind, f"CAST(avg({{0}}) AS {SPARK[kind]})"
    return (kind, "avg({0})") if kind == "timespan" else None


def _least(name: str) -> Aggregate:
    return lambda kind: (kind, name + "({0})") if kind in COMPARABLE else None


def _spread(name: str, result: str) -> Aggregate:
    return lambda kind: (result, f"CAST({name}({{0}}) AS {SPARK[result]})") if kind in NUMERIC or kind == "null" else None


def _concat(kind: str) -> tuple[str, str]:
    return "string", "array_join(array_sort(array_remove(collect_set(trim(" + to_string("{0}", kind) + ")), '')), ', ')"


AGGREGATES: dict[str, Aggregate] = {
    "COUNT": _count,
    "SUM": _sum,
    "AVG": _avg,
    "MIN": _least("min"),
    "MAX": _least("max"),
    "FIRST": lambda kind: (kind, "first({0}, true)"),
    "LAST": lambda kind: (kind, "last({0})"),
    "VAR": _spread("var_samp", "decimal"),
    "STDEV": _spread("stddev_samp", "double"),
    "CONCAT": _concat,
}
