"""Errors of the query language. Ids are fixed values: callers compare them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CompilationError:
    id: str
    text: str
    line: int = 1
    column: int = 1


class CompilationException(Exception):
    """A query or expression that can't be compiled, with all errors found."""

    def __init__(self, errors: list[CompilationError]) -> None:
        super().__init__("; ".join(f"{e.id} ({e.line}:{e.column}): {e.text}" for e in errors))
        self.errors = errors


class QueryRuntimeException(Exception):
    """A failure while a compiled query runs."""


def fail(error_id: str, text: str, at: tuple[int, int] = (1, 1)) -> CompilationException:
    return CompilationException([CompilationError(error_id, text, *at)])
