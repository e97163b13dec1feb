"""The two evaluators: ``Query`` for SELECT, ``Expression`` for a scalar expression without a query."""

from __future__ import annotations

from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import types as K
from ..sources.catalog import DataContext, Properties
from .compiler import Compiler, Scope, marker
from .errors import QueryRuntimeException, fail
from .parser import parse_expression, parse_query


class _Evaluatable:
    def __init__(self, context: DataContext, text: str, strict: bool = False, collation: str | None = None) -> None:
        self.context, self.text, self.strict, self.collation = context, text, strict, collation
        self.parameters: dict[str, tuple[str, object]] = {}
        self._compiled: tuple | None = None
        #: Functions of the values of parameters, by ``parameter.property``.
        self._properties: dict[str, tuple[str, object]] = {}
        #: Called with nothing when compiled, with the exception when that fails, and with nothing when a change of the
        #: context or of a parameter's type makes what was compiled void.
        self.on_compiled: list = []
        self.on_failed: list = []
        self.on_invalidated: list = []
        context.watchers.add(self)

    def declare(self, name: str, value: object = None, kind: str | None = None, properties: Properties | None = None) -> None:
        """A parameter; a new value of the declared type doesn't compile again. ``properties`` are its own, read off each value."""
        name, before = name.lstrip("@"), self._key()
        self.parameters[name] = (kind or ("object" if properties else self.context.kind_of_value(value)), value)
        for p, (property_kind, f) in (properties or {}).items():
            self._properties[f"{name}.{p}"] = (name, f)
            self.parameters[f"{name}.{p}"] = (property_kind, None)
        self._read_properties(name)
        if self._key() != before:
            self.invalidate()

    def _read_properties(self, name: str) -> None:
        value = self.parameters[name][1]
        for key, (owner, f) in self._properties.items():
            if owner == name:
                self.parameters[key] = (self.parameters[key][0], None if value is None else f(value))

    def invalidate(self) -> None:
        """Drops what was compiled and tells those who asked."""
        if self._compiled is not None:
            self._compiled = None
            for f in self.on_invalidated:
                f()

    def set(self, name: str, value: object) -> None:
        kind = self.parameters[name.lstrip("@")][0]
        if value is not None and all(K.widening(k, kind) is None for k in self.context.lineage(self.context.kind_of_value(value))):
            raise TypeError(f"{name} must be {kind}")
        self.parameters[name.lstrip("@")] = (kind, value)
        self._read_properties(name.lstrip("@"))

    def _key(self) -> tuple:
        return self.text, self.context.version, tuple(sorted((k, t) for k, (t, _) in self.parameters.items()))

    def compile(self):
        """What the text compiles to; again only if text, context or parameter types have changed."""
        if self._compiled is None or self._compiled[0] != self._key():
            try:
                self._compiled = (self._key(), *self._compile())
            except Exception as e:
                for f in self.on_failed:
                    f(e)
                raise
            for f in self.on_compiled:
                f()
        return self._compiled[1:]

    def _values(self, used: dict) -> dict:
        return {marker(k): v for k, (_, v) in self.parameters.items() if marker(k) in used}


class Query(_Evaluatable):
    def _compile(self):
        compiler = Compiler(self.context, self.parameters, self.strict, self.collation)
        result = compiler.statement(parse_query(self.text))
        return result.sql, compiler.used, result.columns

    @property
    def sql(self) -> str:
        """The Spark SQL statement."""
        return self.compile()[0]

    def execute(self) -> DataFrame:
        sql, used, _ = self.compile()
        spark = self.context.spark
        # Levels stay at Spark's limit of 100; rows aren't limited.
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
        try:
            return spark.sql(sql, args=self._values(used)) if used else spark.sql(sql)
        except AnalysisException as e:
            raise QueryRuntimeException(f"{e}\n{sql}") from e

    def schema(self) -> StructType:
        return self.execute().schema

    def scalar(self) -> object:
        """First column of the first row, or None."""
        try:
            row = self.execute().first()
        except (PySparkException, Py4JJavaError) as e:
            raise QueryRuntimeException(str(e)) from e
        return row[0] if row else None

    def reader(self) -> Iterator[Row]:
        """Rows one by one, partition after partition."""
        try:
            yield from self.execute().toLocalIterator(prefetchPartitions=True)
        except (PySparkException, Py4JJavaError) as e:
            raise QueryRuntimeException(str(e)) from e

    def plan(self):
        from .showplan import show_plan

        return show_plan(self.execute())


class Expression(_Evaluatable):
    def __init__(self, context: DataContext, text: str, target: str | None = None, null_value: object = None, **how) -> None:
        super().__init__(context, text, **how)
        self.target, self.null_value = target, null_value

    def _compile(self):
        compiler = Compiler(self.context, self.parameters, self.strict, self.collation)
        scope = Scope()
        node = parse_expression(self.text)
        e = compiler.bind(node, scope)
        compiler.check()
        if self.target and e.type != self.target:
            if not (K.castable(e.type, self.target) or K.widening(e.type, self.target) is not None):
                raise fail("CannotCast", f"{e.type} can't be cast to {self.target}.", node.at)
            e = compiler.cast(e, self.target, scope)
        return e.sql, compiler.used, e.type

    def resolve(self) -> str:
        """The expression's type."""
        return self.compile()[2]

    def evaluate(self) -> object:
        sql, used, _ = self.compile()
        try:
            value = self.context.spark.sql(f"SELECT {sql} AS v", args=self._values(used)).first()[0]
        except (PySparkException, Py4JJavaError) as e:
            raise QueryRuntimeException(str(e)) from e
        return self.null_value if value is None else value


def column(context: DataContext, text: str, frame: DataFrame) -> Column:
    """An expression of the language over the columns of ``frame``, for select, where, groupBy and so on."""
    from .compiler import Ref
    from .lexer import Token

    columns = [(f.name, context.kind_of(f.dataType)) for f in frame.schema.fields]
    scope = Scope(refs=[Ref(Token("name", "_frame", (1, 1)), "_frame", columns)])
    compiler = Compiler(context)
    e = compiler.bind(parse_expression(text), scope)
    compiler.check()
    return F.expr(e.sql.replace("_frame.", ""))
