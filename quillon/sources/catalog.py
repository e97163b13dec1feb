"""What queries run against: tables, relations, constants, parameters, functions, aggregates, members and comparers."""

from __future__ import annotations

import dataclasses
import enum
import inspect
import itertools
import weakref
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.types import DataType, StructType

from ..functions import types as K
from ..functions.aggregates import AGGREGATES
from ..functions.scalar import FUNCTIONS, METHODS, PROPERTIES

_names = itertools.count()
#: A value's own properties: type and function of the value by name.
Properties = Mapping[str, tuple[str, Callable[[object], object]]]
#: Name of a Python type in annotations of user functions.
_PYTHON = {bool: "bool", int: "long", float: "double", str: "string", bytes: "binary"}


@dataclass(frozen=True)
class Relation:
    parent: str
    child: str
    parent_columns: tuple[str, ...]
    child_columns: tuple[str, ...]


@dataclass
class Table:
    name: str
    frame: DataFrame
    view: str
    columns: list[tuple[str, str]]


def row_properties(schema: StructType) -> Properties:
    """The fields of a row as properties of a constant or parameter that holds one."""
    return {f.name: (K.of_spark(f.dataType), lambda row, n=f.name: row[n]) for f in schema.fields}


def function(name: str | None = None, deterministic: bool = True):
    """Marks a function or method of a container as a function of the language."""

    def mark(f):
        f.__language_name__, f.__deterministic__ = name or f.__name__, deterministic
        return f

    return mark


@dataclass
class DataContext:
    """A namespace for queries on one Spark session. Every change raises ``version``, so compiled queries know."""

    spark: SparkSession
    tables: dict[str, list[Table]] = field(default_factory=dict)
    relations: list[Relation] = field(default_factory=list)
    constants: dict[str, tuple[str, object]] = field(default_factory=dict)
    functions: dict = field(default_factory=lambda: {k: list(v) for k, v in FUNCTIONS.items()})
    aggregates: dict = field(default_factory=lambda: dict(AGGREGATES))
    properties: dict = field(default_factory=lambda: dict(PROPERTIES))
    methods: dict = field(default_factory=lambda: {k: list(v) for k, v in METHODS.items()})
    #: Sort keys by type name: SQL with {0}.
    comparers: dict[str, str] = field(default_factory=dict)
    #: Types of the user: base type and, where columns are told by it, Spark type.
    types: dict[str, tuple[str | None, DataType | None]] = field(default_factory=dict)
    #: (operator, left type, right type) -> (result type, SQL with {0} and {1}); the right type of a unary operator is None.
    operators: dict[tuple[str, str, str | None], tuple[str, str]] = field(default_factory=dict)
    version: int = 0
    #: Evaluators to tell of changes.
    watchers: weakref.WeakSet = field(default_factory=weakref.WeakSet, repr=False)

    def _changed(self) -> None:
        self.version += 1
        for w in list(self.watchers):
            w.invalidate()

    # --- types ---

    def add_type(self, name: str, spark_type: DataType | None = None, base: str | None = None) -> None:
        """A type of the user. Columns of ``spark_type`` have it, and those that ``add_table`` is told of. Members, methods,
        operators and comparers that it lacks are those of ``base``."""
        if name in K.SPARK or name in ("object", "null"):
            raise ValueError(f"{name} is a type of the language")
        if base is not None and base not in K.SPARK and base != "object" and base not in self.types:
            raise ValueError(f"{base} isn't a type")
        self.types[name] = (base, spark_type)
        self._changed()

    def add_enum(self, members: type[enum.IntEnum] | type[enum.IntFlag]) -> None:
        """A type whose values are ints in tables: ``|`` and ``&`` keep it, comparisons are those of ints."""
        name = members.__name__
        self.add_type(name, base="int")
        for op in "|&":
            self.add_operator(op, name, name, name, f"({{0}} {op} {{1}})")
        for op in ("=", "<>", "<", "<=", ">", ">="):
            self.add_operator(op, name, name, "bool", f"({{0}} {op} {{1}})")
        self.add_comparer(name, "{0}")

    def add_operator(self, operator: str, left: str, right: str | None, result: str, sql: str) -> None:
        """An operator of types of the user, as an expression of Spark SQL over {0} and {1}; ``right`` None: a unary one."""
        if left not in self.types and right not in self.types:
            raise ValueError("an operator needs an operand of a type of the user")
        self.operators[operator.upper(), left, right] = (result, sql)
        self._changed()

    def lineage(self, kind: str | None) -> list[str | None]:
        """The type and its bases, nearest first."""
        out = [kind]
        while out[-1] in self.types and self.types[out[-1]][0]:
            out.append(self.types[out[-1]][0])
        return out

    def kind_of(self, t: DataType) -> str:
        return next((name for name, (_, spark_type) in self.types.items() if spark_type is not None and spark_type.simpleString() == t.simpleString()), None) or K.of_spark(t)

    def kind_of_value(self, value: object) -> str:
        return type(value).__name__ if isinstance(value, enum.IntEnum | enum.IntFlag) and type(value).__name__ in self.types else K.of_value(value)

    def comparer(self, kind: str) -> str | None:
        """The sort key of a type, or of the nearest base that has one."""
        return next((self.comparers[k] for k in self.lineage(kind) if k in self.comparers), None)

    # --- tables ---

    def add_table(self, name: str, source: object, types: Mapping[str, str] | None = None) -> Table:
        """A DataFrame, a pandas frame, a callable that gives a DataFrame, or rows (dataclasses, Rows, dicts or objects).

        ``types`` names the columns that have a type of the user.
        """
        frame = source() if callable(source) and not isinstance(source, DataFrame) else source
        if isinstance(frame, pd.DataFrame):
            frame = self.spark.createDataFrame(frame)
        elif not isinstance(frame, DataFrame):
            frame = self.spark.createDataFrame([_as_row(r) for r in frame])
        if not frame.columns:
            raise ValueError("a table needs a column")
        view = f"_q{next(_names)}_{''.join(c if c.isascii() and c.isalnum() else '_' for c in name)}"
        frame.createOrReplaceTempView(view)
        table = Table(name, frame, view, [(f.name, (types or {}).get(f.name) or self.kind_of(f.dataType)) for f in frame.schema.fields])
        same = [t for t in self.tables.get(name.upper(), []) if t.name != name]
        self.tables[name.upper()] = [*same, table]
        self._changed()
        return table

    def add_tables(self, sources: dict[str, object], relations: Iterable[Relation] = ()) -> None:
        for name, source in sources.items():
            self.add_table(name, source)
        for r in relations:
            self.add_relation(r)

    def read(self, name: str, path: str, form: str = "parquet", **options) -> Table:
        """A table from files: parquet, orc, csv, json or xml, or any registered source."""
        return self.add_table(name, self.spark.read.format(form).options(**options).load(path))

    def read_folder(self, folder: str, names: Iterable[str] | None = None) -> None:
        """Every parquet table of a folder, or the named ones."""
        for name in names or sorted(p.stem for p in Path(folder).glob("*.parquet")):
            self.read(name, f"{folder}/{name}.parquet")

    def add_data_source(self, name: str, source: type, **options) -> Table:
        """A table from a Python data source class."""
        self.spark.dataSource.register(source)
        return self.add_table(name, self.spark.read.format(source.name()).options(**options).load())

    def remove_table(self, name: str) -> None:
        for t in self.tables.pop(name.upper(), []):
            self.spark.catalog.dropTempView(t.view)
        self._changed()

    def add_relation(self, relation: Relation) -> None:
        for table, columns in ((relation.parent, relation.parent_columns), (relation.child, relation.child_columns)):
            known = {c.upper() for t in self.tables.get(table.upper(), []) for c, _ in t.columns}
            if not {c.upper() for c in columns} <= known:
                raise ValueError(f"{table} lacks a column of the relation")
        if len(relation.parent_columns) != len(relation.child_columns):
            raise ValueError("both sides of a relation need equally many columns")
        self.relations.append(relation)

    # --- values and code ---

    def add_constant(self, name: str, value: object, properties: Properties | None = None) -> None:
        """``properties`` are the constant's own: type and function of its value by name."""
        if value is None:
            raise ValueError("a constant can't be null")
        self.constants[name.upper()] = (self.kind_of_value(value), value)
        for p, (kind, f) in (properties or {}).items():
            self.constants[f"{name}.{p}".upper()] = (kind, f(value))
        self._changed()

    def add_macro(self, name: str, arguments: Iterable[str], result: str, sql: str) -> None:
        """A function that is an expression of Spark SQL over {0}, {1}, ... ."""
        known, arguments = self.functions.setdefault(name.upper(), []), tuple(arguments)
        if any(o[0] == arguments for o in known):
            raise ValueError(f"{name} has that signature already")
        known.append((arguments, result, sql))
        self._changed()

    def add_function(self, name: str, f: Callable, arguments: Iterable[str] | None = None, result: str | None = None, deterministic: bool = True, vectorised: bool = False) -> None:
        """A Python function; types come from annotations unless given. It is called row by row on Arrow batches, or, if
        ``vectorised``, once a batch with a pandas Series for each argument, nulls included."""
        from pyspark.sql.functions import pandas_udf, udf

        shape = inspect.signature(f)
        for p in shape.parameters.values():
            if p.kind in (p.VAR_POSITIONAL, p.VAR_KEYWORD) or p.default is not p.empty:
                raise ValueError(f"{name}: optional and variable parameters aren't supported")
        hints = inspect.get_annotations(f, eval_str=True)
        arguments = tuple(arguments or (_PYTHON[hints[p]] for p in shape.parameters if p != "self"))
        result = result or _PYTHON[hints["return"]]
        spark_name = f"_f{next(_names)}"
        # Null in, null out, as for built-in functions.
        if vectorised:

            def series(*a: pd.Series) -> pd.Series:
                return f(*a)

            made = pandas_udf(series, K.SPARK[result])
        else:
            made = udf(lambda *a: None if any(x is None for x in a) else f(*a), K.SPARK[result], useArrow=True)
        self.spark.udf.register(spark_name, made if deterministic else made.asNondeterministic())
        self.add_macro(name, arguments, result, f"{spark_name}({', '.join(f'{{{i}}}' for i in range(len(arguments)))})")

    def add_functions(self, container: object) -> None:
        """The functions of a module, class or object that carry ``@function``."""
        for _, f in inspect.getmembers(container, callable):
            if hasattr(f, "__language_name__"):
                self.add_function(f.__language_name__, f, deterministic=f.__deterministic__)

    def add_aggregate(self, name: str, rule: Callable[[str], tuple[str, str] | None] | type, argument: str | None = None, result: str | None = None) -> None:
        """A rule like those in ``functions.aggregates``; or a class with ``init``, ``accumulate`` and ``terminate``, run over the group's values."""
        if inspect.isclass(rule):
            from pyspark.sql.functions import udf

            def fold(values):
                state = rule()
                state.init()
                for v in values:
                    state.accumulate(v)
                return state.terminate()

            spark_name = f"_a{next(_names)}"
            self.spark.udf.register(spark_name, udf(fold, K.SPARK[result], useArrow=True))
            made = lambda kind: (result, spark_name + "(collect_list({0}))") if K.widening(kind, argument) is not None else None
        else:
            made = rule
        self.aggregates[name.upper()] = made
        self._changed()

    def add_property(self, kind: str, name: str, result: str, sql: str) -> None:
        self.properties[kind, name.upper()] = (result, sql)
        self._changed()

    def add_method(self, kind: str, name: str, arguments: Iterable[str], result: str, sql: str) -> None:
        self.methods.setdefault((kind, name.upper()), []).append((tuple(arguments), result, sql))
        self._changed()

    def add_comparer(self, kind: str, sort_key: str) -> None:
        """Values of the type are ordered by this Spark SQL expression of {0}."""
        self.comparers[kind] = sort_key
        self._changed()


def _as_row(r: object):
    if isinstance(r, (Row, dict, tuple)):
        return Row(**r) if isinstance(r, dict) else r
    if dataclasses.is_dataclass(r):
        return Row(**dataclasses.asdict(r))
    return Row(**{k: v for k, v in vars(r).items() if not k.startswith("_")})
