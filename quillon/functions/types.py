"""The language's types, what they are in Spark, and how they convert."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import types as T

#: Name of each type in Spark SQL.
SPARK = {
    "bool": "BOOLEAN",
    "sbyte": "TINYINT",
    "short": "SMALLINT",
    "int": "INT",
    "long": "BIGINT",
    "ulong": "DECIMAL(20,0)",
    "float": "FLOAT",
    "double": "DOUBLE",
    "decimal": "DECIMAL(38,10)",
    "string": "STRING",
    "datetime": "TIMESTAMP_NTZ",
    "timespan": "INTERVAL DAY TO SECOND",
    "binary": "BINARY",
}

#: The type names that CAST knows, in any case.
CAST_NAMES = {
    "BOOL": "bool", "BOOLEAN": "bool", "BIT": "bool", "SBYTE": "sbyte", "BYTE": "short", "TINYINT": "short", "INT16": "short", "SMALLINT": "short",
    "UINT16": "int", "CHAR": "string", "INT32": "int", "INT": "int", "UINT32": "long", "INT64": "long", "BIGINT": "long", "UINT64": "ulong",
    "SINGLE": "float", "REAL": "float", "DOUBLE": "double", "FLOAT": "double", "DECIMAL": "decimal", "NUMERIC": "decimal", "MONEY": "decimal", "SMALLMONEY": "decimal",
    "STRING": "string", "VARCHAR": "string", "NVARCHAR": "string", "TEXT": "string", "NTEXT": "string", "NCHAR": "string", "XML": "string",
    "DATETIME": "datetime", "SMALLDATETIME": "datetime", "TIMESPAN": "timespan", "BINARY": "binary", "VARBINARY": "binary", "IMAGE": "binary", "TIMESTAMP": "binary",
    "UNIQUEIDENTIFIER": "string", "OBJECT": "object", "SQL_VARIANT": "object",
}

_NUMBERS = ["sbyte", "short", "int", "long", "ulong", "decimal", "float", "double"]
NUMERIC = frozenset(_NUMBERS)
INTEGRAL = frozenset(("sbyte", "short", "int", "long", "ulong"))
COMPARABLE = NUMERIC | {"bool", "string", "datetime", "timespan", "null"}


def of_spark(t: T.DataType) -> str:
    """The language's type of a Spark type; structs keep their fields."""
    for kind, name in (
        (T.BooleanType, "bool"), (T.ByteType, "sbyte"), (T.ShortType, "short"), (T.IntegerType, "int"), (T.LongType, "long"), (T.FloatType, "float"), (T.DoubleType, "double"),
        (T.DecimalType, "decimal"), (T.StringType, "string"), (T.TimestampNTZType, "datetime"), (T.TimestampType, "datetime"), (T.DateType, "datetime"), (T.DayTimeIntervalType, "timespan"), (T.BinaryType, "binary"), (T.NullType, "null"),
    ):
        if isinstance(t, kind):
            return name
    return "object"


def of_value(value: object) -> str:
    if value is None:
        return "null"
    for kind, name in ((bool, "bool"), (int, "int"), (float, "double"), (str, "string"), (datetime, "datetime"), (date, "datetime"), (timedelta, "timespan"), (Decimal, "decimal"), (bytes, "binary")):
        if isinstance(value, kind):
            return "long" if name == "int" and not -(1 << 31) <= value < 1 << 31 else name
    return "object"


def widening(a: str, b: str) -> int | None:
    """Steps of the implicit conversion from ``a`` to ``b``; None: there is none."""
    if a == b:
        return 0
    if a == "null" or b == "object":
        return 1
    if a in INTEGRAL and b in NUMERIC and _NUMBERS.index(a) < _NUMBERS.index(b) and (a, b) != ("sbyte", "ulong"):
        return _NUMBERS.index(b) - _NUMBERS.index(a)
    return 1 if (a, b) == ("float", "double") else None


def castable(a: str, b: str) -> bool:
    """Whether CAST takes ``a`` to ``b``: numbers among each other, or a type to itself."""
    return a == b or a == "null" or "object" in (a, b) or {a, b} <= NUMERIC


def arithmetic(a: str, b: str) -> str | None:
    """Type of a sum of two numbers."""
    if a == "null" and b == "null":
        return "int"
    a, b = (b if a == "null" else a), (a if b == "null" else b)
    if not {a, b} <= NUMERIC:
        return None
    if "double" in (a, b):
        return "double"
    if "float" in (a, b):
        return "double" if "decimal" in (a, b) else "float"
    if "decimal" in (a, b):
        return "decimal"
    if "ulong" in (a, b):
        return "ulong"
    return "int" if a == b == "int" else "long"


def common(a: str, b: str) -> str | None:
    """The type that both convert to."""
    if widening(a, b) is not None:
        return b
    if widening(b, a) is not None:
        return a
    return arithmetic(a, b)
