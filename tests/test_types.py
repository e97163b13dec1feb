"""Types of the user, members of single values, errors told together, and changes of the context."""

import enum

import pytest
from pyspark.sql import Row
from pyspark.sql.types import IntegerType, StructField, StructType

from quillon.plans.errors import CompilationException
from quillon.plans.query import Expression, Query
from quillon.sources.catalog import DataContext, row_properties

POINT = StructType([StructField("x", IntegerType()), StructField("y", IntegerType())])


class Mark(enum.IntFlag):
    RED = 1
    GREEN = 2


@pytest.fixture
def points(spark):
    ctx = DataContext(spark)
    ctx.add_type("shape")
    ctx.add_type("point", POINT, base="shape")
    ctx.add_table("t", spark.createDataFrame([(1, (3, 4)), (2, (1, 1)), (3, (0, 2)), (4, None)], StructType([StructField("id", IntegerType()), StructField("p", POINT)])))
    return ctx


def rows(ctx, text):
    return [tuple(r) for r in Query(ctx, text).execute().collect()]


def test_operators_of_types(points):
    points.add_operator("+", "point", "point", "point", "named_struct('x', {0}.x + {1}.x, 'y', {0}.y + {1}.y)")
    points.add_operator("-", "point", None, "point", "named_struct('x', -{0}.x, 'y', -{0}.y)")
    points.add_operator("*", "point", "int", "int", "({0}.x * {0}.y * {1})")
    # Of the base: found where the type has none.
    points.add_operator("<", "shape", "shape", "bool", "({0}.x < {1}.x)")
    points.add_property("shape", "Area", "int", "({0}.x * {0}.y)")
    points.add_method("shape", "Grown", ["int"], "int", "({0}.x + {1})")
    assert rows(points, "SELECT (p + p).x, (-p).y, p * 2, p.Area, p.Grown(5) FROM t WHERE id = 1") == [(6, -4, 24, 12, 8)]
    assert rows(points, "SELECT a.id, b.id FROM t a JOIN t b ON a.p < b.p ORDER BY 1, 2") == [(2, 1), (3, 1), (3, 2)]
    with pytest.raises(CompilationException) as e:
        Query(points, "SELECT p - p FROM t").compile()
    assert e.value.errors[0].id == "CannotApplyBinaryOperator"
    with pytest.raises(ValueError, match="operand"):
        points.add_operator("+", "int", "int", "int", "{0}")


def test_types_without_order(points):
    for text, error in (
        ("SELECT DISTINCT p FROM t", "InvalidDataTypeInSelectDistinct"),
        ("SELECT COUNT(*) FROM t GROUP BY p", "InvalidDataTypeInGroupBy"),
        ("SELECT id FROM t ORDER BY p", "InvalidDataTypeInOrderBy"),
        ("SELECT p FROM t UNION SELECT p FROM t", "InvalidDataTypeInUnion"),
    ):
        with pytest.raises(CompilationException) as e:
            Query(points, text).compile()
        assert [x.id for x in e.value.errors] == [error]
    # The base's comparer counts for the type.
    points.add_comparer("shape", "{0}.x + {0}.y")
    assert rows(points, "SELECT id FROM t WHERE id < 4 ORDER BY p DESC, id") == [(1,), (2,), (3,)]
    assert rows(points, "SELECT COUNT(*) FROM (SELECT DISTINCT p FROM t) d") == [(4,)]


def test_enums(spark):
    ctx = DataContext(spark)
    ctx.add_enum(Mark)
    ctx.add_constant("RED", Mark.RED)
    ctx.add_constant("GREEN", Mark.GREEN)
    ctx.add_table("t", spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, None)], "id int, mark int"), types={"mark": "Mark"})
    assert rows(ctx, "SELECT id FROM t WHERE (mark & RED) = RED ORDER BY id") == [(2,), (3,)]
    assert rows(ctx, "SELECT id, mark | GREEN AS m FROM t ORDER BY mark DESC, id")[:2] == [(3, 3), (2, 3)]
    assert Expression(ctx, "RED | GREEN").resolve() == "Mark"
    assert rows(ctx, "SELECT SUM(ABS(mark)) FROM t") == [(4,)]
    e = Expression(ctx, "@m & RED")
    e.declare("m", Mark.GREEN)
    assert e.evaluate() == 0
    e.set("m", Mark.RED)
    assert e.evaluate() == 1


def test_properties_of_one_value(spark):
    ctx = DataContext(spark)
    shape = StructType.fromDDL("id int, name string")
    e = Expression(ctx, "@ROW.Id + LEN(@ROW.Name)")
    e.declare("@ROW", Row(id=1, name="Nancy"), properties=row_properties(shape))
    assert e.evaluate() == 6
    e.set("@ROW", Row(id=2, name="Al"))
    assert e.evaluate() == 4
    e.set("@ROW", None)
    assert e.evaluate() is None
    ctx.add_constant("settings", {"low": 3}, properties={"Low": ("int", lambda v: v["low"])})
    assert Expression(ctx, "Settings.Low * 2").evaluate() == 6
    with pytest.raises(CompilationException) as caught:
        Expression(ctx, "'x'.Low").evaluate()
    assert caught.value.errors[0].id == "UndeclaredProperty"


def test_errors_are_told_together(spark):
    ctx = DataContext(spark)
    ctx.add_table("t", spark.createDataFrame([(1, "a")], "k int, s string"))

    def ids(text):
        with pytest.raises(CompilationException) as e:
            Query(ctx, text).compile()
        return [x.id for x in e.value.errors]

    assert ids("SELECT nope, s * 2, k FROM t WHERE k ORDER BY 9") == ["WhereClauseMustEvaluateToBool", "UndeclaredEntity", "CannotApplyBinaryOperator", "OrderByColumnPositionIsOutOfRange"]
    assert ids("SELECT nope FROM t UNION ALL SELECT NOSUCH(k) FROM t") == ["UndeclaredEntity", "UndeclaredFunction"]
    assert ids("SELECT k, s FROM t GROUP BY nope HAVING nix > 1") == ["UndeclaredEntity", "UndeclaredEntity"]
    assert ids("SELECT (SELECT a FROM t), b FROM t x JOIN t y ON x.k = y.c") == ["UndeclaredColumn", "UndeclaredEntity", "UndeclaredEntity"]
    assert ids('SELECT "a".k FROM t "a" CROSS JOIN t "A" WHERE A.k = 1') == ["AmbiguousTableRef"]


def test_ambiguous_invocation(spark):
    ctx = DataContext(spark)
    ctx.add_macro("PICK", ["int", "long"], "int", "1")
    ctx.add_macro("PICK", ["long", "int"], "int", "2")
    assert Expression(ctx, "PICK(1, 3000000000)").evaluate() == 1
    with pytest.raises(CompilationException) as e:
        Expression(ctx, "PICK(1, 1)").evaluate()
    assert e.value.errors[0].id == "AmbiguousInvocation"


def test_invalidation(spark):
    ctx, seen = DataContext(spark), []
    e = Expression(ctx, "@x + 1")
    e.on_invalidated.append(lambda: seen.append("void"))
    e.declare("x", 1)
    assert e.evaluate() == 2
    e.set("x", 2)
    assert seen == []
    ctx.add_constant("c", 1)
    assert seen == ["void"]
    assert e.evaluate() == 3
    e.declare("x", 1.5)
    assert seen == ["void", "void"]


def test_vectorised_function(spark):
    ctx = DataContext(spark)
    ctx.add_table("t", spark.createDataFrame([(1,), (None,), (5,)], "k long"))
    ctx.add_function("FILLED", lambda s: s.fillna(7).astype("int64"), arguments=["long"], result="long", vectorised=True)
    assert sorted(rows(ctx, "SELECT FILLED(k) FROM t")) == [(1,), (5,), (7,)]
