"""Semantics that the suite doesn't pin: nulls, types, parameters, extension, plans."""

from dataclasses import dataclass
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from quillon import suite
from quillon.plans.errors import QueryRuntimeException
from quillon.plans.query import Expression, Query, column
from quillon.plans.showplan import from_xml
from quillon.sources.catalog import DataContext, Relation, function

from .conftest import DATA


@dataclass
class Dto:
    ID: int
    Value: int


@pytest.fixture
def ctx(spark):
    out = DataContext(spark)
    out.add_table("JoinTable1", [{"ID": "2", "Value": "Two"}, {"ID": "3", "Value": "Three"}])
    out.add_table("JoinTable2", [{"ID": "1", "Value": "One"}, {"ID": "2", "Value": "Two"}])
    return out


def value(ctx, text, **how):
    return Expression(ctx, text, **how).evaluate()


def test_full_join_names_and_rows(ctx):
    frame = Query(ctx, "SELECT t1.*, t2.* FROM JoinTable1 t1 FULL JOIN JoinTable2 t2 ON t1.ID = t2.ID").execute()
    assert frame.columns == ["ID", "Value", "ID1", "Value1"]
    assert {tuple(r) for r in frame.collect()} == {(None, None, "1", "One"), ("2", "Two", "2", "Two"), ("3", "Three", None, None)}


def test_sum_types(spark):
    ctx = DataContext(spark)
    frame = spark.createDataFrame([(1, 4), (2, 5), (2, 6)], "ID int, Value short")
    ctx.add_table("t", frame)
    out = Query(ctx, "SELECT ID, SUM(ID) AS a, SUM(Value) AS b, SUM(Value + Value) AS c FROM t GROUP BY ID").execute()
    assert [t for _, t in out.dtypes] == ["int", "int", "bigint", "bigint"]
    assert sorted(map(tuple, out.collect())) == [(1, 1, 4, 8), (2, 4, 11, 22)]


def test_rows_of_dataclasses(spark):
    ctx = DataContext(spark)
    ctx.add_table("t", [Dto(1, 4), Dto(2, 5)])
    assert Query(ctx, "SELECT SUM(Value) FROM t").scalar() == 9


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("NULL + 1", None), ("NULL AND FALSE", False), ("NULL OR TRUE", True), ("NULL OR FALSE", None), ("NOT NULL", None), ("'a' = NULL", None), ("NULL IS NULL", True),
        ("COALESCE(NULL, NULL, 3)", 3), ("NULLIF(1, 1)", None), ("1 IN (NULL, 1)", True), ("CASE NULL WHEN NULL THEN 1 ELSE 2 END", 2), ("LEN(NULL)", None), ("2 ** 3 ** 2", 64),
        ("-2 ** 2", -4), ("7 / 2", 3), ("-7 / 2", -3), ("7 / 2.0", 3.5), ("1.0 / 0", float("inf")), ("5 !> 5", True), ("'abc' LIKE 'A%C'", True), ("'a.c' LIKE 'a.c'", True), ("'abc' LIKE 'a.c'", True),
        ("'xaby' SIMILAR TO 'a.'", True), ("LPAD('abc', 5)", "  abc"), ("SUBSTRING('abc', 0)", ""), ("TO_INT32(3.5)", 4), ("TO_INT32(2.5)", 2), ("CAST(2.9 AS INT)", 2), ("LOG(0.0)", float("-inf")),
        ("'a' + NULL", None), ("TO_STRING(1.50)", "1.5"), ("0ffh + 1", 256), ("TRIM('  x\t')", "x"), ("LTRIM(' \tx ')", "x "), ("#2004-01-01#.Year", 2004), ("'abc'.Length", 3), ("'a' SOUNDSLIKE 'e'", False),
    ],
)
def test_expression(ctx, text, want):
    assert value(ctx, text) == want


@pytest.mark.parametrize("text", ["1 / 0", "TO_INT32('x')", "SUBSTRING('abc', -1)", "REPLACE('a', '', 'b')", "LEFT('abc', -1)", "TO_BYTE(300)"])
def test_runtime_error(ctx, text):
    with pytest.raises(QueryRuntimeException):
        value(ctx, text)


def test_more_than_one_row_is_an_error(spark):
    text = "SELECT (SELECT n_name FROM nation) AS x"
    with pytest.raises(QueryRuntimeException):
        Query(suite.context(spark, DATA, text), text).scalar()


def test_recursion_ends_at_100_levels(spark):
    with pytest.raises(QueryRuntimeException):
        Query(DataContext(spark), "WITH t (k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM t) SELECT COUNT(*) FROM t").scalar()


def test_parameters_and_recompilation(ctx):
    e, seen = Expression(ctx, "@x * 2 + x"), []
    e.on_compiled.append(lambda: seen.append(1))
    e.declare("@x", 5)
    assert e.evaluate() == 15
    e.set("x", 7)
    assert e.evaluate() == 21
    assert len(seen) == 1
    with pytest.raises(TypeError):
        e.set("x", "text")
    e.set("x", None)
    assert e.evaluate() is None


def test_target_type_and_null_value(ctx):
    assert value(ctx, "NULL + 1", null_value=-1) == -1
    assert Expression(ctx, "1 + 1", target="double").resolve() == "double"
    assert Expression(ctx, "1 + 1").resolve() == "int"


def test_container_functions(ctx):
    class Functions:
        @staticmethod
        @function("PLUS_ONE")
        def plus_one(x: int) -> int:
            return x + 1

    ctx.add_functions(Functions)
    assert value(ctx, "PLUS_ONE(41)") == 42
    with pytest.raises(ValueError, match="already"):
        ctx.add_macro("PLUS_ONE", ["long"], "long", "{0}")


def test_comparer_orders_values(spark):
    ctx = DataContext(spark)
    ctx.add_table("t", spark.createDataFrame([("b",), ("a",)], "k string"))
    ctx.add_comparer("string", "ascii({0}) * -1")
    assert [r[0] for r in Query(ctx, "SELECT k FROM t ORDER BY k").execute().collect()] == ["b", "a"]


def test_collation(spark):
    ctx = DataContext(spark)
    ctx.add_table("t", spark.createDataFrame([("B",), ("a",), ("b",)], "k string"))
    assert [r[0] for r in Query(ctx, "SELECT k FROM t ORDER BY k", collation="UNICODE").execute().collect()] == ["a", "b", "B"]
    assert tuple(Query(ctx, "SELECT MIN(k), MAX(k) FROM t", collation="UNICODE").execute().first()) == ("a", "B")
    assert tuple(Query(ctx, "SELECT MIN(k), MAX(k) FROM t").execute().first()) == ("B", "b")


def test_strict_variance_counts_nulls(spark):
    ctx = DataContext(spark)
    ctx.add_table("t", spark.createDataFrame([(2.0,), (4.0,), (None,)], "x double"))
    assert Query(ctx, "SELECT STDEV(x) FROM t").scalar() == pytest.approx(2**0.5)
    assert Query(ctx, "SELECT STDEV(x) FROM t", strict=True).scalar() == pytest.approx(2.0)


def test_relations(ctx):
    ctx.add_relation(Relation("JoinTable1", "JoinTable2", ("ID",), ("ID",)))
    with pytest.raises(ValueError, match="lacks"):
        ctx.add_relation(Relation("JoinTable1", "JoinTable2", ("nope",), ("ID",)))


def test_column_in_frame(ctx, spark):
    frame = spark.range(5).withColumn("name", F.lit("Ab"))
    assert frame.where(column(ctx, "id BETWEEN 2 AND 3 AND name LIKE 'a%'", frame)).count() == 2


def test_plan_has_no_product_and_survives_xml(spark):
    text = "SELECT TOP 3 WITH TIES n.n_name, COUNT(*) c FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name ORDER BY COUNT(*)"
    plan = Query(suite.context(spark, DATA, text), text).plan()
    kinds = {p.spark for p in plan.walk()}
    assert any("WindowGroupLimit" in k for k in kinds)
    assert not any("Cartesian" in k for k in kinds)
    assert from_xml(ElementTree.fromstring(ElementTree.tostring(plan.xml()))).text() == plan.text()


def test_uncorrelated_all_needs_no_nested_loops(spark):
    text = "SELECT n_name FROM nation WHERE n_nationkey >= ALL (SELECT s_nationkey FROM supplier)"
    frame = Query(suite.context(spark, DATA, text), text).execute()
    assert "NestedLoop" not in frame._jdf.queryExecution().toString()


def test_reader_schema_and_filters_reach_the_scan(spark):
    text = "SELECT l_orderkey FROM lineitem WHERE l_quantity > 49"
    query = Query(suite.context(spark, DATA, text), text)
    assert query.schema().fieldNames() == ["l_orderkey"]
    assert len(list(query.reader())) == query.execute().count()
    shown = query.execute()._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,49" in shown
    assert "l_comment" not in shown
