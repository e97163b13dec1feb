"""Compile errors by id, on the driver's tables."""

import pytest

from quillon import suite
from quillon.plans.errors import CompilationException
from quillon.plans.query import Query

from .conftest import DATA

CASES = {
    "SELECT ? FROM nation": "IllegalInputCharacter",
    "SELECT 1 /* open": "UnterminatedComment",
    "SELECT 'open": "UnterminatedString",
    'SELECT "open': "UnterminatedQuotedIdentifier",
    "SELECT [open": "UnterminatedParenthesizedIdentifier",
    "SELECT #2001-01-01": "UnterminatedDate",
    "SELECT #nonsense#": "InvalidDate",
    "SELECT 12x": "InvalidInteger",
    "SELECT 1.2x": "InvalidReal",
    "SELECT 102b": "InvalidBinary",
    "SELECT 8zo": "InvalidOctal",
    "SELECT 0fgh": "InvalidHex",
    "SELECT 99999999999999999999": "NumberTooLarge",
    "SELECT n_name FROM nation WHERE": "SimpleExpressionExpected",
    "SELECT n_name FROM nation GROUP n_name": "TokenExpected",
    "SELECT n_name FROM": "TableReferenceExpected",
    "SELECT n_name FROM nation WHERE n_nationkey + ALL (SELECT 1) = 2": "InvalidOperatorForAllAny",
    "SELECT 1 FROM missing": "UndeclaredTable",
    "SELECT @p": "UndeclaredParameter",
    "SELECT NOSUCH(1)": "UndeclaredFunction",
    "SELECT n.n_name.Nope() FROM nation n": "UndeclaredMethod",
    "SELECT n.nope FROM nation n": "UndeclaredColumn",
    "SELECT n.n_name.Nope FROM nation n": "UndeclaredProperty",
    "SELECT CAST(1 AS nope)": "UndeclaredType",
    "SELECT nope FROM nation": "UndeclaredEntity",
    "SELECT n_name FROM nation a, nation b": "AmbiguousColumnRef",
    "SELECT LEN FROM nation": "InvocationRequiresParentheses",
    "SELECT NOT n_name FROM nation": "CannotApplyUnaryOperator",
    "SELECT n_name * 2 FROM nation": "CannotApplyBinaryOperator",
    "SELECT SUM(*) FROM nation": "AsteriskModifierNotAllowed",
    "SELECT LEN(*) FROM nation": "AsteriskModifierNotAllowed",
    "SELECT CASE WHEN 1 THEN 2 END": "WhenMustEvaluateToBoolIfCaseInputIsOmitted",
    "SELECT CAST('17' AS INT)": "CannotCast",
    "SELECT *": "MustSpecifyTableToSelectFrom",
    "SELECT SUM(COUNT(n_nationkey)) FROM nation": "AggregateCannotContainAggregate",
    "SELECT SUM((SELECT 1)) FROM nation": "AggregateCannotContainAggregate",
    "SELECT AVG(n_name) FROM nation": "AggregateDoesNotSupportType",
    "SELECT n_name FROM nation WHERE COUNT(*) > 1": "AggregateInWhere",
    "SELECT 1 FROM nation a JOIN nation b ON COUNT(a.n_nationkey) = 1": "AggregateInOn",
    "SELECT 1 FROM nation GROUP BY COUNT(n_nationkey)": "AggregateInGroupBy",
    "SELECT (SELECT SUM(n.n_nationkey + r.r_regionkey) FROM region r) FROM nation n GROUP BY n.n_nationkey": "AggregateContainsColumnsFromDifferentQueries",
    "SELECT 1 FROM nation, nation": "DuplicateTableRefInFrom",
    "SELECT 1 FROM nation a CROSS JOIN region b JOIN region c ON a.n_regionkey = c.r_regionkey": "TableRefInaccessible",
    "SELECT TOP 1 WITH TIES n_name FROM nation": "TopWithTiesRequiresOrderBy",
    "SELECT n_name FROM nation ORDER BY 2": "OrderByColumnPositionIsOutOfRange",
    "SELECT n_name FROM nation WHERE n_nationkey": "WhereClauseMustEvaluateToBool",
    "SELECT COUNT(*) FROM nation HAVING COUNT(*)": "HavingClauseMustEvaluateToBool",
    "SELECT n_name, COUNT(*) FROM nation": "SelectExpressionNotAggregatedAndNoGroupBy",
    "SELECT n_name, COUNT(*) FROM nation GROUP BY n_regionkey": "SelectExpressionNotAggregatedOrGrouped",
    "SELECT n_regionkey FROM nation GROUP BY n_regionkey HAVING n_name = 'x'": "HavingExpressionNotAggregatedOrGrouped",
    "SELECT COUNT(*) FROM nation ORDER BY n_name": "OrderByExpressionNotAggregatedAndNoGroupBy",
    "SELECT n_regionkey FROM nation GROUP BY n_regionkey ORDER BY n_name": "OrderByExpressionNotAggregatedOrGrouped",
    "SELECT 1 FROM (SELECT n_name FROM nation ORDER BY n_name) d": "OrderByInvalidInSubqueryUnlessTopIsAlsoSpecified",
    "SELECT n_name FROM nation UNION ALL SELECT 1, 2": "DifferentExpressionCountInBinaryQuery",
    "SELECT n_name AS a FROM nation UNION SELECT n_name FROM nation ORDER BY n_regionkey": "OrderByItemsMustBeInSelectListIfUnionSpecified",
    "SELECT DISTINCT n_name FROM nation ORDER BY n_regionkey": "OrderByItemsMustBeInSelectListIfDistinctSpecified",
    "SELECT 1 FROM nation GROUP BY 1": "GroupByItemDoesNotReferenceAnyColumns",
    "SELECT n_name FROM nation ORDER BY 'x'": "ConstantExpressionInOrderBy",
    "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT 1, 2)": "TooManyExpressionsInSelectListOfSubquery",
    "SELECT d FROM (SELECT n_name FROM nation) d": "InvalidRowReference",
    "SELECT 1 FROM (SELECT n_nationkey + 1 FROM nation) d": "NoColumnAliasSpecified",
    "WITH t (a) AS (SELECT 1, 2) SELECT * FROM t": "CteHasMoreColumnsThanSpecified",
    "WITH t (a, b) AS (SELECT 1) SELECT * FROM t": "CteHasFewerColumnsThanSpecified",
    "WITH t (a, A) AS (SELECT 1, 2) SELECT * FROM t": "CteHasDuplicateColumnName",
    "WITH t AS (SELECT 1 a), T AS (SELECT 2 a) SELECT * FROM t": "CteHasDuplicateTableName",
    "WITH t (a) AS (SELECT a FROM t) SELECT * FROM t": "CteDoesNotHaveUnionAll",
    "WITH t (a) AS (SELECT a FROM t UNION ALL SELECT 1) SELECT * FROM t": "CteDoesNotHaveAnchorMember",
    "WITH t (a) AS (SELECT 1 UNION ALL SELECT 2 FROM nation WHERE EXISTS (SELECT * FROM t)) SELECT * FROM t": "CteContainsRecursiveReferenceInSubquery",
    "WITH t (a) AS (SELECT 1 UNION ALL SELECT a + 1 FROM t WHERE a < 3 UNION ALL SELECT 5) SELECT * FROM t": "CteContainsUnexpectedAnchorMember",
    "WITH t (a) AS (SELECT 1 UNION ALL SELECT x.a FROM t x JOIN t y ON x.a = y.a) SELECT * FROM t": "CteContainsMultipleRecursiveReferences",
    "WITH t (a) AS (SELECT 1 UNION ALL (SELECT a FROM t EXCEPT SELECT 2)) SELECT * FROM t": "CteContainsUnion",
    "WITH t (a) AS (SELECT 1 UNION ALL SELECT DISTINCT a FROM t) SELECT * FROM t": "CteContainsDistinct",
    "WITH t (a) AS (SELECT 1 UNION ALL SELECT TOP 1 a FROM t) SELECT * FROM t": "CteContainsTop",
    "WITH t (a) AS (SELECT 1 UNION ALL SELECT a FROM t LEFT JOIN nation ON a = n_nationkey) SELECT * FROM t": "CteContainsOuterJoin",
    "WITH t (a) AS (SELECT 1 UNION ALL SELECT MAX(a) FROM t) SELECT * FROM t": "CteContainsGroupByHavingOrAggregate",
    "WITH t (a) AS (SELECT 1 UNION ALL SELECT 'x' FROM t) SELECT * FROM t": "CteHasTypeMismatchBetweenAnchorAndRecursivePart",
}


@pytest.mark.parametrize("text", CASES)
def test_error_id(text, spark):
    with pytest.raises(CompilationException) as e:
        Query(suite.context(spark, DATA, text), text).compile()
    assert e.value.errors[0].id == CASES[text]


def test_place_of_an_error(spark):
    with pytest.raises(CompilationException) as e:
        Query(suite.context(spark, DATA, ""), "SELECT 1,\n  nope").compile()
    assert (e.value.errors[0].line, e.value.errors[0].column) == (2, 3)
