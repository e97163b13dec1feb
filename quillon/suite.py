"""Queries in the language, one for each kind of operator, with SQL that another engine can check them by."""

from __future__ import annotations

import enum
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from .operators.frame import aggregate_states, auto_join
from .plans.errors import CompilationException, QueryRuntimeException
from .plans.query import Expression, Query
from .sources.catalog import DataContext, Relation, function, row_properties

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels", "documents", "conversations")

#: name -> (query, SQL to check it by; None: the query itself is SQL that both understand).
QUERIES: dict[str, tuple[str, str | None]] = {}


def _add(name: str, query: str, oracle: str | None = None) -> None:
    QUERIES[name] = (query, oracle)


_add(
    "flagship",
    """SELECT TOP 5 n.n_name, COUNT(*) AS orders, ROUND(SUM(o.o_totalprice), 2) AS revenue FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
    JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_orderdate >= #1996-01-01# GROUP BY n.n_name ORDER BY revenue DESC, n.n_name""",
    """SELECT n.n_name, CAST(COUNT(*) AS INTEGER) AS orders, ROUND(SUM(o.o_totalprice), 2) AS revenue FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
    JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY n.n_name ORDER BY revenue DESC, n.n_name LIMIT 5""",
)
_add(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS n
    FROM lineitem WHERE l_shipdate <= #1998-09-02# GROUP BY l_returnflag, l_linestatus""",
    """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, ROUND(AVG(l_discount), 6) AS avg_disc, CAST(COUNT(*) AS INTEGER) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
# Scans, projection, filter.
_add("scan_project", "SELECT n_nationkey, n_name FROM nation")
_add("scan_star", "SELECT r.*, r.r_regionkey AS again FROM region r")
_add("constant_select", "SELECT 1 AS a, 'x' AS b, 2.5 AS c", "SELECT 1 AS a, 'x' AS b, CAST(2.5 AS DOUBLE) AS c")
_add("null_scan", "SELECT n_name FROM nation WHERE FALSE")
_add("literals", "SELECT 0ffh AS hex, 101b AS bin, 17o AS oct, 1.5e3 AS real, 'it''s' AS txt, #2005-01-31# AS day /* comment */ -- and more", "SELECT 255 AS hex, 5 AS bin, 15 AS oct, CAST(1500 AS DOUBLE) AS real, 'it''s' AS txt, TIMESTAMP '2005-01-31' AS day")
_add("filter_3vl", "SELECT n_nationkey FROM nation WHERE NOT (NULLIF(n_regionkey, 1) = 2 AND n_nationkey > 3)")
_add("quoted_names", 'SELECT [n].[N_NAME] AS [the name], "n_nationkey" AS "Key" FROM nation AS [n]', 'SELECT n_name AS "the name", n_nationkey AS "Key" FROM nation')
_add("names_dedupe", "SELECT a.r_name, b.r_name, a.r_regionkey + b.r_regionkey FROM region a JOIN region b ON a.r_regionkey = b.r_regionkey", 'SELECT r_name AS r_name, r_name AS r_name1, r_regionkey + r_regionkey AS "Column" FROM region')
# Joins.
_add("join_inner", "SELECT n.n_name, r.r_name FROM nation n INNER JOIN region r ON n.n_regionkey = r.r_regionkey")
_add("join_comma", "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
_add("join_cross", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b")
_add("join_left", "SELECT n.n_name, s.s_name FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000")
_add("join_right", "SELECT n.n_name, s.s_name FROM supplier s RIGHT OUTER JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000")
_add("join_full", "SELECT a.k AS k1, b.k AS k2 FROM (SELECT NULLIF(n_nationkey, 3) AS k FROM nation WHERE n_nationkey < 10) a FULL JOIN (SELECT NULLIF(n_nationkey, 7) AS k FROM nation WHERE n_nationkey > 5) b ON a.k = b.k")
_add("join_full_theta", "SELECT a.r_regionkey AS x, b.n_nationkey AS y FROM region a FULL OUTER JOIN nation b ON a.r_regionkey * 8 < b.n_nationkey")
_add("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey > b.n_regionkey")
_add("join_multi_residual", "SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20")
_add("join_nested", "SELECT c.c_name, o.o_orderkey, n.n_name FROM nation n LEFT JOIN (customer c JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000) ON c.c_nationkey = n.n_nationkey")
_add("join_left_on_exists", "SELECT r.r_name, n.n_name FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey AND EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey)")
_add("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
# Subqueries.
_add("semi_exists", "SELECT n_name FROM nation n WHERE EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey)")
_add("anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT * FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
_add("exists_as_value", "SELECT n_name, EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 8000) AS rich FROM nation n")
_add("not_exists_as_value", "SELECT n_name, CASE WHEN NOT EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey) THEN 'none' ELSE 'some' END AS suppliers FROM nation n")
_add("exists_under_or", "SELECT n_name FROM nation n WHERE n_regionkey = 0 OR EXISTS (SELECT * FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 8000)")
_add("in_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
_add("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4)")
_add("not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 2) FROM region)")
_add("in_as_value", "SELECT n_nationkey, n_nationkey IN (SELECT NULLIF(r_regionkey, 2) FROM region) AS hit FROM nation", "SELECT n_nationkey, EXISTS (SELECT 1 FROM region WHERE NULLIF(r_regionkey, 2) = n_nationkey) AS hit FROM nation")
_add("any_gt", "SELECT n_nationkey FROM nation WHERE n_nationkey > ANY (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
_add("any_correlated", "SELECT c.c_custkey FROM customer c WHERE c.c_acctbal * 10 > SOME (SELECT o.o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey)", "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND c.c_acctbal * 10 > o.o_totalprice)")
_add("all_ge", "SELECT n_nationkey FROM nation WHERE n_nationkey >= ALL (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
_add("all_eq_null", "SELECT n_nationkey FROM nation WHERE n_nationkey <> ALL (SELECT NULLIF(r_regionkey, 2) FROM region)")
_add("all_empty", "SELECT n_nationkey FROM nation WHERE n_nationkey > ALL (SELECT s_nationkey FROM supplier WHERE FALSE)")
_add("not_any", "SELECT n_nationkey FROM nation WHERE NOT (n_nationkey = ANY (SELECT s_nationkey FROM supplier))", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
_add("scalar_subq_corr", "SELECT r_name, (SELECT COUNT(*) FROM nation n WHERE n.n_regionkey = r.r_regionkey) AS nations FROM region r", "SELECT r_name, CAST((SELECT COUNT(*) FROM nation n WHERE n.n_regionkey = r.r_regionkey) AS INTEGER) AS nations FROM region r")
_add("scalar_subq_top1", "SELECT r_name, (SELECT TOP 1 n_name FROM nation n WHERE n.n_regionkey = r.r_regionkey ORDER BY n_name DESC) AS last FROM region r", "SELECT r_name, (SELECT MAX(n_name) FROM nation n WHERE n.n_regionkey = r.r_regionkey) AS last FROM region r")
_add("scalar_in_case_guard", "SELECT r_regionkey, CASE WHEN r_regionkey < 10 THEN 'few' ELSE (SELECT n_name FROM nation n WHERE n.n_regionkey = r.r_regionkey) END AS x FROM region r", "SELECT r_regionkey, 'few' AS x FROM region")
_add("subq_in_orderby", "SELECT TOP 3 r_name FROM region r ORDER BY (SELECT SUM(n_nationkey) FROM nation n WHERE n.n_regionkey = r.r_regionkey) DESC", "SELECT r_name FROM region r ORDER BY (SELECT SUM(n_nationkey) FROM nation n WHERE n.n_regionkey = r.r_regionkey) DESC LIMIT 3")
_add("corr_having", "SELECT c.c_nationkey FROM customer c GROUP BY c.c_nationkey HAVING COUNT(*) > (SELECT COUNT(*) * 10 FROM supplier s WHERE s.s_nationkey = c.c_nationkey)")
_add("outer_aggregate", "SELECT n.n_regionkey FROM nation n GROUP BY n.n_regionkey HAVING EXISTS (SELECT * FROM region r WHERE r.r_regionkey + 20 = MAX(n.n_nationkey))", "SELECT n_regionkey FROM nation GROUP BY n_regionkey HAVING MAX(n_nationkey) - 20 IN (SELECT r_regionkey FROM region)")
_add("derived_table", "SELECT d.k, d.n FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey) AS d WHERE d.n > 50", "SELECT c_nationkey AS k, CAST(COUNT(*) AS INTEGER) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 50")
_add("filter_over_top", "SELECT d.n_nationkey FROM (SELECT TOP 5 n_nationkey FROM nation ORDER BY n_nationkey) d WHERE d.n_nationkey > 2", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (3, 4)")
# Common table expressions.
_add("cte_multi_ref", "WITH t AS (SELECT n_regionkey AS k, COUNT(*) AS n FROM nation GROUP BY n_regionkey) SELECT a.k, a.n, b.n AS m FROM t a JOIN t b ON a.k = b.k", "WITH t AS (SELECT n_regionkey AS k, CAST(COUNT(*) AS INTEGER) AS n FROM nation GROUP BY n_regionkey) SELECT a.k, a.n, b.n AS m FROM t a JOIN t b ON a.k = b.k")
_add("cte_chain", "WITH a AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 5), b (x) AS (SELECT k FROM a WHERE k < 15) SELECT x FROM b WHERE x % 2 = 0")
_add("cte_shadows_table", "WITH region AS (SELECT n_nationkey AS r FROM nation WHERE n_nationkey < 3) SELECT r FROM region")
_add("cte_recursive", "WITH t (k, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey = 1 UNION ALL SELECT p.p_partkey, t.depth + 1 FROM part p JOIN t ON p.p_partkey / 2 = t.k WHERE p.p_partkey > 1) SELECT depth, COUNT(*) AS n FROM t GROUP BY depth", "WITH RECURSIVE t (k, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey = 1 UNION ALL SELECT p.p_partkey, t.depth + 1 FROM part p JOIN t ON p.p_partkey // 2 = t.k WHERE p.p_partkey > 1) SELECT depth, CAST(COUNT(*) AS INTEGER) AS n FROM t GROUP BY depth")
_add("cte_recursive_multi_anchor", "WITH t (k) AS (SELECT 1 UNION ALL SELECT 100 UNION ALL SELECT k + 1 FROM t WHERE k % 10 < 5) SELECT k FROM t", "WITH RECURSIVE t (k) AS ((SELECT 1 UNION ALL SELECT 100) UNION ALL SELECT k + 1 FROM t WHERE k % 10 < 5) SELECT k FROM t")
_add("cte_recursive_multi_member", "WITH t (k) AS (SELECT 1 UNION ALL SELECT k * 2 FROM t WHERE k < 20 UNION ALL SELECT k * 3 FROM t WHERE k < 20) SELECT k, COUNT(*) AS n FROM t GROUP BY k", "WITH RECURSIVE t (k) AS (SELECT 1 UNION ALL SELECT k * m FROM t, (VALUES (2), (3)) v(m) WHERE k < 20) SELECT k, CAST(COUNT(*) AS INTEGER) AS n FROM t GROUP BY k")
# Grouping and aggregates.
_add("group_expr", "SELECT o_custkey % 7 AS b, COUNT(*) AS n FROM orders GROUP BY o_custkey % 7", "SELECT o_custkey % 7 AS b, CAST(COUNT(*) AS INTEGER) AS n FROM orders GROUP BY 1")
_add("group_row_ref", "SELECT r.r_name, COUNT(*) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r", "SELECT r.r_name, CAST(COUNT(*) AS INTEGER) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_regionkey, r.r_name")
_add("group_null_key", "SELECT NULLIF(n_regionkey, 2) AS k, COUNT(*) AS n FROM nation GROUP BY NULLIF(n_regionkey, 2)", "SELECT NULLIF(n_regionkey, 2) AS k, CAST(COUNT(*) AS INTEGER) AS n FROM nation GROUP BY 1")
_add("agg_empty_ungrouped", "SELECT COUNT(*) AS c, SUM(n_nationkey) AS s, AVG(n_nationkey) AS a, MIN(n_nationkey) AS mi, MAX(n_nationkey) AS ma, CONCAT(n_name) AS t FROM nation WHERE FALSE", "SELECT CAST(0 AS INTEGER) AS c, CAST(NULL AS INTEGER) AS s, CAST(NULL AS INTEGER) AS a, CAST(NULL AS INTEGER) AS mi, CAST(NULL AS INTEGER) AS ma, '' AS t")
_add("agg_empty_grouped", "SELECT n_regionkey, COUNT(*) AS n FROM nation WHERE FALSE GROUP BY n_regionkey", "SELECT n_regionkey, CAST(COUNT(*) AS INTEGER) AS n FROM nation WHERE FALSE GROUP BY n_regionkey")
_add("having", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus HAVING COUNT(*) > 10", "SELECT o_orderstatus, CAST(COUNT(*) AS INTEGER) AS n FROM orders GROUP BY o_orderstatus HAVING COUNT(*) > 10")
_add("having_no_group", "SELECT n_nationkey FROM nation HAVING n_nationkey > 20", "SELECT n_nationkey FROM nation WHERE n_nationkey > 20")
_add("agg_count", "SELECT COUNT(*) AS a, COUNT(NULLIF(n_regionkey, 1)) AS b FROM nation", "SELECT CAST(COUNT(*) AS INTEGER) AS a, CAST(COUNT(NULLIF(n_regionkey, 1)) AS INTEGER) AS b FROM nation")
_add("agg_sum", "SELECT SUM(n_nationkey) AS i, SUM(o_orderkey) AS l, ROUND(SUM(o_totalprice), 2) AS d FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey", "SELECT CAST(SUM(n_nationkey) AS INTEGER) AS i, CAST(SUM(o_orderkey) AS BIGINT) AS l, ROUND(SUM(o_totalprice), 2) AS d FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey")
_add("agg_avg_int", "SELECT p_brand, AVG(p_size) AS a FROM part GROUP BY p_brand", "SELECT p_brand, CAST(SUM(p_size) // COUNT(p_size) AS INTEGER) AS a FROM part GROUP BY p_brand")
_add("agg_avg_real", "SELECT c_mktsegment, ROUND(AVG(c_acctbal), 4) AS a FROM customer GROUP BY c_mktsegment")
_add("agg_minmax", "SELECT MIN(c_name) AS a, MAX(c_name) AS b, MIN(c_acctbal) AS c, MAX(c_acctbal) AS d FROM customer")
_add("agg_first_unique", "SELECT n_nationkey, FIRST(n_name) AS f FROM nation GROUP BY n_nationkey", "SELECT n_nationkey, n_name AS f FROM nation")
_add("agg_last_unique", "SELECT n_nationkey, LAST(NULLIF(n_regionkey, 1)) AS l FROM nation GROUP BY n_nationkey", "SELECT n_nationkey, NULLIF(n_regionkey, 1) AS l FROM nation")
_add("agg_var", "SELECT p_brand, ROUND(TO_DOUBLE(VAR(p_size)), 4) AS v FROM part GROUP BY p_brand", "SELECT p_brand, ROUND(VAR_SAMP(p_size), 4) AS v FROM part GROUP BY p_brand")
_add("agg_stdev", "SELECT p_brand, ROUND(STDEV(p_retailprice), 4) AS v FROM part GROUP BY p_brand", "SELECT p_brand, ROUND(STDDEV_SAMP(p_retailprice), 4) AS v FROM part GROUP BY p_brand")
_add("agg_concat", "SELECT c_nationkey, CONCAT(c_mktsegment) AS s FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS s FROM customer GROUP BY c_nationkey")
# Sort, distinct, top.
_add("distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
_add("distinct_orderby", "SELECT DISTINCT TOP 4 n_regionkey + 1 AS k FROM nation ORDER BY n_regionkey + 1 DESC", "SELECT DISTINCT n_regionkey + 1 AS k FROM nation ORDER BY k DESC LIMIT 4")
_add("top_n", "SELECT TOP 7 o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
_add("top_zero", "SELECT TOP 0 o_orderkey FROM orders", "SELECT o_orderkey FROM orders LIMIT 0")
_add("top_ties", "SELECT TOP 7 WITH TIES n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC", "SELECT n_name, n_regionkey FROM nation QUALIFY rank() OVER (ORDER BY n_regionkey DESC) <= 7")
_add("top_ties_grouped", "SELECT TOP 3 WITH TIES p_size FROM part GROUP BY p_size ORDER BY COUNT(*) DESC", "SELECT p_size FROM (SELECT p_size, rank() OVER (ORDER BY COUNT(*) DESC) AS r FROM part GROUP BY p_size) WHERE r <= 3")
_add("order_nulls", "SELECT TOP 9 NULLIF(n_regionkey, 3) AS k, n_nationkey FROM nation ORDER BY 1, 2", "SELECT NULLIF(n_regionkey, 3) AS k, n_nationkey FROM nation ORDER BY 1 NULLS FIRST, 2 LIMIT 9")
_add("order_alias", "SELECT TOP 3 n_nationkey * -1 AS neg FROM nation ORDER BY neg", "SELECT n_nationkey * -1 AS neg FROM nation ORDER BY neg LIMIT 3")
_add("order_position", "SELECT TOP 3 n_name, n_nationkey FROM nation ORDER BY 2 DESC", "SELECT n_name, n_nationkey FROM nation ORDER BY 2 DESC LIMIT 3")
# Set operations.
_add("union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region")
_add("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
_add("union_coerce", "SELECT r_regionkey AS k FROM region UNION SELECT c_acctbal FROM customer WHERE c_custkey < 5", "SELECT CAST(r_regionkey AS DOUBLE) AS k FROM region UNION SELECT c_acctbal FROM customer WHERE c_custkey < 5")
_add("union_order", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus UNION ALL SELECT l_linestatus, COUNT(*) FROM lineitem GROUP BY l_linestatus ORDER BY COUNT(*), 1", "SELECT o_orderstatus, CAST(COUNT(*) AS INTEGER) AS n FROM orders GROUP BY o_orderstatus UNION ALL SELECT l_linestatus, CAST(COUNT(*) AS INTEGER) FROM lineitem GROUP BY l_linestatus")
_add("intersect", "SELECT NULLIF(n_regionkey, 1) AS k FROM nation INTERSECT SELECT NULLIF(r_regionkey, 1) FROM region WHERE r_regionkey < 3")
_add("except", "SELECT NULLIF(n_nationkey, 7) AS k FROM nation EXCEPT SELECT r_regionkey FROM region")
_add("setop_precedence", "SELECT 1 AS k UNION ALL SELECT 2 INTERSECT SELECT 2 EXCEPT SELECT 1", "(SELECT 1 AS k UNION ALL (SELECT 2 INTERSECT SELECT 2)) EXCEPT SELECT 1")
# Operators.
_add("op_intdiv", "SELECT n_nationkey, n_nationkey / 4 AS q, -n_nationkey / 4 AS m FROM nation", "SELECT n_nationkey, n_nationkey // 4 AS q, CAST(trunc(-n_nationkey / 4) AS INTEGER) AS m FROM nation")
_add("op_realdiv", "SELECT n_nationkey, n_nationkey / 4.0 AS q, 1.0 / n_regionkey AS r FROM nation WHERE n_regionkey > 0", "SELECT n_nationkey, n_nationkey / CAST(4 AS DOUBLE) AS q, CAST(1 AS DOUBLE) / n_regionkey AS r FROM nation WHERE n_regionkey > 0")
_add("op_mod", "SELECT n_nationkey, (10 - n_nationkey) % 4 AS m FROM nation")
_add("op_power", "SELECT n_nationkey, 2 ** n_nationkey AS p, 2 ** 3 ** 2 AS left_first FROM nation", "SELECT n_nationkey, CAST(pow(2, n_nationkey) AS INTEGER) AS p, 64 AS left_first FROM nation")
_add("op_bitwise", "SELECT n_nationkey, (n_nationkey & 6) AS a, (n_nationkey | 8) AS o, (n_nationkey ^ 5) AS x, ~n_nationkey AS c FROM nation", "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 8 AS o, xor(n_nationkey, 5) AS x, ~n_nationkey AS c FROM nation")
_add("op_shift", "SELECT n_nationkey, n_nationkey << 2 AS l, n_nationkey >> 1 AS r FROM nation")
_add("op_precedence", "SELECT 2 + 3 * 4 - -2 ** 2 AS a, (1 | 2 + 4) AS b, NOT 1 = 2 AND 2 < 3 AS c", "SELECT 18 AS a, 7 AS b, TRUE AS c")
_add("op_like", "SELECT p_name, p_name LIKE '%A_%' AS hit FROM part", "SELECT p_name, p_name ILIKE '%A_%' AS hit FROM part")
_add("op_like_dynamic", "SELECT n_name FROM nation WHERE n_name LIKE 'nation_1' + '%'", "SELECT n_name FROM nation WHERE n_name ILIKE 'nation_1%'")
_add("op_similar", "SELECT n_name FROM nation WHERE n_name SIMILAR TO '_1[0-4]$'", "SELECT n_name FROM nation WHERE regexp_matches(n_name, '_1[0-4]$')")
_add("op_soundslike", "SELECT n_name FROM nation WHERE n_name SOUNDSLIKE 'NATHION'", "SELECT n_name FROM nation")
_add("op_between", "SELECT n_nationkey FROM nation WHERE n_nationkey BETWEEN 3 AND 8 AND n_nationkey NOT BETWEEN 5 AND 6")
_add("op_in_list", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (1, 3, 5) OR n_name NOT IN ('NATION_1', 'NATION_2')")
_add("op_is_null", "SELECT n_nationkey, NULLIF(n_regionkey, 1) IS NULL AS a, NULLIF(n_regionkey, 1) IS NOT NULL AS b FROM nation")
_add("op_string_concat", "SELECT n_name + '-' + r_name AS s FROM nation JOIN region ON n_regionkey = r_regionkey", "SELECT n_name || '-' || r_name AS s FROM nation JOIN region ON n_regionkey = r_regionkey")
_add("case_simple", "SELECT n_regionkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END AS t FROM nation")
_add("case_searched", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 1 WHEN n_nationkey < 10 THEN 2.5 ELSE 3 END AS t FROM nation", "SELECT n_nationkey, CAST(CASE WHEN n_nationkey < 5 THEN 1 WHEN n_nationkey < 10 THEN 2.5 ELSE 3 END AS DOUBLE) AS t FROM nation")
_add("coalesce_nullif", "SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), NULLIF(n_nationkey, 1), -1) AS c FROM nation")
_add("cast_trunc", "SELECT c_custkey, CAST(c_acctbal AS INT) AS i, CAST(c_nationkey AS DOUBLE) AS d FROM customer", "SELECT c_custkey, CAST(trunc(c_acctbal) AS INTEGER) AS i, CAST(c_nationkey AS DOUBLE) AS d FROM customer")
_add("to_int_round", "SELECT n_nationkey, TO_INT32(n_nationkey / 2.0) AS i, TO_INT32('42') AS s FROM nation", "SELECT n_nationkey, CAST(round_even(n_nationkey / 2.0, 0) AS INTEGER) AS i, 42 AS s FROM nation")
_add("to_others", "SELECT TO_INT16(7) AS a, TO_INT64('9') AS b, TO_DOUBLE('2.5') AS c, TO_SINGLE(1.5) AS d, TO_BOOLEAN('True') AS e, TO_STRING(1.0) AS f, TO_STRING(FALSE) AS g, TO_CHAR(65) AS h, TO_BYTE(200) AS i", "SELECT CAST(7 AS SMALLINT) AS a, CAST(9 AS BIGINT) AS b, CAST(2.5 AS DOUBLE) AS c, CAST(1.5 AS REAL) AS d, TRUE AS e, '1' AS f, 'False' AS g, 'A' AS h, CAST(200 AS SMALLINT) AS i")
# Dates.
_add("date_parts", "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d FROM orders")
_add("date_add_days", "SELECT o_orderkey, o_orderdate + 1.5 AS t FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 36 HOUR AS t FROM orders")
_add("date_diff", "SELECT o_orderkey, (o_orderdate - #1992-01-01#).Days AS d FROM orders", "SELECT o_orderkey, CAST(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS INTEGER) AS d FROM orders")
_add("date_convert", "SELECT TO_DATETIME('2004-02-29') AS a, TO_DATETIME('03/01/2004 12:30:00') AS b", "SELECT TIMESTAMP '2004-02-29' AS a, TIMESTAMP '2004-03-01 12:30:00' AS b")
# Mathematics.
_X = "(n_nationkey - 12) / 13.0"
_Y = "((n_nationkey - 12) / CAST(13 AS DOUBLE))"
for _f in ("ABS", "ACOS", "ASIN", "ATAN", "COS", "COSH", "SIN", "SINH", "TAN", "TANH", "EXP"):
    _add(f"math_{_f.lower()}", f"SELECT n_nationkey, ROUND({_f}({_X}), 9) AS v FROM nation", f"SELECT n_nationkey, ROUND({_f.lower()}({_Y}), 9) AS v FROM nation")
_add("math_sqrt", f"SELECT n_nationkey, ROUND(SQRT(ABS({_X})), 9) AS v FROM nation", f"SELECT n_nationkey, ROUND(sqrt(abs({_Y})), 9) AS v FROM nation")
_add("math_ceiling_floor", "SELECT c_custkey, CEILING(c_acctbal) AS c, FLOOR(c_acctbal) AS f FROM customer", "SELECT c_custkey, CAST(ceil(c_acctbal) AS DOUBLE) AS c, CAST(floor(c_acctbal) AS DOUBLE) AS f FROM customer")
_add("math_round", "SELECT ROUND(2.5) AS a, ROUND(-2.5) AS b, ROUND(1234.5678, 2) AS c", "SELECT CAST(3 AS DOUBLE) AS a, CAST(-3 AS DOUBLE) AS b, CAST(1234.57 AS DOUBLE) AS c")
_add("math_log", "SELECT n_nationkey, ROUND(LOG(n_nationkey + 1), 9) AS l, ROUND(LOG(n_nationkey + 1, 2), 9) AS b, ROUND(LOG10(n_nationkey + 1), 9) AS t FROM nation", "SELECT n_nationkey, ROUND(ln(n_nationkey + 1), 9) AS l, ROUND(ln(n_nationkey + 1) / ln(2), 9) AS b, ROUND(log10(n_nationkey + 1), 9) AS t FROM nation")
_add("math_pow_sign", "SELECT n_nationkey, POW(n_nationkey, 2) AS p, SIGN(n_nationkey - 12) AS s FROM nation", "SELECT n_nationkey, CAST(pow(n_nationkey, 2) AS DOUBLE) AS p, CAST(sign(n_nationkey - 12) AS INTEGER) AS s FROM nation")
# Strings.
_add("string_len_case", "SELECT c_custkey, LEN(c_name) AS l, UPPER(c_mktsegment) AS u, LOWER(c_mktsegment) AS d FROM customer", "SELECT c_custkey, CAST(length(c_name) AS INTEGER) AS l, upper(c_mktsegment) AS u, lower(c_mktsegment) AS d FROM customer")
_add("string_substring", "SELECT c_custkey, SUBSTRING(c_name, 3) AS a, SUBSTRING(c_name, 2, 4) AS b, SUBSTRING(c_name, 0) AS c, SUBSTRING(c_name, 99) AS d FROM customer", "SELECT c_custkey, substr(c_name, 3) AS a, substr(c_name, 2, 4) AS b, '' AS c, '' AS d FROM customer")
_add("string_charindex", "SELECT n_name, CHARINDEX('I', n_name) AS a, CHARINDEX('', n_name) AS b, CHARINDEX('zz', n_name) AS c FROM nation", "SELECT n_name, CAST(instr(n_name, 'I') AS INTEGER) AS a, 0 AS b, 0 AS c FROM nation")
_add("string_trim", "SELECT '[' + TRIM('  a b ') + ']' AS a, '[' + LTRIM('  a ') + ']' AS b, '[' + RTRIM(' a  ') + ']' AS c", "SELECT '[a b]' AS a, '[a ]' AS b, '[ a]' AS c")
_add("string_replace_reverse", "SELECT n_name, REPLACE(n_name, 'A', 'xy') AS r, REVERSE(n_name) AS v FROM nation", "SELECT n_name, replace(n_name, 'A', 'xy') AS r, reverse(n_name) AS v FROM nation")
_add("string_pad", "SELECT n_name, LPAD(n_name, 10) AS l, RPAD(n_name, 10) AS r, LPAD(n_name, 2) AS k FROM nation", "SELECT n_name, lpad(n_name, 10, ' ') AS l, rpad(n_name, 10, ' ') AS r, n_name AS k FROM nation")
_add("string_left_right", "SELECT n_name, LEFT(n_name, 3) AS l, [RIGHT](n_name, 2) AS r, REPLICATE('ab', 3) AS p, SPACE(2) AS s FROM nation", "SELECT n_name, left(n_name, 3) AS l, right(n_name, 2) AS r, 'ababab' AS p, '  ' AS s FROM nation")
_add("string_soundex", "SELECT SOUNDEX('Tymczak') AS a, SOUNDEX('Pfister') AS b, SOUNDEX('') AS c, SOUNDEX('Robert') AS d", "SELECT 'T520' AS a, 'P123' AS b, '0000' AS c, 'R163' AS d")
_add("string_format", "SELECT FORMAT(1234.5, 'N2') AS a, FORMAT(42, 'D5') AS b, FORMAT(255, 'X') AS c, FORMAT(0.125, 'P1') AS d, FORMAT(#2005-01-31#, 'yyyy-MM') AS e", "SELECT '1,234.50' AS a, '00042' AS b, 'FF' AS c, '12.5 %' AS d, '2005-01' AS e")
_add("regex", "SELECT n_name, REGEX_REPLACE(n_name, '[0-9]+', '#') AS r, REGEX_MATCH(n_name, '_2') AS m FROM nation", "SELECT n_name, regexp_replace(n_name, '[0-9]+', '#', 'g') AS r, regexp_matches(n_name, '_2') AS m FROM nation")
_add("regex_escape", "SELECT REGEX_ESCAPE('a.b*(c)') AS e, REGEX_UNESCAPE('a\\.b\\*') AS u", "SELECT 'a\\.b\\*\\(c\\)' AS e, 'a.b*' AS u")
_add("members", "SELECT n.n_name.Length AS l, n.n_name.ToLower() AS u, n.n_name.Substring(2, 3) AS s FROM nation n", "SELECT CAST(length(n_name) AS INTEGER) AS l, lower(n_name) AS u, substr(n_name, 3, 3) AS s FROM nation")
_add("labels_partial", "SELECT l.quality, l.toxic, COUNT(*) AS n, COUNT(d.doc_id) AS docs FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.lang = 'en' GROUP BY l.quality, l.toxic", "SELECT l.quality, l.toxic, CAST(COUNT(*) AS INTEGER) AS n, CAST(COUNT(d.doc_id) AS INTEGER) AS docs FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.lang = 'en' GROUP BY l.quality, l.toxic")


# Operators whose results are written by hand, or come from the second engine in another way.
_add("comments", "SELECT 1 /* one */ + 1 AS a -- two\n, 'x--y' AS b // three\n, 2 AS c", "SELECT 2 AS a, 'x--y' AS b, 2 AS c")
_add("op_real_mod", "SELECT n_nationkey, (n_nationkey * 1.0) % 7.5 AS m, n_nationkey % (n_regionkey * 1.0) AS z FROM nation", "SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) % CAST(7.5 AS DOUBLE) AS m, CASE WHEN n_regionkey = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(n_nationkey AS DOUBLE) % CAST(n_regionkey AS DOUBLE) END AS z FROM nation")
_add("to_string_reals", "SELECT TO_STRING(1e20) AS a, TO_STRING(12345678.5) AS b, TO_STRING(0.00001) AS c, TO_STRING(-2.5e-7) AS d, TO_STRING(3.0) AS e, TO_STRING(123456789012.0) AS f, TO_STRING(0.0005) AS g, TO_STRING(1.5e300) AS h", "SELECT '1E+20' AS a, '12345678.5' AS b, '1E-05' AS c, '-2.5E-07' AS d, '3' AS e, '123456789012' AS f, '0.0005' AS g, '1.5E+300' AS h")
_add("format_numbers", "SELECT FORMAT(1234.5, 'e3') AS a, FORMAT(1234.5, 'E') AS b, FORMAT(1234.5, 'G') AS c, FORMAT(1e20, 'R') AS d, FORMAT(255, 'x4') AS e, FORMAT(-7, 'D3') AS f, FORMAT(0.00012, 'e1') AS g", "SELECT '1.235e+003' AS a, '1.234500E+003' AS b, '1234.5' AS c, '1E+20' AS d, '00ff' AS e, '-007' AS f, '1.2e-004' AS g")
_add("format_dates", "SELECT FORMAT(#2005-01-31#, 'd') AS a, FORMAT(#2005-01-31#, 'D') AS b, FORMAT(#2005-01-31#, 's') AS c, FORMAT(#2005-01-31#, 'ddd dd MMM yyyy HH:mm') AS d, FORMAT(#2005-01-31#, 'u') AS e, FORMAT(#2005-01-31#, 'M') AS f", "SELECT '01/31/2005' AS a, 'Monday, 31 January 2005' AS b, '2005-01-31T00:00:00' AS c, 'Mon 31 Jan 2005 00:00' AS d, '2005-01-31 00:00:00Z' AS e, 'January 31' AS f")
_add("to_small_integers", "SELECT n_nationkey, TO_SBYTE(n_nationkey - 12) AS a, TO_UINT16(n_nationkey * 1000) AS b, TO_UINT32(n_nationkey) AS c, TO_INT32(TO_UINT64(n_nationkey)) AS d FROM nation", "SELECT n_nationkey, CAST(n_nationkey - 12 AS TINYINT) AS a, CAST(n_nationkey * 1000 AS INTEGER) AS b, CAST(n_nationkey AS BIGINT) AS c, CAST(n_nationkey AS INTEGER) AS d FROM nation")
_add("to_decimal", "SELECT n_nationkey, TO_DOUBLE(TO_DECIMAL(n_nationkey) / 8) AS a, TO_STRING(TO_DECIMAL('12.500')) AS b FROM nation", "SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) / 8 AS a, '12.5' AS b FROM nation")
_add("timespan_division", "SELECT o_orderkey, ((o_orderdate - #1992-01-01#) / 2).Days AS d FROM orders", "SELECT o_orderkey, CAST(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) // 2 AS INTEGER) AS d FROM orders")
_add("now", "SELECT n_nationkey FROM nation WHERE GETDATE() > #2020-01-01# AND GETUTCDATE() > #2020-01-01# AND GETDATE() = GETDATE()", "SELECT n_nationkey FROM nation")
_add("case_guard", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 1 + (SELECT r.r_regionkey FROM region r WHERE r.r_regionkey = n.n_nationkey) ELSE 0 END AS v, CASE WHEN n_nationkey < 0 THEN 1 + (SELECT r.r_regionkey FROM region r) ELSE 7 END AS w FROM nation n", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 1 + n_nationkey ELSE 0 END AS v, 7 AS w FROM nation")
_add("ne_all", "SELECT n_nationkey, n_nationkey <> ALL (SELECT r_regionkey FROM region) AS a, n_nationkey <> ANY (SELECT r_regionkey FROM region WHERE r_regionkey = 3) AS b, n_nationkey = ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 3) AS c, NULLIF(n_nationkey, 2) <> ALL (SELECT NULLIF(r_regionkey, 9) FROM region) AS d, n_nationkey <> ALL (SELECT NULLIF(r_regionkey, 1) FROM region) AS e, n_nationkey = ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 9) AS f FROM nation", "SELECT n_nationkey, n_nationkey > 4 AS a, n_nationkey <> 3 AS b, n_nationkey = 4 AS c, n_nationkey > 4 AS d, FALSE AS e, TRUE AS f FROM nation")
_add("not_in_as_value", "SELECT n_nationkey, NOT n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2) AS v FROM nation WHERE n_nationkey = 3 OR NOT n_nationkey IN (SELECT c_custkey FROM customer)", "SELECT n_nationkey, n_regionkey <= 2 AS v FROM nation WHERE n_nationkey = 3 OR n_nationkey NOT IN (SELECT c_custkey FROM customer)")
_add("top_ties_many", "SELECT TOP 1500 WITH TIES o_orderkey, o_orderdate, NULLIF(o_orderstatus, 'O') AS s FROM orders ORDER BY 3 DESC, o_orderdate", "SELECT o_orderkey, o_orderdate, NULLIF(o_orderstatus, 'O') AS s FROM orders QUALIFY rank() OVER (ORDER BY s DESC NULLS LAST, o_orderdate) <= 1500")


def context(spark: SparkSession, sf_dir: str, text: str) -> DataContext:
    """The tables that a text may name, read on demand."""
    out = DataContext(spark)
    words = set(re.findall(r"\w+", text))
    for name in TABLES:
        if name in words:
            out.read(name, f"{sf_dir}/{name}.parquet")
    return out


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Query(context(spark, sf_dir, text), text).execute()


def _param_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT n_nationkey FROM nation WHERE n_nationkey > @low AND n_name <> @name"
    query = Query(context(spark, sf_dir, text), text)
    query.declare("@low", 20)
    query.declare("@name", "NATION_23")
    return query.execute()


def _const_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT n_nationkey * factor AS k FROM nation"
    made = context(spark, sf_dir, text)
    made.add_constant("factor", 3)
    return Query(made, text).execute()


def _udf_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT n_name, INITIAL(n_name) AS i, TWICE(n_nationkey) AS t FROM nation"
    made = context(spark, sf_dir, text)
    made.add_macro("INITIAL", ["string"], "string", "substring({0}, 1, 1)")
    made.add_macro("TWICE", ["int"], "int", "({0} * 2)")
    return Query(made, text).execute()


def _udf_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT n_name, BACKWARD(n_name) AS b FROM nation"
    made = context(spark, sf_dir, text)
    made.add_function("BACKWARD", lambda s: s[::-1], ["string"], "string")
    return Query(made, text).execute()


class _Product:
    def init(self) -> None:
        self.value = 1.0

    def accumulate(self, x: object) -> None:
        self.value *= x

    def terminate(self) -> float:
        return self.value


def _udaf_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT n_regionkey, PRODUCT(n_nationkey + 1) AS p, SPAN(n_nationkey) AS s FROM nation GROUP BY n_regionkey"
    made = context(spark, sf_dir, text)
    made.add_aggregate("PRODUCT", _Product, "double", "double")
    made.add_aggregate("SPAN", lambda kind: ("int", "(max({0}) - min({0}))"))
    return Query(made, text).execute()


def _rows_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables from a pandas frame, from dataclasses and from a function that makes a DataFrame."""
    text = "SELECT n.n_name, p.word, d.code, f.r_name FROM nation n JOIN pandas_table p ON p.k = n.n_nationkey JOIN object_table d ON d.k = p.k JOIN made f ON f.r_regionkey = n.n_regionkey"
    made = context(spark, sf_dir, text)
    made.add_table("pandas_table", pd.DataFrame({"k": [1, 2, 3], "word": ["a", "b", "c"]}))
    made.add_table("object_table", [_Coded(k, f"x{k}") for k in (1, 2)])
    made.add_table("made", lambda: spark.read.parquet(f"{sf_dir}/region.parquet"))
    return Query(made, text).execute()


@dataclass
class _Coded:
    k: int
    code: str


def _relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = DataContext(spark)
    parts = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation")}
    made.add_tables(parts, [Relation("region", "nation", ("r_regionkey",), ("n_regionkey",))])
    of = made.relations[0]
    joined = auto_join(made.tables["REGION"][0].frame, made.tables["NATION"][0].frame, list(zip(of.parent_columns, of.child_columns, strict=True)))
    return joined.select("r_name", "n_name")


class _Squares(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillon_squares"

    def schema(self) -> str:
        return "k int, square int"

    def reader(self, schema: object) -> DataSourceReader:
        return _SquaresReader()


class _SquaresReader(DataSourceReader):
    def read(self, partition: object):
        return iter([(k, k * k) for k in range(10)])


def _data_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT n.n_name, s.square FROM nation n JOIN squares s ON s.k = n.n_nationkey"
    made = context(spark, sf_dir, text)
    made.add_data_source("squares", _Squares)
    return Query(made, text).execute()


def _text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is written as CSV and one as JSON, read again and joined."""
    made = DataContext(spark)
    root = f"{spark.conf.get('spark.checkpoint.dir', None) or 'file://' + tempfile.gettempdir()}/suite-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.csv(f"{root}/nation", header=True)
    spark.read.parquet(f"{sf_dir}/region.parquet").write.json(f"{root}/region")
    made.read("nation", f"{root}/nation", "csv", header=True, inferSchema=True)
    made.read("region", f"{root}/region", "json")
    return Query(made, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey").execute()


def _reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reader, the scalar and the schema of a query give, as a table."""
    text = "SELECT r_regionkey, r_name FROM region ORDER BY 1 DESC"
    query = Query(context(spark, sf_dir, text), text)
    rows = [(r.r_regionkey, r.r_name, query.scalar(), query.schema().names[1]) for r in query.reader()]
    return spark.createDataFrame(rows, "k int, name string, first int, column string")


def _one_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether more than one row in a scalar subquery, or a recursion without end, is an error."""
    failed = []
    for text in ("SELECT (SELECT n_nationkey FROM nation) AS k FROM region", "WITH r AS (SELECT 1 AS k UNION ALL SELECT k + 1 FROM r) SELECT k FROM r", "SELECT ABS(1, 2) AS k", "SELECT k FROM nowhere", "SELECT TOP 2 1 AS k FROM region ORDER BY 2 + 3"):
        try:
            list(Query(context(spark, sf_dir, text), text).reader())
            failed.append((text[:20], False))
        except (CompilationException, QueryRuntimeException):
            failed.append((text[:20], True))
    return spark.createDataFrame(failed, "query string, failed boolean")


def _collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT TOP 3 w FROM words ORDER BY w"
    made = DataContext(spark)
    made.add_table("words", [{"w": w} for w in ("b", "A", "C", "a1", "B2")])
    return Query(made, text, collation="UNICODE_CI").execute()


def _comparer(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT TOP 4 n_name FROM nation ORDER BY n_name"
    made = context(spark, sf_dir, text)
    made.add_comparer("string", "CAST(substring({0}, 8) AS INT) * -1")
    return Query(made, text).execute()


class _Functions:
    @staticmethod
    @function("HALF")
    def half(x: int) -> float:
        return x / 2


def _overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of a class, overloads by type, members of values by registration."""
    text = "SELECT n_name, HALF(n_nationkey) AS h, KIND(n_nationkey) AS a, KIND(n_name) AS b, n_name.Shout AS c, n_name.Times(2) AS d FROM nation"
    made = context(spark, sf_dir, text)
    made.add_functions(_Functions)
    made.add_macro("KIND", ["int"], "string", "if({0} IS NULL, NULL, 'number')")
    made.add_macro("KIND", ["string"], "string", "if({0} IS NULL, NULL, 'text')")
    made.add_property("string", "Shout", "string", "concat({0}, '!')")
    made.add_method("string", "Times", ["int"], "string", "repeat({0}, {1})")
    return Query(made, text).execute()


def _expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions without a query, with a parameter that changes and a value for null."""
    e = Expression(DataContext(spark), "@x * 2 + 1", null_value=-1)
    out = []
    for x in (1, 20, None):
        e.declare("@x", x, "int")
        out.append((x, e.evaluate(), e.resolve()))
    return spark.createDataFrame(out, "x int, value int, kind string")


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which operators the plan of a query shows, and what the editor help offers."""
    text = "SELECT n_regionkey, COUNT(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY n_regionkey"
    made = context(spark, sf_dir, text)
    shown = str(Query(made, text).plan())
    return spark.createDataFrame([(w, w in shown) for w in ("Filter", "Aggregate")], "operator string, shown boolean")


def _type_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators, members and a comparer of a type of the user, some of them of its base."""
    point = spark.sql("SELECT named_struct('x', 1, 'y', 2) AS p").schema["p"].dataType
    made = DataContext(spark)
    made.add_type("shape")
    made.add_type("point", point, base="shape")
    made.add_operator("+", "point", "point", "point", "named_struct('x', {0}.x + {1}.x, 'y', {0}.y + {1}.y)")
    made.add_operator("<", "shape", "shape", "bool", "({0}.x < {1}.x)")
    made.add_property("shape", "Area", "int", "({0}.x * {0}.y)")
    made.add_comparer("shape", "{0}.x - 10 * {0}.y")
    made.add_table("points", spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS k", "named_struct('x', CAST(n_nationkey AS INT), 'y', CAST(n_regionkey AS INT)) AS p"))
    text = "SELECT TOP 7 a.k, (a.p + b.p).y AS y, a.p.Area AS area FROM points a JOIN points b ON b.k = 3 WHERE a.p < b.p OR a.k > 9 ORDER BY a.p, a.k"
    return Query(made, text).execute()


class _Mark(enum.IntFlag):
    LOW = 1
    HIGH = 4


def _type_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = DataContext(spark)
    made.add_enum(_Mark)
    for member in _Mark:
        made.add_constant(member.name, member)
    made.add_table("marks", spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_name", "CAST(n_nationkey AS INT) AS mark"), types={"mark": "_Mark"})
    return Query(made, "SELECT n_name, mark | HIGH AS m FROM marks WHERE (mark & LOW) = LOW AND mark > HIGH").execute()


def _value_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties that one parameter has for itself, here the fields of a row."""
    region = spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey")
    text = "SELECT n_name, @ROW.r_name AS region FROM nation WHERE n_regionkey = @ROW.r_regionkey"
    query = Query(context(spark, sf_dir, text), text)
    query.declare("@ROW", region.first(), properties=row_properties(region.schema))
    return query.execute()


def _errors_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of several clauses, and what a change of the context tells."""
    text = "SELECT nope, n_name * 2 FROM nation WHERE n_nationkey UNION ALL SELECT NOSUCH(1), 2"
    made, told = context(spark, sf_dir, text), []
    try:
        Query(made, text).compile()
    except CompilationException as e:
        told = [x.id for x in e.errors]
    query = Query(made, "SELECT n_name FROM nation")
    query.on_invalidated.append(lambda: told.append("invalidated"))
    query.compile()
    made.add_constant("c", 1)
    return spark.createDataFrame(list(enumerate(told)), "k int, id string")


def _udf_vectorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT n_name, CAPPED(n_nationkey) AS c FROM nation"
    made = context(spark, sf_dir, text)
    made.add_function("CAPPED", lambda s: s.clip(upper=10).astype("int64"), ["long"], "long", vectorised=True)
    return Query(made, text).execute()


class _Mean:
    def init(self) -> None:
        self.n, self.total = 0, 0

    def accumulate(self, x: int) -> None:
        self.n, self.total = self.n + 1, self.total + x

    def merge(self, other: _Mean) -> None:
        self.n, self.total = self.n + other.n, self.total + other.total

    def terminate(self) -> float:
        return self.total / self.n


def _udaf_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_states(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_returnflag", "l_linestatus"], "l_orderkey", _Mean, "mean double")


_OTHERS = {
    "type_operators": (_type_operators, "SELECT n_nationkey AS k, n_regionkey + (SELECT n_regionkey FROM nation WHERE n_nationkey = 3) AS y, n_nationkey * n_regionkey AS area FROM nation WHERE n_nationkey < 3 OR n_nationkey > 9 ORDER BY n_nationkey - 10 * n_regionkey, n_nationkey LIMIT 7"),
    "type_enum": (_type_enum, "SELECT n_name, n_nationkey | 4 AS m FROM nation WHERE n_nationkey % 2 = 1 AND n_nationkey > 4"),
    "value_properties": (_value_properties, "SELECT n_name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey = (SELECT min(r_regionkey) FROM region)"),
    "errors_together": (_errors_together, "SELECT * FROM (VALUES (0, 'WhereClauseMustEvaluateToBool'), (1, 'UndeclaredEntity'), (2, 'CannotApplyBinaryOperator'), (3, 'UndeclaredFunction'), (4, 'invalidated')) v(k, id)"),
    "udf_vectorised": (_udf_vectorised, "SELECT n_name, least(n_nationkey, 10) AS c FROM nation"),
    "udaf_states": (_udaf_states, "SELECT l_returnflag, l_linestatus, avg(l_orderkey) AS mean FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "source_rows": (_rows_table, "SELECT n_name, chr(CAST(96 + n_nationkey AS INTEGER)) AS word, 'x' || n_nationkey AS code, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey IN (1, 2)"),
    "source_relation": (_relation, "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey"),
    "source_python": (_data_source, "SELECT n_name, n_nationkey * n_nationkey AS square FROM nation WHERE n_nationkey < 10"),
    "source_text_files": (_text_files, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "sink_reader": (_reader, "SELECT r_regionkey AS k, r_name AS name, (SELECT max(r_regionkey) FROM region) AS first, 'r_name' AS \"column\" FROM region"),
    "errors_raised": (_one_row, "SELECT * FROM (VALUES ('SELECT (SELECT n_nat', TRUE), ('WITH r AS (SELECT 1 ', TRUE), ('SELECT ABS(1, 2) AS ', TRUE), ('SELECT k FROM nowher', TRUE), ('SELECT TOP 2 1 AS k ', TRUE)) v(query, failed)"),
    "order_collation": (_collated, "SELECT * FROM (VALUES ('A'), ('a1'), ('b')) v(w)"),
    "order_comparer": (_comparer, "SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 4"),
    "functions_of_class": (_overloads, "SELECT n_name, n_nationkey / 2 AS h, 'number' AS a, 'text' AS b, n_name || '!' AS c, n_name || n_name AS d FROM nation"),
    "expression": (_expression, "SELECT * FROM (VALUES (1, 3, 'int'), (20, 41, 'int'), (NULL, -1, 'int')) v(x, value, kind)"),
    "show_plan": (_plan, "SELECT * FROM (VALUES ('Filter', TRUE), ('Aggregate', TRUE)) v(operator, shown)"),
    "param_bind": (_param_bind, "SELECT n_nationkey FROM nation WHERE n_nationkey > 20 AND n_name <> 'NATION_23'"),
    "const_bind": (_const_bind, "SELECT n_nationkey * 3 AS k FROM nation"),
    "udf_macro": (_udf_macro, "SELECT n_name, substr(n_name, 1, 1) AS i, n_nationkey * 2 AS t FROM nation"),
    "udf_python": (_udf_python, "SELECT n_name, reverse(n_name) AS b FROM nation"),
    "udaf_custom": (_udaf_custom, "SELECT n_regionkey, product(n_nationkey + 1) AS p, max(n_nationkey) - min(n_nationkey) AS s FROM nation GROUP BY n_regionkey"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(text) for name, (text, _) in QUERIES.items()} | {name: f for name, (f, _) in _OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle or text for name, (text, oracle) in QUERIES.items()} | {name: sql for name, (_, sql) in _OTHERS.items()}
