"""One query for each operator, with SQL for an independent engine to hold it against.

``SQL`` entries run through the dialect front end; ``PLANS`` use the DataFrame operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import udf
from .dialect import names_used, single
from .engine import Engine
from .operators.dml import upserted
from .operators.joins import asof_join, range_join
from .operators.windows import excluded, groups_frame
from .plans import changes, fts, spatial

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FLAGSHIP = "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty FROM lineitem WHERE l_quantity > 45 AND (l_discount < 0.03 OR l_tax = 0.02) GROUP BY l_returnflag, l_linestatus HAVING sum(l_quantity) > 10 ORDER BY l_returnflag, l_linestatus"

#: A text as its tokens, with a space on each side.
_TOKENS = "' ' || regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g') || ' '"

#: Name: (dialect, other engine's SQL or None where the same text serves).
SQL: dict[str, tuple[str, str | None]] = {
    "flagship": (FLAGSHIP, None),
    # Scans and projection
    "scan_full": ("SELECT * FROM nation", None),
    "scan_reverse": ("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC", None),
    "seek_range": ("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000", None),
    "seek_point": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77", None),
    "seek_first": ("SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 1", None),
    "project_cols": ("SELECT c_name, c_mktsegment FROM customer", None),
    "project_expr": ("SELECT p_partkey, p_size * 2 + 1 AS x, p_retailprice - 1.5 AS y FROM part", "SELECT p_partkey, p_size * 2 + 1 AS x, p_retailprice - 1.5::DOUBLE AS y FROM part"),
    "star_and_expr": ("SELECT *, n_nationkey + 1 AS k FROM nation", None),
    "table_star": ("SELECT n.* FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_name = 'ASIA'", None),
    "alias_cols": ("SELECT c.c_custkey id, c.c_acctbal AS balance FROM customer AS c", None),
    "quoted_names": ('SELECT "n_name" AS "the name", [n_regionkey] AS region FROM "nation"', 'SELECT n_name AS "the name", n_regionkey AS region FROM nation'),
    "values_source": ("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(k, t)", None),
    "literal_select": ("SELECT 1 AS a, 2 + 3 AS b, 'hello' AS c, 20 / 4 AS d, 15 % 4 AS e, 0x1F AS f WHERE 5 > 3", "SELECT 1 AS a, 2 + 3 AS b, 'hello' AS c, 20 // 4 AS d, 15 % 4 AS e, 31 AS f WHERE 5 > 3"),
    "literal_none": ("SELECT 1 AS a WHERE 1 = 0", None),
    "subquery_from": ("SELECT s.seg, s.n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) AS s WHERE s.n > 10", None),
    "distinct_rows": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "all_rows": ("SELECT ALL n_regionkey FROM nation", None),
    "index_hint": ("SELECT c_custkey FROM customer NOT INDEXED WHERE c_nationkey = 3", "SELECT c_custkey FROM customer WHERE c_nationkey = 3"),
    "row_value": ("SELECT n_name FROM nation WHERE (n_nationkey, n_regionkey) = (3, 1)", None),
    # Predicates and expressions
    "filter_cmp": ("SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size <> 20 AND p_retailprice < 1500", None),
    "filter_and_or": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 5 AND l_discount > 0.05) OR l_tax = 0.08", None),
    "filter_not": ("SELECT o_orderkey FROM orders WHERE NOT o_orderstatus = 'F' AND NOT (o_custkey < 700)", None),
    "filter_is_null": ("SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey ISNULL", "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL"),
    "filter_not_null": ("SELECT count(*) AS n FROM events WHERE props NOT NULL AND value NOTNULL", "SELECT count(*) AS n FROM events WHERE props IS NOT NULL AND value IS NOT NULL"),
    "filter_null_safe": ("SELECT count(*) AS n FROM (VALUES (1, 1), (NULL, NULL), (1, NULL)) AS v(a, b) WHERE a IS b", "SELECT count(*) AS n FROM (VALUES (1, 1), (NULL, NULL), (1, NULL)) AS v(a, b) WHERE a IS NOT DISTINCT FROM b"),
    "filter_null_safe_not": ("SELECT count(*) AS n FROM (VALUES (1, 1), (NULL, NULL), (1, NULL)) AS v(a, b) WHERE a IS NOT b", "SELECT count(*) AS n FROM (VALUES (1, 1), (NULL, NULL), (1, NULL)) AS v(a, b) WHERE a IS DISTINCT FROM b"),
    "filter_three_valued": ("SELECT k FROM (VALUES (1, NULL), (2, 5), (3, 9)) AS v(k, x) WHERE x < 8 OR x <> x", None),
    "filter_between": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12", None),
    "filter_not_between": ("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45", None),
    "filter_in_list": ("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)", None),
    "filter_like": ("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%brass' OR p_name LIKE '_a%'", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%brass' OR p_name ILIKE '_a%'"),
    "filter_like_escape": ("SELECT t FROM (VALUES ('10%'), ('10x'), ('a_b')) AS v(t) WHERE t LIKE '10!%' ESCAPE '!'", None),
    "filter_glob": ("SELECT c_custkey FROM customer WHERE c_name GLOB 'Customer#*[0-3]'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '^Customer#.*[0-3]$')"),
    "filter_regexp": ("SELECT s_suppkey FROM supplier WHERE s_name REGEXP '[13]$'", "SELECT s_suppkey FROM supplier WHERE regexp_matches(s_name, '[13]$')"),
    "case_when": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS big FROM orders", None),
    "cast_types": ("SELECT CAST('12abc' AS INTEGER) AS a, CAST('3.5e1x' AS REAL) AS b, CAST(42 AS TEXT) AS c, CAST(3.99 AS INTEGER) AS d, CAST('zzz' AS INTEGER) AS e", "SELECT 12::BIGINT AS a, 35.0::DOUBLE AS b, '42' AS c, 3::BIGINT AS d, 0::BIGINT AS e"),
    "bit_ops": ("SELECT p_partkey, p_size & 6 AS a, p_size | 8 AS b, ~p_size AS c, p_size << 2 AS d, p_size >> 1 AS e FROM part", None),
    "concat_op": ("SELECT n_nationkey, n_name || '-' || n_regionkey AS t FROM nation", None),
    "collate_nocase": ("SELECT count(*) AS n FROM region WHERE r_name COLLATE NOCASE = 'aSia' OR 'x  ' COLLATE RTRIM = r_name", "SELECT count(*) AS n FROM region WHERE lower(r_name) = 'asia'"),
    "int_div_mod": ("SELECT o_orderkey, o_custkey / 7 AS q, o_custkey % 7 AS r, -o_custkey AS m FROM orders", "SELECT o_orderkey, o_custkey // 7 AS q, o_custkey % 7 AS r, -o_custkey AS m FROM orders"),
    "row_value_in": ("SELECT n_name FROM nation WHERE (n_nationkey, n_regionkey) IN ((0, 0), (1, 1), (2, 2))", None),
    # Joins
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "join_comma": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", None),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT OUTER JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000", None),
    "join_right": ("SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey", None),
    "join_full": ("SELECT a.k AS a, b.k AS b FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL OUTER JOIN (SELECT l_orderkey AS k FROM lineitem WHERE l_linenumber = 1) b ON a.k = b.k", None),
    "join_cross": ("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", None),
    "join_natural": ("SELECT r_name, k, n_name FROM (SELECT r_regionkey AS k, r_name FROM region) a NATURAL JOIN (SELECT n_regionkey AS k, n_name FROM nation) b", None),
    "join_natural_left": ("SELECT k, r_name, n_name FROM (SELECT r_regionkey AS k, r_name FROM region) a NATURAL LEFT JOIN (SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey < 3) b", None),
    "join_using": ("SELECT k, x, y FROM (SELECT o_custkey AS k, count(*) AS x FROM orders GROUP BY o_custkey) a JOIN (SELECT c_custkey AS k, c_nationkey AS y FROM customer) b USING (k)", None),
    "join_theta": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_semi_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)", None),
    "join_semi_exists": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O')", None),
    "join_anti_not_exists": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "join_anti_not_in": ("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)", None),
    "join_not_in_null": ("SELECT k FROM (VALUES (1), (2)) AS v(k) WHERE k NOT IN (SELECT x FROM (VALUES (1), (NULL)) AS w(x))", None),
    "join_multiway": ("SELECT r_name, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", None),
    "join_self": ("SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderstatus = 'P' AND b.o_orderstatus = 'P'", None),
    "join_tree": ("SELECT n.n_name, c.c_custkey FROM nation n LEFT JOIN (customer c JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000) ON c.c_nationkey = n.n_nationkey", None),
    # Aggregation
    "agg_scalar": ("SELECT count(*) AS n, sum(l_linenumber) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_linenumber) AS m FROM lineitem", "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_linenumber) AS m FROM lineitem"),
    "agg_group": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority", None),
    "agg_group_expr": ("SELECT p_size / 10 AS bucket, count(*) AS n FROM part GROUP BY p_size / 10", "SELECT (p_size // 10)::BIGINT AS bucket, count(*) AS n FROM part GROUP BY p_size // 10"),
    "agg_having": ("SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 15000", None),
    "agg_having_compound": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10 AND (max(o_totalprice) > 100000 OR min(o_orderkey) < 100)", None),
    "agg_count_null": ("SELECT count(*) AS a, count(x) AS b, sum(x) AS c FROM (VALUES (1), (NULL), (3)) AS v(x)", "SELECT count(*) AS a, count(x) AS b, sum(x)::BIGINT AS c FROM (VALUES (1), (NULL), (3)) AS v(x)"),
    "agg_distinct": ("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n, sum(DISTINCT o_custkey) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n, sum(DISTINCT o_custkey)::BIGINT AS s FROM orders GROUP BY o_orderstatus"),
    "agg_filter": ("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS q FROM lineitem GROUP BY l_returnflag", None),
    "agg_empty_scalar": ("SELECT count(*) AS n, sum(l_quantity) AS s, max(l_orderkey) AS m FROM lineitem WHERE l_quantity < 0", None),
    "agg_empty_group": ("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag", None),
    "agg_min_max_text": ("SELECT c_nationkey, min(c_name) AS a, max(c_mktsegment) AS b FROM customer GROUP BY c_nationkey", None),
    "agg_total": ("SELECT total(x) AS t, total(y) AS u FROM (VALUES (1, NULL), (2, NULL)) AS v(x, y)", "SELECT 3.0::DOUBLE AS t, 0.0::DOUBLE AS u"),
    "agg_string_agg": ("SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_group_concat": ("SELECT group_concat(DISTINCT o_orderstatus) AS one FROM orders WHERE o_orderstatus = 'F'", "SELECT 'F' AS one"),
    "agg_nested_expr": ("SELECT l_linestatus, sum(l_linenumber) + 1 AS a, max(l_quantity) - min(l_quantity) AS b FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, (sum(l_linenumber) + 1)::BIGINT AS a, max(l_quantity) - min(l_quantity) AS b FROM lineitem GROUP BY l_linestatus"),
    "agg_rollup": ("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)", None),
    "agg_cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "agg_grouping_sets": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", None),
    # Sort and limit
    "order_asc": ("SELECT c_custkey FROM customer ORDER BY c_custkey ASC", None),
    "order_desc": ("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey", None),
    "order_multi": ("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_linenumber", None),
    "order_expr": ("SELECT n_name FROM nation ORDER BY length(n_name), n_name", None),
    "order_nulls": ("SELECT k FROM (VALUES (1), (NULL), (3)) AS v(k) ORDER BY k DESC NULLS FIRST", None),
    "limit_n": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 30", None),
    "limit_comma": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 30, 15", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 30"),
    "topk": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10", None),
    "topk_per_group": ("SELECT s, k FROM (SELECT o_orderstatus AS s, o_orderkey AS k, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) t WHERE n <= 3", None),
    # Set operations
    "union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "intersect": ("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'", None),
    "except_": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", None),
    "compound_ordered": ("SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region ORDER BY x LIMIT 12", None),
    "compound_nested": ("(SELECT 1 AS x UNION SELECT 2) EXCEPT (SELECT 2 UNION SELECT 3)", None),
    "intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    # CTEs and subqueries
    "cte_basic": ("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT count(*) AS n FROM big WHERE t > 500000", None),
    "cte_columns": ("WITH c(a, b) AS (SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey) SELECT a, b FROM c", None),
    "cte_chain": ("WITH a AS MATERIALIZED (SELECT c_custkey AS k FROM customer WHERE c_nationkey < 5), b AS NOT MATERIALIZED (SELECT o_orderkey FROM orders JOIN a ON o_custkey = k) SELECT count(*) AS n FROM b", "WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey < 5), b AS (SELECT o_orderkey FROM orders JOIN a ON o_custkey = k) SELECT count(*) AS n FROM b"),
    "cte_recursive": ("WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t", None),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 2 FROM orders)", None),
    "correlated_subquery": ("SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c", None),
    # Windows
    "win_rank_family": ("SELECT n_nationkey, row_number() OVER w AS rn, rank() OVER w AS r, dense_rank() OVER w AS d FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)", None),
    "win_percent": ("SELECT n_nationkey, percent_rank() OVER (ORDER BY n_regionkey) AS p, cume_dist() OVER (ORDER BY n_regionkey) AS c FROM nation", None),
    "win_lag_lead": ("SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, lead(o_orderkey, 2, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders", None),
    "win_first_last_nth": ("SELECT n_nationkey, first_value(n_name) OVER w AS a, last_value(n_name) OVER w AS b, nth_value(n_name, 2) OVER w AS c FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", None),
    "win_ntile": ("SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS q FROM customer", None),
    "win_rows_frame": ("SELECT event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM events", "SELECT event_id, (sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))::BIGINT AS s FROM events"),
    "win_range_frame": ("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM part", None),
    "win_named": ("SELECT s_suppkey, sum(s_suppkey) OVER w AS s, count(*) OVER w AS n FROM supplier WINDOW w AS (PARTITION BY s_nationkey)", "SELECT s_suppkey, (sum(s_suppkey) OVER w)::BIGINT AS s, count(*) OVER w AS n FROM supplier WINDOW w AS (PARTITION BY s_nationkey)"),
    "win_agg_filter": ("SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS n, sum(o_custkey) FILTER (WHERE o_totalprice > 100000) OVER (PARTITION BY o_orderpriority) AS s FROM orders", "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS n, (sum(o_custkey) FILTER (WHERE o_totalprice > 100000) OVER (PARTITION BY o_orderpriority))::BIGINT AS s FROM orders"),
    # Scalar functions
    "fn_abs_sign_round": ("SELECT abs(x) AS a, sign(x) AS s, round(x) AS r, round(x, 1) AS r1, round(1234.5, -2) AS h FROM (VALUES (-2.5e0), (0e0), (3.14e0)) AS v(x)", "SELECT abs(x) AS a, CAST(sign(x) AS BIGINT) AS s, round(x) AS r, round(x, 1) AS r1, 1200.0::DOUBLE AS h FROM (VALUES (-2.5::DOUBLE), (0::DOUBLE), (3.14::DOUBLE)) AS v(x)"),
    "fn_abs_least": ("SELECT abs(-9223372036854775807 - 1) AS a, abs(-5) AS b", "SELECT 9223372036854775807 AS a, 5::BIGINT AS b"),
    "fn_length": ("SELECT length(n_name) AS a, length(n_nationkey) AS b, length(zeroblob(3)) AS c, length(NULL) AS d FROM nation", "SELECT length(n_name) AS a, length(n_nationkey::VARCHAR) AS b, 3 AS c, NULL::INTEGER AS d FROM nation"),
    "fn_typeof": ("SELECT typeof(n_nationkey) AS a, typeof(n_name) AS b, typeof(1.5) AS c, typeof(NULL) AS d, typeof(zeroblob(2)) AS e FROM nation", "SELECT 'integer' AS a, 'text' AS b, 'real' AS c, 'null' AS d, 'blob' AS e FROM nation"),
    "fn_upper_lower": ("SELECT upper(n_name) AS a, lower(n_name) AS b FROM nation", None),
    "fn_coalesce_ifnull": ("SELECT coalesce(NULL, NULL, n_name) AS a, ifnull(NULL, n_nationkey) AS b, nullif(n_regionkey, 1) AS c, iif(n_regionkey > 2, 'hi', 'lo') AS d FROM nation", "SELECT n_name AS a, n_nationkey AS b, nullif(n_regionkey, 1) AS c, CASE WHEN n_regionkey > 2 THEN 'hi' ELSE 'lo' END AS d FROM nation"),
    "fn_scalar_min_max": ("SELECT min(a, b) AS lo, max(a, b) AS hi FROM (VALUES (1, 2), (5, 3), (NULL, 4)) AS v(a, b)", "SELECT CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE least(a, b) END AS lo, greatest(a, b) AS hi FROM (VALUES (1, 2), (5, 3), (NULL, 4)) AS v(a, b)"),
    "fn_substr": ("SELECT substr('hello world', 1, 5) AS a, substr('hello world', 7) AS b, substr('hello world', -5, 3) AS c, substr('hello world', 7, -3) AS d, substr('hello', -10, 2) AS e, substr('hello', 0, 2) AS f", "SELECT 'hello' AS a, 'world' AS b, 'wor' AS c, 'lo ' AS d, 'he' AS e, 'he' AS f"),
    "fn_instr": ("SELECT n_nationkey, instr(n_name, 'A') AS p, instr(n_name, 'zz') AS q FROM nation", None),
    "fn_replace": ("SELECT replace(n_name, 'A', 'aa') AS x FROM nation", None),
    "fn_trim": ("SELECT trim('  x ') AS a, trim('xxhixx', 'x') AS b, ltrim('  y ') AS c, rtrim('zz!!', '!') AS d", None),
    "fn_zeroblob": ("SELECT hex(zeroblob(n_regionkey)) AS h FROM nation", "SELECT repeat('00', n_regionkey) AS h FROM nation"),
    "fn_hex_quote": ("SELECT hex('abc') AS a, quote('it''s') AS b, quote(12) AS c, quote(NULL) AS d, char(72, 105) AS e, unicode('A') AS f", "SELECT '616263' AS a, '''it''''s''' AS b, '12' AS c, 'NULL' AS d, 'Hi' AS e, 65 AS f"),
    "fn_math": ("SELECT ceil(x) AS a, floor(x) AS b, sqrt(x) AS c, pow(x, 2) AS d, trunc(x) AS e FROM (VALUES (2.25e0), (9e0)) AS v(x)", "SELECT ceil(x)::BIGINT AS a, floor(x)::BIGINT AS b, sqrt(x) AS c, pow(x, 2) AS d, trunc(x)::BIGINT AS e FROM (VALUES (2.25::DOUBLE), (9::DOUBLE)) AS v(x)"),
    # Dates
    "dt_date": ("SELECT o_orderkey, date(o_orderdate) AS d FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders"),
    "dt_time": ("SELECT event_id, time(ts) AS t FROM events", "SELECT event_id, strftime(ts, '%H:%M:%S') AS t FROM events"),
    "dt_datetime": ("SELECT event_id, datetime(ts) AS t, datetime(1672531200) AS e FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, '2023-01-01 00:00:00' AS e FROM events"),
    "dt_julianday": ("SELECT o_orderkey, round(julianday(o_orderdate), 4) AS j, julianday('2023-01-01') AS k FROM orders", "SELECT o_orderkey, round(julian(o_orderdate) - 0.5, 4) AS j, 2459945.5::DOUBLE AS k FROM orders"),
    "dt_strftime": ("SELECT event_id, strftime('%Y/%m at %H%%', ts) AS a, strftime('%j', ts) AS b FROM events", "SELECT event_id, strftime(ts, '%Y/%m at %H%%') AS a, strftime(ts, '%j') AS b FROM events"),
    "dt_epoch": ("SELECT event_id, unixepoch(ts) AS s, strftime('%s', ts) AS t FROM events", "SELECT event_id, epoch_us(ts) // 1000000 AS s, (epoch_us(ts) // 1000000)::VARCHAR AS t FROM events"),
    "dt_modifiers": ("SELECT o_orderkey, date(o_orderdate, '+1 month', 'start of month') AS a, date(o_orderdate, '-10 days') AS b FROM orders", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate + INTERVAL 1 MONTH), '%Y-%m-%d') AS a, strftime(o_orderdate - INTERVAL 10 DAY, '%Y-%m-%d') AS b FROM orders"),
    # Division and truth by type
    "int_div_agg": ("SELECT o_custkey, sum(o_orderkey) / 4 AS q, max(o_orderkey) / count(*) AS m, avg(o_totalprice) / 2 AS h FROM orders GROUP BY o_custkey", "SELECT o_custkey, (sum(o_orderkey) // 4)::BIGINT AS q, max(o_orderkey) // count(*) AS m, avg(o_totalprice) / 2 AS h FROM orders GROUP BY o_custkey"),
    "int_div_derived": ("WITH c AS (SELECT c_nationkey AS k, count(*) AS n, avg(c_acctbal) AS c_custkey FROM customer GROUP BY c_nationkey) SELECT k, n / 2 AS half, n / 2.0 AS real_half, 1000 / (n / 3) / 2 AS nested, c_custkey / 2 AS d FROM c WHERE n / 3 > 0", "WITH c AS (SELECT c_nationkey AS k, count(*) AS n, avg(c_acctbal) AS c_custkey FROM customer GROUP BY c_nationkey) SELECT k, n // 2 AS half, n / 2.0::DOUBLE AS real_half, 1000 // (n // 3) // 2 AS nested, c_custkey / 2 AS d FROM c WHERE n // 3 > 0"),
    "filter_truthy": ("SELECT p_partkey FROM part WHERE p_size % 3 AND NOT p_size % 4 OR p_size - 7 AND p_size % 5 = 0", "SELECT p_partkey FROM part WHERE p_size % 3 <> 0 AND NOT p_size % 4 <> 0 OR p_size - 7 <> 0 AND p_size % 5 = 0"),
    "truth_as_value": ("SELECT n_nationkey, CASE WHEN n_regionkey THEN 'some' ELSE 'none' END AS k, n_regionkey > 1 AND n_nationkey % 2 AS b FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey <> 0 THEN 'some' ELSE 'none' END AS k, n_regionkey > 1 AND n_nationkey % 2 <> 0 AS b FROM nation"),
    "having_truthy": ("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING sum(n_nationkey) % 2", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING sum(n_nationkey) % 2 <> 0"),
    "iif_truth": ("SELECT n_nationkey, iif(n_regionkey, 'some', 'none') AS x FROM main.nation WHERE main.nation.n_nationkey <> 3", "SELECT n_nationkey, CASE WHEN n_regionkey <> 0 THEN 'some' ELSE 'none' END AS x FROM nation WHERE n_nationkey <> 3"),
    "match_operator": ("SELECT doc_id FROM documents WHERE text MATCH 'the NOT that* OR \"of the\"'", f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS} AS p FROM documents) WHERE contains(p, ' the ') AND NOT contains(p, ' that') OR contains(p, ' of the ')"),
    "in_table": ("WITH wanted AS (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') SELECT n_name FROM nation WHERE n_regionkey IN wanted", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name ILIKE 'A%')"),
    "limit_negative": ("SELECT r_name FROM region ORDER BY r_name LIMIT -1", "SELECT r_name FROM region ORDER BY r_name"),
    "win_groups_sql": ("SELECT p_partkey, count(*) OVER w AS n, sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size DESC GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)", "SELECT p_partkey, count(*) OVER w AS n, (sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size DESC GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT AS s FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"),
    "win_exclude_sql": ("SELECT p_partkey, " + ", ".join(f"{a}(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {h}) AS {a}_{h.lower().replace(' ', '_')}" for a in ("sum", "count") for h in ("NO OTHERS", "CURRENT ROW", "GROUP", "TIES")) + " FROM part", "SELECT p_partkey, " + ", ".join(f"({a}(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {h}))::BIGINT AS {a}_{h.lower().replace(' ', '_')}" for a in ("sum", "count") for h in ("NO OTHERS", "CURRENT ROW", "GROUP", "TIES")) + " FROM part"),
    "unary_plus": ("SELECT n_nationkey, + n_regionkey AS a, - + n_regionkey AS b FROM nation", None),
    "order_default_nulls": ("SELECT k, x FROM (VALUES (1, 5), (2, NULL), (3, 1)) AS v(k, x) ORDER BY x, k", "SELECT k, x FROM (VALUES (1, 5), (2, NULL), (3, 1)) AS v(k, x) ORDER BY x NULLS FIRST, k"),
    "approx_aggregates": ("SELECT n_regionkey, approx_count_distinct(n_nationkey) AS n, percentile(n_nationkey, 0.5) AS m FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, count(DISTINCT n_nationkey) AS n, quantile_cont(n_nationkey, 0.5)::DOUBLE AS m FROM nation GROUP BY n_regionkey"),
    "array_functions": ("SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names, element_at(array_sort(collect_list(n_nationkey)), -1) AS top FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, max(n_nationkey) AS top FROM nation GROUP BY n_regionkey"),
    "fn_char_printf": ("SELECT n_nationkey, char(n_nationkey + 65, n_nationkey + 8364, n_nationkey + 128512) AS c, printf('%05d|%.2f|%s|%x', n_nationkey, n_regionkey / 4.0, n_name, n_nationkey * 100) AS f FROM nation", "SELECT n_nationkey, chr(n_nationkey + 65) || chr(n_nationkey + 8364) || chr(n_nationkey + 128512) AS c, printf('%05d|%.2f|%s|%x', n_nationkey, n_regionkey / 4.0, n_name, n_nationkey * 100) AS f FROM nation"),
    # JSON
    "json_changes": ("SELECT event_id, json_set(props, '$.k', 0, '$.id', event_id) AS s, json_insert(props, '$.k', 0, '$.t', event_type) AS i, json_replace(props, '$.k', 7, '$.z', 1) AS r, json_remove(props, '$.k') AS d, json_patch(props, '{\"k\":null,\"p\":1}') AS p FROM events", "SELECT event_id, '{\"k\":0,\"id\":' || event_id || '}' AS s, '{\"k\":' || (props ->> '$.k') || ',\"t\":\"' || event_type || '\"}' AS i, '{\"k\":7}' AS r, '{}' AS d, '{\"p\":1}' AS p FROM events"),
    "json_each_rows": ("SELECT event_id, j.key, CAST(j.value AS INTEGER) AS v, j.type FROM events, json_each(props) AS j", "SELECT event_id, 'k' AS key, (props ->> '$.k')::BIGINT AS v, 'integer' AS type FROM events"),
    "json_group_object": ("SELECT n_regionkey, json_array_length(json_group_array(n_name)) AS n, json_extract(json_group_object(n_nationkey, n_name), '$.\"7\"') AS seven FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, count(*)::INTEGER AS n, max(CASE WHEN n_nationkey = 7 THEN n_name END) AS seven FROM nation GROUP BY n_regionkey"),
    "json_valid": ("SELECT json_valid('{\"a\": 1}') AS a, json_valid('{bad json') AS b, json_valid(NULL) AS c, count(*) AS n FROM events WHERE json_valid(props) = 1", "SELECT 1 AS a, 0 AS b, NULL::INTEGER AS c, count(*) AS n FROM events WHERE json_valid(props)"),
    "json_extract": ("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "json_extract_array": ("SELECT json_extract('{\"a\":{\"b\":42},\"c\":[10,20]}', '$.a.b') AS a, json_extract('{\"c\":[10,20]}', '$.c.1') AS b, json_extract('{\"t\":true}', '$.t') AS c, '{\"c\":[1,{\"d\":\"x\"}]}' ->> '$.c[1].d' AS d, '{\"c\":[1,2]}' -> '$.c' AS e", "SELECT '42' AS a, '20' AS b, '1' AS c, 'x' AS d, '[1,2]' AS e"),
    "json_object": ("SELECT n_nationkey, json_object('name', n_name, 'region', n_regionkey, 'none', NULL) AS j FROM nation", "SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"none\":null,\"region\":' || n_regionkey || '}' AS j FROM nation"),
    "json_array": ("SELECT json_array(1, 'hello', NULL) AS a, json_array_length('[1,2,3]') AS n", "SELECT '[1,\"hello\",null]' AS a, 3 AS n"),
}


def engine(spark: SparkSession, sf_dir: str, used: set[str] | None = None) -> Engine:
    return Engine(spark).open_folder(sf_dir, [t for t in TABLES if used is None or t in used])


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir, names_used(single(text))).query(text)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def win_groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return groups_frame(rows, ["p_brand"], [F.col("p_size").asc_nulls_first()], -1, 1, {"n": F.count("*"), "s": F.sum("p_partkey")}).select("p_partkey", "n", "s")


def win_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("long").alias("p_size"))
    w = Window.partitionBy("p_brand").orderBy("p_size")
    frame, peers = w.rangeBetween(Window.unboundedPreceding, Window.currentRow), w.rangeBetween(0, 0)
    return rows.select("p_partkey", *[excluded("p_partkey", frame, peers, how).alias(how.replace(" ", "_")) for how in ("no others", "current row", "group", "ties")])


def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), "event_id")
    clicks = e.where("event_type = 'click'").groupBy("user_id", F.col("ts").alias("seen")).agg(F.max("event_id").alias("click_id"))
    return asof_join(buys, clicks, ["user_id"], "at", "seen", ["click_id"]).select("event_id", "user_id", "click_id")


def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.sql("SELECT cast(id * 1000 AS double) AS low, cast(id * 1000 + 1500 AS double) AS high, id AS band FROM range(0, 1000)")
    points = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return range_join(points, bands, "o_totalprice", "low", "high", 1000.0).select("o_orderkey", "band")


def fts_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(fts.ascii_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def fts_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fts.Index.build(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return index.match(["the", "and", "que"]).select(F.col("doc").alias("doc_id"), F.round("score", 5).alias("score"))


def fts_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fts.Index.build(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return index.match(["the", "that"], every=True).select(F.col("doc").alias("doc_id"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("p_size").cast("double"), (F.col("p_partkey") % 50).cast("double")
    return _t(spark, sf_dir, "part").select("p_partkey", spatial.box((x, x + 3), (y, y + F.col("p_partkey") % 7 - 1)).alias("b"))


def spatial_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("p_partkey", spatial.volume(F.col("b")).alias("v"))


def spatial_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).where(spatial.contains(spatial.box((10, 30), (5, 40)), F.col("b"))).select("p_partkey")


def spatial_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All boxes with all boxes."""
    a = _boxes(spark, sf_dir).select(F.col("p_partkey").alias("a"), F.col("b").alias("x"))
    b = _boxes(spark, sf_dir).select(F.col("p_partkey").alias("b"), F.col("b").alias("y"))
    full = lambda c: F.col(c)[1]["hi"] >= F.col(c)[1]["lo"]
    return spatial.overlap_join(a.where(full("x")), b.where(full("y")), "x", "y", (5.0, 5.0), sides=2, keep=(["a"], ["b"]))


def changeset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    new = old.where("s_suppkey % 10 <> 0").withColumn("s_nationkey", F.when(F.col("s_suppkey") % 7 == 0, F.lit(99)).otherwise(F.col("s_nationkey")))
    return changes.diff(old, new, ["s_suppkey"]).select("op", "s_suppkey", "old_s_nationkey", "new_s_nationkey")


def _after(*statements: str, table: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, {table})
        for s in statements:
            e.execute(s)
        return e.query(f"SELECT * FROM {table}")

    return run


def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    new = old.where("s_suppkey % 4 = 0").select((F.col("s_suppkey") + 2).alias("s_suppkey"), (F.col("s_nationkey") + 100).alias("s_nationkey"))
    return upserted(old, new, ["s_suppkey"])


def dml_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, {"region"})
    e.script("BEGIN; DELETE FROM region WHERE r_regionkey < 2; SAVEPOINT a; UPDATE region SET r_name = 'x'; ROLLBACK TO a; COMMIT")
    return e.query("SELECT * FROM region")


def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user function of whole columns, called from the dialect."""
    udf.vectorised(spark, "twice_and", lambda text, more: text.str.len() * 2 + more, "long")
    return engine(spark, sf_dir, {"nation"}).query("SELECT n_nationkey, twice_and(n_name, n_regionkey) AS x FROM nation")


class _Spread:
    """An aggregate's state: the greatest less the least value."""

    def __init__(self) -> None:
        self.seen: list[int] = []

    def step(self, value: int | None) -> None:
        if value is not None:
            self.seen = [min([value, *self.seen]), max([value, *self.seen])]

    def finalize(self) -> int | None:
        return int(self.seen[-1] - self.seen[0]) if self.seen else None


def udf_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    udf.aggregate(spark, "spread_of", _Spread, "long")
    return engine(spark, sf_dir, {"nation"}).query("SELECT n_regionkey, spread_of(n_nationkey) AS spread FROM nation GROUP BY n_regionkey")


def udf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    udf.table_function(spark, "count_to", lambda n: ((i,) for i in range(n + 1)), "i long")
    return engine(spark, sf_dir, {"nation"}).query("SELECT n_nationkey, i FROM nation, LATERAL count_to(n_regionkey)")


def _tables(used: set[str], *statements: str, then: str, args: list | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """A query after some statements, over tables of the folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, used)
        for text in statements:
            e.script(text)
        return e.query(then, args)

    return run


def dml_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, {"supplier"})
    e.execute("UPDATE supplier SET s_acctbal = s_acctbal * 2 WHERE s_nationkey = 3 RETURNING s_suppkey, s_acctbal AS doubled")
    return e.returned


def change_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, {"nation"})
    told = e.capture("nation", ["n_nationkey"])
    e.script("DELETE FROM nation WHERE n_regionkey = 2; UPDATE nation SET n_name = lower(n_name) WHERE n_regionkey = 1; INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (99, 'NEW', 0)")
    return told().select("op", "n_nationkey", "old_n_name", "new_n_name")


#: Name: (plan, the other engine's SQL).
PLANS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "win_groups_frame": (win_groups_frame, "SELECT p_partkey, count(*) OVER w AS n, (sum(p_partkey) OVER w)::BIGINT AS s FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size NULLS FIRST GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"),
    "win_exclude": (win_exclude, "SELECT p_partkey, " + ", ".join(f"(sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {h}))::BIGINT AS {h.lower().replace(' ', '_')}" for h in ("NO OTHERS", "CURRENT ROW", "GROUP", "TIES")) + " FROM part"),
    "join_asof": (join_asof, "WITH c AS (SELECT user_id, ts AS seen, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT b.event_id, b.user_id, c.click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') b ASOF LEFT JOIN c ON b.user_id = c.user_id AND b.ts >= c.seen"),
    "join_range": (join_range, "SELECT o_orderkey, band FROM orders JOIN (SELECT i * 1000.0::DOUBLE AS low, i * 1000.0::DOUBLE + 1500 AS high, i AS band FROM range(1000) t(i)) ON o_totalprice >= low AND o_totalprice < high"),
    "fts_tokenize": (fts_tokenize, "SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x : lower(x))) AS token FROM documents) GROUP BY token"),
    "fts_bm25": (fts_bm25, "WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x : lower(x)) AS ts FROM documents), s AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM d), p AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d), h AS (SELECT doc_id, dl, term, count(*) AS tf FROM p WHERE term IN ('the', 'and', 'que') GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM h GROUP BY term) SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 5) AS score FROM h JOIN f USING (term), s GROUP BY doc_id"),
    "fts_match_all": (fts_match_all, "SELECT doc_id FROM documents WHERE list_contains(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x : lower(x)), 'the') AND list_contains(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x : lower(x)), 'that')"),
    "spatial_volume": (spatial_volume, "SELECT p_partkey, 3.0::DOUBLE * greatest(p_partkey % 7 - 1, 0) AS v FROM part"),
    "spatial_contains": (spatial_contains, "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size + 3 <= 30 AND p_partkey % 50 >= 5 AND p_partkey % 50 + p_partkey % 7 - 1 <= 40"),
    "spatial_overlap_join": (spatial_overlap_join, "WITH t AS (SELECT p_partkey AS k, p_size AS x, p_partkey % 50 AS y, p_partkey % 50 + p_partkey % 7 - 1 AS z FROM part WHERE p_partkey % 7 >= 1) SELECT a.k AS a, b.k AS b FROM t a JOIN t b ON a.x <= b.x + 3 AND b.x <= a.x + 3 AND a.y <= b.z AND b.y <= a.z"),
    "changeset_diff": (changeset_diff, "SELECT CASE WHEN s_suppkey % 10 = 0 THEN 'delete' ELSE 'update' END AS op, s_suppkey, s_nationkey AS old_s_nationkey, CASE WHEN s_suppkey % 10 <> 0 THEN 99 END AS new_s_nationkey FROM supplier WHERE s_suppkey % 10 = 0 OR s_suppkey % 7 = 0"),
    "dml_update": (_after("UPDATE supplier SET s_acctbal = 0, s_name = s_name || '!' WHERE s_nationkey < 5", table="supplier"), "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN s_name || '!' ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_nationkey < 5 THEN 0.0::DOUBLE ELSE s_acctbal END AS s_acctbal FROM supplier"),
    "dml_delete": (_after("DELETE FROM orders WHERE o_orderstatus = 'F' OR o_custkey < 100", table="orders"), "SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' OR o_custkey < 100)"),
    "dml_insert_select": (_after("INSERT INTO region (r_name, r_regionkey) SELECT n_name, n_nationkey + 100 FROM region r, (VALUES ('X', 1), ('Y', 2)) AS v(n_name, n_nationkey) WHERE r.r_regionkey = 0", table="region"), "SELECT * FROM region UNION ALL SELECT * FROM (VALUES (101, 'X'), (102, 'Y')) v"),
    "dml_rollback": (dml_rollback, "SELECT * FROM region WHERE r_regionkey >= 2"),
    "dml_delete_subquery": (_tables({"orders", "customer"}, "DELETE FROM customer WHERE c_nationkey < 20; DELETE FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) OR o_totalprice > (SELECT avg(c_acctbal) * 50 FROM customer)", then="SELECT o_orderkey FROM orders"), "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey >= 20) AND NOT o_totalprice > (SELECT avg(c_acctbal) * 50 FROM customer WHERE c_nationkey >= 20)"),
    "dml_update_cte": (_tables({"customer", "orders"}, "WITH busy AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10) UPDATE customer AS c SET c_mktsegment = 'BUSY', c_acctbal = (SELECT max(n) FROM busy) WHERE c.c_custkey IN (SELECT k FROM busy)", then="SELECT c_custkey, c_mktsegment, c_acctbal FROM customer"), "WITH busy AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10) SELECT c_custkey, CASE WHEN c_custkey IN (SELECT k FROM busy) THEN 'BUSY' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey IN (SELECT k FROM busy) THEN (SELECT max(n) FROM busy)::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer"),
    "dml_update_from": (_tables({"supplier", "nation", "region"}, "UPDATE supplier SET s_name = r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE s_nationkey = n_nationkey AND r_name <> 'ASIA'", then="SELECT s_suppkey, s_name FROM supplier"), "SELECT s_suppkey, CASE WHEN r_name <> 'ASIA' THEN r_name || '/' || n_name ELSE s_name END AS s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "dml_rollback_drop": (_tables({"nation"}, "CREATE TABLE n2 AS SELECT n_nationkey AS k FROM nation; BEGIN; DROP TABLE n2; CREATE TABLE n2 (k INT); INSERT INTO n2 VALUES (1000); ROLLBACK", then="SELECT k FROM n2"), "SELECT n_nationkey AS k FROM nation"),
    "insert_or_replace": (_tables({"supplier"}, "CREATE TABLE s (k INTEGER PRIMARY KEY, n TEXT); INSERT INTO s SELECT s_suppkey, s_name FROM supplier; INSERT OR REPLACE INTO s SELECT s_suppkey + 3, 'new ' || s_suppkey FROM supplier", then="SELECT k, n FROM s"), "SELECT s_suppkey AS k, s_name AS n FROM supplier WHERE s_suppkey - 3 NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey + 3, 'new ' || s_suppkey FROM supplier"),
    "insert_or_ignore": (_tables({"supplier"}, "CREATE TABLE s (k INT UNIQUE, n TEXT); INSERT INTO s SELECT s_suppkey, s_name FROM supplier; INSERT OR IGNORE INTO s SELECT s_suppkey + 3, 'new' FROM supplier", then="SELECT k, n FROM s"), "SELECT s_suppkey AS k, s_name AS n FROM supplier UNION ALL SELECT s_suppkey + 3, 'new' FROM supplier WHERE s_suppkey + 3 NOT IN (SELECT s_suppkey FROM supplier)"),
    "upsert_on_conflict": (_tables({"supplier"}, "CREATE TABLE s (k INT UNIQUE, n INT); INSERT INTO s SELECT s_suppkey, s_nationkey FROM supplier; INSERT INTO s SELECT s_suppkey + 3, 100 FROM supplier ON CONFLICT (k) DO UPDATE SET n = s.n + excluded.n WHERE s.n > 5", then="SELECT k, n FROM s"), "SELECT a.s_suppkey AS k, CASE WHEN b.s_suppkey IS NOT NULL AND a.s_nationkey > 5 THEN a.s_nationkey + 100 ELSE a.s_nationkey END::BIGINT AS n FROM supplier a LEFT JOIN supplier b ON b.s_suppkey + 3 = a.s_suppkey UNION ALL SELECT s_suppkey + 3, 100 FROM supplier WHERE s_suppkey + 3 NOT IN (SELECT s_suppkey FROM supplier)"),
    "row_ids": (_tables({"region"}, "CREATE TABLE r (id INTEGER PRIMARY KEY, n TEXT); INSERT INTO r VALUES (40, 'first'); INSERT INTO r (n) SELECT r_name FROM region ORDER BY r_name", then="SELECT rowid AS id, n FROM r"), "SELECT 40 + row_number() OVER (ORDER BY r_name) AS id, r_name AS n FROM region UNION ALL SELECT 40, 'first'"),
    "ddl_alter": (_tables({"region"}, "CREATE TABLE r AS SELECT r_regionkey AS k, r_name AS n FROM region; ALTER TABLE r ADD COLUMN extra INT DEFAULT 7; ALTER TABLE r RENAME COLUMN n TO name; ALTER TABLE r RENAME TO r2; INSERT INTO r2 (k, name) VALUES (9, 'X')", then="SELECT k, name, extra FROM r2"), "SELECT r_regionkey AS k, r_name AS name, 7::BIGINT AS extra FROM region UNION ALL SELECT 9, 'X', 7"),
    "virtual_table_texts": (_tables({"documents"}, "CREATE VIRTUAL TABLE d USING fts5(source, text); INSERT INTO d SELECT source, text FROM documents", then="SELECT source, count(*) AS n FROM d WHERE d MATCH 'text: (the OR que) AND a*' GROUP BY source"), f"SELECT source, count(*) AS n FROM (SELECT source, {_TOKENS} AS p FROM documents) WHERE (contains(p, ' the ') OR contains(p, ' que ')) AND contains(p, ' a') GROUP BY source"),
    "virtual_table_boxes": (_tables({"part"}, "CREATE VIRTUAL TABLE b USING rtree(id, x0, x1); INSERT INTO b SELECT p_partkey, p_size, p_size + 3 FROM part", then="SELECT id FROM b WHERE x1 >= 20 AND x0 <= 22"), "SELECT p_partkey AS id FROM part WHERE p_size + 3 >= 20 AND p_size <= 22"),
    "generated_columns": (_tables({"supplier"}, "CREATE TABLE s (k INTEGER PRIMARY KEY, n INT REFERENCES nation(n_nationkey) ON DELETE CASCADE, twice INT GENERATED ALWAYS AS (n * 2) STORED, tag TEXT AS (k || '/' || n)); INSERT INTO s SELECT s_suppkey, s_nationkey FROM supplier; UPDATE s SET n = n + 100 WHERE k % 3 = 0", then="SELECT k, n, twice, tag FROM s"), "SELECT k, n, n * 2 AS twice, k || '/' || n AS tag FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey + 100 ELSE s_nationkey END AS n FROM supplier)"),
    "ddl_view": (_tables({"nation", "region"}, "CREATE VIEW asia AS SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'; CREATE VIEW asia2 AS SELECT upper(n_name) AS u FROM asia", then="SELECT u FROM asia2"), "SELECT upper(n_name) AS u FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "dml_returning": (dml_returning, "SELECT s_suppkey, s_acctbal * 2 AS doubled FROM supplier WHERE s_nationkey = 3"),
    "params_numbered": (_tables({"orders"}, then="SELECT o_orderkey, ?2 AS tag FROM orders WHERE o_orderstatus = ?1 AND o_custkey < ?3", args=["F", "late", 300]), "SELECT o_orderkey, 'late' AS tag FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 300"),
    "change_capture": (change_capture, "SELECT CASE WHEN n_regionkey = 2 THEN 'delete' ELSE 'update' END AS op, n_nationkey, n_name AS old_n_name, CASE WHEN n_regionkey = 1 THEN lower(n_name) END AS new_n_name FROM nation WHERE n_regionkey IN (1, 2) UNION ALL SELECT 'insert', 99, NULL, 'NEW'"),
    "upsert_replace": (upsert_replace, "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey + 2 FROM supplier WHERE s_suppkey % 4 = 0) UNION ALL SELECT s_suppkey + 2, s_nationkey + 100 FROM supplier WHERE s_suppkey % 4 = 0"),
    "udf_scalar": (udf_scalar, "SELECT n_nationkey, length(n_name) * 2 + n_regionkey AS x FROM nation"),
    "udf_aggregate": (udf_aggregate, "SELECT n_regionkey, max(n_nationkey) - min(n_nationkey) AS spread FROM nation GROUP BY n_regionkey"),
    "udf_table": (udf_table, "SELECT n_nationkey, unnest(generate_series(0, n_regionkey)) AS i FROM nation"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _sql(text) for n, (text, _) in SQL.items()} | {n: plan for n, (plan, _) in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: other or text for n, (text, other) in SQL.items()} | {n: other for n, (_, other) in PLANS.items()}
