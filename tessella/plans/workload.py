"""The workload: queries in the dialects, each with the same question in DuckDB's SQL.

Keys are query names; values are (dialect, text, SQL for DuckDB or None if the text means the same there).
"""

from __future__ import annotations

Q: dict[str, tuple[str, str, str | None]] = {}


def q(name: str, dialect: str, text: str, duck: str | None = None) -> None:
    Q[name] = (dialect, text, duck)


# projection and predicates
q("proj_alias", "pg", "SELECT n.n_name AS nation, n_nationkey + 1 AS k, n_regionkey FROM nation n")
q("proj_star", "oracle", "SELECT r.* FROM region r")
q("select_distinct", "mysql", "SELECT DISTINCTROW o_orderstatus, o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
NP = "nullif(o_orderpriority, '5-LOW')"
q("filter_3vl", "pg", f"SELECT o_orderkey FROM orders WHERE NOT ({NP} = '1-URGENT') OR o_totalprice > 400000")
q("null_safe_eq", "mysql", f"SELECT o_orderkey, {NP} <=> NULL AS is_low, {NP} <=> '1-URGENT' AS is_urgent FROM orders",
  f"SELECT o_orderkey, CAST({NP} IS NOT DISTINCT FROM NULL AS INT) AS is_low, CAST({NP} IS NOT DISTINCT FROM '1-URGENT' AS INT) AS is_urgent FROM orders")
q("is_distinct", "pg", f"SELECT o_orderkey FROM orders WHERE {NP} IS DISTINCT FROM '2-HIGH'")
q("is_predicates", "pg", "SELECT o_orderkey, (o_totalprice > 1000) IS TRUE AS a, (nullif(o_orderstatus, 'O') = 'F') IS UNKNOWN AS b, nullif(o_orderstatus, 'F') ISNULL AS c, nullif(o_orderstatus, 'F') NOTNULL AS d FROM orders",
  "SELECT o_orderkey, o_totalprice > 1000 AS a, (nullif(o_orderstatus, 'O') = 'F') IS NULL AS b, nullif(o_orderstatus, 'F') IS NULL AS c, nullif(o_orderstatus, 'F') IS NOT NULL AS d FROM orders")
q("in_list", "pg", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
q("in_subquery", "oracle", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
q("not_in_null", "pg", f"SELECT count(*) AS n FROM orders WHERE o_orderpriority NOT IN (SELECT {NP} FROM orders)")
q("exists_corr", "pg", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)")
q("quantified_all", "pg", "SELECT p_partkey FROM part WHERE p_size >= ALL (SELECT p_size FROM part WHERE p_brand = 'Brand#11') AND p_retailprice > ANY (SELECT p_retailprice FROM part WHERE p_size = 3)")
q("quantified_array", "pg", "SELECT p_partkey, p_size = ANY (ARRAY[1, 2, 3]) AS small FROM part", "SELECT p_partkey, p_size IN (1, 2, 3) AS small FROM part")
q("like_escape", "pg", r"SELECT p_partkey FROM part WHERE p_name LIKE '%1%' AND p_name NOT LIKE '%!_2%' ESCAPE '!'")
q("ilike", "pg", "SELECT p_partkey FROM part WHERE p_type ILIKE '%BRASS%' OR p_type ILIKE '%s'")
q("similar_to", "pg", "SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#(1|2)[1-3]'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#(1|2)[1-3]')")
q("regexp_match_op", "pg", "SELECT p_partkey FROM part WHERE p_brand ~ '[13]$' AND p_type !~* '^STANDARD'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '[13]$') AND NOT regexp_matches(p_type, '^STANDARD', 'i')")
q("rlike_mysql", "mysql", "SELECT p_partkey FROM part WHERE p_brand RLIKE '#[2-3]' AND p_name NOT REGEXP '9$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[2-3]') AND NOT regexp_matches(p_name, '9$')")
q("between_symmetric", "pg", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity BETWEEN SYMMETRIC 10 AND 5", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity BETWEEN 5 AND 10")
q("row_compare", "pg", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) < (50, 3) AND (l_returnflag, l_linestatus) = ('R', 'F')")
q("row_in", "mysql", "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) IN (('F', '1-URGENT'), ('O', '5-LOW'))")
q("case_simple", "oracle", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s FROM orders")
q("case_searched", "mysql", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 3 WHEN o_totalprice > 100000 THEN 2 END AS s, IF(o_custkey > 700, 'new', 'old') AS era FROM orders",
  "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 3 WHEN o_totalprice > 100000 THEN 2 END AS s, CASE WHEN o_custkey > 700 THEN 'new' ELSE 'old' END AS era FROM orders")
q("cast_lenient", "mysql", "SELECT o_orderkey, CAST(o_orderpriority AS SIGNED) AS p, o_orderpriority + 1 AS p1 FROM orders",
  "SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS p, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) + 1 AS p1 FROM orders")
q("scalar_subquery", "pg", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
q("xor_mysql", "mysql", "SELECT count(*) AS n FROM orders WHERE (o_orderstatus = 'F') XOR (o_totalprice > 200000)", "SELECT count(*) AS n FROM orders WHERE (o_orderstatus = 'F') <> (o_totalprice > 200000)")
q("unique_subquery", "oracle", "SELECT n_nationkey FROM nation WHERE UNIQUE (SELECT c_mktsegment FROM customer WHERE c_custkey < 3)", "SELECT n_nationkey FROM nation WHERE (SELECT count(*) = count(DISTINCT c_mktsegment) FROM customer WHERE c_custkey < 3)")
q("sounds_like", "mysql", "SELECT n_nationkey FROM nation WHERE n_name SOUNDS LIKE n_name", "SELECT n_nationkey FROM nation")
q("overlaps_pred", "pg", "SELECT o_orderkey FROM orders WHERE (o_orderdate, o_orderdate + INTERVAL '30 days') OVERLAPS (TIMESTAMP '1995-01-01 00:00:00', TIMESTAMP '1995-03-01 00:00:00')",
  "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-01-01' < o_orderdate + INTERVAL 30 DAY")
q("distinct_on", "pg", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")

# sources
q("join_inner", "pg", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
q("join_left", "mysql", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000 GROUP BY c_custkey")
q("join_right", "pg", "SELECT o_orderkey, s_name FROM supplier RIGHT OUTER JOIN orders ON s_suppkey = o_orderkey")
q("join_full", "pg", "SELECT c_custkey, s_suppkey FROM customer c FULL JOIN supplier s ON c_custkey = s_suppkey")
q("join_cross", "pg", "SELECT r_name, n_name FROM region CROSS JOIN nation")
q("join_natural", "oracle", "SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)", "SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b")
q("join_using", "pg", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)")
q("join_theta", "pg", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
q("join_comma", "oracle", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
q("join_straight", "mysql", "SELECT n_name, r_name FROM nation STRAIGHT_JOIN region ON n_regionkey = r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
q("join_self", "pg", "SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey + 25 = b.c_custkey")
q("outer_join_sign", "oracle", "SELECT c.c_custkey, o.o_orderkey FROM customer c, orders o WHERE c.c_custkey = o.o_custkey(+) AND o.o_totalprice(+) > 300000",
  "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000")
q("lateral_topn", "pg", "SELECT c.c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) t")
q("cross_apply", "oracle", "SELECT c.c_custkey, t.s FROM customer c CROSS APPLY (SELECT sum(o.o_totalprice) AS s FROM orders o WHERE o.o_custkey = c.c_custkey HAVING count(*) > 5) t",
  "SELECT o_custkey AS c_custkey, sum(o_totalprice) AS s FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey HAVING count(*) > 5")
q("outer_apply", "oracle", "SELECT c.c_custkey, t.m FROM customer c OUTER APPLY (SELECT max(o.o_orderkey) AS m FROM orders o WHERE o.o_custkey = c.c_custkey) t",
  "SELECT c_custkey, max(o_orderkey) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
q("partitioned_outer_join", "oracle", "SELECT s.c_nationkey, r.c_mktsegment AS seg, s.n FROM (SELECT c_nationkey, c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_acctbal > 8000 GROUP BY c_nationkey, c_mktsegment) s PARTITION BY (c_nationkey) RIGHT JOIN (SELECT DISTINCT c_mktsegment FROM customer) r ON s.seg = r.c_mktsegment",
  "WITH s AS (SELECT c_nationkey, c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_acctbal > 8000 GROUP BY 1, 2) SELECT s.c_nationkey, r.c_mktsegment AS seg, s.n FROM (SELECT DISTINCT c_nationkey FROM s) p CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) r LEFT JOIN s ON s.c_nationkey = p.c_nationkey AND s.seg = r.c_mktsegment")
q("values_rel", "pg", "SELECT v.a, v.b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v (a, b)")
q("table_stmt", "mysql", "TABLE region", "FROM region")
q("posexplode_ordinality", "pg", "SELECT p_partkey, t.w, t.n FROM part, unnest(string_to_array(p_type, ' ')) WITH ORDINALITY AS t (w, n)",
  "SELECT p_partkey, w[i] AS w, i AS n FROM (SELECT p_partkey, string_split(p_type, ' ') AS w, unnest(range(1, len(string_split(p_type, ' ')) + 1)) AS i FROM part)")
q("generate_series_rel", "pg", "SELECT r_regionkey, g.x FROM region, generate_series(1, 4) AS g (x)", "SELECT r_regionkey, CAST(x AS INT) AS x FROM region, range(1, 5) g(x)")
q("json_table_props", "mysql", "SELECT e.event_id, j.k FROM events e, JSON_TABLE(e.props, '$' COLUMNS (k INT PATH '$.k')) AS j", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
q("json_table_nested", "oracle", """SELECT j.ord, j.a, j.b FROM region r, JSON_TABLE('[{"a":1,"b":[7,8]},{"a":2,"b":[]}]', '$[*]' COLUMNS (ord FOR ORDINALITY, a NUMBER(5) PATH '$.a', NESTED PATH '$.b[*]' COLUMNS (b NUMBER(5) PATH '$'))) j WHERE r_regionkey = 1""",
  "SELECT ord, CAST(a AS DECIMAL(5, 0)) AS a, CAST(b AS DECIMAL(5, 0)) AS b FROM (VALUES (1, 1, 7), (1, 1, 8), (2, 2, NULL)) v(ord, a, b)")
q("pivot_status", "oracle", "SELECT * FROM (SELECT o_custkey, o_orderstatus, o_totalprice FROM orders) PIVOT (count(o_totalprice) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
  "SELECT o_custkey, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY o_custkey")
q("unpivot_prices", "oracle", "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_tax FROM lineitem) UNPIVOT (val FOR what IN (l_discount AS 'discount', l_tax AS 'tax'))",
  "SELECT l_orderkey, l_linenumber, l_partkey, 'discount' AS what, l_discount AS val FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'tax', l_tax FROM lineitem")
q("dual_table", "oracle", "SELECT 1 AS one, 'a' || NULL || 'b' AS ab FROM dual", "SELECT 1 AS one, 'ab' AS ab")
TREE = "SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey DIV 3 END AS parent, p_brand FROM part"
TREE_D = "SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS parent, p_brand FROM part"
q("connect_by", "oracle", "SELECT id, LEVEL AS lvl, CONNECT_BY_ROOT id AS root, SYS_CONNECT_BY_PATH(id, '/') AS path, PRIOR id AS up, CONNECT_BY_ISLEAF AS leaf FROM (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN floor(p_partkey / 3) END AS parent FROM part) START WITH parent IS NULL CONNECT BY PRIOR id = parent",
  f"WITH RECURSIVE t AS ({TREE_D}), h AS (SELECT id, 1 AS lvl, id AS root, '/' || id AS path, CAST(NULL AS BIGINT) AS up FROM t WHERE parent IS NULL UNION ALL SELECT t.id, lvl + 1, root, path || '/' || t.id, h.id FROM t JOIN h ON t.parent = h.id) SELECT *, CAST(NOT EXISTS (SELECT 1 FROM t WHERE t.parent = h.id) AS INT) AS leaf FROM h")
q("connect_by_nocycle", "oracle", "SELECT n_nationkey, LEVEL AS lvl FROM nation START WITH n_nationkey = 0 CONNECT BY NOCYCLE PRIOR n_nationkey = mod(n_nationkey + 24, 25) AND LEVEL <= 30",
  "SELECT CAST(n_nationkey AS INT) AS n_nationkey, CAST(n_nationkey + 1 AS INT) AS lvl FROM nation")
q("siblings_order", "oracle", "SELECT id, LEVEL AS lvl FROM (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN floor(p_partkey / 3) END AS parent FROM part) START WITH id = 1 CONNECT BY PRIOR id = parent ORDER SIBLINGS BY id",
  "WITH RECURSIVE t AS (SELECT p_partkey AS id, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0), h AS (SELECT id, 1 AS lvl FROM t WHERE id = 1 UNION ALL SELECT t.id, lvl + 1 FROM t JOIN h ON t.parent = h.id) SELECT * FROM h")

# CTEs and set operations
q("cte_plain", "pg", "WITH big AS MATERIALIZED (SELECT * FROM orders WHERE o_totalprice > 300000), c (k, n) AS (SELECT o_custkey, count(*) FROM big GROUP BY o_custkey) SELECT k, n FROM c WHERE n > 1")
q("cte_recursive", "pg", "WITH RECURSIVE s (n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM s WHERE n < 20) SELECT n, f FROM s")
q("cte_tree", "mysql", f"WITH RECURSIVE t AS ({TREE}), h (id, lvl) AS (SELECT id, 1 FROM t WHERE parent IS NULL UNION ALL SELECT t.id, lvl + 1 FROM t JOIN h ON t.parent = h.id) SELECT lvl, count(*) AS n FROM h GROUP BY lvl",
  f"WITH RECURSIVE t AS ({TREE_D}), h AS (SELECT id, 1 AS lvl FROM t WHERE parent IS NULL UNION ALL SELECT t.id, lvl + 1 FROM t JOIN h ON t.parent = h.id) SELECT lvl, count(*) AS n FROM h GROUP BY lvl")
q("cte_cycle", "pg", "WITH RECURSIVE g (a) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 3 UNION ALL SELECT mod(a + 7, 25) FROM g) CYCLE a SET is_cycle USING path SELECT a, is_cycle FROM g",
  "SELECT CAST((3 + 7 * i) % 25 AS INT) AS a, i = 25 AS is_cycle FROM range(26) t(i)")
for name, op in (("union_distinct", "UNION"), ("union_all", "UNION ALL"), ("intersect_distinct", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except_distinct", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    q(name, "pg", f"SELECT c_nationkey AS k FROM customer {op} SELECT s_nationkey FROM supplier")
q("minus_oracle", "oracle", "SELECT c_nationkey AS k FROM customer MINUS SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier")
q("setop_precedence_pg", "pg", "SELECT 1 AS x UNION SELECT 2 INTERSECT SELECT 3", "SELECT 1 AS x")
q("setop_precedence_oracle", "oracle", "SELECT 1 AS x FROM dual UNION SELECT 2 FROM dual INTERSECT SELECT 2 FROM dual", "SELECT 2 AS x")

# aggregation
q("agg_basic", "pg", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 2) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus",
  "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 2) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY ALL")
q("agg_distinct", "pg", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, sum(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
q("count_multi_distinct", "mysql", f"SELECT count(DISTINCT o_orderstatus, {NP}) AS n FROM orders", f"SELECT count(*) AS n FROM (SELECT DISTINCT o_orderstatus, {NP} AS p FROM orders WHERE {NP} IS NOT NULL)")
q("bit_aggs", "mysql", "SELECT l_linenumber, BIT_AND(l_partkey) AS a, BIT_OR(l_partkey) AS o, BIT_XOR(l_partkey) AS x FROM lineitem GROUP BY l_linenumber")
q("bit_aggs_empty", "mysql", "SELECT BIT_AND(l_partkey) AS a, BIT_OR(l_partkey) AS o, BIT_XOR(l_partkey) AS x FROM lineitem WHERE l_partkey < 0", "SELECT CAST(-1 AS BIGINT) AS a, CAST(0 AS BIGINT) AS o, CAST(0 AS BIGINT) AS x")
q("stddev_mysql", "mysql", "SELECT o_orderstatus, round(STD(o_totalprice), 3) AS a, round(STDDEV(o_totalprice), 3) AS b, round(VARIANCE(o_custkey), 3) AS c, round(STDDEV_SAMP(o_custkey), 3) AS d FROM orders GROUP BY o_orderstatus",
  "SELECT o_orderstatus, round(stddev_pop(o_totalprice), 3) AS a, round(stddev_pop(o_totalprice), 3) AS b, round(var_pop(o_custkey), 3) AS c, round(stddev_samp(o_custkey), 3) AS d FROM orders GROUP BY ALL")
q("stddev_pg", "pg", "SELECT o_orderstatus, round(STDDEV(o_custkey), 3) AS b, round(VARIANCE(o_custkey), 3) AS c, round(VAR_POP(o_custkey), 3) AS d FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(stddev_samp(o_custkey), 3) AS b, round(var_samp(o_custkey), 3) AS c, round(var_pop(o_custkey), 3) AS d FROM orders GROUP BY ALL")
G3 = "l_returnflag, l_linestatus, l_linenumber"
q("rollup", "mysql", f"SELECT {G3}, count(*) AS n FROM lineitem GROUP BY {G3} WITH ROLLUP", f"SELECT {G3}, count(*) AS n FROM lineitem GROUP BY ROLLUP ({G3})")
q("cube", "pg", f"SELECT {G3}, count(*) AS n FROM lineitem GROUP BY CUBE ({G3})")
q("grouping_sets", "oracle", f"SELECT {G3}, count(*) AS n, GROUPING(l_returnflag) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())", f"SELECT {G3}, count(*) AS n, CAST(grouping(l_returnflag) AS INT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
q("grouping_id", "oracle", "SELECT l_returnflag, l_linestatus, GROUPING_ID(l_returnflag, l_linestatus) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
q("having", "oracle", "SELECT o_custkey, sum(o_totalprice) AS s FROM orders HAVING count(*) > 15 GROUP BY o_custkey", "SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey HAVING count(*) > 15")
q("listagg", "oracle", "SELECT p_size, LISTAGG(p_brand, ';') WITHIN GROUP (ORDER BY p_brand DESC, p_partkey) AS l FROM part GROUP BY p_size", "SELECT p_size, string_agg(p_brand, ';' ORDER BY p_brand DESC, p_partkey) AS l FROM part GROUP BY p_size")
q("group_concat", "mysql", "SELECT p_size, GROUP_CONCAT(DISTINCT p_brand ORDER BY p_brand SEPARATOR '|') AS l FROM part GROUP BY p_size", "SELECT p_size, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS l FROM part GROUP BY p_size")
q("string_agg", "pg", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS l FROM nation GROUP BY n_regionkey")
q("percentile_cont", "oracle", "SELECT o_orderstatus, round(PERCENTILE_CONT(0.3) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p, round(MEDIAN(o_totalprice), 4) AS m FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.3), 4) AS p, round(median(o_totalprice), 4) AS m FROM orders GROUP BY o_orderstatus")
q("percentile_disc", "pg", "SELECT o_orderstatus, percentile_disc(0.3) WITHIN GROUP (ORDER BY o_totalprice) AS p FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, quantile_disc(o_totalprice, 0.3) AS p FROM orders GROUP BY o_orderstatus")
q("mode_agg", "pg", "SELECT mode() WITHIN GROUP (ORDER BY o_orderstatus) AS m FROM orders", "SELECT mode(o_orderstatus) AS m FROM orders")
q("hypothetical_rank", "pg", "SELECT o_orderstatus, rank(200000) WITHIN GROUP (ORDER BY o_totalprice) AS r, dense_rank(100) WITHIN GROUP (ORDER BY o_custkey DESC) AS d FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) FILTER (o_totalprice < 200000) + 1 AS r, count(DISTINCT CASE WHEN o_custkey > 100 THEN o_custkey END) + 1 AS d FROM orders GROUP BY o_orderstatus")
q("filter_agg", "pg", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS n, max(o_custkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS m FROM orders GROUP BY o_orderstatus")
q("keep_first", "oracle", "SELECT o_custkey, MIN(o_totalprice) KEEP (DENSE_RANK FIRST ORDER BY o_orderpriority DESC) AS a, COUNT(o_totalprice) KEEP (DENSE_RANK LAST ORDER BY o_orderpriority) AS n FROM orders GROUP BY o_custkey",
  "SELECT o_custkey, min(o_totalprice) AS a, count(*) AS n FROM (SELECT *, max(o_orderpriority) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderpriority = m GROUP BY o_custkey")
q("keep_last", "oracle", "SELECT o_custkey, MAX(o_totalprice) KEEP (DENSE_RANK LAST ORDER BY o_orderdate) AS a, round(SUM(o_totalprice) KEEP (DENSE_RANK FIRST ORDER BY o_orderdate), 2) AS s FROM orders GROUP BY o_custkey",
  "SELECT o_custkey, max(o_totalprice) FILTER (o_orderdate = hi) AS a, round(sum(o_totalprice) FILTER (o_orderdate = lo), 2) AS s FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS hi, min(o_orderdate) OVER (PARTITION BY o_custkey) AS lo FROM orders) GROUP BY o_custkey")
q("ratio_to_report", "oracle", "SELECT o_orderkey, round(RATIO_TO_REPORT(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS r FROM orders", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS r FROM orders")
q("corr_regr", "pg", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_tax), 6) AS p, round(covar_samp(l_quantity, l_discount), 6) AS s, round(regr_slope(l_extendedprice, l_quantity), 4) AS b, regr_count(l_tax, l_quantity) AS n FROM lineitem", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_tax), 6) AS p, round(covar_samp(l_quantity, l_discount), 6) AS s, round(regr_slope(l_extendedprice, l_quantity), 4) AS b, CAST(regr_count(l_tax, l_quantity) AS BIGINT) AS n FROM lineitem")
q("bool_aggs", "pg", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 490000) AS o, every(o_custkey >= 0) AS e FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 490000) AS o, bool_and(o_custkey >= 0) AS e FROM orders GROUP BY o_orderstatus")
q("array_agg_order", "pg", "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_nationkey DESC), '-') AS l FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '-' ORDER BY n_nationkey DESC) AS l FROM nation GROUP BY n_regionkey")

# windows
W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
q("win_rank_family", "pg", f"SELECT o_orderkey, row_number() {W} AS a, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS b, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS c, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 6) AS d, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 6) AS e FROM orders")
q("win_ntile", "oracle", f"SELECT o_orderkey, NTILE(4) {W} AS t FROM orders")
q("win_lag_lead", "mysql", f"SELECT o_orderkey, LAG(o_totalprice, 1, 0) {W} AS a, LEAD(o_orderkey, 2) {W} AS b FROM orders")
q("win_ignore_nulls", "oracle", f"SELECT o_orderkey, LAG({NP}) IGNORE NULLS {W} AS a FROM orders", f"SELECT o_orderkey, LAG({NP} IGNORE NULLS) {W} AS a FROM orders")
q("win_first_last_nth", "pg", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS a, last_value(o_orderkey) OVER w AS b, nth_value(o_orderkey, 2) OVER w AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
q("win_rows", "pg", "SELECT o_orderkey, sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s FROM orders", "SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM orders")
q("win_range_interval", "pg", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1 day' PRECEDING AND CURRENT ROW) AS n FROM events")
q("win_named", "mysql", "SELECT o_orderkey, COUNT(*) OVER w AS n, MAX(o_totalprice) OVER w AS m FROM orders WINDOW w AS (PARTITION BY o_custkey)")
q("win_distinct_count", "oracle", "SELECT o_orderkey, COUNT(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) AS n FROM orders", "SELECT o_orderkey, CAST(count(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) AS INT) AS n FROM orders")
for what in ("CURRENT ROW", "GROUP", "TIES"):
    q(f"win_exclude_{what.split()[0].lower()}", "pg", f"SELECT o_orderkey, sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {what}) AS s, count(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {what}) AS n FROM orders",
      f"SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {what}) AS BIGINT) AS s, count(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {what}) AS n FROM orders")

# order and limit
for d in ("mysql", "pg", "oracle"):
    for way in ("ASC", "DESC"):
        first = (way == "ASC") == (d == "mysql")
        q(f"order_nulls_{d}_{way.lower()}", d, f"SELECT o_orderkey, row_number() OVER (ORDER BY {NP} {way}, o_orderkey) AS n FROM orders", f"SELECT o_orderkey, row_number() OVER (ORDER BY {NP} {way} NULLS {'FIRST' if first else 'LAST'}, o_orderkey) AS n FROM orders")
q("limit_offset", "mysql", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5, 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
q("limit_offset_pg", "pg", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7 OFFSET 3")
q("fetch_first", "oracle", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 4 ROWS FETCH NEXT 6 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 6 OFFSET 4")
q("fetch_percent", "oracle", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey FETCH FIRST 3 PERCENT ROWS ONLY", "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER () AS c FROM orders) WHERE r <= ceil(c * 0.03)")
q("with_ties", "pg", "SELECT p_partkey, p_size FROM part ORDER BY p_size FETCH FIRST 10 ROWS WITH TIES", "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size) AS r FROM part) WHERE r <= 10")
q("rownum", "oracle", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey) WHERE ROWNUM <= 8", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 8")

# operators
q("arith_div_mysql", "mysql", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_partkey / 7, 3) AS DOUBLE) AS a, l_partkey DIV 7 AS b, l_partkey % 7 AS c, CAST(l_partkey / 0 AS DOUBLE) AS z FROM lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_partkey / 7, 3) AS DOUBLE) AS a, l_partkey // 7 AS b, l_partkey % 7 AS c, CAST(NULL AS DOUBLE) AS z FROM lineitem")
q("arith_div_pg", "pg", "SELECT l_orderkey, l_linenumber, l_partkey, l_partkey / 7 AS a, -l_partkey / 7 AS b, mod(l_partkey, 7) AS c, round(l_quantity / 7, 4) AS d FROM lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, l_partkey // 7 AS a, CAST(trunc(-l_partkey / 7) AS BIGINT) AS b, l_partkey % 7 AS c, round(l_quantity / 7, 4) AS d FROM lineitem")
q("arith_div_oracle", "oracle", "SELECT o_orderkey, CAST(round(o_custkey / 4, 2) AS BINARY_DOUBLE) AS a, REMAINDER(o_custkey, 4) AS r FROM orders", "SELECT o_orderkey, round(o_custkey / 4, 2) AS a, o_custkey - 4 * round_even(o_custkey / 4, 0) AS r FROM orders")
q("bit_ops", "mysql", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 3 AS o, p_partkey ^ 5 AS x, p_partkey << 2 AS l, p_partkey >> 1 AS r, ~p_size AS n FROM part", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 3 AS o, xor(p_partkey, 5) AS x, p_partkey << 2 AS l, p_partkey >> 1 AS r, ~p_size AS n FROM part")
q("power_op", "pg", "SELECT p_partkey, p_size ^ 2 AS p, p_size # 3 AS x FROM part", "SELECT p_partkey, pow(p_size, 2) AS p, xor(p_size, 3) AS x FROM part")
q("concat_null_mysql", "mysql", f"SELECT o_orderkey, CONCAT(o_orderstatus, {NP}) AS a, CONCAT_WS('-', o_orderstatus, {NP}) AS b FROM orders", f"SELECT o_orderkey, o_orderstatus || {NP} AS a, concat_ws('-', o_orderstatus, {NP}) AS b FROM orders")
q("concat_null_pg", "pg", f"SELECT o_orderkey, o_orderstatus || {NP} AS a, concat(o_orderstatus, {NP}, 1) AS b FROM orders", f"SELECT o_orderkey, o_orderstatus || {NP} AS a, concat(o_orderstatus, {NP}, 1) AS b FROM orders")
q("concat_null_oracle", "oracle", f"SELECT o_orderkey, o_orderstatus || {NP} || 'x' AS a FROM orders", f"SELECT o_orderkey, o_orderstatus || coalesce({NP}, '') || 'x' AS a FROM orders")
q("empty_is_null", "oracle", "SELECT count(*) AS n FROM orders WHERE replace(o_orderstatus, 'F', '') IS NULL", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
q("greatest_null", "mysql", f"SELECT o_orderkey, GREATEST({NP}, '2') AS a, LEAST(o_custkey, 10) AS b FROM orders", f"SELECT o_orderkey, CASE WHEN {NP} IS NOT NULL THEN greatest({NP}, '2') END AS a, least(o_custkey, 10) AS b FROM orders")
q("greatest_null_pg", "pg", f"SELECT o_orderkey, GREATEST({NP}, '2') AS a FROM orders")
q("json_ops", "mysql", "SELECT event_id, props->'$.k' AS a, props->>'$.k' AS b FROM events", "SELECT event_id, props->>'$.k' AS a, props->>'$.k' AS b FROM events")

# dates
q("date_add_interval", "pg", "SELECT o_orderkey, o_orderdate + INTERVAL '1 month 3 days' AS a, o_orderdate - INTERVAL '2 hours' AS b, CAST(o_orderdate AS date) + 5 AS c FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH + INTERVAL 3 DAY AS a, o_orderdate - INTERVAL 2 HOUR AS b, CAST(o_orderdate AS DATE) + 5 AS c FROM orders")
q("date_add_interval_mysql", "mysql", "SELECT o_orderkey, DATE_ADD(o_orderdate, INTERVAL 3 MONTH) AS a, DATE_SUB(o_orderdate, INTERVAL 1 WEEK) AS b, o_orderdate + INTERVAL '1 12' DAY_HOUR AS c, ADDDATE(DATE(o_orderdate), 31) AS d FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 3 MONTH AS a, o_orderdate - INTERVAL 7 DAY AS b, o_orderdate + INTERVAL 36 HOUR AS c, CAST(o_orderdate AS DATE) + 31 AS d FROM orders")
q("date_diff_mysql", "mysql", "SELECT o_orderkey, DATEDIFF(DATE '1999-01-01', o_orderdate) AS d, TIMESTAMPDIFF(MONTH, o_orderdate, TIMESTAMP '1999-01-15 00:00:00') AS m, TO_DAYS(o_orderdate) AS t FROM orders", "SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS INT) AS d, datesub('month', o_orderdate, TIMESTAMP '1999-01-15') AS m, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INT) + 719528 AS t FROM orders")
q("date_diff_pg", "pg", "SELECT o_orderkey, DATE '1999-01-01' - CAST(o_orderdate AS date) AS d FROM orders", "SELECT o_orderkey, CAST(DATE '1999-01-01' - CAST(o_orderdate AS DATE) AS INT) AS d FROM orders")
q("date_diff_oracle", "oracle", "SELECT event_id, CAST(round(TIMESTAMP '2024-02-01 00:00:00' - ts, 6) AS BINARY_DOUBLE) AS d, MONTHS_BETWEEN(DATE '2024-07-31', TRUNC(ts, 'MM')) > 5 AS late FROM events", "SELECT event_id, round(date_diff('microsecond', ts, TIMESTAMP '2024-02-01') / 86400000000.0, 6) AS d, 1 AS late FROM events")
q("extract_fields", "pg", "SELECT event_id, EXTRACT(YEAR FROM ts) AS y, EXTRACT(MONTH FROM ts) AS m, EXTRACT(DAY FROM ts) AS d, EXTRACT(HOUR FROM ts) AS h, EXTRACT(DOW FROM ts) AS w, EXTRACT(ISODOW FROM ts) AS i, EXTRACT(DOY FROM ts) AS j, EXTRACT(QUARTER FROM ts) AS q, EXTRACT(WEEK FROM ts) AS k, EXTRACT(CENTURY FROM ts) AS c FROM events",
  "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, dayofweek(ts) AS w, isodow(ts) AS i, dayofyear(ts) AS j, quarter(ts) AS q, week(ts) AS k, century(ts) AS c FROM events")
q("date_trunc", "pg", "SELECT event_id, date_trunc('month', ts) AS m, date_trunc('hour', ts) AS h, date_trunc('week', ts) AS w FROM events", "SELECT event_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, date_trunc('hour', ts) AS h, CAST(date_trunc('week', ts) AS TIMESTAMP) AS w FROM events")
q("date_trunc_oracle", "oracle", "SELECT event_id, TRUNC(ts) AS d, TRUNC(ts, 'Q') AS q, LAST_DAY(TRUNC(ts)) AS l, ADD_MONTHS(TRUNC(ts), 1) AS a FROM events", "SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS d, CAST(date_trunc('quarter', ts) AS TIMESTAMP) AS q, last_day(ts) AS l, CAST(CAST(ts AS DATE) + INTERVAL 1 MONTH AS DATE) AS a FROM events")
q("date_parts_mysql", "mysql", "SELECT event_id, YEAR(ts) AS y, DAYOFWEEK(ts) AS w, WEEKDAY(ts) AS d, DAYNAME(ts) AS n, MONTHNAME(ts) AS m, TIME_TO_SEC(ts) AS s, UNIX_TIMESTAMP(ts) AS u FROM events", "SELECT event_id, year(ts) AS y, dayofweek(ts) + 1 AS w, isodow(ts) - 1 AS d, dayname(ts) AS n, monthname(ts) AS m, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s, CAST(floor(epoch(ts)) AS BIGINT) AS u FROM events")
q("fmt_roundtrip_mysql", "mysql", "SELECT event_id, DATE_FORMAT(ts, '%Y/%m/%d %H-%i-%s') AS f, STR_TO_DATE(DATE_FORMAT(ts, '%d.%m.%Y'), '%d.%m.%Y') AS d FROM events", "SELECT event_id, strftime(ts, '%Y/%m/%d %H-%M-%S') AS f, CAST(ts AS DATE) AS d FROM events")
q("fmt_roundtrip_pg", "pg", "SELECT event_id, to_char(ts, 'YYYY-MM-DD HH24:MI:SS') AS f, to_date(to_char(ts, 'DD Mon YYYY'), 'DD Mon YYYY') AS d FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS f, CAST(ts AS DATE) AS d FROM events")
q("fmt_roundtrip_oracle", "oracle", "SELECT event_id, TO_CHAR(ts, 'DD-MON-YY') AS f, TO_DATE(TO_CHAR(ts, 'YYYYMMDD'), 'YYYYMMDD') AS d FROM events", "SELECT event_id, strftime(ts, '%d-%b-%y') AS f, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS d FROM events")

# functions
q("str_basic", "mysql", "SELECT p_partkey, UPPER(p_name) AS a, LCASE(p_type) AS b, LENGTH(p_name) AS c, CHAR_LENGTH(p_name) AS d, REVERSE(p_brand) AS e, LEFT(p_name, 3) AS f, RIGHT(p_name, 2) AS g, SUBSTRING(p_type, 2, 4) AS h, LOCATE('a', p_type) AS i, INSTR(p_type, 'e') AS j, REPEAT(p_brand, 2) AS k FROM part",
  "SELECT p_partkey, upper(p_name) AS a, lower(p_type) AS b, strlen(p_name) AS c, length(p_name) AS d, reverse(p_brand) AS e, left(p_name, 3) AS f, right(p_name, 2) AS g, substr(p_type, 2, 4) AS h, strpos(p_type, 'a') AS i, strpos(p_type, 'e') AS j, repeat(p_brand, 2) AS k FROM part")
q("str_bytes_chars", "mysql", "SELECT doc_id, LENGTH(text) AS b, CHAR_LENGTH(text) AS c, OCTET_LENGTH(lang) AS o FROM documents", "SELECT doc_id, CAST(strlen(text) AS INT) AS b, length(text) AS c, CAST(strlen(lang) AS INT) AS o FROM documents")
q("str_pad_trim", "pg", "SELECT p_partkey, lpad(p_brand, 12, '*') AS a, rpad(p_brand, 5, '-') AS b, trim(BOTH 'B' FROM p_brand) AS c, ltrim(p_brand, 'Bra') AS d, rtrim(p_brand, '123') AS e, btrim(p_type, 'SPL') AS f, split_part(p_type, ' ', 2) AS g, initcap(lower(p_type)) AS h, translate(p_brand, 'Bd', 'bD') AS i FROM part",
  "SELECT p_partkey, lpad(p_brand, 12, '*') AS a, rpad(p_brand, 5, '-') AS b, trim(p_brand, 'B') AS c, ltrim(p_brand, 'Bra') AS d, rtrim(p_brand, '123') AS e, trim(p_type, 'SPL') AS f, split_part(p_type, ' ', 2) AS g, list_aggregate(list_transform(string_split(lower(p_type), ' '), lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ') AS h, translate(p_brand, 'Bd', 'bD') AS i FROM part")
q("trim_string_mysql", "mysql", "SELECT p_partkey, TRIM(LEADING 'Brand' FROM p_brand) AS a, TRIM(TRAILING '#1' FROM 'x#1#1') AS b FROM part", "SELECT p_partkey, regexp_replace(p_brand, '^(Brand)+', '') AS a, 'x' AS b FROM part")
q("str_mysql_more", "mysql", "SELECT p_partkey, FIELD(p_size, 3, 5, 7) AS a, ELT(2, p_brand, p_type) AS b, FIND_IN_SET('b', 'a,b,c') AS c, STRCMP(p_brand, 'Brand#22') AS d, INSERT(p_brand, 2, 3, 'XX') AS e, SUBSTRING_INDEX(p_type, ' ', 1) AS f, HEX(p_size) AS g, CONV(p_size, 10, 2) AS h, SPACE(2) AS i FROM part",
  "SELECT p_partkey, CASE p_size WHEN 3 THEN 1 WHEN 5 THEN 2 WHEN 7 THEN 3 ELSE 0 END AS a, p_type AS b, 2 AS c, CASE WHEN p_brand = 'Brand#22' THEN 0 WHEN p_brand < 'Brand#22' THEN -1 ELSE 1 END AS d, p_brand[1] || 'XX' || p_brand[5:] AS e, split_part(p_type, ' ', 1) AS f, upper(printf('%x', p_size)) AS g, ltrim(bin(p_size), '0') AS h, '  ' AS i FROM part")
q("str_oracle", "oracle", "SELECT p_partkey, SUBSTR(p_type, -4) AS a, INSTR(p_type, 'A', 3) AS b, DECODE(p_size, 1, 'one', 2, 'two', 'many') AS c, NVL2(nullif(p_brand, 'Brand#11'), 'y', 'n') AS d, INITCAP(lower(p_type)) AS e, LENGTHB(p_name) AS f FROM part",
  "SELECT p_partkey, right(p_type, 4) AS a, CASE WHEN strpos(substr(p_type, 3), 'A') > 0 THEN strpos(substr(p_type, 3), 'A') + 2 ELSE 0 END AS b, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS c, CASE WHEN p_brand <> 'Brand#11' THEN 'y' ELSE 'n' END AS d, list_aggregate(list_transform(string_split(lower(p_type), ' '), lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ') AS e, CAST(strlen(p_name) AS INT) AS f FROM part")
q("regexp_family", "pg", "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '_') AS a, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS b, regexp_count(p_type, 'A') AS c, regexp_substr(p_brand, '[0-9]+') AS d FROM part",
  "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '_') AS a, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS b, len(regexp_extract_all(p_type, 'A')) AS c, nullif(regexp_extract(p_brand, '[0-9]+'), '') AS d FROM part")
q("regexp_oracle", "oracle", "SELECT p_partkey, REGEXP_REPLACE(p_type, '[AEIOU]', '_') AS b FROM part WHERE REGEXP_LIKE(p_brand, '[24]$')", "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS b FROM part WHERE regexp_matches(p_brand, '[24]$')")
q("num_basic", "pg", "SELECT p_partkey, abs(-p_size) AS a, ceil(p_retailprice) AS b, floor(p_retailprice) AS c, round(sqrt(p_size), 6) AS d, sign(p_size - 25) AS e, round(ln(p_size + 1), 6) AS f, round(log(p_size + 1), 6) AS g, round(exp(1), 6) AS h, trunc(p_retailprice, 1) AS i, round(cbrt(p_size), 6) AS j, gcd(p_size, 12) AS k, round(degrees(1), 6) AS l, round(sind(30), 6) AS m FROM part",
  "SELECT p_partkey, abs(-p_size) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS b, CAST(floor(p_retailprice) AS BIGINT) AS c, round(sqrt(p_size), 6) AS d, CAST(sign(p_size - 25) AS DOUBLE) AS e, round(ln(p_size + 1), 6) AS f, round(log10(p_size + 1), 6) AS g, round(exp(1), 6) AS h, trunc(p_retailprice * 10) / 10 AS i, round(cbrt(p_size), 6) AS j, gcd(p_size, 12) AS k, round(degrees(1), 6) AS l, round(sin(radians(30)), 6) AS m FROM part")
q("num_mysql", "mysql", "SELECT p_partkey, LOG(p_size + 1) > 1 AS a, MOD(p_size, 7) AS b, TRUNCATE(p_retailprice, 1) AS c, POW(p_size, 2) AS d, BIT_COUNT(p_size) AS e, MD5(p_name) AS g, SHA1(p_brand) AS h, SHA2(p_brand, 256) AS i FROM part",
  "SELECT p_partkey, CAST(ln(p_size + 1) > 1 AS INT) AS a, p_size % 7 AS b, trunc(p_retailprice * 10) / 10 AS c, pow(p_size, 2) AS d, bit_count(p_size) AS e, md5(p_name) AS g, sha1(p_brand) AS h, sha256(p_brand) AS i FROM part")
q("json_funcs", "mysql", "SELECT event_id, JSON_EXTRACT(props, '$.k') AS a, JSON_VALID(props) AS b, JSON_CONTAINS_PATH(props, 'one', '$.k') AS c, JSON_LENGTH(props) AS d FROM events", "SELECT event_id, props->>'$.k' AS a, 1 AS b, 1 AS c, 1 AS d FROM events")
q("array_ops", "pg", "SELECT n_nationkey, (ARRAY[1, n_nationkey, 3])[2] AS a, array_length(ARRAY[1, 2] || ARRAY[n_nationkey], 1) AS b, array_to_string((ARRAY['a', 'b', 'c'])[2:3], '+') AS c, ARRAY[1, 2, 3] @> ARRAY[2] AS d, ARRAY[n_nationkey] && ARRAY[1, 2] AS e FROM nation",
  "SELECT n_nationkey, n_nationkey AS a, 3 AS b, 'b+c' AS c, true AS d, n_nationkey IN (1, 2) AS e FROM nation")
q("geo_point_distance", "mysql", "SELECT n_nationkey, round(ST_DISTANCE(POINT(n_nationkey, n_regionkey), POINT(3, 4)), 6) AS d, ST_X(POINT(n_nationkey, 2)) AS x FROM nation", "SELECT n_nationkey, round(sqrt(pow(n_nationkey - 3, 2) + pow(n_regionkey - 4, 2)), 6) AS d, CAST(n_nationkey AS DOUBLE) AS x FROM nation")
q("xml_funcs", "pg", "SELECT n_nationkey, xmlelement(name_, n_name) AS a, xmlcomment(n_name) AS b FROM nation", "SELECT n_nationkey, '<name_>' || n_name || '</name_>' AS a, '<!--' || n_name || '-->' AS b FROM nation")
q("collate_ci", "mysql", "SELECT n_nationkey FROM nation WHERE n_name COLLATE utf8mb4_general_ci = lower(n_name)", "SELECT n_nationkey FROM nation")
q("json_mutation", "mysql", "SELECT event_id, JSON_SET(props, '$.k', 1, '$.z', 'y') AS a, JSON_REMOVE(props, '$.k') AS b, JSON_MERGE_PATCH(props, '{\"q\": [1, 2]}') AS c, JSON_DEPTH(props) AS d FROM events",
  """SELECT event_id, '{"k": 1, "z": "y"}' AS a, '{}' AS b, '{"k": ' || (props->>'$.k') || ', "q": [1, 2]}' AS c, 2 AS d FROM events""")
q("geo_polygons", "mysql", "SELECT n_nationkey, ST_AREA(ST_GEOMFROMTEXT(CONCAT('POLYGON((0 0,', n_nationkey + 1, ' 0,', n_nationkey + 1, ' 2,0 2,0 0))'))) AS a, MBRCONTAINS('POLYGON((0 0,10 0,10 10,0 10,0 0))', CONCAT('POINT(', n_nationkey, ' 5)')) AS c, ST_ASTEXT(ST_CENTROID('POLYGON((0 0,4 0,4 2,0 2,0 0))')) AS m, ST_LENGTH('LINESTRING(0 0,3 4)') AS l FROM nation",
  "SELECT n_nationkey, CAST(2 * (n_nationkey + 1) AS DOUBLE) AS a, CAST(n_nationkey <= 10 AS DOUBLE) AS c, 'POINT(2 1)' AS m, CAST(5 AS DOUBLE) AS l FROM nation")
q("loose_group_by", "mysql", "SELECT c_custkey, c_name, UPPER(c_mktsegment) AS seg, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", "SELECT c_custkey, any_value(c_name) AS c_name, any_value(upper(c_mktsegment)) AS seg, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
q("cube_vs_union", "mysql", "SELECT o_orderstatus AS a, o_orderpriority AS b, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority UNION ALL SELECT o_orderstatus, NULL, COUNT(*) FROM orders GROUP BY o_orderstatus UNION ALL SELECT NULL, o_orderpriority, COUNT(*) FROM orders GROUP BY o_orderpriority UNION ALL SELECT NULL, NULL, COUNT(*) FROM orders", "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
q("xmltable", "oracle", "SELECT n.n_nationkey, x.ord, x.v, x.w FROM nation n, XMLTABLE('/r/i' PASSING '<r><i><v>' || n.n_nationkey || '</v></i><i><v>7</v><w>z</w></i></r>' COLUMNS ord FOR ORDINALITY, v NUMBER(5) PATH 'v', w VARCHAR2(5) PATH 'w' DEFAULT '-') x",
  "SELECT n_nationkey, i AS ord, CAST(CASE i WHEN 1 THEN n_nationkey ELSE 7 END AS DECIMAL(5, 0)) AS v, CASE i WHEN 1 THEN '-' ELSE 'z' END AS w FROM nation, (VALUES (1), (2)) t(i)")
q("months_between", "oracle", "SELECT o_orderkey, CAST(round(MONTHS_BETWEEN(DATE '2000-01-01', TRUNC(o_orderdate, 'MM')), 4) AS BINARY_DOUBLE) AS m, NEXT_DAY(TRUNC(o_orderdate), 'SUNDAY') AS d FROM orders", "SELECT o_orderkey, CAST(date_diff('month', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS DOUBLE) AS m, CAST(CAST(o_orderdate AS DATE) + CAST(7 - dayofweek(o_orderdate) AS INTEGER) AS DATE) AS d FROM orders")
q("null_groups", "pg", f"SELECT {NP} AS p, count(*) AS n, count({NP}) AS m, GROUPING({NP}) AS g FROM orders GROUP BY ROLLUP ({NP})", f"SELECT {NP} AS p, count(*) AS n, count({NP}) AS m, CAST(grouping({NP}) AS INT) AS g FROM orders GROUP BY ROLLUP ({NP})")
q("time_functions", "mysql", "SELECT event_id, HOUR(ts) AS h, MINUTE(ts) AS m, SECOND(ts) AS s, QUARTER(ts) AS q, LAST_DAY(ts) AS l, MAKEDATE(YEAR(ts), 60) AS d, DAYOFYEAR(ts) AS y, TO_SECONDS(ts) > 0 AS t FROM events", "SELECT event_id, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS m, CAST(second(ts) AS INT) AS s, CAST(quarter(ts) AS INT) AS q, last_day(ts) AS l, CAST(make_date(CAST(year(ts) AS INT), 1, 1) + 59 AS DATE) AS d, CAST(dayofyear(ts) AS INT) AS y, 1 AS t FROM events")
q("position_functions", "pg", "SELECT p_partkey, position('A' in p_type) AS a, strpos(p_type, 'S') AS b, overlay(p_brand placing 'XY' from 2 for 3) AS c, substring(p_type from 2 for 3) AS d, ascii(p_brand) AS e, chr(65 + mod(p_size, 26)) AS f, starts_with(p_type, 'S') AS g FROM part", "SELECT p_partkey, CAST(strpos(p_type, 'A') AS INT) AS a, CAST(strpos(p_type, 'S') AS INT) AS b, p_brand[1] || 'XY' || p_brand[5:] AS c, substr(p_type, 2, 3) AS d, ascii(p_brand) AS e, chr(65 + p_size % 26) AS f, starts_with(p_type, 'S') AS g FROM part")
GR = "PARTITION BY o_orderstatus ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING"
q("win_groups_sql", "pg", f"SELECT o_orderkey, count(*) OVER ({GR}) AS n, max(o_custkey) OVER ({GR}) AS m FROM orders o WHERE o.o_totalprice > 5000")
q("tpch_q1", "pg", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus")
q("tpch_q3", "mysql", "SELECT l_orderkey, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1996-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10",
  "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1996-03-15' GROUP BY ALL ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10")
q("tpch_q5", "oracle", "SELECT n_name, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name")
q("tpch_q6", "pg", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")


def oracle_sql() -> dict[str, str]:
    return {name: duck or text for name, (_, text, duck) in Q.items()}
