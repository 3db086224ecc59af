"""The SQL corpus: one statement per operator, for Spark and for the oracle.

A statement is (Spark SQL, oracle SQL); None as the oracle's means the same text.
Every computed column has an alias, counts and ranks are BIGINT, and orders that
decide on rows are total, so that both engines return equal rows.
"""

from __future__ import annotations

STATEMENTS: dict[str, tuple[str, str | None]] = {}


def _add(name: str, spark: str, oracle: str | None = None) -> None:
    assert name not in STATEMENTS, name
    STATEMENTS[name] = (spark, oracle)


# Scan, projection, filter.
_add("select_star", "SELECT * FROM nation")
_add("scan_project", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
_add("column_alias", "SELECT o_orderkey AS id, o_totalprice AS amount FROM orders")
_add("table_alias", "SELECT o.o_orderkey, o.o_orderstatus FROM orders o")
_add("arithmetic", "SELECT l_orderkey, l_extendedprice, l_extendedprice * l_quantity AS gross, l_linenumber + 1 AS next_line, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
_add("filter_string_eq", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
_add("filter_conjunction", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_extendedprice > 1000 AND l_quantity >= 30")
_add("filter_count", "SELECT COUNT(*) AS cnt FROM orders WHERE o_totalprice > 1000")
_add("filter_scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)")
_add("implicit_cast", "SELECT l_orderkey, l_extendedprice, l_linenumber * l_quantity AS weighted FROM lineitem WHERE l_linenumber > 2.5")
_add("between_in_like", "SELECT p_partkey, p_brand, p_type FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#12', 'Brand#23', 'Brand#11') OR p_type LIKE '%STEEL%' AND p_size NOT BETWEEN 1 AND 3")
_add("or_not_null", "SELECT c_custkey, c_mktsegment FROM customer WHERE (NOT c_acctbal > 0 OR c_mktsegment = 'BUILDING') AND c_name IS NOT NULL")
_add("case_when", "SELECT CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, COUNT(*) AS cnt FROM orders GROUP BY 1")
_add("coalesce_cast", "SELECT o_orderkey, CAST(FLOOR(o_totalprice) AS INTEGER) AS whole, COALESCE(NULLIF(o_orderstatus, 'P'), 'pending') AS status, TRY_CAST(o_orderpriority AS INTEGER) AS number FROM orders")
_add("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_add("values_table", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)")

# Aggregates.
_add("global_multi_agg", "SELECT COUNT(*) AS cnt, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total, AVG(CAST(o_custkey AS DOUBLE)) AS mean, MIN(o_totalprice) AS least, MAX(o_totalprice) AS most FROM orders")
_add("global_sum_expr", "SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_quantity AS DECIMAL(6,0))) AS DOUBLE) AS revenue, AVG(l_quantity) AS mean_quantity, MIN(l_quantity) AS least, MAX(l_quantity) AS most FROM lineitem")
_add("count_col", "SELECT COUNT(*) AS all_rows, COUNT(o_custkey) AS customers, COUNT(o_orderpriority) AS priorities FROM orders")
_add("count_distinct", "SELECT COUNT(DISTINCT o_orderstatus) AS statuses, COUNT(DISTINCT o_custkey) AS customers FROM orders")
_add("count_distinct_mixed", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers, COUNT(DISTINCT o_orderpriority) AS priorities, COUNT(*) AS cnt FROM orders GROUP BY o_orderstatus")
_add("filtered_global_agg", "SELECT COUNT(*) AS cnt, AVG(l_quantity) AS mean FROM lineitem WHERE l_extendedprice > 50000")
_add("group_status", "SELECT o_orderstatus, COUNT(*) AS cnt, MIN(o_totalprice) AS least, MAX(o_totalprice) AS most FROM orders GROUP BY o_orderstatus ORDER BY o_orderstatus")
_add("group_customer", "SELECT o_custkey, COUNT(*) AS cnt, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM orders GROUP BY o_custkey")
_add("group_part", "SELECT l_partkey, COUNT(*) AS cnt, SUM(l_quantity) AS quantity FROM lineitem GROUP BY l_partkey")
_add("group_two_cols", "SELECT o_orderstatus, o_custkey, COUNT(*) AS cnt, MAX(o_totalprice) AS most FROM orders GROUP BY o_orderstatus, o_custkey")
_add("group_no_agg", "SELECT o_orderstatus FROM orders GROUP BY o_orderstatus")
_add("filtered_group", "SELECT o_orderstatus, COUNT(*) AS cnt, MIN(o_totalprice) AS least FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
_add("group_expression", "SELECT l_returnflag, SUM(CAST(l_quantity AS BIGINT)) AS quantity, SUM(CAST(l_linenumber AS BIGINT)) AS numbers FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(SUM(CAST(l_linenumber AS BIGINT)) AS BIGINT) AS numbers FROM lineitem GROUP BY l_returnflag")
_add("having", "SELECT o_custkey, COUNT(*) AS cnt FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
_add("filter_agg", "SELECT l_returnflag, COUNT(*) FILTER (WHERE l_quantity > 25) AS large, COUNT(*) AS cnt FROM lineitem GROUP BY l_returnflag")
_add("grouping_sets", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS cnt FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
_add("cube", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_add("rollup", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_add("stddev_var_corr", "SELECT ROUND(STDDEV(l_quantity), 6) AS deviation, ROUND(VAR_SAMP(l_quantity), 6) AS variance, ROUND(CORR(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem")
_add("median", "SELECT l_returnflag, MEDIAN(l_quantity) AS middle FROM lineitem GROUP BY l_returnflag")
_add("percentile", "SELECT l_returnflag, PERCENTILE_CONT(0.25) WITHIN GROUP (ORDER BY l_quantity) AS lower FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, QUANTILE_CONT(l_quantity, 0.25) AS lower FROM lineitem GROUP BY l_returnflag")
_add("bool_bit_aggs", "SELECT o_orderstatus, BOOL_AND(o_totalprice > 1000) AS every_one, BOOL_OR(o_totalprice > 400000) AS any_one, BIT_AND(o_custkey) AS all_bits, BIT_OR(o_custkey) AS any_bits, BIT_XOR(o_custkey) AS odd_bits FROM orders GROUP BY o_orderstatus")
_add("string_agg", "SELECT n_regionkey, LISTAGG(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, STRING_AGG(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_add("array_agg_size", "SELECT n_regionkey, CAST(SIZE(ARRAY_AGG(n_name)) AS BIGINT) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(LEN(ARRAY_AGG(n_name)) AS BIGINT) AS names FROM nation GROUP BY n_regionkey")
_add("first_last_by", "SELECT o_custkey, MAX_BY(o_orderkey, o_totalprice) AS dearest, MIN_BY(o_orderkey, o_totalprice) AS cheapest FROM orders GROUP BY o_custkey", "SELECT o_custkey, ARG_MAX(o_orderkey, o_totalprice) AS dearest, ARG_MIN(o_orderkey, o_totalprice) AS cheapest FROM orders GROUP BY o_custkey")

# Sort, limit, top-k.
_add("topk_customers", "SELECT o_custkey, COUNT(*) AS cnt FROM orders GROUP BY o_custkey ORDER BY cnt DESC, o_custkey LIMIT 20")
_add("topk_products_count", "SELECT l_partkey, COUNT(*) AS cnt FROM lineitem GROUP BY l_partkey ORDER BY COUNT(*) DESC, l_partkey LIMIT 20")
_add("topk_products_revenue", "SELECT l_partkey, SUM(l_quantity) AS quantity, MAX(l_extendedprice) AS dearest FROM lineitem GROUP BY l_partkey ORDER BY quantity DESC, l_partkey LIMIT 20")
_add("topk_100", "SELECT o_custkey, MAX(o_totalprice) AS most FROM orders GROUP BY o_custkey ORDER BY most DESC, o_custkey LIMIT 100")
_add("order_by_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_add("order_by_asc", "SELECT o_orderstatus, COUNT(*) AS cnt FROM orders GROUP BY o_orderstatus ORDER BY cnt ASC, o_orderstatus ASC")
_add("offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5")
_add("nulls_order", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 450000 ORDER BY o.o_orderkey DESC NULLS FIRST, c.c_custkey")
_add("scalar_subquery_group", "SELECT o_orderstatus, COUNT(*) AS cnt FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders) GROUP BY o_orderstatus")

# Joins.
_add("join_project", "SELECT o.o_orderkey, o.o_orderstatus, l.l_partkey, l.l_quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey")
_add("join_count", "SELECT COUNT(*) AS cnt FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey")
_add("join_global_revenue", "SELECT COUNT(*) AS cnt, SUM(l.l_quantity) AS quantity, MAX(l.l_extendedprice * l.l_quantity) AS largest FROM orders o join lineitem l ON o.o_orderkey = l.l_orderkey")
_add("join_group_status", "SELECT o.o_orderstatus, COUNT(*) AS cnt, COUNT(l.l_partkey) AS parts, SUM(l.l_quantity) AS quantity FROM orders o Join lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderstatus")
_add("join_group_customer_topk", "SELECT o.o_custkey, COUNT(*) AS cnt, SUM(l.l_quantity) AS quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_custkey ORDER BY quantity DESC, o.o_custkey LIMIT 20")
_add("join_group_customer_product", "SELECT o.o_custkey, l.l_partkey, COUNT(*) AS cnt, SUM(l.l_quantity) AS quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_custkey, l.l_partkey")
_add("join_filter_group", "SELECT o.o_orderstatus, l.l_returnflag, COUNT(*) AS cnt FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_totalprice > 200000 GROUP BY o.o_orderstatus, l.l_returnflag")
_add("join_count_distinct_topk", "SELECT l.l_partkey, COUNT(DISTINCT o.o_custkey) AS customers FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY l.l_partkey ORDER BY customers DESC, l.l_partkey LIMIT 50")
_add("join_multi_distinct", "SELECT o.o_orderstatus, COUNT(DISTINCT o.o_custkey) AS customers, COUNT(DISTINCT l.l_partkey) AS parts, SUM(l.l_quantity) AS quantity, AVG(l.l_quantity) AS mean FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderstatus")
_add("join_many_to_many", "SELECT COUNT(*) AS cnt, SUM(CAST(a.l_linenumber AS BIGINT)) AS numbers FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey", "SELECT COUNT(*) AS cnt, CAST(SUM(a.l_linenumber) AS BIGINT) AS numbers FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey")
_add("join_rank", "SELECT o.o_custkey, l.l_orderkey, l.l_extendedprice, CAST(RANK() OVER (PARTITION BY o.o_custkey ORDER BY l.l_extendedprice DESC) AS BIGINT) AS rnk FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey")
_add("join_five_tables", "SELECT r.r_name, n.n_name, COUNT(*) AS cnt, SUM(l.l_quantity) AS quantity FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY r.r_name, n.n_name")
_add("left_join_null_count", "SELECT COUNT(*) AS cnt, COUNT(l.l_orderkey) AS matched FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey")
_add("right_join", "SELECT o.o_orderstatus, COUNT(*) AS cnt FROM lineitem l RIGHT JOIN orders o ON o.o_orderkey = l.l_orderkey AND l.l_quantity > 45 WHERE l.l_orderkey IS NULL GROUP BY o.o_orderstatus")
_add("full_join", "SELECT COUNT(*) AS cnt, COUNT(c.c_custkey) AS customers, COUNT(s.s_suppkey) AS suppliers FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey + 50")
_add("semi_join", "SELECT o_orderkey FROM orders LEFT SEMI JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity = 50", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey AND l_quantity = 50)")
_add("anti_join", "SELECT o_orderkey FROM orders LEFT ANTI JOIN lineitem ON o_orderkey = l_orderkey", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey)")
_add("cross_join_small", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
_add("theta_join", "SELECT a.n_name AS first_name, b.n_name AS second_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_add("using_join", "SELECT n_nationkey, COUNT(*) AS cnt FROM (SELECT c_nationkey AS n_nationkey FROM customer) JOIN nation USING (n_nationkey) GROUP BY n_nationkey", "SELECT n_nationkey, COUNT(*) AS cnt FROM (SELECT c_nationkey AS n_nationkey FROM customer) AS c JOIN nation USING (n_nationkey) GROUP BY n_nationkey")
_add("multi_key_join", "SELECT COUNT(*) AS cnt FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
_add("join_star", "SELECT * FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey")
_add("join_limit_star", "SELECT o.*, l.l_partkey, l.l_linenumber, l.l_quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey ORDER BY o.o_totalprice DESC, o.o_orderkey, l.l_extendedprice DESC, l.l_partkey LIMIT 100")
_add("join_sum_product", "SELECT COUNT(*) AS cnt, CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_quantity AS DECIMAL(6,0))) AS DOUBLE) AS revenue FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey")
_add("natural_join", "SELECT n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region)", "SELECT n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) AS r")
_add("join_hint_broadcast", "SELECT /*+ BROADCAST(n) */ n.n_name, COUNT(*) AS cnt FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
_add("join_hint_merge", "SELECT /*+ MERGE(l) */ o.o_orderstatus, COUNT(*) AS cnt FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderstatus")
_add("lateral_join", "SELECT n.n_name, t.c_custkey, t.c_acctbal FROM nation n, LATERAL (SELECT c_custkey, c_acctbal FROM customer c WHERE c.c_nationkey = n.n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) AS t")

# The published benchmark's twelve queries; sums are exact decimals, and orders that limit rows are total.
_PRICE, _GROSS = "CAST(o_totalprice AS DECIMAL(12,2))", "CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_quantity AS DECIMAL(6,0))"
_add("bench_q1", f"SELECT COUNT(*) AS cnt, CAST(SUM({_PRICE}) AS DOUBLE) AS total, CAST(SUM({_PRICE}) AS DOUBLE) / COUNT(*) AS mean, MIN(o_totalprice) AS least, MAX(o_totalprice) AS most FROM orders")
_add("bench_q2", f"SELECT o_orderstatus, COUNT(*) AS cnt, CAST(SUM({_PRICE}) AS DOUBLE) AS total FROM orders GROUP BY o_orderstatus ORDER BY cnt DESC, o_orderstatus")
_add("bench_q3", "SELECT * FROM orders WHERE o_totalprice > 500 AND o_custkey > 5 ORDER BY o_orderkey LIMIT 1000")
_add("bench_q4", f"SELECT o_orderstatus, CAST(SUM({_PRICE}) AS DOUBLE) / COUNT(*) AS mean, CAST(SUM(o_custkey) AS BIGINT) AS total FROM orders WHERE o_totalprice > 100 GROUP BY o_orderstatus")
_add("bench_q5", f"SELECT COUNT(*) AS cnt, CAST(SUM({_GROSS}) AS DOUBLE) AS revenue, CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*) AS mean FROM lineitem")
_add("bench_q6", "SELECT l_partkey, COUNT(*) AS cnt, SUM(l_quantity) AS qty FROM lineitem GROUP BY l_partkey ORDER BY cnt DESC, l_partkey LIMIT 20")
_add("bench_q7", "SELECT * FROM lineitem WHERE l_extendedprice > 100 AND l_quantity > 5 ORDER BY l_orderkey, l_extendedprice, l_partkey LIMIT 1000")
_add("bench_q8", f"SELECT l_partkey, CAST(SUM({_GROSS}) AS DOUBLE) AS revenue FROM lineitem GROUP BY l_partkey ORDER BY revenue DESC, l_partkey LIMIT 20")
_add("bench_q9", f"SELECT o.o_custkey, COUNT(*) AS order_count, CAST(SUM({_GROSS}) AS DOUBLE) AS total_revenue FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_custkey ORDER BY total_revenue DESC, o.o_custkey LIMIT 20")
_add("bench_q10", "SELECT o.o_orderstatus, COUNT(DISTINCT o.o_orderkey) AS order_count, SUM(l.l_quantity) AS total_items, CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*) AS mean_price FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderstatus")
_add("bench_q11", "SELECT o_custkey, o_orderkey, o_totalprice, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS rnk FROM orders")
_add("bench_q12", "SELECT l_partkey, l_orderkey, l_extendedprice, CAST(ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey) AS BIGINT) AS row_num FROM lineitem")

# Windows.
_add("win_rank_partition", "SELECT o_custkey, o_orderkey, o_totalprice, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS rnk FROM orders")
_add("win_top_per_group", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS rn FROM orders) AS t WHERE rn <= 3")
_add("win_running_sum_partition", "SELECT l_orderkey, l_extendedprice, SUM(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM lineitem")
_add("win_running_sum_peers", "SELECT l_orderkey, l_extendedprice, SUM(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_linenumber) AS running FROM lineitem")
_add("win_lag_lead", "SELECT o_custkey, o_orderkey, LAG(o_totalprice, 1) OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS before, LEAD(o_totalprice, 1) OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS after FROM orders")
_add("win_avg_partition", "SELECT l_orderkey, l_extendedprice, AVG(l_quantity) OVER (PARTITION BY l_orderkey) AS mean FROM lineitem")
_add("win_count_partition", "SELECT o_orderkey, o_orderstatus, COUNT(*) OVER (PARTITION BY o_orderstatus) AS cnt FROM orders")
_add("win_minmax_partition", "SELECT o_orderkey, MIN(o_totalprice) OVER (PARTITION BY o_orderstatus) AS least, MAX(o_totalprice) OVER (PARTITION BY o_orderstatus) AS most FROM orders")
_add("win_dense_rank", "SELECT l_orderkey, l_extendedprice, CAST(DENSE_RANK() OVER (PARTITION BY l_partkey ORDER BY l_quantity) AS BIGINT) AS rnk FROM lineitem")
_add("win_moving", "SELECT l_orderkey, l_extendedprice, SUM(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_extendedprice ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM lineitem")
_add("win_range_offset", "SELECT o_custkey, o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 10000 PRECEDING AND CURRENT ROW) AS near FROM orders")
_add("ntile", "SELECT o_custkey, o_orderkey, CAST(NTILE(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS BIGINT) AS quarter FROM orders")
_add("first_last_value", "SELECT o_custkey, o_orderkey, FIRST_VALUE(o_orderkey) OVER w AS cheapest, LAST_VALUE(o_orderkey) OVER w AS dearest FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
_add("nth_value", "SELECT o_custkey, o_orderkey, NTH_VALUE(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_totalprice ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders")
_add("percent_rank_cume_dist", "SELECT o_custkey, o_orderkey, PERCENT_RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS pr, CUME_DIST() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS cd FROM orders")

# Set operations, subqueries, common tables.
_add("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
_add("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
_add("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
_add("except", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey AS k FROM lineitem")
_add("cte", "WITH big AS (SELECT o_custkey, COUNT(*) AS cnt FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey) SELECT c.c_mktsegment, SUM(b.cnt) AS cnt FROM big b JOIN customer c ON c.c_custkey = b.o_custkey GROUP BY c.c_mktsegment", "WITH big AS (SELECT o_custkey, COUNT(*) AS cnt FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey) SELECT c.c_mktsegment, CAST(SUM(b.cnt) AS BIGINT) AS cnt FROM big b JOIN customer c ON c.c_custkey = b.o_custkey GROUP BY c.c_mktsegment")
_add("recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t")
_add("exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
_add("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
_add("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
_add("correlated_scalar", "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")

_add("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier")
_add("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier")

# More aggregates.
_add("approx_count_distinct", "SELECT o_orderstatus, ABS(APPROX_COUNT_DISTINCT(o_custkey) - COUNT(DISTINCT o_custkey)) <= 0.2 * COUNT(DISTINCT o_custkey) AS near FROM orders GROUP BY o_orderstatus")
_add("first_last", "SELECT o_orderkey, FIRST(o_orderstatus) AS first_status, LAST(o_totalprice) AS last_price, ANY_VALUE(o_custkey) AS customer FROM orders GROUP BY o_orderkey")
_add("count_if_mode", "SELECT l_returnflag, COUNT_IF(l_quantity > 25) AS large, MAX(l_quantity) - MIN(l_quantity) AS spread FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(COUNT_IF(l_quantity > 25) AS BIGINT) AS large, MAX(l_quantity) - MIN(l_quantity) AS spread FROM lineitem GROUP BY l_returnflag")
_add("regr", "SELECT ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 4) AS slope, REGR_COUNT(l_extendedprice, l_quantity) AS n, ROUND(COVAR_POP(l_quantity, l_discount), 6) AS covariance FROM lineitem", "SELECT ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 4) AS slope, CAST(REGR_COUNT(l_extendedprice, l_quantity) AS BIGINT) AS n, ROUND(COVAR_POP(l_quantity, l_discount), 6) AS covariance FROM lineitem")

# Scalar functions.
_add("string_fns", "SELECT c_custkey, UPPER(c_name) AS up, LOWER(c_name) AS low, LENGTH(c_name) AS len, SUBSTRING(c_name, 1, 4) AS head, REPLACE(c_name, '#', '-') AS dashed, CONCAT(c_name, '/', c_mktsegment) AS joined, LPAD(c_mktsegment, 12, '*') AS padded, REVERSE(c_mktsegment) AS back, TRIM('  x ') AS trimmed, LEFT(c_name, 3) AS l3, RIGHT(c_name, 3) AS r3, REPEAT('ab', 2) AS twice, SPLIT_PART(c_name, '#', 2) AS part, MD5(c_name) AS hash FROM customer",
     "SELECT c_custkey, UPPER(c_name) AS up, LOWER(c_name) AS low, CAST(LENGTH(c_name) AS INTEGER) AS len, SUBSTRING(c_name, 1, 4) AS head, REPLACE(c_name, '#', '-') AS dashed, CONCAT(c_name, '/', c_mktsegment) AS joined, LPAD(c_mktsegment, 12, '*') AS padded, REVERSE(c_mktsegment) AS back, TRIM('  x ') AS trimmed, LEFT(c_name, 3) AS l3, RIGHT(c_name, 3) AS r3, REPEAT('ab', 2) AS twice, SPLIT_PART(c_name, '#', 2) AS part, MD5(c_name) AS hash FROM customer")
_add("regex_fns", "SELECT p_partkey, REGEXP_REPLACE(p_name, '[aeiou]', '_') AS masked, REGEXP_LIKE(p_type, '^[A-Z]+ ') AS words FROM part", "SELECT p_partkey, REGEXP_REPLACE(p_name, '[aeiou]', '_', 'g') AS masked, REGEXP_MATCHES(p_type, '^[A-Z]+ ') AS words FROM part")
_add("math_fns", "SELECT l_orderkey, l_extendedprice, ABS(-l_quantity) AS positive, CEIL(l_discount * 10) AS up, FLOOR(l_discount * 10) AS down, SQRT(l_quantity) AS root, POWER(l_quantity, 2) AS square, SIGN(l_discount - 0.05) AS sgn, GREATEST(l_quantity, 25.0) AS most, LEAST(l_quantity, 25.0) AS least, l_linenumber % 3 AS rest FROM lineitem",
     "SELECT l_orderkey, l_extendedprice, ABS(-l_quantity) AS positive, CAST(CEIL(l_discount * 10) AS BIGINT) AS up, CAST(FLOOR(l_discount * 10) AS BIGINT) AS down, SQRT(l_quantity) AS root, POWER(l_quantity, 2) AS square, CAST(SIGN(l_discount - 0.05) AS DOUBLE) AS sgn, GREATEST(l_quantity, 25.0) AS most, LEAST(l_quantity, 25.0) AS least, l_linenumber % 3 AS rest FROM lineitem")
_add("date_fns", "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS BIGINT) AS d, CAST(o_orderdate AS DATE) AS day, CAST(DATE_TRUNC('MONTH', o_orderdate) AS DATE) AS month_start FROM orders")
_add("date_group", "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, COUNT(*) AS cnt, MAX(o_totalprice) AS most FROM orders GROUP BY 1")
_add("date_filter", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01'")
_add("events_by_hour", "SELECT CAST(EXTRACT(HOUR FROM ts) AS BIGINT) AS h, event_type, COUNT(*) AS cnt FROM events GROUP BY 1, 2")
_add("array_fns", "SELECT vec_id, CAST(SIZE(embedding) AS BIGINT) AS n, ARRAY_CONTAINS(ARRAY(1, 2, 3), label) AS low FROM embeddings", "SELECT vec_id, CAST(LEN(embedding) AS BIGINT) AS n, LIST_CONTAINS([1, 2, 3], label) AS low FROM embeddings")
_add("unnest", "SELECT n_nationkey, x FROM nation LATERAL VIEW EXPLODE(SEQUENCE(1, 3)) t AS x", "SELECT n_nationkey, CAST(UNNEST(RANGE(1, 4)) AS INTEGER) AS x FROM nation")
_add("json_fns", "SELECT event_id, GET_JSON_OBJECT(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
_add("string_more", "SELECT c_custkey, CONCAT_WS('-', c_name, c_mktsegment) AS joined, TRANSLATE(c_mktsegment, 'AEIOU', '12345') AS digits, LEVENSHTEIN(c_name, c_mktsegment) AS apart, OCTET_LENGTH(c_name) AS bytes, SHA2(c_name, 256) AS sha, LTRIM('  x ') AS l, RTRIM(' x  ') AS r, BTRIM(' x ') AS b, RPAD(c_mktsegment, 12, '*') AS padded, ASCII(c_mktsegment) AS code, CHR(65) AS letter, INSTR(c_name, '#') AS at, POSITION('#' IN c_name) AS pos, CONTAINS(c_name, '#') AS has FROM customer",
     "SELECT c_custkey, CONCAT_WS('-', c_name, c_mktsegment) AS joined, TRANSLATE(c_mktsegment, 'AEIOU', '12345') AS digits, CAST(LEVENSHTEIN(c_name, c_mktsegment) AS INTEGER) AS apart, CAST(STRLEN(c_name) AS INTEGER) AS bytes, SHA256(c_name) AS sha, LTRIM('  x ') AS l, RTRIM(' x  ') AS r, TRIM(' x ') AS b, RPAD(c_mktsegment, 12, '*') AS padded, ASCII(c_mktsegment) AS code, CHR(65) AS letter, CAST(INSTR(c_name, '#') AS INTEGER) AS at, CAST(POSITION('#' IN c_name) AS INTEGER) AS pos, CONTAINS(c_name, '#') AS has FROM customer")
_add("string_names", "SELECT c_custkey, STRPOS(c_name, '#') AS at, STARTS_WITH(c_name, 'Cust') AS head, ENDS_WITH(c_name, '9') AS tail, TO_HEX(c_custkey) AS hexed FROM customer",
     "SELECT c_custkey, CAST(STRPOS(c_name, '#') AS INTEGER) AS at, STARTS_WITH(c_name, 'Cust') AS head, SUFFIX(c_name, '9') AS tail, LOWER(TO_HEX(c_custkey)) AS hexed FROM customer")
_add("regex_more", "SELECT c_custkey, REGEXP_EXTRACT(c_name, '([A-Za-z]+)#(0*)([0-9]+)', 3) AS number, REGEXP_LIKE(c_name, '#0+1') AS one, SIZE(SPLIT(c_name, '[#0]+')) AS parts FROM customer", "SELECT c_custkey, REGEXP_EXTRACT(c_name, '([A-Za-z]+)#(0*)([0-9]+)', 3) AS number, REGEXP_MATCHES(c_name, '#0+1') AS one, CAST(LEN(STRING_SPLIT_REGEX(c_name, '[#0]+')) AS INTEGER) AS parts FROM customer")
_add("math_more", "SELECT l_orderkey, l_extendedprice, ROUND(EXP(l_discount), 9) AS e, ROUND(LN(l_quantity), 9) AS ln, ROUND(LOG10(l_quantity), 9) AS l10, ROUND(LOG2(l_quantity), 9) AS l2, ROUND(SIN(l_quantity), 9) AS s, ROUND(COS(l_quantity), 9) AS c, ROUND(TAN(l_discount), 9) AS t, ROUND(ASIN(l_discount), 9) AS asn, ROUND(ATAN2(l_discount, l_quantity), 9) AS at2, ROUND(CBRT(l_quantity), 9) AS root, ROUND(DEGREES(l_discount), 9) AS deg, ROUND(RADIANS(l_quantity), 9) AS rad, ROUND(PI(), 9) AS pi, MOD(l_linenumber, 3) AS rest, ISNAN(l_quantity) AS odd FROM lineitem")
_add("math_whole", "SELECT n_nationkey, FACTORIAL(5) AS f, GCD(n_nationkey, 12) AS g, LCM(n_nationkey, 12) AS l, n_nationkey & 3 AS both, n_nationkey | 3 AS any_bit, n_nationkey << 2 AS four FROM nation",
     "SELECT n_nationkey, CAST(FACTORIAL(5) AS BIGINT) AS f, CAST(GCD(n_nationkey, 12) AS BIGINT) AS g, CAST(LCM(n_nationkey, 12) AS BIGINT) AS l, n_nationkey & 3 AS both, n_nationkey | 3 AS any_bit, n_nationkey << 2 AS four FROM nation")
_add("date_more", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL '10' DAY AS later, DATEDIFF(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS days, LAST_DAY(o_orderdate) AS month_end, CAST(EXTRACT(QUARTER FROM o_orderdate) AS BIGINT) AS q, CAST(EXTRACT(WEEK FROM o_orderdate) AS BIGINT) AS w, CAST(EXTRACT(DOY FROM o_orderdate) AS BIGINT) AS doy, MAKE_DATE(1999, 2, 3) AS made, CAST(ADD_MONTHS(o_orderdate, 1) AS DATE) AS next_month, UNIX_SECONDS(CAST(o_orderdate AS TIMESTAMP)) AS epoch, DATE_FORMAT(o_orderdate, 'yyyy/MM/dd') AS shown FROM orders",
     "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 DAY AS DATE) AS later, CAST(DATEDIFF('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER) AS days, LAST_DAY(o_orderdate) AS month_end, EXTRACT(QUARTER FROM o_orderdate) AS q, EXTRACT(WEEK FROM o_orderdate) AS w, EXTRACT(DOY FROM o_orderdate) AS doy, MAKE_DATE(1999, 2, 3) AS made, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS next_month, CAST(EPOCH(o_orderdate) AS BIGINT) AS epoch, STRFTIME(o_orderdate, '%Y/%m/%d') AS shown FROM orders")
_add("date_bin", "SELECT event_id, UNIX_SECONDS(DATE_BIN(INTERVAL '15' MINUTE, CAST(ts AS TIMESTAMP), TIMESTAMP '2000-01-01 00:00:00')) AS bin FROM events", "SELECT event_id, CAST(EPOCH(TIME_BUCKET(INTERVAL 15 MINUTE, ts, TIMESTAMP '2000-01-01 00:00:00')) AS BIGINT) AS bin FROM events")
_add("array_more", "SELECT n_nationkey, ARRAY_JOIN(ARRAY_SORT(ARRAY_DISTINCT(ARRAY(n_nationkey, n_regionkey, 3, 3))), ',') AS sorted, ELEMENT_AT(ARRAY(n_nationkey, 7), 2) AS second, ARRAY_POSITION(ARRAY(5, n_regionkey), n_regionkey) AS at, ARRAY_MAX(ARRAY(n_nationkey, 9)) AS most, ARRAY_JOIN(TRANSFORM(SLICE(ARRAY(1, 2, 3, 4), 2, 2), x -> x * n_nationkey), ',') AS times, ARRAY_JOIN(FILTER(ARRAY(1, 2, 3, 4), x -> x > n_regionkey), ',') AS above, ARRAY_JOIN(CONCAT(ARRAY(1), ARRAY(n_regionkey)), ',') AS both, AGGREGATE(ARRAY(1, 2, n_nationkey), 0, (a, x) -> a + x) AS total, ARRAY_JOIN(FLATTEN(ARRAY(ARRAY(1, 2), ARRAY(n_regionkey))), ',') AS flat FROM nation",
     "SELECT n_nationkey, ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT([n_nationkey, n_regionkey, 3, 3])), ',') AS sorted, LIST_EXTRACT([n_nationkey, 7], 2) AS second, CAST(LIST_POSITION([5, n_regionkey], n_regionkey) AS BIGINT) AS at, LIST_MAX([n_nationkey, 9]) AS most, ARRAY_TO_STRING(LIST_TRANSFORM(([1, 2, 3, 4])[2:3], lambda x: x * n_nationkey), ',') AS times, ARRAY_TO_STRING(LIST_FILTER([1, 2, 3, 4], lambda x: x > n_regionkey), ',') AS above, ARRAY_TO_STRING(LIST_CONCAT([1], [n_regionkey]), ',') AS both, CAST(LIST_SUM([1, 2, n_nationkey]) AS INTEGER) AS total, ARRAY_TO_STRING(FLATTEN([[1, 2], [n_regionkey]]), ',') AS flat FROM nation")
_add("struct_map", "SELECT n_nationkey, s.name AS name, s.at.region AS region, ELEMENT_AT(m, 'a') AS a, SIZE(MAP_KEYS(m)) AS n, ARRAY_JOIN(ARRAY_SORT(MAP_KEYS(m)), ',') AS ks FROM (SELECT n_nationkey, NAMED_STRUCT('name', n_name, 'at', NAMED_STRUCT('region', n_regionkey)) AS s, MAP('a', n_nationkey, 'b', n_regionkey) AS m FROM nation) AS t",
     "SELECT n_nationkey, s.name AS name, s.at.region AS region, m['a'] AS a, CAST(LEN(MAP_KEYS(m)) AS INTEGER) AS n, ARRAY_TO_STRING(LIST_SORT(MAP_KEYS(m)), ',') AS ks FROM (SELECT n_nationkey, STRUCT_PACK(name := n_name, at := STRUCT_PACK(region := n_regionkey)) AS s, MAP {'a': n_nationkey, 'b': n_regionkey} AS m FROM nation) AS t")
_add("type_of", "SELECT DISTINCT UPPER(TYPEOF(o_orderkey)) AS key, UPPER(TYPEOF(o_totalprice)) AS price, UPPER(TYPEOF(CAST(o_orderdate AS DATE))) AS day, UPPER(TYPEOF(o_totalprice > 1)) AS flag FROM orders")
