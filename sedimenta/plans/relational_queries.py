"""The relational surface that Catalyst gives: each query is one statement over the tables.

A statement is planned by Spark as it stands; where a function has another name
in the other dialect, the two texts differ in that name alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sedimenta.functions.rewrite import rewrite

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: name: SQL, or the SQL of both dialects parted by ||
STATEMENTS: dict[str, str] = {
    # projections and predicates
    "scan_project": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 49",
    "time_as_timestamp": "SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP_NTZ) AS t FROM events||SELECT event_id, date_trunc('second', ts) AS t FROM events",
    "scale_metric": "SELECT event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events",
    "scale_decimal": "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS cents FROM orders",
    "project_computed": "SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS q, l_linenumber AS n FROM lineitem",
    "select_star": "SELECT * FROM nation",
    "filter_eq_string": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
    "filter_eq_int": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7",
    "filter_range_incl": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 12",
    "filter_range_strict": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_quantity < 12",
    "filter_flip": "SELECT o_orderkey FROM orders WHERE 100 >= o_orderkey AND 5 < o_custkey",
    "filter_and": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey < 50 AND o_orderpriority = '1-URGENT'",
    "filter_or_in_like_null": "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'P' OR o_custkey IN (1, 2, 3)) AND o_orderpriority LIKE '%-%' AND o_totalprice IS NOT NULL AND o_orderstatus <> 'X'",
    "filter_not_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS band FROM orders WHERE NOT (o_orderstatus = 'F')",
    "filter_column_compare": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > l_tax",
    "time_window_prune": "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP_NTZ '2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-12 00:00:00'||SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'",
    # aggregates
    "agg_global": "SELECT count(*) AS n, count(l_quantity) AS c, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, avg(CAST(l_quantity AS BIGINT)) AS a FROM lineitem",
    "agg_empty_input": "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_linenumber) AS lo, max(l_linenumber) AS hi, avg(l_linenumber) AS a FROM lineitem WHERE l_returnflag = 'zz'",
    "agg_group_string": "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus",
    "agg_group_int": "SELECT l_linenumber, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s, min(l_shipdate) AS lo FROM lineitem GROUP BY l_linenumber",
    "agg_group_multi": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s, avg(CAST(l_quantity AS BIGINT)) AS a FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_null_group": "SELECT nullif(event_type, 'click') AS k, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS s FROM events GROUP BY nullif(event_type, 'click')",
    "regroup_subset": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_custkey BETWEEN 10 AND 300 GROUP BY o_orderstatus, o_orderpriority",
    "group_expr": "SELECT (value > 50) AS big, count(*) AS n FROM events GROUP BY (value > 50)",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "count_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag",
    "filtered_agg": "SELECT o_orderstatus, count(*) FILTER (WHERE o_custkey < 100) AS few, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "stddev": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 5) AS v FROM lineitem GROUP BY l_returnflag",
    "corr": "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_discount), 6) AS c FROM lineitem",
    "median": "SELECT event_type, median(CAST(round(value * 100) AS BIGINT)) AS m FROM events GROUP BY event_type",
    "bool_aggs": "SELECT o_orderstatus, bool_and(o_totalprice > 0) AS every_, bool_or(o_custkey = 1) AS some_ FROM orders GROUP BY o_orderstatus",
    "array_agg_sorted": "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey||SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "agg_expression": "SELECT l_returnflag, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * l_linenumber) AS BIGINT) AS s, max(l_quantity - l_linenumber) AS m FROM lineitem GROUP BY l_returnflag",
    "min_max_by": "SELECT o_orderstatus, max_by(o_orderkey, o_orderkey) AS last_, min_by(o_custkey, o_orderkey) AS first_ FROM orders GROUP BY o_orderstatus",
    "percentile_exact": "SELECT event_type, CAST(round(percentile(CAST(round(value * 100) AS BIGINT), 0.9)) AS BIGINT) AS p FROM events GROUP BY event_type||SELECT event_type, CAST(round(quantile_cont(CAST(round(value * 100) AS BIGINT), 0.9)) AS BIGINT) AS p FROM events GROUP BY event_type",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    "join_sort_merge": "SELECT /*+ MERGE(o) */ o_orderkey, c_name FROM orders o JOIN customer c ON o_custkey = c_custkey WHERE o_orderstatus = 'P'",
    "join_broadcast": "SELECT /*+ BROADCAST(c) */ o_orderkey, c_name FROM orders o JOIN customer c ON o_custkey = c_custkey WHERE o_orderstatus = 'O'",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'",
    "join_full": "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey + 50",
    "join_semi": "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'||SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "join_anti": "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'||SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "join_cross": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_using": "SELECT n_nationkey, x.n_name FROM nation x JOIN nation y USING (n_nationkey)",
    "join_natural": "SELECT n_nationkey, n_name FROM nation NATURAL JOIN (SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey = 1) t",
    "join_multi": "SELECT r_name, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "join_self_range": "SELECT count(*) AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) * 0.95 FROM orders)",
    "exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "lateral": "SELECT n_name, t.k FROM nation, LATERAL (SELECT n_nationkey * 10 AS k) t",
    # windows, sorts, limits, set operations
    "win_rank": "SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS nt FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)",
    "win_percent": "SELECT event_id, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "win_lag_lead": "SELECT event_id, lag(event_id) OVER w AS prev, lead(event_id, 2) OVER w AS next2, first_value(event_id) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "win_last_nth": "SELECT event_id, last_value(event_id) OVER w AS l, nth_value(event_id, 2) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_rows_frame": "SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM events",
    "win_range_frame": "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS n FROM events",
    "sort_limit": "SELECT event_id, ts FROM events ORDER BY ts ASC NULLS LAST, event_id LIMIT 10",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20",
    "offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25",
    "union": "SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier",
    "union_all": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "intersect_all": "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT r_regionkey FROM region",
    "except_all": "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region",
    "cte_derived": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM (SELECT * FROM per) t GROUP BY n",
    "values_list": "SELECT k, v FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)",
    # scalar functions
    "str_fns": "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS BIGINT) AS n, substr(p_type, 1, 4) AS s, trim(concat('  ', p_name, ' ')) AS t, replace(p_type, ' ', '_') AS r, split_part(p_type, ' ', 1) AS f, lpad(p_brand, 12, '.') AS lp, reverse(p_brand) AS rv FROM part",
    "regexp_fns": "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '*') AS r, p_name rlike 'a.*e' AS m FROM part||SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '*', 'g') AS r, regexp_matches(p_name, 'a.*e') AS m FROM part",
    "date_fns": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS t FROM orders||SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, quarter(o_orderdate)::INT AS q, date_trunc('month', o_orderdate)::TIMESTAMP AS t FROM orders",
    "date_arith": "SELECT o_orderkey, o_orderdate + INTERVAL '1' DAY AS next_day, CAST(extract(HOUR FROM o_orderdate) AS INT) AS h FROM orders",
    "date_bin": "SELECT event_id, CAST(date_bin(INTERVAL '15 minutes', ts) AS TIMESTAMP_NTZ) AS b FROM events||SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01 00:00:00') AS b FROM events",
    "math_fns": "SELECT event_id, abs(-value) AS a, floor(value) AS f, ceil(value) AS c, round(sqrt(abs(value)), 6) AS s, round(power(value, 2), 4) AS p, round(ln(abs(value) + 1), 6) AS l, round(sin(value), 6) AS si, event_id % 7 AS m FROM events||SELECT event_id, abs(-value) AS a, floor(value)::BIGINT AS f, ceil(value)::BIGINT AS c, round(sqrt(abs(value)), 6) AS s, round(power(value, 2), 4) AS p, round(ln(abs(value) + 1), 6) AS l, round(sin(value), 6) AS si, event_id % 7 AS m FROM events",
    "arithmetic": "SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS a, l_linenumber - 1 AS s, l_linenumber * 3 AS m, l_linenumber / 2 AS d, l_linenumber div 2 AS i FROM lineitem||SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS a, l_linenumber - 1 AS s, l_linenumber * 3 AS m, l_linenumber / 2 AS d, (l_linenumber // 2)::BIGINT AS i FROM lineitem",
    "cond_fns": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS c, greatest(o_custkey, 100) AS g, least(o_custkey, 100) AS l, CASE o_orderstatus WHEN 'O' THEN 1 ELSE 0 END AS k FROM orders",
    "array_fns": "SELECT n_nationkey, size(array(n_nationkey, n_regionkey)) AS n, array_contains(array(1, 2, 3), n_regionkey) AS c, element_at(split(n_name, 'A'), 1) AS e FROM nation||SELECT n_nationkey, len([n_nationkey, n_regionkey])::INT AS n, list_contains([1, 2, 3], n_regionkey) AS c, string_split(n_name, 'A')[1] AS e FROM nation",
    "unnest": "SELECT n_nationkey, explode(sequence(1, n_regionkey + 1)) AS k FROM nation||SELECT n_nationkey, unnest(range(1, n_regionkey + 2))::INT AS k FROM nation",
    "map_fns": "SELECT n_nationkey, map('a', n_nationkey, 'b', n_regionkey)['b'] AS b FROM nation||SELECT n_nationkey, map {'a': n_nationkey, 'b': n_regionkey}['b'] AS b FROM nation",
    "struct_fns": "SELECT n_nationkey, named_struct('k', n_nationkey, 'n', n_name).n AS n FROM nation||SELECT n_nationkey, struct_pack(k := n_nationkey, n := n_name).n AS n FROM nation",
    "hash_fns": "SELECT p_partkey, md5(p_name) AS m, sha2(p_name, 256) AS s, base64(encode(p_brand, 'utf-8')) AS b FROM part||SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s, base64(encode(p_brand)) AS b FROM part",
    "json_props": "SELECT event_id, size(json_object_keys(props)) AS n FROM events||SELECT event_id, len(json_keys(props))::INT AS n FROM events",
    "cast_fns": "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS s, CAST('12' AS INT) AS i, CAST(CAST(o_totalprice AS DECIMAL(12,1)) AS DOUBLE) AS d FROM orders||SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST('12' AS INT) AS i, CAST(CAST(o_totalprice AS DECIMAL(12,1)) AS DOUBLE) AS d FROM orders",
}


def spark_sql(name: str) -> str:
    return STATEMENTS[name].split("||")[0]


def other_sql(name: str) -> str:
    return STATEMENTS[name].split("||")[-1]


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The statement over the directory's tables, in a session of its own."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            own.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return own.sql(rewrite(sql))


def queries() -> dict:
    return {n: (lambda spark, sf_dir, q=spark_sql(n): run(spark, sf_dir, q)) for n in STATEMENTS}


def oracle_sql() -> dict:
    return {n: other_sql(n) for n in STATEMENTS}
