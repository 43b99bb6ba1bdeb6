"""Scans, joins, aggregation, windows, sorts, set operations, subqueries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basalt.operators import recursive, spread, subquery
from basalt.operators.ordering import order
from basalt.session import table

from .registry import query, statement

PRICING = """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus
"""
statement("pricing_summary", PRICING)

# --- scans ----------------------------------------------------------------------------------------
statement("scan_all", "SELECT * FROM nation")
statement("scan_columns", "SELECT o_orderkey, o_totalprice FROM orders")
statement("pk_lookup", "SELECT * FROM orders WHERE o_orderkey = 77")
statement("pk_range", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 500")
statement("multi_index_and", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 AND l_discount >= 0.05")
statement("multi_index_or", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = 3 OR l_partkey = 11")
statement("composite_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '3-MEDIUM'")
statement("index_ordered", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
statement("keyset_page", "SELECT o_orderkey FROM orders WHERE o_orderkey > 120 ORDER BY o_orderkey LIMIT 20")
statement("min_max", "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS first_day FROM orders")
statement("count_star", "SELECT count(*) AS n FROM lineitem")
statement("count_distinct", "SELECT count(DISTINCT l_suppkey) AS n, count(DISTINCT l_returnflag) AS f FROM lineitem")
statement("values_source", "SELECT n_nationkey, b FROM nation JOIN (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b) ON n_regionkey = a")
statement("derived_table", "SELECT s, count(*) AS n FROM (SELECT o_orderstatus AS s FROM orders WHERE o_totalprice > 1000) AS d GROUP BY s")
statement("select_without_from", "SELECT n_nationkey, (SELECT 1 + 2) AS a, (SELECT 'x' || 'y') AS b, upper(n_name) AS c FROM nation")


@query("view_scan", "SELECT c_mktsegment, count(*) AS n FROM (SELECT * FROM customer WHERE c_acctbal > 0) AS rich GROUP BY c_mktsegment")
def view_scan(spark, sf_dir):
    table(spark, sf_dir, "customer").where("c_acctbal > 0").createOrReplaceTempView("rich_customers")
    return spark.sql("SELECT c_mktsegment, count(*) AS n FROM rich_customers GROUP BY c_mktsegment")


@query("json_rows", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS value FROM region")
def json_rows(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.to_json(F.struct("r_regionkey", "r_name")).alias("value"))


# --- predicates and expressions -------------------------------------------------------------------
statement("tuple_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('R', 'F')) AND l_quantity < 3")
statement("in_not_in", "SELECT n_name FROM nation WHERE n_regionkey IN (0, 2) AND n_nationkey NOT IN (1, 5, 9)")
statement("like_forms", "SELECT p_partkey, p_name LIKE 'cold%' AS a, p_name LIKE '%widget' AS b, p_type ILIKE 'econ_my' AS c, p_brand NOT LIKE '%3' AS d FROM part")
statement("like_escape", "SELECT x, x LIKE '%!%%' ESCAPE '!' AS pct FROM (SELECT CASE WHEN n_regionkey < 2 THEN n_name || '%' ELSE n_name END AS x FROM nation) AS t")
statement("glob", "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#1?' AND p_name GLOB '*widget'", "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#1?' AND p_name GLOB '*widget'")
statement("regexp", "SELECT p_partkey FROM part WHERE p_brand RLIKE '#[12]$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[12]$')")
statement("three_valued", "SELECT o_orderkey, a, b, a AND b AS x, a OR b AS y, NOT a AS z FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN true WHEN o_totalprice > 50000 THEN false END AS a, CASE WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 3 = 1 THEN false END AS b FROM orders) AS t")
statement("is_distinct", "SELECT o_orderkey, a, b, a IS DISTINCT FROM b AS d, a IS NOT DISTINCT FROM b AS s, a IS NULL AS n, a = b AS e, a <> b AS f, a < b AS g, a >= b AS h FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 4 END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4 END AS b FROM orders) AS t")
statement("bool_tests", "SELECT o_orderkey, (o_totalprice > 100000) IS TRUE AS big, (o_orderstatus = 'F') IS NOT FALSE AS f FROM orders")
statement("xor", "SELECT o_orderkey, xor(o_totalprice > 100000, o_orderstatus = 'F') AS x FROM orders", "SELECT o_orderkey, (o_totalprice > 100000) <> (o_orderstatus = 'F') AS x FROM orders")
statement("bit_operators", "SELECT o_orderkey, o_orderkey & 7 AS a, o_orderkey | 8 AS b, ~o_orderkey AS c, o_orderkey << 2 AS d, o_orderkey >> 1 AS e FROM orders")
statement("case_forms", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS a, CASE WHEN o_totalprice > 100000 THEN 1 WHEN o_totalprice > 50000 THEN 2 END AS b FROM orders")
statement("concat_operator", "SELECT n_nationkey, a || b AS c FROM (SELECT n_nationkey, n_name AS a, CASE WHEN n_regionkey <> 2 THEN n_name END AS b FROM nation) AS t")
statement("intervals", "SELECT o_orderkey, o_orderdate + INTERVAL '1 day' AS a, o_orderdate - INTERVAL '2 months' AS b, o_orderdate + INTERVAL '3 hours' AS c FROM orders")
statement("alias_in_where", "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS q2 FROM lineitem) AS a WHERE q2 > 95")
statement("typed_literals", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01 00:00:00'")


@query("parameters", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F'")
def parameters(spark, sf_dir):
    from basalt.engine import Engine

    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return Engine(spark).sql("SELECT o_orderkey FROM orders WHERE o_totalprice > $1 AND o_orderstatus = $2", [150000, "F"])


# --- joins ----------------------------------------------------------------------------------------
statement("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
statement("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 180000")
statement("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'")
statement("join_full", "SELECT s.s_suppkey, c.c_custkey FROM (SELECT * FROM supplier WHERE s_suppkey < 20) AS s FULL OUTER JOIN (SELECT * FROM customer WHERE c_custkey BETWEEN 10 AND 40) AS c ON s.s_suppkey = c.c_custkey")
statement("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
statement("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
statement("join_natural", "SELECT * FROM (SELECT n_nationkey, n_name FROM nation) AS a NATURAL JOIN (SELECT n_nationkey, n_regionkey FROM nation) AS b")
statement("join_using", "SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem JOIN (SELECT o_orderkey AS l_orderkey, o_totalprice FROM orders) AS o USING (l_orderkey) WHERE l_quantity > 48")
statement("join_residual", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice / 2")
statement("join_range", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier AS a JOIN supplier AS b ON a.s_acctbal < b.s_acctbal AND b.s_acctbal < a.s_acctbal + 50")
statement("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
statement("join_null_keys", "SELECT n_nationkey, b.v FROM (SELECT n_nationkey, CASE WHEN n_regionkey <> 2 THEN n_regionkey END AS k FROM nation) AS a LEFT JOIN (SELECT CASE WHEN r_regionkey <> 3 THEN r_regionkey END AS k, r_name AS v FROM region) AS b ON a.k = b.k")
statement("join_three", "SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
statement("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
statement("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
statement("not_in_nulls", "SELECT 'none' AS what, count(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey > 0 THEN r_regionkey END FROM region) UNION ALL SELECT 'some', count(*) FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)")

# --- aggregation ----------------------------------------------------------------------------------
statement("agg_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_discount), 8) AS a, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem")
statement("agg_expression", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)")
statement("agg_position", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
statement("agg_alias", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY s")
statement("having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 100 AND count(*) > 3")
statement("agg_only_in_order", "SELECT l_suppkey FROM lineitem GROUP BY l_suppkey ORDER BY sum(l_quantity) DESC, l_suppkey LIMIT 5")
statement("post_aggregate", "SELECT l_returnflag, CASE WHEN sum(l_quantity) > 1000 THEN 'many' ELSE 'few' END AS size, round(sum(l_tax) / count(*), 8) AS t FROM lineitem GROUP BY l_returnflag")
statement("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS c, sum(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_returnflag")
statement("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS urgent FROM orders GROUP BY o_orderstatus")
statement("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
statement("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
statement("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
statement("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
statement("statistics_aggregates", "SELECT l_returnflag, round(stddev(l_quantity), 6) AS a, round(variance(l_quantity), 6) AS b, round(stddev_samp(l_quantity), 6) AS c, round(var_samp(l_quantity), 6) AS d, round(stddev_pop(l_tax), 8) AS e, round(var_pop(l_tax), 8) AS f, median(l_quantity) AS m FROM lineitem GROUP BY l_returnflag",
          "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS a, round(var_pop(l_quantity), 6) AS b, round(stddev_samp(l_quantity), 6) AS c, round(var_samp(l_quantity), 6) AS d, round(stddev_pop(l_tax), 8) AS e, round(var_pop(l_tax), 8) AS f, median(l_quantity) AS m FROM lineitem GROUP BY l_returnflag")
statement("string_agg", "SELECT n_regionkey, listagg(n_name, '; ') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
statement("array_agg", "SELECT n_regionkey, to_json(sort_array(collect_list(n_nationkey))) AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '[' || string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) || ']' AS keys FROM nation GROUP BY n_regionkey")
statement("first_last", "SELECT o_custkey, min_by(o_orderstatus, o_orderkey) AS f, max_by(o_orderstatus, o_orderkey) AS l FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS f, arg_max(o_orderstatus, o_orderkey) AS l FROM orders GROUP BY o_custkey")
statement("safe_sum", "SELECT l_returnflag, round(safe_sum(l_orderkey * 1000000000000) * power(10, -18), 3) AS s FROM lineitem GROUP BY l_returnflag",
          "SELECT l_returnflag, round(sum((l_orderkey * 1000000000000)::DOUBLE) * power(10, -18), 3) AS s FROM lineitem GROUP BY l_returnflag")

# --- windows --------------------------------------------------------------------------------------
@query("window_ranks", "SELECT o_orderkey, row_number() OVER w AS a, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS b, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS c, ntile(4) OVER w AS d FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)")
def window_ranks(spark, sf_dir):
    """Three statuses: places are those of sorted ranges, ranks are sums over counted keys."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    rows = spread.ranked(spread.numbered(o, ["o_orderstatus"], [order("o_totalprice"), order("o_orderkey")], size="_rows"), ["o_orderstatus"], {"o_orderpriority": False})
    return rows.select("o_orderkey", *[c.cast("int").alias(k) for k, c in zip("abcd", (F.col("_n"), F.col("_rank"), F.col("_dense"), spread.tile(F.col("_n"), F.col("_rows"), 4)), strict=True)])


@query("window_percent", "SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority), 8) AS p, round(cume_dist() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority), 8) AS c FROM orders")
def window_percent(spark, sf_dir):
    rows = spread.ranked(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus"], {"o_orderpriority": False})
    before = F.col("_rank") - 1
    p, c = before / F.greatest(F.col("_size") - 1, F.lit(1)), (before + F.col("_peers")) / F.col("_size")
    return rows.select("o_orderkey", F.round(p, 8).alias("p"), F.round(c, 8).alias("c"))


statement("window_lead_lag", "SELECT o_orderkey, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, lag(o_totalprice, 2, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders")
statement("window_values", "SELECT o_orderkey, first_value(o_totalprice) OVER w AS a, last_value(o_totalprice) OVER w AS b, nth_value(o_totalprice, 2) OVER w AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
statement("window_rows", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")

@query("window_range", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_returnflag ORDER BY l_suppkey RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS n FROM lineitem WHERE l_quantity > 45")
def window_range(spark, sf_dir):
    """Rows of a supplier are counted first, so that the frames run over suppliers."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey")
    held = rows.groupBy(F.col("l_returnflag").alias("_f"), F.col("l_suppkey").alias("_k")).agg(F.count("*").alias("_m"))
    near = W.partitionBy("_f").orderBy(order("_k")).rangeBetween(-3, W.currentRow)
    facts = spread.kept(held.withColumn("n", F.sum("_m").over(near)))
    return spread.with_facts(rows, facts, {"l_returnflag": "_f", "l_suppkey": "_k"}, "_m").drop("l_returnflag", "l_suppkey", "_m")


statement("window_over_group", "SELECT o_orderstatus, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM orders GROUP BY o_orderstatus")


@query("window_default_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS s, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS d FROM orders")
def window_default_frame(spark, sf_dir):
    from basalt.operators.ordering import distinct_over, window

    o = table(spark, sf_dir, "orders")
    running = window(["o_custkey"], [order("o_orderdate"), order("o_orderkey")])
    return o.select("o_orderkey", F.round(F.sum("o_totalprice").over(running), 2).alias("s"), distinct_over("o_orderpriority", window(["o_custkey"])).alias("d"))


# --- sort, limit ----------------------------------------------------------------------------------
@query("nulls_order", "SELECT o_orderkey, row_number() OVER (ORDER BY x NULLS LAST, o_orderkey) AS up, row_number() OVER (ORDER BY x DESC NULLS FIRST, o_orderkey) AS down FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS x FROM orders) AS t")
def nulls_order(spark, sf_dir):
    """No partition: the places in both orders are those of sorted ranges."""
    x = F.when(F.col("o_orderstatus") != "F", F.col("o_custkey"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", x.alias("x"))
    for name, ascending in (("up", True), ("down", False)):
        rows = spread.numbered(rows, [], [order("x", ascending), order("o_orderkey")], name).drop("_size")
    return rows.select("o_orderkey", F.col("up").cast("int"), F.col("down").cast("int"))


statement("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
statement("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 30")
statement("fetch_first", "SELECT o_orderkey FROM orders ORDER BY o_orderkey FETCH FIRST 5 ROWS ONLY")
statement("sort_expression", "SELECT s_suppkey FROM supplier ORDER BY abs(s_acctbal - 1000), s_suppkey LIMIT 12")
statement("sort_position", "SELECT n_regionkey, n_name FROM nation ORDER BY 1 DESC, 2 LIMIT 9")

# --- set operations -------------------------------------------------------------------------------
for _name, _op in (("union_all", "UNION ALL"), ("union", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    statement(f"set_{_name}", f"SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40 {_op} SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30")


@query("set_precedence", "SELECT n_regionkey AS x FROM nation UNION SELECT * FROM (SELECT r_regionkey + 3 FROM region EXCEPT SELECT n_regionkey FROM nation) AS t")
def set_precedence(spark, sf_dir):
    one, two = table(spark, sf_dir, "nation").selectExpr("n_regionkey AS x"), table(spark, sf_dir, "region").selectExpr("r_regionkey + 3 AS x")
    return subquery.combine(one, ("union", two), ("except", one))


# --- subqueries and CTEs --------------------------------------------------------------------------
statement("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
statement("scalar_subquery_empty", "SELECT (SELECT max(o_orderkey) FROM orders WHERE o_orderkey < 0) AS nothing")
statement("correlated_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
statement("correlated_filter", "SELECT o_orderkey FROM orders AS o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders AS i WHERE i.o_custkey = o.o_custkey)")
statement("in_subquery", "SELECT count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
statement("row_in_subquery", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_suppkey, l_linenumber) IN (SELECT s_suppkey, 3 FROM supplier WHERE s_acctbal > 8000)")
statement("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
statement("nested_subquery", "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49.5))")
statement("quantified_all", "SELECT o_orderkey FROM orders WHERE o_totalprice >= ALL (SELECT o_totalprice FROM orders)", "SELECT o_orderkey FROM orders WHERE o_totalprice >= (SELECT max(o_totalprice) FROM orders)")
statement("quantified_any", "SELECT s_suppkey FROM supplier WHERE s_acctbal < ANY (SELECT c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey < 40)", "SELECT s_suppkey FROM supplier WHERE s_acctbal < (SELECT max(c_acctbal) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey < 40)")
statement("quantified_equal", "SELECT n_name FROM nation WHERE n_regionkey = ANY (SELECT r_regionkey FROM region WHERE r_name < 'B') AND n_nationkey <> ALL (SELECT s_nationkey FROM supplier WHERE s_suppkey < 5)", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name < 'B') AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 5)")


statement("quantified_text", "SELECT c_custkey FROM customer WHERE c_name > ALL (SELECT s_name FROM supplier) AND c_mktsegment <= ANY (SELECT r_name FROM region)", "SELECT c_custkey FROM customer WHERE c_name > (SELECT max(s_name) FROM supplier) AND c_mktsegment <= (SELECT max(r_name) FROM region)")
statement("quantified_timestamp", "SELECT o_orderkey, o_orderdate > ANY (SELECT ts FROM events) AS later, o_orderdate <= ALL (SELECT l_shipdate FROM lineitem WHERE l_quantity > 45) AS first FROM orders",
          "SELECT o_orderkey, o_orderdate > (SELECT min(ts) FROM events) AS later, o_orderdate <= (SELECT min(l_shipdate) FROM lineitem WHERE l_quantity > 45) AS first FROM orders")
statement("quantified_all_equal", "SELECT x, x = ALL (SELECT n_regionkey FROM nation WHERE n_nationkey < 5) AS a, x = ALL (SELECT y FROM (VALUES (5), (5)) AS u(y)) AS b, x = ALL (SELECT y FROM (VALUES (5), (NULL)) AS u(y)) AS c FROM (VALUES (1), (5), (NULL)) AS t(x)",
          "SELECT x, CASE WHEN x IS NOT NULL THEN false END AS a, x = 5 AS b, CASE WHEN x <> 5 THEN false END AS c FROM (VALUES (1), (5), (NULL)) AS t(x)")
statement("quantified_any_unequal", "SELECT o_orderkey, o_orderpriority <> ANY (SELECT o_orderpriority FROM orders WHERE o_orderkey < 9) AS a, o_orderkey + 1 <> SOME (SELECT 8) AS b, NOT o_orderkey <> ANY (SELECT 7) AS c FROM orders",
          "SELECT o_orderkey, EXISTS (SELECT 1 FROM orders i WHERE i.o_orderkey < 9 AND i.o_orderpriority <> o.o_orderpriority) AS a, o_orderkey + 1 <> 8 AS b, o_orderkey = 7 AS c FROM orders o")
statement("quantified_empty", "SELECT n_nationkey, n_name > ALL (SELECT r_name FROM region WHERE r_regionkey > 99) AS a, n_name > ANY (SELECT r_name FROM region WHERE r_regionkey > 99) AS b, n_nationkey = ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 99) AS c, n_nationkey <> ANY (SELECT r_regionkey FROM region WHERE r_regionkey > 99) AS d, n_nationkey > ALL (SELECT CAST(NULL AS INTEGER)) AS e FROM nation",
          "SELECT n_nationkey, true AS a, false AS b, true AS c, false AS d, false AS e FROM nation")
statement("quantified_bigint", "SELECT o_orderkey FROM orders WHERE o_orderkey + 9007199254740993 > ALL (SELECT o_orderkey + 9007199254740992 FROM orders WHERE o_orderstatus = 'P')",
          "SELECT o_orderkey FROM orders WHERE o_orderkey + 1 > (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'P')")
statement("quantified_correlated", "SELECT c_custkey FROM customer WHERE c_acctbal > ANY (SELECT o_totalprice / 20 FROM orders WHERE o_custkey = c_custkey)", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT min(o_totalprice / 20) FROM orders WHERE o_custkey = c_custkey)")
statement("in_nothing", "SELECT n_nationkey, n_nationkey IN () AS a, n_nationkey + 1 NOT IN () AS b, CASE WHEN n_name IN ( ) THEN 1 ELSE 2 END AS c FROM nation WHERE NOT n_regionkey IN ()", "SELECT n_nationkey, false AS a, true AS b, 2 AS c FROM nation")


@query("quantified_frame", "SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT max(c_acctbal) - 500 FROM customer) AND s_acctbal > (SELECT min(c_acctbal) FROM customer)")
def quantified_frame(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    out = subquery.quantified(s, "s_acctbal + 500", ">", "ALL", c.select("c_acctbal"))
    return subquery.quantified(out, "s_acctbal", ">", "ANY", c.select("c_acctbal")).select("s_suppkey")


statement("cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey AS c, count(*) AS n FROM big GROUP BY o_custkey) SELECT c, n FROM per WHERE n > 1")
statement("cte_columns", "WITH t(a, b) AS (SELECT n_nationkey, n_name FROM nation) SELECT a, b FROM t WHERE a < 5")
statement("recursive_cte", "WITH RECURSIVE t(id, depth) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey BETWEEN 1 AND 9 UNION ALL SELECT c_custkey, depth + 1 FROM t JOIN customer ON c_custkey = id * 2) SELECT count(*) AS c, sum(id) AS s, max(depth) AS d FROM t",
          "WITH RECURSIVE t(id, depth) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey BETWEEN 1 AND 9 UNION ALL SELECT c_custkey, depth + 1 FROM t JOIN customer ON c_custkey = id * 2) SELECT count(*) AS c, sum(id)::BIGINT AS s, max(depth) AS d FROM t")


statement("recursive_members", "WITH RECURSIVE t(n, how) AS (SELECT r_regionkey + 1, 'a' FROM region UNION ALL SELECT n * 2, how || 'b' FROM t WHERE n < 20 UNION ALL SELECT n * 3, how || 'c' FROM t WHERE n < 9) SELECT n, how FROM t WHERE n <> 4",
          "WITH RECURSIVE s AS (SELECT unnest([1, 2]) AS k), t(n, how) AS (SELECT r_regionkey + 1, 'a' FROM region UNION ALL SELECT CASE WHEN k = 1 THEN n * 2 ELSE n * 3 END, how || CASE WHEN k = 1 THEN 'b' ELSE 'c' END FROM t, s WHERE (k = 1 AND n < 20) OR (k = 2 AND n < 9)) SELECT n, how FROM t WHERE n <> 4")


@query("recursive_loop", "WITH RECURSIVE t(n, p) AS (SELECT r_regionkey, 1 FROM region UNION ALL SELECT n + 1, p * 2 FROM t WHERE n < 6) SELECT n, p FROM t")
def recursive_loop(spark, sf_dir):
    start = table(spark, sf_dir, "region").selectExpr("r_regionkey AS n", "1 AS p")
    return recursive.recurse(start, lambda t: t.where("n < 6").selectExpr("n + 1 AS n", "p * 2 AS p"))


# --- benchmark-like composites --------------------------------------------------------------------
statement("revenue_by_supplier_nation", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
statement("join_group_having", "SELECT c_mktsegment, count(*) AS n, round(avg(o_totalprice), 4) AS a FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment HAVING count(*) > 10")
statement("top_orders_per_customer", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) AS t WHERE r <= 2")
statement("left_join_group", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
