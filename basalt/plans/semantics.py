"""Functions and changes with the reference's semantics, vectors, JSON, time, versions."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from basalt.functions import scalars, windows
from basalt.operators import vectors, versions
from basalt.session import shared, table
from basalt.streaming import events as streaming

from .registry import query, statement

# --- scalar functions -----------------------------------------------------------------------------
statement("strings_case", "SELECT p_partkey, upper(p_name) AS a, lower(p_brand) AS b, length(p_name) AS c, char_length(p_type) AS d, reverse(p_name) AS e FROM part")
statement("strings_concat", "SELECT n_nationkey, concat(a, b, 'z') AS c, concat_ws('-', a, b, 'z') AS d FROM (SELECT n_nationkey, n_name AS a, CASE WHEN n_regionkey <> 2 THEN n_name END AS b FROM nation) AS t")
statement("strings_cut", "SELECT p_partkey, substring(p_name, 2, 3) AS a, substring(p_name, 0, 3) AS b, substr(p_name, 4) AS c, left(p_name, 3) AS d, right(p_name, 4) AS e FROM part",
          "SELECT p_partkey, substring(p_name, 2, 3) AS a, substring(p_name, 1, 3) AS b, substr(p_name, 4) AS c, left(p_name, 3) AS d, right(p_name, 4) AS e FROM part")
statement("strings_trim", "SELECT p_partkey, trim(x) AS a, ltrim(x) AS b, rtrim(x) AS c, replace(x, 'a', 'bb') AS d, repeat(trim(x), 2) AS e FROM (SELECT p_partkey, '  ' || p_name || ' ' AS x FROM part) AS t")
statement("strings_find", "SELECT p_partkey, instr(p_name, 'i') AS a, strpos(p_name, 'widget') AS b, position('d' IN p_name) AS c, locate('e', p_name) AS d, split_part(p_name, ' ', 2) AS e FROM part",
          "SELECT p_partkey, instr(p_name, 'i')::INTEGER AS a, strpos(p_name, 'widget')::INTEGER AS b, position('d' IN p_name)::INTEGER AS c, instr(p_name, 'e')::INTEGER AS d, split_part(p_name, ' ', 2) AS e FROM part")
statement("strings_pad", "SELECT p_partkey, lpad(p_type, 10, '*') AS a, rpad(p_type, 3, '-') AS b, lpad(p_brand, 9) AS c, char(65) AS d, char(233) AS e, char(128512) AS f FROM part",
          "SELECT p_partkey, lpad(p_type, 10, '*') AS a, rpad(p_type, 3, '-') AS b, lpad(p_brand, 9, ' ') AS c, chr(65) AS d, chr(233) AS e, chr(128512) AS f FROM part")
statement("strings_collate", "SELECT x, collate(x, 'NOCASE') AS a, collate(x, 'NOACCENT') AS b, collate(x, 'BINARY') AS c FROM (SELECT 'É' || n_name AS x FROM nation) AS t",
          "SELECT x, lower(x) AS a, strip_accents(x) AS b, x AS c FROM (SELECT 'É' || n_name AS x FROM nation) AS t")
statement("math_rounding", "SELECT s_suppkey, round(s_acctbal) AS a, round(s_acctbal, 1) AS b, floor(s_acctbal) AS c, ceil(s_acctbal) AS d, ceiling(s_acctbal) AS e, abs(s_acctbal) AS f, sign(s_acctbal) AS g FROM supplier",
          "SELECT s_suppkey, round(s_acctbal) AS a, round(s_acctbal, 1) AS b, floor(s_acctbal) AS c, ceil(s_acctbal) AS d, ceil(s_acctbal) AS e, abs(s_acctbal) AS f, sign(s_acctbal)::BIGINT AS g FROM supplier")
statement("math_truncate", "SELECT s_suppkey, truncate(s_acctbal) AS a, trunc(-s_acctbal, 1) AS b FROM supplier", "SELECT s_suppkey, trunc(s_acctbal) AS a, CASE WHEN -s_acctbal < 0 THEN ceil(-s_acctbal * power(10, 1)) ELSE floor(-s_acctbal * power(10, 1)) END / power(10, 1) AS b FROM supplier")
statement("math_logs", "SELECT s_suppkey, round(log(x), 8) AS a, round(log(2, x), 8) AS b, round(ln(x), 8) AS c, round(log10(x), 8) AS d, round(log2(x), 8) AS e, round(sqrt(x), 8) AS f FROM (SELECT s_suppkey, s_acctbal AS x FROM supplier) AS t",
          "SELECT s_suppkey, round(CASE WHEN x > 0 THEN log10(x) END, 8) AS a, round(CASE WHEN x > 0 THEN log2(x) END, 8) AS b, round(CASE WHEN x > 0 THEN ln(x) END, 8) AS c, round(CASE WHEN x > 0 THEN log10(x) END, 8) AS d, round(CASE WHEN x > 0 THEN log2(x) END, 8) AS e, round(CASE WHEN x >= 0 THEN sqrt(x) END, 8) AS f FROM (SELECT s_suppkey, s_acctbal AS x FROM supplier) AS t")
statement("math_powers", "SELECT s_suppkey, round(power(s_suppkey, 2), 4) AS a, round(pow(s_suppkey, 0.5), 8) AS b, round(exp(s_suppkey / 1000.0D), 6) AS c, round(sin(s_suppkey), 8) AS d, round(cos(s_suppkey), 8) AS e, round(tan(s_suppkey), 6) AS f, round(pi(), 8) AS g FROM supplier",
          "SELECT s_suppkey, round(power(s_suppkey, 2), 4) AS a, round(pow(s_suppkey, 0.5), 8) AS b, round(exp(s_suppkey / 1000), 6) AS c, round(sin(s_suppkey), 8) AS d, round(cos(s_suppkey), 8) AS e, round(tan(s_suppkey), 6) AS f, round(pi(), 8) AS g FROM supplier")
statement("math_division", "SELECT o_orderkey, int_div(o_orderkey, 7) AS a, int_div(o_orderkey, 0) AS b, safe_mod(o_orderkey, 7) AS c, safe_mod(o_orderkey, 0) AS d, mod(o_orderkey, 9) AS e FROM orders",
          "SELECT o_orderkey, o_orderkey // 7 AS a, NULL::BIGINT AS b, o_orderkey % 7 AS c, NULL::BIGINT AS d, o_orderkey % 9 AS e FROM orders")
statement("random_range", "SELECT count(*) AS n FROM orders WHERE random() >= 0 AND random() < 1", "SELECT count(*) AS n FROM orders")
statement("dates_parts", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s FROM orders",
          "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d, hour(o_orderdate)::INTEGER AS h, minute(o_orderdate)::INTEGER AS mi, second(o_orderdate)::INTEGER AS s FROM orders")
statement("dates_extract", "SELECT event_id, extract(dow FROM ts) AS a, extract(isodow FROM ts) AS b, extract(doy FROM ts) AS c, extract(week FROM ts) AS d, extract(quarter FROM ts) AS e, extract(second FROM ts) AS f, extract(epoch FROM ts) AS g FROM events",
          "SELECT event_id, dayofweek(ts)::INTEGER AS a, isodow(ts)::INTEGER AS b, dayofyear(ts)::BIGINT AS c, week(ts)::BIGINT AS d, quarter(ts)::BIGINT AS e, second(ts)::BIGINT AS f, floor(epoch(ts))::BIGINT AS g FROM events")
statement("dates_trunc", "SELECT event_id, date_trunc('hour', ts) AS a, date_trunc('week', ts) AS b, date_trunc('quarter', ts) AS c FROM events")
statement("dates_time_trunc", "SELECT event_id, time_trunc('15m', ts) AS a, time_trunc('1h30m', ts) AS b FROM events",
          "SELECT event_id, (epoch_ms(0) + to_microseconds((epoch_us(ts) // 900000000) * 900000000))::TIMESTAMPTZ AS a, (epoch_ms(0) + to_microseconds((epoch_us(ts) // 5400000000) * 5400000000))::TIMESTAMPTZ AS b FROM events")
statement("dates_add", "SELECT o_orderkey, date_add(o_orderdate, 10) AS a, date_add(o_orderdate, 1, 'month') AS b, date_sub(o_orderdate, 2, 'hour') AS c, date_sub(o_orderdate, 1) AS d FROM orders",
          "SELECT o_orderkey, o_orderdate + INTERVAL 10 DAY AS a, o_orderdate + INTERVAL 1 MONTH AS b, o_orderdate - INTERVAL 2 HOUR AS c, o_orderdate - INTERVAL 1 DAY AS d FROM orders")
statement("dates_diff", "SELECT event_id, datediff(ts, TIMESTAMP '2024-01-01 12:00:00') AS d FROM events", "SELECT event_id, date_sub('day', TIMESTAMP '2024-01-01 12:00:00', ts) AS d FROM events")
statement("dates_to_char", "SELECT event_id, to_char(ts, 'YYYY-MM-DD HH24:MI:SS') AS c FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS c FROM events")
statement("dates_now", "SELECT event_id, now() >= ts AS a, length(current_time()) AS b, current_timestamp() > ts AS c, current_date() >= CAST(ts AS DATE) AS d FROM events",
          "SELECT event_id, true AS a, 8 AS b, true AS c, true AS d FROM events")
statement("conditionals", "SELECT o_orderkey, coalesce(a, b, 0) AS c, nullif(a, 1) AS d, ifnull(b, 9) AS e, greatest(a, b) AS f, least(a, b) AS g, iif(a > 1, 'y', 'n') AS h FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 4 END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4 END AS b FROM orders) AS t",
          "SELECT o_orderkey, coalesce(a, b, 0) AS c, nullif(a, 1) AS d, ifnull(b, 9) AS e, greatest(a, b) AS f, least(a, b) AS g, CASE WHEN a > 1 THEN 'y' ELSE 'n' END AS h FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 4 END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4 END AS b FROM orders) AS t")
statement("casts", "SELECT n_nationkey, CAST(x AS INTEGER) AS a, CAST(x AS FLOAT) AS b, CAST(x AS TEXT) AS c, CAST(x AS BOOLEAN) AS d FROM (SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'x' || n_name WHEN n_regionkey = 1 THEN 'yes' WHEN n_regionkey = 2 THEN '' ELSE '-' || n_nationkey END AS x FROM nation) AS t",
          "SELECT n_nationkey, TRY_CAST(x AS BIGINT) AS a, TRY_CAST(x AS DOUBLE) AS b, x AS c, CASE WHEN x IN ('yes') THEN true END AS d FROM (SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'x' || n_name WHEN n_regionkey = 1 THEN 'yes' WHEN n_regionkey = 2 THEN '' ELSE '-' || n_nationkey END AS x FROM nation) AS t")
statement("cast_date", "SELECT event_id, CAST(ts AS DATE) AS d FROM events", "SELECT event_id, date_trunc('day', ts)::TIMESTAMPTZ AS d FROM events")
statement("typeof", "SELECT DISTINCT typeof(o_orderkey) AS a, typeof(o_totalprice) AS b, typeof(o_orderstatus) AS c, typeof(o_totalprice > 5) AS d FROM orders",
          "SELECT DISTINCT 'INTEGER' AS a, 'FLOAT' AS b, 'TEXT' AS c, 'BOOLEAN' AS d FROM orders")
statement("json_access", "SELECT event_id, json_extract(props, '$.k') AS k, json_valid(props) AS v, json_keys(props) AS ks, json_type(props) AS t FROM events",
          "SELECT event_id, json_extract_string(props, '$.k') AS k, 1::BIGINT AS v, '[\"k\"]' AS ks, 'object' AS t FROM events")
statement("json_build", "SELECT n_nationkey, json_array(n_nationkey, n_name, 3) AS a, json_object('x', n_nationkey, 'y', n_name) AS b, json_array_length('[' || n_nationkey || ',2]') AS c, json_array_length('{}') AS d, json_valid('{' || n_name) AS e, json_type('[' || n_nationkey || ']') AS f, json_typeof(CAST(n_nationkey AS TEXT)) AS g FROM nation",
          "SELECT n_nationkey, '[' || n_nationkey || ',\"' || n_name || '\",3]' AS a, '{\"x\":' || n_nationkey || ',\"y\":\"' || n_name || '\"}' AS b, 2 AS c, NULL::INTEGER AS d, 0::BIGINT AS e, 'array' AS f, 'number' AS g FROM nation")

# --- vectors --------------------------------------------------------------------------------------
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 3)"
statement("vector_distances", f"SELECT e.vec_id, round(vec_distance_l2(e.embedding, q.v), 5) AS l2, round(vec_distance_cosine(e.embedding, q.v), 5) AS cos, round(vec_distance_ip(e.embedding, q.v), 5) AS ip, vec_dims(e.embedding) AS d, round(vec_norm(e.embedding), 4) AS n FROM embeddings AS e CROSS JOIN {_Q} AS q(v)",
          f"SELECT e.vec_id, round(list_distance(e.embedding::DOUBLE[], q.v::DOUBLE[]), 5) AS l2, round(list_cosine_distance(e.embedding::DOUBLE[], q.v::DOUBLE[]), 5) AS cos, round(-list_inner_product(e.embedding::DOUBLE[], q.v::DOUBLE[]), 5) AS ip, len(e.embedding)::INTEGER AS d, round(sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 4) AS n FROM embeddings AS e CROSS JOIN {_Q} AS q(v)")
statement("vector_nearest", f"SELECT e.vec_id, round(e.embedding <=> q.v, 5) AS d FROM embeddings AS e CROSS JOIN {_Q} AS q(v) ORDER BY e.embedding <=> q.v, vec_id LIMIT 10",
          f"SELECT e.vec_id, round(list_distance(e.embedding::DOUBLE[], q.v::DOUBLE[]), 5) AS d FROM embeddings AS e CROSS JOIN {_Q} AS q(v) ORDER BY list_distance(e.embedding::DOUBLE[], q.v::DOUBLE[]), vec_id LIMIT 10")
statement("vector_text", "SELECT n_nationkey, vec_to_text(array(n_nationkey, n_regionkey)) AS t FROM nation",
          "SELECT n_nationkey, '[' || n_nationkey || ',' || n_regionkey || ']' AS t FROM nation")


# --- user functions -------------------------------------------------------------------------------
@query("udf_scalar", "SELECT o_orderkey, o_totalprice * 2 + 1 AS x FROM orders")
def udf_scalar(spark, sf_dir):
    spark.udf.register("twice_plus_one", F.pandas_udf(lambda s: s * 2 + 1, "double"))
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderkey, twice_plus_one(o_totalprice) AS x FROM orders")


@query("udf_aggregate", "SELECT o_orderstatus, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY o_orderstatus")
def udf_aggregate(spark, sf_dir):
    def spread(s: pd.Series) -> float:
        return float(s.max() - s.min())

    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderstatus").agg(F.round(F.pandas_udf(spread, "double")("o_totalprice"), 2).alias("spread"))


@query("udf_window", "SELECT o_orderkey, o_custkey, round(sum(o_totalprice * power(2, n)) OVER (PARTITION BY o_custkey ORDER BY n ROWS UNBOUNDED PRECEDING) / power(2, n), 4) AS decayed FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey DESC) AS n FROM orders)")
def udf_window(spark, sf_dir):
    """A sum in which each order counts half of the one after it."""

    def decayed(prices: pd.Series) -> pd.Series:
        return prices.ewm(alpha=0.5, adjust=False).mean() * 2 - prices.iloc[0] * 0.5 ** pd.Series(range(len(prices)))

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    out = windows.window_function(orders, decayed, "o_totalprice", "decayed", "double", ["o_custkey"], ["o_orderdate", "-o_orderkey"])
    return out.select("o_orderkey", "o_custkey", F.round("decayed", 4).alias("decayed"))


statement("version", "SELECT n_nationkey, length(version()) > 0 AS v, date_diff(TIMESTAMP '2024-03-01 00:00:00', TIMESTAMP '2024-02-27 12:00:00') AS d, TIMESTAMP '2024-03-01 00:00:00' - TIMESTAMP '2024-02-27 12:00:30' AS t, collate(n_name, 'NUMERIC') AS c FROM nation", "SELECT n_nationkey, true AS v, 2 AS d, '2 days 11:59:30' AS t, n_name AS c FROM nation")


# --- versions and changes -------------------------------------------------------------------------
_HISTORY = "SELECT user_id, event_id AS txn, ts, value, event_type = 'error' AS deleted FROM events"


@query("as_of_timestamp", f"SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, txn DESC) AS r FROM ({_HISTORY}) WHERE ts <= TIMESTAMP '2024-01-05 00:00:00') WHERE r = 1 AND NOT deleted")
def as_of_timestamp(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return versions.as_of(spark.sql(_HISTORY), ["user_id"], "ts", F.expr("TIMESTAMP '2024-01-05 00:00:00'"), transaction="txn").select("user_id", "value")


@query("as_of_transaction", f"SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY txn DESC) AS r FROM ({_HISTORY}) WHERE txn <= 300) WHERE r = 1 AND NOT deleted")
def as_of_transaction(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return versions.as_of(spark.sql(_HISTORY), ["user_id"], "txn", 300).select("user_id", "value")


@query("insert_rows", "SELECT * FROM region UNION ALL SELECT 99, 'NOWHERE' UNION ALL SELECT 100, NULL")
def insert_rows(spark, sf_dir):
    return versions.insert(table(spark, sf_dir, "region"), spark.createDataFrame([("99", "NOWHERE"), ("100", None)], "r_regionkey string, r_name string"))


@query("insert_select", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 1000, n_name FROM nation WHERE n_regionkey = 1")
def insert_select(spark, sf_dir):
    return versions.insert(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation").where("n_regionkey = 1").selectExpr("n_nationkey + 1000 AS r_regionkey", "n_name AS r_name"))


@query("update_rows", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_rows(spark, sf_dir):
    return versions.update(table(spark, sf_dir, "customer"), {"c_acctbal": "0", "c_mktsegment": "'DEBT'"}, "c_acctbal < 0")


@query("delete_rows", "SELECT * FROM customer WHERE NOT coalesce(c_acctbal < 1000 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0), false)")
def delete_rows(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return versions.delete_matching(table(spark, sf_dir, "customer"), nations, ["c_nationkey"], "c_acctbal < 1000")


@query("delete_returning", "SELECT c_custkey, round(c_acctbal * 2, 2) AS twice FROM customer WHERE c_acctbal < -500")
def delete_returning(spark, sf_dir):
    return versions.returning(table(spark, sf_dir, "customer"), "c_acctbal < -500", "c_custkey", "round(c_acctbal * 2, 2) AS twice")


@query("truncate_table", "SELECT * FROM region WHERE false")
def truncate_table(spark, sf_dir):
    return versions.truncate(table(spark, sf_dir, "region"))


@query("upsert", "SELECT s_suppkey, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey + 1000000, 1.0 FROM supplier WHERE s_suppkey % 3 = 0")
def upsert(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    third = s.where("s_suppkey % 3 = 0")
    new = third.selectExpr("s_suppkey", "1.0D AS s_acctbal").union(third.selectExpr("s_suppkey + 1000000", "1.0D"))
    return versions.upsert(s, new, ["s_suppkey"], {"s_acctbal": "old.s_acctbal + new.s_acctbal"})


@query("create_table_as", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def create_table_as(spark, sf_dir):
    from basalt.operators.ddl import create_table_as

    name = f"orders_per_customer_{uuid.uuid4().hex}"  # a warehouse outlives sessions
    return create_table_as(spark, name, table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")))


@query("alter_table", "SELECT n_nationkey, n_name AS title, n_regionkey::DOUBLE AS n_regionkey, 'x' AS note FROM nation")
def alter_table(spark, sf_dir):
    from basalt.operators import ddl

    n = ddl.add_column(table(spark, sf_dir, "nation"), "note", "STRING", "'x'")
    return ddl.modify_column(ddl.rename_column(n, "n_name", "title"), "n_regionkey", "FLOAT")


# --- constraints ----------------------------------------------------------------------------------
@query("constraint_unique", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def constraint_unique(spark, sf_dir):
    return versions.not_unique(table(spark, sf_dir, "orders"), ["o_custkey"])


@query("constraint_foreign_key", "SELECT o_orderkey FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def constraint_foreign_key(spark, sf_dir):
    return versions.orphans(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey").select("o_orderkey")


@query("constraint_check", "SELECT c_custkey FROM customer WHERE NOT c_acctbal >= 0")
def constraint_check(spark, sf_dir):
    return versions.fails_check(table(spark, sf_dir, "customer"), "c_acctbal >= 0").select("c_custkey")


@query("constraint_dimension", "SELECT vec_id FROM embeddings WHERE len(embedding) <> 64")
def constraint_dimension(spark, sf_dir):
    return versions.wrong_dimension(table(spark, sf_dir, "embeddings"), "embedding", 64).select("vec_id")


@query("constraint_not_null", "SELECT event_id FROM events WHERE props IS NULL")
def constraint_not_null(spark, sf_dir):
    return versions.is_null(table(spark, sf_dir, "events"), "props").select("event_id")


@query("cascade_delete", "SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal < 0 WHERE c_custkey IS NULL")
def cascade_delete(spark, sf_dir):
    return versions.cascade(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal < 0"), "c_custkey").select("o_orderkey")


@query("cascade_set_null", "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN o_custkey END AS o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal < 0")
def cascade_set_null(spark, sf_dir):
    return versions.cascade(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal < 0"), "c_custkey", "set null").select("o_orderkey", "o_custkey")


# --- event time -----------------------------------------------------------------------------------
@query("tumbling_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    return streaming.windowed(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 2))


@query("time_buckets", "SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1")
def time_buckets(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(streaming.time_bucket("ts", "1 hour").alias("bucket")).agg(F.count("*").alias("n"))


@query("glob_function", "SELECT p_partkey FROM part WHERE p_name GLOB '*l? *'")
def glob_function(spark, sf_dir):
    return table(spark, sf_dir, "part").where(scalars.glob(F.col("p_name"), "*l? *")).select("p_partkey")


@query("sliding_windows", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def sliding_windows(spark, sf_dir):
    return streaming.windowed(table(spark, sf_dir, "events"), "1 hour", "30 minutes").withColumn("total", F.round("total", 2))


def _stream(spark, sf_dir, shape, parts):
    """The table a stream makes of the events in parts, one after the other, each as all its files."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    base = f"{shared(spark)}/events-{uuid.uuid4().hex}"
    for part in parts:
        events.where(part).write.mode("append").parquet(f"{base}/in")
        streaming.append(shape(streaming.watch(spark, f"{base}/in", events.schema, per_batch=None)), f"{base}/out", f"{base}/at")
    return spark.read.parquet(f"{base}/out")


_SESSIONS = """WITH b AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b),
g AS (SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, s)
SELECT start, "end", user_id, n FROM g"""


@query("session_windows", _SESSIONS)
def session_windows(spark, sf_dir):
    return streaming.sessions(table(spark, sf_dir, "events"))


@query("session_stream", _SESSIONS + """ WHERE "end" <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def session_stream(spark, sf_dir):
    """The same sessions from a stream: those that the watermark has passed."""
    return _stream(spark, sf_dir, streaming.sessions, ["true"])


@query("late_data", """WITH m AS (SELECT max(ts) FILTER (event_id % 10 <> 0) - INTERVAL 10 MINUTE AS seen, max(ts) - INTERVAL 10 MINUTE AS done FROM events),
e AS (SELECT event_id, date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS stop, event_type, value FROM events)
SELECT start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM e, m WHERE (event_id % 10 <> 0 OR stop > seen) AND stop <= done GROUP BY 1, 2""")
def late_data(spark, sf_dir):
    """Every tenth event comes after all others: by then only windows that the watermark hasn't passed take it."""
    return _stream(spark, sf_dir, streaming.windowed, ["event_id % 10 <> 0", "event_id % 10 = 0"]).withColumn("total", F.round("total", 2))


#: Lists that a query reads of the 24: many, as the vectors here hardly cluster.
VECTOR_PROBES = 19


# --- approximate vector scan ----------------------------------------------------------------------
@query("vector_index_scan", "SELECT count(*) FILTER (vec_id % 20 = 0) AS queries, true AS recalled, true AS pruned FROM embeddings")
def vector_index_scan(spark, sf_dir):
    """Recall at 10 of an inverted file against the exact scan is 0.95 at least, of at most 85 % of the vectors."""
    given = table(spark, sf_dir, "embeddings")
    asked = given.where("vec_id % 20 = 0")
    path = f"{shared(spark)}/vectors-{uuid.uuid4().hex}"
    vectors.build(given, path, lists=24)
    found, want = vectors.search(spark, path, asked, probes=VECTOR_PROBES), vectors.exact(given, asked)
    hits = want.join(found, ["query_id", "id"], "left").agg(F.avg(F.coalesce((found["rank"] > 0).cast("double"), F.lit(0.0))).alias("recall"))
    read = vectors.probed(spark, path, asked, VECTOR_PROBES).agg((F.sum("n") / F.countDistinct("query_id")).alias("read"))
    total = given.agg(F.count_if(F.col("vec_id") % 20 == 0).alias("queries"), F.count("*").alias("all"))
    return total.join(hits).join(read).select("queries", (F.col("recall") >= 0.95).alias("recalled"), (F.col("read") <= F.col("all") * 0.85).alias("pruned"))
