import pytest

from basalt.engine import Engine, rewrite
from basalt.functions import scalars
from basalt.operators import notes, recursive, search, subquery, versions
from basalt.operators.ddl import create_table, storage_type
from basalt.operators.explain import explain


def one(spark, text, params=None):
    return Engine(spark).query_raw(text, params)[1]


def test_nulls_in_order(spark):
    text = "SELECT x FROM (VALUES (2), (NULL), (1)) AS t(x) ORDER BY x"
    assert [r[0] for r in one(spark, text)] == [1, 2, None]
    assert [r[0] for r in one(spark, text + " DESC")] == [None, 2, 1]
    assert [r[0] for r in one(spark, text + " NULLS FIRST")] == [None, 1, 2]


def test_rewrites_leave_strings_alone():
    assert "'ORDER BY x; log(1)'" in rewrite("SELECT 'ORDER BY x; log(1)' AS a")


def test_casts_never_raise(spark):
    assert one(spark, "SELECT CAST('3.7' AS INTEGER) AS a, CAST('' AS INTEGER) AS b, CAST(3.9D AS INTEGER) AS c, CAST('x' AS TIMESTAMP) AS d") == [[None, None, 3, None]]


def test_division_and_modulo(spark):
    assert one(spark, "SELECT int_div(7, 2) AS a, int_div(-7, 2) AS b, int_div(1, 0) AS c, safe_mod(1, 0) AS d") == [[3, -3, None, None]]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|REMAINDER_BY_ZERO"):
        one(spark, "SELECT mod(1, 0) AS a")


def test_quantified(spark):
    t = "(VALUES (1), (5)) AS t(x)"
    empty = "(SELECT y FROM (VALUES (1)) AS u(y) WHERE y > 9)"
    assert sorted(one(spark, f"SELECT x FROM {t} WHERE x > ALL {empty}")) == [[1], [5]]
    assert one(spark, f"SELECT x FROM {t} WHERE x > ANY {empty}") == []
    assert one(spark, f"SELECT x FROM {t} WHERE x >= ALL (SELECT 5)") == [[5]]
    a, b = spark.range(5).toDF("x"), spark.sql("SELECT * FROM VALUES (1), (NULL), (3) AS v(y)")
    names = lambda df: sorted(r.x for r in df.collect())
    assert names(subquery.quantified(a, "x", "=", "ANY", b)) == [1, 3]
    assert names(subquery.quantified(a, "x", "<>", "ALL", b)) == []
    assert names(subquery.quantified(a, "x", "<>", "ALL", b.where("y = 1"))) == [0, 2, 3, 4]
    assert names(subquery.quantified(a, "x", "<", "ANY", b)) == [0, 1, 2]
    assert names(subquery.quantified(a, "x", "=", "ALL", b.where("y > 5"))) == [0, 1, 2, 3, 4]


def test_parameters(spark):
    assert one(spark, "SELECT $2 AS b, $1 AS a", [1, "x"]) == [["x", 1]]
    assert one(spark, "SELECT :v AS a", {"v": 3}) == [[3]]
    assert one(spark, "SELECT ? AS a, ? AS b", [4, 5]) == [[4, 5]]
    many = Engine(spark).execute("SELECT ';' AS a; SELECT 2 AS b;")
    assert [r.collect()[0][0] for r in many] == [";", 2]
    assert Engine(spark).prepare("SELECT $1 AS a")([7]).first().a == 7


def test_vector_operator(spark):
    assert one(spark, "SELECT v <=> '[0,0]' AS d FROM (SELECT array(3.0D, 4.0D) AS v) AS t") == [[5.0]]


def test_durations():
    assert scalars.duration_seconds("1h30m") == 5400
    with pytest.raises(ValueError):
        scalars.duration_seconds("x")


def test_recursion_stops_silently(spark):
    out = recursive.recurse(spark.range(1).toDF("n"), lambda t: t.selectExpr("n + 1 AS n"), limit=3)
    assert sorted(r.n for r in out.collect()) == [0, 1, 2, 3]


def test_delete_keeps_null_conditions(spark):
    t = spark.createDataFrame([(1,), (None,)], "x int")
    assert [r.x for r in versions.delete(t, "x > 0").collect()] == [None]


def test_upsert_inserts_and_updates(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    n = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in versions.upsert(t, n, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_as_of(spark):
    h = spark.createDataFrame([(1, 1, "a", False), (1, 5, "b", False), (2, 2, "c", False), (2, 3, "c", True)], "k int, t int, v string, deleted boolean")
    at = lambda t: sorted(r.v for r in versions.as_of(h, ["k"], "t", t).collect())
    assert (at(0), at(2), at(4), at(9)) == ([], ["a", "c"], ["a"], ["b"])


def test_edit_refuses(spark):
    df = spark.createDataFrame([("a a", "# H\n1\n# H\n2")], "t string, s string")
    with pytest.raises(Exception, match="places found"):
        df.select(notes.edit(df.t, "find_replace", "b", "a")).collect()
    with pytest.raises(Exception, match="several sections"):
        df.select(notes.edit(df.s, "replace_section", "x", section="# H")).collect()


def test_proximity(spark):
    df = spark.createDataFrame([("a/b/x.md", t) for t in ("a/b/y.md", "a/y.md", "y.md", "a/b/c/y.md", "q/y.md")], "s string, t string")
    assert [r[0] for r in df.select(notes.proximity(df.s, df.t)).collect()] == [0, 1, 2, 101, 1000]


def test_metadata_lists(spark):
    df = spark.createDataFrame([('{"tags":["a","b"],"n":{"x":"3"}}',)], "m string")
    assert df.where(search.metadata_filter("m", {"tags": ["a"], "n.x": {"$lt": 4}})).count() == 1
    assert df.where(search.metadata_filter("m", {"tags": ["a", "z"]})).count() == 0


def test_tables(spark):
    assert storage_type("VECTOR(3)") == "array<float>" and storage_type("DECIMAL(10,2)") == "double"
    assert create_table(spark, "made", {"a": "INTEGER", "b": "TEXT"}).dtypes == [("a", "bigint"), ("b", "string")]


def test_stream(spark, tmp_path):
    from basalt.streaming import events

    for i in range(2):
        spark.createDataFrame([(1, f"v{i}"), (i + 2, "x")], "k int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = events.watch(spark, str(tmp_path / "in"), "k int, v string", per_batch=1)
    q = events.fold(source, str(tmp_path / "out"), ["k"], str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted((r.k, r.v) for r in events.folded(spark, str(tmp_path / "out")).collect()) == [(1, "v1"), (2, "x"), (3, "x")]


def test_stream_keeps_the_newest(spark, tmp_path):
    from basalt.streaming import events

    for rows in ([(1, 5, "new"), (2, 1, "a"), (2, 1, "b"), (3, None, "n")], [(1, 4, "late"), (2, 1, "a"), (3, 0, "z")]):
        spark.createDataFrame(rows, "k int, at int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for cp in ("one", "again"):  # the second run repeats all batches
        source = events.watch(spark, str(tmp_path / "in"), "k int, at int, v string", per_batch=1)
        events.fold(source, str(tmp_path / "out"), ["k"], str(tmp_path / cp), order="at", buckets=4).start().awaitTermination(60)
        assert sorted((r.k, r.v) for r in events.folded(spark, str(tmp_path / "out")).collect()) == [(1, "new"), (2, "b"), (3, "z")]


def test_explain_analyze(spark):
    e = Engine(spark)
    spark.range(1000).selectExpr("id", "id % 10 AS k").createOrReplaceTempView("big")
    spark.range(3).selectExpr("id AS k", "'x' AS t").createOrReplaceTempView("small")
    rows = e.query("EXPLAIN ANALYZE SELECT b.id, t FROM big b JOIN small s ON b.k = s.k")
    joins = [r for r in rows if "Join" in r["node"]]
    assert [r["actual_rows"] for r in joins] == [300] and joins[0]["estimated_bytes"]
    assert {1000, 3} <= {r["actual_rows"] for r in rows if r["node"].startswith("Range")}
    assert all(r.actual_rows is None for r in explain(e.sql("SELECT b.id FROM big b WHERE id < $1", [5]), False).collect())
