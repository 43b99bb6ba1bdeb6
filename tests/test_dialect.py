import datetime

import pytest

from basalt.engine import Engine

T = "(VALUES (7, 2, 'a'), (-7, 2, 'b'), (1, 0, NULL)) AS t(a, b, c)"


def rows(spark, text, params=None):
    return Engine(spark).query_raw(text, params)[1]


def ordered(spark, text, params=None):
    return sorted(rows(spark, text, params), key=str)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT 7 / 2 AS x, -7 / 2 AS y, 7 / 2.0 AS z, 1 / 0 AS n, 7 % 0 AS m, 7 % 4 AS k", [[3, -3, 3.5, None, None, 3]]),
        ("SELECT 100 / 7 / 2 AS x, 100 / (7 / 2) AS y, (1 + 6) / 2 * 2 AS z", [[7, 33, 6]]),
        ("SELECT CAST('7' AS FLOAT) / 2 AS x, CAST('7' AS INTEGER) / 2 AS y, avg(a) / 2 AS z, sum(a) / 2 AS s FROM (VALUES (1), (2)) AS t(a)", [[3.5, 3, 0.75, 1]]),
        ("SELECT true XOR false AS a, true XOR NULL AS b, 1 > 2 XOR 2 > 1 AS c, xor(true, true) AS d", [[True, None, True, False]]),
        ("SELECT true OR false XOR true AS a, CASE WHEN 1 = 1 XOR 2 = 2 THEN 'y' ELSE 'n' END AS b", [[False, "n"]]),
        ("SELECT '{\"a\": {\"b\": [1, 2]}, \"s\": \"x\"}' -> 'a' ->> 'b' AS x, '{\"s\": \"x\"}' -> 's' AS y, '{\"s\": \"x\"}' ->> 's' AS z", [["[1,2]", '"x"', "x"]]),
        ("SELECT v['a'][1] AS x, v -> 'no' AS y, v ->> 'a' AS z FROM (SELECT '{\"a\": [1, 2]}' AS v) AS t", [["2", None, "[1,2]"]]),
        ("SELECT 1 AS x UNION SELECT 2 EXCEPT SELECT 1 ORDER BY x", [[1], [2]]),
        ("SELECT TIMESTAMP '2024-01-05 00:00:00' + 3 AS x, TIMESTAMP '2024-01-05 00:00:00' - 3 AS y", [[datetime.datetime(2024, 1, 8), datetime.datetime(2024, 1, 2)]]),
        ("SELECT TIMESTAMP '2024-01-05 00:00:00' - TIMESTAMP '2024-01-01 01:00:09' AS x, TIMESTAMP '2024-01-01 00:00:00' - TIMESTAMP '2024-01-01 01:00:00' AS y", [["3 days 22:59:51", "-01:00:00"]]),
        ("SELECT array_agg(x ORDER BY x DESC) AS a, string_agg(y, '-' ORDER BY x) AS s FROM (VALUES (1, 'p'), (3, 'q'), (2, 'r')) AS t(x, y)", [["[3,2,1]", "p-r-q"]]),
        ("SELECT stddev(x) FILTER (WHERE x < 4) AS s FROM (VALUES (1.0D), (3.0D), (9.0D)) AS t(x)", [[1.0]]),
        ("SELECT '1/2' AS s, 'a XOR b' AS x, 4 / 2 AS d -- 1/0", [["1/2", "a XOR b", 2]]),
    ],
)
def test_expressions(spark, text, want):
    assert rows(spark, text) == want


def test_alias_in_where(spark):
    assert ordered(spark, f"SELECT a * 2 AS twice FROM {T} WHERE twice > 2") == [[14]]
    assert ordered(spark, f"SELECT a / b AS q, a FROM {T} WHERE q = 3 AND c = 'a'") == [[3, 7]]
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        rows(spark, f"SELECT a FROM {T} WHERE nothing = 1")


def test_division_in_subqueries_groups_and_parameters(spark):
    assert ordered(spark, f"SELECT a / 2 AS h, count(*) AS n FROM {T} GROUP BY a / 2 HAVING sum(b) / 1 >= 0") == [[-3, 1], [0, 1], [3, 1]]
    assert ordered(spark, f"SELECT a FROM {T} WHERE a IN (SELECT 15 / 2) OR a = (SELECT 3 / 2)") == [[1], [7]]
    assert ordered(spark, f"WITH w AS (SELECT a / 2 AS h FROM {T}) SELECT max(h) AS m FROM w") == [[3]]
    assert rows(spark, "SELECT $1 / $2 AS x, $3 AS s", [7, 2, "it's / \\ ?"]) == [[3, "it's / \\ ?"]]
    assert rows(spark, "SELECT ? / ? AS x", [7.0, 2]) == [[3.5]]
    assert rows(spark, "SELECT :p / 2 AS x", {"p": 9}) == [[4]]


def test_frames(spark):
    v = "(VALUES (1, 1, 'a'), (2, 1, 'b'), (3, 2, 'b')) AS t(i, k, s)"
    assert ordered(spark, f"SELECT i, sum(i) OVER (ORDER BY k, i) AS s FROM {v}") == [[1, 1], [2, 3], [3, 6]]
    assert sorted(r[0] for r in rows(spark, f"SELECT count(*) OVER (ORDER BY k) AS n FROM {v}")) == [1, 2, 3]
    assert ordered(spark, f"SELECT i, sum(i) OVER (ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM {v}") == [[1, 6], [2, 6], [3, 6]]
    assert ordered(spark, f"SELECT i, count(DISTINCT s) OVER (PARTITION BY k) AS n FROM {v}") == [[1, 2], [2, 2], [3, 1]]
    named = f"SELECT i, rank() OVER w AS r, lag(i) OVER w AS l, sum(i) OVER w AS s, cume_dist() OVER w AS c FROM {v} WINDOW w AS (ORDER BY i)"
    assert [r[:4] for r in ordered(spark, named)] == [[1, 1, None, 1], [2, 2, 1, 3], [3, 3, 2, 6]]
    assert ordered(spark, f"SELECT i, stddev(k) OVER (PARTITION BY s) AS d FROM {v}") == [[1, 0.0], [2, 0.5], [3, 0.5]]


def test_as_of(spark):
    h = spark.sql("SELECT * FROM VALUES (1, 1, TIMESTAMP '2024-01-01 00:00:00', 'a', false), (1, 5, TIMESTAMP '2024-01-03 00:00:00', 'b', false), (2, 2, TIMESTAMP '2024-01-02 00:00:00', 'c', false), (2, 6, TIMESTAMP '2024-01-04 00:00:00', 'c', true) AS v(k, txn, ts, v, gone)")
    e = Engine(spark)
    e.register_history("things", h, ["k"], "ts", "txn", "gone")
    got = lambda text, p=None: sorted(r["v"] for r in e.query(text, p))
    assert got("SELECT v FROM things AS OF TIMESTAMP '2024-01-02 12:00:00'") == ["a", "c"]
    assert got("SELECT x.v FROM things AS OF TRANSACTION 5 AS x WHERE x.k = 1") == ["b"]
    assert got("SELECT things.v FROM things AS OF TRANSACTION $1 WHERE things.k > 0", [9]) == ["b"]


def test_tuples_classes_and_windows_without_order(spark):
    from basalt.engine import Engine

    e = Engine(spark)
    spark.createDataFrame([(1, "x", 2**62), (2, "y", 2**62), (3, "*", 5)], "a long, t string, big long").createOrReplaceTempView("forms")
    keys = lambda q: [r["a"] for r in e.query(f"SELECT a FROM forms WHERE {q} ORDER BY a")]
    assert keys("(a, t) IN ((1, 'x'), (2, 'x'))") == [1] and keys("(a, t) NOT IN ((1, 'x'), (2, 'x'))") == [2, 3]
    assert keys("abs(a) IN (1) AND (a, t) IN ((1, 'x'))") == [1] and keys("(a, t) IN (SELECT 1, 'x')") == [1]
    assert keys("t GLOB '[xy]*'") == [1, 2] and keys(r"t GLOB '\*'") == [3] and keys("t GLOB '?'") == [1, 2, 3]
    assert [r["r"] for r in e.query("SELECT ROW_NUMBER() OVER () AS r FROM forms ORDER BY r")] == [1, 2, 3]
    assert e.query_one("SELECT SUM(big) FILTER (WHERE a < 3) AS s FROM forms")["s"] == 2.0**63
    assert {r["s"] for r in e.query("SELECT SUM(big) OVER () AS s FROM forms")} == {2.0**63}
    assert e.query_one("SELECT JSON_OBJECT('a', NULL, 'b', 1, 'a', NULL) AS j") == {"j": '{"a":null,"b":1}'}
