import pytest

from basalt.engine import Engine
from basalt.operators.store import ConstraintError


@pytest.fixture
def e(spark):
    e = Engine(spark)
    yield e
    for name in list(e.store.tables):
        e.sql(f"DROP TABLE {name}")


def got(e, text, params=None):
    return sorted(e.query_raw(text, params)[1], key=str)


def test_insert_update_delete(e):
    e.execute("CREATE TABLE t (id INTEGER PRIMARY KEY AUTO_INCREMENT, name TEXT NOT NULL, n INTEGER DEFAULT 5, CHECK (n < 100)); CREATE TABLE IF NOT EXISTS t (x TEXT)")
    assert e.query_one("INSERT INTO t (name) VALUES ('a'), ('b')") == {"rows_affected": 2}
    assert e.query_one("INSERT INTO t (id, name, n) VALUES ($1, $2, DEFAULT)", [7, "it's"]) == {"rows_affected": 1}
    assert e.query_one("INSERT INTO t (name, n) SELECT name || '!', n * 2 FROM t WHERE n / 2 = 2 AND id = 1 RETURNING id, n AS twice") == {"id": 8, "twice": 10}
    assert got(e, "SELECT id, name, n FROM t") == [[1, "a", 5], [2, "b", 5], [7, "it's", 5], [8, "a!", 10]]
    assert e.query_one("UPDATE t SET n = n + 7 / 2, name = upper(name) WHERE id IN (SELECT min(id) FROM t) RETURNING name, n") == {"name": "A", "n": 8}
    assert e.query_one("UPDATE t SET n = NULL WHERE n > 100") == {"rows_affected": 0}
    assert e.query_one("DELETE FROM t WHERE n > ALL (SELECT 8)") == {"rows_affected": 1}
    assert got(e, "SELECT id, n FROM t ORDER BY id") == [[1, 8], [2, 5], [7, 5]]
    e.sql("VACUUM")
    assert e.query_one("TRUNCATE TABLE t") == {"rows_affected": 3}
    assert got(e, "SELECT * FROM t") == []


def test_upsert(e):
    e.execute("CREATE TABLE u (k INTEGER PRIMARY KEY, n INTEGER, s TEXT); INSERT INTO u VALUES (1, 1, 'a'), (2, 2, 'b')")
    e.sql("INSERT INTO u VALUES (2, 10, 'x'), (3, 3, 'c') ON DUPLICATE KEY UPDATE n = n + VALUES(n)")
    assert got(e, "SELECT * FROM u") == [[1, 1, "a"], [2, 12, "b"], [3, 3, "c"]]
    e.execute("CREATE TABLE w (k INTEGER PRIMARY KEY, n INTEGER CHECK (n < 10)); INSERT INTO w VALUES (1, 6)")
    for bad in ("(1, 6)", "(4, 1), (4, 2)"):
        with pytest.raises(ConstraintError):
            e.sql(f"INSERT INTO w VALUES {bad} ON DUPLICATE KEY UPDATE n = n + VALUES(n)")
    assert got(e, "SELECT * FROM w") == [[1, 6]]


def test_constraints(e):
    e.execute("CREATE TABLE p (id INTEGER PRIMARY KEY); CREATE TABLE c (id INTEGER UNIQUE, p_id INTEGER REFERENCES p(id) ON DELETE CASCADE, v VECTOR(2), g INTEGER CHECK (g > 0))")
    e.execute("INSERT INTO p VALUES (1), (2); INSERT INTO c VALUES (1, 1, '[1, 2]', 1), (2, NULL, NULL, NULL)")
    for bad in ("INSERT INTO p VALUES (1)", "INSERT INTO p VALUES (5), (5)", "INSERT INTO p VALUES (NULL)", "INSERT INTO c VALUES (3, 9, NULL, 1)", "INSERT INTO c VALUES (3, 1, '[1]', 1)", "INSERT INTO c VALUES (3, 1, NULL, 0)", "UPDATE c SET id = 2", "UPDATE c SET g = -1 WHERE id = 1"):
        with pytest.raises(ConstraintError):
            e.sql(bad)
    assert got(e, "SELECT id, p_id, g FROM c") == [[1, 1, 1], [2, None, None]]
    e.sql("DELETE FROM p WHERE id = 1")
    assert got(e, "SELECT id FROM c") == [[2]] and got(e, "SELECT id FROM p") == [[2]]
    with pytest.raises(NotImplementedError):
        e.sql("BEGIN")


def test_alter_views_and_copies(e):
    e.execute("CREATE TABLE a (k INTEGER, s TEXT); INSERT INTO a VALUES (1, '7'), (2, 'x')")
    e.execute("ALTER TABLE a ADD COLUMN n INTEGER DEFAULT 4; ALTER TABLE a RENAME COLUMN s TO t; ALTER TABLE a MODIFY COLUMN t INTEGER")
    assert got(e, "SELECT k, t, n FROM a") == [[1, 7, 4], [2, None, 4]]
    e.execute("ALTER TABLE a DROP COLUMN n; ALTER TABLE a RENAME TO b; CREATE VIEW few AS SELECT * FROM b WHERE k < 2; CREATE TABLE copy AS SELECT k * 2 AS kk FROM b; CREATE INDEX i ON b (k)")
    assert got(e, "SELECT * FROM few") == [[1, 7]] and got(e, "SELECT kk FROM copy") == [[2], [4]]
    assert "b" in [r[0] for r in got(e, "SHOW TABLES")] and [r[0] for r in got(e, "DESCRIBE b")] == ["k", "t"]
    assert "Project" in got(e, "EXPLAIN SELECT k + 1 AS x FROM b")[0][0]


def test_show_and_describe(e):
    e.execute("CREATE TABLE parents (id INTEGER PRIMARY KEY AUTO_INCREMENT, mail TEXT UNIQUE NOT NULL); CREATE TABLE kids (k INTEGER, p INTEGER REFERENCES parents(id), n FLOAT DEFAULT 1.5 CHECK (n > 0), v VECTOR(3), PRIMARY KEY (k))")
    e.execute("CREATE INDEX by_n ON kids (n); CREATE UNIQUE INDEX one ON kids (p, n) USING HASH; CREATE VIEW some AS SELECT k FROM kids WHERE n > 2")
    assert got(e, "SHOW TABLES") == [["kids"], ["parents"]] and got(e, "SHOW VIEWS") == [["some"]]
    assert e.query_one("SHOW CREATE VIEW some") == {"View": "some", "Create View": "CREATE VIEW some AS SELECT k FROM kids WHERE n > 2"}
    assert e.query_one("SHOW CREATE TABLE parents")["Create Table"] == "CREATE TABLE parents (id Integer PRIMARY KEY AUTO_INCREMENT, mail Text UNIQUE NOT NULL)"
    assert e.query_one("SHOW CREATE TABLE kids")["Create Table"] == "CREATE TABLE kids (k Integer PRIMARY KEY, p Integer, n Float DEFAULT 1.5 CHECK (n > 0), v Vector(3), FOREIGN KEY (p) REFERENCES parents(id) ON DELETE RESTRICT)"
    assert got(e, "SHOW INDEXES FROM kids") == [["kids", "by_n", "n", "BTREE", False], ["kids", "one", "(p, n)", "HASH", True]]
    assert got(e, "SHOW INDEXES FROM parents") == [["parents", "unique_parents_mail", "mail", "BTREE", True]]
    assert [[x["Field"], x["Type"], x["Null"], x["Key"], x["Default"], x["Extra"]] for x in e.query("DESCRIBE kids")] == [["k", "Integer", "NO", "PRI", "", ""], ["p", "Integer", "YES", "MUL", "", ""], ["n", "Float", "YES", "", "1.5", ""], ["v", "Vector(3)", "YES", "", "", ""]]
    e.execute("INSERT INTO parents (mail) VALUES ('a'); INSERT INTO kids (k, p) VALUES (1, 1)")
    with pytest.raises(ConstraintError):
        e.sql("INSERT INTO kids (k, p) VALUES (2, 1)")
    e.execute("DROP INDEX one; INSERT INTO kids (k, p) VALUES (2, 1); DROP VIEW some")
    assert got(e, "SELECT k FROM kids") == [[1], [2]] and got(e, "SHOW VIEWS") == []


def test_counters_over_partitions(e, spark):
    spark.range(1000).selectExpr("CAST(id AS STRING) AS name").repartition(7).createOrReplaceTempView("names")
    e.execute("CREATE TABLE n (id INTEGER PRIMARY KEY AUTO_INCREMENT, name TEXT); INSERT INTO n (name) SELECT name FROM names; INSERT INTO n (name) SELECT name FROM names")
    assert sorted(x[0] for x in got(e, "SELECT id FROM n")) == list(range(1, 2001))


def test_catalog_outlives_its_engine(spark, tmp_path):
    at = f"file://{tmp_path}/catalog.json"
    a = Engine(spark, at)
    a.execute("CREATE TABLE kept (id INTEGER PRIMARY KEY, s TEXT CHECK (s <> '')); INSERT INTO kept VALUES (1, 'x'); CREATE VIEW short AS SELECT s FROM kept; CREATE INDEX i ON kept (s)")
    spark.catalog.dropTempView("kept")
    spark.catalog.dropTempView("short")
    b = Engine(spark, at)
    assert got(b, "SELECT * FROM kept") == [[1, "x"]] and got(b, "SELECT * FROM short") == [["x"]] and len(got(b, "SHOW INDEXES FROM kept")) == 1
    for bad in ("(1, 'y')", "(2, '')"):
        with pytest.raises(ConstraintError):
            b.sql(f"INSERT INTO kept VALUES {bad}")
    b.execute("INSERT INTO kept VALUES (2, 'z'); DROP VIEW short; DROP TABLE kept")
    assert Engine(spark, at).store.tables == {}


def test_changes_write_only_the_files_they_touch(e):
    e.execute("CREATE TABLE f (k INTEGER PRIMARY KEY, v INTEGER); INSERT INTO f VALUES (1, 1), (2, 2); INSERT INTO f VALUES (3, 3); INSERT INTO f VALUES (4, 4)")
    before = set(e.store.frame("f").inputFiles())
    e.sql("UPDATE f SET v = v * 10 WHERE k = (SELECT max(k) - 1 FROM f)")
    after = set(e.store.frame("f").inputFiles())
    assert got(e, "SELECT * FROM f") == [[1, 1], [2, 2], [3, 30], [4, 4]] and 0 < len(before - after) < len(before)
    with pytest.raises(ConstraintError):
        e.sql("UPDATE f SET k = 1 WHERE k = 4")
    assert e.query_one("DELETE FROM f WHERE f.v < 2 OR k = 4") == {"rows_affected": 2}
    assert e.query_one("UPDATE f SET v = 0 WHERE k > 99") == {"rows_affected": 0}
    e.sql("VACUUM")
    assert got(e, "SELECT * FROM f") == [[2, 2], [3, 30]] and e.query_one("DELETE FROM f") == {"rows_affected": 2}
    assert got(e, "SELECT * FROM f") == [] and e.query_one("UPDATE f SET v = 1") == {"rows_affected": 0}


def test_versions(e):
    e.execute("CREATE TABLE v (id INTEGER PRIMARY KEY, n INTEGER); INSERT INTO v VALUES (1, 1), (2, 2); UPDATE v SET n = 9 WHERE id = 2; DELETE FROM v WHERE id = 1")
    numbers = [x[0] for x in e.store.tables["v"].versions]
    assert got(e, f"SELECT id, n FROM v AS OF TRANSACTION {numbers[1]}") == [[1, 1], [2, 2]]
    assert got(e, "SELECT v.id, w.n FROM v JOIN v AS OF TRANSACTION $1 AS w ON v.id = w.id", [numbers[2]]) == [[2, 9]]
    assert got(e, f"SELECT id FROM v AS OF TRANSACTION {numbers[0]}") == [] and got(e, "SELECT n FROM v") == [[9]]
    with pytest.raises(ValueError):
        e.sql("SELECT * FROM v AS OF TIMESTAMP '2000-01-01 00:00:00'")
    e.sql("VACUUM")
    assert got(e, f"SELECT id FROM v AS OF TRANSACTION {numbers[3]}") == [[2]]
    with pytest.raises(ValueError):
        e.sql(f"SELECT id FROM v AS OF TRANSACTION {numbers[1]}")


def test_references_in_circles(e):
    e.execute("CREATE TABLE n (id INTEGER PRIMARY KEY, up INTEGER REFERENCES n(id) ON DELETE CASCADE ON UPDATE CASCADE); INSERT INTO n VALUES (1, NULL), (2, 1), (3, 2), (4, 4), (5, NULL)")
    e.sql("UPDATE n SET id = 10 WHERE id = 1")
    assert got(e, "SELECT id, up FROM n") == [[10, None], [2, 10], [3, 2], [4, 4], [5, None]]
    assert e.query_one("DELETE FROM n WHERE id IN (10, 4)") == {"rows_affected": 2}
    assert got(e, "SELECT id FROM n") == [[5]]
    e.execute("CREATE TABLE p (id INTEGER PRIMARY KEY); CREATE TABLE q (id INTEGER PRIMARY KEY, p INTEGER REFERENCES p(id) ON DELETE CASCADE); CREATE TABLE r (q INTEGER REFERENCES q(id)); INSERT INTO p VALUES (1), (2); INSERT INTO q VALUES (7, 1), (8, 2); INSERT INTO r VALUES (8)")
    with pytest.raises(ConstraintError):
        e.sql("DELETE FROM p WHERE id > 0")  # r refuses behind q: nothing has changed
    assert len(got(e, "SELECT * FROM p")) == 2 and len(got(e, "SELECT * FROM q")) == 2
    with pytest.raises(ConstraintError):
        e.sql("UPDATE q SET id = 9 WHERE id = 8")
    e.sql("DELETE FROM p WHERE id = 1")
    assert got(e, "SELECT id FROM q") == [[8]]
