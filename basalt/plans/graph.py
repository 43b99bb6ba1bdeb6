"""Questions about a knowledge graph whose notes, links and dates are made of the tables."""

from __future__ import annotations

import datetime
import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.operators import context, notes
from basalt.session import table

from .registry import query

#: Documents as rows of a search index.
INDEX = ["doc_id AS id", "CASE WHEN doc_id % 3 = 0 THEN 'observation' ELSE 'entity' END AS type", "concat('Doc ', doc_id, ' ', lang) AS title", "text AS content", "concat('docs/', lang, '/', doc_id) AS permalink",
         "to_json(named_struct('entity_type', lang, 'status', CASE WHEN doc_id % 2 = 0 THEN 'active' ELSE 'draft' END, 'tags', array(lang, concat('n', doc_id % 5)))) AS metadata",
         "timestamp_seconds(1700000000 + doc_id * 3600) AS created_at", "timestamp_seconds(1700000000 + doc_id * 3600) AS updated_at", "doc_id % 2 AS project_id"]

_FILTERS = """SELECT 'glob' AS how, doc_id AS id FROM documents WHERE lang = 'en' AND doc_id::VARCHAR LIKE '1%'
UNION ALL SELECT 'path', doc_id FROM documents WHERE doc_id = 7 AND lang IS NOT NULL
UNION ALL SELECT 'tag', doc_id FROM documents WHERE lang = 'en' AND doc_id % 5 = 1
UNION ALL SELECT 'status', doc_id FROM documents WHERE doc_id % 2 = 0 AND lang IN ('de', 'fr')
UNION ALL (SELECT 'after', doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id > 50 ORDER BY doc_id DESC LIMIT 5 OFFSET 2)
UNION ALL SELECT 'title', doc_id FROM documents WHERE lang = 'de' AND doc_id % 2 = 1 AND contains(lower(text), 'die')"""


@query("search_filters", _FILTERS)
def search_filters(spark, sf_dir):
    index = table(spark, sf_dir, "documents").selectExpr(*INDEX)
    seven = table(spark, sf_dir, "documents").where("doc_id = 7").select("lang").first()
    ways = {
        "glob": {"permalink_match": " docs/EN/1*"}, "path": {"permalink": f"docs/{seven.lang if seven else ''}/7"}, "tag": {"text": "tag:en, n1"}, "status": {"status": "active", "kinds": ["de", "fr"]},
        "after": {"types": ["observation"], "after": datetime.datetime.fromtimestamp(1700000000 + 50 * 3600, datetime.UTC), "limit": 5, "offset": 2}, "title": {"title": "de", "text": '"die"', "project": 1}, "nothing": {},
    }
    return functools.reduce(DataFrame.union, [context.find(index, **w).select(F.lit(k).alias("how"), "id") for k, w in ways.items()])


def _customers(spark, sf_dir):
    """Customers, nations and regions as entities, who belongs where as relations."""
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    day = "TIMESTAMP '2020-01-01' + make_dt_interval(CAST({} AS INT))"
    es = c.selectExpr("concat('c', c_custkey) AS id", "c_name AS title", f"{day.format('c_custkey')} AS created_at").union(n.selectExpr("concat('n', n_nationkey)", "n_name", day.format("n_nationkey + 30"))).union(r.selectExpr("concat('r', r_regionkey)", "r_name", day.format("90")))
    rs = c.selectExpr("concat('c', c_custkey, '>') AS id", "concat('c', c_custkey) AS from_id", "CASE WHEN c_custkey % 9 > 0 THEN concat('n', c_nationkey) END AS to_id", "'home' AS to_name", "'lives in' AS relation_type").union(n.selectExpr("concat('n', n_nationkey, '>')", "concat('n', n_nationkey)", "concat('r', n_regionkey)", "'region'", "'part of'"))
    return es, rs


_E = "e AS (SELECT 'c' || c_custkey AS id, c_name AS title, TIMESTAMP '2020-01-01' + to_days(c_custkey::INT) AS born FROM customer UNION ALL SELECT 'n' || n_nationkey, n_name, TIMESTAMP '2020-01-01' + to_days(n_nationkey + 30) FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, TIMESTAMP '2020-01-01' + to_days(90) FROM region)"
_R = "r AS (SELECT 'c' || c_custkey || '>' AS id, 'c' || c_custkey AS f, CASE WHEN c_custkey % 9 > 0 THEN 'n' || c_nationkey END AS t, 'lives in: home' AS title FROM customer UNION ALL SELECT 'n' || n_nationkey || '>', 'n' || n_nationkey, 'r' || n_regionkey, 'part of: region' FROM nation)"


def _walk(seeds: str, depth: int, after: str) -> str:
    """The walks of `related` in SQL."""
    return f"""WITH RECURSIVE {_E}, {_R}, k AS (SELECT * FROM e WHERE born >= TIMESTAMP '{after}'), l AS (SELECT * FROM r WHERE f IN (SELECT id FROM k)),
w(root_id, type, id, depth, nxt) AS (SELECT id, 'entity', id, 0, NULL::VARCHAR FROM k WHERE id IN ({seeds})
  UNION SELECT root_id, CASE WHEN w.type = 'entity' THEN 'relation' ELSE 'entity' END, CASE WHEN w.type = 'entity' THEN l.id ELSE nxt END, depth + 1, CASE WHEN w.type = 'entity' THEN CASE WHEN l.f = w.id THEN l.t ELSE l.f END END
  FROM w LEFT JOIN l ON w.type = 'entity' AND (l.f = w.id OR l.t = w.id) WHERE depth < {2 * depth} AND (l.id IS NOT NULL OR nxt IN (SELECT id FROM k)))
SELECT root_id, type, w.id, coalesce(e.title, r.title) AS title, min(depth)::INTEGER AS depth FROM w LEFT JOIN e ON w.type = 'entity' AND e.id = w.id LEFT JOIN r ON w.type = 'relation' AND r.id = w.id WHERE depth > 0 GROUP BY ALL"""


@query("context_related", _walk("'n3', 'r1', 'c9'", 2, "2020-01-01"))
def context_related(spark, sf_dir):
    return context.related(spark.createDataFrame([("n3",), ("r1",), ("c9",)], "root_id string"), *_customers(spark, sf_dir), depth=2)


@query("context_since", _walk("'n3', 'r1'", 1, "2020-02-03"))
def context_since(spark, sf_dir):
    return context.related(spark.createDataFrame([("n3",), ("r1",)], "root_id string"), *_customers(spark, sf_dir), depth=1, after=datetime.datetime(2020, 2, 3))


@query("context_build", """WITH p AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey::VARCHAR LIKE '1%'),
a AS (SELECT 'c' || c_custkey AS root_id, 'primary' AS part, 'entity' AS type, 'c' || c_custkey AS id, c_name AS title, 0 AS depth FROM p
  UNION ALL SELECT 'c' || o_custkey, 'observation', 'observation', 'o' || o_orderkey, o_orderstatus || ': ' || o_orderpriority || '...', 0 FROM orders JOIN p ON o_custkey = c_custkey
  UNION ALL SELECT 'c' || c_custkey, 'related', 'relation', 'c' || c_custkey || '>', 'lives in: home', 1 FROM p
  UNION ALL SELECT 'c' || c_custkey, 'related', 'entity', 'n' || c_nationkey, n_name, 2 FROM p JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 9 > 0) SELECT * FROM a""")
def context_build(spark, sf_dir):
    es, rs = _customers(spark, sf_dir)
    index = table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS id", "'entity' AS type", "c_name AS title", "'' AS content", "concat('customers/', lower(c_mktsegment), '/', c_custkey) AS permalink", "'{}' AS metadata", "current_timestamp() AS created_at", "current_timestamp() AS updated_at", "1 AS project_id")
    observations = table(spark, sf_dir, "orders").selectExpr("concat('o', o_orderkey) AS id", "concat('c', o_custkey) AS entity_id", "o_orderstatus AS category", "o_orderpriority AS content")
    return context.build(index, es, observations, rs, "memory://Customers/Building/1*", max_related=10)


@query("recent_activity", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'entity' ELSE 'relation' END AS type FROM orders WHERE o_orderdate > TIMESTAMP '1998-08-02 12:00:00' - INTERVAL 21 DAY AND o_orderstatus IN ('F', 'O')")
def recent_activity(spark, sf_dir):
    index = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE o_orderstatus WHEN 'F' THEN 'entity' WHEN 'O' THEN 'relation' ELSE 'observation' END AS type", "o_orderdate AS created_at")
    return context.recent(index, "3 weeks ago", datetime.datetime(1998, 8, 2, 12), ["ENTITY", "relation"]).select("id", "type")


@query("link_resolution_search", """WITH w AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ') || [lower(p_type), p_partkey::VARCHAR]) AS w FROM part),
l AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS name FROM part), h AS (SELECT name, p_partkey, len(w) AS n FROM l JOIN w ON list_has_all(w, list_distinct(string_split(name, ' '))))
SELECT name, p_partkey AS entity_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n, p_partkey) AS r FROM h) WHERE r = 1 UNION ALL SELECT 'no such part', NULL UNION ALL SELECT 'cold*', NULL""")
def link_resolution_search(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    es = part.selectExpr("p_partkey AS entity_id", "p_name AS title", "concat(lower(p_type), '/', p_partkey) AS permalink", "concat(p_partkey, '.md') AS file_path")
    ls = part.selectExpr("concat(p_name, ' ', lower(p_type)) AS name").distinct().union(spark.createDataFrame([("no such part",), ("cold*",)], "name string")).selectExpr("name AS link_id", "name", "'x.md' AS source")
    return context.fuzzy_links(notes.resolve_links(ls, es), es).select("name", "entity_id")


_FILES = "SELECT p_type || '/' || replace(p_brand, '#', '') || '/' || p_name || '.md' AS f FROM part"


@query("directory_listing", f"""SELECT DISTINCT * FROM (SELECT '/PROMO/' || split_part(f, '/', 2) AS path, 'directory' AS type, split_part(f, '/', 2) AS name FROM ({_FILES}) WHERE f LIKE 'PROMO/%' AND split_part(f, '/', 2) LIKE '%2%'
UNION ALL SELECT '/' || f, 'file', split_part(f, '/', 3) FROM ({_FILES}) WHERE f LIKE 'PROMO/%' AND split_part(f, '/', 2) LIKE '%2%' AND split_part(f, '/', 3) LIKE '%2%' UNION ALL SELECT '/' || split_part(f, '/', 1), 'directory', split_part(f, '/', 1) FROM ({_FILES}))""")
def directory_listing(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.concat(F.concat_ws("/", "p_type", F.replace("p_brand", F.lit("#"), F.lit("")), "p_name"), F.lit(".md")).alias("file_path"))
    return context.listing(files, "./PROMO/", 2, "*2*").union(context.listing(files))


@query("note_upsert", """SELECT 'parts/' || p_partkey || '.md' AS file_path, CASE WHEN p_partkey % 3 = 1 THEN 'T' || p_partkey WHEN p_partkey % 7 = 0 THEN p_partkey::VARCHAR ELSE p_name END AS title,
  CASE WHEN p_partkey % 3 = 1 THEN 'thing' WHEN p_partkey % 7 = 0 THEN 'note' ELSE 'part' END AS entity_type, 'parts/' || p_partkey AS permalink, CASE WHEN p_partkey % 3 = 1 OR p_partkey % 7 = 0 THEN 'updated' ELSE 'same' END AS change FROM part
UNION ALL SELECT 'new/Part A' || s_suppkey || '.md', 'Part A' || s_suppkey, 'note', 'new/part-a' || s_suppkey, 'created' FROM supplier
UNION ALL SELECT 'two/b.md', 'b', 'note', 'same/link', 'created' UNION ALL SELECT 'two/c.md', 'c', 'note', 'same/link-1', 'created' UNION ALL SELECT 'two/Parts/0.md', '0', 'note', 'two/parts/0', 'created'""")
def note_upsert(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    es = part.selectExpr("p_partkey AS id", "p_name AS title", "'part' AS entity_type", "concat('parts/', p_partkey) AS permalink", "concat('parts/', p_partkey, '.md') AS file_path", "sha2('old', 256) AS checksum")
    by_path = part.where("p_partkey % 3 = 1").selectExpr("concat('parts/', p_partkey, '.md') AS file_path", r"concat('---\ntitle: T', p_partkey, '\ntype: thing\n---\nbody') AS text")
    by_link = part.where("p_partkey % 7 = 0 AND p_partkey % 3 <> 1").selectExpr("concat('moved/', p_partkey, '.md') AS file_path", r"concat('---\npermalink: parts/', p_partkey, '\n---\nbody') AS text")
    fresh = table(spark, sf_dir, "supplier").selectExpr("concat('new/Part A', s_suppkey, '.md') AS file_path", "'text' AS text")
    more = spark.createDataFrame([("two/b.md", "---\npermalink: same/link\n---\nx"), ("two/c.md", "---\npermalink: same/link\n---\ny"), ("two/Parts/0.md", "z")], "file_path string, text string")
    return context.upsert(es, by_path.union(by_link).union(fresh).union(more)).select("file_path", "title", "entity_type", "permalink", "change")


@query("import_projects", r"""SELECT 'in/Project_' || o_custkey || '_/docs/' || o_orderkey || '_' || regexp_replace(regexp_replace(o_orderpriority, '[\s\-]+', '_', 'g'), '[^\w]+', '', 'g') || '_md' AS permalink, 'project_doc' AS type, o_orderkey || ' ' || o_orderpriority || '.md' AS title, '2024-01-01' AS created, '2024-02-02' AS modified, 'Status ' || o_orderstatus AS content FROM orders WHERE o_custkey < 20
UNION ALL SELECT DISTINCT 'in/Project_' || o_custkey || '_/prompt-template', 'prompt_template', 'Prompt Template: Project (' || o_custkey || ')', '2024-01-01', '2024-02-02', '# Prompt Template: Project (' || o_custkey || ')' || chr(10) || chr(10) || 'Be brief.' FROM orders WHERE o_custkey < 20 AND o_custkey % 2 = 1""")
def import_projects(spark, sf_dir):
    doc = F.struct(F.col("o_orderkey").cast("string").alias("uuid"), F.concat(F.col("o_orderkey"), F.lit(" "), F.col("o_orderpriority"), F.lit(".md")).alias("filename"), F.concat(F.lit("Status "), F.col("o_orderstatus")).alias("content"))
    projects = table(spark, sf_dir, "orders").where("o_custkey < 20").groupBy("o_custkey").agg(F.collect_list(doc).alias("docs"))
    lines = projects.select(F.to_json(F.struct(F.concat(F.lit("Project ("), F.col("o_custkey"), F.lit(")")).alias("name"), F.lit("2024-01-01").alias("created_at"), F.lit("2024-02-02").alias("updated_at"), F.when(F.col("o_custkey") % 2 == 1, F.lit("Be brief.")).otherwise(F.lit("")).alias("prompt_template"), "docs")).alias("value"))
    return context.project_export(lines, "in").drop("project_name")
