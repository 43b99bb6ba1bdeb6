"""Notes, links, graphs, search and ingestion."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basalt.operators import notes, ranked, recursive, search
from basalt.session import shared, table
from basalt.sources import web

from .registry import query

#: A note of each part, with the words of its row in a head, observations, relations and prose.
NOTE = """---
title: {p_name}
tags: [{p_type}, other]
status: {p_mfgr}
---
# {p_name}

- [{p_type}] Size {p_size} here #size{p_size} #of (seen by {p_brand})
- [ ] a task
- a plain item with #tag{p_size}
- [link](http://x.example)
- made by [[{p_brand}]] (since {p_partkey})
- [[{p_type}]]
Prose with [[In [[{p_type}]] out]] and [[{p_name}]].
"""


def _note(spark, sf_dir):
    pieces = [F.lit(x) if i % 2 == 0 else F.col(x).cast("string") for i, x in enumerate(re.split(r"[{}]", NOTE))]
    part = table(spark, sf_dir, "part").withColumn("p_mfgr", F.when(F.col("p_size") % 2 == 0, "active").otherwise("draft"))
    parsed = part.select(F.col("p_partkey").alias("entity_id"), "p_name", F.concat(*pieces).alias("text")).withColumn("f", notes.frontmatter("text"))
    return parsed.select("entity_id", "p_name", F.col("f.metadata").alias("metadata"), F.col("f.body").alias("body"))


@query("note_frontmatter", "SELECT p_partkey AS entity_id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'active' ELSE 'draft' END AS status, '[\"' || p_type || '\",\"other\"]' AS tags, 'Prose with [[In [[' || p_type || ']] out]] and [[' || p_name || ']].' AS last FROM part")
def note_frontmatter(spark, sf_dir):
    j = lambda k: F.get_json_object("metadata", f"$.{k}").alias(k)
    return _note(spark, sf_dir).select("entity_id", j("title"), j("status"), j("tags"), F.element_at(F.split(F.trim(F.replace("body", F.lit("\n"), F.lit("\x01"))), "\x01"), -2).alias("last"))


_OBSERVATIONS = "SELECT p_partkey AS entity_id, p_type AS category, 'Size ' || p_size || ' here #size' || p_size || ' #of' AS content, 'size' || p_size || ',of' AS tags, 'seen by ' || p_brand AS context FROM part UNION ALL SELECT p_partkey, NULL, 'a plain item with #tag' || p_size, 'tag' || p_size, NULL FROM part"
_RELATIONS = "SELECT p_partkey AS entity_id, 'made by' AS relation_type, p_brand AS to_name, 'since ' || p_partkey AS context FROM part UNION ALL SELECT p_partkey, 'relates_to', p_type, NULL FROM part"


@query("note_observations", _OBSERVATIONS)
def note_observations(spark, sf_dir):
    return notes.observations(_note(spark, sf_dir)).select("entity_id", "category", "content", F.array_join("tags", ",").alias("tags"), "context")


@query("note_relations", _RELATIONS)
def note_relations(spark, sf_dir):
    return notes.relations(_note(spark, sf_dir)).select("entity_id", "relation_type", "to_name", "context")


@query("note_inline_links", "SELECT p_partkey AS entity_id, unnest([p_brand, p_type, 'In [[' || p_type || ']] out', p_name]) AS target FROM part")
def note_inline_links(spark, sf_dir):
    return _note(spark, sf_dir).select("entity_id", F.explode(notes.inline_links("body")).alias("target"))


_PERMALINK = "SELECT p_partkey, regexp_replace(regexp_replace(lower(replace(p_brand, '#', ' No')), '[^a-z0-9/.-]', '-', 'g'), '-+', '-', 'g') || '/' || replace(p_name, ' ', '-') AS permalink FROM part"


@query("permalinks", _PERMALINK.replace("lower(replace(p_brand, '#', ' No'))", "lower(replace(p_brand, '#', ' No'))"))
def permalinks(spark, sf_dir):
    path = F.concat(F.replace("p_brand", F.lit("#"), F.lit(" No")), F.lit("/"), F.col("p_name"), F.lit(".md"))
    return table(spark, sf_dir, "part").select("p_partkey", notes.ascii_permalink(path).alias("permalink"))


@query("permalinks_unicode", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'docs/my-feature-' || w WHEN 1 THEN 'cafe-creme-' || w WHEN 2 THEN '中文/测试文档-' || p_partkey WHEN 3 THEN 'version-2.0.' || p_partkey ELSE 'api-v2-' || w END AS permalink
FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS w FROM part)""")
def permalinks_unicode(spark, sf_dir):
    forms = ["concat('docs/My Feature ', p_name, '.md')", "concat('CaféCrème ', p_name, '.md')", "concat('中文/测试文档', p_partkey, '.md')", "concat('Version 2.0.', p_partkey)", "concat('API (v2) ', p_name, '.md')"]
    path = F.expr("CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END")
    return table(spark, sf_dir, "part").select("p_partkey", notes.permalink(path).alias("permalink"))


@query("permalinks_unique", "SELECT p_partkey, p_name || CASE WHEN r > 0 THEN '-' || r ELSE '' END AS permalink FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS r FROM part)")
def permalinks_unique(spark, sf_dir):
    return notes.unique_permalinks(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("permalink")), "p_partkey")


@query("tags", "SELECT p_partkey, p_type || ',' || p_size AS tags FROM part")
def tags(spark, sf_dir):
    listed = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("#"), "p_type", F.lit(", ,##"), F.col("p_size"), F.lit(" ,"))).otherwise(F.concat(F.lit('["#'), "p_type", F.lit('", " ", "'), F.col("p_size"), F.lit('"]')))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(notes.parse_tags(listed), ",").alias("tags"))


@query("text_variants", "SELECT p_partkey, unnest(list_distinct([p_type || '/' || p_name, lower(p_type || '/' || p_name), p_type, p_name, lower(p_type)] || string_split(lower(p_name), ' ') || [lower(p_name)])) AS v FROM part")
def text_variants(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(notes.text_variants(F.concat_ws("/", "p_type", "p_name"))).alias("v"))


def _graph(spark, sf_dir):
    """Customers, nations and regions as entities; who belongs where as relations."""
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    es = c.selectExpr("concat('c', c_custkey) AS entity_id", "c_name AS title").union(n.selectExpr("concat('n', n_nationkey)", "n_name")).union(r.selectExpr("concat('r', r_regionkey)", "r_name"))
    rs = c.selectExpr("concat('c', c_custkey) AS from_id", "concat('n', c_nationkey) AS to_id").union(n.selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)"))
    return es, rs


_EDGES = "SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"


@query("graph_context", f"WITH RECURSIVE e AS (SELECT src, dst FROM ({_EDGES}) UNION SELECT dst, src FROM ({_EDGES})), t(id, depth) AS (SELECT 'r0', 0 UNION SELECT e.dst, depth + 1 FROM t JOIN e ON e.src = t.id WHERE depth < 2) SELECT id, min(depth) AS depth FROM t GROUP BY id")
def graph_context(spark, sf_dir):
    _, rs = _graph(spark, sf_dir)
    return recursive.reach(spark.createDataFrame([("r0",)], "id string"), rs.selectExpr("from_id AS src", "to_id AS dst"), 2)


@query("graph_statistics", "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS entities, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS relations, 0::BIGINT AS unresolved, (SELECT count(*) FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)) AS isolated")
def graph_statistics(spark, sf_dir):
    return notes.statistics(*_graph(spark, sf_dir))


@query("graph_most_connected", "SELECT o_custkey AS entity_id, count(*) AS outgoing FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 10")
def graph_most_connected(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    es = o.select(F.col("o_custkey").alias("entity_id")).distinct()
    return notes.most_connected(es, o.select(F.col("o_custkey").alias("from_id"))).select("entity_id", "outgoing")


@query("graph_activity", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def graph_activity(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


_ENTITIES = "SELECT p_partkey AS id, p_name AS title, lower(p_type) || '/' || p_partkey AS permalink, p_type || '/' || p_brand || '/' || p_partkey || '.md' AS path FROM part"


def _entities(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS entity_id", "p_name AS title", "concat(lower(p_type), '/', p_partkey) AS permalink", "concat(p_type, '/', p_brand, '/', p_partkey, '.md') AS file_path")


@query("link_resolution", f"""WITH e AS ({_ENTITIES}), t AS (SELECT a.p_partkey AS link_id, e.id, row_number() OVER (PARTITION BY a.p_partkey ORDER BY CASE WHEN split_part(e.path, '/', 1) = a.p_type THEN 101 ELSE 1000 END, length(e.path), e.id) AS r FROM part a JOIN e ON e.title = a.p_name WHERE a.p_partkey % 5 = 1)
SELECT p_partkey AS link_id, CASE p_partkey % 5 WHEN 1 THEN t.id WHEN 4 THEN NULL ELSE p_partkey END AS entity_id FROM part LEFT JOIN t ON p_partkey = link_id AND r = 1""")
def link_resolution(spark, sf_dir):
    es = _entities(spark, sf_dir)
    name = F.expr("CASE entity_id % 5 WHEN 0 THEN permalink WHEN 1 THEN title WHEN 2 THEN file_path WHEN 3 THEN replace(file_path, '.md', '') ELSE 'nothing like it' END")
    return notes.resolve_links(es.select(F.col("entity_id").alias("link_id"), name.alias("name"), F.concat(F.substring_index("file_path", "/", 1), F.lit("/from.md")).alias("source")), es).select("link_id", "entity_id")


@query("forward_relations", f"""WITH e AS ({_ENTITIES}), n AS (SELECT title AS n, min(id) AS lo FROM e GROUP BY title)
SELECT id AS from_id, CASE id % 3 WHEN 0 THEN nullif(lo, id) WHEN 1 THEN id + 1 END AS to_id, CASE id % 3 WHEN 2 THEN 'none' ELSE title END AS to_name FROM e JOIN n ON title = n""")
def forward_relations(spark, sf_dir):
    es = _entities(spark, sf_dir)
    rs = es.selectExpr("entity_id AS from_id", "CASE WHEN entity_id % 3 = 1 THEN entity_id + 1 END AS to_id", "CASE entity_id % 3 WHEN 2 THEN 'none' ELSE title END AS to_name", "'x' AS relation_type")
    return notes.resolve_forward(rs.union(rs), es).select("from_id", "to_id", "to_name")


@query("sync_diff", "SELECT CASE p_partkey % 10 WHEN 1 THEN 'deleted' WHEN 2 THEN 'moved' ELSE 'modified' END AS change, CASE p_partkey % 10 WHEN 2 THEN 'moved/' ELSE '' END || p_partkey AS path, CASE p_partkey % 10 WHEN 2 THEN p_partkey::VARCHAR END AS old_path FROM part WHERE p_partkey % 10 IN (1, 2, 3) UNION ALL SELECT 'new', 'new/' || s_suppkey, NULL FROM supplier")
def sync_diff(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    before = part.selectExpr("CAST(p_partkey AS STRING) AS path", "CAST(p_size AS DOUBLE) AS mtime", "p_partkey AS size", "sha2(CAST(p_partkey AS STRING), 256) AS checksum")
    kind = "p_partkey % 10"
    now = part.where(f"{kind} <> 1").selectExpr(f"concat(CASE WHEN {kind} = 2 THEN 'moved/' ELSE '' END, p_partkey) AS path", f"p_size + CASE {kind} WHEN 3 THEN 2.0D WHEN 4 THEN 9.0D WHEN 5 THEN 0.005D ELSE 0.0D END AS mtime", f"p_partkey + CAST({kind} = 3 AS INT) AS size", f"sha2(concat(p_partkey, CASE WHEN {kind} = 3 THEN '!' ELSE '' END), 256) AS checksum")
    fresh = table(spark, sf_dir, "supplier").selectExpr("concat('new/', s_suppkey) AS path", "1.0D AS mtime", "1L AS size", "concat('s', s_suppkey) AS checksum")
    return notes.sync_diff(before, now.union(fresh))


@query("note_edits", "SELECT p_partkey, p_name || chr(10) || 'b' AS appended, 'x' || chr(10) || p_name AS prepended, replace(p_name, ' ', '$1') AS replaced, '# H' || chr(10) || 'new' || chr(10) || '## I' || chr(10) || p_type AS section, p_name || chr(10) || '# J' || chr(10) || 'new' || chr(10) AS added FROM part")
def note_edits(spark, sf_dir):
    t, sectioned = F.col("p_name"), F.concat(F.lit("# H\nold "), "p_name", F.lit("\n## I\n"), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", notes.edit(t, "append", "b").alias("appended"), notes.edit(t, "prepend", "x").alias("prepended"), notes.edit(t, "find_replace", "$1", " ").alias("replaced"), notes.edit(sectioned, "replace_section", "new", section="# H").alias("section"), notes.edit(t, "replace_section", "new", section="# J").alias("added"))


@query("directory_tree", "SELECT d AS directory, count(*) AS files FROM (SELECT unnest([p_type, p_type || '/' || p_brand]) AS d FROM part) GROUP BY d")
def directory_tree(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", "p_brand", F.concat("p_name", F.lit(".md"))).alias("file_path"))
    return notes.directories(files).select("directory", "files")


@query("move_directory", "SELECT CASE WHEN p_type = 'ECONOMY' THEN 'cheap/' || p_name ELSE p_type || '/' || p_name END AS file_path FROM part")
def move_directory(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", "p_name").alias("file_path"))
    return notes.move_directory(files, "ECONOMY", "cheap")


@query("ignore_patterns", "SELECT p_partkey, p_type IN ('ECONOMY', 'PROMO') OR p_name LIKE 'small%' OR (p_type = 'LARGE' AND p_partkey % 10 = 4 AND length(p_partkey::VARCHAR) = 2) AS ignored FROM part")
def ignore_patterns(spark, sf_dir):
    path = F.concat_ws("/", "p_type", F.concat(F.col("p_partkey"), F.lit(".d")), F.concat("p_name", F.lit(".md")))
    return table(spark, sf_dir, "part").select("p_partkey", notes.ignored(path, ["ECONOMY/", "/PROMO", "small*.md", "/LARGE/?4.d/", "/widget.md"]).alias("ignored"))


@query("search_contains", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'ation')")
def search_contains(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(search.contains_all("the ATION", "text")).select("doc_id")


@query("search_boolean", r"SELECT doc_id FROM documents WHERE (regexp_matches(lower(text), '(^|[^\p{L}\p{N}/])the') OR regexp_matches(lower(text), '(^|[^\p{L}\p{N}/])que')) AND NOT regexp_matches(lower(text), '(^|[^\p{L}\p{N}/])onha')")
def search_boolean(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(search.match("(the OR que) AND NOT onha*", search.words(F.col("text")), F.col("text"))).select("doc_id")


_BM25 = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}/]+'), lambda x: x <> '') AS t FROM documents),
f AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x = 'that')) AS a, len(list_filter(t, lambda x: x = 'und')) AS b FROM w),
s AS (SELECT count(*) AS docs, avg(n) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM f)
SELECT doc_id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / av)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / av)), 6) AS score FROM f, s WHERE a > 0 OR b > 0"""


@query("search_bm25", _BM25)
def search_bm25(spark, sf_dir):
    return search.bm25(table(spark, sf_dir, "documents"), "that und").select("doc_id", F.round("score", 6).alias("score"))


@query("search_postings", _BM25)
def search_postings(spark, sf_dir):
    """The same scores from stored postings, of which a query reads its terms."""
    docs = table(spark, sf_dir, "documents")
    index = search.postings(docs, path=f"{shared(spark)}/postings-{uuid.uuid4().hex}")
    corpus = docs.agg(F.count("*").alias("n_docs"), F.count("text").alias("_texts")).crossJoin(index.agg(F.sum("tf").alias("_words"))).select("n_docs", (F.col("_words") / F.col("_texts")).alias("avg_n"))
    return search.bm25_of(index, corpus, "und that").select("doc_id", F.round("score", 6).alias("score"))


@query("search_metadata", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::DOUBLE >= 10 AND json_extract_string(props, '$.k')::DOUBLE BETWEEN 5 AND 60 AND json_extract_string(props, '$.k') <> '11' AND json_extract_string(props, '$.k') IN ('12', '13', '20', '33')")
def search_metadata(spark, sf_dir):
    cond = search.metadata_filter("props", {"k": {"$gte": 10, "$between": [5, 60], "$in": ["12", "13", "20", "33"]}})
    return table(spark, sf_dir, "events").where(cond).select("event_id")


@query("search_index", f"""SELECT 'entity' AS type, p_name AS title, 'parts/' || p_partkey AS permalink FROM part
UNION ALL SELECT DISTINCT 'observation', concat_ws(': ', category, content), concat_ws('/', 'parts/' || entity_id, 'observations', category, content) FROM ({_OBSERVATIONS})
UNION ALL SELECT 'relation', p_name || ' → ' || to_name, 'parts/' || entity_id || '/' || relation_type || '/' || to_name FROM ({_RELATIONS}) JOIN part ON entity_id = p_partkey""")
def search_index(spark, sf_dir):
    note = _note(spark, sf_dir)
    es = note.selectExpr("entity_id", "p_name AS title", "concat('parts/', entity_id) AS permalink", "body AS content")
    return notes.index_rows(es, notes.observations(note), notes.relations(note)).select("type", "title", "permalink")


@query("import_conversations", "SELECT conv_id, count(*)::INTEGER AS turns, string_agg('### ' || upper(role[1]) || lower(role[2:]) || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def import_conversations(spark, sf_dir):
    return notes.conversations(table(spark, sf_dir, "conversations"))


@query("import_chat_tree", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pos, coalesce(role, 'unknown') AS role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' AND turn % 5 <> 3")
def import_chat_tree(spark, sf_dir):
    """Exported conversations: every fifth message is hidden."""
    node = lambda t: F.concat(F.lit("n"), t)
    turn = F.col("turn")
    message = F.struct(F.struct("role").alias("author"), F.struct(F.array("text").alias("parts")).alias("content"), F.struct((turn % 5 == 3).alias("is_visually_hidden_from_conversation")).alias("metadata"))
    after = F.lead(turn).over(W.partitionBy("conv_id").orderBy("turn"))
    before = F.lag(turn).over(W.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", node(turn).alias("id"), F.struct(node(before).alias("parent"), F.when(after.isNotNull(), F.array(node(after))).otherwise(F.array().cast("array<string>")).alias("children"), message.alias("message")).alias("v"))
    trees = rows.groupBy("conv_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", "v")))).alias("m"))
    return trees.select("conv_id", F.posexplode(notes.linear_chat("m")).alias("pos", "x")).select("conv_id", "pos", "x.role", "x.text")


@query("import_memory_json", """SELECT 'entity' AS kind, n_name AS a, CASE WHEN n_nationkey % 2 = 0 THEN 'nation' ELSE 'unknown' END AS b, CASE WHEN n_nationkey % 3 > 0 THEN 'of ' || n_regionkey END AS c FROM nation
UNION ALL SELECT 'relation', n_name, r_name, 'part_of' FROM nation JOIN region ON n_regionkey = r_regionkey""")
def import_memory_json(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'entityName' ELSE 'id' END")
    entity = F.map_concat(F.create_map(F.lit("type"), F.lit("entity"), name, F.col("n_name")), F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("entityType"), F.lit("nation"))).otherwise(F.create_map().cast("map<string,string>")))
    text = F.when(F.col("n_nationkey") % 3 > 0, F.regexp_replace(F.to_json(entity), r"\}$", F.concat(F.lit(',"observations":["of '), F.col("n_regionkey"), F.lit('"]}')))).otherwise(F.to_json(entity))
    link = F.to_json(F.struct(F.lit("relation").alias("type"), F.col("n_name").alias("from"), F.col("r_name").alias("to"), F.lit("part_of").alias("relationType")))
    es, rs = notes.memory_json(n.select(F.explode(F.array(text, link)).alias("value")))
    return es.select(F.lit("entity").alias("kind"), F.col("name").alias("a"), F.col("entity_type").alias("b"), F.array_join("observations", ",").alias("c")).union(rs.select(F.lit("relation"), "from_name", "to_name", "relation_type"))


def _shown(page: str) -> str:
    """What a page shows, in SQL, for pages without nested hidden elements."""
    out = f"regexp_replace({page}, '(?is)<!--.*?-->|<![^>]*>', '', 'g')"
    for tag in ("script", "style", "noscript", "svg", "template", "iframe", "nav", "footer", "head"):
        out = f"regexp_replace({out}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}>', '', 'g')"
    for n in range(1, 7):
        out = f"regexp_replace({out}, '(?i)<h{n}(\\s[^>]*)?>', chr(10) || '{'#' * n} ', 'g')"
    out = f"regexp_replace({out}, '(?i)</?({'|'.join(web.BLOCKS)})(\\s[^>]*|/)?>', chr(10), 'g')"
    out = f"regexp_replace({out}, '</?[A-Za-z][^>]*>', '', 'g')"
    for entity, c in (("lt", "<"), ("gt", ">"), ("quot", chr(34)), ("#39", "''"), ("nbsp", "\u00a0"), ("amp", "&")):
        out = f"regexp_replace({out}, '&{entity};?', '{c}', 'g')"
    return f"regexp_replace(regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query("html_text", f"SELECT page_id, {_shown('html')} AS text FROM pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.html_to_text("html").alias("text"))


_LINKS = r"""WITH a AS (SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) AS site,
  unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>', '', 'g'), '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS x FROM pages),
l AS (SELECT DISTINCT page_id, host, split_part(CASE WHEN x LIKE '/%' THEN site || x ELSE x END, '#', 1) AS link FROM a WHERE x <> '' AND NOT regexp_matches(x, '^(#|javascript:|mailto:)')),
h AS (SELECT *, regexp_extract(lower(link), '^[a-z]+://([^/?#:]+)', 1) AS there FROM l)
SELECT page_id, link, CASE WHEN contains(there, 'github.com') OR contains(there, 'raw.githubusercontent.com') THEN 'code_host' WHEN there = host OR there LIKE '%.' || host THEN 'internal' ELSE 'external' END AS kind FROM h"""


@query("html_links", _LINKS)
def html_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("link", F.explode(web.links("html", "url")))
    return pages.select("page_id", "link", web.link_kind(F.col("link"), F.lower(F.try_parse_url("url", F.lit("HOST")))).alias("kind"))


_KIND = f"WITH p AS (SELECT page_id, url, {_shown('html')} AS text FROM pages) SELECT page_id, k AS kind FROM p, (VALUES " + ", ".join(f"('{k}', '(?i){p}')" for k, p in web.KINDS.items()) + rf""") AS t(k, p) WHERE regexp_matches(url || chr(10) || text, p)
UNION ALL SELECT page_id, 'concepts' FROM p WHERE len(regexp_extract_all(lower(text), '{web.CONCEPTS}')) >= 2"""


@query("content_kinds", _KIND)
def content_kinds(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", web.html_to_text("html").alias("text"))
    return pages.select("page_id", F.explode(web.content_kinds(F.col("url"), F.col("text"))).alias("kind"))


_PLACES = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}/]+'), lambda x: x <> '') AS t FROM documents),
p AS (SELECT doc_id, t[i] AS term, i FROM (SELECT doc_id, t, unnest(generate_series(1, len(t))) AS i FROM w)) """


def _ranked(spark, sf_dir, text: str):
    docs = table(spark, sf_dir, "documents")
    index = ranked.index(docs, f"{shared(spark)}/ranked-{uuid.uuid4().hex}")
    return ranked.search(index, text, docs).select("doc_id", F.round("score", 6).alias("score"))


@query("search_ranked_or", _PLACES + """, h AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id, term ORDER BY i) AS k FROM p WHERE term = 'que' OR term LIKE 'unt%')
SELECT doc_id, round(sum(1.0 / (k * k)) * 0.1 / 1.64493406685 / 2, 6) AS score FROM h GROUP BY doc_id""")
def search_ranked_or(spark, sf_dir):
    """A word or a prefix, ranked by occurrences."""
    return _ranked(spark, sf_dir, ranked.prepare("que OR unt*"))


_NEAR = """, n AS (SELECT a.doc_id, sum(ln(1 - 0.1 * sqrt(1 / (1.005 + 0.05 * exp(abs(a.i - b.i) / 1.5 - 2))))) AS s FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.term = '{a}' AND b.term = '{b}' AND abs(a.i - b.i) BETWEEN 1 AND 100 GROUP BY a.doc_id)
SELECT doc_id, round(coalesce(1 - exp(s), 1e-16), 6) AS score FROM ({found}) LEFT JOIN n USING (doc_id)"""


@query("search_ranked_and", _PLACES + _NEAR.format(a="with", b="the", found="SELECT doc_id FROM p WHERE term = 'with' INTERSECT SELECT doc_id FROM p WHERE term = 'the' EXCEPT SELECT doc_id FROM p WHERE term = 'que'"))
def search_ranked_and(spark, sf_dir):
    """Two words and not a third, ranked by nearness."""
    return _ranked(spark, sf_dir, ranked.prepare("with AND the AND NOT que"))


@query("search_ranked_phrase", _PLACES + _NEAR.format(a="of", b="the", found="SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.term = 'of' AND b.term = 'the' AND b.i = a.i + 2"))
def search_ranked_phrase(spark, sf_dir):
    """A phrase with one word between two, ranked by nearness."""
    return _ranked(spark, sf_dir, "of <2> the")
