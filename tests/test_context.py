"""Pages, timeframes and searches on small literal inputs."""

import datetime

import pytest

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basalt.operators import context, explain, notes
from basalt.sources import web

NOW = datetime.datetime(2024, 5, 31, 12)


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""), ("a < b &amp; c", "a < b & c"), ("<p>one<p>two</p>", "one\ntwo"), ("<h2 title='a>b'>T</h2>x", "## T\nx"),
        ("<nav>x<svg>y</svg>z</nav>seen</nav>still", "seenstill"), ("<head><title>t</title></head><div>d</div>", "d"),
        ("<script>if (a < b) { '</p>' }</script>s<style>p>a{}</style>", "s"), ("<!-- <p>no</p> -->a<!doctype html>b<!-- open", "ab"),
        ("<div><div><div>a</div></div></div><div>b</div>", "a\n\nb"), ("<LI>A<BR/>B", "A\nB"), ("<p>unfinished <a href=", "unfinished <a href="),
    ],
)
def test_page_text(page, want):
    assert web._text(page) == want


def test_heads_of_notes():
    head = """title: "A: b"  # no
tags:
- x
- 'y z'
nested:
  deep:
    k: v
  list:
    - one
    - name: n
      size: 3
      more: [a, "b, c"]
text: |
  first
    second

  # third
folded: >-
  joins
  lines
empty:
url: http://a.b/c#d
# comment: no
last: [ ]"""
    got, body = notes._front(f"---\n{head}\n---\nbody\n---\n")
    assert body == "body\n---\n" and got == {
        "title": "A: b", "tags": ["x", "y z"], "nested": {"deep": {"k": "v"}, "list": ["one", {"name": "n", "size": "3", "more": ["a", "b, c"]}]},
        "text": "first\n  second\n\n# third", "folded": "joins lines", "empty": "", "url": "http://a.b/c#d", "last": [],
    }
    assert notes._front("no head") == ({}, "no head") and notes._front(None) == ({}, "") and notes._front("---\nonly text\n---\n") == ({}, "")


def test_links(spark):
    page = """<a href="/x#y">1</a><A class=b HREF='z?q=1&amp;r=2'>2</A><a href="#top">3</a><a href="mailto:a@b">4</a><!-- <a href="/no"> --><a href=/x>5</a><a>6</a><a href="https://github.com/o">7</a>"""
    df = spark.createDataFrame([(page, "http://a.org/d/e")], "html string, url string")
    assert df.select(web.links("html", "url").alias("l")).first().l == ["http://a.org/x", "http://a.org/d/z?q=1&r=2", "https://github.com/o"]


def test_timeframes():
    day = datetime.timedelta(days=1)
    for text, days in (("today", 1), ("1h", 1), ("yesterday", 1), ("7d", 7), ("2 weeks ago", 14), ("last month", 30), ("3 days ago", 3)):
        assert context.since(text, NOW) == NOW - days * day
    assert context.since("2024-05-01", NOW) == datetime.datetime(2024, 5, 1)
    for wrong in ("soon", "5 moons", "3y", "2025-01-01"):
        with pytest.raises(ValueError):
            context.since(wrong, NOW)


def test_upsert_keeps_identifiers_unique(spark):
    es = spark.createDataFrame([(5, "A", "note", "a", "a.md", "x")], "id long, title string, entity_type string, permalink string, file_path string, checksum string")
    new = spark.createDataFrame([(f"f/{i}.md", "---\npermalink: p\n---\n") for i in range(40)] + [("a.md", "new")], "file_path string, text string")
    got = context.upsert(es, new).collect()
    assert sorted(r.id for r in got) == list(range(5, 46)) and len({r.permalink for r in got}) == 41
    assert [r.change for r in got if r.id == 5] == ["updated"] and context.upsert(es, new.limit(0)).first().change == "same"


def _most_rows(df):
    return max(r.actual_rows or 0 for r in explain.explain(df, True).collect())


def test_links_by_nearness_as_by_all_pairs(spark):
    paths = ["a.md", "x/a.md", "x/y/a.md", "x/y/z/a.md", "x/b.md", "/x/a.md", "x//a.md", "xy/a.md", "w/x/y/a.md", "x/y/b.md"]
    es = spark.createDataFrame([(i, ("t", "u", "x/b")[i % 3], p.removesuffix(".md") if i % 4 == 0 else f"p{i % 5}", p) for i, p in enumerate(paths * 3)], "entity_id long, title string, permalink string, file_path string")
    names = ["t", "u", "x/b", "x/b.md", "x/y/a", "p1", "none", None, "x//a"]
    ls = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate((n, s) for n in names for s in ["f.md", "x/f.md", "x/y/f.md", "x/y/z/f.md", "v/f.md", "/x/f.md", "x//f.md", None])], "link_id long, name string, source string")
    way = F.when(F.col("name") == F.col("permalink"), 0).when(F.col("name") == F.col("title"), 1).when(F.col("name") == F.col("file_path"), 2).when(F.concat("name", F.lit(".md")) == F.col("file_path"), 3)
    order = W.partitionBy("link_id").orderBy("_w", notes.proximity(F.col("source"), F.col("file_path")), F.length("file_path"), "entity_id")
    want = ls.crossJoin(es).withColumn("_w", way).where("_w IS NOT NULL").withColumn("_r", F.row_number().over(order)).where("_r = 1")
    want = {r.link_id: r.entity_id for r in want.collect()}
    assert want and {r.link_id: r.entity_id for r in notes.resolve_links(ls, es).collect()} == {i: want.get(i) for i in range(len(names) * 8)}


def test_links_to_a_common_title_make_no_pairs(spark):
    es = spark.range(600).selectExpr("id AS entity_id", "'t' AS title", "concat('p', id) AS permalink", "concat('f', id % 3, '/', id, '.md') AS file_path")
    found = notes.resolve_links(spark.range(600).selectExpr("id AS link_id", "'t' AS name", "concat('f', id % 4, '/x.md') AS source"), es)
    assert _most_rows(found) < 10_000
    assert {r.link_id: r.entity_id for r in found.collect()} == {i: i % 4 if i % 4 < 3 else 0 for i in range(600)}


def test_search_for_links_combines_entities_of_the_same_words(spark):
    es = spark.range(600).selectExpr("id AS entity_id", "concat('red ', if(id % 2 = 0, 'green', 'blue')) AS title", "concat('p', id) AS permalink")
    ls = spark.createDataFrame([(i, n, "s", None) for i, n in enumerate(["blue red", "red", "RED/red", "green p4", "green p5", "red*", "", "none red"] + ["Red green"] * 300)], "link_id long, name string, source string, entity_id long")
    found = context.fuzzy_links(ls, es)
    assert _most_rows(found) < 10_000
    got = {r.link_id: r.entity_id for r in found.collect()}
    assert [got[i] for i in range(8)] == [1, 0, 0, 4, None, None, None, None] and {got[i] for i in range(8, 308)} == {0}
