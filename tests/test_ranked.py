"""Ranked search over postings."""

import math

from pyspark.sql import functions as F

from basalt.operators import explain, ranked, search


def test_prefixes_between_operators(spark, tmp_path):
    assert ranked.prepare("que OR unt*") == "que | unt:*" and ranked.prepare("a* AND NOT b:*") == "a:* & !b:*"
    docs = spark.createDataFrame([(1, "que Unter unter"), (2, "Untat"), (3, "aunt que que"), (4, None)], "doc_id long, text string")
    index = ranked.index(docs, str(tmp_path / "i"))
    got = {r.doc_id: r.score for r in ranked.search(index, ranked.prepare("que OR unt*"), docs).collect()}
    one = 0.1 / 1.64493406685 / 2
    assert {k: round(v / one, 9) for k, v in got.items()} == {1: 2.25, 2: 1.0, 3: 1.25}


def test_words_are_grouped_where_they_are_read(spark):
    docs = spark.createDataFrame([(i, " ".join(["a", "b/c", "Ünd", "a"] * 50)) for i in range(40)] + [(90, ""), (91, " -- "), (92, None), (93, "-a é́b a-")], "doc_id long, text string")
    found = search.occurrences(docs, "doc_id", "text")
    got = {(r.doc_id, r.term): (list(r.positions), r.n) for r in found.collect()}
    want = {}
    for r in docs.select("doc_id", search.words(F.coalesce("text", F.lit(""))).alias("w")).collect():
        for p, w in enumerate(r.w, 1):
            want.setdefault((r.doc_id, w), ([], len(r.w)))[0].append(p)
    assert got == want
    assert max(r.actual_rows or 0 for r in explain.explain(search.postings(docs), True).collect()) < 1000


def test_nearness_as_by_all_pairs(spark, tmp_path):
    text = " ".join(("with" if i % 7 == 0 else "the" if i % 5 == 0 else "x") for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, "with " + "x " * 200 + "the"), (3, "the"), (4, "with the")], "doc_id long, text string")
    found = ranked.search(ranked.index(docs, str(tmp_path / "i")), "with & the", docs)
    words = text.split()
    a, b = ([i for i, w in enumerate(words) if w == t] for t in ("with", "the"))
    total = sum(math.log(1 - math.sqrt(0.01 / (1.005 + 0.05 * math.exp(abs(x - y) / 1.5 - 2)))) for x in a for y in b if 1 <= abs(x - y) <= 100)
    got = {r.doc_id: r.score for r in found.collect()}
    assert sorted(got) == [1, 2, 4] and math.isclose(got[1], 1 - math.exp(total), rel_tol=1e-9) and math.isclose(got[2], 1e-16) and 0.05 < got[4] < 0.2
