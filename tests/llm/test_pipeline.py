"""The stages of the pipeline: what each keeps, judged on its own input."""

import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from basalt.llm import neardup

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs.collect()]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == columns + ["copy"] * (i == 4)
        tables.append(docs.collect())
    raw, good, lined, single, clean, mixed = tables
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    kept = {r.doc_id for r in good}
    assert sum(labels[i] == 1 and i not in kept for i in labels) <= 0.03 * len(labels)
    assert sum(labels[i] == 0 and i in kept for i in labels) <= 0.03 * len(labels)
    assert {r.doc_id: r.text for r in raw}.items() >= {r.doc_id: r.text for r in good}.items()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    assert max(Counter(tuple(words(x)) for r in lined for x in r.text.split("\n") if words(x)).values()) == 1
    assert all(r.n_chars == len(r.text) for r in lined)
    sets = [frozenset(tuple(words(r.text)[i : i + 5]) for i in range(len(words(r.text)) - 4)) for r in single]
    assert all(len(a & b) < 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b)
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [term(r.text)] for i in range(len(w) - 9)}
    dirty = {r.doc_id for r in single for w in [term(r.text)] if any(tuple(w[i : i + 10]) in grams for i in range(len(w) - 9))}
    assert {r.doc_id for r in clean} == {r.doc_id for r in single} - dirty
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean}
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3


def test_run_and_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    shared = corpus_pipeline._common.scratch_dir(spark).removeprefix("file:")
    left = [x for x in os.listdir(shared) if x.startswith("pipeline-")]
    assert len(left) == 1 and "mixing" in left[0]  # the result; what the stages had staged is gone
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.count() == 0


def test_awkward_rows(spark, tmp_path):
    rows = [(1, "", "en", None, 0, "x", 1), (None, None, None, "a", None, "x", 1), (2, "some words stand here", "en", "a", 4, "x", 1), (2, "some words stand here", "en", "a", 4, "x", 1), (3, "w " * 30000, "en", "b", 9, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _score string, _rest int")
    columns = docs.columns
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns[: len(columns)] == columns
    assert neardup.one_of_each(spark.createDataFrame(rows[2:4], "doc_id long, text string, lang string, source string, n_chars long, _score string, _rest int")).count() == 1


def test_copy_gets_a_free_name(spark):
    docs = spark.createDataFrame([(i, f"text number {i}", "a", 1, 2) for i in range(6)], "doc_id long, text string, source string, Copy int, copy_ int")
    out = corpus_pipeline.mix_sources(spark, docs, SF)
    assert out.columns == [*docs.columns, "copy__"] and out.count() > 0
