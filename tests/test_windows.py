"""Window functions of one's own, over batches that cut partitions."""

import pytest

from basalt.functions.windows import window_function


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_partitions_across_batches(spark, size):
    rows = [(p, i, float(i % 4)) for p in ("a", "b", None, "c") for i in range({"a": 7, "b": 1, "c": 5}.get(p, 4))] + [("a", None, 9.0)]
    df = spark.createDataFrame(rows, "p string, k long, v double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        found = window_function(df, lambda s: s.cumsum(), "v", "c", "double", ["p"], ["-k"])
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, found.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    down = lambda r: (r[1] is not None, -(r[1] or 0))
    want = [(p, k, v, sum(r[2] for r in rows if r[0] == p and down(r) <= down((p, k)))) for p, k, v in rows]
    assert got == sorted(want, key=str)
