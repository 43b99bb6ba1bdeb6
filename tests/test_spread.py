"""Windows over few large partitions, spread over tasks."""

import os
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basalt.operators import spread
from basalt.operators.ordering import order
from basalt.plans.catalogue import QUERIES

SF = os.environ.get("BASALT_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture
def rows(spark):
    r = random.Random(3)
    data = [(i, r.choice(["a", "b", None]), r.choice([1.0, 2.0, None, 5.0]), r.choice([None, *range(40)])) for i in range(500)] + [(500, "alone", None, None)]
    return spark.createDataFrame(data, "id long, p string, x double, k int").repartition(5)


@pytest.mark.parametrize("few", [100_000, 3])
def test_places_and_ranks(spark, rows, few, monkeypatch):
    monkeypatch.setattr(spread, "FEW", few)
    for part in (["p"], []):
        n = W.partitionBy(*part).orderBy(order("x", False), order("id"))
        k = W.partitionBy(*part).orderBy(order("k"), order("x", False))
        want = rows.select("id", F.row_number().over(n), F.count("*").over(W.partitionBy(*part)), F.ntile(7).over(n), F.lag("x").over(n), F.rank().over(k), F.dense_rank().over(k))
        got = spread.numbered(rows, part, [order("x", False), order("id")])
        got = got.withColumn("tile", spread.tile(F.col("_n"), F.col("_size"), 7)).withColumnRenamed("_size", "size")
        lag = spread.lagged(got, "_n", "x", "lag") if not part else got.withColumn("lag", F.lag("x").over(n))
        got = spread.ranked(lag, part, {"k": False, "x": True}).select("id", "_n", "size", "tile", "lag", "_rank", "_dense")
        assert sorted(map(tuple, got.collect()), key=lambda t: t[0]) == sorted(map(tuple, want.collect()), key=lambda t: t[0])


def test_empty_and_unordered(rows):
    assert sorted(x["_n"] for x in spread.numbered(rows, [], []).collect()) == list(range(1, 502))
    assert {(x["_rank"], x["_dense"]) for x in spread.ranked(rows, ["p"], {}).collect()} == {(1, 1)}
    none = rows.where("false")
    assert spread.numbered(none, ["p"], [order("id")]).count() == spread.ranked(none, ["p"], {"k": False}).count() == spread.numbered(none, [], []).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["windows_without_order", "nulls_order", "window_ranks"])
def test_no_task_numbers_all_rows(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and "lag(" not in plan and "ntile" not in plan and "rank(" not in plan
