"""Vector scans against brute force."""

import math

import numpy as np

from basalt.operators import explain, vectors


def brute(rows, asked, k):
    out = []
    for q, v in asked:
        d = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(v, w, strict=True))), i) for i, w in rows if i != q)
        out += [(q, n + 1, i, x) for n, (x, i) in enumerate(d[:k])]
    return sorted(out)


def test_blocks_give_what_all_pairs_give(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "VECTORS", 37)
    monkeypatch.setattr(vectors, "QUERIES", 5)
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 6)]) for i in range(300)] + [(900 + i, [1e6 + i % 2] * 6) for i in range(9)]
    df = spark.createDataFrame([*rows, (1000, None)], "vec_id long, embedding array<float>")
    asked = [x for x in rows if x[0] % 20 == 0]
    q = df.where("vec_id % 20 = 0")
    want = brute(rows, asked, 7)
    assert sorted(tuple(x) for x in vectors.exact(df, q, 7).collect()) == want
    vectors.build(df, str(tmp_path / "v"), 4)
    assert sorted(tuple(x) for x in vectors.search(spark, str(tmp_path / "v"), q, 7, probes=4).collect()) == want
    assert {x.rank for x in vectors.exact(df.where("vec_id < 3"), df.where("vec_id = 0"), 7).collect()} == {1, 2}


def test_exact_scan_makes_no_row_for_each_pair(spark):
    df = spark.range(3000).selectExpr("id AS vec_id", "array(cast(id AS float), 1f) AS embedding")
    found = vectors.exact(df, df.where("vec_id % 20 = 0"), 3)
    assert max(x.actual_rows or 0 for x in explain.explain(found, True).collect()) < 100_000
