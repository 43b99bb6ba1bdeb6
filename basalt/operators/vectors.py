"""Approximate vector scan: an inverted file of vectors by their nearest centroid, stored as Parquet."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Training vectors for each list, expected; rounds of training.
EACH, ROUNDS = 64, 8
#: Vectors and queries of a block, queries multiplied at once.
VECTORS, QUERIES, AT_ONCE = 8192, 2048, 128


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centres of each row, nearest first."""
    d = (centres**2).sum(1)[None] - 2 * x @ centres.T
    some = np.argpartition(d, min(n, d.shape[1]) - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)


def train(vectors: DataFrame, lists: int, id_col: str, vector_col: str, each: int = EACH, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of `lists` lists, learned from a sample of about each * lists vectors, picked by a hash of the id: its size
    doesn't grow with the table."""
    n = vectors.count()
    keep = F.pmod(F.xxhash64(F.lit(29), id_col), F.lit(1 << 20)) < F.lit(int(min(1.0, each * lists / max(n, 1)) * (1 << 20)) + 1)
    x = np.array([r[0] for r in vectors.where(keep).select(F.col(vector_col).cast("array<double>")).limit(4 * each * lists).collect()], float)
    if not len(x):
        return np.zeros((0, 0))
    centres = x[np.random.default_rng(7).permutation(len(x))[: min(lists, len(x))]].copy()
    for _ in range(rounds):
        at = nearest(x, centres, 1)[:, 0]
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        size = np.bincount(at, minlength=len(centres))
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def lists_of(vector: Column, centres: np.ndarray, n: int) -> Column:
    """The numbers of the n lists nearest to a vector. The centres, whose number is a parameter, go with the function."""

    @F.pandas_udf("array<int>")
    def of(v):
        import pandas as pd

        return pd.Series(list(nearest(np.stack(v.to_numpy()).astype(float), centres, n).astype(np.int32))) if len(v) else pd.Series([], dtype=object)

    return of(vector.cast("array<double>"))


def build(vectors: DataFrame, path: str, lists: int, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """Write the index: path/centres (list, centre, n) and path/lists (id, vector), a folder for each list. All vectors are
    indexed but nulls; a list of many is written by several tasks."""
    spark = vectors.sparkSession
    given = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col), F.col(vector_col).cast("array<double>").alias(vector_col))
    centres = train(given, lists, id_col, vector_col)
    if not len(centres):
        given.withColumn("_list", F.lit(0)).limit(0).write.mode("overwrite").parquet(f"{path}/lists")
        spark.createDataFrame([], "_list int, centre array<double>, n long").write.mode("overwrite").parquet(f"{path}/centres")
        return
    listed = given.withColumn("_list", lists_of(F.col(vector_col), centres, 1)[0])
    listed.repartition("_list", F.pmod(F.xxhash64(id_col), F.lit(4))).write.mode("overwrite").partitionBy("_list").parquet(f"{path}/lists")
    sizes = spark.read.parquet(f"{path}/lists").groupBy("_list").agg(F.count("*").alias("n"))
    named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "_list int, centre array<double>")
    named.join(sizes, "_list", "left").fillna(0, "n").write.mode("overwrite").parquet(f"{path}/centres")


def probed(spark: SparkSession, path: str, queries: DataFrame, probes: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, query, _list, n (vectors in it): the lists that each query reads."""
    named = spark.read.parquet(f"{path}/centres").orderBy("_list").collect()  # as many as the lists, a parameter
    centres = np.array([r["centre"] for r in named], float).reshape(len(named), -1)
    if not len(centres):
        return queries.where("false").select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("query"), F.lit(0).alias("_list"), F.lit(0).cast("long").alias("n"))
    asked = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("query"))
    asked = asked.select("*", F.explode(lists_of(F.col("query"), centres, min(probes, len(centres)))).alias("_list"))
    return asked.join(F.broadcast(spark.read.parquet(f"{path}/centres").select("_list", "n")), "_list")


def blocks(vectors: DataFrame, most: int) -> DataFrame:
    """Rows (_list, _dim, ids, data): up to `most` vectors of a list and dimension, from a task's rows (_list, id, vector)."""

    def run(batches):
        import pyarrow as pa

        held: dict[tuple, list] = {}

        def flush(key):
            part = held.pop(key)
            ids, data = np.array([i for i, _ in part], np.int64), np.array([v for _, v in part], np.float64)
            return pa.RecordBatch.from_pydict({"_list": pa.array([key[0]], pa.int32()), "_dim": pa.array([key[1]], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})

        for batch in batches:
            for at, i, v in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                key = (at, len(v))
                held.setdefault(key, []).append((i, v))
                if len(held[key]) >= most:
                    yield flush(key)
        for key in list(held):
            yield flush(key)

    return vectors.mapInArrow(run, "_list int, _dim int, ids binary, data binary")


def closest(q: np.ndarray, c: np.ndarray, qid: np.ndarray, cid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, distance) of the k nearest rows of c to each row of q, ties to the smaller id. Products of matrices
    choose, with room for their error; what they choose is measured component by component, in order."""
    with np.errstate(over="ignore", invalid="ignore"):
        qn, cn = (q**2).sum(1), (c**2).sum(1)
        near = cn[None] - 2 * (q @ c.T)
        other = qid[:, None] != cid[None]
        if len(cid) > k + 1 and np.isfinite(qn).all() and np.isfinite(near).all():
            near[~other] = np.inf
            limit = np.partition(near, k - 1, axis=1)[:, k - 1] + 1e-10 * (qn + cn.max())
            other &= near <= limit[:, None]
        i, j = np.nonzero(other)
        d = np.zeros(len(i))
        for x in range(q.shape[1]):
            d += (c[j, x] - q[i, x]) ** 2
        d = np.sqrt(d)
    order = np.lexsort((cid[j], d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return qid[i[first]], cid[j[first]], d[first]


def _meet(vectors: DataFrame, queries: DataFrame, k: int, deal: int) -> DataFrame:
    """query_id, rank, id, distance: for each query (_list, id, vector) the k nearest vectors (_list, id, vector) of its lists.

    Blocks of vectors meet blocks of queries by their list; each list's vectors are dealt to `deal` groups, for which the
    queries are repeated. A pair of blocks gives k rows a query; nothing is broadcast.
    """
    given = lambda df: df.where("id IS NOT NULL AND vector IS NOT NULL")
    cs = blocks(given(vectors), VECTORS).withColumn("_g", F.pmod(F.xxhash64("ids"), F.lit(deal)).cast("int"))
    qs = blocks(given(queries), QUERIES).withColumnsRenamed({"ids": "qids", "data": "qdata"}).withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    pairs = cs.join(qs.hint("merge"), ["_list", "_dim", "_g"]).select("_dim", "qids", "qdata", "ids", "data")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                dim, qi, qd, ci, cd = (batch.column(x)[r].as_py() for x in range(5))
                qid, cid = np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64)
                q, c = np.frombuffer(qd, np.float64).reshape(len(qid), dim), np.frombuffer(cd, np.float64).reshape(len(cid), dim)
                for i in range(0, len(qid), AT_ONCE):
                    found = closest(q[i : i + AT_ONCE], c, qid[i : i + AT_ONCE], cid, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "id", "distance"])

    scored = pairs.mapInArrow(run, "query_id long, id long, distance double")
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, distance (L2): the k nearest of the vectors in each query's `probes` nearest lists, ties to the
    smaller id; a vector isn't its own neighbour. Ids are longs. The scan opens the folders of the asked lists alone."""
    asked = probed(spark, path, queries, probes, id_col, vector_col).select("_list", F.col("query_id").cast("long").alias("id"), F.col("query").alias("vector"))
    lists = [r[0] for r in asked.select("_list").distinct().collect()]  # as many as the lists, a parameter
    every = spark.read.parquet(f"{path}/lists").where(F.col("_list").isin(lists)).select("_list", F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    return _meet(every, asked, k, 4)


def exact(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The same from all vectors, to measure recall with: every query meets every vector, in blocks."""
    of = lambda df: df.select(F.lit(0).alias("_list"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return _meet(of(vectors), of(queries), k, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
