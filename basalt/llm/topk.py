"""Exact top-k search by columnar branch-and-bound."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import lean, stage

#: Bytes of a block of queries, vectors of a block of candidates; queries that are searched at once; dimensions of a step.
QUERY_BYTES, CANDIDATES, AT_ONCE, STEP = 8 << 20, 4096, 256, 16
#: Sums of products below this are exact in floating point, in any order.
EXACT = 2.0**53
LONG = (-(2**63), 2**63 - 1)


def blocks(vectors: DataFrame, size: int | None = None, most: int | None = None) -> DataFrame:
    """Rows (_dim, n, ids, data): blocks of `size` vectors, or about `most` bytes, of a dimension in vertical layout
    (dimension after dimension, float64). Blocks are cut from each task's rows, so that none depends on a group."""

    def run(batches):
        import pyarrow as pa

        held: dict[int, list] = {}

        def flush(dim):
            part = held.pop(dim)
            ids = np.array([i for i, _ in part], np.int64)
            data = np.array([v for _, v in part], np.float64).T.copy() if dim else np.zeros((0, len(part)))
            return pa.RecordBatch.from_pydict({"_dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= (size or max(1, most // (8 * max(1, len(v))))):
                    yield flush(len(v))
        for dim in list(held):
            yield flush(dim)

    return vectors.mapInArrow(lean(run), "_dim int, n int, ids binary, data binary")


def edge(low: float) -> float:
    """A bound below which nothing can be among the best, as scores beyond a long tie at its ends."""
    return -np.inf if low <= LONG[0] else min(low, 2.0**63 * (1 - 1e-9))


def search_block(qd: np.ndarray, cd: np.ndarray, qid: np.ndarray, cid: np.ndarray, k: int, step: int = STEP):
    """k best of the candidates for each query by inner product, ties to the smaller id; both dimension x vectors of
    integers (float64). Products beyond the range of a long count as its ends.

    Scores are summed `step` dimensions at a time. What the dimensions to come can add is at most the product of
    the norms of the two remainders; a candidate below the k-th best lower bound is dropped and the survivors
    are compacted. Dimensions go in the order of the queries' mass, the largest first. Where a sum can leave what
    floating point holds exactly, the bounds also allow for its error, and the survivors are multiplied as
    integers of any length.
    """
    dims, nq = qd.shape[0], qd.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        order = np.argsort(-(qd**2).sum(1), kind="stable")
        q, c = qd[order], cd[order]
        cuts = list(range(0, dims, step)) + [dims]
        rest = lambda x: np.sqrt(np.concatenate([np.cumsum((x**2)[::-1], 0)[::-1], np.zeros((1, x.shape[1]))])[cuts[1:]])
        qn, cn = np.sqrt((q**2).sum(0)), np.sqrt((c**2).sum(0))
        top = (qn.max() if nq else 0.0) * (cn.max() if c.shape[1] else 0.0)
        exact = top < EXACT / 2
        wild = not exact and not top < 1e300  # even the bounds would overflow: nothing is dropped
        qr, cr = rest(q), rest(c)
        slack = 0.0 if exact else 4e-16 * (dims + 4)
        # The first block of dimensions is one product for all queries; the bounds then leave few candidates.
        first = q[: cuts[1]].T @ c[: cuts[1]] if dims else np.zeros((nq, c.shape[1]))
        out_q, out_c, out_s = [], [], []
        for i in range(nq):
            live = np.flatnonzero(cid != qid[i])
            s = first[i][live]
            for b in range(1, len(cuts) - 1) if not wild else ():
                if len(live) > k:
                    bound = qr[b - 1][i] * cr[b - 1][live] * (1 + 1e-12) + slack * qn[i] * cn[live]
                    low = edge(np.partition(s - bound, len(s) - k)[len(s) - k])
                    keep = s + bound >= low - 1e-6 * (1 + abs(low))
                    live, s = live[keep], s[keep]
                s = s + q[cuts[b] : cuts[b + 1], i] @ c[cuts[b] : cuts[b + 1]][:, live]
            if exact:
                score = np.rint(s).astype(np.int64)
            else:
                if len(live) > k and not wild:
                    err = slack * qn[i] * cn[live]
                    low = edge(np.partition(s - err, len(s) - k)[len(s) - k])
                    live = live[s + err >= low]
                mine = [int(x) for x in qd[:, i]]
                score = np.array([min(max(sum(a * int(x) for a, x in zip(mine, cd[:, j], strict=True)), LONG[0]), LONG[1]) for j in live], np.int64)
            best = np.lexsort((cid[live], ~score))[:k]  # ~: the order of -score, for the least long too
            out_q.append(np.full(len(best), qid[i]))
            out_c.append(cid[live[best]])
            out_s.append(score[best])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_c, out_s))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, query_bytes: int = QUERY_BYTES, candidate_block: int = CANDIDATES) -> DataFrame:
    """Exact k highest inner products of vectors of integers: query_id, rank, vec_id, score.

    queries, candidates: (vec_id long, v array<double> of integers), no nulls in them. All queries meet all
    candidates, in blocks: a cell of the grid is a block of queries and a group of blocks of candidates. Blocks are
    written before the grid is made, so that a repeated task sees the same ones. Candidates are repeated once per
    block of queries (of query_bytes), queries once per group; no side is broadcast without bound. Each pair of
    blocks returns k rows per query, which a window with a partial limit merges. A vector is never its own
    candidate (same vec_id), and rows repeated with the same id and vector count once. Vectors of another dimension
    than the query's aren't compared. Scores beyond the range of a long are its ends (and then ties, to the smaller
    id). Fewer candidates than k: all. Empty tables: no rows.
    """
    spark = queries.sparkSession
    qs = blocks(queries.dropDuplicates(), most=query_bytes).withColumn("_b", F.sha2(F.concat("ids", "data"), 256))
    qs = stage(qs.select("_dim", "_b", F.col("ids").alias("qids"), F.col("data").alias("qdata")), "topk-queries")
    cs = stage(blocks(candidates.dropDuplicates(), candidate_block).withColumn("_c", F.xxhash64("ids", "data")), "topk-candidates")
    groups = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), cs.count()))
    # Both sides are repeated along the other's axis and meet by an equality, spread over all tasks. Slots and groups
    # are numbered without the data. The hint: Spark estimates the repeated queries by their compressed files and would
    # broadcast them through the driver.
    slots = qs.select("_dim", "_b").distinct().withColumn("_slot", F.row_number().over(W.partitionBy("_dim").orderBy("_b")) - 1)
    counts = slots.groupBy("_dim").agg(F.max("_slot").alias("_last"))
    grid = cs.withColumn("_g", F.pmod("_c", F.lit(groups)).cast("int")).join(F.broadcast(counts), "_dim").withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_last")))).drop("_last")
    asked = qs.dropDuplicates(["_dim", "_b"]).join(slots, ["_dim", "_b"]).withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = grid.join(asked.hint("merge"), ["_dim", "_slot", "_g"]).select("_dim", "qids", "qdata", "ids", "data")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                dim, qi, qd, ci, cd = (batch.column(j)[r].as_py() for j in range(5))
                qid, cid = np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64)
                q, c = np.frombuffer(qd, np.float64).reshape(dim, len(qid)), np.frombuffer(cd, np.float64).reshape(dim, len(cid))
                for i in range(0, len(qid), AT_ONCE):
                    a, b, s = search_block(q[:, i : i + AT_ONCE], c, qid[i : i + AT_ONCE], cid, k)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(lean(run), "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, v): floor(scale * component), as double, of the vectors without null or non-finite components; null ids go too.

    From 2^53 on a double is an integer already. A double that the scale takes out of its range counts as not finite.
    """
    v = F.col(vector_col)
    fit = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * F.lit(scale)) != F.lit(float("inf")))
    floor = lambda x: F.when(F.abs(x) < F.lit(EXACT), F.floor(x).cast("double")).otherwise(x)
    kept = vectors.where(v.isNotNull() & F.col(id_col).isNotNull()).where(F.forall(v, fit))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: floor(x.cast("double") * F.lit(scale))).alias("v"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(every.where(F.pmod("vec_id", F.lit(20)) == 0), every).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP8_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
