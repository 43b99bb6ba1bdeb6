"""Centroid clustering by annulus search over centroids in the order of their norms."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lean, stage

LONG = 2**63 - 1
#: Components up to this have squared distances of 2^62 at most for 64 dimensions; larger ones are computed without bound.
SAFE = 1 << 26
#: Centroids nearest in norm that give a vector's first upper bound; pairs of vector and centroid that are compared at once.
SEEDS, PAIRS = 2, 1 << 16
LIMB = 40


def components(column, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, floor(scale * x) of their components, float64) of the lists of exactly dims components, none null or not
    finite, before or after scaling."""
    off = np.asarray(column.offsets, np.int64)
    values = column.values
    raw = values.cast("double").to_numpy(zero_copy_only=False) if len(values) else np.zeros(0)
    fits = (np.diff(off) == dims) & column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(fits)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(raw[off[rows][:, None] + np.arange(dims)] * scale)  # a null is not a number
    fine = np.isfinite(x).all(1)
    return rows[fine], x[fine]


def integers(x: np.ndarray) -> np.ndarray:
    """Rows of whole numbers as int64 if they are small, else as integers of any length."""
    return x.astype(np.int64) if not x.size or np.abs(x).max() <= SAFE else np.array([[int(v) for v in row] for row in x], object)


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths in floating point; a scale keeps squares within its range."""
    y = x.astype(np.float64)
    top = np.maximum(np.abs(y).max(1, initial=0), 1.0)
    return top * np.sqrt(((y / top[:, None]) ** 2).sum(1))


class Centroids:
    """Centroids in the order of their norms, and the search among them."""

    def __init__(self, rows: list[list[int]], seeds: int = SEEDS):
        self.exact = np.array(rows, object).reshape(len(rows), -1)
        self.small = all(abs(v) <= SAFE for row in rows for v in row)
        self.rows = self.exact.astype(np.int64) if self.small else self.exact
        length = norms(self.exact)
        self.order = np.argsort(length, kind="stable")
        self.length, self.seeds, self.compared = length[self.order], max(1, min(seeds, len(rows))), 0

    def squared(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        d = (x if x.dtype == self.rows.dtype else x.astype(object)) - (self.rows if x.dtype == self.rows.dtype else self.exact)[at]
        self.compared += len(at)
        return (d * d).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row of integers, ties to the smaller number.

        No centroid is nearer than its norm differs from the vector's. The centroids nearest in norm give an upper
        bound; those whose norm lies in the annulus that it leaves, its edges and the error of floating point
        included, are found by binary search and compared exactly.
        """
        n, k = len(x), len(self.order)
        kind = np.int64 if x.dtype != object and self.small else object
        best, low = np.zeros(n, np.int64), np.zeros(n, kind)
        size = norms(x)
        first = np.clip(np.searchsorted(self.length, size) - (self.seeds + 1) // 2, 0, k - self.seeds)
        bound = None
        for j in range(self.seeds):
            d = self.squared(x, self.order[first + j])
            bound = d if bound is None else np.where(d < bound, d, bound)
        slack = 1e-9 * (1 + size + (self.length[-1] if k else 0.0))
        root = np.sqrt(bound) if bound.dtype != object else np.array([float(math.isqrt(v) + 1) for v in bound])
        reach = root * (1 + 1e-9) + slack
        a, b = np.searchsorted(self.length, size - reach, "left"), np.searchsorted(self.length, size + reach, "right")
        count = np.maximum(b - a, 1)
        ends = np.cumsum(count)
        i = 0
        while i < n:  # as many vectors as make about PAIRS comparisons
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
            many = count[i:j]
            own = np.repeat(np.arange(i, j), many)
            at = self.order[np.minimum(np.repeat(a[i:j], many) + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many), k - 1)]
            d = self.squared(x[own], at)
            by = sorted(range(len(own)), key=lambda r: (own[r], d[r], at[r])) if d.dtype == object else np.lexsort((at, d, own))
            lead = np.asarray(by)[np.cumsum(many) - many]
            best[i:j], low[i:j] = at[lead], d[lead]
            i = j
        return best, low


def limbs(x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(place, digits) with x = sum of digits << LIMB * place: integers of any length as longs."""
    sign, left = np.array([-1 if v < 0 else 1 for v in x], object), np.array([abs(v) for v in x], object)
    out = []
    while any(left):
        out.append((len(out), sign * np.array([v & ((1 << LIMB) - 1) for v in left], object)))
        left = np.array([v >> LIMB for v in left], object)
    return out


def totals(vectors: DataFrame, centres: list[list[int]], dims: int, scale: float) -> tuple[list[int], list[list[int]]]:
    """(vectors, componentwise sums) of each centroid's vectors. Tasks add up their own; the driver gets a number for each
    centroid, component and place of 40 bits."""

    def run(batches):
        import pyarrow as pa

        search = Centroids(centres)
        n, s = np.zeros(len(centres), np.int64), np.zeros((len(centres), dims), object)
        for batch in batches:
            _, x = components(batch.column(1), dims, scale)
            if not len(x):
                continue
            x = integers(x)
            at, _ = search.nearest(x)
            n += np.bincount(at, minlength=len(centres))
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            s[at[order][starts]] += np.add.reduceat(x[order], starts, axis=0).astype(object)
        cells = [(c, -1, 0, int(n[c])) for c in range(len(centres)) if n[c]]
        for c in np.flatnonzero(n):
            cells += [(int(c), d, place, int(digits[d])) for place, digits in limbs(s[c]) for d in range(dims) if digits[d]]
        cols = list(zip(*cells, strict=True)) if cells else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], names=["c", "d", "place", "part"])

    parts = vectors.mapInArrow(lean(run), "c int, d int, place int, part long")
    n, s = [0] * len(centres), [[0] * dims for _ in centres]
    for c, d, place, total in parts.groupBy("c", "d", "place").agg(F.sum(F.col("part").cast("decimal(38,0)"))).collect():
        if d < 0:
            n[c] = int(total)
        else:
            s[c][d] += int(total) << LIMB * place
    return n, s


def start(vectors: DataFrame, k: int, dims: int, scale: float) -> list[list[int]]:
    """The k kept vectors with the smallest sha256 of `1:<vec_id>`, in this order; vectors of one id by their components, null ids last."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, x = components(batch.column(1), dims, scale)
            ids = batch.column(0).take(pa.array(rows)).to_pylist()
            names = [None if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest() for i in ids]
            keep = sorted(range(len(ids)), key=lambda r: (names[r] is None, names[r] or "", tuple(x[r])))[:k]
            yield pa.RecordBatch.from_arrays([pa.array([names[r] for r in keep], pa.string()), pa.array([x[r].tolist() for r in keep], pa.list_(pa.float64()))], names=["h", "x"])

    first = vectors.mapInArrow(lean(run), "h string, x array<double>").orderBy(F.col("h").asc_nulls_last(), "x").limit(k)
    return [[int(v) for v in r.x] for r in first.collect()]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly dims components, none null or not finite (a component that the scale takes out of the range
    of a double counts as not finite), as integers floor(scale * x). Lloyd's rounds are exact: squared distances
    of integers, ties to the smaller number, new centroids floor(sum / count), empty ones stay. A round reads the
    vectors once and sends k * dims sums of each task through a combining shuffle; k centroids, a parameter, are all
    that the driver and the tasks hold. Distances and inertias beyond a long are its end.

    Fewer vectors than k: as many centroids. Rows that repeat an id and vector count each, as starting points too. Null
    ids are clustered and are starting points last. Other columns are ignored. No vector kept: no rows.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    centres = start(base, k, dims, scale)
    if not centres:
        return base.where("false").select("vec_id", *[F.lit(0).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"))], F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        n, s = totals(base, centres, dims, scale)
        centres = [[v // n[c] for v in s[c]] if n[c] else centres[c] for c in range(len(centres))]

    def run(batches):
        import pyarrow as pa

        search = Centroids(centres)
        for batch in batches:
            rows, x = components(batch.column(1), dims, scale)
            if len(x):
                at, d = search.nearest(integers(x))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(at.astype(np.int32)), pa.array([min(int(v), LONG) for v in d], pa.int64())], names=["vec_id", "cluster", "distance"])

    given = stage(base.mapInArrow(lean(run), f"vec_id {kind}, cluster int, distance long"), "centroids-given")
    sums = {r["cluster"]: int(r["s"]) for r in given.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    names = {c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest() for c in sums}
    told = [(c, min(s, LONG), min(sum(sums.values()), LONG), names[c]) for c, s in sums.items()]
    told = given.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return given.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_SCORED = "list_sum(list_transform(generate_series(1, 64), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
_ASSIGNED = """g{i} AS (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, c.c, """ + _SCORED + """ AS d FROM v, c{i} c) GROUP BY r)"""
_MOVED = """m{i} AS (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT g.c, unnest(generate_series(1, 64)) AS j, unnest(v.x) AS x FROM g{i} g JOIN v USING (r)) GROUP BY c, j),
c{k} AS (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM m{i} GROUP BY c) m USING (c))"""
OP12_SQL = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x FROM v ORDER BY 1 LIMIT 16),
{", ".join(_ASSIGNED.format(i=i) + ", " + _MOVED.format(i=i, k=i + 1) for i in range(3))}, {_ASSIGNED.format(i=3)},
t AS (SELECT c, sum(d)::BIGINT AS cluster_inertia FROM g3 GROUP BY c)
SELECT v.vec_id, g3.c::INTEGER AS cluster, g3.d AS distance, t.cluster_inertia, (SELECT sum(d)::BIGINT FROM g3) AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM v JOIN g3 USING (r) JOIN t ON t.c = g3.c JOIN c3 ON c3.c = g3.c
"""
