"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bucket_of, chunks, lean, mix, utf8, small_batches

TERMS = 4096
ROWS = 256  # documents whose term counts are dense at a time
STEP = 4 << 20  # bytes whose grams are counted at a time


def features(raw: np.ndarray, off: np.ndarray, terms: int = TERMS) -> np.ndarray:
    """Log counts of hashed byte 3-grams and of byte-class 6-grams of whole texts, text x terms (float32)."""
    n = len(off) - 1
    out = np.zeros((n, terms), np.float32)
    if not len(raw):
        return out
    # Classes: lower, upper, digit, space, line end, other ASCII as it is, beyond ASCII.
    kind = np.arange(256, dtype=np.uint64)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 1, 2, 3, 4
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))
    half = terms // 2
    for table, width, at in ((None, 3, 0), (kind, 6, half)):
        for a in range(0, len(raw) - width + 1, STEP):  # a long text in pieces, whose grams are counted together
            part = raw[a : a + STEP + width - 1]
            values = part.astype(np.uint64) if table is None else table[part]
            code = np.zeros(len(values) - width + 1, np.uint64)
            for j in range(width):
                code = (code << np.uint64(8)) | values[j : len(values) - width + 1 + j]
            mine = row[a : a + len(code)]
            inside = mine == row[a + width - 1 : a + width - 1 + len(code)]
            slot = (mix(code[inside]) % np.uint64(half)).astype(np.int64) + at
            out += np.bincount(mine[inside].astype(np.int64) * terms + slot, minlength=n * terms).reshape(n, terms).astype(np.float32)
    return np.log1p(out)


class Model:
    """Projection to the latent space, labelled vectors in it, their labels."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, dims: int = 64, neighbours: int = 15, seed: int = 5):
        df = (x > 0).sum(0)
        self.idf = np.log((1 + len(x)) / (1 + df)).astype(np.float32) + 0.1
        self.neighbours = min(neighbours, len(x))
        self.prior = float(labels.mean())
        x = self._unit(x * self.idf)
        dims = min(dims, *x.shape)
        rng = np.random.default_rng(seed)
        basis = rng.standard_normal((x.shape[1], min(dims + 10, *x.shape))).astype(np.float32)
        for _ in range(4):  # randomised subspace iteration towards the leading right singular vectors
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        small = np.linalg.svd(x @ basis, full_matrices=False)[2]
        self.map = (basis @ small.T)[:, :dims].astype(np.float32)
        self.vectors = self._unit(x @ self.map)
        self.labels = labels.astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest neighbours, weighted by their cosine (negative: 0); prior if none is similar."""
        v = self._unit((self._unit(x * self.idf)) @ self.map)
        cos = v @ self.vectors.T  # exact, block by block
        k = self.neighbours
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** 2
        total = w.sum(1)
        return np.clip(np.where(total > 1e-9, (w * self.labels[near]).sum(1) / np.maximum(total, 1e-9), self.prior), 0, 1)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Model of a sample of about max_rows labelled documents (documented bound).

    Labelled ids are counted, then picked by a hash of the id at the rate that gives max_rows. An id with several
    labels has their rounded mean. The picked labels, bounded by the sample, are broadcast to find their texts;
    term counts are made on the executors; their sparse rows come to the driver, which fits the projection.
    None if nothing can be learned from.
    """
    each = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.round(F.avg(label_col)).cast("int").alias("_y"))
    n = each.count()
    if not n:
        return None
    picked = each.where(F.pmod(F.xxhash64(F.lit(21), "_id"), F.lit(1 << 30)) < int(min(1.0, max_rows / n) * (1 << 30)))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(picked), "_id").select("_id", "_text", "_y")
    texts = texts.groupBy("_id").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"), F.min("_y").alias("_y"))  # one text of an id

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            raw, off = utf8(batch.column(1))
            for a in range(0, len(off) - 1, ROWS):
                b = min(len(off) - 1, a + ROWS)
                x = features(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                at = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_pydict({"id": batch.column(0).slice(a, b - a), "y": batch.column(2).slice(a, b - a), "at": pa.array([i.astype(np.int16).tobytes() for i in at], pa.binary()), "x": pa.array([x[j][i].astype(np.float16).tobytes() for j, i in enumerate(at)], pa.binary())})

    kind = texts.schema["_id"].dataType.simpleString()
    rows = texts.mapInArrow(lean(count), f"id {kind}, y int, at binary, x binary").toArrow().sort_by("id")
    if not rows.num_rows:
        return None
    x = np.zeros((rows.num_rows, TERMS), np.float32)
    for i, (at, v) in enumerate(zip(rows["at"].to_pylist(), rows["x"].to_pylist(), strict=True)):
        x[i, np.frombuffer(at, np.int16)] = np.frombuffer(v, np.float16)
    return Model(x, np.array(rows["y"].to_pylist()))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[Column] | None = None, out_col: str = "_score") -> DataFrame:
    """The kept columns (all by default) plus out_col (to be a new name): how likely label 1 is, from the whole text alone.

    Null and empty texts have no terms and get the prior; without a model all get 1. Repeated rows give a row
    each; empty tables give none. The labelled vectors (bounded by the training sample) are broadcast; each
    block of documents multiplies with all of them. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    cols = keep or [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.select(*cols, F.col(text_col).cast("string").alias(f"{out_col}_text"))
    names = kept.columns[:-1]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + f", `{out_col}` double"

    def run(batches):
        import pyarrow as pa

        m = sent.value
        for batch in batches:
            raw, off = utf8(batch.column(batch.num_columns - 1))
            out = np.ones(len(off) - 1)
            for a, b in chunks(off) if m else ():
                for i in range(a, b, ROWS):
                    j = min(b, i + ROWS)
                    out[i:j] = m.score(features(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(out)], names=[*names, out_col])

    return kept.mapInArrow(lean(run), schema)


def fold(col: Column) -> Column:
    return F.coalesce(bucket_of(col, 3) == 1, F.lit(False))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(~fold(F.col("doc_id"))))
    scored = score(docs, model, keep=[F.col("doc_id"), fold(F.col("doc_id")).alias("held_out")])
    return scored.select("doc_id", "held_out", F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
