"""Sum-of-squares packing of documents into sequences of bounded length."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import lean, small_batches, stage
from .units import byte_ids, parts

MODEL, END = "byte_bpe_50k.json", 2
#: Pieces that one task places, about; slices that number a length's pieces side by side; from here on a shard's numbers
#: are sequences that one piece fills.
SHARD, SLICES, FULL = 1 << 20, 64, 1 << 31


def pieces(docs: DataFrame, model: str = MODEL, capacity: int = 1024, end: int | None = END) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32: each text's ids, then `end`, cut if there are more than
    capacity: the first piece takes what is left over, the others are full. Null texts are empty. Long texts are
    encoded part by part."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        encode, _, apart = byte_ids(model, False)
        tail = np.array([] if end is None else [end], np.int32)
        for batch in batches:
            ids, out = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                x = np.concatenate([*(encode(p) for p in (parts(text) if apart else [text])), tail]).astype("<u4")
                first = len(x) % capacity or min(capacity, len(x))
                cuts = [0, *range(first, len(x) + 1, capacity)] if len(x) else [0]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    ids.append(i)
                    out.append((k, a, b - a, zlib.crc32(x[a:b].tobytes())))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def placed(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, in the order of the lengths given, which must fall.

    open_[g] are the sequences with a gap of g. A piece goes where the sum of the squares of these counts becomes
    smallest, ties to the smaller gap: moving one from gap g to g - s changes the sum by 2 (N[g - s] - N[g]) + 2, and
    filling it up by 1 - 2 N[g]. With the largest first a new sequence is opened only where none has room, so
    that the small ones at the end fill what is left.
    """
    n = int(counts.sum())
    at, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    open_ = np.zeros(capacity + 1, np.int64)
    members: list[list[int]] = [[] for _ in range(capacity + 1)]
    i = sequences = 0
    for s, many in zip(lengths.tolist(), counts.tolist(), strict=True):
        for _ in range(many):
            gap = capacity
            if s < capacity:
                g = open_[s:capacity]
                after = open_[: capacity - s].copy()
                after[0] = 0
                cost = 2 * (after - g) + 2
                cost[0] -= 1
                cost[g == 0] = np.iinfo(np.int64).max
                k = int(cost.argmin())
                if g[k]:
                    gap = s + k
            if gap == capacity:
                mine = sequences
                sequences += 1
            else:
                open_[gap] -= 1
                mine = members[gap].pop()
            at[i], offset[i] = mine, capacity - gap
            if gap > s:
                open_[gap - s] += 1
                members[gap - s].append(mine)
            i += 1
    return at, offset


def pack(docs: DataFrame, model: str = MODEL, capacity: int = 1024, end: int | None = END, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are dealt to shards of about `shard`. A shard's task gets a count for each length, which is at most
    `capacity` rows, places every piece by the sum of squares (see `placed`), largest first, and returns a place for
    each number of a length. The pieces of a length are interchangeable: they are numbered in slices side by side,
    and take the places of their numbers by a join. Pieces of the full length are sequences of their own. What a shard
    leaves open are few sequences beside its million pieces.

    Null and empty texts are one piece, of the end id alone. Repeated rows are pieces of their own, null ids stay, other
    columns are ignored, an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stage(pieces(base, model, capacity, end).withColumn("_r", F.monotonically_increasing_id()), "pack-pieces")
    n = rows._rows if rows._rows is not None else rows.count()
    shards = max(1, -(-n // shard))
    dealt = rows.withColumns({"_s": F.pmod(F.xxhash64("_r"), F.lit(shards)).cast("int"), "_slice": F.pmod(F.xxhash64(F.lit(5), "_r"), F.lit(SLICES)).cast("int")})
    counts = stage(dealt.groupBy("_s", "length", "_slice").agg(F.count("*").alias("n")), "pack-counts")
    before = F.sum("n").over(W.partitionBy("_s", "length").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    bases = counts.select("_s", "length", "_slice", F.coalesce(before, F.lit(0)).cast("long").alias("_before"))
    numbered = dealt.withColumn("_n", F.row_number().over(W.partitionBy("_s", "length", "_slice").orderBy("_r")) - 1)
    numbered = numbered.join(bases, ["_s", "length", "_slice"]).withColumn("_n", F.col("_n") + F.col("_before"))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("length", ascending=False)
        lengths, many = pdf["length"].to_numpy(), pdf["n"].to_numpy()
        at, offset = placed(lengths, many, capacity)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        return pd.DataFrame({"_s": pdf["_s"].iloc[0], "length": np.repeat(lengths, many), "_n": nth, "_at": at, "offset": offset})

    sizes = counts.where(F.col("length") < capacity).groupBy("_s", "length").agg(F.sum("n").alias("n"))
    places = stage(sizes.groupBy("_s").applyInPandas(run, "_s int, length long, _n long, _at long, offset long"), "pack-places")
    sequence = F.col("_s").cast("long") * F.lit(1 << 32)
    part = numbered.where(F.col("length") < capacity).join(places, ["_s", "length", "_n"]).withColumn("sequence_id", sequence + F.col("_at"))
    full = numbered.where(F.col("length") == capacity).withColumns({"sequence_id": sequence + FULL + F.col("_n"), "offset": F.lit(0).cast("long")})
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return part.select(*cols).unionByName(full.select(*cols))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
