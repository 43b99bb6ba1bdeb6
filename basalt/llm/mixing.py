"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import rest, stage

WORD = r"[^\x20\x09-\x0D]+"
SPAN = 4096


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(_null, _source, source_size, target) of sources with their sizes: shares by weight, cut at cap times the size.

    The excess is reshared by weight until no target is above its cap: the fixed point is a common level l with
    target = least(cap * size, l * weight), found from prefix sums over the sources in the order of cap / weight.
    """
    every = W.orderBy("_null", "_source")
    turn = F.pmod(F.row_number().over(every) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).withColumn("_cap", F.lit(cap) * F.col("source_size"))
    order = W.orderBy(F.col("_cap") / F.col("_w"), "_null", "_source")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = ranked.withColumn("_level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    found = levels.withColumn("_l", F.max(F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.col("_level"))).over(whole))
    return found.select("_null", "_source", "source_size", F.least("_cap", F.col("_l") * F.col("_w")).alias("target"))


def mix(docs: DataFrame, weights: tuple = (1, 2, 3), cap: float = 3.0, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken = copies * size.

    Documents stand in their source by (size, doc_id); each expects target / source_size copies; with one offset
    in [0, 1) added to the prefix sums, it is emitted once per integer boundary that its interval crosses.
    The rank within the source is summed up in four levels (band of sizes, size, span of 4096 ids, row), each a
    small pre-aggregated table, so a source with a third of all rows never meets in one task.

    Null text: size 0. Null source: a source of its own, last. Null doc_id: last of its size, by a hash of the text. Rows
    that are equal in id and size are interchangeable. Sources without words have target 0. Empty table: no rows.
    Other columns are ignored; with carry the text and they, as a struct _rest, come along.
    """
    offset = random.Random(seed).random()
    # Rows without an id stand by a hash of their text; equal ones, which are interchangeable, by the task that wrote them.
    nameless = F.lit(1 << 61) + F.col("_t") * F.lit(4096) + F.pmod(F.spark_partition_id(), F.lit(4096))
    base = stage(
        docs.select(F.col(id_col).alias("doc_id"), F.pmod(F.xxhash64(F.lit(5), F.col(text_col)), F.lit(1 << 40)).alias("_t"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), *([F.col(text_col).alias("text")] if carry else []), *rest(docs, text_col, carry))
        .withColumns({"_null": F.col("source").isNull(), "_source": F.coalesce("source", F.lit("")), "_band": F.floor(F.log2(F.col("size") + F.lit(1.0)) * 4).cast("int"), "_span": F.when(F.col("doc_id").isNull(), nameless).otherwise(F.floor(F.col("doc_id").cast("long") / F.lit(SPAN)).cast("long"))}),
        "mix-base",
    )
    src = ["_null", "_source"]
    spans = base.groupBy(*src, "_band", "size", "_span").agg(F.count("*").alias("_n"))
    sized = spans.groupBy(*src, "_band", "size").agg(F.sum("_n").alias("_n"))
    bands = sized.groupBy(*src, "_band").agg(F.sum("_n").alias("_n"))
    run = lambda w: F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1))
    bands = bands.select(*src, "_band", F.coalesce(run(W.partitionBy(*src).orderBy("_band")), F.lit(0)).alias("_a"))
    sized = sized.select(*src, "_band", "size", F.coalesce(run(W.partitionBy(*src, "_band").orderBy("size")), F.lit(0)).alias("_b"))
    spans = spans.select(*src, "_band", "size", "_span", F.coalesce(run(W.partitionBy(*src, "size").orderBy("_span")), F.lit(0)).alias("_c"))
    goal = targets(base.groupBy(*src).agg(F.sum("size").alias("source_size")), weights, cap)
    starts = spans.join(sized, [*src, "_band", "size"]).join(bands.join(goal, src), [*src, "_band"])
    starts = starts.select(*src, "size", "_span", (F.col("_a") + F.col("_b") + F.col("_c")).alias("_start"), "source_size", "target")
    rows = base.withColumn("_i", F.row_number().over(W.partitionBy(*src, "size", "_span").orderBy("doc_id")) - 1)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("_start") + F.col("_i")
    copies = (F.floor((at + 1) * rate + F.lit(offset)) - F.floor(at * rate + F.lit(offset))).cast("long")
    return rows.join(starts, [*src, "size", "_span"]).withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["text", "_rest"] if carry else []))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s),
v AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, max(CASE WHEN cap / w >= level THEN level END) OVER () * w) AS target FROM v),
r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS LAST) - 1 AS i FROM d)
SELECT doc_id, size, source_size, target,
  (size * CASE WHEN source_size > 0 THEN floor((i + 1) * (target / source_size) + {random.Random(20).random()!r}) - floor(i * (target / source_size) + {random.Random(20).random()!r}) ELSE 0 END)::BIGINT AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
"""
