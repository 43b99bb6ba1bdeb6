"""From raw documents to a mixed training corpus: five stages, each written before the next one reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import _common, decontaminate, lines, mixing, neardup, quality


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose share of good neighbours is below one half go. The classifier learns as in its own query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.where(~quality.fold(F.col("doc_id"))))
    out = "_score" + "_" * max(map(len, docs.columns))
    return quality.score(docs, model, out_col=out).where(F.col(out) >= 0.5).select(*[f"`{c}`" for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or all but a word of it, go; so do documents that have lost lines and keep only white space."""
    out = lines.dedup(docs, carry=True)
    empty = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = _common.restored(out.where(~empty | F.col("text").isNull()), docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.without(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, numbered by the column copy (with underscores behind it if documents have one)."""
    name = "copy"
    while name in [c.lower() for c in docs.columns]:
        name += "_"
    mixed = mixing.mix(docs, carry=True).where("copies > 0")
    number = "_nth" + "_" * max(map(len, docs.columns))
    return _common.restored(mixed.withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), docs, more=[F.col(number).cast("int").alias(name)])


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("source mixing", mix_sources),
]

#: The classifier and the signatures have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next; what a stage has staged goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, f in STAGES:
        path = f"{_common.scratch_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with _common.owned(spark):
            f(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            _common.drop(spark, last)
        last = path
    return docs
