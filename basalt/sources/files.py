"""Files of any format that Spark reads or writes, and only the changed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema=None, modified_after: str | None = None, **options) -> DataFrame:
    """modified_after: a scan watermark, so that only newer files are read."""
    if kind not in FORMATS:
        raise ValueError(f"{kind}: not one of {FORMATS}")
    r = spark.read.format(kind).options(**options)
    r = r.schema(schema) if schema is not None else r
    return (r.option("modifiedAfter", modified_after) if modified_after else r).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    w = df.write.format(kind).mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
