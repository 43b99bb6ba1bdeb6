"""Streams of files: changes folded into a table, and windows over event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def time_bucket(ts: str, width: str) -> Column:
    """Start of the epoch-aligned bucket of a width such as `15 minutes`."""
    return F.window(ts, width).getField("start")


def watch(spark: SparkSession, path: str, schema, kind: str = "parquet", per_batch: int | None = 100) -> DataFrame:
    """New files of a folder as a stream, so many at once (None: all that are there)."""
    files = spark.readStream.format(kind).schema(schema)
    return (files.option("maxFilesPerTrigger", per_batch) if per_batch else files).load(path)


def fold(stream: DataFrame, table: str, key: list[str], checkpoint: str, order: str | None = None, buckets: int = 64):
    """Upsert a stream into a Parquet table, which `folded` reads.

    Of all rows of a key, the one of the greatest `order` stays (ties: the greatest other columns); without an
    order, that of the latest batch. So a repeated batch, or one that comes late, changes nothing. The table is kept
    in buckets of keys; a batch writes only the buckets it touches, beside the table first, then in their place.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        at = F.lit(epoch).cast("long") if order is None else F.lit(0).cast("long")
        rows = df.withColumns({"_epoch": at, "_bucket": F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")})
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        every = rows
        if fs.exists(path):
            touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # bounded by the number of buckets
            every = spark.read.schema(rows.schema).parquet(table).where(F.col("_bucket").isin(touched)).unionByName(rows)
        newest = [F.desc_nulls_last(c) for c in ([order] if order else []) + ["_epoch"] + [c for c in df.columns if c not in key and c != order]]
        one = every.withColumn("_r", F.row_number().over(W.partitionBy("_bucket", *key).orderBy(*newest))).where("_r = 1").drop("_r")
        beside = f"{table}-staged-{epoch}"
        one.write.mode("overwrite").parquet(beside)
        spark.read.schema(rows.schema).parquet(beside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(table)
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside), True)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def folded(spark: SparkSession, table: str) -> DataFrame:
    """The newest row of each key of a table that `fold` keeps."""
    return spark.read.parquet(table).drop("_epoch", "_bucket")


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and event type; beyond the reference. Works on batches and streams."""
    timed = events.withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """What a stream has to say of all files there are, added to a Parquet table: a window's row once the watermark has
    passed its end. A later call goes on where this one ended; rows of windows that have passed are too late and dropped."""
    kept = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    kept.outputMode("append").trigger(availableNow=True).start().awaitTermination()
