"""Sessions and tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(master: str | None = None, **conf) -> SparkSession:
    """A session with UTC, ANSI, adaptive execution and deep recursion; what is given wins."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.cteRecursionLevelLimit": "10000", "spark.ui.enabled": "false"}
    builder = SparkSession.builder.config(map=base | {k.replace("__", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Temporary views of the tables that a text names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def shared(spark: SparkSession) -> str:
    """Folder for intermediate tables that all executors reach: spark.checkpoint.dir. Where it is unset, one is set:
    a temporary folder of a local session, else a folder in the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        at = tempfile.mkdtemp(prefix="basalt-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch-{uuid.uuid4().hex}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")
