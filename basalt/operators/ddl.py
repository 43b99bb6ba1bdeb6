"""Tables as statements define them: types, columns, managed copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.dialect import TYPES


def storage_type(declared: str) -> str:
    """Spark type of a declared one: all integers 64 bits, all decimals double, all text string, VECTOR(n) array<float>."""
    base = declared.split("(")[0].strip().upper()
    if base == "VECTOR":
        return "array<float>"
    return {"DATE": "timestamp", "TIME": "timestamp"}.get(base, TYPES.get(base, base)).lower()


def create_table_as(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    df.write.mode("overwrite").saveAsTable(name)
    return spark.table(name)


def create_table(spark: SparkSession, name: str, columns: dict[str, str]) -> DataFrame:
    """An empty managed table of declared types."""
    return create_table_as(spark, name, spark.createDataFrame([], ", ".join(f"`{c}` {storage_type(t)}" for c, t in columns.items())))


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def add_column(df: DataFrame, name: str, declared: str, default: str = "NULL") -> DataFrame:
    """Old rows get the default."""
    return df.withColumn(name, F.expr(f"CAST({default} AS {storage_type(declared)})"))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def modify_column(df: DataFrame, name: str, declared: str) -> DataFrame:
    """Values that don't convert become null."""
    return df.withColumn(name, F.expr(f"try_cast(`{name}` AS {storage_type(declared)})"))


def describe(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes
