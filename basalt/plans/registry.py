"""Where queries register themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basalt.engine import Engine
from basalt.session import views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def statement(name: str, text: str, oracle: str | None = None) -> None:
    """Register a statement of the engine's dialect; oracle: its form elsewhere, if it differs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return Engine(spark).sql(text)

    QUERIES[name] = run
    SQL[name] = oracle or text
