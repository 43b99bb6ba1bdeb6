"""Versioned tables, and changes of tables as new DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(history: DataFrame, key: list[str], column: str, moment, deleted: str = "deleted", transaction: str | None = None) -> DataFrame:
    """Rows as they were: of each key the newest version with `column` <= moment, unless that one is a deletion.

    column: a timestamp (AS OF TIMESTAMP) or a transaction number (AS OF TRANSACTION). Of versions with equal
    timestamps the one of the largest `transaction` is the newest. The filter reaches the scan; the window keeps
    one row per key before it is shuffled (group limit).
    """
    newest = W.partitionBy(*key).orderBy(F.desc(column), *([F.desc(transaction)] if transaction else []))
    seen = history.where(F.col(column) <= F.lit(moment)).withColumn("_r", F.row_number().over(newest)).where("_r = 1")
    return seen.where(~F.col(deleted)).drop("_r")


def insert(table: DataFrame, rows: DataFrame, defaults: dict | None = None) -> DataFrame:
    """table with the rows appended; missing columns take their default or null; values are coerced, null on failure."""
    cols = [
        (F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") if f.name in rows.columns else F.lit((defaults or {}).get(f.name)).cast(f.dataType)).alias(f.name)
        for f in table.schema.fields
    ]
    return table.union(rows.select(*cols))


def update(table: DataFrame, changes: dict[str, str], where: str = "true") -> DataFrame:
    """All columns of changes are computed from the row as it was."""
    hit = F.coalesce(F.expr(where), F.lit(False))
    return table.select(*[F.when(hit, F.expr(changes[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in changes else F.col(f.name) for f in table.schema.fields])


def delete(table: DataFrame, where: str = "true") -> DataFrame:
    """Rows stay where the condition is false or null."""
    return table.where(~F.coalesce(F.expr(where), F.lit(False)))


def delete_matching(table: DataFrame, keys: DataFrame, on: list[str], where: str = "true") -> DataFrame:
    """DELETE ... WHERE (columns) IN (query) AND where: the rows that stay. The keys stay distributed."""
    hit = keys.select(*on).dropna().distinct().withColumn("_hit", F.lit(True))
    marked = table.join(hit, on, "left").where(~F.coalesce(F.col("_hit") & F.expr(where), F.lit(False)))
    return marked.select(*table.columns)


def returning(table: DataFrame, where: str, *exprs: str) -> DataFrame:
    """What UPDATE or DELETE ... RETURNING gives: expressions over the affected rows."""
    return table.where(where).selectExpr(*exprs)


def truncate(table: DataFrame) -> DataFrame:
    return table.limit(0)


def upsert(table: DataFrame, rows: DataFrame, key: list[str], changes: dict[str, str] | None = None) -> DataFrame:
    """INSERT ... ON DUPLICATE KEY UPDATE: rows with a known key change it, others are added.

    changes: column -> SQL over old.<column> and new.<column>; by default the new row's columns win. One full
    outer join on the key.
    """
    a, b = table.alias("old"), rows.alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in key]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    here, there = F.col(f"old.{key[0]}").isNotNull(), F.col(f"new.{key[0]}").isNotNull()
    cols = []
    for f in table.schema.fields:
        fresh = F.col(f"new.{f.name}") if f.name in rows.columns else F.lit(None)
        change = F.expr(changes[f.name]) if changes is not None and f.name in changes else (fresh if changes is None and f.name in rows.columns else F.col(f"old.{f.name}"))
        cols.append(F.when(here & there, change).when(there, fresh).otherwise(F.col(f"old.{f.name}")).cast(f.dataType).alias(f.name))
    return a.join(b, cond, "full_outer").select(*cols)


# --- constraints: each returns the offending rows -------------------------------------------------


def not_unique(table: DataFrame, key: list[str]) -> DataFrame:
    twice = table.groupBy(*key).agg(F.count("*").alias("_copies")).where("_copies > 1")
    return twice.withColumnRenamed("_copies", "n" if "n" not in key else "copies")


def is_null(table: DataFrame, column: str) -> DataFrame:
    return table.where(F.col(column).isNull())


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias("_pk")), F.col(fk) == F.col("_pk"), "left_anti")


def fails_check(table: DataFrame, check: str) -> DataFrame:
    """Null passes."""
    return table.where(~F.expr(check))


def wrong_dimension(table: DataFrame, column: str, n: int) -> DataFrame:
    return table.where(F.size(column) != n)


def cascade(child: DataFrame, fk: str, deleted: DataFrame, pk: str, action: str = "cascade") -> DataFrame:
    """The child table after parents went: its rows go too (cascade), or lose their reference (set null)."""
    gone = deleted.select(F.col(pk).alias("_pk"), F.lit(True).alias("_gone")).distinct()
    joined = child.join(gone, F.col(fk) == F.col("_pk"), "left")
    if action == "cascade":
        return joined.where("_gone IS NULL").drop("_pk", "_gone")
    return joined.withColumn(fk, F.when(F.col("_gone").isNull(), F.col(fk))).drop("_pk", "_gone")
