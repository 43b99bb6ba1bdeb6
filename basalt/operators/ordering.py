"""Order of nulls and frames of windows as the reference has them, stated explicitly."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order(col: str | Column, ascending: bool = True) -> Column:
    """Nulls last when ascending, first when descending."""
    c = F.col(col) if isinstance(col, str) else col
    return c.asc_nulls_last() if ascending else c.desc_nulls_first()


def window(partition: list | None = None, by: list[Column] | None = None) -> WindowSpec:
    """For aggregates and value functions: rows up to the current one if ordered, else the whole partition."""
    spec = W.partitionBy(*(partition or []))
    if by:
        return spec.orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)
    return spec


def distinct_over(col: str, spec: WindowSpec, kind: str = "count") -> Column:
    """count or sum of distinct values over a window, which Spark rejects as an aggregate."""
    values = F.collect_set(col).over(spec)
    if kind == "count":
        return F.size(values).cast("long")
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))
