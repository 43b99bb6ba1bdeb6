"""Quantified comparisons and set operations with the reference's precedence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPS = {">": ("max", "min"), ">=": ("max", "min"), "<": ("min", "max"), "<=": ("min", "max")}


def condition(left: str, op: str, kind: str, rows: str, values: str, low: str, high: str) -> str:
    """SQL of `left op ALL|ANY` over what is known of the values: how many rows, how many of them not null, the
    least and the greatest, in the values' own type.

    ALL of nothing is true, ANY of nothing false. The range operators ignore nulls among the values, and are false
    if there are only nulls. = ALL and <> ANY are decided by two different values, else by the only one; nulls
    leave what isn't decided unknown.
    """
    every = kind.upper() == "ALL"
    empty = f"WHEN {rows} = 0 THEN {str(every).upper()}"
    if op in OPS:
        edge = {"max": high, "min": low}[OPS[op][0 if every else 1]]
        return f"CASE {empty} WHEN {values} = 0 THEN FALSE ELSE ({left}) {op} {edge} END"
    return f"CASE {empty} WHEN ({left}) IS NULL THEN NULL WHEN {low} <> {high} OR ({left}) <> {low} THEN {str(not every).upper()} WHEN {rows} > {values} THEN NULL ELSE {str(every).upper()} END"


def quantified(df: DataFrame, expr: str, op: str, kind: str, values: DataFrame) -> DataFrame:
    """Rows of df with `expr op ALL|ANY (values)`: = ANY is a semi join, <> ALL a null-aware anti join, all else
    `condition`.

    The values shrink to one row (combined before the shuffle), so the cross join is a broadcast of it.
    """
    kind, name = kind.upper().replace("SOME", "ANY"), values.columns[0]
    if op == "=" and kind == "ANY":
        return df.join(values.select(F.col(name).alias("_v")), F.expr(f"({expr}) = _v"), "left_semi")
    low = values.agg(F.count("*").alias("_all"), F.count(name).alias("_some"), F.min(name).alias("_min"), F.max(name).alias("_max"))
    if op in ("<>", "!=") and kind == "ALL":
        kept = df.join(values.select(F.col(name).alias("_v")).where("_v IS NOT NULL"), F.expr(f"({expr}) = _v"), "left_anti")
        test = f"_all = 0 OR (_all = _some AND ({expr}) IS NOT NULL)"
    else:
        kept, test = df, condition(expr, op, kind, "_all", "_some", "_min", "_max")
    return kept.crossJoin(F.broadcast(low)).where(test).drop("_all", "_some", "_min", "_max")


def combine(first: DataFrame, *rest: tuple[str, DataFrame]) -> DataFrame:
    """A chain of set operations: INTERSECT and EXCEPT bind tighter than UNION before them, else from the left."""
    do: dict[str, Callable] = {
        "union": lambda a, b: a.union(b).distinct(), "union all": lambda a, b: a.union(b), "intersect": lambda a, b: a.intersect(b),
        "intersect all": lambda a, b: a.intersectAll(b), "except": lambda a, b: a.subtract(b), "except all": lambda a, b: a.exceptAll(b),
    }
    terms: list[tuple[str, DataFrame]] = [("", first)]
    for op, df in rest:
        if op.lower().startswith("union"):
            terms.append((op.lower(), df))
        else:
            head, left = terms[-1]
            terms[-1] = (head, do[op.lower()](left, df))
    out = terms[0][1]
    for op, df in terms[1:]:
        out = do[op](out, df)
    return out
