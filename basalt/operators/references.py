"""What a change of rows does to the rows that refer to them: a fixpoint over the graph of references.

Levels are semi-naive: only the rows that a level has added are joined with the tables that refer to them, and rows known
already are left out, so that tables may refer to themselves or to one another in a circle. Rows are named by the
file and place they stand in. Everything is decided, and written beside the tables, before any table changes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID = ["_file", "_row"]


@dataclass
class Effects:
    """Rows that go, by table, and values that change, by table and column (rows _file, _row, _new)."""

    gone: dict[str, list[DataFrame]] = field(default_factory=dict)
    values: dict[tuple[str, str], list[DataFrame]] = field(default_factory=dict)
    refused: list[tuple[str, str, DataFrame]] = field(default_factory=list)  # child, parent, rows that refer


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def known(rows: DataFrame, parts: list[DataFrame] | None) -> DataFrame:
    """rows but those named in parts."""
    return rows.join(union([p.select(*ID) for p in parts]), ID, "left_anti") if parts else rows


def on_delete(name: str, first: DataFrame, named: Callable, links: Callable, stage: Callable) -> Effects:
    """first: the rows of `name` that go. named(table): its rows with _file and _row; links(table): (child, column, parent's
    column, action) of what refers to it; stage(table, frame): the frame written and read again, None if it has no rows."""
    out = Effects({name: [first]})
    level = {name: first}
    while level:
        found: dict[str, list[DataFrame]] = {}
        for parent, rows in level.items():
            for child, column, key, action in links(parent):
                keys = rows.select(F.col(key).alias(column)).dropna().distinct()
                hit = named(child).join(keys, column, "left_semi")
                if action == "CASCADE":
                    found.setdefault(child, []).append(hit)
                elif action == "SET NULL":
                    null = F.lit(None).cast(hit.schema[column].dataType)
                    out.values.setdefault((child, column), []).append(hit.select(*ID, null.alias("_new")))
                else:
                    out.refused.append((child, parent, hit.select(*ID)))
        level = {}
        for child, parts in found.items():
            new = stage(child, known(union(parts).dropDuplicates(ID), out.gone.get(child)))
            if new is not None:
                out.gone.setdefault(child, []).append(new)
                level[child] = new
    return out


def on_update(changed: dict[tuple[str, str], DataFrame], named: Callable, links: Callable, stage: Callable, own: dict[tuple[str, str], DataFrame]) -> Effects:
    """changed: by table and column, (_old, _new) of referenced values; own: by table and column, the rows (_file, _row) whose
    value the statement itself sets, which no reference overrides."""
    out = Effects()
    while changed:
        found: dict[tuple[str, str], list[DataFrame]] = {}
        for (parent, key), pairs in changed.items():
            for child, column, referred, action in links(parent):
                if referred != key:
                    continue
                rows = named(child)
                rows = known(rows, [own[child, column]] if (child, column) in own else None)
                hit = rows.withColumnRenamed(column, "_old").join(pairs.dropDuplicates(["_old"]), "_old")
                if action == "CASCADE":
                    found.setdefault((child, column), []).append(hit.select(*ID, "_old", "_new"))
                elif action == "SET NULL":
                    found.setdefault((child, column), []).append(hit.select(*ID, "_old", F.lit(None).cast(hit.schema["_old"].dataType).alias("_new")))
                else:
                    out.refused.append((child, parent, hit.select(*ID)))
        changed = {}
        for (child, column), parts in found.items():
            new = stage(child, known(union(parts).dropDuplicates(ID), out.values.get((child, column))))
            if new is not None:
                out.values.setdefault((child, column), []).append(new.select(*ID, "_new"))
                changed[child, column] = new.where("_old IS DISTINCT FROM _new").select("_old", "_new")
    return out
