"""Windows over few large partitions, or none: places and ranks from sorted ranges, so that no task holds a partition."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basalt.session import shared

#: A row's number within its task; monotonically_increasing_id has the task above it.
TASK, ROW = 33, (1 << 33) - 1
#: Tables of up to so many rows are broadcast; rows that a task sorts, about.
FEW, SORTED = 100_000, 400_000


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: what follows sees the same rows, tasks and numbers."""
    path = f"{shared(df.sparkSession)}/spread-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(a: DataFrame, b: DataFrame, keys: dict[str, str]) -> Column:
    """Equality of keys of two frames, nulls being equal."""
    return functools.reduce(lambda x, y: x & y, [a[x].eqNullSafe(b[y]) for x, y in keys.items()])


def few(df: DataFrame) -> bool:
    return df.limit(FEW + 1).count() <= FEW


def pieces(df: DataFrame) -> int:
    """Tasks for a frame, so that what one of them sorts stays the same as tables grow."""
    return df.count() // SORTED + 1


def with_facts(rows: DataFrame, facts: DataFrame, keys: dict[str, str], weight: str) -> DataFrame:
    """rows and what facts tell of their keys (rows' column: facts' column); weight: how many rows a key has.

    Facts of many keys are shuffled, but for those of keys with more than one row in FEW, of which there can be no more.
    """
    drop = list(keys.values())
    if few(facts):
        return rows.join(F.broadcast(facts), same(rows, facts, keys)).drop(*drop)
    least = facts.agg(F.sum(weight)).first()[0] / FEW
    often, seldom = facts.where(F.col(weight) >= least), facts.where(F.col(weight) < least)
    some = rows.join(F.broadcast(often), same(rows, often, keys)).drop(*drop)
    rest = rows.join(F.broadcast(often), same(rows, often, keys), "left_anti")
    return some.unionByName(rest.join(seldom.hint("merge"), same(rest, seldom, keys)).drop(*drop))


def placed(df: DataFrame, by: list[Column], total: str | None = None) -> DataFrame:
    """df and _at, the rows before each (or the sum of `total`, a column of longs, over them) in the order of `by`: ranges
    of it are sorted by tasks, and what tasks hold is summed up, one row for each. Without an order: as they come."""
    laid = df.repartitionByRange(pieces(df), *by).sortWithinPartitions(*by) if by else df
    rows = kept(laid.withColumn("_i", F.monotonically_increasing_id())).withColumn("_t", F.shiftright("_i", TASK))
    held = rows.groupBy(F.col("_t").alias("_task")).agg((F.sum(total) if total else F.count("*")).alias("_m"))
    before = W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    starts = held.select("_task", F.coalesce(F.sum("_m").over(before), F.lit(0)).cast("long").alias("_s"))
    if total:
        inner = W.partitionBy("_t").orderBy("_i").rowsBetween(W.unboundedPreceding, -1)
        here = F.coalesce(F.sum(total).over(inner), F.lit(0)).cast("long")
    else:
        here = F.col("_i").bitwiseAND(F.lit(ROW))
    rows = rows.withColumn("_here", here)
    return rows.join(F.broadcast(starts), rows["_t"] == starts["_task"]).withColumn("_at", F.col("_s") + F.col("_here")).drop("_task", "_s", "_here", "_i")


def numbered(df: DataFrame, partition: list[str], by: list[Column], out: str = "_n", size: str = "_size") -> DataFrame:
    """df and its row_number in each partition, in the order of `by` (without one: in any), and the partition's rows.

    Partitions are few and large, or there is none (an empty list); rows of a partition are spread over tasks. A partition's
    first place is told to its rows of each task, so that a key of that join has no more rows than a task.
    """
    rows = placed(df, [*(F.col(p).asc_nulls_last() for p in partition), *by] if partition or by else [])
    names = {p: f"_p{i}" for i, p in enumerate(partition)}
    cells = rows.groupBy(F.col("_t").alias("_task"), *[F.col(p).alias(n) for p, n in names.items()]).agg(F.min("_at").alias("_low"), F.count("*").alias("_m"))
    whole = W.partitionBy(*names.values())
    cells = cells.select("_task", *names.values(), F.min("_low").over(whole).alias("_first"), F.sum("_m").over(whole).alias(size))
    keys = {"_t": "_task"} | names
    found = rows.join(F.broadcast(cells) if few(cells) else cells, same(rows, cells, keys))
    return found.withColumn(out, F.col("_at") - F.col("_first") + 1).drop("_at", "_t", "_first", *keys.values())


def ranked(df: DataFrame, partition: list[str], by: dict[str, bool]) -> DataFrame:
    """df and _rank, _dense (its ranks in its partition by the columns of `by`, each with whether it descends), _peers (rows of the
    same keys) and _size (rows of the partition). Rows of the same keys are counted first, by tasks; ranks are sums
    over distinct keys."""
    keys = {k: f"_k{i}" for i, k in enumerate([*partition, *by])}
    peers = df.groupBy(*[F.col(k).alias(n) for k, n in keys.items()]).agg(F.count("*").alias("_peers"))
    inside = [keys[p] for p in partition]
    order = [F.col(keys[k]).desc_nulls_first() if down else F.col(keys[k]).asc_nulls_last() for k, down in by.items()]
    one = numbered(peers, inside, order, "_dense", "_keys").drop("_keys")
    summed = placed(one, [*(F.col(p).asc_nulls_last() for p in inside), F.col("_dense")], "_peers").drop("_t")
    whole = summed.groupBy(*[F.col(p).alias(f"{p}_") for p in inside]).agg(F.min("_at").alias("_first"), F.sum("_peers").alias("_size"))
    found = summed.join(F.broadcast(whole) if few(whole) else whole, same(summed, whole, {p: f"{p}_" for p in inside}) if inside else F.lit(True))
    facts = kept(found.withColumn("_rank", F.col("_at") - F.col("_first") + 1).drop("_at", "_first", *[f"{p}_" for p in inside]))
    return with_facts(df, facts, keys, "_peers")


def tile(number: Column, size: Column, n: int) -> Column:
    """ntile(n) of a row number in a partition of `size` rows: the first ones have a row more."""
    at, least, more = number - 1, F.call_function("div", size, F.lit(n)), size % n
    wide = more * (least + 1)
    return F.when(at < wide, F.call_function("div", at, least + 1)).otherwise(more + F.call_function("div", at - wide, F.greatest(least, F.lit(1)))) + 1


def lagged(df: DataFrame, number: str, value: str, out: str, by: int = 1) -> DataFrame:
    """df and the value of the row `by` places before, by the number of numbered rows (null before the first)."""
    n = pieces(df)
    rows = df.repartition(n, number)
    earlier = df.select((F.col(number) + by).alias("_to"), F.col(value).alias(out)).repartition(n, "_to")
    return rows.join(earlier, rows[number] == earlier["_to"], "left").drop("_to")
