"""Window functions of one's own, over ordered partitions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_function(df: DataFrame, process: Callable[[pd.Series], pd.Series], value: str, out: str, kind: str, partition: list[str], order: list[str] = ()) -> DataFrame:
    """df with the column `out` of type `kind`: what `process` makes of the values of each partition, in order.

    process takes the values of one partition as a series and returns as many. Descending keys begin with -. Nulls
    come last in ascending order and first in descending order. Null partitions are one partition. Like any window
    without a frame, a partition is handled by one task. Spark sorts the rows; they come in batches of many partitions.
    """
    keys = [F.col(k.lstrip("-")) for k in order]
    by = [k.desc_nulls_first() if o.startswith("-") else k.asc_nulls_last() for k, o in zip(keys, order, strict=True)]
    names = df.columns
    marks = [F.col(p).isNull().alias(f"_n{i}") for i, p in enumerate(partition)]
    marked = [*partition, *(f"_n{i}" for i in range(len(partition)))]

    def same(a, b):
        return (a == b) | ((a != a) & (b != b)) | (pd.isna(a) & pd.isna(b))

    def run(batches):
        held: list[pd.DataFrame] = []

        def close(rows: pd.DataFrame, starts: list[int]) -> pd.DataFrame:
            made = []
            for at, end in zip(starts, [*starts[1:], len(rows)], strict=True):
                part = list(process(rows[value].iloc[at:end].reset_index(drop=True)))
                if len(part) != end - at:
                    raise ValueError(f"{len(part)} values for {end - at} rows")
                made += part
            return rows[names].assign(**{out: made})

        for rows in batches:
            if not len(rows):
                continue
            rows = rows.reset_index(drop=True)
            new = np.zeros(len(rows), bool)
            for c in marked:
                new |= ~np.asarray(same(rows[c], rows[c].shift()), bool)
            new[0] = bool(held) and not all(same(held[-1][c].iloc[-1], rows[c].iloc[0]) for c in marked)
            starts = np.flatnonzero(new).tolist()
            if starts and held and starts[0] == 0:
                yield close(pd.concat(held, ignore_index=True), [0])
                held = []
            elif starts:
                yield close(pd.concat([*held, rows.iloc[: starts[0]]], ignore_index=True), [0])
                held = []
            if len(starts) > 1:
                yield close(rows.iloc[starts[0] : starts[-1]].reset_index(drop=True), [x - starts[0] for x in starts[:-1]])
            held.append(rows.iloc[starts[-1] :] if starts else rows)
        if held:
            yield close(pd.concat(held, ignore_index=True), [0])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` {kind}"
    dealt = df.select("*", *marks)
    dealt = dealt.repartition(*partition).sortWithinPartitions(*partition, *by) if partition else dealt.repartition(1).sortWithinPartitions(*by) if by else dealt.repartition(1)
    return dealt.mapInPandas(run, schema)
