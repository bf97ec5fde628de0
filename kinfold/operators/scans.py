"""Prefix sums over rows in order, by reduce-then-scan: no task holds a whole key, however many rows it has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.lineage import written


def prefix_sums(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Adds for each item out: value of values the sum of value (an integer; null counts 0) over the rows of the same keys up to this
    one, in the order of the columns `order`.

    Rows are dealt out by ranges of (keys, order), each task sums its own, and is written once. A key's part in a task is
    raised by what the tasks before hold of it: as ranges follow each other, only the first key of a task has any there, so
    that there are at most as many carries as tasks. Rows that are equal in keys and order come in any order."""
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), *keys, *order).sortWithinPartitions(*keys, *order)
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + "".join(f", `{out}` long" for out in values) + ", _task int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, last, carry = TaskContext.get().partitionId(), None, dict.fromkeys(values, 0)
        for pdf in batches:
            if not len(pdf):
                continue
            # a null key is a key of its own
            same = np.ones(len(pdf), bool)
            for k in keys:
                now, then = pdf[k].iloc[1:].reset_index(drop=True), pdf[k].iloc[:-1].reset_index(drop=True)
                same[1:] &= ((now == then) | (now.isna() & then.isna())).to_numpy(bool)
            head = tuple(None if pd.isna(x) else x for x in pdf[keys].iloc[0])
            same[0] = False
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(pdf))))
            shown = pdf[names].copy()
            for out, value in values.items():
                sums = pdf[value].fillna(0).to_numpy(np.int64).cumsum()
                total = sums - np.where(first > 0, sums[first - 1], 0) + np.where(first == 0, carry[out] if head == last else 0, 0)
                shown[out], carry[out] = total, int(total[-1])
            last = tuple(None if pd.isna(x) else x for x in pdf[keys].iloc[-1])
            shown["_task"] = task
            yield shown

    local = written(ranged.mapInPandas(run, schema))
    amount = local.groupBy("_task", *keys).agg(*[F.sum(F.coalesce(value, F.lit(0))).alias(f"_{out}") for out, value in values.items()])
    # of each task the keys that also stand in an earlier one: the first alone
    earlier = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    carries = amount.select("_task", *[F.col(k).alias(f"_{k}") for k in keys], *[F.sum(f"_{out}").over(earlier).alias(f"_carry_{out}") for out in values])
    carries = carries.where(F.col(f"_carry_{next(iter(values))}").isNotNull())
    same = local["_task"] == carries["_task"]
    for k in keys:
        same = same & local[k].eqNullSafe(carries[f"_{k}"])
    joined = local.join(F.broadcast(carries), same, "left")
    return joined.select(*[local[c] for c in names], *[(local[out] + F.coalesce(f"_carry_{out}", F.lit(0))).alias(out) for out in values])
