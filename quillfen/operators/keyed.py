"""Joins of a frame with a per-key table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", small: bool = False
) -> DataFrame:
    """Join on `keys`, null keys matching null keys; the right keys are dropped.

    `small` is for tables whose size is bounded by construction and broadcasts them;
    otherwise the adaptive planner picks the join and splits hot keys.
    """
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    joined = left.join(F.broadcast(renamed) if small else renamed, same, how)
    return joined if how == "left_semi" or how == "left_anti" else joined.drop(*[f"_right_{k}" for k in keys])


def group_values(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Add group aggregates to every row; rows with a null key get null.

    Aggregating first and joining back keeps a hot group spread over many tasks,
    which a window over the group would not.
    """
    grouped = df.dropna(subset=list(keys)).groupBy(*keys)
    totals = grouped.agg(*[c.alias(n) for n, c in aggregates.items()])
    renamed = totals.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_right_{k}") for k in keys])
    return df.join(renamed, same, "left").drop(*[f"_right_{k}" for k in keys])
