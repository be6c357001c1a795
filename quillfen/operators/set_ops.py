"""UNION, UNION ALL, INTERSECT and EXCEPT with the multiplicities of the workbench."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillfen.operators.keyed import keyed_join
from quillfen.operators.sampling import row_hash


def align(left: DataFrame, right: DataFrame, match_by_name: bool) -> DataFrame:
    """Right side with the left side's columns: picked by name, or renamed by position."""
    if match_by_name:
        return right.select(*left.columns)
    if len(left.columns) != len(right.columns):
        raise ValueError("positional set operations need the same number of columns")
    return right.toDF(*left.columns)


def set_op(left: DataFrame, right: DataFrame, kind: str, match_by_name: bool = True) -> DataFrame:
    if match_by_name and set(left.columns) <= set(right.columns):
        right = align(left, right, True)
    elif not match_by_name:
        right = align(left, right, False)
    if kind == "union_all":
        return left.unionByName(right, allowMissingColumns=True)
    if kind == "union":
        return left.unionByName(right, allowMissingColumns=True).distinct()
    if kind == "intersect":
        return left.intersect(right.select(*left.columns))
    if kind == "except":
        # Keeps duplicate left rows, unlike EXCEPT [ALL]; nulls compare equal.
        shared = [c for c in left.columns if c in right.columns]
        return keyed_join(left, right.select(*shared).distinct(), shared, "left_anti")
    raise ValueError(f"unknown set operation: {kind}")


def preview_set_op(
    left: DataFrame, right: DataFrame, kind: str, rows: int | None = 5000, match_by_name: bool = True, seed: int = 42
) -> DataFrame:
    """The operation on a seeded random sample of at most `rows` rows of each side (None: all)."""

    def drawn(side: DataFrame) -> DataFrame:
        # Equal rows share the hash; a top-k by it is taken per task before the shuffle.
        return side if rows is None else side.orderBy(row_hash(side, seed)).limit(rows)

    return set_op(drawn(left), drawn(right), kind, match_by_name)
