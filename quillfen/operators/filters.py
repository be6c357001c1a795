"""Predicates, their combination and the filtered view."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfen.operators.quantiles import quantiles
from quillfen.session import scalars


def _text_mask(column: Column, spec: dict) -> Column:
    text, search = column.cast("string"), spec.get("search", "")
    sensitive = spec.get("case_sensitive", False)
    if spec.get("use_regex"):
        pattern = spec.get("pattern", search)
        try:
            re.compile(pattern)
        except re.error:
            pass
        else:
            return text.rlike(pattern if sensitive else f"(?i){pattern}")
    return text.contains(search) if sensitive else F.lower(text).contains(search.lower())


def mask(name: str, spec: dict) -> Column:
    """One predicate; the result is null where the column is null."""
    column, kind = F.col(name), spec.get("type")
    if kind == "range":
        return column.between(F.lit(spec["min"]), F.lit(spec["max"]))
    if kind == "date_range":
        return column.between(F.lit(spec["start"]), F.lit(spec["end"]))
    if kind == "gt":
        return column > F.lit(spec["value"])
    if kind == "lt":
        return column < F.lit(spec["value"])
    if kind == "categorical":
        return column.isin(list(spec["values"]))
    if kind == "text":
        return _text_mask(column, spec)
    if kind == "or":
        parts = [mask(name, part) for part in spec.get("conditions", [])]
        return reduce(lambda a, b: a | b, parts, F.lit(False))
    return F.lit(True)


def predicate(df: DataFrame, state: dict) -> Column:
    """The whole filter state as one condition, so that it reaches the scan."""
    filters = {c: s for c, s in state.get("filters", {}).items() if c in df.columns}
    nulls = state.get("null_handling", {})

    def kept(name: str) -> Column:
        how = nulls.get(name, "exclude")
        spec = filters[name]
        if how == "include" or (how == "separate" and spec.get("type") == "categorical"):
            return mask(name, spec) | F.col(name).isNull()
        return mask(name, spec)

    if not filters:
        return F.lit(True)
    if state.get("logic_mode", "AND") == "AND":
        return reduce(lambda a, b: a & b, [kept(c) for c in filters])
    groups = state.get("logic_groups")
    if groups:
        ands = [
            reduce(lambda a, b: a & b, [mask(c, filters[c]) for c in g if c in filters], F.lit(True))
            for g in groups
        ]
        return reduce(lambda a, b: a | b, ands)
    return reduce(lambda a, b: a | b, [mask(c, s) for c, s in filters.items()])


def apply_filters(df: DataFrame, state: dict) -> DataFrame:
    return df.filter(predicate(df, state))


def date_preset(preset: str, as_of: dt.datetime) -> dict:
    """Range spec of a named period that ends at `as_of`."""
    days = {"last_7_days": 7, "last_30_days": 30, "last_90_days": 90}
    if preset in days:
        return {"type": "date_range", "start": as_of - dt.timedelta(days=days[preset]), "end": as_of}
    if preset == "year_to_date":
        return {"type": "date_range", "start": dt.datetime(as_of.year, 1, 1), "end": as_of}
    if preset == "last_year":
        year = as_of.year - 1
        return {"type": "date_range", "start": dt.datetime(year, 1, 1), "end": dt.datetime(year, 12, 31)}
    raise ValueError(f"unknown preset: {preset}")


def iqr_bounds(df: DataFrame, column: str, factor: float = 1.5) -> tuple[float, float]:
    q1, q3 = quantiles(df, [column], [0.25, 0.75])[column]
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)


def outlier_filter(df: DataFrame, column: str, keep_only: bool = False) -> dict:
    """Spec that drops IQR outliers, or keeps nothing else."""
    low, high = iqr_bounds(df, column)
    if keep_only:
        return {"type": "or", "conditions": [{"type": "lt", "value": low}, {"type": "gt", "value": high}]}
    return {"type": "range", "min": low, "max": high}


def filter_impact(df: DataFrame, state: dict) -> DataFrame:
    """Rows before and after, counted in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(F.coalesce(predicate(df, state), F.lit(False))).alias("rows_after"),
    ).withColumn(
        "kept_percent", F.try_divide(F.col("rows_after") * F.lit(100.0), F.col("rows_before"))
    )


def view(
    df: DataFrame, columns: list[str] | None = None, sort_by: str | None = None,
    descending: bool = False, limit: int = 500, tie_break: tuple[str, ...] = (),
) -> DataFrame:
    """Projected, sorted head of a table."""
    out = df
    if sort_by:
        first = F.col(sort_by).desc() if descending else F.col(sort_by).asc()
        out = out.orderBy(first, *tie_break)
    out = out.limit(limit)
    return out.select(*columns) if columns else out


def kept_share(df: DataFrame, state: dict) -> float | None:
    row = scalars(filter_impact(df, state), share=F.max("kept_percent"))
    return row["share"]
