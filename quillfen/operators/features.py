"""Feature engineering: date parts, numeric transforms, encodings, interactions, lags."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfen.operators.correlation import target_correlation
from quillfen.operators.ingest import date_columns, numeric_columns, text_columns
from quillfen.operators.keyed import keyed_join
from quillfen.operators.ordered import Ordered
from quillfen.operators.quantiles import cut_codes, quantiles
from quillfen.session import ratio, scalars


def date_parts(df: DataFrame, column: str) -> DataFrame:
    d = F.col(column)
    return df.withColumns(
        {
            f"{column}_year": F.year(d), f"{column}_month": F.month(d), f"{column}_day": F.day(d),
            f"{column}_dayofweek": F.weekday(d), f"{column}_dayofyear": F.dayofyear(d),
            f"{column}_week": F.weekofyear(d), f"{column}_quarter": F.quarter(d),
        }
    )


def date_flags(df: DataFrame, column: str) -> DataFrame:
    d = F.to_date(column)
    first, last = F.trunc(d, "month"), F.last_day(d)
    quarter_start, year_start = F.trunc(d, "quarter"), F.trunc(d, "year")
    flags = {
        "is_weekend": F.weekday(d) >= 5, "is_month_end": d == last, "is_month_start": d == first,
        "is_quarter_end": d == F.last_day(F.add_months(quarter_start, 2)), "is_quarter_start": d == quarter_start,
        "is_year_end": d == F.last_day(F.add_months(year_start, 11)), "is_year_start": d == year_start,
    }
    return df.withColumns({f"{column}_{n}": f.cast("int") for n, f in flags.items()})


def cyclic_parts(df: DataFrame, column: str) -> DataFrame:
    month, day = F.month(column) * (2 * math.pi / 12), F.weekday(column) * (2 * math.pi / 7)
    return df.withColumns(
        {
            f"{column}_month_sin": F.sin(month), f"{column}_month_cos": F.cos(month),
            f"{column}_dayofweek_sin": F.sin(day), f"{column}_dayofweek_cos": F.cos(day),
        }
    )


def numeric_transforms(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """log1p|x|, square root of |x|, square, cube and z-score; one pass for all means."""
    if not columns:
        return df
    stats = scalars(df, **{c: F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")) for c in columns})
    out = {}
    for c in columns:
        v = F.col(c).cast("double")
        out[f"{c}_log"], out[f"{c}_sqrt"] = F.log1p(F.abs(v)), F.sqrt(F.abs(v))
        out[f"{c}_squared"], out[f"{c}_cubed"] = v * v, v * v * v
        out[f"{c}_zscore"] = ratio(v - F.lit(stats[c]["m"]), F.lit(stats[c]["s"]))
    return df.withColumns(out)


def quantile_bins(df: DataFrame, columns: Sequence[str], bins: Sequence[int] = (5, 10)) -> DataFrame:
    """Quantile bin numbers on exact edges; repeated edges are merged."""
    if not columns:
        return df
    steps = sorted({i / b for b in bins for i in range(b + 1)})
    edges = quantiles(df, columns, steps)
    out = {}
    for c in columns:
        at = dict(zip(steps, edges[c]))
        for b in bins:
            cuts = [at[i / b] for i in range(b + 1) if at[i / b] is not None]
            out[f"{c}_bin_{b}"] = cut_codes(F.col(c).cast("double"), cuts)
    return df.withColumns(out)


_SMALL_CATEGORIES = 1000  # a table of so many categories is broadcast


def encode_category(df: DataFrame, column: str, target: str | None = None, low: int = 2, high: int | None = None) -> DataFrame:
    """Share of each category, and the target's mean, for columns of at least `low` (and, if given, at most `high`) values."""
    known = df.filter(F.col(column).isNotNull())
    groups = known.groupBy(column).agg(F.count(F.lit(1)).alias("_n"), *([F.avg(target).alias(f"{column}_target_mean")] if target else []))
    most = _SMALL_CATEGORIES if high is None else max(high, _SMALL_CATEGORIES)
    count = groups.limit(most + 1).count()
    if count < low or (high is not None and count > high):
        return df
    total = known.agg(F.count(F.lit(1))).scalar()
    table = groups.withColumn(f"{column}_freq", F.col("_n") / total).drop("_n")
    return keyed_join(df, table, [column], small=count <= _SMALL_CATEGORIES)


def interactions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Products and ratios of every pair of the columns."""
    out = {}
    for a, b in combinations(columns, 2):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        out[f"{a}_x_{b}"] = x * y
        out[f"{a}_div_{b}"] = ratio(x, y + 1e-10)
    return df.withColumns(out) if out else df


def lags(df: DataFrame, column: str, order_by: Sequence[str], steps: Sequence[int] = (1, 7, 30), partition_by: Sequence[str] = ()) -> DataFrame:
    columns = {f"{column}_lag_{k}": (lambda w, k=k: F.lag(column, k).over(w)) for k in steps}
    return Ordered(df, order_by, partition_by).windowed(columns, max(steps)).result()


class Features(NamedTuple):
    data: DataFrame
    importance: DataFrame | None


def engineer(
    df: DataFrame, target: str | None = None, exclude: Sequence[str] = (), order_by: Sequence[str] = ()
) -> Features:
    """All feature families over the usable columns of a table."""
    dates = [c for c in date_columns(df) if c not in exclude]
    numbers = [c for c in numeric_columns(df) if c not in exclude]
    texts = [c for c in text_columns(df) if c not in exclude]
    out = df
    for c in dates:
        out = cyclic_parts(date_flags(date_parts(out, c), c), c)
    out = quantile_bins(numeric_transforms(out, numbers), numbers)
    for c in texts:
        out = encode_category(out, c, target)
    out = interactions(out, numbers)
    if dates and numbers and order_by:
        out = lags(out, numbers[0], [dates[0], *[c for c in order_by if c != dates[0]]])
    importance = target_correlation(out, numeric_columns(out), target) if target else None
    return Features(out, importance)
