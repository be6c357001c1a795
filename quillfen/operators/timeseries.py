"""Time buckets, moving averages, trends and seasonal decomposition."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfen.operators.charts import grouped
from quillfen.operators.ingest import NUMERIC, TEMPORAL, parse_timestamp
from quillfen.operators.keyed import keyed_join
from quillfen.operators.ordered import Ordered
from quillfen.session import clock_micros, scalars

UNITS = {
    "daily": "D", "weekly": "W", "monthly": "M", "quarterly": "Q", "yearly": "Y",
    "day": "D", "week": "W", "month": "M", "quarter": "Q", "year": "Y",
}
_SUNDAY = 3  # 1970-01-04 was a Sunday


def unit_of(name: str) -> str:
    unit = UNITS.get(name, name)
    if unit not in "DWMQY":
        raise ValueError(f"unknown time unit: {name}")
    return unit


def period_number(column: Column, unit: str) -> Column:
    """Consecutive number of the day, Monday-to-Sunday week, month, quarter or year."""
    date = F.to_date(column)
    if unit == "D":
        return F.unix_date(date)
    if unit == "W":
        return F.floor((F.unix_date(date) - (_SUNDAY - 6)) / 7).cast("int")
    if unit == "M":
        return F.year(date) * 12 + F.month(date) - 1
    if unit == "Q":
        return F.year(date) * 4 + F.quarter(date) - 1
    return F.year(date)


def period_start(number: Column, unit: str) -> Column:
    if unit == "D":
        return F.date_from_unix_date(number.cast("int"))
    if unit == "W":
        return F.date_from_unix_date((number * 7 + (_SUNDAY - 6)).cast("int"))
    if unit == "M":
        return F.make_date(F.floor(number / 12).cast("int"), (F.pmod(number, F.lit(12)) + 1).cast("int"), F.lit(1))
    if unit == "Q":
        return F.make_date(F.floor(number / 4).cast("int"), (F.pmod(number, F.lit(4)) * 3 + 1).cast("int"), F.lit(1))
    return F.make_date(number.cast("int"), F.lit(1), F.lit(1))


def period_end(number: Column, unit: str) -> Column:
    """Label of a bucket: the day, its Sunday, or the last day of the period."""
    return F.date_sub(period_start(number + 1, unit), 1)


def parsed_dates(df: DataFrame, column: str) -> DataFrame:
    """Text dates parsed; rows without a valid date are dropped."""
    if not isinstance(df.schema[column].dataType, TEMPORAL):
        df = df.withColumn(column, parse_timestamp(F.col(column)))
    return df.dropna(subset=[column])


def time_buckets(
    df: DataFrame, date: str, values: Sequence[str], unit: str, function: str = "mean",
    group: str | None = None, order_by: str | None = None,
) -> DataFrame:
    """Aggregate per bucket; empty buckets inside a series are kept (0 for sum and count)."""
    unit = unit_of(unit)
    keys = [group] if group else []
    rows = parsed_dates(df, date).withColumn("_period", period_number(F.col(date), unit))
    table = grouped(rows, [*keys, "_period"], {v: (v, function) for v in values}, order_by)
    if function in ("sum", "count"):
        table = table.fillna(0, subset=list(values))
    span = table.groupBy(*keys).agg(F.min("_period").alias("_lo"), F.max("_period").alias("_hi"))
    every = span.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("_period"))
    filled = keyed_join(every, table, [*keys, "_period"])
    if function in ("sum", "count"):
        filled = filled.fillna(0, subset=list(values))
    return filled.select(*keys, period_end(F.col("_period"), unit).alias(date), *values)


def invalid_dates(df: DataFrame, date: str) -> DataFrame:
    """How many values are not dates."""
    bad = F.col(date).isNull() | parse_timestamp(F.col(date)).isNull()
    return df.agg(F.count_if(bad).alias("invalid"), F.count(F.lit(1)).alias("rows"))


def series_points(df: DataFrame, values: Sequence[str], group: str | None = None, minimum: int = 2) -> DataFrame:
    """Points per series and whether there are enough to draw it."""
    keys = [group] if group else []
    rows = df.dropna(subset=keys) if keys else df
    counts = rows.groupBy(*keys).agg(*[F.count(v).alias(v) for v in values])
    long = counts.unpivot(keys, list(values), "metric", "points")
    return long.withColumn("kept", F.col("points") >= minimum)


def axis_type(df: DataFrame, column: str) -> str:
    data_type = df.schema[column].dataType
    if isinstance(data_type, TEMPORAL):
        return "datetime"
    if isinstance(data_type, NUMERIC):
        row = scalars(df, n=F.count(F.lit(1)), d=F.countDistinct(column))
        return "category" if row["d"] < 20 and row["d"] < 0.3 * row["n"] else "linear"
    return "category" if isinstance(data_type, T.StringType) else "linear"


def moving_averages(df: DataFrame, date: str, value: str, tie_break: Sequence[str] = ()) -> DataFrame:
    """Centred row averages over 7 and 30 points."""
    rows = df.select(date, value, *tie_break).dropna(subset=[date, value])
    frames = {"ma7": (-3, 3), "ma30": (-15, 14)}
    columns = {n: (lambda w, f=f: F.avg(value).over(w.rowsBetween(*f))) for n, f in frames.items()}
    return Ordered(rows, [date, *tie_break]).windowed(columns, 15, 14).result()


def trend_direction(df: DataFrame, date: str, value: str) -> DataFrame:
    """Sign of the least-squares slope of value over time; needs ten points."""
    days = clock_micros(F.col(date)) / 86_400e6
    out = df.dropna(subset=[date, value]).agg(
        F.count(F.lit(1)).alias("points"), F.regr_slope(F.col(value), days).alias("slope_per_day")
    )
    sign = F.when(F.col("slope_per_day") > 0, "upward").when(F.col("slope_per_day") < 0, "downward").otherwise("flat")
    return out.withColumn("trend", F.when(F.col("points") >= 10, sign))


def detect_frequency(df: DataFrame, date: str) -> str | None:
    """D, W, M, Q or Y from the most frequent step between successive dates."""
    stamps = df.select(clock_micros(F.col(date)).alias("_t")).dropna()
    steps = Ordered(stamps, ["_t"]).windowed({"_p": lambda w: F.lag("_t").over(w)}, 1).result()
    top = (
        steps.select((F.col("_t") - F.col("_p")).alias("step")).dropna().groupBy("step")
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "step").first()
    )
    if top is None:
        return None
    days = top["step"] // 86_400_000_000
    if days in (1, 7):
        return {1: "D", 7: "W"}[days]
    for unit, low, high in (("M", 28, 31), ("Q", 89, 92), ("Y", 365, 366)):
        if low <= days <= high:
            return unit
    return None


def regularise(df: DataFrame, date: str, value: str, unit: str) -> DataFrame:
    """One mean per period without gaps, missing periods take the last known mean."""
    unit = unit_of(unit)
    table = time_buckets(df.dropna(subset=[date, value]), date, [value], unit, "mean")
    number = table.withColumn("_period", period_number(F.col(date), unit))
    filled = Ordered(number, ["_period"]).last_valid({"observed": F.col(value)}).result()
    label = F.col(date) if unit == "W" else period_start(F.col("_period"), unit)
    return filled.select("_period", label.alias(date), "observed")


class Decomposition(NamedTuple):
    components: DataFrame
    period: int


_PERIODS = {"D": 7, "W": 52, "M": 12, "Q": 4, "Y": 1}


def decompose(
    df: DataFrame, date: str, value: str, frequency: str = "auto", model: str = "additive"
) -> Decomposition:
    """Classical decomposition into trend, seasonal and residual parts."""
    unit = detect_frequency(df, date) if frequency == "auto" else unit_of(frequency)
    if unit is None:
        raise ValueError("no regular frequency found: pass one")
    series = regularise(df, date, value, unit)
    bounds = scalars(series, n=F.count(F.lit(1)), first=F.min("_period"))
    n = bounds["n"]
    if n < 4:
        raise ValueError("too few periods to decompose")
    m = _PERIODS[unit]
    if n < 2 * m:
        m = n // 2
    half = m // 2
    series = series.withColumn("_t", F.col("_period") - F.lit(bounds["first"]))

    def moving(w):
        if m % 2:
            return F.avg("observed").over(w.rowsBetween(-half, half))
        ends = F.lag("observed", half).over(w) + F.lead("observed", half).over(w)
        return (F.sum("observed").over(w.rowsBetween(-half, half)) - ends / 2) / m

    front, back = half, n - 1 - half
    full = F.col("_t").between(front, back)
    smooth = Ordered(series, ["_t"]).windowed({"_ma": moving}, half, half).result()
    smooth = smooth.withColumn("_ma", F.when(full, F.col("_ma")))
    if half:
        head = F.col("_t").between(front, min(front + m, back) - 1)
        tail = F.col("_t").between(max(front, back - m), back - 1)
        fits = {}
        for end, part in (("head", head), ("tail", tail)):
            y, x = F.when(part, F.col("_ma")), F.when(part, F.col("_t"))
            fits[f"{end}_slope"], fits[f"{end}_base"] = F.regr_slope(y, x), F.regr_intercept(y, x)
        line = scalars(smooth, **fits)
        guess = F.when(
            F.col("_t") < front, F.lit(line["head_base"]) + F.lit(line["head_slope"]) * F.col("_t")
        ).when(F.col("_t") > back, F.lit(line["tail_base"]) + F.lit(line["tail_slope"]) * F.col("_t"))
        smooth = smooth.withColumn("trend", F.coalesce(F.col("_ma"), guess))
    else:
        smooth = smooth.withColumn("trend", F.col("_ma"))
    additive = model == "additive"
    detrended = F.col("observed") - F.col("trend") if additive else F.try_divide("observed", "trend")
    phased = smooth.withColumns({"_phase": F.col("_t") % m, "_detrended": detrended})
    # One row per phase: at most 52, or half of a short series.
    phases = phased.groupBy("_phase").agg(F.avg("_detrended").alias("_mean"))
    level = phases.agg(F.avg("_mean")).scalar()
    centred = F.col("_mean") - level if additive else F.try_divide(F.col("_mean"), level)
    joined = keyed_join(phased, phases.select("_phase", centred.alias("seasonal")), ["_phase"], small=True)
    rest = (
        F.col("observed") - F.col("trend") - F.col("seasonal")
        if additive
        else F.try_divide(F.try_divide(F.col("observed"), F.col("seasonal")), F.col("trend"))
    )
    return Decomposition(joined.select(date, "observed", "trend", "seasonal", rest.alias("residual")), m)


def decomposition_strength(components: DataFrame) -> DataFrame:
    """Trend and seasonal strength and the share of variance explained."""
    resid = F.var_samp("residual")
    return components.agg(
        (1 - resid / F.var_samp(F.col("trend") + F.col("residual"))).alias("trend_strength"),
        (1 - resid / F.var_samp(F.col("seasonal") + F.col("residual"))).alias("seasonality_strength"),
        (1 - resid / F.var_samp("observed")).alias("variance_explained"),
    )


def residual_outliers(components: DataFrame, deviations: float = 2.0) -> DataFrame:
    row = scalars(components, mean=F.avg("residual"), sd=F.stddev_samp("residual"))
    return components.filter(F.abs(F.col("residual") - F.lit(row["mean"])) > F.lit(deviations * (row["sd"] or 0.0)))


def _indexed(df: DataFrame, order: Sequence[str], value: str) -> tuple[DataFrame, int]:
    rows = df.select(*order, F.col(value).cast("double").alias("_y")).dropna()
    indexed = Ordered(rows, list(order)).row_index("_i").result()
    return indexed, scalars(rows, n=F.count(F.lit(1)))["n"]


def quartile_change(df: DataFrame, order: Sequence[str], value: str) -> DataFrame:
    """Relative change from the mean of the first to the mean of the last quarter of the rows."""
    indexed, n = _indexed(df, order, value)
    k = max(3, n // 4)
    out = indexed.agg(
        F.avg(F.when(F.col("_i") <= k, F.col("_y"))).alias("first_mean"),
        F.avg(F.when(F.col("_i") > n - k, F.col("_y"))).alias("last_mean"),
    )
    change = F.try_divide(F.col("last_mean") - F.col("first_mean"), F.abs("first_mean"))
    return out.withColumn("change", F.when(F.lit(n >= 4), change))


def golden_period(df: DataFrame, order: Sequence[str], value: str, min_ratio: float = 1.5) -> DataFrame:
    """Best contiguous window of a quarter of the rows, from differences of running totals."""
    indexed, n = _indexed(df, order, value)
    w = max(3, n // 4)
    totals = Ordered(indexed, ["_i"]).running({"_s": F.col("_y")}).result()
    start = totals.select((F.col("_i") + w).alias("_end"), F.col("_s").alias("_before"))
    ends = totals.select(F.col("_i").alias("_end"), "_s").filter(F.col("_end") >= w)
    windows = keyed_join(ends, start, ["_end"]).select(
        ((F.col("_s") - F.coalesce("_before", F.lit(0.0))) / w).alias("_mean")
    )
    best = windows.agg(F.max("_mean").alias("best_mean"), F.lit(w).alias("window"))
    overall = indexed.agg(F.avg("_y")).scalar()
    out = best.withColumn("overall_mean", overall)
    ratio = F.when(F.col("overall_mean") > 0, F.col("best_mean") / F.col("overall_mean"))
    return out.withColumn("ratio", ratio).withColumn(
        "golden", F.lit(n >= 8) & F.coalesce(F.col("ratio") > min_ratio, F.lit(False))
    )


def slope_trend(df: DataFrame, order: Sequence[str], value: str, threshold: float = 0.1) -> DataFrame:
    """Least-squares slope per row relative to the absolute mean."""
    indexed, _ = _indexed(df, order, value)
    out = indexed.agg(F.regr_slope("_y", F.col("_i").cast("double")).alias("slope"), F.avg("_y").alias("mean"))
    out = out.withColumn("normalised_slope", F.try_divide("slope", F.abs("mean")))
    return out.withColumn("significant", F.abs("normalised_slope") > threshold)


def monthly_volatility(df: DataFrame, date: str, value: str, threshold: float = 1.0) -> DataFrame:
    """Coefficient of variation of the monthly means; needs 12 points and 3 months."""
    rows = df.select(date, value).dropna()
    months = rows.groupBy(F.trunc(date, "month").alias("month")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    out = months.agg(
        F.count(F.lit(1)).alias("months"), F.sum("n").alias("points"),
        F.try_divide(F.stddev_samp("mean"), F.avg("mean")).alias("volatility"),
    )
    enough = (F.col("months") >= 3) & (F.col("points") >= 12)
    return out.withColumn("high", enough & (F.col("volatility") > threshold))
