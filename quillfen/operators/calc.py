"""Derived columns that need the whole table, a group, or the row order.

Each function adds column `name`.  Global values are computed in one aggregate
pass and enter as literals; group values are aggregated and joined back; ordered
columns use Ordered, so `order_by` must name a total order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfen.operators.correlation import average_rank, rank_positions
from quillfen.operators.keyed import group_values, keyed_join
from quillfen.operators.ordered import Ordered
from quillfen.operators.quantiles import quantiles
from quillfen.session import clock_micros, ratio, rounded, scalars

Names = Sequence[str]


def _lit(value) -> Column:
    return F.lit(value).cast("double")


def _number(column: str) -> Column:
    return F.col(column).cast("double")


# ---- global values -------------------------------------------------------------------


def contribution(df: DataFrame, value: str, name: str) -> DataFrame:
    total = scalars(df, s=F.sum(value))["s"]
    return df.withColumn(name, ratio(F.col(value), _lit(total)) * 100)


def z_score(df: DataFrame, value: str, name: str) -> DataFrame:
    s = scalars(df, m=F.avg(value), sd=F.stddev_samp(value))
    return df.withColumn(name, ratio(F.col(value) - _lit(s["m"]), _lit(s["sd"])))


def standardised(df: DataFrame, value: str, name: str) -> DataFrame:
    return z_score(df, value, name).withColumn(name, rounded(F.col(name), 3))


def min_max(df: DataFrame, value: str, name: str) -> DataFrame:
    s = scalars(df, low=F.min(value), high=F.max(value))
    return df.withColumn(name, ratio(F.col(value) - _lit(s["low"]), _lit(s["high"]) - _lit(s["low"])))


def max_normalised(df: DataFrame, value: str, name: str) -> DataFrame:
    return df.withColumn(name, ratio(F.col(value), _lit(scalars(df, m=F.max(value))["m"])))


def outlier_flag(df: DataFrame, value: str, name: str, limit: float = 3.0) -> DataFrame:
    s = scalars(df, m=F.avg(value), sd=F.stddev_samp(value))
    flag = F.abs(F.col(value) - _lit(s["m"])) > _lit(s["sd"]) * limit
    return df.withColumn(name, F.coalesce(flag, F.lit(False)))


def robust_z_score(df: DataFrame, value: str, name: str) -> DataFrame:
    """Distance from the median in mean absolute deviations (1 when there is no deviation)."""
    middle = quantiles(df, [value], [0.5])[value][0]
    mean = scalars(df, m=F.avg(value))["m"]
    mad = scalars(df, d=F.avg(F.abs(F.col(value) - _lit(mean))))["d"]
    return df.withColumn(name, (F.col(value) - _lit(middle)) / _lit(mad or 1.0))


def top_performer(df: DataFrame, value: str, name: str, probability: float = 0.8) -> DataFrame:
    edge = quantiles(df, [value], [probability])[value][0]
    return df.withColumn(name, F.coalesce(F.col(value) >= _lit(edge), F.lit(False)))


def bottom_performer(df: DataFrame, value: str, name: str, probability: float = 0.1) -> DataFrame:
    edge = quantiles(df, [value], [probability])[value][0]
    return df.withColumn(name, F.coalesce(F.col(value) <= _lit(edge), F.lit(False)))


def weighted_average(df: DataFrame, value: str, weight: str, name: str) -> DataFrame:
    s = scalars(df, a=F.sum(_number(value) * _number(weight)), w=F.sum(_number(weight)))
    return df.withColumn(name, ratio(_lit(s["a"]), _lit(s["w"])))


def geometric_mean(df: DataFrame, rate: str, name: str) -> DataFrame:
    mean = scalars(df, m=F.avg(F.ln(1 + _number(rate))))["m"]
    return df.withColumn(name, F.exp(_lit(mean)) - 1)


def sharpe_ratio(df: DataFrame, returns: str, name: str, periods: int = 252) -> DataFrame:
    s = scalars(df, m=F.avg(returns), sd=F.stddev_samp(returns))
    return df.withColumn(name, ratio(_lit(s["m"]), _lit(s["sd"])) * F.sqrt(F.lit(periods)))


def median_imputed(df: DataFrame, value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(_number(value), _lit(quantiles(df, [value], [0.5])[value][0])))


def winsorised(df: DataFrame, value: str, name: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    a, b = quantiles(df, [value], [low, high])[value]
    clipped = F.greatest(_lit(a), F.least(_lit(b), _number(value)))
    return df.withColumn(name, F.when(F.col(value).isNotNull(), clipped))


def percentile_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average-tie rank as a share of the non-null rows, in percent."""
    n = scalars(df, n=F.count(value))["n"]
    return average_rank(df, value, name).withColumn(name, F.col(name) / _lit(n) * 100)


# ---- group values ----------------------------------------------------------------------


def within_group_percentage(df: DataFrame, value: str, group: Names, name: str) -> DataFrame:
    out = group_values(df, group, _total=F.sum(value))
    return out.withColumn(name, rounded(ratio(F.col(value), F.col("_total")) * 100, 2)).drop("_total")


def group_average(df: DataFrame, value: str, group: Names, name: str) -> DataFrame:
    return group_values(df, group, **{name: F.avg(value)})


def group_deviation(df: DataFrame, value: str, group: Names, name: str) -> DataFrame:
    out = group_values(df, group, _mean=F.avg(value))
    return out.withColumn(name, F.col(value) - F.col("_mean")).drop("_mean")


def group_normalised(df: DataFrame, value: str, group: Names, name: str) -> DataFrame:
    out = group_values(df, group, _low=F.min(value), _high=F.max(value))
    return out.withColumn(name, ratio(F.col(value) - F.col("_low"), F.col("_high") - F.col("_low"))).drop("_low", "_high")


def seasonality_index(df: DataFrame, current: str, last_year: str, date: str, name: str) -> DataFrame:
    """Percent above last year's mean of the same calendar month."""
    out = group_values(df.withColumn("_month", F.month(date)), ["_month"], _mean=F.avg(last_year))
    return out.withColumn(name, (ratio(F.col(current), F.col("_mean")) - 1) * 100).drop("_month", "_mean")


def group_rank(df: DataFrame, value: str, group: Names, name: str) -> DataFrame:
    """Dense rank, largest first."""
    keys = list(group)
    places = rank_positions(df.dropna(subset=keys), value, keys, descending=True)
    return keyed_join(df, places.select(*keys, value, F.col("_dense").alias(name)), [*keys, value])


def group_top(df: DataFrame, value: str, group: Names, name: str, n: int = 3) -> DataFrame:
    ranked = average_rank(df, value, "_rank", list(group), descending=True)
    return ranked.withColumn(name, F.coalesce(F.col("_rank") <= n, F.lit(False))).drop("_rank")


# ---- ordered values ----------------------------------------------------------------------


def moving_average(df: DataFrame, value: str, name: str, order_by: Names, partition_by: Names = (), window: int = 3) -> DataFrame:
    back = window - 1
    return Ordered(df, order_by, partition_by).windowed({name: lambda w: F.avg(value).over(w.rowsBetween(-back, 0))}, back).result()


def rolling_sum(df: DataFrame, value: str, name: str, order_by: Names, partition_by: Names = (), window: int = 7) -> DataFrame:
    back = window - 1
    return Ordered(df, order_by, partition_by).windowed({name: lambda w: F.sum(value).over(w.rowsBetween(-back, 0))}, back).result()


def rolling_volatility(df: DataFrame, value: str, name: str, order_by: Names, partition_by: Names = (), window: int = 20) -> DataFrame:
    back = window - 1
    return Ordered(df, order_by, partition_by).windowed({name: lambda w: F.stddev_samp(value).over(w.rowsBetween(-back, 0))}, back).result()


def previous_value(df: DataFrame, value: str, name: str, order_by: Names, partition_by: Names = (), rows: int = 1) -> DataFrame:
    return Ordered(df, order_by, partition_by).windowed({name: lambda w: F.lag(value, rows).over(w)}, rows).result()


def next_value(df: DataFrame, value: str, name: str, order_by: Names, partition_by: Names = (), rows: int = 1) -> DataFrame:
    return Ordered(df, order_by, partition_by).windowed({name: lambda w: F.lead(value, rows).over(w)}, 0, rows).result()


def change(df: DataFrame, value: str, name: str, order_by: Names, partition_by: Names = ()) -> DataFrame:
    """Difference from the previous row."""
    return Ordered(df, order_by, partition_by).windowed({name: lambda w: F.col(value) - F.lag(value).over(w)}, 1).result()


def returns(df: DataFrame, value: str, name: str, order_by: Names, partition_by: Names = ()) -> DataFrame:
    """Percent change from the previous row; missing values count as the last known one."""
    known = Ordered(df, order_by, partition_by).last_valid({"_known": _number(value)})
    out = known.windowed({"_before": lambda w: F.lag("_known").over(w)}, 1).result()
    return out.withColumn(name, (ratio(F.col("_known"), F.col("_before")) - 1) * 100).drop("_known", "_before")


def cumulative_sum(df: DataFrame, value: str, name: str, order_by: Names, partition_by: Names = ()) -> DataFrame:
    out = Ordered(df, order_by, partition_by).running({name: F.col(value)}).result()
    return out.withColumn(name, F.when(F.col(value).isNotNull(), F.col(name)))


def sequence_number(df: DataFrame, name: str, order_by: Names, partition_by: Names = ()) -> DataFrame:
    return Ordered(df, order_by, partition_by).row_index(name).result()


def first_occurrence(df: DataFrame, keys: Names, name: str, order_by: Names) -> DataFrame:
    """True for the first row of each key."""
    return sequence_number(df, "_place", order_by, keys).withColumn(name, F.col("_place") == 1).drop("_place")


def days_since_previous(df: DataFrame, date: str, name: str, order_by: Names, partition_by: Names = ()) -> DataFrame:
    stamp = clock_micros(F.col(date))

    def gap(w):
        return F.floor((stamp - F.lag(stamp).over(w)) / F.lit(86_400_000_000)).cast("long")

    return Ordered(df, order_by, partition_by).windowed({name: gap}, 1).result()


def beta(df: DataFrame, own: str, market: str, name: str, order_by: Names, partition_by: Names = (), window: int = 60) -> DataFrame:
    """Rolling covariance with the market over the market's variance, once the window is full."""
    back = window - 1

    def coefficient(w):
        frame = w.rowsBetween(-back, 0)
        both = F.when(F.col(own).isNotNull() & F.col(market).isNotNull(), 1)
        full = (F.count(both).over(frame) >= window) & (F.count(market).over(frame) >= window)
        return F.when(full, F.try_divide(F.covar_samp(own, market).over(frame), F.var_samp(market).over(frame)))

    return Ordered(df, order_by, partition_by).windowed({name: coefficient}, back).result()


def rsi(df: DataFrame, price: str, name: str, order_by: Names, partition_by: Names = (), window: int = 14) -> DataFrame:
    """Relative strength index over `window` rows."""
    moves = Ordered(df, order_by, partition_by).windowed({"_move": lambda w: F.col(price) - F.lag(price).over(w)}, 1)
    gain = F.when(F.col("_move") > 0, F.col("_move")).otherwise(0.0)
    loss = F.when(F.col("_move") < 0, -F.col("_move")).otherwise(0.0)
    back = window - 1

    def index(w):
        frame = w.rowsBetween(-back, 0)
        up, down = F.avg(gain).over(frame), F.avg(loss).over(frame)
        value = F.when(down > 0, 100 - 100 / (1 + up / down)).when(up > 0, F.lit(100.0))
        return F.when(F.count(F.lit(1)).over(frame) >= window, value)

    return moves.windowed({name: index}, back).result().drop("_move")


def bollinger_position(df: DataFrame, price: str, name: str, order_by: Names, partition_by: Names = (), window: int = 20) -> DataFrame:
    back = window - 1

    def position(w):
        frame = w.rowsBetween(-back, 0)
        value = F.try_divide(F.col(price) - F.avg(price).over(frame), F.stddev_samp(price).over(frame) * 2)
        return F.when(F.count(price).over(frame) >= window, value)

    return Ordered(df, order_by, partition_by).windowed({name: position}, back).result()


def exponential_average(df: DataFrame, value: str, name: str, order_by: Names, partition_by: Names = (), span: int = 7) -> DataFrame:
    return Ordered(df, order_by, partition_by).ewm(value, name, span, adjust=False).result()


def exponential_volatility(df: DataFrame, value: str, name: str, order_by: Names, partition_by: Names = (), span: int = 20) -> DataFrame:
    return Ordered(df, order_by, partition_by).ewm(value, name, span, adjust=False, what="std").result()


def macd(df: DataFrame, price: str, name: str, order_by: Names, partition_by: Names = ()) -> DataFrame:
    fast = Ordered(df, order_by, partition_by).ewm(price, "_fast", 12, adjust=True)
    both = fast.ewm(price, "_slow", 26, adjust=True).result()
    return both.withColumn(name, F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
