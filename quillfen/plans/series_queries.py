"""Queries of time series and cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfen.operators import cohorts as co
from quillfen.operators import timeseries as ts
from quillfen.plans.registry import Tables, day, moment, query, rnd, sql_day, sql_moment, sql_rnd

# Calendar steps, first day and label of each bucket unit.
STARTS = {
    "D": ("date_trunc('day', {c})", "INTERVAL 1 DAY", "s"),
    "W": ("date_trunc('week', {c})", "INTERVAL 7 DAY", "s + INTERVAL 6 DAY"),
    "M": ("date_trunc('month', {c})", "INTERVAL 1 MONTH", "s + INTERVAL 1 MONTH - INTERVAL 1 DAY"),
    "Q": ("date_trunc('quarter', {c})", "INTERVAL 3 MONTH", "s + INTERVAL 3 MONTH - INTERVAL 1 DAY"),
    "Y": ("date_trunc('year', {c})", "INTERVAL 1 YEAR", "s + INTERVAL 1 YEAR - INTERVAL 1 DAY"),
}


def bucket_sql(unit: str, table: str, date: str, aggregate: str, empty: str, digits: int, key: str = "'all'") -> str:
    start, step, label = STARTS[unit]
    return f"""WITH b AS (SELECT {key} AS g, {start.format(c=date)}::TIMESTAMP AS s, {aggregate} AS v FROM {table} GROUP BY 1, 2),
      e AS (SELECT g, unnest(generate_series(MIN(s), MAX(s), {step})) AS s FROM b GROUP BY g)
      SELECT e.g, strftime({label.replace('s ', 'e.s ', 1) if ' ' in label else 'e.s'}, '%Y-%m-%d') AS bucket,
      {sql_rnd(f'COALESCE(v, {empty})', digits)} AS value FROM e LEFT JOIN b ON e.g = b.g AND e.s = b.s"""


def bucketed(df, date, value, unit, function, digits, group=None):
    out = ts.time_buckets(df, date, [value], unit, function, group)
    key = F.col(group) if group else F.lit("all")
    return out.select(key.alias("g"), day(date).alias("bucket"), rnd(value, digits).alias("value"))


SOME = "(SELECT * FROM orders WHERE o_custkey % 97 = 5)"
for _unit, _function, _sql, _empty in (
    ("daily", "sum", "SUM(o_totalprice)", "0"), ("weekly", "mean", "AVG(o_totalprice)", "NULL"),
    ("monthly", "median", "MEDIAN(o_totalprice)", "NULL"), ("quarterly", "max", "MAX(o_totalprice)", "NULL"),
    ("yearly", "count", "COUNT(o_totalprice)", "0"), ("weekly", "min", "MIN(o_totalprice)", "NULL"),
):

    @query(f"ts1_buckets_{_unit}_{_function}", bucket_sql(ts.UNITS[_unit], "orders", "o_orderdate", _sql, _empty, 2))
    def _(t: Tables, unit=_unit, function=_function):
        return bucketed(t.orders, "o_orderdate", "o_totalprice", unit, function, 2)


@query(
    "ts1_gaps_are_kept",
    bucket_sql("D", "(SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000)", "o_orderdate", "SUM(o_totalprice)", "0", 2),
)
def _(t: Tables):
    few = t.orders.filter("o_orderpriority = '1-URGENT' AND o_totalprice > 450000")
    return bucketed(few, "o_orderdate", "o_totalprice", "daily", "sum", 2)


@query("ts1_invalid_dates", "SELECT COUNT(*) FILTER (WHERE o_orderkey % 4 = 0) AS invalid, COUNT(*) AS rows FROM orders")
def _(t: Tables):
    text = F.when(F.col("o_orderkey") % 4 == 0, "soon").otherwise(moment("o_orderdate"))
    return ts.invalid_dates(t.orders.select(text.alias("d")), "d")


@query(
    "ts2_grouped_buckets",
    bucket_sql("D", "events", "ts", "AVG(value)", "NULL", 4, "event_type"),
)
def _(t: Tables):
    return bucketed(t.events, "ts", "value", "daily", "mean", 4, "event_type")


@query(
    "ts3_series_points",
    "SELECT user_id, 'value' AS metric, COUNT(NULLIF(event_type, 'error')) AS points, COUNT(NULLIF(event_type, 'error')) >= 50 AS kept FROM events GROUP BY 1",
)
def _(t: Tables):
    e = t.events.select("user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return ts.series_points(e, ["value"], "user_id", 50)


@query(
    "ts4_axis_type",
    "SELECT * FROM (VALUES ('l_linenumber', 'category'), ('l_extendedprice', 'linear'), ('l_shipdate', 'datetime'), ('l_returnflag', 'category')) v(name, axis)",
)
def _(t: Tables):
    names = ("l_linenumber", "l_extendedprice", "l_shipdate", "l_returnflag")
    return t.spark.createDataFrame([(n, ts.axis_type(t.lineitem, n)) for n in names], "name string, axis string")


@query(
    "ts5_moving_averages",
    f"""SELECT event_id, {sql_rnd('AVG(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)')} AS ma7,
        {sql_rnd('AVG(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)')} AS ma30 FROM events""",
)
def _(t: Tables):
    out = ts.moving_averages(t.events, "ts", "value", ["event_id"])
    return out.select("event_id", rnd("ma7").alias("ma7"), rnd("ma30").alias("ma30"))


@query(
    "ts6_trend_direction",
    f"""SELECT COUNT(*) AS points, {sql_rnd("regr_slope(o_totalprice, epoch_us(o_orderdate) / 86400e6)", 5)} AS slope_per_day,
        CASE WHEN regr_slope(o_totalprice, epoch_us(o_orderdate) / 86400e6) > 0 THEN 'upward' ELSE 'downward' END AS trend FROM orders""",
)
def _(t: Tables):
    out = ts.trend_direction(t.orders, "o_orderdate", "o_totalprice")
    return out.withColumn("slope_per_day", rnd("slope_per_day", 5))


@query("ts7_frequency", "SELECT 'D' AS daily, 'M' AS monthly")
def _(t: Tables):
    days = t.orders.select("o_orderdate").distinct()
    months = t.orders.select(F.trunc("o_orderdate", "month").alias("d")).distinct()
    found = (ts.detect_frequency(days, "o_orderdate"), ts.detect_frequency(months, "d"))
    return t.spark.createDataFrame([found], "daily string, monthly string")


_FEW = "(SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000)"


@query(
    "ts8_regularise",
    f"""WITH b AS (SELECT o_orderdate::TIMESTAMP AS s, AVG(o_totalprice) AS v FROM {_FEW} GROUP BY 1),
        e AS (SELECT unnest(generate_series(MIN(s), MAX(s), INTERVAL 1 DAY)) AS s FROM b)
        SELECT {sql_day('e.s')} AS bucket, {sql_rnd('LAST_VALUE(v IGNORE NULLS) OVER (ORDER BY e.s)', 2)} AS observed FROM e LEFT JOIN b USING (s)""",
)
def _(t: Tables):
    few = t.orders.filter("o_orderpriority = '1-URGENT' AND o_totalprice > 450000")
    out = ts.regularise(few, "o_orderdate", "o_totalprice", "D")
    return out.select(day("o_orderdate").alias("bucket"), rnd("observed", 2).alias("observed"))


def decomposition_sql(additive: bool) -> str:
    op, level = ("-", "AVG(m)") if additive else ("/", "AVG(m)")
    return f"""o AS (SELECT date_trunc('month', o_orderdate) AS s, AVG(o_totalprice) AS x FROM orders GROUP BY 1),
      a AS (SELECT s, x, ROW_NUMBER() OVER (ORDER BY s) - 1 AS t, COUNT(*) OVER () AS n FROM o),
      b AS (SELECT *, CASE WHEN t BETWEEN 6 AND n - 7 THEN (SUM(x) OVER (ORDER BY t ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)
            - (LAG(x, 6) OVER (ORDER BY t) + LEAD(x, 6) OVER (ORDER BY t)) / 2) / 12 END AS ma FROM a),
      h AS (SELECT regr_slope(ma, t) AS k, regr_intercept(ma, t) AS c FROM b WHERE t BETWEEN 6 AND 17),
      g AS (SELECT regr_slope(ma, t) AS k, regr_intercept(ma, t) AS c FROM b WHERE t BETWEEN n - 7 - 12 AND n - 8),
      c AS (SELECT b.s, b.x, b.t, COALESCE(ma, CASE WHEN t < 6 THEN h.c + h.k * t ELSE g.c + g.k * t END) AS trend FROM b, h, g),
      p AS (SELECT t % 12 AS f, AVG(x {op} trend) AS m FROM c GROUP BY 1),
      q AS (SELECT f, m {op} (SELECT {level} FROM p) AS seasonal FROM p),
      d AS (SELECT s, x AS observed, trend, seasonal, x {op} trend {op} seasonal AS residual FROM c JOIN q ON c.t % 12 = q.f)"""


@query(
    "ts9_decompose_additive",
    "WITH " + decomposition_sql(True) + f""" SELECT {sql_day('s')} AS month, {sql_rnd('observed', 3)} AS observed, {sql_rnd('trend', 3)} AS trend,
        {sql_rnd('seasonal', 3)} AS seasonal, {sql_rnd('residual', 3)} AS residual FROM d""",
)
def _(t: Tables):
    out = ts.decompose(t.orders, "o_orderdate", "o_totalprice", "M").components
    return out.select(
        day("o_orderdate").alias("month"), *[rnd(c, 3).alias(c) for c in ("observed", "trend", "seasonal", "residual")]
    )


@query(
    "ts9_decompose_multiplicative",
    "WITH " + decomposition_sql(False) + f""" SELECT {sql_day('s')} AS month, {sql_rnd('observed', 3)} AS observed, {sql_rnd('trend', 3)} AS trend,
        {sql_rnd('seasonal', 6)} AS seasonal, {sql_rnd('residual', 6)} AS residual FROM d""",
)
def _(t: Tables):
    out = ts.decompose(t.orders, "o_orderdate", "o_totalprice", "M", "multiplicative").components
    return out.select(
        day("o_orderdate").alias("month"), rnd("observed", 3).alias("observed"), rnd("trend", 3).alias("trend"),
        rnd("seasonal", 6).alias("seasonal"), rnd("residual", 6).alias("residual"),
    )


@query(
    "ts10_strength",
    "WITH " + decomposition_sql(True) + f""" SELECT {sql_rnd('1 - VAR_SAMP(residual) / VAR_SAMP(trend + residual)', 6)} AS trend_strength,
        {sql_rnd('1 - VAR_SAMP(residual) / VAR_SAMP(seasonal + residual)', 6)} AS seasonality_strength,
        {sql_rnd('1 - VAR_SAMP(residual) / VAR_SAMP(observed)', 6)} AS variance_explained FROM d""",
)
def _(t: Tables):
    out = ts.decomposition_strength(ts.decompose(t.orders, "o_orderdate", "o_totalprice", "M").components)
    return out.select(*[rnd(c, 6).alias(c) for c in out.columns])


@query(
    "ts11_residual_outliers",
    "WITH " + decomposition_sql(True) + f""", r AS (SELECT AVG(residual) m, STDDEV_SAMP(residual) sd FROM d)
        SELECT {sql_day('s')} AS month, {sql_rnd('residual', 3)} AS residual FROM d, r WHERE ABS(residual - m) > 2 * sd""",
)
def _(t: Tables):
    out = ts.residual_outliers(ts.decompose(t.orders, "o_orderdate", "o_totalprice", "M").components)
    return out.select(day("o_orderdate").alias("month"), rnd("residual", 3).alias("residual"))


_ROWS = "(SELECT value, ROW_NUMBER() OVER (ORDER BY ts, event_id) AS i, COUNT(*) OVER () AS n FROM events)"


@query(
    "ts12_quartile_change",
    f"""WITH q AS (SELECT AVG(value) FILTER (WHERE i <= n // 4) AS a, AVG(value) FILTER (WHERE i > n - n // 4) AS b FROM {_ROWS})
        SELECT {sql_rnd('a')} AS first_mean, {sql_rnd('b')} AS last_mean, {sql_rnd('(b - a) / ABS(a)', 6)} AS change FROM q""",
)
def _(t: Tables):
    out = ts.quartile_change(t.events, ["ts", "event_id"], "value")
    return out.select(rnd("first_mean").alias("first_mean"), rnd("last_mean").alias("last_mean"), rnd("change", 6).alias("change"))


@query(
    "ts13_golden_period",
    f"""WITH s AS (SELECT i, n, SUM(value) OVER (ORDER BY i) AS s FROM {_ROWS}),
        w AS (SELECT (b.s - COALESCE(a.s, 0)) / (b.n // 4) AS m, b.n // 4 AS w FROM s b LEFT JOIN s a ON a.i = b.i - b.n // 4 WHERE b.i >= b.n // 4)
        SELECT {sql_rnd('MAX(m)')} AS best_mean, CAST(MAX(w) AS INTEGER) AS window, {sql_rnd('(SELECT AVG(value) FROM events)')} AS overall_mean,
        {sql_rnd('MAX(m) / (SELECT AVG(value) FROM events)', 6)} AS ratio, MAX(m) / (SELECT AVG(value) FROM events) > 1.5 AS golden FROM w""",
)
def _(t: Tables):
    out = ts.golden_period(t.events, ["ts", "event_id"], "value")
    return out.withColumns({"best_mean": rnd("best_mean"), "overall_mean": rnd("overall_mean"), "ratio": rnd("ratio", 6)})


@query(
    "ts14_slope_trend",
    f"""SELECT {sql_rnd('1e6 * regr_slope(value, i)', 3)} AS slope, {sql_rnd('AVG(value)')} AS mean,
        {sql_rnd('1e6 * regr_slope(value, i) / ABS(AVG(value))', 3)} AS normalised_slope, ABS(regr_slope(value, i) / ABS(AVG(value))) > 0.1 AS significant FROM {_ROWS}""",
)
def _(t: Tables):
    out = ts.slope_trend(t.events, ["ts", "event_id"], "value")
    return out.withColumns(
        {"slope": rnd(F.col("slope") * 1e6, 3), "mean": rnd("mean"), "normalised_slope": rnd(F.col("normalised_slope") * 1e6, 3)}
    )


@query(
    "ts15_monthly_volatility",
    f"""WITH m AS (SELECT date_trunc('month', o_orderdate) AS s, AVG(o_totalprice) AS v, COUNT(*) AS n FROM orders GROUP BY 1)
        SELECT COUNT(*) AS months, CAST(SUM(n) AS BIGINT) AS points, {sql_rnd('STDDEV_SAMP(v) / AVG(v)', 6)} AS volatility,
        STDDEV_SAMP(v) / AVG(v) > 1.0 AS high FROM m""",
)
def _(t: Tables):
    return ts.monthly_volatility(t.orders, "o_orderdate", "o_totalprice").withColumn("volatility", rnd("volatility", 6))


# ---- cohorts -------------------------------------------------------------------

PERIOD_DIFF = {
    "month": "datediff('month', f, o_orderdate)", "quarter": "datediff('quarter', f, o_orderdate)",
    "week": "datediff('day', date_trunc('week', f), date_trunc('week', o_orderdate)) // 7", "day": "datediff('day', f, o_orderdate)",
}


def cohort_sql(unit: str) -> str:
    return f"""a AS (SELECT *, date_trunc('{unit}', f) AS cohort, CAST({PERIOD_DIFF[unit]} AS INTEGER) AS idx
        FROM (SELECT *, MIN(o_orderdate) OVER (PARTITION BY o_custkey) AS f FROM orders))"""


for _unit in PERIOD_DIFF:

    @query(
        f"ts16_cohort_by_{_unit}",
        f"WITH {cohort_sql(_unit)} SELECT o_orderkey, {sql_day('cohort')} AS cohort, idx AS cohort_index FROM a",
    )
    def _(t: Tables, unit=_unit):
        out = co.assign(t.orders, "o_custkey", "o_orderdate", unit)
        return out.select("o_orderkey", day("cohort").alias("cohort"), "cohort_index")


MATRIX_SQL = cohort_sql("quarter") + """, c AS (SELECT cohort, idx, COUNT(DISTINCT o_custkey) AS customers, SUM(o_totalprice) AS revenue FROM a GROUP BY 1, 2),
    m AS (SELECT c.*, s.customers AS size, 100.0::DOUBLE * c.customers / s.customers AS retention FROM c JOIN c s ON c.cohort = s.cohort AND s.idx = 0)"""


def quarter_cells(t: Tables):
    return co.matrix(co.assign(t.orders, "o_custkey", "o_orderdate", "quarter"), "o_custkey", "o_totalprice")


@query(
    "ts17_retention_matrix",
    f"WITH {MATRIX_SQL} SELECT {sql_day('cohort')} AS cohort, idx AS cohort_index, customers, size, {sql_rnd('retention')} AS retention FROM m",
)
def _(t: Tables):
    out = quarter_cells(t)
    return out.select(day("cohort").alias("cohort"), "cohort_index", "customers", "size", rnd("retention").alias("retention"))


@query(
    "ts17_retention_wide",
    f"""WITH {MATRIX_SQL} SELECT {sql_day('cohort')} AS cohort, MAX(customers) FILTER (WHERE idx = 0) AS p0,
        MAX(customers) FILTER (WHERE idx = 1) AS p1, MAX(customers) FILTER (WHERE idx = 2) AS p2 FROM m GROUP BY 1""",
)
def _(t: Tables):
    out = co.wide_matrix(quarter_cells(t), "customers", [0, 1, 2])
    return out.select(day("cohort").alias("cohort"), *[F.col(str(i)).alias(f"p{i}") for i in range(3)])


@query(
    "ts18_revenue_matrix",
    f"WITH {MATRIX_SQL} SELECT {sql_day('cohort')} AS cohort, idx AS cohort_index, {sql_rnd('revenue', 2)} AS revenue FROM m",
)
def _(t: Tables):
    return quarter_cells(t).select(day("cohort").alias("cohort"), "cohort_index", rnd("revenue", 2).alias("revenue"))


@query(
    "ts19_cohort_summary",
    f"""WITH {MATRIX_SQL} SELECT {sql_day('cohort')} AS cohort, MAX(size) AS cohort_size,
        {', '.join(sql_rnd(f'MAX(retention) FILTER (WHERE idx = {k})') + f' AS avg_retention_{k}' for k in (1, 3, 6))},
        {sql_rnd('MAX(revenue) FILTER (WHERE idx = 0) / MAX(size)', 2)} AS avg_order_value, {sql_rnd('MAX(revenue) FILTER (WHERE idx = 0)', 2)} AS total_revenue
        FROM m GROUP BY m.cohort""",
)
def _(t: Tables):
    out = co.cohort_summary(quarter_cells(t))
    return out.withColumns(
        {"cohort": day("cohort"), "avg_order_value": rnd("avg_order_value", 2), "total_revenue": rnd("total_revenue", 2)}
        | {f"avg_retention_{k}": rnd(f"avg_retention_{k}") for k in (1, 3, 6)}
    )


@query(
    "ts19_cohort_overall",
    f"""WITH {MATRIX_SQL}, r AS (SELECT cohort, MAX(size) AS size, AVG(retention) AS retention, SUM(revenue) AS revenue FROM m GROUP BY 1)
        SELECT COUNT(*) AS total_cohorts, CAST(SUM(size) AS BIGINT) AS total_users, {sql_rnd('AVG(size)')} AS average_cohort_size,
        {sql_rnd('AVG(retention)')} AS average_retention_rate, {sql_rnd('SUM(revenue)', 2)} AS total_revenue,
        {sql_rnd('SUM(revenue) / SUM(size)', 2)} AS average_revenue_per_user FROM r""",
)
def _(t: Tables):
    out = co.overall(quarter_cells(t))
    return out.withColumns(
        {"average_cohort_size": rnd("average_cohort_size"), "average_retention_rate": rnd("average_retention_rate"),
         "total_revenue": rnd("total_revenue", 2), "average_revenue_per_user": rnd("average_revenue_per_user", 2)}
    )
