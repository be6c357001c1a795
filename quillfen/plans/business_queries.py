"""Queries of feature engineering and business analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfen.operators import business as bi
from quillfen.operators import features as ft
from quillfen.plans.registry import Tables, query, rnd, sql_rnd

PARTS = {
    "year": "year(o_orderdate)", "month": "month(o_orderdate)", "day": "day(o_orderdate)", "dayofweek": "isodow(o_orderdate) - 1",
    "dayofyear": "dayofyear(o_orderdate)", "week": "week(o_orderdate)", "quarter": "quarter(o_orderdate)",
}


@query("bi1_date_parts", "SELECT o_orderkey, " + ", ".join(f"CAST({e} AS INTEGER) AS d_{n}" for n, e in PARTS.items()) + " FROM orders")
def _(t: Tables):
    return ft.date_parts(t.orders.select("o_orderkey", F.col("o_orderdate").alias("d")), "d").drop("d")


FLAGS = {
    "is_weekend": "isodow(d) > 5", "is_month_end": "d = last_day(d)", "is_month_start": "day(d) = 1",
    "is_quarter_end": "d = last_day(d) AND month(d) % 3 = 0", "is_quarter_start": "day(d) = 1 AND month(d) % 3 = 1",
    "is_year_end": "month(d) = 12 AND day(d) = 31", "is_year_start": "month(d) = 1 AND day(d) = 1",
}


@query("bi2_date_flags", "SELECT o_orderkey, " + ", ".join(f"CAST({e} AS INTEGER) AS d_{n}" for n, e in FLAGS.items()) + " FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def _(t: Tables):
    return ft.date_flags(t.orders.select("o_orderkey", F.col("o_orderdate").alias("d")), "d").drop("d")


@query(
    "bi3_cyclic_parts",
    f"""SELECT o_orderkey, {sql_rnd('SIN(2 * PI() * month(o_orderdate) / 12)', 6)} AS d_month_sin, {sql_rnd('COS(2 * PI() * month(o_orderdate) / 12)', 6)} AS d_month_cos,
        {sql_rnd('SIN(2 * PI() * (isodow(o_orderdate) - 1) / 7)', 6)} AS d_dayofweek_sin, {sql_rnd('COS(2 * PI() * (isodow(o_orderdate) - 1) / 7)', 6)} AS d_dayofweek_cos FROM orders""",
)
def _(t: Tables):
    out = ft.cyclic_parts(t.orders.select("o_orderkey", F.col("o_orderdate").alias("d")), "d").drop("d")
    return out.select("o_orderkey", *[rnd(c, 6).alias(c) for c in out.columns[1:]])


@query(
    "bi4_numeric_transforms",
    f"""SELECT event_id, {sql_rnd('LN(1 + ABS(value))')} AS value_log, {sql_rnd('SQRT(ABS(value))')} AS value_sqrt, {sql_rnd('value * value')} AS value_squared,
        {sql_rnd('value * value * value', 2)} AS value_cubed, {sql_rnd('(value - AVG(value) OVER ()) / STDDEV_SAMP(value) OVER ()', 6)} AS value_zscore FROM events""",
)
def _(t: Tables):
    out = ft.numeric_transforms(t.events.select("event_id", "value"), ["value"]).drop("value")
    digits = {"value_cubed": 2, "value_zscore": 6}
    return out.select("event_id", *[rnd(c, digits.get(c, 4)).alias(c) for c in out.columns[1:]])


def bins_sql(column: str, table: str, n: int, edges: int | None = None) -> str:
    """CASE over exact quantile edges, right-closed."""
    cases = " ".join(
        f"WHEN {column} <= (SELECT quantile_cont({column}, {i / n}) FROM {table}) THEN {i - 1}" for i in range(1, n + 1)
    )
    return f"CASE {cases} END"


@query(
    "bi5_quantile_bins",
    f"SELECT event_id, {bins_sql('value', 'events', 5)} AS value_bin_5, {bins_sql('value', 'events', 10)} AS value_bin_10 FROM events",
)
def _(t: Tables):
    return ft.quantile_bins(t.events.select("event_id", "value"), ["value"]).drop("value")


@query(
    "bi5_quantile_bins_repeated_edges",
    "SELECT event_id, CASE WHEN v = 0 THEN 0 WHEN v <= 1 THEN 1 ELSE 2 END AS v_bin_5 FROM (SELECT event_id, CASE WHEN event_id % 10 < 5 THEN 0 WHEN event_id % 10 < 7 THEN 1 ELSE 2 END AS v FROM events)".replace(
        "CASE WHEN v = 0 THEN 0 WHEN v <= 1 THEN 1 ELSE 2 END", "CASE WHEN v <= 1 THEN 0 ELSE 1 END"
    ),
)
def _(t: Tables):
    # Edges 0, 0, 0, 1, 2, 2 leave the bins [0, 1] and (1, 2].
    v = F.when(F.col("event_id") % 10 < 5, 0).when(F.col("event_id") % 10 < 7, 1).otherwise(2)
    return ft.quantile_bins(t.events.select("event_id", v.alias("v")), ["v"], [5]).drop("v")


@query(
    "bi6_frequency_encoding",
    f"SELECT event_id, {sql_rnd('COUNT(*) OVER (PARTITION BY event_type) / COUNT(*) OVER ()', 8)} AS event_type_freq FROM events",
)
def _(t: Tables):
    out = ft.encode_category(t.events, "event_type")
    return out.select("event_id", rnd("event_type_freq", 8).alias("event_type_freq"))


@query(
    "bi7_target_encoding",
    f"SELECT event_id, {sql_rnd('AVG(value) OVER (PARTITION BY event_type)', 5)} AS event_type_target_mean FROM events",
)
def _(t: Tables):
    out = ft.encode_category(t.events, "event_type", "value")
    return out.select("event_id", rnd("event_type_target_mean", 5).alias("event_type_target_mean"))


@query(
    "bi8_interactions",
    f"""SELECT p_partkey, {sql_rnd('p_size * p_retailprice')} AS p_size_x_p_retailprice, {sql_rnd('p_size / (p_retailprice + 1e-10)', 8)} AS p_size_div_p_retailprice FROM part""",
)
def _(t: Tables):
    out = ft.interactions(t.part, ["p_size", "p_retailprice"])
    return out.select("p_partkey", rnd("p_size_x_p_retailprice").alias("p_size_x_p_retailprice"), rnd("p_size_div_p_retailprice", 8).alias("p_size_div_p_retailprice"))


@query(
    "bi9_lags",
    "SELECT event_id, LAG(value, 1) OVER w AS value_lag_1, LAG(value, 7) OVER w AS value_lag_7, LAG(value, 30) OVER w AS value_lag_30 FROM events WINDOW w AS (ORDER BY ts, event_id)",
)
def _(t: Tables):
    return ft.lags(t.events, "value", ["ts", "event_id"]).select("event_id", "value_lag_1", "value_lag_7", "value_lag_30")


@query("bi9_all_features")
def _(t: Tables):
    out = ft.engineer(t.events.drop("props"), target="value", exclude=["event_id"], order_by=["ts", "event_id"])
    return out.importance


# ---- RFM -------------------------------------------------------------------------------

RFM_SQL = """m AS (SELECT o_custkey, datediff('day', MAX(o_orderdate), (SELECT MAX(o_orderdate) FROM orders)) AS recency, COUNT(*) AS frequency, SUM(o_totalprice) AS monetary
    FROM orders GROUP BY 1),
  q AS (SELECT """ + ", ".join(
    f"quantile_cont({c}, {p}) AS {c[0]}{int(p * 4)}" for c in ("recency", "frequency", "monetary") for p in (0.0, 0.25, 0.5, 0.75, 1.0)
) + """ FROM m),
  k AS (SELECT m.*, """ + ", ".join(
    # Bins between distinct edges; a repeated edge closes no bin.
    f"CAST((CASE WHEN {c} > {c[0]}1 AND {c[0]}1 > {c[0]}0 THEN 1 ELSE 0 END) + (CASE WHEN {c} > {c[0]}2 AND {c[0]}2 > {c[0]}1 THEN 1 ELSE 0 END) + (CASE WHEN {c} > {c[0]}3 AND {c[0]}3 > {c[0]}2 THEN 1 ELSE 0 END) AS INTEGER) AS {c[0]}c"
    for c in ("recency", "frequency", "monetary")
) + " FROM m, q), s AS (SELECT *, 4 - rc AS R_score, fc + 1 AS F_score, mc + 1 AS M_score, (4 - rc)::VARCHAR || (fc + 1)::VARCHAR || (mc + 1)::VARCHAR AS RFM_Score FROM k),"
SEGMENT_SQL = "CASE " + " ".join(
    f"WHEN RFM_Score IN ({', '.join(repr(c) for c in codes)}) THEN '{name}'" for name, codes in bi.SEGMENTS.items()
) + " ELSE 'Unclassified' END"
RFM_SQL += f" g AS (SELECT *, {SEGMENT_SQL} AS segment FROM s)"


def order_rfm(t: Tables, **options):
    return bi.rfm(t.orders, "o_custkey", "o_orderdate", "o_totalprice", **options)


@query("bi10_rfm_metrics", f"WITH {RFM_SQL} SELECT o_custkey, recency, frequency, {sql_rnd('monetary', 2)} AS monetary FROM m")
def _(t: Tables):
    out = bi.rfm_metrics(t.orders, "o_custkey", "o_orderdate", "o_totalprice")
    return out.withColumn("monetary", rnd("monetary", 2))


@query("bi11_rfm_scores", f"WITH {RFM_SQL} SELECT o_custkey, R_score, F_score, M_score, RFM_Score FROM s")
def _(t: Tables):
    return order_rfm(t).select("o_custkey", "R_score", "F_score", "M_score", "RFM_Score")


@query(
    "bi11_rfm_scores_by_rank",
    """WITH m AS (SELECT o_custkey, COUNT(*) AS f FROM orders GROUP BY 1), r AS (SELECT o_custkey, ROW_NUMBER() OVER (ORDER BY f, o_custkey) AS i FROM m),
       q AS (SELECT quantile_cont(i, 0.25) a, quantile_cont(i, 0.5) b, quantile_cont(i, 0.75) c FROM r)
       SELECT o_custkey, CASE WHEN i <= a THEN 1 WHEN i <= b THEN 2 WHEN i <= c THEN 3 ELSE 4 END AS F_score FROM r, q""",
)
def _(t: Tables):
    return order_rfm(t, ties="rank").select("o_custkey", "F_score")


ACTION_SQL = "CASE segment " + " ".join(f"WHEN '{n}' THEN '{a}'" for n, a in bi.ACTIONS.items()) + " ELSE 'Monitor and engage' END"


@query("bi12_rfm_customers", f"WITH {RFM_SQL} SELECT o_custkey, segment, {ACTION_SQL} AS action FROM g")
def _(t: Tables):
    return order_rfm(t).select("o_custkey", "segment", "action")


@query(
    "bi13_rfm_segments",
    f"""WITH {RFM_SQL} SELECT segment, {sql_rnd('AVG(recency)', 2)} AS recency, {sql_rnd('AVG(frequency)', 2)} AS frequency, {sql_rnd('AVG(monetary)', 2)} AS monetary,
        COUNT(*) AS customer_count, {sql_rnd('COUNT(*) * 100.0::DOUBLE / (SELECT COUNT(*) FROM g)', 1)} AS percentage FROM g GROUP BY 1""",
)
def _(t: Tables):
    return bi.segment_statistics(order_rfm(t))


# ---- pricing -----------------------------------------------------------------------------


def priced(t: Tables):
    lines = t.lineitem.select("l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"))
    return lines.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))


PRICED = "(SELECT p_brand, l_extendedprice / l_quantity AS price, l_quantity AS quantity, l_extendedprice / l_quantity * l_quantity AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey)"
METRICS = {
    "price_mean": ("AVG(price)", 4), "price_std": ("STDDEV_SAMP(price)", 4), "price_min": ("MIN(price)", 4), "price_max": ("MAX(price)", 4),
    "quantity_sum": ("SUM(quantity)", 2), "quantity_mean": ("AVG(quantity)", 4), "quantity_std": ("STDDEV_SAMP(quantity)", 4), "revenue_sum": ("SUM(revenue)", 2),
}


@query("bi14_price_metrics", "SELECT p_brand, " + ", ".join(f"{sql_rnd(e, d)} AS {n}" for n, (e, d) in METRICS.items()) + f" FROM {PRICED} GROUP BY 1")
def _(t: Tables):
    out = bi.price_metrics(priced(t), "p_brand", "price", "quantity")
    return out.select("p_brand", *[rnd(n, d).alias(n) for n, (_, d) in METRICS.items()])


_ELASTICITY = "-(STDDEV_SAMP(quantity) / AVG(quantity)) / (STDDEV_SAMP(price) / AVG(price))"


@query(
    "bi15_elasticity",
    f"""SELECT p_brand, {sql_rnd(_ELASTICITY, 6)} AS price_elasticity, {sql_rnd(f'AVG(price) * CASE WHEN ABS({_ELASTICITY}) < 1 THEN 1.1 ELSE 0.9 END')} AS suggested_price FROM {PRICED} GROUP BY 1""",
)
def _(t: Tables):
    out = bi.price_metrics(priced(t), "p_brand", "price", "quantity")
    return out.select("p_brand", rnd("price_elasticity", 6).alias("price_elasticity"), rnd("suggested_price").alias("suggested_price"))


TOTALS = {
    "average_price": ("AVG(price)", 4), "price_std": ("STDDEV_SAMP(price)", 4), "min_price": ("MIN(price)", 4), "max_price": ("MAX(price)", 4), "median_price": ("MEDIAN(price)", 4),
    "price_skewness": ("SKEWNESS(price)", 5), "total_quantity": ("SUM(quantity)", 2), "average_quantity": ("AVG(quantity)", 4), "quantity_std": ("STDDEV_SAMP(quantity)", 4),
    "total_revenue": ("SUM(revenue)", 2), "average_revenue": ("AVG(revenue)", 3), "revenue_std": ("STDDEV_SAMP(revenue)", 3), "price_quantity_correlation": ("CORR(price, quantity)", 5),
}


@query("bi16_price_totals", "SELECT COUNT(*) AS transactions, " + ", ".join(f"{sql_rnd(e, d)} AS {n}" for n, (e, d) in TOTALS.items()) + f" FROM {PRICED}")
def _(t: Tables):
    out = bi.price_totals(priced(t), "price", "quantity")
    return out.select("transactions", *[rnd(n, d).alias(n) for n, (_, d) in TOTALS.items()])


@query(
    "bi17_price_bands",
    f"""WITH d AS (SELECT * FROM {PRICED}), q AS (SELECT quantile_cont(price, 0.25) a, quantile_cont(price, 0.5) b, quantile_cont(price, 0.75) c FROM d),
        g AS (SELECT CASE WHEN price <= a THEN 'Low' WHEN price <= b THEN 'Medium-Low' WHEN price <= c THEN 'Medium-High' ELSE 'High' END AS band, price, quantity, revenue FROM d, q),
        s AS (SELECT band, SUM(quantity) AS quantity, SUM(revenue) AS revenue, COUNT(*) AS transactions, AVG(price) AS avg_price, AVG(quantity) AS avg_quantity FROM g GROUP BY 1)
        SELECT band, {sql_rnd('quantity', 2)} AS quantity, {sql_rnd('revenue', 2)} AS revenue, transactions, {sql_rnd('avg_price')} AS avg_price, {sql_rnd('avg_quantity')} AS avg_quantity,
        s.revenue = (SELECT MAX(revenue) FROM s) AS best FROM s""",
)
def _(t: Tables):
    out = bi.price_bands(priced(t), "price", "quantity")
    return out.withColumns({"quantity": rnd("quantity", 2), "revenue": rnd("revenue", 2), "avg_price": rnd("avg_price"), "avg_quantity": rnd("avg_quantity")})


# ---- A/B tests -----------------------------------------------------------------------------


def variants(t: Tables):
    # The variant gets a small bonus, so that there is something to find.
    arm = F.when(F.col("user_id") % 2 == 0, "A").otherwise("B")
    value = F.when(F.col("user_id") % 2 == 0, F.col("value")).otherwise(F.col("value") * 1.05)
    return t.events.select(arm.alias("arm"), value.alias("value"))


ARMS = "(SELECT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS arm, CASE WHEN user_id % 2 = 0 THEN value ELSE value * 1.05::DOUBLE END AS value FROM events)"


@query(
    "bi18_ab_groups",
    f"""SELECT arm AS "group", COUNT(*) AS sample_size, {sql_rnd('AVG(value)')} AS mean, {sql_rnd('STDDEV_SAMP(value)')} AS std, {sql_rnd('MIN(value)')} AS min, {sql_rnd('MAX(value)')} AS max,
        {sql_rnd('MEDIAN(value)')} AS median, {sql_rnd('AVG(value) - 1.96 * STDDEV_SAMP(value) / SQRT(COUNT(*))')} AS ci_low, {sql_rnd('AVG(value) + 1.96 * STDDEV_SAMP(value) / SQRT(COUNT(*))')} AS ci_high
        FROM {ARMS} GROUP BY 1""",
)
def _(t: Tables):
    out = bi.ab_groups(variants(t), "arm", "value").drop("lift_vs_control")
    return out.select("group", "sample_size", *[rnd(c).alias(c) for c in out.columns if c not in ("group", "sample_size")])


_SIDES = f"""(SELECT COUNT(*) FILTER (WHERE arm = 'A') AS n1, COUNT(*) FILTER (WHERE arm = 'B') AS n2, AVG(value) FILTER (WHERE arm = 'A') AS m1, AVG(value) FILTER (WHERE arm = 'B') AS m2,
    VAR_SAMP(value) FILTER (WHERE arm = 'A') AS v1, VAR_SAMP(value) FILTER (WHERE arm = 'B') AS v2 FROM {ARMS})"""


@query(
    "bi19_welch_test",
    f"""SELECT 'A vs B' AS groups, {sql_rnd('(m1 - m2) / SQRT(v1 / n1 + v2 / n2)', 6)} AS t_statistic,
        {sql_rnd('POW(v1 / n1 + v2 / n2, 2) / (POW(v1 / n1, 2) / (n1 - 1) + POW(v2 / n2, 2) / (n2 - 1))', 3)} AS degrees,
        ABS((m1 - m2) / SQRT(v1 / n1 + v2 / n2)) > 1.9602 AS significant, {sql_rnd('(m2 - m1) / SQRT((v1 + v2) / 2)', 6)} AS effect_size FROM {_SIDES}""",
)
def _(t: Tables):
    out = bi.welch_test(variants(t), "arm", "value", "A", "B").drop("p_value")
    return out.withColumns({"t_statistic": rnd("t_statistic", 6), "degrees": rnd("degrees", 3), "effect_size": rnd("effect_size", 6)})


@query(
    "bi20_lift",
    f"SELECT 'A' AS \"group\", 0.0::DOUBLE AS lift_vs_control UNION ALL SELECT 'B', {sql_rnd('(m2 - m1) / m1 * 100', 6)} FROM {_SIDES}",
)
def _(t: Tables):
    out = bi.ab_groups(variants(t), "arm", "value", control="A")
    return out.select("group", rnd("lift_vs_control", 6).alias("lift_vs_control"))


@query(
    "bi18_ab_many_groups",
    f"""SELECT (user_id % 7)::VARCHAR AS "group", COUNT(*) AS sample_size, {sql_rnd('AVG(value)')} AS mean
        FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY 1""",
)
def _(t: Tables):
    out = bi.ab_groups(t.events.withColumn("arm", F.col("user_id") % 7), "arm", "value")
    return out.select("group", "sample_size", rnd("mean").alias("mean"))


@query(
    "bi7_many_categories",
    f"SELECT o_custkey, {sql_rnd('COUNT(*) / (SELECT COUNT(*) FROM orders)', 10)} AS share FROM orders GROUP BY 1",
)
def _(t: Tables):
    out = ft.encode_category(t.orders.select("o_custkey"), "o_custkey").distinct()
    return out.select("o_custkey", rnd("o_custkey_freq", 10).alias("share"))


@query("bi21_power")
def _(t: Tables):
    return bi.ab_power(variants(t), "arm", "value", "A", "B")


@query(
    "bi21_power_facts",
    f"""SELECT {sql_rnd('ABS(m2 - m1) / SQRT((v1 + v2) / 2)', 6)} AS effect_size, LEAST(n1, n2) AS sample_size_per_group, 0.05::DOUBLE AS alpha,
        true AS near_normal FROM {_SIDES}""",
)
def _(t: Tables):
    # In samples of this size the power lies close to that of the normal distribution, 1.959964 deviations on.
    out = bi.ab_power(variants(t), "arm", "value", "A", "B")
    sizes = variants(t).groupBy("arm").agg(F.count("value").alias("n")).agg(F.sqrt(F.product("n") / F.sum("n"))).scalar()
    beyond = F.col("effect_size") * sizes - F.lit(1.959964)
    # The polynomial of the normal distribution (Abramowitz and Stegun 26.2.17).
    step = 1 / (1 + 0.2316419 * F.abs(beyond))
    series = step * (0.319381530 + step * (-0.356563782 + step * (1.781477937 + step * (-1.821255978 + step * 1.330274429))))
    tail = F.exp(-beyond * beyond / 2) / F.sqrt(2 * F.pi()) * series
    normal = F.when(beyond >= 0, 1 - tail).otherwise(tail)
    return out.select(rnd("effect_size", 6).alias("effect_size"), "sample_size_per_group", "alpha", (F.abs(F.col("power") - normal) < 0.01).alias("near_normal"))
