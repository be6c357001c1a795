"""Queries of the aggregate tables behind charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfen.operators import charts
from quillfen.plans.registry import Tables, query, rnd, sql_rnd

WIDE_FROM = """FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def wide(t: Tables):
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )


def rounded_columns(df, digits, *columns):
    return df.withColumns({c: rnd(c, digits) for c in columns})


for _function, _sql in (
    ("sum", "SUM(value)"), ("mean", "AVG(value)"), ("median", "MEDIAN(value)"), ("min", "MIN(value)"), ("max", "MAX(value)"),
):

    @query(
        f"agg1_group_{_function}",
        f"SELECT event_type, CAST(user_id % 7 AS BIGINT) AS grp, {sql_rnd(_sql)} AS value FROM events WHERE user_id % 7 > 0 GROUP BY 1, 2",
    )
    def _(t: Tables, function=_function):
        e = t.events.withColumn("grp", F.nullif(F.col("user_id") % 7, F.lit(0)))
        return rounded_columns(charts.aggregate_table(e, "event_type", "value", function, "grp"), 4, "value")


@query("agg1_group_count", "SELECT o_orderpriority, COUNT(*) AS count FROM orders GROUP BY 1")
def _(t: Tables):
    return charts.aggregate_table(t.orders, "o_orderpriority", "o_totalprice", "count")


@query(
    "agg2_many_metrics_long",
    f"""WITH a AS (SELECT l_returnflag, AVG(l_quantity) AS l_quantity, AVG(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1),
        b AS (SELECT *, ROW_NUMBER() OVER (ORDER BY l_quantity DESC, l_returnflag) AS x_rank FROM a)
        SELECT l_returnflag, x_rank, 'l_quantity' AS metric, {sql_rnd('l_quantity')} AS value FROM b
        UNION ALL SELECT l_returnflag, x_rank, 'l_extendedprice', {sql_rnd('l_extendedprice')} FROM b""",
)
def _(t: Tables):
    out = charts.aggregate_long(t.lineitem, "l_returnflag", ["l_quantity", "l_extendedprice"], "mean")
    return rounded_columns(out, 4, "value")


@query(
    "agg2_many_metrics_colour",
    f"""WITH a AS (SELECT l_returnflag, l_linestatus, MAX(l_quantity) AS l_quantity, MAX(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2)
        SELECT l_returnflag, l_linestatus, l_returnflag || ' - ' || l_linestatus AS x_color_combo, 'l_quantity' AS metric, l_quantity AS value FROM a
        UNION ALL SELECT l_returnflag, l_linestatus, l_returnflag || ' - ' || l_linestatus, 'l_tax', l_tax FROM a""",
)
def _(t: Tables):
    return charts.aggregate_long(t.lineitem, "l_returnflag", ["l_quantity", "l_tax"], "max", "l_linestatus")


@query("agg3_frequency", "SELECT c_mktsegment, c_nationkey, COUNT(*) AS count FROM customer GROUP BY 1, 2")
def _(t: Tables):
    return charts.frequency_table(t.customer, "c_mktsegment", "c_nationkey")


@query(
    "agg4_top_categories",
    """WITH top AS (SELECT p_name FROM part GROUP BY 1 ORDER BY COUNT(*) DESC, p_name LIMIT 5)
       SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM top)""",
)
def _(t: Tables):
    return charts.limit_categories(t.part, "p_name", 5).select("p_partkey", "p_name")


@query(
    "agg5_error_bars_std",
    f"SELECT event_type, {sql_rnd('AVG(value)')} AS value, {sql_rnd('STDDEV_SAMP(value)')} AS std FROM events GROUP BY 1",
)
def _(t: Tables):
    return rounded_columns(charts.with_error_bars(t.events, ["event_type"], "value", "std"), 4, "value", "std")


@query(
    "agg5_error_bars_sem",
    f"SELECT event_type, {sql_rnd('AVG(value)')} AS value, {sql_rnd('STDDEV_SAMP(value) / SQRT(COUNT(value))', 6)} AS sem FROM events GROUP BY 1",
)
def _(t: Tables):
    out = charts.with_error_bars(t.events, ["event_type"], "value", "sem")
    return rounded_columns(rounded_columns(out, 4, "value"), 6, "sem")


@query(
    "agg6_first_last",
    "SELECT user_id, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value FROM events GROUP BY 1",
)
def _(t: Tables):
    return charts.grouped(
        t.events, ["user_id"], {"first_value": ("value", "first"), "last_value": ("value", "last")}, order_by="ts"
    )


@query(
    "agg7_card",
    f"""SELECT {sql_rnd('SUM(value)', 2)} AS sum, {sql_rnd('AVG(value)')} AS mean, {sql_rnd('MEDIAN(value)')} AS median,
        CAST(COUNT(value) AS DOUBLE) AS count, MIN(value) AS min, MAX(value) AS max FROM events""",
)
def _(t: Tables):
    out = charts.card_table(t.events, "value", ["sum", "mean", "median", "count", "min", "max"])
    return rounded_columns(rounded_columns(out, 2, "sum"), 4, "mean", "median")


@query(
    "agg8_kpi_constant_target",
    f"""SELECT {sql_rnd('AVG(value)')} AS value, 50.0::DOUBLE AS target, {sql_rnd('AVG(value) - 50')} AS delta,
        {sql_rnd('(AVG(value) - 50) / 50')} AS delta_relative, AVG(value) <= 50 AS met FROM events""",
)
def _(t: Tables):
    out = charts.kpi(t.events, "value", "mean", target=50.0, polarity="lower")
    return rounded_columns(out, 4, "value", "target", "delta", "delta_relative")


@query(
    "agg8_kpi_column_target",
    f"""SELECT {sql_rnd('SUM(l_extendedprice)', 2)} AS value, {sql_rnd('SUM(l_quantity)', 2)} AS target,
        {sql_rnd('SUM(l_extendedprice) / SUM(l_quantity) - 1')} AS delta_relative, SUM(l_extendedprice) >= SUM(l_quantity) AS met FROM lineitem""",
)
def _(t: Tables):
    out = charts.kpi(t.lineitem, "l_extendedprice", "sum", target_column="l_quantity", target_function="sum").drop("delta")
    return rounded_columns(rounded_columns(out, 2, "value", "target"), 4, "delta_relative")


@query(
    "agg9_kpi_trend",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, v FROM (SELECT *, NULLIF(value, 6.55) AS v FROM events) WHERE v IS NOT NULL ORDER BY ts, v LIMIT 500",
)
def _(t: Tables):
    e = t.events.withColumn("v", F.nullif("value", F.lit(6.55)))
    ids = t.events.select("event_id", F.col("ts").alias("_at"))
    line = charts.trend_line(e, "ts", "v", 500)
    out = line.join(ids, F.col("ts") == F.col("_at"))
    return out.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "v")


@query(
    "agg10_gauge",
    f"""WITH g AS (SELECT AVG(value) v FROM events) SELECT {sql_rnd('v')} AS value, 0.0::DOUBLE AS low, {sql_rnd('GREATEST(2 * v, v + 1, 1)')} AS high,
        40.0::DOUBLE AS target, 40.0::DOUBLE AS threshold, v > 40 AS met FROM g""",
)
def _(t: Tables):
    return rounded_columns(charts.gauge(t.events, "value", "mean", target=40.0, strict=True), 4, "value", "high")


@query(
    "agg10_gauge_column_bounds",
    """SELECT ROUND(MAX(p_size), 0)::DOUBLE AS value, MIN(p_size)::DOUBLE AS low, 100.0::DOUBLE AS high, NULL::DOUBLE AS target,
       NULL::DOUBLE AS threshold, NULL::BOOLEAN AS met FROM part""",
)
def _(t: Tables):
    return charts.gauge(t.part, "p_size", "max", low_column=("p_size", "min"), high=100.0)


@query(
    "agg11_pie",
    f"""SELECT c_mktsegment, {sql_rnd('v', 2)} AS value, {sql_rnd('100 * v / SUM(v) OVER ()')} AS percentage
        FROM (SELECT c_mktsegment, SUM(ABS(c_acctbal)) AS v FROM customer GROUP BY 1)""",
)
def _(t: Tables):
    c = t.customer.withColumn("balance", F.abs("c_acctbal"))
    out = charts.pie_slices(c, "c_mktsegment", "balance", "sum")
    return rounded_columns(rounded_columns(out, 2, "value"), 4, "percentage")


_NATIONS = """WITH a AS (SELECT n_name, COUNT(*) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
    b AS (SELECT *, 100.0 * value / SUM(value) OVER () AS p FROM a)"""


def nation_slices(t: Tables):
    return charts.pie_slices(t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")), "n_name")


@query(
    "agg12_pie_other",
    _NATIONS + f""", c AS (SELECT *, ROW_NUMBER() OVER (ORDER BY value DESC, n_name) AS rn FROM b)
        SELECT n_name, value, {sql_rnd('p', 6)} AS percentage, CAST(rn AS INTEGER) AS position FROM c WHERE rn < 8
        UNION ALL SELECT 'Other', CAST(SUM(value) AS BIGINT), {sql_rnd('SUM(p)', 6)}, 8 FROM c WHERE rn >= 8""",
)
def _(t: Tables):
    out = charts.limit_slices(nation_slices(t), "n_name", limit=8)
    return rounded_columns(out, 6, "percentage")


@query(
    "agg12_pie_threshold",
    _NATIONS + f"SELECT n_name, value, {sql_rnd('p', 6)} AS percentage FROM b WHERE p >= 4",
)
def _(t: Tables):
    return rounded_columns(charts.limit_slices(nation_slices(t), "n_name", min_percent=4.0), 6, "percentage")


@query(
    "agg13_pie_buckets",
    f"""WITH top AS (SELECT p_name FROM part GROUP BY 1 ORDER BY COUNT(*) DESC, p_name LIMIT 10)
        SELECT CASE WHEN p_name IN (SELECT p_name FROM top) THEN p_name ELSE 'Other' END AS p_name,
        {sql_rnd('SUM(p_retailprice)', 2)} AS value FROM part GROUP BY 1""",
)
def _(t: Tables):
    return rounded_columns(charts.pie_buckets(t.part, "p_name", "p_retailprice"), 2, "value")


@query(
    "agg14_treemap",
    f"""SELECT r_name, n_name, c_mktsegment, CAST((r_name IS NOT NULL)::INT + (n_name IS NOT NULL)::INT + (c_mktsegment IS NOT NULL)::INT AS INTEGER) AS level,
        {sql_rnd('SUM(l_quantity)', 2)} AS value {WIDE_FROM} GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""",
)
def _(t: Tables):
    out = charts.tree_levels(wide(t), ["r_name", "n_name", "c_mktsegment"], "l_quantity")
    return rounded_columns(out, 2, "value")


@query(
    "agg14_treemap_small_categories",
    """WITH p AS (SELECT COALESCE(NULLIF(p_type, 'SMALL'), 'Unknown') AS p_type, p_name FROM part),
       top AS (SELECT p_name FROM p GROUP BY 1 ORDER BY COUNT(*) DESC, p_name LIMIT 9),
       q AS (SELECT p_type, CASE WHEN p_name IN (SELECT p_name FROM top) THEN p_name ELSE 'Other' END AS p_name FROM p)
       SELECT p_type, p_name, CAST((p_type IS NOT NULL)::INT + (p_name IS NOT NULL)::INT AS INTEGER) AS level, COUNT(*)::DOUBLE AS value
       FROM q GROUP BY ROLLUP (p_type, p_name)""",
)
def _(t: Tables):
    p = t.part.withColumn("p_type", F.nullif("p_type", F.lit("SMALL")))
    return charts.tree_levels(p, ["p_type", "p_name"], max_categories=10)


@query("agg15_crosstab", "SELECT event_type, user_id, COUNT(*) AS count FROM events GROUP BY 1, 2")
def _(t: Tables):
    return charts.crosstab(t.events, "event_type", "user_id")


GEO_SQL = """(SELECT *, CAST((c_custkey * 37) % 190 - 95 AS DOUBLE) AS lat, CAST((c_custkey * 91) % 360 - 180 AS DOUBLE) AS lon FROM customer)"""


def geo(t: Tables):
    return t.customer.withColumns(
        {
            "lat": (F.col("c_custkey") * 37 % 190 - 95).cast("double"),
            "lon": (F.col("c_custkey") * 91 % 360 - 180).cast("double"),
        }
    )


@query(
    "agg16_geo_groups",
    f"""WITH v AS (SELECT * FROM {GEO_SQL} WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180),
        m AS (SELECT c_nationkey, c_mktsegment, COUNT(*) n FROM v GROUP BY 1, 2),
        s AS (SELECT c_nationkey, c_mktsegment, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) rn FROM m)
        SELECT v.c_nationkey, {sql_rnd('AVG(lat)')} AS lat, {sql_rnd('AVG(lon)')} AS lon, {sql_rnd('SUM(c_acctbal)', 2)} AS c_acctbal,
        ANY_VALUE(s.c_mktsegment) AS c_mktsegment FROM v JOIN s ON v.c_nationkey = s.c_nationkey AND rn = 1 GROUP BY 1""",
)
def _(t: Tables):
    out = charts.geo_groups(geo(t), "lat", "lon", "c_nationkey", "c_acctbal", "sum", text="c_mktsegment")
    return rounded_columns(rounded_columns(out, 4, "lat", "lon"), 2, "c_acctbal")


@query(
    "agg17_coordinate_check",
    f"""SELECT MIN(lat) AS lat_min, MAX(lat) AS lat_max, MIN(lon) AS lon_min, MAX(lon) AS lon_max,
        COUNT(*) FILTER (WHERE NOT lat BETWEEN -90 AND 90) AS bad_lat, COUNT(*) FILTER (WHERE NOT lon BETWEEN -180 AND 180) AS bad_lon
        FROM {GEO_SQL}""",
)
def _(t: Tables):
    return charts.coordinate_check(geo(t).drop("c_name"))


def histogram_sql(column: str, table: str, bins: int, extra: str = "") -> str:
    return f"""WITH b AS (SELECT MIN({column}) lo, (MAX({column}) - MIN({column})) / {bins} w, COUNT({column}) n FROM {table})
        SELECT LEAST(CAST(FLOOR(({column} - lo) / w) AS INTEGER), {bins - 1}) AS bin, COUNT(*) AS count {extra}
        FROM {table}, b GROUP BY 1"""


@query("agg18_histogram_numeric", histogram_sql("value", "events", 20))
def _(t: Tables):
    return charts.histogram(t.events, "value", 20).select("bin", "count")


@query(
    "agg18_histogram_datetime",
    histogram_sql("x", "(SELECT epoch_us(o_orderdate) / 1e6 AS x FROM orders)", 60),
)
def _(t: Tables):
    return charts.histogram(t.orders, "o_orderdate").select("bin", "count")


@query("agg18_histogram_categories", "SELECT lang AS value, COUNT(*) AS count FROM documents GROUP BY 1")
def _(t: Tables):
    return charts.histogram(t.documents, "lang")


@query(
    "agg18_histogram_numeric_text",
    histogram_sql("x", "(SELECT TRY_CAST(k AS DOUBLE) AS x FROM (SELECT CASE WHEN event_id % 10 = 0 THEN 'n/k' ELSE CAST(user_id AS VARCHAR) END AS k FROM events) WHERE TRY_CAST(k AS DOUBLE) IS NOT NULL)", 10),
)
def _(t: Tables):
    k = F.when(F.col("event_id") % 10 == 0, "n/k").otherwise(F.col("user_id").cast("string"))
    return charts.histogram(t.events.select(k.alias("k")), "k", 10).select("bin", "count")


@query(
    "agg19_density_histogram",
    histogram_sql("o_totalprice", "orders", 40, f", {sql_rnd('COUNT(*) / (ANY_VALUE(n) * ANY_VALUE(w)) * 1e6')} AS density"),
)
def _(t: Tables):
    out = charts.density_histogram(t.orders, "o_totalprice")
    return out.select("bin", "count", rnd(F.col("density") * 1e6).alias("density"))


@query(
    "agg20_density_curve",
    f"""WITH s AS (SELECT MIN(o_totalprice) lo, MAX(o_totalprice) hi, COUNT(*) n, STDDEV_SAMP(o_totalprice) * POW(COUNT(*), -0.2) h FROM orders),
        g AS (SELECT lo + i * (hi - lo) / 199 AS x FROM s, range(200) r(i))
        SELECT {sql_rnd('x', 2)} AS x, {sql_rnd('SUM(EXP(-0.5 * POW((x - o_totalprice) / h, 2))) / (ANY_VALUE(n) * ANY_VALUE(h) * SQRT(2 * PI())) * 1e6', 3)} AS density
        FROM g, orders, s GROUP BY x""",
)
def _(t: Tables):
    out = charts.density_curve(t.orders, "o_totalprice")
    return out.select(rnd("x", 2).alias("x"), rnd(F.col("density") * 1e6, 3).alias("density"))


@query(
    "agg21_box_statistics",
    f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) q1, MEDIAN(value) m, quantile_cont(value, 0.75) q3 FROM events GROUP BY 1),
        r AS (SELECT e.event_type, value, q1, m, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events e JOIN q USING (event_type))
        SELECT event_type, COUNT(*) AS count, MIN(value) AS min, {sql_rnd('MAX(q1)')} AS q1, {sql_rnd('MAX(m)')} AS median, {sql_rnd('MAX(q3)')} AS q3,
        MAX(value) AS max, MIN(value) FILTER (WHERE inside) AS whisker_low, MAX(value) FILTER (WHERE inside) AS whisker_high,
        COUNT(*) FILTER (WHERE NOT inside) AS outliers FROM r GROUP BY 1""",
)
def _(t: Tables):
    return rounded_columns(charts.box_statistics(t.events, "value", ["event_type"]), 4, "q1", "median", "q3")


@query(
    "agg22_scatter",
    """SELECT c_custkey, CAST(c_custkey AS DOUBLE) AS x, c_acctbal AS y, ABS(c_acctbal - 5000) AS size FROM customer WHERE c_custkey % 9 <> 0""",
)
def _(t: Tables):
    x = F.when(F.col("c_custkey") % 9 == 0, "none").otherwise(F.col("c_custkey").cast("string"))
    c = t.customer.select("c_custkey", x.alias("x"), F.col("c_acctbal").alias("y"), (F.col("c_acctbal") - 5000).alias("size"))
    return charts.scatter_points(c, "x", "y", "size")


@query(
    "agg23_pareto",
    f"""WITH c AS (SELECT p_name AS value, COUNT(*) AS count FROM part GROUP BY 1),
        r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY count DESC, value) rn FROM c),
        a AS (SELECT value, count, rn FROM r WHERE rn <= 15 UNION ALL SELECT 'Other', CAST(SUM(count) AS BIGINT), 16 FROM r WHERE rn > 15),
        p AS (SELECT *, round_even(count * 1000.0::DOUBLE / (SELECT SUM(count) FROM c), 0) / 10 AS percentage FROM a)
        SELECT value, count, percentage, {sql_rnd('SUM(percentage) OVER (ORDER BY rn)')} AS cumulative FROM p""",
)
def _(t: Tables):
    return rounded_columns(charts.pareto_table(t.part, "p_name"), 4, "cumulative")


@query("agg24_bar", f"SELECT p_brand, {sql_rnd('SUM(p_retailprice)', 2)} AS p_retailprice FROM part GROUP BY 1")
def _(t: Tables):
    return rounded_columns(charts.bar_table(t.part, "p_brand", "p_retailprice"), 2, "p_retailprice")


@query(
    "agg25_card_context",
    f"SELECT COUNT(*) AS count, {sql_rnd('AVG(o_totalprice)')} AS mean, MIN(o_totalprice) AS min, MAX(o_totalprice) AS max FROM orders",
)
def _(t: Tables):
    return rounded_columns(charts.card_context(t.orders, "o_totalprice"), 4, "mean")


@query(
    "agg26_line_points",
    "SELECT strftime(o_orderdate, '%Y-%m-%d') AS x, o_totalprice AS y FROM orders WHERE o_orderstatus <> 'P'",
)
def _(t: Tables):
    y = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    points, _removed = charts.line_points(t.orders.select("o_orderdate", y.alias("y")), "o_orderdate", "y")
    return points.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("x"), "y")


@query("agg26_line_removed", "SELECT COUNT(*) AS removed FROM orders WHERE o_orderstatus = 'P'")
def _(t: Tables):
    y = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return charts.line_points(t.orders.select("o_orderdate", y.alias("y")), "o_orderdate", "y")[1]
