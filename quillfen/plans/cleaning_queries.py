"""Queries of duplicates, missing values, types, dates, splitting and anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfen.operators import cleaning as cln
from quillfen.operators import dates as dt
from quillfen.plans.registry import Tables, day, moment, query, rnd, sql_day, sql_moment, sql_rnd

for _keep, _order in (("first", "event_id"), ("last", "event_id DESC")):

    @query(
        f"cln1_keep_{_keep}",
        f"SELECT user_id, event_type, event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY {_order}) AS rn FROM events) WHERE rn = 1",
    )
    def _(t: Tables, keep=_keep):
        out = cln.remove_duplicates(t.events, ["user_id", "event_type"], keep, ["event_id"])
        return out.select("user_id", "event_type", "event_id")


@query(
    "cln1_keep_none",
    "SELECT user_id, value, COUNT(*) AS n FROM events GROUP BY 1, 2 HAVING COUNT(*) = 1",
)
def _(t: Tables):
    out = cln.remove_duplicates(t.events, ["user_id", "value"], None)
    return out.select("user_id", "value", F.lit(1).cast("long").alias("n"))


@query("cln1_all_columns", "SELECT DISTINCT text, lang FROM documents")
def _(t: Tables):
    return cln.remove_duplicates(t.documents.select("text", "lang"))


@query(
    "cln2_duplicate_members",
    "SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY 1 HAVING COUNT(*) > 1)",
)
def _(t: Tables):
    return cln.duplicate_members(t.documents, ["text"]).select("doc_id")


GAPS_SQL = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, NULLIF(l_discount, 0) AS discount, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linenumber END AS line,
    NULLIF(l_returnflag, 'R') AS flag, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_shipdate END AS shipdate FROM lineitem)"""
ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def gaps(t: Tables):
    return t.lineitem.select(
        *ORDER, F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).alias("line"),
        F.nullif("l_returnflag", F.lit("R")).alias("flag"),
        F.when(F.col("l_suppkey") % 4 != 0, F.col("l_shipdate")).alias("shipdate"),
    )


def fold(df, *columns):
    """Counts per filled value, so that whole tables compare as few rows."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "cln3_fill_constant",
    f"SELECT COALESCE(discount, 0.5) AS discount, COALESCE(flag, 'none') AS flag, COUNT(*) AS rows FROM {GAPS_SQL} GROUP BY ALL",
)
def _(t: Tables):
    return fold(cln.fill_value(gaps(t), {"discount": 0.5, "flag": "none"}), "discount", "flag")


@query(
    "cln4_fill_mean",
    f"""SELECT {sql_rnd('COALESCE(discount, (SELECT AVG(discount) FROM d))', 8)} AS discount, {sql_rnd('COALESCE(line, (SELECT AVG(line) FROM d))', 8)} AS line, COUNT(*) AS rows
        FROM {GAPS_SQL} GROUP BY ALL""".replace("FROM d)", f"FROM {GAPS_SQL})"),
)
def _(t: Tables):
    out = cln.fill_mean(gaps(t), ["discount", "line"])
    return fold(out.select(rnd("discount", 8).alias("discount"), rnd("line", 8).alias("line")), "discount", "line")


@query(
    "cln5_fill_median",
    f"""SELECT {sql_rnd(f'COALESCE(discount, (SELECT MEDIAN(discount) FROM {GAPS_SQL}))', 8)} AS discount, COUNT(*) AS rows FROM {GAPS_SQL} GROUP BY ALL""",
)
def _(t: Tables):
    return fold(cln.fill_median(gaps(t), ["discount"]).select(rnd("discount", 8).alias("discount")), "discount")


@query(
    "cln6_fill_mode",
    f"""WITH d AS (SELECT * FROM {GAPS_SQL}) SELECT COALESCE(flag, (SELECT flag FROM d WHERE flag IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, flag LIMIT 1)) AS flag,
        COALESCE(line, (SELECT line FROM d WHERE line IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, line LIMIT 1)) AS line, COUNT(*) AS rows FROM d GROUP BY ALL""",
)
def _(t: Tables):
    return fold(cln.fill_mode(gaps(t), ["flag", "line"]), "flag", "line")


UNIQUE = "(SELECT *, ROW_NUMBER() OVER (ORDER BY ts, event_id) AS i FROM (SELECT event_id, ts, user_id, CASE WHEN event_id % 3 = 0 OR event_id < 5 THEN NULL ELSE value END AS v, CASE WHEN event_id % 4 = 1 THEN NULL ELSE ts END AS seen FROM events))"


def sparse(t: Tables):
    return t.events.select(
        "event_id", "ts", "user_id", F.when((F.col("event_id") % 3 != 0) & (F.col("event_id") >= 5), F.col("value")).alias("v"),
        F.when(F.col("event_id") % 4 != 1, F.col("ts")).alias("seen"),
    )


@query(
    "cln7_forward_fill",
    f"SELECT event_id, {sql_moment('LAST_VALUE(seen IGNORE NULLS) OVER (ORDER BY i)')} AS seen FROM {UNIQUE}",
)
def _(t: Tables):
    return cln.fill_forward(sparse(t), ["seen"], ["ts", "event_id"]).select("event_id", moment("seen").alias("seen"))


@query(
    "cln8_interpolate",
    f"""WITH n AS (SELECT *, LAST_VALUE(v IGNORE NULLS) OVER a AS pv, LAST_VALUE(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS pi,
          FIRST_VALUE(v IGNORE NULLS) OVER b AS nv, FIRST_VALUE(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ni FROM {UNIQUE}
          WINDOW a AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT event_id, {sql_rnd('CASE WHEN v IS NOT NULL THEN v WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * ((i - pi)::DOUBLE / (ni - pi)) END', 5)} AS v FROM n""",
)
def _(t: Tables):
    return cln.interpolate(sparse(t), ["v"], ["ts", "event_id"]).select("event_id", rnd("v", 5).alias("v"))


@query(
    "cln9_fill_by_type",
    f"SELECT COALESCE(line, 0) AS line, COALESCE(flag, 'Unknown') AS flag, COUNT(*) AS rows FROM {GAPS_SQL} GROUP BY ALL",
)
def _(t: Tables):
    return fold(cln.fill_by_type(gaps(t)), "line", "flag")


@query(
    "cln10_drop_rows",
    f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM {GAPS_SQL} WHERE discount IS NOT NULL AND line IS NOT NULL AND flag IS NOT NULL AND shipdate IS NOT NULL",
)
def _(t: Tables):
    return cln.drop_missing_rows(gaps(t)).select(*ORDER)


@query("cln11_drop_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem")
def _(t: Tables):
    return cln.drop_missing_columns(gaps(t))


@query(
    "cln12_auto_strategies",
    """SELECT * FROM (VALUES ('l_orderkey', 'none'), ('discount', 'mean'), ('line', 'mean'), ('flag', 'mode'), ('shipdate', 'forward'), ('mostly_null', 'drop_column'), ('skewed', 'median')) v("column", strategy)""",
)
def _(t: Tables):
    df = gaps(t).withColumns(
        {
            "mostly_null": F.when(F.col("l_linenumber") == 1, F.col("line")),
            "skewed": F.when(F.col("l_linenumber") < 5, F.pow(F.lit(10.0), F.col("l_linenumber") * 2)),
        }
    )
    chosen = cln.choose_strategies(df, ["l_orderkey", "discount", "line", "flag", "shipdate", "mostly_null", "skewed"])
    return t.spark.createDataFrame(list(chosen.items()), "column string, strategy string")


@query(
    "cln13_imputation_report",
    f"""SELECT 'discount' AS "column", 'mean' AS strategy, COUNT(*) - COUNT(discount) AS missing_count, {sql_rnd('100.0 - 100.0 * COUNT(discount) / COUNT(*)')} AS missing_percent FROM {GAPS_SQL}
        UNION ALL SELECT 'flag', 'mode', COUNT(*) - COUNT(flag), {sql_rnd('100.0 - 100.0 * COUNT(flag) / COUNT(*)')} FROM {GAPS_SQL}
        UNION ALL SELECT 'shipdate', 'forward', COUNT(*) - COUNT(shipdate), {sql_rnd('100.0 - 100.0 * COUNT(shipdate) / COUNT(*)')} FROM {GAPS_SQL}""",
)
def _(t: Tables):
    done = cln.impute(gaps(t), columns=["discount", "flag", "shipdate"], order_by=ORDER)
    return done.report.select("column", "strategy", "missing_count", rnd("missing_percent").alias("missing_percent"))


@query(
    "cln13_imputed_nulls",
    f"""WITH f AS (SELECT line, LAST_VALUE(shipdate IGNORE NULLS) OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS s FROM {GAPS_SQL})
        SELECT 0::BIGINT AS discount, 0::BIGINT AS flag, COUNT(*) - COUNT(line) AS line, COUNT(*) - COUNT(s) AS shipdate FROM f""",
)
def _(t: Tables):
    data = cln.impute(gaps(t), columns=["discount", "flag", "shipdate"], order_by=ORDER).data
    names = ("discount", "flag", "line", "shipdate")
    return data.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])


def texts(t: Tables):
    key = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        key.cast("string").alias("whole"),
        F.concat(key.cast("string"), F.lit(".5")).alias("fraction"),
        F.when(key % 2 == 0, "yes").otherwise("No").alias("paid"),
        F.concat(F.lit("$"), F.format_number(key.cast("double"), 2)).alias("price"),
        F.concat((key % 1000).cast("string"), F.lit("."), (key % 997).cast("string"), F.lit("%")).alias("rate"),
        F.concat(F.lit("k"), (key % 1000).cast("string")).alias("kind"),
        F.concat(F.lit("note "), key.cast("string")).alias("note"),
    )


@query(
    "cln14_type_detection",
    """SELECT * FROM (VALUES ('day', 'datetime'), ('whole', 'integer'), ('fraction', 'float'), ('paid', 'boolean'), ('price', 'currency'),
       ('kind', 'categorical'), ('note', 'unknown'), ('rate', 'percentage')) v("column", detected_type)""",
)
def _(t: Tables):
    found = cln.detect_types(texts(t).drop("o_orderkey")).report
    return found.select("column", "detected_type")


@query(
    "cln15_conversions",
    "SELECT o_orderkey, o_orderkey % 2 = 0 AS paid, o_orderkey::DOUBLE AS price, (o_orderkey % 1000)::DOUBLE / 100 AS rate FROM orders",
)
def _(t: Tables):
    df = texts(t)
    percent = F.concat((F.col("o_orderkey") % 1000).cast("string"), F.lit("%"))
    return df.select(
        "o_orderkey", cln.to_boolean(F.col("paid")).alias("paid"), cln.currency_to_number(F.col("price")).alias("price"),
        cln.percentage_to_number(percent).alias("rate"),
    )


@query(
    "cln16_conversion_report",
    """SELECT 'amount' AS "column", 'integer' AS detected_type, COUNT(*) FILTER (WHERE o_orderkey % 10 > 0) AS converted_rows, COUNT(*) FILTER (WHERE o_orderkey % 10 = 0) AS failed_rows FROM orders""",
)
def _(t: Tables):
    amount = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("bad"), "o_orderkey")).otherwise(F.col("o_orderkey").cast("string"))
    out = cln.detect_types(t.orders.select(amount.alias("amount"))).report
    return out.select("column", "detected_type", "converted_rows", "failed_rows")


def european(t: Tables):
    mixed = F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    return t.orders.select("o_orderkey", mixed.alias("ordered"))


@query(
    "cln17_standardised_dates",
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN {sql_day('o_orderdate')} END AS ordered, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%m/%d/%Y') END AS ordered_formatted FROM orders",
)
def _(t: Tables):
    out = dt.standardise_dates(european(t), ["ordered"], "us").data
    return out.select("o_orderkey", day("ordered").alias("ordered"), "ordered_formatted")


@query(
    "cln17_date_report",
    f"""SELECT 'ordered' AS "column", 'format_specific' AS method, 'dd.MM.yyyy' AS format, {sql_rnd('AVG((o_orderkey % 5 > 0)::INT)', 6)} AS success_rate,
        COUNT(*) FILTER (WHERE o_orderkey % 5 > 0) AS converted_rows, COUNT(*) FILTER (WHERE o_orderkey % 5 = 0) AS failed_rows FROM orders""",
)
def _(t: Tables):
    out = dt.standardise_dates(european(t), ["ordered"]).report
    return out.drop("output_format").withColumn("success_rate", rnd("success_rate", 6))


@query("cln18_date_columns", """SELECT * FROM (VALUES ('o_orderdate'), ('day')) v("column")""")
def _(t: Tables):
    df = t.orders.select("o_orderdate", "o_orderpriority", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    return t.spark.createDataFrame([(c,) for c in dt.detect_date_columns(df)], "column string")


@query(
    "cln19_split_column",
    "SELECT p_partkey, split_part(p_name, ' ', 1) AS p_name_part1, NULLIF(split_part(p_name, ' ', 2), '') AS p_name_part2 FROM part",
)
def _(t: Tables):
    return cln.split_column(t.part.select("p_partkey", "p_name")).data


@query(
    "cln19_split_report",
    "SELECT 'code' AS \"column\", '/' AS delimiter, 'code_part1, code_part2, code_part3' AS new_columns, COUNT(*) AS rows, COUNT(*) FILTER (WHERE p_partkey % 4 = 0) AS gaps FROM part",
)
def _(t: Tables):
    third = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_size").cast("string"))
    code = F.concat_ws("/", "p_type", F.replace("p_brand", F.lit("#"), F.lit("")), third)
    r = cln.split_column(t.part.select(code.alias("code"))).report
    row = (r["column"], r["delimiter"], ", ".join(r["new_columns"]), r["rows"], r["rows_with_missing_parts"])
    return t.spark.createDataFrame([row], "column string, delimiter string, new_columns string, rows long, gaps long")


_Z = "(SELECT *, ABS((value - (SELECT AVG(value) FROM events)) / (SELECT STDDEV_SAMP(value) FROM events)) > 3 AS hit FROM events)"


@query("cln20_z_score_flags", f"SELECT event_id, hit AS value_is_outlier FROM {_Z}")
def _(t: Tables):
    return cln.z_score_outliers(t.events, ["value"]).data.select("event_id", "value_is_outlier")


@query(
    "cln20_z_score_report",
    f"""SELECT 'value' AS "column", COUNT(*) FILTER (WHERE hit) AS count, {sql_rnd('100.0 * COUNT(*) FILTER (WHERE hit) / COUNT(*)')} AS percentage,
        MIN(value) FILTER (WHERE hit) AS min_value, MAX(value) FILTER (WHERE hit) AS max_value, {sql_rnd('AVG(value)')} AS data_mean, {sql_rnd('STDDEV_SAMP(value)')} AS data_std FROM {_Z}""",
)
def _(t: Tables):
    out = cln.z_score_outliers(t.events, ["value"]).report
    return out.withColumns({c: rnd(c) for c in ("percentage", "data_mean", "data_std")})


@query(
    "cln20_z_score_calendar",
    f"""SELECT 'value' AS "column", CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(month(ts) AS INTEGER) AS month, COUNT(*) AS count FROM {_Z} WHERE hit GROUP BY ALL""",
)
def _(t: Tables):
    return cln.z_score_outliers(t.events, ["value"]).calendar


@query(
    "cln21_impossible_values",
    f"""SELECT 'age < 18 and income > 100000' AS rule, COUNT(*) FILTER (WHERE c_custkey % 80 < 18 AND c_acctbal * 20 > 100000) AS violations,
        {sql_rnd('100.0 * COUNT(*) FILTER (WHERE c_custkey % 80 < 18 AND c_acctbal * 20 > 100000) / COUNT(*)')} AS percentage FROM customer""",
)
def _(t: Tables):
    people = t.customer.select((F.col("c_custkey") % 80).alias("age"), (F.col("c_acctbal") * 20).alias("income"))
    return cln.impossible_values(people, cln.age_income_rules(people)).withColumn("percentage", rnd("percentage"))


@query(
    "cln22_temporal_anomalies",
    f"""WITH d AS (SELECT CASE WHEN o_orderkey % 100 = 0 THEN o_orderdate - INTERVAL 120 YEAR ELSE o_orderdate END AS d FROM orders)
        SELECT 'future_date' AS anomaly, COUNT(*) FILTER (WHERE d > TIMESTAMP '2001-01-02') AS count, {sql_rnd("100.0 * COUNT(*) FILTER (WHERE d > TIMESTAMP '2001-01-02') / COUNT(*)")} AS percentage FROM d
        UNION ALL SELECT 'historical_date', COUNT(*) FILTER (WHERE d < TIMESTAMP '1900-01-01'), {sql_rnd("100.0 * COUNT(*) FILTER (WHERE d < TIMESTAMP '1900-01-01') / COUNT(*)")} FROM d""",
)
def _(t: Tables):
    d = F.when(F.col("o_orderkey") % 100 == 0, F.col("o_orderdate") - F.expr("INTERVAL 120 YEAR")).otherwise(F.col("o_orderdate"))
    return cln.temporal_anomalies(t.orders.select(d.alias("d")), "d", "2001-01-01").withColumn("percentage", rnd("percentage"))


@query(
    "cln23_midnight_pattern",
    f"""SELECT COUNT(*) FILTER (WHERE hour(ts) = 0) AS count, {sql_rnd('100.0 * COUNT(*) FILTER (WHERE hour(ts) = 0) / COUNT(*)')} AS percentage,
        {sql_rnd('AVG(value) FILTER (WHERE hour(ts) = 0)')} AS avg_value FROM events""",
)
def _(t: Tables):
    out = cln.midnight_pattern(t.events, "ts", "value")
    return out.withColumns({"percentage": rnd("percentage"), "avg_value": rnd("avg_value")})


@query(
    "cln36_numeric_coercion",
    "SELECT event_id, CASE WHEN event_id % 10 > 0 THEN value END AS v, true AS success FROM events",
)
def _(t: Tables):
    v = F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.col("value").cast("string"))
    out, success = cln.numeric_or_fail(t.events.select("event_id", v.alias("v")), "v")
    return out.withColumn("success", F.lit(success))
