"""Queries of the derived-column catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfen.functions import calc as c
from quillfen.operators import calc as op
from quillfen.plans.registry import Tables, moment, query, rnd, sql_rnd

AS_OF_SQL = "TIMESTAMP '2002-01-01'"


def finish(df: DataFrame, key: str, digits: int | None) -> DataFrame:
    result = F.col("result")
    kind = df.schema["result"].dataType.simpleString()
    if digits is not None:
        result = rnd(result, digits)
    elif kind in ("timestamp_ntz", "timestamp"):
        result = moment(result)
    elif kind in ("int", "smallint"):
        result = result.cast("long")
    return df.select(key, result.alias("result"))


def plain(name: str, table: str, key: str, column: Callable[[], Column], sql: str, digits: int | None = None) -> None:
    """A stateless column over a whole table."""
    value = sql_rnd(sql, digits) if digits is not None else sql

    @query(f"fx{name}", f"SELECT {key}, {value} AS result FROM {table}")
    def _(t: Tables):
        return finish(getattr(t, table).withColumn("result", column()), key, digits)


def derived(name: str, table: str, key: str, build: Callable[[DataFrame], DataFrame], sql: str, digits: int | None = None, source: str | None = None) -> None:
    """A column that needs the table, a group or an order."""
    value = sql_rnd(sql, digits) if digits is not None else sql

    @query(f"fx{name}", f"SELECT {key}, {value} AS result FROM {source or table}")
    def _(t: Tables):
        return finish(build(getattr(t, table)), key, digits)


class Values:
    """The bound columns, built when a query runs."""

    key = property(lambda self: F.col("o_orderkey"))
    price = property(lambda self: F.col("o_totalprice"))
    cost = property(lambda self: (self.key % 1000 * 100).cast("double"))
    later = property(lambda self: F.col("o_orderdate") + F.make_dt_interval((self.key % 90).cast("int"), F.lit(5)))
    score = property(lambda self: self.key % 101)
    gaps = property(lambda self: F.when(F.col("event_id") % 3 > 0, F.col("value")))
    as_of = property(lambda self: F.lit("2002-01-01").cast("timestamp_ntz"))


v = Values()

# Bindings: revenue = o_totalprice, cost-like values come from the keys.
O, E, P = ("orders", "o_orderkey"), ("events", "event_id"), ("part", "p_partkey")
COST_SQL = "(o_orderkey % 1000 * 100)::DOUBLE"
EV = "ts, event_id"
EVENT_ORDER = ["ts", "event_id"]


def div(a: str, b: str) -> str:
    return f"({a}) / NULLIF(({b})::DOUBLE, 0)"


def change(new: str, old: str) -> str:
    return f"(({new}) - ({old})) / NULLIF(({old})::DOUBLE, 0) * 100"


# 1-10 time series
derived("1_moving_average", *E, lambda d: op.moving_average(d, "value", "result", EVENT_ORDER), f"AVG(value) OVER (ORDER BY {EV} ROWS 2 PRECEDING)", 4)
plain("3_year_over_year", *O, lambda: c.year_over_year_growth(v.price, v.cost), change("o_totalprice", COST_SQL), 4)
derived("4_month_over_month", *E, lambda d: op.change(d, "value", "result", EVENT_ORDER), f"value - LAG(value) OVER (ORDER BY {EV})", 4)
derived("5_cumulative_sum", *E, lambda d: op.cumulative_sum(d, "value", "result", EVENT_ORDER), f"SUM(value) OVER (ORDER BY {EV})", 3)
derived("6_contribution", *E, lambda d: op.contribution(d, "value", "result"), "value / SUM(value) OVER () * 100", 6)
derived("7_daily_returns", *E, lambda d: op.returns(d, "value", "result", EVENT_ORDER), f"(value / LAG(value) OVER (ORDER BY {EV}) - 1) * 100", 3)
derived("8_rolling_sum", *E, lambda d: op.rolling_sum(d, "value", "result", EVENT_ORDER), f"SUM(value) OVER (ORDER BY {EV} ROWS 6 PRECEDING)", 4)
derived(
    "9_seasonality_index", *O, lambda d: op.seasonality_index(d.withColumn("last", v.cost), "o_totalprice", "last", "o_orderdate", "result"),
    f"(o_totalprice / AVG({COST_SQL}) OVER (PARTITION BY month(o_orderdate)) - 1) * 100", 5,
)
plain("10_days_since_activity", *O, lambda: c.days_since("o_orderdate", v.as_of), f"datediff('day', o_orderdate, {AS_OF_SQL})")

# 11-22 finance
plain("11_profit_margin", *O, lambda: c.profit_margin(v.price, v.cost), f"round_even((o_totalprice - {COST_SQL}) / o_totalprice * 100, 2)", 2)
plain("12_roi", *O, lambda: c.return_on_investment(v.price, v.cost), f"round_even({change('o_totalprice', COST_SQL)}, 2)", 2)
plain("13_cagr", *O, lambda: c.cagr(v.price, v.cost, v.key % 7 + 1), f"(POW({div('o_totalprice', COST_SQL)}, 1.0::DOUBLE / (o_orderkey % 7 + 1)) - 1) * 100", 5)
plain("14_markup", *O, lambda: c.markup(v.price, v.cost), f"round_even({change('o_totalprice', COST_SQL)}, 2)", 2)
plain("15_discount_percentage", *O, lambda: c.discount_percentage(v.cost, v.price), f"round_even({div(f'{COST_SQL} - o_totalprice', COST_SQL)} * 100, 2)", 2)
plain("16_lifetime_value", *O, lambda: c.customer_lifetime_value(v.price, v.key % 12, v.key % 5), "o_totalprice * (o_orderkey % 12) * (o_orderkey % 5)", 4)
plain("17_acquisition_cost", *O, lambda: c.customer_acquisition_cost(v.price, v.key % 9), div("o_totalprice", "o_orderkey % 9"), 4)
plain(
    "18_ltv_cac", *O, lambda: c.ltv_cac_ratio(v.price, v.key % 12, v.key % 5, v.cost, v.key % 9),
    div("o_totalprice * (o_orderkey % 12) * (o_orderkey % 5)", div(COST_SQL, "o_orderkey % 9")), 4,
)
plain("19_unit_contribution", *O, lambda: c.unit_contribution(v.price, v.cost), f"o_totalprice - {COST_SQL}", 4)
plain("20_break_even", *O, lambda: c.break_even_units(v.cost, F.lit(50), v.key % 51), div(COST_SQL, "50 - o_orderkey % 51"), 4)
plain("21_conversion_rate", *O, lambda: c.conversion_rate(v.key % 7, v.key % 11), f"COALESCE(round_even({div('o_orderkey % 7', 'o_orderkey % 11')} * 100, 2), 0)", 2)
plain("22_order_value", *O, lambda: c.average_order_value(v.price, v.key % 11), div("o_totalprice", "o_orderkey % 11"), 4)

# 23-33 statistics
derived("23_z_score", *E, lambda d: op.z_score(d, "value", "result"), "(value - AVG(value) OVER ()) / STDDEV_SAMP(value) OVER ()", 6)
derived("24_min_max", *E, lambda d: op.min_max(d, "value", "result"), "(value - MIN(value) OVER ()) / (MAX(value) OVER () - MIN(value) OVER ())", 6)
derived(
    "25_percentile_rank", *E, lambda d: op.percentile_rank(d, "value", "result"),
    "(RANK() OVER (ORDER BY value) + (COUNT(*) OVER (PARTITION BY value) - 1) / 2) / COUNT(*) OVER () * 100", 6,
)
derived("26_outlier_flag", *E, lambda d: op.outlier_flag(d, "value", "result"), "ABS(value - AVG(value) OVER ()) > 3 * STDDEV_SAMP(value) OVER ()")
derived(
    "27_robust_z_score", *E, lambda d: op.robust_z_score(d, "value", "result"),
    "(value - (SELECT MEDIAN(value) FROM events)) / (SELECT AVG(ABS(value - (SELECT AVG(value) FROM events))) FROM events)", 6,
)
plain("28_log", *E, lambda: c.log_transform("value"), "LN(value + 1)", 6)
plain("29_square_root", *E, lambda: c.square_root("value"), "SQRT(value)", 6)
derived("30_top_performer", *E, lambda d: op.top_performer(d, "value", "result"), "value >= (SELECT quantile_cont(value, 0.8) FROM events)")
derived("31_bottom_performer", *E, lambda d: op.bottom_performer(d, "value", "result"), "value <= (SELECT quantile_cont(value, 0.1) FROM events)")
plain("32_change_from_baseline", *O, lambda: c.change_from_baseline(v.price, v.cost), f"round_even({change('o_totalprice', COST_SQL)}, 2)", 2)
derived("33_rolling_volatility", *E, lambda d: op.rolling_volatility(d, "value", "result", EVENT_ORDER), f"STDDEV_SAMP(value) OVER (ORDER BY {EV} ROWS 19 PRECEDING)", 4)

# 34-46 dates
LATER_SQL = "(o_orderdate + to_days((o_orderkey % 90)::INTEGER) + INTERVAL 5 HOUR)"
plain("34_age", *O, lambda: c.age_years("o_orderdate", v.as_of), f"datediff('day', o_orderdate, {AS_OF_SQL}) / 365.25::DOUBLE", 6)
plain("35_days_between", *O, lambda: c.days_between("o_orderdate", v.later), f"datediff('day', o_orderdate, {LATER_SQL})")
plain(
    "36_business_days", *O, lambda: c.business_days("o_orderdate", v.later),
    "(SELECT COUNT(*) FILTER (WHERE isodow(o_orderdate + to_days(i::INTEGER)) < 6) FROM range(o_orderkey % 90) r(i))",
)
plain("37_year_month", *O, lambda: c.year_month("o_orderdate"), "strftime(o_orderdate, '%Y-%m')")
plain("38_day_of_week", *O, lambda: c.day_of_week("o_orderdate"), "isodow(o_orderdate) - 1")
plain("39_weekend", *O, lambda: c.is_weekend("o_orderdate"), "isodow(o_orderdate) > 5")
plain("40_days_until_month_end", *O, lambda: c.days_until_month_end("o_orderdate"), "datediff('day', o_orderdate, last_day(o_orderdate)::TIMESTAMP)")
plain("41_quarter", *O, lambda: c.calendar_quarter("o_orderdate"), "quarter(o_orderdate)")
plain("42_fiscal_quarter", *O, lambda: c.fiscal_quarter("o_orderdate"), "((month(o_orderdate) + 8) % 12) // 3 + 1")
plain("43_hours_worked", *O, lambda: c.hours_worked("o_orderdate", v.later), "(o_orderkey % 90) * 24 + 5", 4)
plain("44_days_since_event", *E, lambda: c.days_since("ts", F.lit("2024-03-01 12:00:00").cast("timestamp_ntz")), "CAST(floor((epoch_us(TIMESTAMP '2024-03-01 12:00:00') - epoch_us(ts)) / 86400e6) AS BIGINT)")
plain("45_week_number", *O, lambda: c.week_number("o_orderdate"), "week(o_orderdate)")
plain("46_month_end", *O, lambda: c.is_month_end("o_orderdate"), "o_orderdate::DATE = last_day(o_orderdate)")

# 47-58 text
plain("47_first_name", *P, lambda: c.first_name(F.concat(F.lit("  "), "p_name")), "split_part(p_name, ' ', 1)")
plain("48_email_domain", *P, lambda: c.email_domain(F.concat(F.lit("a@"), "p_type", F.lit(".com"))), "p_type || '.com'")
plain("49_phone_digits", *P, lambda: c.phone_digits(F.concat(F.lit("+1 (555) "), F.col("p_partkey").cast("string"))), "'1555' || p_partkey")
plain("50_keyword", "documents", "doc_id", lambda: c.has_keyword("text", "Ther"), "contains(lower(text), 'ther')")
plain("51_word_count", "documents", "doc_id", lambda: c.word_count("text"), r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))")
plain("52_first_number", *E, lambda: c.first_number("props"), "TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)", 2)
plain("53_title_case", *P, lambda: c.title_case("p_name"), "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')")
plain("54_stripped", *P, lambda: c.stripped(F.concat(F.lit(" \t"), "p_name", F.lit("\n "))), "p_name")
plain("55_full_name", *P, lambda: c.full_name("p_name", F.nullif("p_type", F.lit("PROMO"))), "CASE WHEN p_type <> 'PROMO' THEN p_name || ' ' || p_type END")
plain("56_obfuscated_email", *P, lambda: c.obfuscated_email(F.concat("p_name", F.lit("@x.org"))), "left(p_name, 3) || '***@x.org'")
plain("57_url_domain", "pages", "page_id", lambda: c.url_domain("url"), r"regexp_replace(url, 'https?://(www\.)?([^/]+).*', '\2')")
plain("58_text_length", "documents", "doc_id", lambda: c.text_length("text"), "length(text)")

# 59-69 groups
G = ["event_type"]
W = "OVER (PARTITION BY event_type"
derived("59_within_group_percentage", *E, lambda d: op.within_group_percentage(d, "value", G, "result"), f"round_even((value / SUM(value) {W}) * 100), 2)", 2)
derived("60_group_rank", *E, lambda d: op.group_rank(d, "value", G, "result"), f"DENSE_RANK() {W} ORDER BY value DESC)")
derived("61_group_deviation", *E, lambda d: op.group_deviation(d, "value", G, "result"), f"value - AVG(value) {W})", 4)
derived("62_group_normalised", *E, lambda d: op.group_normalised(d, "value", G, "result"), f"(value - MIN(value) {W})) / (MAX(value) {W}) - MIN(value) {W}))", 6)
derived("63_cumulative_by_group", *E, lambda d: op.cumulative_sum(d, "value", "result", EVENT_ORDER, G), f"SUM(value) {W} ORDER BY {EV})", 3)
derived("64_sequence_by_group", *E, lambda d: op.sequence_number(d, "result", EVENT_ORDER, G), f"ROW_NUMBER() {W} ORDER BY {EV})")
derived("65_previous_in_group", *E, lambda d: op.previous_value(d, "value", "result", EVENT_ORDER, G), f"LAG(value) {W} ORDER BY {EV})", 4)
derived("66_next_in_group", *E, lambda d: op.next_value(d, "value", "result", EVENT_ORDER, G), f"LEAD(value) {W} ORDER BY {EV})", 4)
derived("67_change_in_group", *E, lambda d: op.returns(d, "value", "result", EVENT_ORDER, G), f"(value / LAG(value) {W} ORDER BY {EV}) - 1) * 100", 3)
derived("68_group_average", *E, lambda d: op.group_average(d, "value", G, "result"), f"AVG(value) {W})", 4)
derived("69_group_top", *E, lambda d: op.group_top(d, "value", G, "result"), f"RANK() {W} ORDER BY value DESC) + (COUNT(*) OVER (PARTITION BY event_type, value) - 1) / 2 <= 3")

# 70-80 rules
SCORE_SQL = "(o_orderkey % 101)"
plain("70_pass_fail", *O, lambda: c.pass_fail(v.score), f"CASE WHEN {SCORE_SQL} > 50 THEN 'Pass' ELSE 'Fail' END")
plain("71_letter_grade", *O, lambda: c.letter_grade(v.score), f"CASE WHEN {SCORE_SQL} >= 90 THEN 'A' WHEN {SCORE_SQL} >= 80 THEN 'B' WHEN {SCORE_SQL} >= 70 THEN 'C' ELSE 'F' END")
plain("72_any_condition", *O, lambda: c.any_true(v.key % 2 == 0, F.nullif(v.key % 3, F.lit(1)) == 0), "(o_orderkey % 2 = 0) OR (o_orderkey % 3 = 0)")
plain("73_all_conditions", *O, lambda: c.all_equal("F", "o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))), "o_orderstatus = 'F'")
plain("74_recently_active", *O, lambda: c.recently_active("o_orderdate", F.lit("2001-08-15").cast("timestamp_ntz")), "datediff('day', o_orderdate, TIMESTAMP '2001-08-15') <= 30")
plain("75_range_check", *O, lambda: c.within_range(v.price, v.cost, v.cost * 2), f"o_totalprice BETWEEN {COST_SQL} AND {COST_SQL} * 2")
plain("76_weighted_score", *O, lambda: c.weighted_score(v.key % 10, v.key % 20, v.key % 30), "round_even((o_orderkey % 10) * 0.4::DOUBLE + (o_orderkey % 20) * 0.3::DOUBLE + (o_orderkey % 30) * 0.3::DOUBLE, 2)", 2)
plain("77_urgency_score", *O, lambda: c.urgency_score(v.key % 10, v.key % 20, v.key % 30), "round_even((o_orderkey % 10) * 0.5::DOUBLE + (o_orderkey % 20) * 0.3::DOUBLE + (o_orderkey % 30) * 0.2::DOUBLE, 2)", 2)
plain("78_tier", *O, lambda: c.tier(v.score), f"CASE WHEN {SCORE_SQL} = 0 THEN NULL WHEN {SCORE_SQL} <= 60 THEN 'D' WHEN {SCORE_SQL} <= 80 THEN 'C' WHEN {SCORE_SQL} <= 90 THEN 'B' ELSE 'A' END")
plain("79_inverted", *O, lambda: c.inverted(v.key % 2 == 0), "o_orderkey % 2 <> 0")
plain("80_condition_count", *O, lambda: c.equals_as_int("o_orderstatus", "F"), "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END::BIGINT")

# 81-92 arithmetic
plain("81_percentage_change", *O, lambda: c.percentage_change(v.price, v.cost), f"COALESCE(round_even({change('o_totalprice', COST_SQL)}, 2), 0)", 2)
plain("82_ratio", *O, lambda: c.safe_ratio(v.price, v.key % 10), div("o_totalprice", "o_orderkey % 10"), 4)
derived("83_weighted_average", "lineitem", "l_linenumber", lambda d: op.weighted_average(d, "l_extendedprice", "l_quantity", "result").select("l_linenumber", "result").distinct(), "(SELECT SUM(l_extendedprice * l_quantity) / SUM(l_quantity) FROM lineitem)", 4, "(SELECT DISTINCT l_linenumber FROM lineitem)")
derived("84_geometric_mean", "lineitem", "l_linenumber", lambda d: op.geometric_mean(d, "l_tax", "result").select("l_linenumber", "result").distinct(), "(SELECT EXP(AVG(LN(1 + l_tax))) - 1 FROM lineitem)", 8, "(SELECT DISTINCT l_linenumber FROM lineitem)")
plain("85_compound_interest", *O, lambda: c.compound_interest(v.price, F.lit(0.05), F.lit(12), v.key % 10), "o_totalprice * POW(1 + 0.05::DOUBLE / 12, 12 * (o_orderkey % 10))", 3)
plain("86_distance", *O, lambda: c.euclidean_distance(v.key % 10, v.key % 11, v.key % 12, v.key % 13), "SQRT(POW(o_orderkey % 12 - o_orderkey % 10, 2) + POW(o_orderkey % 13 - o_orderkey % 11, 2))", 6)
plain("87_round_to_multiple", *O, lambda: c.round_to(v.price), "round_even(o_totalprice / 5, 0) * 5", 2)
plain("88_ceiling_to_multiple", *O, lambda: c.ceil_to(v.price), "CEIL(o_totalprice / 10) * 10", 2)
plain("89_floor_to_multiple", *O, lambda: c.floor_to(v.price), "FLOOR(o_totalprice / 100) * 100", 2)
plain("90_absolute_difference", *O, lambda: c.absolute_difference(v.price, v.cost), f"ABS(o_totalprice - {COST_SQL})", 4)
plain("91_sign", *O, lambda: c.sign(v.price - v.cost * 3), f"SIGN(o_totalprice - {COST_SQL} * 3)", 1)
plain("92_logit", "lineitem", "l_orderkey", lambda: c.logit("l_discount"), "CASE WHEN l_discount > 0 THEN LN(l_discount / (1 - l_discount)) END", 6)

# 93-103 indicators and scores
# In SQL each row sums its predecessors until their weights are below 1e-15.
ROWS_SQL = f"(SELECT event_id, value AS x, ROW_NUMBER() OVER (ORDER BY {EV}) AS i FROM events)"


def weights_sql(span: int, first: str, later: str) -> str:
    keep = f"(1 - 2.0::DOUBLE / ({span} + 1))"
    return f"POW({keep}, a.i - b.i) * (CASE WHEN b.i = 1 THEN {first} ELSE {later} END)"


def ewm_source(depth: int, measures: str) -> str:
    return f"(SELECT a.event_id, {measures} FROM {ROWS_SQL} a JOIN {ROWS_SQL} b ON b.i BETWEEN a.i - {depth} AND a.i GROUP BY a.event_id)"


W7, W20 = weights_sql(7, "1", "0.25::DOUBLE"), weights_sql(20, "1", "2.0::DOUBLE / 21")
W12, W26 = weights_sql(12, "1", "1"), weights_sql(26, "1", "1")
derived("2_exponential_average", *E, lambda d: op.exponential_average(d, "value", "result", EVENT_ORDER), "m", 4, ewm_source(150, f"SUM({W7} * b.x) AS m"))
derived(
    "93_exponential_volatility", *E, lambda d: op.exponential_volatility(d, "value", "result", EVENT_ORDER),
    "CASE WHEN n > 1 THEN SQRT((q - m * m) / (1 - w2)) END", 4,
    ewm_source(400, f"COUNT(*) AS n, SUM({W20} * b.x) AS m, SUM({W20} * b.x * b.x) AS q, SUM(POW({W20}, 2)) AS w2"),
)
derived(
    "96_macd", *E, lambda d: op.macd(d, "value", "result", EVENT_ORDER), "f / fw - s / sw", 4,
    ewm_source(500, f"SUM({W12} * b.x) AS f, SUM({W12}) AS fw, SUM({W26} * b.x) AS s, SUM({W26}) AS sw"),
)
derived("94_sharpe", "lineitem", "l_linenumber", lambda d: op.sharpe_ratio(d, "l_discount", "result").select("l_linenumber", "result").distinct(), "(SELECT AVG(l_discount) / STDDEV_SAMP(l_discount) * SQRT(252) FROM lineitem)", 6, "(SELECT DISTINCT l_linenumber FROM lineitem)")
derived(
    "95_beta", *E, lambda d: op.beta(d.withColumn("market", F.col("user_id").cast("double")), "value", "market", "result", EVENT_ORDER),
    f"CASE WHEN ROW_NUMBER() OVER (ORDER BY {EV}) >= 60 THEN COVAR_SAMP(value, user_id) OVER (ORDER BY {EV} ROWS 59 PRECEDING) / VAR_SAMP(user_id) OVER (ORDER BY {EV} ROWS 59 PRECEDING) END", 4,
)
derived(
    "97_rsi", *E, lambda d: op.rsi(d, "value", "result", EVENT_ORDER),
    "CASE WHEN rn >= 14 THEN 100 - 100 / (1 + g / l) END", 4,
    f"""(SELECT event_id, ROW_NUMBER() OVER w AS rn, AVG(CASE WHEN m > 0 THEN m ELSE 0 END) OVER f AS g, AVG(CASE WHEN m < 0 THEN -m ELSE 0 END) OVER f AS l
        FROM (SELECT *, value - LAG(value) OVER (ORDER BY {EV}) AS m FROM events) WINDOW w AS (ORDER BY {EV}), f AS (ORDER BY {EV} ROWS 13 PRECEDING))""",
)
derived(
    "98_bollinger", *E, lambda d: op.bollinger_position(d, "value", "result", EVENT_ORDER),
    f"CASE WHEN ROW_NUMBER() OVER (ORDER BY {EV}) >= 20 THEN (value - AVG(value) OVER (ORDER BY {EV} ROWS 19 PRECEDING)) / (STDDEV_SAMP(value) OVER (ORDER BY {EV} ROWS 19 PRECEDING) * 2) END", 5,
)
derived(
    "99_purchase_frequency", *O, lambda d: op.days_since_previous(d, "o_orderdate", "result", ["o_orderdate", "o_orderkey"], ["o_custkey"]),
    "datediff('day', LAG(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate)",
)
plain("100_recency_score", *O, lambda: c.recency_score("o_orderdate", v.as_of), f"1.0::DOUBLE / (datediff('day', o_orderdate, {AS_OF_SQL}) + 1)", 8)
plain("101_rfm_score", *O, lambda: c.rfm_score(v.key % 5, v.key % 4, v.key % 3), "round_even((o_orderkey % 5) * 0.4::DOUBLE + (o_orderkey % 4) * 0.3::DOUBLE + (o_orderkey % 3) * 0.3::DOUBLE, 2)", 2)
plain("102_churn_risk", *O, lambda: c.churn_risk(v.key % 50, v.key % 4, v.key % 2), "round_even((o_orderkey % 50) * 0.5::DOUBLE + (o_orderkey % 4) * 0.3::DOUBLE + (1 - o_orderkey % 2) * 0.2::DOUBLE, 2)", 2)
plain("103_cohort_retention", *O, lambda: c.cohort_retention(v.key % 8, v.key % 9), f"{div('o_orderkey % 8', 'o_orderkey % 9')} * 100", 5)

# 104-115 cleaning
GAPS_SQL = "(CASE WHEN event_id % 3 > 0 THEN value END)"
derived("104_median_imputed", *E, lambda d: op.median_imputed(d.withColumn("v", v.gaps), "v", "result"), f"COALESCE({GAPS_SQL}, (SELECT MEDIAN({GAPS_SQL}) FROM events))", 4)
derived(
    "105_winsorised", *E, lambda d: op.winsorised(d, "value", "result"),
    "GREATEST((SELECT quantile_cont(value, 0.05) FROM events), LEAST((SELECT quantile_cont(value, 0.95) FROM events), value))", 4,
)
derived("106_standardised", *E, lambda d: op.standardised(d, "value", "result"), "round_even((value - AVG(value) OVER ()) / STDDEV_SAMP(value) OVER (), 3)", 3)
plain("107_age_group", *O, lambda: c.age_group(v.score), f"CASE WHEN {SCORE_SQL} = 0 THEN NULL WHEN {SCORE_SQL} <= 18 THEN '<18' WHEN {SCORE_SQL} <= 35 THEN '18-35' WHEN {SCORE_SQL} <= 50 THEN '36-50' WHEN {SCORE_SQL} <= 65 THEN '51-65' ELSE '65+' END")
plain("108_time_of_day", *E, lambda: c.time_of_day(F.hour("ts")), "CASE WHEN hour(ts) < 6 THEN 'Night' WHEN hour(ts) < 12 THEN 'Morning' WHEN hour(ts) < 18 THEN 'Afternoon' ELSE 'Evening' END")
plain("109_validation_flag", *O, lambda: c.out_of_bounds(v.price, v.cost, v.cost * 4), f"o_totalprice < {COST_SQL} OR o_totalprice > {COST_SQL} * 4")
derived(
    "110_first_occurrence", *O, lambda d: op.first_occurrence(d, ["o_custkey", "o_orderstatus"], "result", ["o_orderkey"]),
    "ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1",
)
plain("111_boolean_encoding", *O, lambda: c.yes_no(F.when(v.key % 3 == 0, "Yes").when(v.key % 3 == 1, "No")), "CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END::BIGINT")
plain("112_one_hot", *P, lambda: c.one_hot("p_type", "PROMO"), "CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END::BIGINT")
derived("113_max_normalised", *E, lambda d: op.max_normalised(d, "value", "result"), "value / MAX(value) OVER ()", 6)
plain("114_temporal_order", *O, lambda: c.in_order("o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz")), "TIMESTAMP '1998-01-01' >= o_orderdate")
plain("115_type_consistency", *O, lambda: c.date_matches_text("o_orderdate", F.when(v.key % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("?")), "o_orderkey % 2 = 0")
