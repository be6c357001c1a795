"""Derived columns that need only the values of their own row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillfen.session import clock_micros, ratio, rounded

Value = Column | str


def _c(value: Value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _change(new: Value, old: Value) -> Column:
    return ratio(_c(new).cast("double") - _c(old).cast("double"), _c(old)) * 100


def _days(later: Value, earlier: Value) -> Column:
    """Whole days between two moments, rounded down."""
    micros = clock_micros(_c(later)) - clock_micros(_c(earlier))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


def _bins(value: Value, edges: list[float], labels: list[str], right: bool = True) -> Column:
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        inside = (_c(value) > low) & (_c(value) <= high) if right else (_c(value) >= low) & (_c(value) < high)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


# ---- time series ---------------------------------------------------------------------


def year_over_year_growth(current: Value, last_year: Value) -> Column:
    return _change(current, last_year)


def days_since(date: Value, as_of: Column) -> Column:
    return _days(as_of, date)


# ---- finance ---------------------------------------------------------------------------


def profit_margin(revenue: Value, cost: Value) -> Column:
    return rounded(ratio(_c(revenue) - _c(cost), _c(revenue)) * 100, 2)


def return_on_investment(ending: Value, investment: Value) -> Column:
    return rounded(_change(ending, investment), 2)


def cagr(ending: Value, starting: Value, years: Value) -> Column:
    return (F.pow(ratio(_c(ending), _c(starting)), ratio(F.lit(1.0), _c(years))) - 1) * 100


def markup(price: Value, cost: Value) -> Column:
    return rounded(_change(price, cost), 2)


def discount_percentage(original: Value, sale: Value) -> Column:
    return rounded(ratio(_c(original) - _c(sale), _c(original)) * 100, 2)


def customer_lifetime_value(order_value: Value, frequency: Value, lifespan: Value) -> Column:
    return _c(order_value) * _c(frequency) * _c(lifespan)


def customer_acquisition_cost(spend: Value, customers: Value) -> Column:
    return ratio(_c(spend), _c(customers))


def ltv_cac_ratio(order_value: Value, frequency: Value, lifespan: Value, spend: Value, customers: Value) -> Column:
    value = customer_lifetime_value(order_value, frequency, lifespan)
    return ratio(value, customer_acquisition_cost(spend, customers))


def unit_contribution(price: Value, variable_cost: Value) -> Column:
    return _c(price) - _c(variable_cost)


def break_even_units(fixed_costs: Value, price: Value, variable_cost: Value) -> Column:
    return ratio(_c(fixed_costs), unit_contribution(price, variable_cost))


def conversion_rate(conversions: Value, visitors: Value) -> Column:
    return F.coalesce(rounded(ratio(_c(conversions), _c(visitors)) * 100, 2), F.lit(0.0))


def average_order_value(revenue: Value, orders: Value) -> Column:
    return ratio(_c(revenue), _c(orders))


# ---- statistics --------------------------------------------------------------------------


def log_transform(value: Value) -> Column:
    return F.ln(_c(value) + 1)


def square_root(value: Value) -> Column:
    return F.when(_c(value) >= 0, F.sqrt(_c(value)))


def change_from_baseline(value: Value, baseline: Value) -> Column:
    return rounded(_change(value, baseline), 2)


# ---- dates -----------------------------------------------------------------------------------


def age_years(birth: Value, as_of: Column) -> Column:
    return _days(as_of, birth) / 365.25


def days_between(start: Value, end: Value) -> Column:
    return _days(end, start)


def business_days(start: Value, end: Value) -> Column:
    """Monday-to-Friday days in [start, end)."""

    def weekdays_before(date: Value) -> Column:
        day = F.unix_date(F.to_date(_c(date))) + 3  # day 0 was a Monday
        return F.floor(day / 7) * 5 + F.least(F.pmod(day, F.lit(7)), F.lit(5))

    return (weekdays_before(end) - weekdays_before(start)).cast("long")


def year_month(date: Value) -> Column:
    return F.date_format(_c(date), "yyyy-MM")


def day_of_week(date: Value) -> Column:
    return F.weekday(_c(date))


def is_weekend(date: Value) -> Column:
    return F.weekday(_c(date)) >= 5


def days_until_month_end(date: Value) -> Column:
    return F.datediff(F.last_day(_c(date)), F.to_date(_c(date)))


def calendar_quarter(date: Value) -> Column:
    return F.quarter(_c(date))


def fiscal_quarter(date: Value) -> Column:
    return (F.floor(F.pmod(F.month(_c(date)) - 4, F.lit(12)) / 3) + 1).cast("int")


def hours_worked(start: Value, end: Value) -> Column:
    micros = clock_micros(_c(end)) - clock_micros(_c(start))
    return micros / F.lit(3.6e9)


def week_number(date: Value) -> Column:
    return F.weekofyear(_c(date))


def is_month_end(date: Value) -> Column:
    return F.to_date(_c(date)) == F.last_day(_c(date))


# ---- text -------------------------------------------------------------------------------------


def _words(text: Value) -> Column:
    return F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")


def first_name(text: Value) -> Column:
    return F.get(_words(text), F.lit(0))


def email_domain(text: Value) -> Column:
    return F.element_at(F.split(_c(text), "@"), -1)


def phone_digits(text: Value) -> Column:
    return F.regexp_replace(_c(text), r"\D", "")


def has_keyword(text: Value, keyword: str = "urgent") -> Column:
    return F.coalesce(F.lower(_c(text)).contains(keyword.lower()), F.lit(False))


def word_count(text: Value) -> Column:
    return F.size(_words(text))


def first_number(text: Value) -> Column:
    return F.regexp_extract(_c(text), r"(\d+)", 1).try_cast("double")


def title_case(text: Value) -> Column:
    from quillfen.functions.text import title_case as title

    return title(_c(text))


def stripped(text: Value) -> Column:
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def full_name(first: Value, last: Value) -> Column:
    return F.concat(_c(first), F.lit(" "), _c(last))


def obfuscated_email(text: Value) -> Column:
    at = F.instr(_c(text), F.lit("@"))
    # Without an @ the last character is shown, as a slice from -1 does.
    tail = F.when(at > 0, F.substr(_c(text), at)).otherwise(F.right(_c(text), F.lit(1)))
    return F.concat(F.substring(_c(text), 1, 3), F.lit("***"), tail)


def url_domain(text: Value) -> Column:
    return F.regexp_replace(_c(text), r"https?://(www\.)?([^/]+).*", "$2")


def text_length(text: Value) -> Column:
    return F.length(_c(text))


# ---- rules ---------------------------------------------------------------------------------------


def pass_fail(score: Value, limit: float = 50) -> Column:
    return F.when(_c(score) > limit, "Pass").otherwise("Fail")


def letter_grade(score: Value) -> Column:
    return F.when(_c(score) >= 90, "A").when(_c(score) >= 80, "B").when(_c(score) >= 70, "C").otherwise("F")


def any_true(*flags: Value) -> Column:
    out = F.lit(False)
    for flag in flags:
        out = out | F.coalesce(_c(flag) == F.lit(True), F.lit(False))
    return out


def all_equal(value, *columns: Value) -> Column:
    out = F.lit(True)
    for column in columns:
        out = out & F.coalesce(_c(column) == F.lit(value), F.lit(False))
    return out


def recently_active(date: Value, as_of: Column, days: int = 30) -> Column:
    return F.coalesce(_days(as_of, date) <= days, F.lit(False))


def within_range(value: Value, low: Value, high: Value) -> Column:
    return F.coalesce(_c(value).between(_c(low), _c(high)), F.lit(False))


def _weighted(*parts: tuple[Value, float]) -> Column:
    return rounded(sum((_c(v) * w for v, w in parts[1:]), _c(parts[0][0]) * parts[0][1]), 2)


def weighted_score(a: Value, b: Value, c: Value) -> Column:
    return _weighted((a, 0.4), (b, 0.3), (c, 0.3))


def urgency_score(overdue: Value, severity: Value, impact: Value) -> Column:
    return _weighted((overdue, 0.5), (severity, 0.3), (impact, 0.2))


def tier(score: Value) -> Column:
    return _bins(score, [0, 60, 80, 90, 100], ["D", "C", "B", "A"])


def inverted(flag: Value) -> Column:
    return ~_c(flag)


def equals_as_int(value: Value, wanted: str = "Completed") -> Column:
    return F.coalesce((_c(value) == wanted).cast("int"), F.lit(0))


# ---- arithmetic -------------------------------------------------------------------------------------


def percentage_change(new: Value, old: Value) -> Column:
    return F.coalesce(rounded(_change(new, old), 2), F.lit(0.0))


def safe_ratio(numerator: Value, denominator: Value) -> Column:
    return ratio(_c(numerator), _c(denominator))


def compound_interest(principal: Value, rate: Value, periods: Value, years: Value) -> Column:
    return _c(principal) * F.pow(1 + ratio(_c(rate), _c(periods)), _c(periods) * _c(years))


def euclidean_distance(x1: Value, y1: Value, x2: Value, y2: Value) -> Column:
    return F.sqrt(F.pow(_c(x2) - _c(x1), 2) + F.pow(_c(y2) - _c(y1), 2))


def round_to(value: Value, step: float = 5) -> Column:
    return F.rint(_c(value) / step) * step


def ceil_to(value: Value, step: float = 10) -> Column:
    return (F.ceil(_c(value) / step) * step).cast("double")


def floor_to(value: Value, step: float = 100) -> Column:
    return (F.floor(_c(value) / step) * step).cast("double")


def absolute_difference(a: Value, b: Value) -> Column:
    return F.abs(_c(a) - _c(b))


def sign(value: Value) -> Column:
    return F.signum(_c(value))


def logit(probability: Value) -> Column:
    return F.ln(ratio(_c(probability), 1 - _c(probability)))


# ---- scores -------------------------------------------------------------------------------------------


def recency_score(date: Value, as_of: Column) -> Column:
    return ratio(F.lit(1.0), _days(as_of, date) + 1)


def rfm_score(recency: Value, frequency: Value, monetary: Value) -> Column:
    return _weighted((recency, 0.4), (frequency, 0.3), (monetary, 0.3))


def churn_risk(inactive: Value, complaints: Value, satisfaction: Value) -> Column:
    return _weighted((inactive, 0.5), (complaints, 0.3), (1 - _c(satisfaction), 0.2))


def cohort_retention(active: Value, size: Value) -> Column:
    return ratio(_c(active), _c(size)) * 100


# ---- validation ------------------------------------------------------------------------------------------


def age_group(age: Value) -> Column:
    return _bins(age, [0, 18, 35, 50, 65, 100], ["<18", "18-35", "36-50", "51-65", "65+"])


def time_of_day(hour: Value) -> Column:
    return _bins(hour, [0, 6, 12, 18, 24], ["Night", "Morning", "Afternoon", "Evening"], right=False)


def out_of_bounds(value: Value, low: Value, high: Value) -> Column:
    return F.coalesce(_c(value) < _c(low), F.lit(False)) | F.coalesce(_c(value) > _c(high), F.lit(False))


def yes_no(text: Value) -> Column:
    return F.when(_c(text) == "Yes", 1).otherwise(0)


def one_hot(value: Value, category: str = "A") -> Column:
    return equals_as_int(value, category)


def in_order(start: Value, end: Value) -> Column:
    return F.coalesce(_c(end) >= _c(start), F.lit(False))


def date_matches_text(date: Value, text: Value) -> Column:
    return F.coalesce(F.date_format(_c(date), "yyyy-MM-dd") == _c(text), F.lit(False))
