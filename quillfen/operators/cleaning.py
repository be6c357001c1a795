"""Duplicates, missing values, type detection, splitting and anomalies."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfen.operators.dates import parse_any
from quillfen.operators.frequencies import FEW_VALUES, count_values, value_frequencies
from quillfen.operators.ingest import NUMBER_SHAPE, date_columns, numeric_columns, parse_boolean, parse_number, text_columns, type_group
from quillfen.operators.keyed import keyed_join
from quillfen.operators.ordered import INDEX, Ordered
from quillfen.operators.profile import adjusted_skewness, plain_columns
from quillfen.operators.quantiles import quantiles
from quillfen.session import scalars

# ---- duplicates -------------------------------------------------------------------


def remove_duplicates(
    df: DataFrame, subset: Sequence[str] | None = None, keep: str | None = "first", order_by: Sequence[str] = ()
) -> DataFrame:
    """Keep the first, last or no member of each duplicate group.

    Groups are folded by a partial aggregate, so a group of many copies never
    meets in one task.
    """
    keys = list(subset) if subset else list(df.columns)
    if keep in ("first", "last"):
        if not subset:
            return df.dropDuplicates()
        if not order_by:
            raise ValueError("keeping the first or last row of a subset needs order_by")
        pick = F.min_by if keep == "first" else F.max_by
        row = pick(F.struct(*df.columns), F.struct(*order_by)).alias("_row")
        return df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(row).select("_row.*")
    members = F.count(F.lit(1)).alias("_members")
    row = F.any_value(F.struct(*df.columns)).alias("_row")
    lonely = df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(members, row)
    return lonely.filter("_members = 1").select("_row.*")


def duplicate_members(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """All rows of groups with more than one member."""
    keys = list(subset) if subset else list(df.columns)
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_members")).filter("_members > 1")
    return keyed_join(df, groups, keys, "left_semi")


# ---- missing values ---------------------------------------------------------------

STRATEGIES = ("mean", "median", "mode", "forward", "interpolate", "constant", "drop_rows", "drop_column", "none")


def mode_value(df: DataFrame, column: str):
    """Most frequent non-null value, the smallest one on ties."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    row = counts.orderBy(F.desc("_n"), column).first()
    return None if row is None else row[0]


def fill_value(df: DataFrame, values: dict) -> DataFrame:
    """Fill given columns with constants of their own type."""
    out = {}
    for c, v in values.items():
        out[c] = F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
    return df.withColumns(out) if out else df


def _numbers(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return [c for c in numeric_columns(df) if columns is None or c in columns]


def fill_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = _numbers(df, columns)
    means = scalars(df, **{c: F.avg(c) for c in names}) if names else {}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(means[c])) for c in names}) if names else df


def fill_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = _numbers(df, columns)
    middle = quantiles(df, names, [0.5]) if names else {}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(middle[c][0])) for c in names}) if names else df


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    values = {}
    for c in columns:
        value = mode_value(df, c)
        values[c] = "Unknown" if value is None and isinstance(df.schema[c].dataType, T.StringType) else value
    return fill_value(df, values)


def fill_forward(
    df: DataFrame, columns: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()
) -> DataFrame:
    """Last known value in row order."""
    filled = Ordered(df, order_by, partition_by).last_valid({f"_f_{c}": F.col(c) for c in columns}).result()
    return filled.withColumns({c: F.col(f"_f_{c}") for c in columns}).drop(*[f"_f_{c}" for c in columns])


def interpolate(
    df: DataFrame, columns: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()
) -> DataFrame:
    """Linear by row position; leading nulls stay, trailing nulls take the last value."""
    indexed = Ordered(df, order_by, partition_by).row_index()
    points = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("double").alias("v"), F.col(INDEX).alias("i"))) for c in columns}
    both = indexed.last_valid({f"_p_{c}": p for c, p in points.items()})
    both = both.next_valid({f"_n_{c}": p for c, p in points.items()})
    out, wide = {}, both.df
    for c in columns:
        before, after = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        step = (F.col(INDEX) - before["i"]) / F.nullif((after["i"] - before["i"]).cast("double"), F.lit(0.0))
        between = before["v"] + (after["v"] - before["v"]) * step
        out[c] = F.when(F.col(c).isNotNull(), F.col(c).cast("double")).when(before.isNull(), F.lit(None)).when(
            after.isNull(), before["v"]
        ).otherwise(between)
    wide = wide.withColumns(out).drop(*[f"_{k}_{c}" for c in columns for k in "pn"])
    return both._with(wide).result()


def fill_by_type(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """0 for numbers, `Unknown` for text."""
    names = columns or df.columns
    values = {}
    for c in names:
        group = type_group(df.schema[c].dataType)
        if group in ("numeric", "text"):
            values[c] = 0 if group == "numeric" else "Unknown"
    return fill_value(df, values)


def drop_missing_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(columns) if columns else None)


def _null_counts(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, int]]:
    row = df.agg(F.count(F.lit(1)), *[F.count_if(F.col(f"`{c}`").isNull()) for c in columns]).first()
    return row[0], dict(zip(columns, row[1:]))


def drop_missing_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    _, nulls = _null_counts(df, list(columns or df.columns))
    return df.drop(*[c for c, n in nulls.items() if n])


def choose_strategies(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    """none / drop_column above 50 % / median for skewed, else mean / forward for dates / mode."""
    names = list(columns or df.columns)
    rows, nulls = _null_counts(df, names)
    skewed = [c for c in names if 20 < 100 * nulls[c] / max(rows, 1) <= 50 and c in numeric_columns(df)]
    skews = scalars(df, **{c: adjusted_skewness(F.col(c).cast("double")) for c in skewed}) if skewed else {}
    out = {}
    for c in names:
        percent, group = 100.0 * nulls[c] / max(rows, 1), type_group(df.schema[c].dataType)
        if not nulls[c]:
            out[c] = "none"
        elif percent > 50:
            out[c] = "drop_column"
        elif group == "numeric":
            out[c] = "median" if c in skews and abs(skews[c] or 0.0) > 1 else "mean"
        else:
            out[c] = "forward" if group == "datetime" else "mode"
    return out


class Imputation(NamedTuple):
    data: DataFrame
    report: DataFrame
    summary: dict


def impute(
    df: DataFrame, strategy: str = "auto", columns: Sequence[str] | None = None, order_by: Sequence[str] = ()
) -> Imputation:
    """Fill or drop missing values and report what was done per column."""
    names = list(columns or df.columns)
    rows, nulls = _null_counts(df, names)
    plan = choose_strategies(df, names) if strategy == "auto" else {c: strategy if nulls[c] else "none" for c in names}
    groups = {c: type_group(df.schema[c].dataType) for c in names}
    for c in names:  # strategies that do not apply to a column's type leave it alone
        if plan[c] in ("mean", "median", "interpolate") and groups[c] != "numeric":
            plan[c] = "skipped"
        if plan[c] == "forward" and groups[c] != "datetime" and "date" not in c.lower():
            plan[c] = "skipped"
    chosen = {s: [c for c in names if plan[c] == s] for s in set(plan.values())}
    values: dict = {}
    if chosen.get("mean"):
        values.update(scalars(df, **{c: F.avg(c) for c in chosen["mean"]}))
    if chosen.get("median"):
        values.update({c: v[0] for c, v in quantiles(df, chosen["median"], [0.5]).items()})
    for c in chosen.get("mode", []):
        value = mode_value(df, c)
        values[c] = "Unknown" if value is None and groups[c] == "text" else value
    for c in chosen.get("constant", []):
        if groups[c] in ("numeric", "text"):
            values[c] = 0 if groups[c] == "numeric" else "Unknown"
    filled = {
        c: F.coalesce(F.col(c), F.lit(v) if plan[c] in ("mean", "median") else F.lit(v).cast(df.schema[c].dataType))
        for c, v in values.items()
    }
    data = df.withColumns(filled) if filled else df
    if chosen.get("forward") or chosen.get("interpolate"):
        if not order_by:
            raise ValueError("forward fill and interpolation need order_by")
        if chosen.get("forward"):
            data = fill_forward(data, chosen["forward"], order_by)
        if chosen.get("interpolate"):
            data = interpolate(data, chosen["interpolate"], order_by)
    data = data.drop(*chosen.get("drop_column", []))
    if chosen.get("drop_rows"):
        data = data.dropna("any")
    report = [(c, plan[c], nulls[c], 100.0 * nulls[c] / max(rows, 1), None if values.get(c) is None else str(values[c])[:50]) for c in names]
    left = [c for c in names if c in data.columns]
    final_rows, final = _null_counts(data, left) if left else (rows, {})
    before, after = sum(nulls.values()), sum(final.values())
    summary = {
        "original_rows": rows, "final_rows": final_rows, "original_missing": before, "final_missing": after,
        "missing_reduction": 100.0 * (before - after) / before if before else 0.0,
        "columns_dropped": len(chosen.get("drop_column", [])),
    }
    schema = "column string, strategy string, missing_count long, missing_percent double, value string"
    return Imputation(data.select(*[c for c in df.columns if c in data.columns]), df.sparkSession.createDataFrame(report, schema), summary)


# ---- types --------------------------------------------------------------------------

# Currency marks.
CURRENCY_MARKS = (r"^\$", "USD", "EUR", "£", "¥")


def to_boolean(column: Column) -> Column:
    return parse_boolean(column.cast("string"))


def to_number(column: Column) -> Column:
    return parse_number(column.cast("string"))


def currency_to_number(column: Column) -> Column:
    return to_number(F.regexp_replace(column.cast("string"), "[$,£€¥]", ""))


def percentage_to_number(column: Column) -> Column:
    return to_number(F.replace(column.cast("string"), F.lit("%"), F.lit(""))) / 100


def _type_facts(column: Column, group: str) -> Column:
    """What each type makes of a value, as one struct, so that nothing is read twice."""
    text = column.cast("string")
    number = column.cast("double") if group == "numeric" else to_number(column)
    marks = sum(((text.startswith(m[2:]) if m.startswith("^") else text.contains(m)).cast("int") for m in CURRENCY_MARKS), F.lit(0))
    facts = [
        column.isNotNull().alias("known"), number.alias("number"), to_boolean(column).isNotNull().alias("boolean"),
        marks.alias("marks"), text.contains("%").alias("percent"),
    ]
    if group == "text":  # a number is no date
        trial = F.when(~column.rlike(NUMBER_SHAPE) & column.rlike(r"\d"), parse_any(column))
        facts.append((trial.isNotNull() & column.isNotNull()).alias("datetime"))
    else:
        facts.append((F.lit(group == "datetime") & column.isNotNull()).alias("datetime"))
    return F.struct(*facts)


def _type_rates(facts: Column, weight: Column) -> dict[str, Column]:
    """Weighted counts of the values that read as each type; a value that stands for many cells is tried once."""

    def cells(holds: Column) -> Column:
        return F.coalesce(F.sum(F.when(holds, weight)), F.lit(0))

    number = facts["number"]
    whole = F.bool_and(F.when(number.isNotNull(), number == F.floor(number)))
    return {
        "n": cells(facts["known"]),
        "integer": F.when(whole, cells(number.isNotNull())),
        "float": cells(number.isNotNull()),
        "boolean": cells(facts["boolean"]),
        "currency": F.coalesce(F.sum(facts["marks"] * weight), F.lit(0)),
        "percentage": cells(facts["percent"]),
        "datetime": cells(facts["datetime"]),
    }


class TypeDetection(NamedTuple):
    data: DataFrame
    report: DataFrame


def _reading(column: Column, found: str, group: str) -> Column | None:
    """The column as the detected type; none where it stays as it is."""
    readings = {
        "datetime": lambda: parse_any(column) if group == "text" else column,
        "integer": lambda: to_number(column).try_cast("bigint"),
        "float": lambda: to_number(column),
        "boolean": lambda: to_boolean(column),
        "categorical": lambda: column,
        "currency": lambda: currency_to_number(column),
        "percentage": lambda: percentage_to_number(column),
    }
    return readings[found]() if found in readings else None


def detect_types(df: DataFrame, columns: Sequence[str] | None = None) -> TypeDetection:
    """Best type per column with a confidence of at least 0.7, and the converted table.

    Text columns of few values are tried value by value, each weighing as many cells as hold it; others cell by cell
    in one scan.
    """
    names = [c for c in plain_columns(df) if columns is None or c in columns]
    order = ("datetime", "integer", "float", "boolean", "categorical", "currency", "percentage")
    groups = {c: type_group(df.schema[c].dataType) for c in names}
    distinct = {c: counted.distinct for c, counted in count_values(df, names).items()}
    few = [c for c in names if groups[c] == "text" and distinct[c] <= FEW_VALUES]
    cells = [c for c in names if c not in few]
    values = value_frequencies(df, few) if few else None

    def measure(made: dict[str, Column], rates) -> dict[str, dict]:
        """Make one column of each, over its values or over its cells, then aggregate what was made.

        Each column is a small plan of its own that scans nothing else; they run side by side in one job.
        """
        parts = []
        for c, column in made.items():
            rows, weight = (values, F.col("count")) if c in few else (df, F.lit(1))
            staged = rows.select(column.alias("made"), weight.alias("count"))
            totals = F.struct(*[e.alias(n) for n, e in rates(F.col("made"), F.col("count")).items()])
            parts.append(staged.agg(totals.alias("totals")).select(F.lit(c).alias("column"), "totals"))
        return {r["column"]: r["totals"].asDict() for r in reduce(DataFrame.unionByName, parts).collect()} if parts else {}

    def source(c: str) -> Column:
        return F.when(F.col("column") == c, F.col("value")) if c in few else F.col(f"`{c}`")

    measured = measure({c: _type_facts(source(c), groups[c]) for c in names}, _type_rates)
    out, checks, chosen, known = {}, {}, {}, {}
    for c in names:
        row = measured[c]
        n = known[c] = row.pop("n")
        rates = {k: (v or 0) / n for k, v in row.items()} if n else {}
        rates["boolean"] = rates.get("boolean", 0.0) if rates.get("boolean", 0.0) > 0.8 else 0.0
        rates["categorical"] = 1.0 if n and 0.01 <= distinct.get(c, 0) / n <= 0.3 else 0.0
        for k in ("currency", "percentage"):
            rates[k] = rates.get(k, 0.0) if rates.get(k, 0.0) > 0.3 else 0.0
        best = max(order, key=lambda k: rates.get(k, 0.0)) if n else None  # ties go to the earlier type
        confidence = rates.get(best, 0.0) if best else 1.0
        found = "null_only" if best is None else best if confidence >= 0.7 else "unknown"
        chosen[c] = (found, confidence)
        convert = _reading(F.col(f"`{c}`"), found, groups[c])
        if convert is not None:
            out[c] = convert
            checks[c] = _reading(source(c), found, groups[c]).isNotNull()
    done = measure(checks, lambda read, weight: {"ok": F.coalesce(F.sum(F.when(read, weight)), F.lit(0))})
    rows = [
        (c, df.schema[c].dataType.simpleString(), found, round(confidence, 2), done[c]["ok"] if c in done else 0,
         known[c] - done[c]["ok"] if c in done else 0)
        for c, (found, confidence) in chosen.items()
    ]
    schema = "column string, original_type string, detected_type string, confidence double, converted_rows long, failed_rows long"
    return TypeDetection(df.withColumns(out) if out else df, df.sparkSession.createDataFrame(rows, schema))


def numeric_or_fail(df: DataFrame, column: str) -> tuple[DataFrame, bool]:
    """Column coerced to numbers; fails only when no non-null value is a number."""
    if type_group(df.schema[column].dataType) in ("numeric", "datetime"):
        return df, True
    row = scalars(df, hits=F.count(to_number(F.col(column))), n=F.count(column))
    success = bool(row["hits"]) or not row["n"]
    return df.withColumn(column, to_number(F.col(column))), success


# ---- splitting -------------------------------------------------------------------------

# Delimiters tried, in order.
DELIMITERS = (",", ";", "|", "\t", " - ", "/", "\\", ":", " ")


def occurrences(column: Column, token: str) -> Column:
    shorter = F.length(F.replace(column, F.lit(token), F.lit("")))
    return ((F.length(column) - shorter) / len(token)).cast("double")


def splittable_column(df: DataFrame) -> str | None:
    """Text column with the most delimiters per value."""
    names = text_columns(df)
    if not names:
        return None
    scores = [sum((F.avg(occurrences(F.col(c), d)) for d in DELIMITERS), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(names)]
    row = df.agg(*scores).first()
    return max(zip(names, row), key=lambda p: p[1] or 0.0)[0]


def best_delimiter(df: DataFrame, column: str) -> str | None:
    """Highest count x consistency over all values."""
    wanted = {}
    for i, d in enumerate(DELIMITERS):
        hits = occurrences(F.col(column), d)
        wanted[f"d{i}"] = F.struct(F.sum(hits).alias("n"), F.avg(hits).alias("mean"), F.stddev_samp(hits).alias("sd"))
    row, scores = scalars(df, **wanted), {}
    for i, d in enumerate(DELIMITERS):
        s = row[f"d{i}"]
        if s["n"]:
            scores[d] = s["n"] * (1 - (s["sd"] or 0.0) / (s["mean"] + 1e-10))
    return max(scores, key=scores.get) if scores else None


# Content hints for part names.
PART_HINTS = (
    ("street", r"\b(st|street|ave|avenue|rd|road)\b"), ("city", r"\b(city|town)\b"),
    ("state", r"\b(state|province|region)\b"), ("zip", r"\b(zip|postal|code)\b"), ("zip", r"^\d{5}"),
)


class Split(NamedTuple):
    data: DataFrame
    report: dict


def split_column(df: DataFrame, column: str | None = None, delimiter: str | None = None, min_filled: float = 0.1) -> Split:
    """Split a text column into parts filled in more than `min_filled` of its values."""
    column = column or splittable_column(df)
    if column is None:
        raise ValueError("no text column to split")
    delimiter = delimiter or best_delimiter(df, column)
    if delimiter is None:
        raise ValueError("no consistent delimiter found")
    parts = F.split(F.col(column), re.escape(delimiter))
    rows = scalars(df, n=F.count(column))["n"]
    places = df.select(F.posexplode(parts).alias("i", "part")).filter(F.col("part") != "")
    hints = [F.avg(F.lower("part").rlike(p).cast("double")).alias(f"h{j}") for j, (_, p) in enumerate(PART_HINTS)]
    filled = places.groupBy("i").agg(F.count(F.lit(1)).alias("n"), *hints)
    kept = filled.filter(F.col("n") > min_filled * rows).orderBy("i").collect()  # fewer than 1 / min_filled per value on average
    plain = f"{column}_part" if len(kept) <= 3 else f"{column}_"
    names: list[str] = []
    for k, row in enumerate(kept):
        hint = next((h for j, (h, _) in enumerate(PART_HINTS) if k < 3 and row[f"h{j}"] > 0.5), None)
        name = f"{column}_{hint}" if hint else f"{plain}{k + 1}"
        names.append(name if name not in names else f"{plain}{k + 1}")
    pieces = {n: F.nullif(F.get(parts, F.lit(r["i"])), F.lit("")) for n, r in zip(names, kept)}
    data = df.withColumns(pieces).drop(column)
    full = scalars(df, some=F.count(F.coalesce(*pieces.values())), gaps=F.count_if(F.col(column).isNotNull() & sum((p.isNull().cast("int") for p in pieces.values()), F.lit(0)).cast("boolean")))
    report = {
        "column": column, "delimiter": delimiter, "new_columns": names, "rows": rows,
        "rows_with_missing_parts": full["gaps"], "success_percent": 100.0 * full["some"] / rows if rows else 0.0,
    }
    return Split(data, report)


# ---- anomalies --------------------------------------------------------------------------


class Outliers(NamedTuple):
    data: DataFrame
    report: DataFrame
    calendar: DataFrame | None


def z_score_outliers(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 3.0, minimum: int = 10) -> Outliers:
    """Flag |z| > limit per numeric column, with day-of-week and month counts of the flagged rows."""
    names = _numbers(df, columns)
    row = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s"), F.count(c).alias("n")).alias(f"c{i}") for i, c in enumerate(names)]).first()
    flags, checks, facts = {}, {}, {}
    for c, s in zip(names, row):
        if s["n"] < minimum or not s["s"]:
            continue
        hit = F.coalesce(F.abs((F.col(c) - F.lit(s["m"])) / F.lit(s["s"])) > limit, F.lit(False))
        flags[f"{c}_is_outlier"], facts[c] = hit, s
        value = F.when(hit, F.col(c).cast("double"))
        checks[c] = F.struct(F.count(value).alias("k"), F.min(value).alias("low"), F.max(value).alias("high"))
    found = scalars(df, **checks) if checks else {}
    hits = {c: r for c, r in found.items() if r["k"]}
    data = df.withColumns({f"{c}_is_outlier": flags[f"{c}_is_outlier"] for c in hits}) if hits else df
    rows = [(c, r["k"], 100.0 * r["k"] / facts[c]["n"], r["low"], r["high"], facts[c]["m"], facts[c]["s"]) for c, r in hits.items()]
    schema = "column string, count long, percentage double, min_value double, max_value double, data_mean double, data_std double"
    calendar, dates = None, date_columns(df)
    if dates and hits:
        flagged = F.explode(F.array_compact(F.array(*[F.when(F.col(f"{c}_is_outlier"), F.lit(c)) for c in hits])))
        calendar = (
            data.select(flagged.alias("column"), F.weekday(dates[0]).alias("day_of_week"), F.month(dates[0]).alias("month"))
            .groupBy("column", "day_of_week", "month").agg(F.count(F.lit(1)).alias("count"))
        )
    return Outliers(data, df.sparkSession.createDataFrame(rows, schema), calendar)


def impossible_values(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule, all rules in one pass."""
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(r).alias(n) for n, r in rules.items()])
    long = counted.unpivot(["_rows"], list(rules), "rule", "violations")
    return long.select("rule", "violations", F.try_divide(F.col("violations") * 100.0, F.col("_rows")).alias("percentage"))


def age_income_rules(df: DataFrame) -> dict[str, Column]:
    """age < 18 with income > 100 000, for columns named so."""
    names = numeric_columns(df)
    ages, incomes = [c for c in names if "age" in c.lower()], [c for c in names if "income" in c.lower()]
    return {f"{a} < 18 and {b} > 100000": (F.col(a) < 18) & (F.col(b) > 100_000) for a in ages for b in incomes}


def temporal_anomalies(df: DataFrame, date: str, as_of: str) -> DataFrame:
    """Dates more than a day after `as_of`, and dates before 1900."""
    stamp = F.col(date).cast("timestamp_ntz")
    late = stamp > F.lit(as_of).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    early = stamp < F.lit("1900-01-01").cast("timestamp_ntz")
    row = df.agg(F.count(stamp).alias("_n"), F.count_if(late).alias("future_date"), F.count_if(early).alias("historical_date"))
    long = row.unpivot(["_n"], ["future_date", "historical_date"], "anomaly", "count")
    return long.select("anomaly", "count", F.try_divide(F.col("count") * 100.0, F.col("_n")).alias("percentage"))


def midnight_pattern(df: DataFrame, date: str, metric: str) -> DataFrame:
    at_midnight = F.hour(date) == 0
    return df.agg(
        F.count_if(at_midnight).alias("count"),
        F.try_divide(F.count_if(at_midnight) * 100.0, F.count(F.lit(1)).cast("double")).alias("percentage"),
        F.avg(F.when(at_midnight, F.col(metric))).alias("avg_value"),
    )
