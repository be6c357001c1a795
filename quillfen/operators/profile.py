"""Column profiles: a few wide aggregate passes over the whole table."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfen.operators.frequencies import count_values, estimates, row_key
from quillfen.operators.ingest import date_columns, numeric_columns, text_columns, type_group
from quillfen.operators.quantiles import quantiles
from quillfen.session import scalars

_BATCH = 30  # columns per aggregate pass


def _plain(data_type: T.DataType) -> bool:
    return not isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def plain_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if _plain(f.dataType)]


def adjusted_skewness(column: Column) -> Column:
    """Sample skewness with the small-sample correction."""
    n = F.count(column).cast("double")
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def adjusted_kurtosis(column: Column) -> Column:
    """Sample excess kurtosis with the small-sample correction."""
    n = F.count(column).cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n > 3, scale * ((n + 1) * F.kurtosis(column) + 6))


@dataclass
class ColumnProfile:
    name: str
    group: str
    dtype: str
    rows: int
    nulls: int
    distinct: int = 0
    least: int = 0
    top: list[tuple[str, int]] = field(default_factory=list)
    stats: dict = field(default_factory=dict)

    @property
    def non_null(self) -> int:
        return self.rows - self.nulls

    @property
    def null_share(self) -> float:
        return self.nulls / self.rows if self.rows else 0.0

    @property
    def unique_share(self) -> float:
        return self.distinct / self.rows if self.rows else 0.0


@dataclass
class Profile:
    rows: int
    columns: dict[str, ColumnProfile]

    def of(self, group: str) -> list[ColumnProfile]:
        return [c for c in self.columns.values() if c.group == group]

    @property
    def missing(self) -> int:
        return sum(c.nulls for c in self.columns.values())

    @property
    def missing_percent(self) -> float:
        cells = self.rows * len(self.columns)
        return 100.0 * self.missing / cells if cells else 0.0


def _batched(df: DataFrame, expressions: dict[str, list[Column]]) -> dict[str, list]:
    """Run per-column aggregate lists, a batch of columns per pass."""
    out: dict[str, list] = {}
    names = list(expressions)
    for start in range(0, len(names), _BATCH):
        block = names[start : start + _BATCH]
        flat = [e.alias(f"a{i}_{j}") for i, n in enumerate(block) for j, e in enumerate(expressions[n])]
        row = list(df.agg(*flat).first())
        for n in block:
            out[n], row = row[: len(expressions[n])], row[len(expressions[n]) :]
    return out


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """k most frequent values per column, ties to the smaller text."""
    counted = count_values(df, columns, top=k)
    rows = [(c, value, count, i + 1) for c in columns for i, (value, count) in enumerate(counted[c].top)]
    return df.sparkSession.createDataFrame(rows, "column string, value string, count long, rank int")


def profile(df: DataFrame, top: int = 10, spread: bool = True, approximate: bool = False) -> Profile:
    """Profile every plain column: one scan of moments and estimates, value counts, quantiles."""
    columns = plain_columns(df)
    schema = df.schema
    moments = {}
    for c in columns:
        column = F.col(f"`{c}`")
        wanted = [F.count(F.lit(1)), F.count(column), *estimates(c, schema[c].dataType)]
        if type_group(schema[c].dataType) == "numeric":
            number = column.cast("double")
            wanted += [
                F.avg(number), F.stddev_samp(number), F.min(number), F.max(number),
                adjusted_skewness(number), adjusted_kurtosis(number),
                F.avg(number.between(0, 100).cast("double")), F.avg(number.between(0, 1).cast("double")),
                F.avg((number < 0).cast("double")), F.count_if(number < 0), F.avg(_two_decimals(number).cast("double")),
            ]
        elif type_group(schema[c].dataType) == "datetime":
            wanted += [F.min(column).cast("string"), F.max(column).cast("string")]
        moments[c] = wanted
    measured = _batched(df, moments)
    profiles, estimated = {}, {}
    for c in columns:
        rows, count, about, size, *rest = measured[c]
        estimated[c] = (about, size or 0.0)
        group = type_group(schema[c].dataType)
        p = ColumnProfile(c, group, schema[c].dataType.simpleString(), rows, rows - count)
        if group == "numeric":
            names = (
                "mean", "std", "min", "max", "skew", "kurtosis", "in_0_100", "in_0_1", "negative_share",
                "negatives", "two_decimals",
            )
            p.stats = dict(zip(names, rest))
        elif group == "datetime":
            p.stats = dict(zip(("min", "max"), rest))
        profiles[c] = p
    rows = measured[columns[0]][0] if columns else df.count()
    if columns:
        if approximate:
            for c, (about, _) in estimated.items():
                profiles[c].distinct = about
        else:
            for c, counted in count_values(df, columns, top, estimated).items():
                profiles[c].distinct, profiles[c].least, profiles[c].top = counted.distinct, counted.least, counted.top
    numbers = [c for c in columns if profiles[c].group == "numeric"]
    if spread and numbers:
        for c, (q25, q50, q75) in quantiles(df, numbers, [0.25, 0.5, 0.75]).items():
            profiles[c].stats.update({"q25": q25, "q50": q50, "q75": q75})
    return Profile(rows, profiles)


def _two_decimals(number: Column) -> Column:
    cents, tenths = number * 100, number * 10
    return (F.abs(cents - F.rint(cents)) < 1e-6) & (F.abs(tenths - F.rint(tenths)) > 1e-6)


# ---- tables made from profiles ---------------------------------------------------


def duplicate_rows(df: DataFrame) -> int:
    """Rows beyond the first copy of each distinct row."""
    if not df.columns:
        return 0
    keys = df.select(*row_key([F.col(f"`{c}`") for c in df.columns]))  # rows meet by a 128-bit hash
    counts = keys.groupBy("_key_a", "_key_b").agg(F.count(F.lit(1)).alias("_copies"))
    return scalars(counts, extra=F.sum(F.col("_copies") - 1))["extra"] or 0


def estimated_bytes(df: DataFrame, rows: int) -> int:
    """Rows times the default width of each type; stands in for memory accounting."""
    widths = {"string": 20, "timestamp": 8, "timestamp_ntz": 8, "date": 4, "double": 8, "bigint": 8,
              "int": 4, "float": 4, "smallint": 2, "tinyint": 1, "boolean": 1}
    return rows * sum(widths.get(f.dataType.simpleString(), 64) for f in df.schema)


def dataset_summary(df: DataFrame) -> DataFrame:
    p = profile(df, top=0, spread=False)
    duplicates = duplicate_rows(df)
    row = (
        p.rows, len(df.columns), ", ".join(numeric_columns(df)), ", ".join(text_columns(df)), ", ".join(date_columns(df)),
        p.missing, p.missing_percent, duplicates, 100.0 * duplicates / p.rows if p.rows else 0.0,
        estimated_bytes(df, p.rows) / 2**20, ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in df.schema),
    )
    return df.sparkSession.createDataFrame(
        [row],
        "row_count long, col_count int, numeric_columns string, categorical_columns string, datetime_columns string,"
        "missing_count long, missing_percentage double, duplicate_count long, duplicate_percentage double,"
        "estimated_mb double, column_types string",
    )


def validate_dataset(df: DataFrame) -> DataFrame:
    """Issues and warnings, one per row."""
    p, found = profile(df, top=0, spread=False), []
    if not p.rows:
        found.append(("issue", "empty", None))
    for c in df.columns:
        if re.search(r"[\n\r\t\0]", c):
            found.append(("issue", f"control characters in name: {c!r}", None))
    duplicates = duplicate_rows(df)
    if duplicates:
        found.append(("warning", "duplicate rows", float(duplicates)))
    if p.missing_percent > 30:
        found.append(("issue", "missing values", p.missing_percent))
    elif p.missing_percent > 5:
        found.append(("warning", "missing values", p.missing_percent))
    found += [("warning", f"constant column: {c.name}", 1.0) for c in p.columns.values() if c.distinct == 1]
    return df.sparkSession.createDataFrame(found, "level string, finding string, amount double")


def column_table(df: DataFrame) -> DataFrame:
    """One row per column: type, counts, most frequent value and range."""
    p = profile(df, top=1, spread=False)
    rows = []
    for c in p.columns.values():
        low, high = c.stats.get("min"), c.stats.get("max")
        rows.append(
            (c.name, c.group, c.non_null, 100.0 * c.null_share, c.distinct, c.top[0][0] if c.top else None,
             c.stats.get("mean"), None if low is None else str(low), None if high is None else str(high))
        )
    return df.sparkSession.createDataFrame(
        rows,
        "column string, type string, non_null long, null_percent double, unique long, sample string, mean double,"
        "min string, max string",
    )


def statistics_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max, skew and kurtosis per numeric column."""
    columns = columns or numeric_columns(df)
    wanted = {}
    for c in columns:
        v = F.col(f"`{c}`").cast("double")
        wanted[c] = [F.count(v), F.avg(v), F.stddev_samp(v), F.min(v), F.max(v), adjusted_skewness(v), adjusted_kurtosis(v)]
    measured, edges = _batched(df, wanted), quantiles(df, columns, [0.25, 0.5, 0.75])
    rows = []
    for c in columns:
        count, mean, std, low, high, skew, kurtosis = measured[c]
        rows.append((c, count, mean, std, low, *edges[c], high, skew, kurtosis))
    return df.sparkSession.createDataFrame(
        rows,
        "column string, count long, mean double, std double, min double, q25 double, q50 double, q75 double,"
        "max double, skew double, kurtosis double",
    )


def missing_table(df: DataFrame) -> DataFrame:
    """Columns with missing values, worst first."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    long = counts.unpivot([], df.columns, "column", "missing")
    rows = df.agg(F.count(F.lit(1))).scalar()
    share = F.try_divide(F.col("missing") * 100.0, rows)
    return long.filter("missing > 0").withColumn("percent", share).orderBy(F.desc("missing"), "column")


def quality_score(p: Profile) -> float:
    """0.7 of completeness plus 0.3 of the share of columns with more than one value."""
    varied = 100.0 * sum(c.distinct > 1 for c in p.columns.values()) / max(1, len(p.columns))
    return max(0.0, min(100.0, 0.7 * (100.0 - p.missing_percent) + 0.3 * varied))


def rich_summary(df: DataFrame, top: int = 5) -> DataFrame:
    """Per column: missing, unique, top values and statistics, plus the dataset score."""
    p = profile(df, top=top)
    score = quality_score(p)
    rows = []
    for c in p.columns.values():
        spread = "high_cardinality" if c.distinct > 50 else "low_cardinality"
        rows.append(
            (c.name, c.group, c.nulls, 100.0 * c.null_share, c.distinct, ", ".join(f"{v}={n}" for v, n in c.top),
             c.stats.get("mean"), c.stats.get("std"), c.stats.get("q50"), spread if c.group == "text" else None, score)
        )
    return df.sparkSession.createDataFrame(
        rows,
        "column string, type string, missing long, missing_percent double, unique long, top_values string, mean double,"
        "std double, median double, distribution string, quality_score double",
    )


# Name hints and value families of the semantic types.
PERCENT_HINTS = ("pct", "percent", "percentage", "rate", "ratio")
STAGE_HINTS = ("stage", "step", "funnel", "status", "phase", "level", "progress", "state")
BOOLEAN_FAMILIES = (
    r"(true|false|yes|no|1|0|t|f|y|n)",
    r"(active|inactive|enabled|disabled|on|off)",
    r"(success|failure|pass|fail|complete|incomplete)",
    r"(win|loss|won|lost|approved|rejected)",
)
DATE_SHAPES = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{4}/\d{2}/\d{2}|\d{2}-\d{2}-\d{4}"
BUSINESS_HIGH = (
    "revenue", "sales", "profit", "gmv", "arr", "margin", "growth", "income", "earnings", "gross", "net", "turnover",
    "value", "worth", "conversion", "roi", "lifetime", "clv", "arpu", "transaction",
)
BUSINESS_MEDIUM = (
    "cost", "expense", "spend", "rate", "performance", "efficiency", "productivity", "utilization", "satisfaction",
    "retention", "churn", "engagement", "frequency", "duration", "quality", "score", "metric",
)
# Names of columns that hold keys, secrets or bookkeeping.
JUNK_NAMES = (
    r"^id$", r"_id$", r"^uuid$", r"^guid$", r"^pk_", r"^fk_",
    r"^rowid$", r"^index$", r"^key$", r"^hash$", r"^md5$",
    r"^token$", r"^secret$", r"^password$", r"^ssn$", r"^pin$",
    r"^version$", r"^created$", r"^updated$", r"^deleted$",
)


def semantic_type(c: ColumnProfile, date_share: float = 0.0) -> str:
    """Meaning of a column from its type, name and values."""
    name = c.name.lower()
    if re.search(r"(^|_)(id|uuid|guid)$", name):
        return "id"
    if c.group in ("datetime", "boolean"):
        return c.group
    if c.group == "numeric":
        if not c.non_null:
            return "numeric"
        wide, unit = c.stats["in_0_100"], c.stats["in_0_1"]
        if (wide > 0.8 and wide > unit) or any(h in name for h in PERCENT_HINTS):
            return "percentage"
        if c.stats["mean"] > 10 and c.stats["two_decimals"] > 0.5:
            return "currency"
        return "numeric"
    if c.group == "text":
        if not c.non_null:
            return "categorical"
        if any(h in name for h in STAGE_HINTS):
            return "stage"
        if c.distinct <= 4:
            values = [v.strip().lower() for v, _ in c.top]
            if any(all(re.fullmatch(f, v) for v in values) for f in BOOLEAN_FAMILIES):
                return "boolean"
        return "datetime" if date_share > 0.7 else "categorical"
    return "unknown"


def date_text_shares(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Share of values that contain a date-like text."""
    if not columns:
        return {}
    shares = _batched(df, {c: [F.avg(F.col(f"`{c}`").rlike(DATE_SHAPES).cast("double"))] for c in columns})
    return {c: v[0] or 0.0 for c, v in shares.items()}


def is_junk(c: ColumnProfile, kind: str) -> bool:
    """Identifier-like name, or nearly unique values without a business name."""
    name = c.name.lower()
    if any(re.search(pattern, name) for pattern in JUNK_NAMES):
        return True
    business = any(term in name for term in BUSINESS_HIGH + BUSINESS_MEDIUM)
    return c.unique_share > 0.9 and kind != "datetime" and not business


def semantic_table(df: DataFrame) -> DataFrame:
    p = profile(df, top=10, spread=False)
    dates = date_text_shares(df, [c.name for c in p.of("text")])
    rows = []
    for c in p.columns.values():
        kind = semantic_type(c, dates.get(c.name, 0.0))
        rows.append((c.name, kind, is_junk(c, kind)))
    return df.sparkSession.createDataFrame(rows, "column string, semantic_type string, junk boolean")


def outlier_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """IQR outlier count and share per numeric column; flagged between 1 % and 5 %."""
    columns = columns or numeric_columns(df)
    wanted = {}
    for c, (q1, q3) in quantiles(df, columns, [0.25, 0.75]).items():
        v = F.col(f"`{c}`").cast("double")
        if q1 is None:
            wanted[c] = [F.lit(0), F.count(v)]
            continue
        iqr = max(1e-12, q3 - q1)
        wanted[c] = [F.count_if((v < q1 - 1.5 * iqr) | (v > q3 + 1.5 * iqr)), F.count(v)]
    rows = []
    for c, (outliers, count) in _batched(df, wanted).items():
        share = outliers / count if count else 0.0
        rows.append((c, outliers, share, 0.01 < share < 0.05))
    return df.sparkSession.createDataFrame(rows, "column string, outliers long, share double, flagged boolean")


# Metrics that should not be negative.
POSITIVE_METRICS = ("revenue", "sales", "profit", "income", "gmv", "margin")


def negative_table(df: DataFrame, terms: tuple[str, ...] = POSITIVE_METRICS, threshold: float = 0.1) -> DataFrame:
    """Share of negative values in metrics that should be positive."""
    columns = [c for c in numeric_columns(df) if any(t in c.lower() for t in terms)]
    wanted = {c: [F.count_if(F.col(f"`{c}`") < 0), F.avg((F.col(f"`{c}`") < 0).cast("double"))] for c in columns}
    rows = [(c, n, s or 0.0, (s or 0.0) > threshold) for c, (n, s) in _batched(df, wanted).items()]
    return df.sparkSession.createDataFrame(rows, "column string, negatives long, share double, flagged boolean")


def sampling_profile(df: DataFrame) -> tuple[Profile, dict]:
    """Facts that decide about sampling."""
    p = profile(df, top=1, spread=False)
    skews = [abs(c.stats["skew"]) for c in p.of("numeric") if c.stats["skew"] is not None]
    imbalance = {}
    for c in p.of("text"):
        if c.top and c.non_null:
            imbalance[c.name] = round(c.top[0][1] / c.least, 2)
    return p, {
        "high_null": [c.name for c in p.columns.values() if c.null_share > 0.3],
        "skew": round(sum(skews) / len(skews), 2) if skews else 0.0,
        "imbalance": imbalance,
        "high_cardinality": [c.name for c in p.of("text") if c.distinct > 50],
        "temporal": [c.name for c in p.of("datetime")],
    }


def characteristics_table(df: DataFrame) -> DataFrame:
    p, facts = sampling_profile(df)
    rows = [
        (c.name, 100.0 * c.null_share, c.stats.get("skew") if c.group == "numeric" else None,
         facts["imbalance"].get(c.name), c.name in facts["high_cardinality"], c.name in facts["temporal"])
        for c in p.columns.values()
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "column string, null_percent double, skew double, imbalance_ratio double, high_cardinality boolean, temporal boolean",
    )


def complexity_score(df: DataFrame, facts: tuple[Profile, dict] | None = None) -> float:
    """0..10 from size, width, nulls, skew, imbalance, time, cardinality and estimated size."""
    p, f = facts or sampling_profile(df)
    score = min(2.0, math.log10(max(1.0, p.rows / 1000)) * 0.5)
    score += min(2.0, len(df.columns) * 0.1)
    score += min(2.0, len(f["high_null"]) * 0.5)
    score += min(2.0, f["skew"] * 0.5)
    score += min(2.0, sum(r > 10 for r in f["imbalance"].values()))
    score += 1.0 if f["temporal"] else 0.0
    score += min(1.0, len(f["high_cardinality"]) * 0.2)
    return min(10.0, round(score, 1) + min(2.0, estimated_bytes(df, p.rows) / 2**20 / 100))


def readiness(df: DataFrame) -> DataFrame:
    """Whether the table can be analysed, and why not."""
    p = profile(df, top=0, spread=False)
    usable = [c for c in p.columns.values() if c.group in ("numeric", "text") and not re.search(r"^id$|_id$|^uuid$|^guid$", c.name.lower())]
    missing = p.missing_percent
    if not df.columns:
        reason = "no_columns"
    elif p.rows < 3:
        reason = "insufficient_data" if p.rows else "empty_dataset"
    elif not usable:
        reason = "no_analyzable_columns"
    elif missing > 75:
        reason = "excessive_missing_data"
    else:
        reason = "valid"
    row = (reason == "valid", reason, p.rows, len(df.columns), len(p.of("numeric")), len(p.of("text")), len(p.of("datetime")), missing, missing > 50)
    return df.sparkSession.createDataFrame(
        [row],
        "valid boolean, reason string, rows long, columns int, numeric_columns int, categorical_columns int,"
        "datetime_columns int, missing_percentage double, warns boolean",
    )
