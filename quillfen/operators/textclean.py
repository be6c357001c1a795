"""Text normalisation and masking of personal data over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfen.functions.text import steps
from quillfen.operators.ingest import text_columns


class Cleaned(NamedTuple):
    data: DataFrame
    report: DataFrame


def changed_rows(both: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows whose value differs after cleaning, per column, in one pass."""
    counts = both.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(~a.eqNullSafe(b)).alias(c) for c, (a, b) in pairs.items()]
    )
    long = counts.unpivot(["_rows"], list(pairs), "column", "changed_rows")
    return long.select("column", "changed_rows", F.try_divide(F.col("changed_rows") * 100.0, F.col("_rows")).alias("percent"))


def normalise_text(df: DataFrame, columns: Sequence[str] | None = None) -> Cleaned:
    """One projection per step, so that no step is evaluated more than once."""
    names = [c for c in text_columns(df) if columns is None or c in columns]
    both = df.withColumns({f"_before_{c}": F.col(c) for c in names})
    plans = {c: steps(c) for c in names}
    for i in range(len(steps(""))):
        both = both.withColumns({c: plans[c][i][1](F.col(c)) for c in names})
    report = changed_rows(both, {c: (F.col(f"_before_{c}"), F.col(c)) for c in names})
    return Cleaned(both.drop(*[f"_before_{c}" for c in names]), report)


# Patterns of personal data and the lowest level that looks for them.
PATTERNS = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "conservative"),
    ("phone", r"(\+\d{1,3}[-.]?)?\(?\d{3}\)?[-.]?\d{3}[-.]?\d{4}\b", "conservative"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "conservative"),
    ("credit_card", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b", "conservative"),
    ("ip_address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "standard"),
    ("name", r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b", "standard"),
    ("address", r"\b\d+\s+([A-Z][a-z]+\s)+([A-Z][a-z]+)\b", "aggressive"),
)
# Column-name hints.
NAME_HINTS = (
    ("email", ("email", "mail", "e-mail")),
    ("phone", ("phone", "mobile", "tel", "telephone")),
    ("name", ("name", "firstname", "lastname", "fullname", "username")),
    ("address", ("address", "street", "city", "zip", "postal", "location")),
    ("id", ("ssn", "social", "id", "passport", "driver", "license", "national")),
    ("financial", ("credit", "card", "account", "bank", "routing")),
)
# Levels of search, and the share of rows with a hit from which a column counts.
LEVELS = ("conservative", "standard", "aggressive")
THRESHOLDS = {"conservative": 0.05, "standard": 0.03, "aggressive": 0.01}
# What a hit is replaced with.
MASKS = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@", "***@"),  # starts at word starts only: linear time
    "phone": (r"(\d{3})[-.]?\d{3}[-.]?(\d{4})", "***-***-$2"),
    "ssn": (r"(\d{3})-(\d{2})-(\d{4})", "***-**-$3"),
    "credit_card": (r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?(\d{4})", "**** **** **** $1"),
    "ip_address": (r"\b(\d{1,3})\.(\d{1,3})\.\d{1,3}\.\d{1,3}\b", "$1.$2.***.***"),
    "name": (r"(?U)\b(\w)\w+\b", "$1***"),
    "address": (r"\b\d+\s+", "*** "),
}


def pattern_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of non-null values per column that match each pattern, over all rows."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(kind).alias("pii_type"), F.avg(F.col(c).rlike(p).cast("double")).alias("share"))
        for c in columns for kind, p, _ in PATTERNS
    ]
    return df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def detect_pii(df: DataFrame, level: str = "standard", columns: Sequence[str] | None = None) -> dict[str, list[str]]:
    """Kinds found per text column: by its name, then by its values."""
    names = [c for c in text_columns(df) if columns is None or c in columns]
    if not names:
        return {}
    reach = LEVELS.index(level)
    shares = {(r["column"], r["pii_type"]): r["share"] for r in pattern_shares(df, names).collect()}
    found: dict[str, list[str]] = {}
    for c in names:
        kinds = [kind for kind, hints in NAME_HINTS if any(h in c.lower() for h in hints)]
        for kind, _, lowest in PATTERNS:
            share = shares[(c, kind)]
            if LEVELS.index(lowest) <= reach and share and share >= THRESHOLDS[level] and kind not in kinds:
                kinds.append(kind)
        if kinds and any(shares[(c, k)] is not None for k, _, _ in PATTERNS):
            found[c] = kinds
    return found


def mask(column: Column, kinds: Sequence[str]) -> Column:
    for kind in kinds:
        if kind in MASKS:
            pattern, replacement = MASKS[kind]
            column = F.regexp_replace(column, pattern, replacement)
    return column


def sanitise_pii(df: DataFrame, level: str = "standard", columns: Sequence[str] | None = None) -> Cleaned:
    """Masked table and a report of kinds and changed rows per column."""
    found = detect_pii(df, level, columns)
    new = {c: mask(F.col(c), kinds) for c, kinds in found.items()}
    spark = df.sparkSession
    if not new:
        return Cleaned(df, spark.createDataFrame([], "column string, kinds string, changed_rows long, percent double"))
    kinds = spark.createDataFrame([(c, ", ".join(k)) for c, k in found.items()], "column string, kinds string")
    report = changed_rows(df, {c: (F.col(c), e) for c, e in new.items()}).join(kinds, "column").select("column", "kinds", "changed_rows", "percent")
    return Cleaned(df.withColumns(new), report)
