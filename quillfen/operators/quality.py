"""Health score and data-quality issues over the whole table."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfen.operators.correlation import _pair_values, _safe, correlation
from quillfen.operators.dates import parse_any
from quillfen.operators.profile import Profile, duplicate_rows, outlier_table, profile
from quillfen.session import scalars

# Name hints.
TARGET_HINTS = ("target", "label", "value", "amount", "price", "sales", "score")
IMPORTANT_HINTS = ("date", "time", "id", "key", "target", "label", "value", "amount", "price")
POSITIVE_HINTS = ("price", "cost", "amount", "age", "quantity", "count", "revenue", "sales")
SEVERITIES = ("critical", "high", "medium", "low")


def dataset_type(p: Profile) -> str:
    if p.of("datetime") and p.rows > 10_000:
        return "transactional"
    shares = [c.unique_share for c in p.columns.values()]
    return "aggregated" if shares and sum(shares) / len(shares) < 0.1 else "general"


def severity(ratio: float, rows: int, thresholds: tuple[float, float, float] = (0.01, 0.05, 0.10)) -> str:
    """critical / high / medium above the largest / middle / smallest threshold; laxer for big tables."""
    factor = 1 if rows < 1_000 else 2 if rows < 100_000 else 3
    for limit, name in zip(sorted(thresholds, reverse=True), SEVERITIES):
        if ratio > limit * factor:
            return name
    return "low"


def health_score(df: DataFrame, p: Profile | None = None) -> DataFrame:
    """0..100: penalties for missing, duplicate and useless columns, hard caps, a small bonus."""
    p = p or profile(df, top=0, spread=False)
    kind, missing = dataset_type(p), p.missing_percent
    duplicates = 100.0 * duplicate_rows(df) / p.rows if p.rows else 0.0
    constant = sum(c.distinct == 1 for c in p.columns.values())
    wide = sum(c.distinct > 0.9 * p.rows for c in p.of("text"))
    score = 100.0 - missing * {"transactional": 0.8, "aggregated": 0.3, "general": 0.4}[kind]
    score -= duplicates * 0.2 + constant * 3 + wide * 2
    caps = []
    if duplicates > 30:
        score, caps = min(score, 40.0), [*caps, "duplicates"]
    if missing > 40 and kind == "transactional":
        score, caps = min(score, 35.0), [*caps, "missing"]
    if constant > 0.5 * len(p.columns):
        score, caps = min(score, 50.0), [*caps, "constant"]
    if not p.columns or not p.rows:
        score, caps = 0.0, [*caps, "empty"]
    else:
        target = any(h in c.name.lower() for c in p.of("numeric") for h in TARGET_HINTS)
        score += 8 if p.of("datetime") and target else 3 if p.of("datetime") or target else 0
    final = int(max(0, min(100, round(score))))
    return df.sparkSession.createDataFrame(
        [(final, kind, bool(caps), ", ".join(caps))], "score int, dataset_type string, capped boolean, caps string"
    )


def near_duplicates(df: DataFrame, column: str) -> int:
    """Rows that only repeat after folding case and outer spaces."""
    values = df.select(F.col(f"`{column}`").alias("value")).filter(F.col("value").isNotNull())
    exact = values.groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    folded = exact.groupBy(F.trim(F.lower("value")).alias("value")).agg(F.sum("count").alias("count"))
    repeated = F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0))
    return (scalars(folded, n=repeated)["n"] or 0) - (scalars(exact, n=repeated)["n"] or 0)


def fuzzy_candidate(p: Profile) -> str | None:
    """Text column with the most values that is neither constant nor nearly unique."""
    fits = [c for c in p.of("text") if 5 < c.distinct < 0.5 * p.rows]
    return max(fits, key=lambda c: c.distinct).name if fits else None


_PAIRS_PER_PASS = 200
#: Rows that show which columns may agree, and the share that pairs must reach there. A pair that agrees on 80 % of all
#: rows falls short of it with a chance below exp(-2 * 1024 * 0.15 ** 2), about 1e-20.
SHOWN_ROWS, SHOWN_SHARE = 1024, 0.65


def _may_agree(df: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The pairs worth counting over all rows, from the rows with the smallest hashes of their numbers."""
    names = sorted({c for pair in pairs for c in pair})
    rows = df.select(*[F.col(f"`{c}`") for c in names]).withColumn("_turn", F.xxhash64(F.monotonically_increasing_id()))
    shown = rows.orderBy("_turn").limit(SHOWN_ROWS)
    codes = [F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.col(f"`{c}`"))).alias(f"c{i}") for i, c in enumerate(names)]
    table = [list(r) for r in shown.select(*codes).collect()]  # SHOWN_ROWS numbers per column at most
    if not table:
        return []
    known = np.array([[v is not None for v in row] for row in table])
    values = np.array([[v or 0 for v in row] for row in table], np.int64)
    place = {c: i for i, c in enumerate(names)}

    def share(a: int, b: int) -> float:
        return float((known[:, a] & known[:, b] & (values[:, a] == values[:, b])).mean())

    return [(a, b) for a, b in pairs if share(place[a], place[b]) >= SHOWN_SHARE]


def equal_pairs(df: DataFrame, names: list[str]) -> list[tuple[str, str, float]]:
    """Columns of one type that agree on 80 % to 100 % of the rows, counted over all rows where they may."""
    types = {f.name: f.dataType for f in df.schema}
    pairs = [(a, b) for a, b in combinations(names, 2) if types[a] == types[b]]
    pairs = _may_agree(df, pairs) if pairs else []
    found = []
    for start in range(0, len(pairs), _PAIRS_PER_PASS):
        block = pairs[start : start + _PAIRS_PER_PASS]
        same = [F.avg(F.coalesce(F.col(f"`{a}`") == F.col(f"`{b}`"), F.lit(False)).cast("double")).alias(f"p{i}") for i, (a, b) in enumerate(block)]
        found += [(a, b, s) for (a, b), s in zip(block, df.agg(*same).first()) if s is not None and 0.8 < s < 1.0]
    return found


def mixed_date_columns(df: DataFrame, names: list[str]) -> list[tuple[str, int, int]]:
    """Text columns of which some, but not all, values are dates."""
    if not names:
        return []
    row = df.agg(*[F.struct(F.count(parse_any(F.col(c))).alias("hits"), F.count(c).alias("n")).alias(f"c{i}") for i, c in enumerate(names)]).first()
    return [(c, r["hits"], r["n"]) for c, r in zip(names, row) if 0 < r["hits"] < r["n"]]


def issues(df: DataFrame, limit: int | None = None, only: list[str] | None = None) -> DataFrame:
    """Issues by severity: category, columns, severity and the measured ratio.

    All issues, or the first `limit`. `only` restricts the search to some categories and skips the passes of the others.
    """
    p = profile(df, top=2, spread=False)
    n, found = p.rows, []
    texts, numbers = [c.name for c in p.of("text")], [c.name for c in p.of("numeric")]

    def wanted(category: str) -> bool:
        return only is None or category in only

    def add(category: str, columns: str, level: str, ratio: float) -> None:
        found.append((category, columns, level, float(ratio)))

    if not n:
        add("empty", "", "critical", 1.0)
    if n and wanted("missing"):
        for c in p.columns.values():
            important = any(h in c.name.lower() for h in IMPORTANT_HINTS)
            level = severity(c.null_share, n, (0.02, 0.05, 0.10) if important else (0.05, 0.10, 0.20))
            if c.nulls and (level != "low" or c.null_share >= 0.01):
                add("missing", c.name, level, c.null_share)
    if n and wanted("duplicates_exact"):
        share = duplicate_rows(df) / n
        if share:
            add("duplicates_exact", "", severity(share, n, (0.05, 0.10, 0.20)), share)
    column = fuzzy_candidate(p) if wanted("duplicates_fuzzy") else None
    if column:
        share = near_duplicates(df, column) / n
        if share > 0:
            add("duplicates_fuzzy", column, "medium" if share > 0.05 else "low", share)
    if wanted("near_constant"):
        for c in p.columns.values():
            if c.distinct > 1 and c.top and c.top[0][1] / c.non_null > 0.9:
                add("near_constant", c.name, "low", c.top[0][1] / c.non_null)
    if wanted("negative_values"):
        for c in p.of("numeric"):
            if any(h in c.name.lower() for h in POSITIVE_HINTS) and c.stats["negatives"]:
                add("negative_values", c.name, severity(c.stats["negatives"] / n, n), c.stats["negatives"] / n)
    if wanted("high_correlation"):
        pairs = list(combinations(numbers, 2))
        rs = map(_safe, _pair_values(df, pairs, correlation))
        strong = [(a, b, abs(r)) for (a, b), r in zip(pairs, rs) if r is not None and abs(r) > 0.975]
        for a, b, r in sorted(strong, key=lambda x: (-x[2], x[0], x[1])):
            add("high_correlation", f"{a}, {b}", "medium", r)
    if wanted("redundant_columns"):
        for a, b, share in equal_pairs(df, list(p.columns)):
            add("redundant_columns", f"{a}, {b}", "low", share)
    if wanted("date_format"):
        for c, hits, count in mixed_date_columns(df, texts):
            add("date_format", c, "medium", hits / count)
    if n and numbers and wanted("outliers"):
        for row in outlier_table(df, numbers).collect():
            share = row["outliers"] / n
            if share > 0.01:
                add("outliers", row["column"], severity(share, n, (0.05, 0.10, 0.20)), share)
    if wanted("imbalance"):
        for c in [*p.of("numeric"), *p.of("boolean")]:
            if c.distinct == 2 and c.top[0][1] / c.non_null > 0.9:
                share = c.top[0][1] / c.non_null
                add("imbalance", c.name, "high" if share > 0.95 else "medium", share)
    found.sort(key=lambda r: SEVERITIES.index(r[2]))
    ranked = [(i + 1, *r) for i, r in enumerate(found[:limit])]
    return df.sparkSession.createDataFrame(
        ranked, "position int, category string, columns string, severity string, ratio double"
    )
