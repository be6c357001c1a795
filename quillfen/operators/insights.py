"""Insight mining over (category, metric) pairs, on full data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfen.operators.keyed import keyed_join
from quillfen.operators.ordered import Ordered
from quillfen.operators.profile import Profile, profile

# Ranking weight and base impact per insight type.
PRIORITY = {
    "dependency_risk": 10.0, "missing_data_opportunity": 8.5, "golden_period": 8.0, "strong_pareto": 7.0,
    "business_relationship": 6.5, "significant_trend": 6.0, "moderate_concentration": 5.0, "high_volatility": 4.0,
    "healthy_distribution": 3.0,
}
IMPACT = {
    "dependency_risk": 0.9, "missing_data_opportunity": 0.8, "golden_period": 0.8, "strong_pareto": 0.7,
    "business_relationship": 0.7, "significant_trend": 0.6, "high_volatility": 0.6, "moderate_concentration": 0.5,
    "healthy_distribution": 0.4,
}


def segment_table(df: DataFrame, categories: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """sum, mean and count per (category, segment, metric), all pairs in one pass."""
    numbers = [F.col(m).cast("double").alias(m) for m in metrics]
    text = df.select(*[F.col(c).cast("string").alias(c) for c in categories if c not in metrics], *numbers)
    long = text.unpivot(list(metrics), list(categories), "category", "segment").filter(F.col("segment").isNotNull())
    sums = []
    for m in metrics:
        sums += [F.sum(m).alias(f"{m}\x1fsum"), F.avg(m).alias(f"{m}\x1fmean"), F.count(m).alias(f"{m}\x1fcount")]
    wide = long.groupBy("category", "segment").agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), F.col(f"{m}\x1fsum").alias("total"), F.col(f"{m}\x1fmean").alias("mean"),
                F.col(f"{m}\x1fcount").alias("count"),
            )
            for m in metrics
        ]
    )
    return wide.select("category", "segment", F.explode(rows).alias("r")).select("category", "segment", "r.*")


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def relationships(
    df: DataFrame, categories: Sequence[str], metrics: Sequence[str], min_ratio: float = 1.5, min_share: float = 0.02,
    min_rows: float = 0.05, dependency: float = 0.5, limit: int | None = None,
) -> DataFrame:
    """Best segment per (category, metric) that is large, strong and above average; all pairs, or the first `limit`."""
    segments = segment_table(df, categories, metrics)
    # One row per pair.
    pairs = segments.groupBy("category", "metric").agg(F.sum("total").alias("_all"), F.count(F.lit(1)).alias("_groups"))
    means = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.avg(m).alias(m) for m in metrics])
    overall = means.unpivot(["_rows"], list(metrics), "metric", "_mean")
    joined = keyed_join(segments, pairs, ["category", "metric"], "inner", small=True)
    joined = keyed_join(joined, overall, ["metric"], "inner", small=True)
    scored = joined.withColumns(
        {"share": F.try_divide("total", "_all"), "ratio": F.try_divide(F.col("mean"), F.col("_mean"))}
    ).filter(
        (F.col("_groups") >= 3) & (F.col("count") >= F.col("_rows") * min_rows)
        & (F.col("share") >= min_share) & (F.col("ratio") >= min_ratio)
    )
    best = scored.groupBy("category", "metric").agg(
        F.max_by(F.struct("segment", "share", "ratio", "count"), F.struct("share", "ratio", "segment")).alias("b")
    ).select("category", "metric", F.col("b.segment").alias("top_segment"), "b.share", "b.ratio", F.col("b.count").alias("rows"))
    kind = F.when(F.col("share") > dependency, "dependency_risk").otherwise("business_relationship")
    out = best.withColumns({"type": kind, "multiplier": F.when(F.col("share") > dependency, 2.5).otherwise(1.5)})
    return _first(out.orderBy(F.desc(F.col("share") * F.col("ratio")), "category", "metric"), limit)


def pareto(
    df: DataFrame, categories: Sequence[str], metrics: Sequence[str], threshold: float = 0.8, dependency: float = 0.5
) -> DataFrame:
    """How many top segments hold 80 % of each metric, and the concentration class."""
    segments = segment_table(df, categories, metrics).select("category", "segment", "metric", F.coalesce("total", F.lit(0.0)).alias("total"))
    keys = ["category", "metric"]
    pairs = segments.groupBy(*keys).agg(F.sum("total").alias("_all"), F.count(F.lit(1)).alias("groups"))
    pairs = pairs.filter((F.col("groups") >= 5) & (F.col("_all") != 0))
    ordered = Ordered(segments.withColumn("_down", -F.col("total")), ["_down", "segment"], keys)
    walked = ordered.running({"_cum": F.col("total"), "_rank": F.lit(1).cast("long")}).result()
    shares = keyed_join(walked, pairs, keys, "inner", small=True).withColumn("_cum", F.col("_cum") / F.col("_all"))
    inside = F.col("_cum") <= threshold
    points = shares.groupBy(*keys).agg(
        F.max("groups").alias("groups"), (F.count_if(inside) + 1).alias("pareto_point"),
        F.min(F.when(~inside, F.col("_cum"))).alias("concentration"),
        F.max(F.when(F.col("_rank") == 1, F.col("segment"))).alias("top_item"),
    )
    k, c = F.col("pareto_point"), F.col("concentration")
    kind = (
        F.when((k == 1) & (c >= dependency), "dependency_risk")
        .when((k <= 3) & (c >= 0.8), "strong_pareto")
        .when((k <= 5) & (c >= 0.6), "moderate_concentration")
        .when(k >= 10, "healthy_distribution")
    )
    weight = F.when(F.col("type") == "dependency_risk", 2.5).when(F.col("type") == "strong_pareto", 2.0).when(
        F.col("type") == "moderate_concentration", 1.5
    ).otherwise(1.0)
    return points.withColumn("type", kind).withColumn("multiplier", F.when(F.col("type").isNotNull(), weight))


def missing_impact(df: DataFrame, columns: Sequence[str], metrics: Sequence[str], threshold: float = 0.2) -> DataFrame:
    """Difference of a metric's mean between rows where a column is missing and where it is not."""
    pairs = [(c, m) for c in columns for m in metrics if c != m]
    cells = []
    for c, m in pairs:
        gone = F.col(c).isNull()
        value = F.col(m).cast("double")
        cells.append(
            F.struct(
                F.lit(c).alias("missing_column"), F.lit(m).alias("metric"), F.avg(gone.cast("double")).alias("missing_share"),
                F.count_if(gone).alias("missing"), F.count_if(~gone).alias("present"),
                F.avg(F.when(gone, value)).alias("mean_missing"), F.avg(F.when(~gone, value)).alias("mean_present"),
            )
        )
    long = df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    base = F.abs("mean_present")
    difference = F.when(base > 1e-9, (F.col("mean_missing") - F.col("mean_present")) / base)
    out = long.filter((F.col("missing") >= 5) & (F.col("present") >= 5)).withColumn("difference", difference)
    out = out.filter(F.abs("difference") > threshold)
    kind = F.when(F.col("difference") > 0.3, "missing_data_opportunity").otherwise("missing_data_impact")
    return out.select(
        "missing_column", "metric", "missing_share", "mean_missing", "mean_present", "difference", kind.alias("type"),
        F.when(F.col("difference") > 0.3, 2.0).otherwise(1.5).alias("multiplier"),
    )


def best_per_metric(insights: DataFrame, order: Sequence[str] = ("category",), limit: int | None = None) -> DataFrame:
    """One insight per metric, the one with the highest multiplier; all metrics, or the first `limit` by name."""
    # One row per (category, metric) pair comes in.
    spec = Window.partitionBy("metric").orderBy(F.desc("multiplier"), *order)
    first = insights.filter(F.col("type").isNotNull()).withColumn("_rank", F.row_number().over(spec))
    return _first(first.filter("_rank = 1").drop("_rank").orderBy("metric"), limit)


def ranked(insights: DataFrame, limit: int | None = None) -> DataFrame:
    """Priority = type weight x multiplier; impact = type impact scaled by share, concentration or difference."""

    def lookup(table: dict, default: float):
        column = F.lit(default)
        for name, value in table.items():
            column = F.when(F.col("type") == name, F.lit(value)).otherwise(column)
        return column

    factors = []
    for name, scale in (("share", 2.0), ("concentration", 2.0), ("difference", 1.0)):
        if name in insights.columns:
            factors.append(F.least(F.lit(1.0), F.abs(F.col(name)) * scale))
    factor = F.coalesce(*factors, F.lit(1.0)) if factors else F.lit(1.0)
    impact = F.least(F.lit(1.0), F.greatest(F.lit(0.1), lookup(IMPACT, 0.5) * factor))
    out = insights.withColumns({"priority": lookup(PRIORITY, 5.0) * F.col("multiplier"), "impact": impact})
    ties = ["metric", "type", *(["category"] if "category" in insights.columns else [])]
    return _first(out.orderBy(F.desc("priority"), F.desc("impact"), *ties), limit)


def leader_ratio(df: DataFrame, category: str, metric: str) -> DataFrame:
    """Mean of the best group over the mean of the second; needs three groups."""
    means = df.dropna(subset=[category]).groupBy(category).agg(F.avg(metric).alias("mean"))
    groups = means.agg(F.count(F.lit(1))).scalar()
    top = means.orderBy(F.desc("mean"), category).limit(2)
    ordered = top.select(F.col(category).cast("string").alias("leader"), "mean").agg(
        F.max_by("leader", "mean").alias("leader"), F.max("mean").alias("first"), F.min("mean").alias("second")
    )
    ratio = F.when((groups >= 3) & (F.abs("second") > 1e-9), F.col("first") / F.col("second"))
    return ordered.withColumn("ratio", ratio)


def variation_scores(df: DataFrame, top: int = 10, p: Profile | None = None) -> DataFrame:
    """IQR over |median| (capped at 1) for numbers, normalised entropy of the top values for text."""
    import math

    p = p or profile(df, top=top)
    rows = []
    for c in p.columns.values():
        score = 0.5
        if c.group == "numeric" and c.stats.get("q50") is not None and abs(c.stats["q50"]) > 1e-9:
            score = min(1.0, (c.stats["q75"] - c.stats["q25"]) / abs(c.stats["q50"]))
        elif c.group in ("text", "boolean"):
            total = sum(n for _, n in c.top)
            if c.distinct <= 1:
                score = 0.0
            elif total:
                entropy = -sum(n / total * math.log2(n / total + 1e-9) for _, n in c.top)
                score = entropy / math.log2(c.distinct + 1e-9)
        rows.append((c.name, score))
    return df.sparkSession.createDataFrame(rows, "column string, variation double")


def mine(df: DataFrame, categories: Sequence[str], metrics: Sequence[str], nullable: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Relationship, concentration and missing-data insights, ranked together."""
    parts = [
        relationships(df, categories, metrics).select("type", "category", "metric", "multiplier", "share"),
        best_per_metric(pareto(df, categories, metrics)).select("type", "category", "metric", "multiplier", "concentration"),
    ]
    if nullable:
        impact = missing_impact(df, nullable, metrics).withColumnRenamed("missing_column", "category")
        parts.append(impact.select("type", "category", "metric", "multiplier", "difference"))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return ranked(merged.dropDuplicates(["type", "category", "metric"]), limit)
