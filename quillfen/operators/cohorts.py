"""Customer cohorts: assignment, retention and revenue by periods since the first purchase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfen.operators.keyed import group_values, keyed_join
from quillfen.operators.timeseries import parsed_dates, period_number, period_start, unit_of


def assign(df: DataFrame, customer: str, date: str, unit: str = "month") -> DataFrame:
    """Each purchase with its customer's first period and the periods since then."""
    unit = unit_of(unit)
    rows = parsed_dates(df, date).dropna(subset=[customer])
    rows = group_values(rows, [customer], _first=F.min(date))
    first, now = period_number(F.col("_first"), unit), period_number(F.col(date), unit)
    return rows.withColumns(
        {"cohort": period_start(first, unit), "order_period": period_start(now, unit), "cohort_index": now - first}
    ).drop("_first")


def matrix(cohorts: DataFrame, customer: str, value: str | None = None) -> DataFrame:
    """Long matrix: customers, retention percent and revenue per cohort and index."""
    aggregates = [F.countDistinct(customer).alias("customers")]
    if value:
        aggregates.append(F.sum(value).alias("revenue"))
    cells = cohorts.groupBy("cohort", "cohort_index").agg(*aggregates)
    size = cells.filter("cohort_index = 0").select("cohort", F.col("customers").alias("size"))
    joined = keyed_join(cells, size, ["cohort"])
    return joined.withColumn("retention", F.try_divide(F.col("customers") * 100.0, F.col("size")))


def wide_matrix(cells: DataFrame, measure: str, indexes: list[int]) -> DataFrame:
    """Matrix with one column per index."""
    return cells.groupBy("cohort").pivot("cohort_index", indexes).agg(F.max(measure))


def cohort_summary(cells: DataFrame) -> DataFrame:
    """Size, retention after 1, 3 and 6 periods, first-period revenue and order value."""

    def at(index: int, column: str):
        return F.max(F.when(F.col("cohort_index") == index, F.col(column)))

    revenue = []
    if "revenue" in cells.columns:
        revenue = [
            F.try_divide(at(0, "revenue"), F.max("size").cast("double")).alias("avg_order_value"),
            at(0, "revenue").alias("total_revenue"),
        ]
    return cells.groupBy("cohort").agg(
        F.max("size").alias("cohort_size"),
        *[at(k, "retention").alias(f"avg_retention_{k}") for k in (1, 3, 6)],
        *revenue,
    )


def overall(cells: DataFrame) -> DataFrame:
    """Totals over all cohorts; retention is the mean of the cohorts' own means."""
    revenue = [F.sum("revenue").alias("revenue")] if "revenue" in cells.columns else []
    per = cells.groupBy("cohort").agg(F.max("size").alias("size"), F.avg("retention").alias("retention"), *revenue)
    extra = []
    if revenue:
        extra = [
            F.sum("revenue").alias("total_revenue"),
            F.try_divide(F.sum("revenue"), F.sum("size").cast("double")).alias("average_revenue_per_user"),
        ]
    return per.agg(
        F.count(F.lit(1)).alias("total_cohorts"), F.sum("size").alias("total_users"),
        F.avg("size").alias("average_cohort_size"), F.avg("retention").alias("average_retention_rate"), *extra,
    )
