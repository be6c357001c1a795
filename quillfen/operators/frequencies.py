"""Exact distinct counts and most frequent values without shuffling the cells of a table.

One scan estimates how many values each column has. Columns with few are counted together: the counts fold within the
tasks, so a task sends a few rows per column. Columns with many are counted one by one in their own type, texts that
are long by a 128-bit hash; only then are the few texts that a report shows looked up. The estimate decides the way,
never the answer.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Estimated values up to which a column is counted with others, and bytes from which a text is counted by its hash.
FEW_VALUES, LONG_TEXT = 1000, 32
_COLUMNS_PER_JOB = 16


@dataclass
class Counted:
    """Distinct values of a column, its most frequent ones by (count, text), and the count of the rarest."""

    distinct: int = 0
    least: int = 0
    top: list[tuple[str, int]] = field(default_factory=list)


def estimates(column: str, data_type: T.DataType) -> list[Column]:
    """Aggregates that choose the way of counting: about how many values, and how long they are."""
    own = F.col(f"`{column}`")
    size = F.avg(F.octet_length(own)) if isinstance(data_type, T.StringType) else F.lit(0.0)
    return [F.approx_count_distinct(own), size]


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per (column, value), nulls left out; for columns of few values."""
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    long = text.unpivot([], columns, "column", "value").filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def row_key(columns: list[Column]) -> list[Column]:
    """A 128-bit hash of values in two halves; nulls count as values."""
    marked = [x for c in columns for x in (c, c.isNull())]
    return [F.xxhash64(*marked).alias("_key_a"), F.xxhash64(F.lit(1), *marked).alias("_key_b")]


def _typed(df: DataFrame, column: str) -> DataFrame:
    own = df.select(F.col(f"`{column}`").alias("value")).filter(F.col("value").isNotNull())
    return own.groupBy("value").agg(F.count(F.lit(1)).alias("count"))


def _hashed(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(texts with keys, count per key)."""
    own = df.select(F.col(f"`{column}`").alias("value")).filter(F.col("value").isNotNull())
    keyed = own.select("value", *row_key([F.col("value")]))
    return keyed, keyed.groupBy("_key_a", "_key_b").agg(F.count(F.lit(1)).alias("count"))


def _totals(counts: DataFrame, column: str) -> DataFrame:
    """The number of values and the least count, in the layout of `_leading`."""
    return counts.agg(
        F.lit(column).alias("column"), F.lit(True).alias("total"), F.min("count").cast("string").alias("value"),
        F.count(F.lit(1)).alias("count"),
    )


def _leading(counts: DataFrame, column: str, k: int) -> DataFrame:
    text = counts.select(F.lit(column).alias("column"), F.lit(False).alias("total"), F.col("value").cast("string").alias("value"), "count")
    return text.orderBy(F.desc("count"), "value").limit(k)


def _top_texts(df: DataFrame, column: str, k: int) -> list[tuple[str, int]]:
    """The k most frequent texts, ties to the smaller, by hashes first and texts of the winners afterwards."""
    keyed, counts = _hashed(df, column)
    best = counts.orderBy(F.desc("count")).limit(k).collect()
    if not best:
        return []
    border = best[-1]["count"]
    above = {(r["_key_a"], r["_key_b"]): r["count"] for r in best if r["count"] > border}
    named = F.struct("_key_a", "_key_b").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in above]) if above else F.lit(False)
    found = [(r["value"], above[r["_key_a"], r["_key_b"]]) for r in keyed.filter(named).distinct().collect()] if above else []
    if border == 1:  # all other texts occur once: the smallest ones need no join
        rest = keyed.filter(~named)
    else:
        tied = counts.filter(F.col("count") == border)
        rest = keyed.join(tied, ["_key_a", "_key_b"], "left_semi").dropDuplicates(["_key_a", "_key_b"])
    texts = rest.select("value").orderBy("value").limit(k - len(found)).collect()
    return found + [(r["value"], border) for r in texts]


def count_values(
    df: DataFrame, columns: list[str], top: int = 0, estimated: dict[str, tuple[int, float]] | None = None
) -> dict[str, Counted]:
    """Exact counts of every column; `estimated` are the results of `estimates` where they are known already."""
    out = {c: Counted() for c in columns}
    if not columns:
        return out
    types = {f.name: f.dataType for f in df.schema}
    if estimated is None:
        flat = [e.alias(f"e{i}_{j}") for i, c in enumerate(columns) for j, e in enumerate(estimates(c, types[c]))]
        row = list(df.agg(*flat).first())
        estimated = {c: (row[2 * i], row[2 * i + 1] or 0.0) for i, c in enumerate(columns)}
    few = [c for c in columns if estimated[c][0] <= FEW_VALUES]
    many = [c for c in columns if c not in few]
    parts = []
    if few:
        counts = value_frequencies(df, few)
        parts.append(counts.groupBy("column").agg(F.lit(True).alias("total"), F.min("count").cast("string").alias("value"), F.count(F.lit(1)).alias("count")))
        if top:
            order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
            best = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            parts.append(best.select("column", F.lit(False).alias("total"), "value", "count"))
    for c in many:
        long = (estimated[c][1] or 0.0) >= LONG_TEXT and isinstance(types[c], T.StringType)
        counts = _hashed(df, c)[1] if long else _typed(df, c)
        parts.append(_totals(counts, c))
        if top and long:
            out[c].top = _top_texts(df, c, top)
        elif top:
            parts.append(_leading(counts, c, top))
    for start in range(0, len(parts), 2 * _COLUMNS_PER_JOB):
        rows = reduce(DataFrame.unionByName, parts[start : start + 2 * _COLUMNS_PER_JOB]).collect()  # top + 1 rows per column
        for row in rows:
            if row["total"]:
                out[row["column"]].distinct, out[row["column"]].least = row["count"], int(row["value"] or 0)
            else:
                out[row["column"]].top.append((row["value"], row["count"]))
    for counted in out.values():
        counted.top.sort(key=lambda r: (-r[1], r[0].encode()))
    return out
