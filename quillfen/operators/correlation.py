"""Correlation and covariance matrices in long form, ranks, significance."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfen.functions.stats import correlation_p_value
from quillfen.operators.frequencies import FEW_VALUES
from quillfen.operators.keyed import keyed_join
from quillfen.operators.ordered import Ordered
from quillfen.session import cut_lineage

_BATCH = 60  # aggregates that one scan computes beside each other, below the code generation limits


def rank_positions(
    df: DataFrame, column: str, keys: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """Per distinct value: rows up to it, rows with it, dense rank.  Nulls are left out.

    Equal values are counted first, so a value shared by many rows is one row here.
    """
    counted = df.dropna(subset=[*keys, column]).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_ties"))
    order = column
    if descending:
        counted, order = counted.withColumn("_down", -F.col(column)), "_down"
    walked = Ordered(counted, [order], keys).running({"_upto": F.col("_ties"), "_dense": F.lit(1).cast("long")})
    return walked.result().drop("_down")


def average_rank(
    df: DataFrame, column: str, name: str, keys: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """Add the rank of each value, ties averaged; null where the value is null."""
    places = rank_positions(df, column, keys, descending)
    rank = F.col("_upto") - F.col("_ties") + (F.col("_ties") + 1) / 2
    return keyed_join(df, places.select(*keys, column, rank.alias(name)), [*keys, column])


def ranked(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null-free rows with every value replaced by its rank among its column, ties averaged.

    All columns are counted and sorted once, as (column, value) pairs. Columns of few values get their ranks from
    broadcast tables of at most FEW_VALUES rows; the cells of all others meet their ranks in one join and are regrouped
    by row once, however many columns there are.
    """
    names = [f"c{i}" for i in range(len(columns))]
    numbers = rows.select(*[F.col(f"`{c}`").cast("double").alias(n) for n, c in zip(names, columns)])
    counted = numbers.unpivot([], names, "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("_ties"))
    counted = cut_lineage(counted)
    sizes = {r["column"]: r["n"] for r in counted.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = Ordered(counted, ["value"], ["column"]).running({"_upto": F.col("_ties")}).result()
    rank = (F.col("_upto") - F.col("_ties") + (F.col("_ties") + 1) / 2).alias("rank")
    places = cut_lineage(places.select("column", "value", rank))
    few = [n for n in names if sizes.get(n, 0) <= FEW_VALUES]
    many = [n for n in names if n not in few]
    made = numbers
    for n in few:
        own = places.filter(F.col("column") == n).select(F.col("value").alias(n), F.col("rank").alias(f"{n}_rank"))
        made = keyed_join(made, own, [n], small=True).drop(n).withColumnRenamed(f"{n}_rank", n)
    if len(many) == 1:
        own = places.filter(F.col("column") == many[0]).select(F.col("value").alias(many[0]), "rank")
        made = keyed_join(made, own, many).drop(many[0]).withColumnRenamed("rank", many[0])
    elif many:
        cells = made.withColumn("row", F.monotonically_increasing_id()).unpivot(["row", *few], many, "column", "value")
        met = keyed_join(cells, places, ["column", "value"])
        kept = [F.first(n).alias(n) for n in few]
        made = met.groupBy("row").agg(*kept, *[F.max(F.when(F.col("column") == n, F.col("rank"))).alias(n) for n in many])
    return made.select(*[F.col(n).alias(c) for n, c in zip(names, columns)])


def correlation(a: Column, b: Column) -> Column:
    """Pearson r over the rows where both are known; null when one of them does not vary."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _known(a: Column, b: Column) -> Column:
    """Rows where both are known."""
    return F.count_if(a.isNotNull() & b.isNotNull())


def _pair_values(df: DataFrame, pairs: Sequence[tuple[str, str]], measure) -> list:
    """One aggregate per pair in one scan; where they are too many for that, all pairs from blocked products."""
    if not pairs:
        return []
    if len(pairs) > _BATCH and measure in (correlation, F.covar_samp, _known):
        return _product_values(df, pairs, measure)
    out: list = []
    for start in range(0, len(pairs), _BATCH):
        block = pairs[start : start + _BATCH]
        row = df.agg(*[measure(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(f"p{i}")
                       for i, (a, b) in enumerate(block)]).first()
        out.extend(row)
    return out


def products(df: DataFrame, columns: Sequence[str]) -> dict[str, np.ndarray]:
    """Sums over the rows where both columns of a pair are known, from one scan of the centred values X and their mask M.

    `n` = M'M, `x` = X'M, `xx` = (X*X)'M and `xy` = X'X, each with a row and a column per column. The values are
    centred by their means of an earlier scan, so nothing cancels. A task sends one row per pair, whatever its rows.
    """
    k = len(columns)
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    means = [m if m is not None and math.isfinite(m) else 0.0 for m in numbers.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(k)]).first()]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for batch in batches:
            known = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(float)
            values = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            centred = np.where(known > 0, values - np.array(means), 0.0)
            total += np.stack([known.T @ known, centred.T @ known, (centred * centred).T @ known, centred.T @ centred])
        i, j = np.divmod(np.arange(k * k), k)
        sums = [pa.array(part.ravel()) for part in total]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *sums], names=["i", "j", "n", "x", "xx", "xy"])

    names = ("n", "x", "xx", "xy")
    made = numbers.mapInArrow(summed, "i int, j int, n double, x double, xx double, xy double")
    out = {name: np.zeros((k, k)) for name in names}
    for row in made.groupBy("i", "j").agg(*[F.sum(name).alias(name) for name in names]).collect():  # one row per pair
        for name in names:
            out[name][row["i"], row["j"]] = row[name]
    return out


def _product_values(df: DataFrame, pairs: Sequence[tuple[str, str]], measure) -> list:
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    place = {c: i for i, c in enumerate(columns)}
    sums = products(df, columns)
    n = sums["n"]
    with np.errstate(all="ignore"):
        joint = sums["xy"] - sums["x"] * sums["x"].T / n
        spread = sums["xx"] - sums["x"] ** 2 / n
        spread[spread <= 1e-13 * sums["xx"]] = 0.0  # a column that does not vary on these rows
        both = np.sqrt(spread * spread.T)
        table = n if measure is _known else np.where(n > 1, joint / (n - 1), np.nan) if measure is F.covar_samp else np.where(both > 0, joint / both, np.nan)
    return [None if np.isnan(v) else float(v) for v in (table[place[a], place[b]] for a, b in pairs)]


def _safe(value):
    return None if value is None or value != value else float(value)


def matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson", complete: bool = True) -> DataFrame:
    """Long square matrix (x, y, value); `method` is pearson, spearman or covariance.

    complete=True keeps rows without nulls only, otherwise each pair uses its own rows.
    """
    rows = df.select(*columns)
    rows = rows.dropna() if complete or method == "spearman" else rows
    if method == "spearman":
        rows = ranked(rows, columns)
    measure = F.covar_samp if method == "covariance" else correlation
    pairs = list(combinations(columns, 2))
    if method == "covariance":
        pairs += [(c, c) for c in columns]
    values = dict(zip(pairs, map(_safe, _pair_values(rows, pairs, measure))))
    cells = []
    for x in columns:
        for y in columns:
            value = values.get((x, y), values.get((y, x)))
            cells.append((x, y, 1.0 if x == y and method != "covariance" else value))
    return df.sparkSession.createDataFrame(cells, "x string, y string, value double")


def significance(df: DataFrame, columns: Sequence[str], method: str = "pearson", level: float = 0.05) -> DataFrame:
    """r, points and p-value per pair; `insignificant` marks p > level."""
    spark = df.sparkSession
    pairs = list(combinations(columns, 2))
    rows = df.select(*columns)
    counts = _pair_values(rows, pairs, _known)
    if method == "spearman":
        nulls = rows.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        full = [c for c, missing in zip(columns, nulls) if not missing]  # their pairs share all rows and so their ranks
        cells = matrix(rows, full, "spearman").collect() if len(full) > 1 else []
        values = {(r["x"], r["y"]): r["value"] for r in cells}
        for a, b in pairs:
            if (a, b) in values:
                continue
            part = matrix(rows, [a, b], "spearman").filter((F.col("x") == a) & (F.col("y") == b)).first()
            values[(a, b)] = part["value"]
        rs = [values[p] for p in pairs]
    else:
        rs = [_safe(v) for v in _pair_values(rows, pairs, correlation)]
    out = []
    for (a, b), r, n in zip(pairs, rs, counts):
        p = correlation_p_value(r, n)
        out.append((a, b, r, int(n), p, p > level))
    return spark.createDataFrame(out, "x string, y string, r double, points long, p_value double, insignificant boolean")


def top_pairs(
    df: DataFrame, columns: Sequence[str], n: int = 5, business_terms: Sequence[str] = ()
) -> DataFrame:
    """Strongest pairs by |r|; with business terms, pairs that name them come first."""
    pairs = list(combinations(columns, 2))
    values = [_safe(v) for v in _pair_values(df, pairs, correlation)]
    rows = []
    for (a, b), r in zip(pairs, values):
        if r is not None:
            relevance = sum(any(term in c.lower() for term in business_terms) for c in (a, b))
            rows.append((a, b, r, relevance))
    rows.sort(key=lambda r: (-r[3], -abs(r[2]), r[0], r[1]))
    return df.sparkSession.createDataFrame(rows[:n], "x string, y string, corr double, business_relevance int")


def target_correlation(df: DataFrame, features: Sequence[str], target: str, n: int = 10) -> DataFrame:
    """|r| of each feature with the target, strongest first."""
    pairs = [(f, target) for f in features if f != target]
    values = [_safe(v) for v in _pair_values(df, pairs, correlation)]
    rows = sorted(((f, abs(v)) for (f, _), v in zip(pairs, values) if v is not None), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame(rows[:n], "feature string, correlation_with_target double")


def pair_correlation(x: str, y: str) -> Column:
    return correlation(F.col(x).cast("double"), F.col(y).cast("double"))
