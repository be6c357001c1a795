"""Random, stratified and adaptive samples; deterministic for a seed."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfen.operators.ingest import text_columns
from quillfen.operators.keyed import keyed_join
from quillfen.operators.ordered import Ordered
from quillfen.operators.profile import complexity_score, sampling_profile


def row_hash(df: DataFrame, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])


def random_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(fraction, seed)


def stratified_fraction(df: DataFrame, stratum: str, fraction: float, seed: int = 42) -> DataFrame:
    """Exactly the ceil(fraction * n) rows with the lowest hashes of each stratum.

    Rows whose hash lies far above the wanted share are dropped before anything is
    ordered; should a stratum come out short, which is checked, no row is dropped.
    """
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    spread = 6 * F.sqrt(F.lit(fraction * (1 - fraction)) / F.col("_n")) + 10 / F.col("_n")
    sizes = sizes.select(stratum, F.ceil(F.col("_n") * F.lit(fraction)).alias("_keep"), (F.lit(fraction) + spread).alias("_cut"))
    hashed = keyed_join(df.withColumn("_hash", row_hash(df, seed)), sizes, [stratum])
    low = hashed.filter(F.col("_hash") / F.lit(2.0**64) + 0.5 <= F.col("_cut"))
    short = low.groupBy(stratum).agg(F.count(F.lit(1)).alias("_low"))
    missing = keyed_join(sizes, short, [stratum]).filter(F.coalesce("_low", F.lit(0)) < F.col("_keep"))
    chosen = hashed if missing.limit(1).count() else low
    placed = Ordered(chosen, ["_hash"], [stratum]).row_index("_place").result()
    return placed.filter("_place <= _keep").select(*df.columns)


def adaptive_fraction(score: float, temporal: bool) -> float:
    fraction = min(0.9, max(0.3, 1.0 - 0.08 * score))
    return min(0.8, fraction) if temporal else fraction


class Sample(NamedTuple):
    data: DataFrame
    sampled: bool
    fraction: float
    stratum: str | None
    score: float


def smart_sample(
    df: DataFrame, size_threshold: int = 100_000, complexity_threshold: float = 5.0, seed: int = 42, stratum: str | None = None
) -> Sample:
    """Sample only big or complex tables, by the most imbalanced category where there is one."""
    p, facts = sampling_profile(df)
    score = complexity_score(df, (p, facts))
    if p.rows <= size_threshold and score <= complexity_threshold:
        return Sample(df, False, 1.0, None, score)
    fraction = adaptive_fraction(score, bool(facts["temporal"]))
    if stratum not in df.columns:
        fits = {c: r for c, r in facts["imbalance"].items() if p.columns[c].distinct <= 50 and r > 5}
        stratum = max(fits, key=fits.get) if fits else None
    if stratum and p.columns[stratum].distinct > 1:
        return Sample(stratified_fraction(df, stratum, fraction, seed), True, fraction, stratum, score)
    return Sample(random_fraction(df, fraction, seed), True, fraction, None, score)


def equal_allocation(df: DataFrame, stratum: str, limit: int, seed: int = 42) -> DataFrame:
    """limit // strata rows of each stratum, one at least, in hash order; null is a stratum of its own.

    With more strata than `limit` there are as many rows as strata, so none is lost.
    """
    strata = df.select(stratum).distinct().count()
    per = max(1, limit // max(1, strata))
    # The rank filter is applied per task before the shuffle.
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(row_hash(df, seed)))
    return df.withColumn("_place", place).filter(F.col("_place") <= per).drop("_place")


def diverse_head(df: DataFrame, rows: int = 20, seed: int = 42) -> DataFrame:
    """A few rows of each value of the first text column."""
    names = text_columns(df)
    if not names:
        return df.withColumn("_hash", row_hash(df, seed)).orderBy("_hash").limit(rows).drop("_hash")
    return equal_allocation(df, names[0], 3 * rows, seed).limit(rows)
