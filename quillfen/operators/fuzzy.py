"""Near-equal values: exact similarity join, first-seen clusters, schema matching.

Similarity is the indel ratio 2*LCS/(a+b), rounded to whole percent.  Two texts
that reach the threshold lose only so many 3-grams that their rarest grams must
meet (prefix filter), so candidates come from a join on rare grams and no pair is
missed.  Values that sound alike (equal Metaphone codes) can count as equal too; they
meet through the first of their class.  Clusters are those of scanning the values in first-seen order: a value
joins the earliest seed it resembles, else it becomes a seed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfen.functions.phonetic import metaphone
from quillfen.functions.text import comparable, title_case
from quillfen.operators.keyed import keyed_join
from quillfen.operators.ordered import Ordered
from quillfen.operators.profile import profile
from quillfen.session import cut_lineage

_Q = 3


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit per character of `a`."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hits = state & places.get(c, 0)
        state = ((state + hits) | (state - hits)) & full
    return len(a) - state.bit_count()


def percent_ratio(a: str, b: str) -> int:
    if a == b:
        return 100
    total = len(a) + len(b)
    return round(200.0 * common_length(a, b) / total) if a and b else 0


def _ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([percent_ratio(a, b) for a, b in zip(left, right)], dtype="int32")


def similarity(left: str, right: str) -> Column:
    return F.pandas_udf(_ratios, T.IntegerType())(left, right)


def _lost_grams(threshold: float) -> float:
    """Most 3-grams, per character, that a text can lose to a partner above the threshold."""
    half = threshold / 2
    shortest, longest = half / (1 - half), (1 - half) / half
    return max(_Q + (_Q - 1) * b - (2 * _Q - 1) * half * (1 + b) for b in (shortest, longest))


def similar_pairs(texts: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(a, b) ids, a < b, of all `texts` (id, text) whose ratio reaches the threshold."""
    cut = threshold - 0.005  # ratios are rounded to whole percent
    lost = _lost_grams(cut)
    growth = (2 - cut) / cut
    base = texts.filter(F.length("text") > 0).withColumn("size", F.length("text"))
    padded = F.concat(F.lit("\x02" * (_Q - 1)), F.col("text"), F.lit("\x03" * (_Q - 1)))
    grams = base.withColumn("padded", padded).select(
        "id", "size",
        F.explode(
            F.transform(F.sequence(F.lit(1), F.col("size") + _Q - 1), lambda i: F.substr(F.col("padded"), i, F.lit(_Q)))
        ).alias("gram"),
    )
    # Repeated grams of one text are told apart by their number.
    counted = grams.groupBy("id", "size", "gram").agg(F.count(F.lit(1)).alias("times"))
    tokens = counted.select("id", "size", "gram", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("turn"))
    frequency = tokens.groupBy("gram", "turn").agg(F.count(F.lit(1)).alias("uses"))
    rarest = Window.partitionBy("id").orderBy("uses", "gram", "turn")  # one text per partition
    keep = F.floor(F.col("size") * F.lit(lost)) + 1
    prefix = (
        keyed_join(tokens, frequency, ["gram", "turn"], "inner")
        .withColumn("place", F.row_number().over(rarest)).filter(F.col("place") <= keep)
        .withColumn("band", F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(growth))).cast("int"))
    )
    left = prefix.filter("uses > 1").select(F.col("id").alias("a"), F.col("size").alias("a_size"), "gram", "turn", "band")
    right = prefix.filter("uses > 1").select(
        F.col("id").alias("b"), F.col("size").alias("b_size"), "gram", "turn",
        F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"),
    )
    shorter, longer = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
    candidates = left.join(right, ["gram", "turn", "band"]).filter(
        (F.col("a") < F.col("b")) & (shorter * F.lit(growth) >= longer)
    ).select("a", "b").distinct()
    first = base.select(F.col("id").alias("a"), F.col("text").alias("a_text"))
    second = base.select(F.col("id").alias("b"), F.col("text").alias("b_text"))
    # The indel distance is never below the edit distance, which is tested in the JVM before any text goes to Python.
    most = F.floor(F.lit(1 - cut) * (F.length("a_text") + F.length("b_text")) + F.lit(1e-9))
    near = candidates.join(first, "a").join(second, "b").filter(F.levenshtein("a_text", "b_text") <= most)
    checked = near.withColumn("percent", similarity("a_text", "b_text"))
    return checked.filter(F.col("percent") >= round(threshold * 100)).select("a", "b", "percent")


def _united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _pivots(nodes: DataFrame) -> DataFrame:
    """(a, b) from the first node of every class to each other node of it: one edge a node, whatever the class."""
    classed = nodes.filter(F.col("class").isNotNull())
    first = classed.groupBy("class").agg(F.min("id").alias("a"))
    return classed.join(first, "class").filter(F.col("a") < F.col("id")).select("a", F.col("id").alias("b"))


def first_seen_clusters(edges: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(id, seed) of every clustered id: seeds have no earlier seed next to them.

    Ids are next to each other by an edge (a, b), a < b, or by an equal class of `classes` (id, class). Among the
    open ids of a class only the first can be a seed, so it stands for the class and pairs are never listed. Each
    round writes what it settled and what is left open, not what earlier rounds settled.
    """
    edges = cut_lineage(edges.select("a", "b"))
    kind = edges.schema["a"].dataType.simpleString()
    classed = edges.sparkSession.createDataFrame([], f"id {kind}, class string") if classes is None else classes
    classed = cut_lineage(classed.select("id", "class")) if classes is not None else classed
    open_edges, open_nodes = edges, classed
    seeded, absorbed = [], []
    while True:
        near = open_edges.unionByName(_pivots(open_nodes)) if classes is not None else open_edges
        near = cut_lineage(near) if classes is not None else near
        if not near.limit(1).count():
            break
        waiting = near.select(F.col("b").alias("a")).distinct()
        seeds = cut_lineage(near.select("a").distinct().join(waiting, "a", "left_anti").select(F.col("a").alias("id")))
        taken = cut_lineage(near.join(seeds.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        seeded.append(seeds)
        absorbed.append(taken)
        gone = taken.unionByName(seeds)
        for end in ("a", "b"):
            open_edges = open_edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
        open_edges = cut_lineage(open_edges.select("a", "b"))
        open_nodes = open_nodes.join(gone, "id", "left_anti")
        if classes is not None:
            open_nodes = cut_lineage(open_nodes)
    if not seeded:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("seed")).limit(0)
    seeds, members = _united(seeded), _united(absorbed)
    offers = edges.join(seeds.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id"), F.col("a").alias("seed"))
    if classes is not None:  # a class has one seed at most: a second would be next to the first
        of_class = classed.join(seeds, "id", "left_semi").select("class", F.col("id").alias("seed"))
        own = classed.join(of_class, "class").filter(F.col("class").isNotNull() & (F.col("seed") < F.col("id")))
        offers = offers.unionByName(own.select("id", "seed"))
    joined = offers.join(members, "id", "left_semi").groupBy("id").agg(F.min("seed").alias("seed"))
    return joined.unionByName(joined.select(F.col("seed").alias("id"), "seed").distinct())


def sound_classes(texts: DataFrame) -> DataFrame:
    """(id, class) of the `texts` (id, text) of more than two characters that have a code."""
    coded = texts.filter(F.length("text") > 2).select("id", metaphone(F.col("text")).alias("class"))
    return coded.filter("class != ''")


class FuzzyDuplicates(NamedTuple):
    data: DataFrame
    report: DataFrame


def _order(df: DataFrame, order_by: Sequence[str]) -> Column:
    return F.min(F.struct(*order_by)) if order_by else F.min(F.struct(F.lit(0)))


def fuzzy_duplicates(
    df: DataFrame, columns: Sequence[str], threshold: float = 0.85, order_by: Sequence[str] = (), phonetic: bool = False
) -> FuzzyDuplicates:
    """Clusters of near-equal values per column, with a canonical value each.

    `order_by` defines which value was seen first; without it values count in text order. `phonetic` also takes values
    of more than two characters as equal that sound alike, by the Metaphone code of their whole folded text.
    """
    report, data = None, df
    for c in columns:
        values = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(_order(df, order_by).alias("seen"))
        placed = Ordered(values, ["seen", "value"]).row_index("id").result().select("id", "value")
        placed = cut_lineage(placed.withColumn("text", comparable(F.col("value"))))
        texts = placed.groupBy("text").agg(F.min("id").alias("id"))
        clusters = first_seen_clusters(similar_pairs(texts, threshold), sound_classes(texts) if phonetic else None)
        # Values with one folded form share the fate of the first of them.
        heads = keyed_join(texts.withColumnRenamed("id", "head"), clusters.withColumnRenamed("id", "head"), ["head"])
        heads = heads.select("text", F.coalesce("seed", "head").alias("seed"))
        members = keyed_join(placed, heads, ["text"], "inner")
        proper = (F.col("value") == title_case(F.col("value"))) | (F.col("value") == F.upper("value"))
        filled = F.length(F.trim("value")) > 0
        groups = members.groupBy("seed").agg(
            F.count(F.lit(1)).alias("members"),
            F.max_by("value", F.struct(filled, proper, F.length("value"), -F.col("id"))).alias("canonical_value"),
        ).filter("members > 1")
        groups = Ordered(groups, ["seed"]).row_index("number").result()
        found = keyed_join(members, groups, ["seed"], "inner").select(
            F.lit(c).alias("column"), F.col("value").alias("original_value"),
            F.concat(F.lit("cluster_"), (F.col("number") - 1).cast("string")).alias("cluster_id"), "canonical_value",
            F.when(F.col("members") > 2, "high").otherwise("medium").alias("confidence"),
        )
        report = found if report is None else report.unionByName(found)
        ids = found.select(F.col("original_value").alias(c), F.col("cluster_id").alias(f"{c}_duplicate_cluster"))
        data = keyed_join(data, ids, [c])
    return FuzzyDuplicates(data, report)


def summary(report: DataFrame) -> DataFrame:
    per = report.groupBy("column", "cluster_id").agg(F.count(F.lit(1)).alias("members"))
    return per.groupBy("column").agg(
        F.count(F.lit(1)).alias("clusters"), F.sum(F.col("members") - 1).alias("duplicate_values")
    )


class SchemaMatch(NamedTuple):
    mapping: DataFrame
    unmatched: DataFrame


def match_schemas(left: DataFrame, right: DataFrame, minimum: float = 0.3) -> SchemaMatch:
    """Best right column per left column by name, type and share of unique values."""
    one, two = profile(left, top=0, spread=False), profile(right, top=0, spread=False)
    rows, used = [], set()
    for a in one.columns.values():
        best = None
        for b in two.columns.values():
            score = 0.4 * percent_ratio(a.name.lower(), b.name.lower()) / 100
            score += 0.3 * (a.group == b.group and a.group != "other")
            score = min(1.0, score + 0.3 * (1 - abs(a.unique_share - b.unique_share)))
            if best is None or score > best[0]:
                best = (score, b)
        if best and best[0] > minimum:
            score, b = best
            used.add(b.name)
            level = "high" if score > 0.7 else "medium" if score > 0.5 else "low"
            action = "exact_match" if score > 0.9 else "fuzzy_match" if score > 0.7 else "review_needed"
            rows.append((a.name, b.name, round(score, 3), a.dtype, b.dtype, a.distinct, b.distinct, level, action))
    matched = {r[0] for r in rows}
    lonely = [("left", c) for c in one.columns if c not in matched] + [("right", c) for c in two.columns if c not in used]
    spark = left.sparkSession
    mapping = spark.createDataFrame(
        rows,
        "left_column string, right_column string, similarity double, left_type string, right_type string,"
        "left_unique long, right_unique long, confidence string, action string",
    )
    return SchemaMatch(mapping, spark.createDataFrame(lonely, "side string, column string"))
