"""Full joins whose hot and null keys are dealt over tasks equal the plain join, and their tasks are even."""

from collections import Counter
from statistics import median

import numpy as np
from pyspark.sql import functions as F

from quillfen.plans.join_graph import join_pair


def _keys(draw, size, hot):
    shares = [h[1] for h in hot]
    kinds = draw.choice(len(hot) + 1, size, p=[*shares, 1 - sum(shares)])
    return [hot[k][0] if k < len(hot) else int(draw.integers(0, 400)) for k in kinds]


def _wanted(left, right):
    """Counts of (key, left value, right value, indicator) by brute force; None equals None."""
    out = Counter()
    seen = set()
    for k, x in left:
        found = [y for other, y in right if other == k]
        seen.add(k)
        out.update([(k, x, y, "both") for y in found] or [(k, x, None, "left_only")])
    out.update((k, None, y, "right_only") for k, y in right if k not in seen)
    return out


def test_equals_the_plain_join(spark):
    draw = np.random.default_rng(2)
    cases = [
        ([(None, 0.5), (1, 0.3)], []),  # hot on the left
        ([], [(None, 0.4), (2, 0.3)]),  # hot on the right
        ([(None, 0.1), (7, 0.1)], [(None, 0.1), (7, 0.05)]),  # hot on both
        ([(-1, 0.6)], [(-2, 0.6)]),  # hot, never matched
    ]
    for left_hot, right_hot in cases:
        left = [(k, int(draw.integers(0, 3))) for k in _keys(draw, 600, left_hot)]
        right = [(k, int(draw.integers(0, 3))) for k in _keys(draw, 150, right_hot)]
        a, b = spark.createDataFrame(left, "k long, x int"), spark.createDataFrame(right, "k int, y int")
        want = _wanted(left, right)
        for limit in (7, 10_000):
            got = Counter(tuple(r) for r in join_pair(a, b, "k", "k", "b", "outer", rows_per_task=limit).collect())
            assert got == want, (left_hot, right_hot, limit)


def test_other_names_types_and_empty_sides(spark):
    a = spark.createDataFrame([(None, {"a": 1}), (1, None), (1, {"b": 2})] * 20, "k long, m map<string,int>")
    b = spark.createDataFrame([("1", 5), (None, 6)], "id string, y int")
    out = join_pair(a, b.withColumn("id", F.col("id").cast("long")), "k", "id", "b", "outer", rows_per_task=3)
    assert out.columns == ["k", "m", "id", "y", "_merge_b"] and out.count() == 60
    assert join_pair(a, b, "k", "id", "b", "outer", rows_per_task=3).count() == 60  # unlike types
    none = a.limit(0).withColumnRenamed("m", "n")
    assert {r["_merge_b"] for r in join_pair(a, none, "k", "k", "b", "outer", rows_per_task=3).collect()} == {"left_only"}
    assert {r["_merge_b"] for r in join_pair(none, a, "k", "k", "b", "outer", rows_per_task=3).collect()} == {"right_only"}
    assert join_pair(none, none, "k", "k", "b", "outer").count() == 0


def test_tasks_are_even(spark):
    number = F.col("id")
    key = F.when(number % 2 == 0, None).when(number % 10 < 6, 1).otherwise(number)
    a = spark.range(40_000).select(key.cast("long").alias("k"), number.alias("x"))
    b = spark.range(5_000).select(F.expr("nullif(id, 2)").alias("k"), F.lit(1).alias("y"))
    before = {name: spark.conf.get(name, None) for name in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for name, value in zip(before, ("false", "16", "-1"), strict=True):
            spark.conf.set(name, value)
        largest = []
        for limit in (100, 1_000_000):
            out = join_pair(a, b, "k", "k", "b", "outer", rows_per_task=limit)
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            largest.append(max(sizes) / median(sizes))
        assert largest[0] < 3 < largest[1]
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
