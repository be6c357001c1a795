"""The similarity join and the first-seen clusters against brute force."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from quillfen.operators import fuzzy


def words(n, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(3, 25))).strip() or "abc" for _ in range(n // 3)]
    out = set(base)
    while len(out) < n:
        w = list(rng.choice(base))
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(w) + 1)
            if rng.random() < 0.5:
                w.insert(i, rng.choice("abcde"))
            elif i < len(w) and len(w) > 3:
                del w[i]
        out.add("".join(w).strip() or "x")
    return sorted(out)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_length_matches_dynamic_programming():
    texts = words(40, 1)
    for a in texts[:20]:
        for b in texts[20:]:
            assert fuzzy.common_length(a, b) == lcs(a, b)


def test_ratio_is_a_percentage():
    assert fuzzy.percent_ratio("abc", "abc") == 100
    assert fuzzy.percent_ratio("", "abc") == 0
    assert fuzzy.percent_ratio("abcd", "abce") == 75
    assert fuzzy.percent_ratio("abc", "xyz") == 0
    assert difflib.SequenceMatcher(None, "abcd", "abce").ratio() == 0.75


@pytest.mark.parametrize("threshold", [0.85, 0.7])
def test_pairs_match_brute_force(spark, threshold):
    texts = words(120, 5)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r["a"], r["b"]) for r in fuzzy.similar_pairs(df, threshold).collect()}
    want = {
        (i, j)
        for i in range(len(texts))
        for j in range(i + 1, len(texts))
        if fuzzy.percent_ratio(texts[i], texts[j]) >= round(threshold * 100)
    }
    assert got == want and want


def greedy(values):
    clusters, done = [], set()
    for i, a in enumerate(values):
        if a in done:
            continue
        done.add(a)
        cluster = [a]
        for b in values[i + 1 :]:
            if b not in done and fuzzy.percent_ratio(a, b) >= 85:
                cluster.append(b)
                done.add(b)
        if len(cluster) > 1:
            clusters.append(cluster)
    return clusters


def test_clusters_match_scanning_in_order(spark):
    values = words(100, 9)
    random.Random(2).shuffle(values)
    rows = [(i, v) for i, v in enumerate(values)] + [(1000 + i, v) for i, v in enumerate(values[:30])]
    df = spark.createDataFrame(rows, "id long, v string")
    out = fuzzy.fuzzy_duplicates(df, ["v"], order_by=["id"])
    got = {}
    for r in out.report.collect():
        got.setdefault(r["cluster_id"], set()).add(r["original_value"])
    want = {f"cluster_{k}": set(c) for k, c in enumerate(greedy(values))}
    assert got == want and want
    marked = out.data.filter(F.col("v_duplicate_cluster").isNotNull()).count()
    assert marked == sum(v in set().union(*want.values()) for _, v in rows)


def test_canonical_prefers_proper_casing_then_length(spark):
    rows = [(1, "blue bolt"), (2, "Blue Bolt"), (3, "blue  bolt inc."), (4, "gear"), (5, None)]
    out = fuzzy.fuzzy_duplicates(spark.createDataFrame(rows, "id long, v string"), ["v"], order_by=["id"])
    report = out.report.collect()
    assert {r["original_value"] for r in report} == {"blue bolt", "Blue Bolt", "blue  bolt inc."}
    assert {r["canonical_value"] for r in report} == {"Blue Bolt"}
    assert {r["confidence"] for r in report} == {"high"}


def test_no_clusters(spark):
    out = fuzzy.fuzzy_duplicates(spark.createDataFrame([(1, "abc"), (2, "xyz")], "id long, v string"), ["v"])
    assert out.report.count() == 0
    assert out.data.count() == 2


def test_schema_match(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "customer_id long, name string")
    right = spark.createDataFrame([("a", 5, 1.0), ("b", 6, 1.0)], "name string, customer_no long, zz double")
    out = fuzzy.match_schemas(left, right)
    best = {r["left_column"]: r["right_column"] for r in out.mapping.collect()}
    assert best == {"customer_id": "customer_no", "name": "name"}
    assert [tuple(r) for r in out.unmatched.collect()] == [("right", "zz")]
