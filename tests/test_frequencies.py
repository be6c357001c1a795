"""Value counts against Python's counters, on both ways of counting."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillfen.operators import cleaning, frequencies, profile
from quillfen.operators.frequencies import count_values


@pytest.fixture(scope="module")
def frame(spark):
    rows = []
    for k in range(3000):
        long = f"{'x' * 40} {k // 2}" if k < 2000 else f"{'y' * 40} {k % 7}"  # pairs, and a few heavy ones
        rows.append((k, k % 5, k / 4, f"t{k % 1500}", long, f"{'z' * 50}{k}", k % 2 == 0, dt.date(2020, 1, 1) + dt.timedelta(k % 1200), None))
    rows += [(None,) * 9, rows[0], rows[0]]
    return spark.createDataFrame(rows, "id long, few int, number double, text string, long string, unique_long string, flag boolean, day date, nothing string"), rows


@pytest.mark.parametrize("few_values", [0, 10, 1000, 10_000])
def test_counts_equal_counters_whatever_the_way(spark, frame, monkeypatch, few_values):
    df, rows = frame
    monkeypatch.setattr(frequencies, "FEW_VALUES", few_values)
    got = count_values(df, df.columns, top=5)
    for n, c in enumerate(df.columns):
        texts = [r.v for r in df.select(F.col(c).cast("string").alias("v")).collect() if r.v is not None]
        counts = Counter(texts)
        best = sorted(counts.items(), key=lambda r: (-r[1], r[0]))[:5]
        assert (got[c].distinct, got[c].least, got[c].top) == (len(counts), min(counts.values(), default=0), best), c


def test_many_values_are_shuffled_in_their_own_type(spark, frame):
    df, _ = frame
    plan = frequencies._typed(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "string" not in plan.lower() and "Expand" not in plan
    keys = frequencies._hashed(df, "unique_long")[1]
    exchange = keys._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_key_a" in exchange and "count" in exchange
    assert [f.name for f in keys.schema] == ["_key_a", "_key_b", "count"]


def test_duplicate_rows_tell_nulls_apart(spark):
    rows = [(None, "a"), ("a", None), (None, "a"), (None, None), ("", "a"), ("a", ""), ("a", "")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert profile.duplicate_rows(df) == 2 and profile.duplicate_rows(df.limit(0)) == 0


def test_types_are_the_same_by_values_and_by_cells(spark, monkeypatch):
    rows = []
    for k in range(400):
        at = dt.date(2020, 1, 1) + dt.timedelta(k)
        shapes = ("%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y", "%b %d, %Y", "%Y-%m-%d %H:%M:%S")
        day = [*map(at.strftime, shapes), f"20{k:02}-02-30", f"x{k}"][k % 7]
        rows.append((day, str(k % 9), "yes" if k % 2 else "No", f"${k}.00", f"{k}%", None, f"w{k}", k))
    df = spark.createDataFrame(rows, "day string, whole string, paid string, price string, rate string, none string, word string, n int")
    reports = []
    for few in (0, 10_000):
        monkeypatch.setattr(cleaning, "FEW_VALUES", few)
        reports.append([tuple(r) for r in cleaning.detect_types(df).report.collect()])
    assert reports[0] == reports[1]
    found = {r[0]: r for r in reports[0]}
    dates = sum(k % 7 < 5 for k in range(400))
    assert found["day"][2:] == ("datetime", round(dates / 400, 2), dates, 400 - dates)
    assert [found[c][2] for c in ("whole", "paid", "price", "none", "word")] == ["integer", "boolean", "currency", "null_only", "unknown"]
