"""Pair matrices from blocked products and shared ranks, against pandas."""

import numpy as np
import pandas as pd
import pytest

from quillfen.operators import correlation as cor


@pytest.fixture(scope="module")
def frame(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(400, 14))
    pdf = pd.DataFrame({f"v{k}": base[:, k] * 10**k + base[:, 0] * 10**k + 1e6 for k in range(12)})
    pdf["same"], pdf["few"] = 7.25, draw.integers(0, 4, 400).astype(float)
    holes = pdf.mask(draw.random(pdf.shape) < 0.2)
    holes["lonely"] = [1.0] + [None] * 399
    return pdf, holes, spark.createDataFrame(pdf), spark.createDataFrame(holes.astype(object).where(holes.notna(), None), ", ".join(f"{c} double" for c in holes))


def table(df):
    return {(r.x, r.y): r.value for r in df.collect()}


def agree(got, want, names):
    for a in names:
        for b in names:
            value = want.loc[a, b]
            if a == b or pd.isna(value):
                continue
            assert got[a, b] == pytest.approx(value, rel=1e-7, abs=1e-9), (a, b)


def test_many_columns_come_from_one_scan_of_products(frame, monkeypatch):
    pdf, holes, df, holed = frame
    names = list(holes.columns)
    assert len(names) * (len(names) - 1) // 2 > cor._BATCH
    got = table(cor.matrix(holed, names, complete=False))
    agree(got, holes.corr(), names)
    assert got["same", "v1"] is None and got["lonely", "v1"] is None
    agree(table(cor.matrix(holed, names, "covariance", complete=False)), holes.cov(), names)
    agree(table(cor.matrix(df, list(pdf.columns))), pdf.corr(), list(pdf.columns))
    assert {k for k, v in got.items() if v is None} == {(a, b) for a in names for b in names if a != b and {a, b} & {"same", "lonely"}}
    monkeypatch.setattr(cor, "_BATCH", 10_000)  # the other way: one aggregate per pair
    by_pairs = table(cor.matrix(holed, names, complete=False))
    assert all(v == pytest.approx(by_pairs[k], abs=1e-9) for k, v in got.items() if v is not None)


def test_two_hundred_columns(spark):
    draw = np.random.default_rng(4)
    pdf = pd.DataFrame(draw.normal(size=(60, 200)), columns=[f"c{k}" for k in range(200)])
    got = table(cor.matrix(spark.createDataFrame(pdf), list(pdf.columns)))
    assert len(got) == 40_000
    agree(got, pdf.corr(), list(pdf.columns)[::20])


@pytest.mark.parametrize("few_values", [0, 100, 1000])
def test_ranks_of_all_columns_from_one_sort(frame, monkeypatch, few_values):
    monkeypatch.setattr(cor, "FEW_VALUES", few_values)
    pdf, holes, df, holed = frame
    names = ["v0", "v3", "few", "v5"]
    agree(table(cor.matrix(df, names, "spearman")), pdf[names].corr("spearman"), names)
    agree(table(cor.matrix(holed, names, "spearman")), holes[names].dropna().corr("spearman"), names)
    plan = cor.ranked(df.select(*names), names)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == {0: 1, 100: 2, 1000: 4}[few_values]


def test_significance_shares_ranks_where_nothing_is_missing(frame):
    pdf, holes, df, holed = frame
    both = holed.select("v0", "few").toPandas()
    mixed = df.select("v1", "v2", "few")
    got = {(r.x, r.y): (r.r, r.points) for r in cor.significance(mixed, ["v1", "v2", "few"], "spearman").collect()}
    want = pdf[["v1", "v2", "few"]].corr("spearman")
    assert all(v[0] == pytest.approx(want.loc[k]) and v[1] == 400 for k, v in got.items())
    row = cor.significance(holed, ["v0", "few"], "spearman").first()
    assert row.r == pytest.approx(both.corr("spearman").iloc[0, 1]) and row.points == len(both.dropna())
