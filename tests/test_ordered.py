"""Distributed row-order operators against pandas, with tiny buckets to force the wide path."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillfen.operators.ordered import Ordered
from quillfen.operators.quantiles import grouped_quantiles, quantiles

SIZES = [10_000, 7]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    n = 60
    pdf = pd.DataFrame({"id": np.arange(n), "g": np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abc"), n))})
    pdf["x"] = np.where(rng.random(n) < 0.2, np.nan, rng.normal(10, 3, n).round(2))
    return pdf


def make(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))


def collect(df, name):
    return df.orderBy("id").toPandas()[name].to_numpy(dtype=float)


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_order_operators_match_pandas(spark, frame, size, keys):
    df = make(spark, frame)
    pdf = frame.sort_values("id")
    grouped = pdf.groupby("g")["x"] if keys else None
    one = lambda fn: grouped.transform(fn) if keys else fn(pdf["x"])
    o = Ordered(df, ["id"], keys, rows_per_task=size)
    expected = {
        "cum": one(lambda s: s.fillna(0).cumsum()),
        "ffill": one(lambda s: s.ffill()),
        "bfill": one(lambda s: s.bfill()),
        "lag": one(lambda s: s.shift(9)),
        "lead": one(lambda s: s.shift(-2)),
        "roll": one(lambda s: s.rolling(20, min_periods=1).mean()),
        "mid": one(lambda s: s.rolling(5, center=True, min_periods=1).mean()),
        "idx": pdf.groupby("g").cumcount() + 1 if keys else pdf["id"] + 1,
    }
    got = {
        "cum": o.running({"v": F.coalesce("x", F.lit(0.0))}),
        "ffill": o.last_valid({"v": F.col("x")}),
        "bfill": o.next_valid({"v": F.col("x")}),
        "lag": o.windowed({"v": lambda w: F.lag("x", 9).over(w)}, 9, 0),
        "lead": o.windowed({"v": lambda w: F.lead("x", 2).over(w)}, 0, 2),
        "roll": o.windowed({"v": lambda w: F.avg("x").over(w.rowsBetween(-19, 0))}, 19, 0),
        "mid": o.windowed({"v": lambda w: F.avg("x").over(w.rowsBetween(-2, 2))}, 2, 2),
        "idx": o.row_index("v"),
    }
    for name, want in expected.items():
        out = got[name].result()
        assert out.count() == len(frame), name
        np.testing.assert_allclose(collect(out, "v"), want.to_numpy(dtype=float), err_msg=name, rtol=1e-9)


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("adjust", [True, False])
@pytest.mark.parametrize("what", ["mean", "std"])
def test_ewm_matches_pandas(spark, frame, size, adjust, what):
    df = make(spark, frame)
    whole = getattr(frame["x"].ewm(span=7, adjust=adjust), what)()
    out = Ordered(df, ["id"], rows_per_task=size).ewm("x", "v", 7, adjust, what).result()
    np.testing.assert_allclose(collect(out, "v"), whole.to_numpy(), rtol=1e-7)
    by = frame.groupby("g")["x"].transform(lambda s: getattr(s.ewm(span=7, adjust=adjust), what)())
    out = Ordered(df, ["id"], ["g"], rows_per_task=size).ewm("x", "v", 7, adjust, what).result()
    np.testing.assert_allclose(collect(out, "v"), by.to_numpy(), rtol=1e-7)


@pytest.mark.parametrize("limit", [10_000, 5])
def test_quantiles_match_pandas(spark, frame, limit):
    pdf = pd.concat([frame, frame.assign(x=10.0)])  # a value that holds half of all rows
    df = make(spark, pdf)
    probs = [0.0, 0.05, 0.25, 0.5, 0.8, 1.0]
    got = quantiles(df, ["x", "id"], probs, limit=limit)
    np.testing.assert_allclose(got["x"], pdf["x"].quantile(probs), rtol=1e-12)
    np.testing.assert_allclose(got["id"], pdf["id"].quantile(probs), rtol=1e-12)
    by = grouped_quantiles(df, ["g"], {"m": ("x", 0.5), "q": ("x", 0.25), "i": ("id", 0.9)}, limit=limit)
    want = pdf.groupby("g").agg(m=("x", "median"), q=("x", lambda s: s.quantile(0.25)), i=("id", lambda s: s.quantile(0.9)))
    have = by.toPandas().set_index("g").sort_index()
    np.testing.assert_allclose(have[["m", "q", "i"]].to_numpy(dtype=float), want.sort_index().to_numpy())
