"""Exponentially weighted columns without gaps take the vectorised path."""

import numpy as np
import pandas as pd
import pytest

from quillfen.operators.ordered import Ordered


@pytest.mark.parametrize("size", [10_000, 9])
@pytest.mark.parametrize("adjust", [True, False])
@pytest.mark.parametrize("what", ["mean", "std"])
def test_without_gaps(spark, size, adjust, what):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(80), "x": rng.normal(5, 2, 80)})
    want = getattr(pdf["x"].ewm(span=12, adjust=adjust), what)()
    out = Ordered(spark.createDataFrame(pdf), ["id"], rows_per_task=size).ewm("x", "v", 12, adjust, what).result()
    got = out.orderBy("id").toPandas()["v"].to_numpy(dtype=float)
    np.testing.assert_allclose(got, want.to_numpy(), rtol=1e-7)
