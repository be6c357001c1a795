"""Columns that nearly agree, against counting every pair."""

from itertools import combinations

import numpy as np
import pandas as pd

from quillfen.operators import quality


def test_three_hundred_columns(spark):
    draw = np.random.default_rng(9)
    rows = 3000
    base = draw.integers(0, 1000, (rows, 300)).astype(float)
    for k, kept in enumerate((0.79, 0.81, 0.85, 0.95, 0.999, 1.0)):  # copies of column 0 that differ somewhere
        changed = draw.random(rows) >= kept
        base[:, 290 + k] = np.where(changed, -1.0 - k, base[:, 0])
    pdf = pd.DataFrame(base, columns=[f"c{k}" for k in range(300)])
    frame = pdf.astype(object)
    frame.loc[draw.random(rows) < 0.05, "c5"] = None
    frame["c6"] = frame["c5"]  # equal, and unknown together
    df = spark.createDataFrame(frame, ", ".join(f"{c} double" for c in frame))
    want = {}
    for a, b in combinations(frame.columns, 2):
        share = float((frame[a].notna() & (frame[a] == frame[b])).mean()) if {a, b} & {"c0", "c5", "c6"} or int(a[1:]) >= 290 else 0.0
        if 0.8 < share < 1.0:
            want[a, b] = share
    got = {(a, b): s for a, b, s in quality.equal_pairs(df, list(frame.columns))}
    assert got.keys() == want.keys() and len(got) > 8
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_few_rows_types_and_no_rows(spark):
    rows = [(k, k if k else 7, str(k), f"{k}" if k % 9 else "x", None) for k in range(20)]
    df = spark.createDataFrame(rows, "a long, b long, s string, t string, n string")
    got = {(a, b): round(s, 2) for a, b, s in quality.equal_pairs(df, df.columns)}
    assert got == {("a", "b"): 0.95, ("s", "t"): 0.85}
    assert quality.equal_pairs(df.limit(0), df.columns) == []
