"""Hard negatives against a search over all rows with Python's integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfen.llm import hardnegatives

SCHEMA = "vec_id long, embedding array<float>, label int, block int, data string, role int, anchor string"


def brute(rows, is_anchor):
    """rows: (id, label, vector); the contract read word for word."""
    good = [(i, c, v) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    known = {}
    for i, c, v in good:
        known.setdefault((i, c), [math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for (i, c), v in known.items():
        if not is_anchor(i):
            continue
        met = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, d) for (j, d), w in known.items() if len(w) == len(v) and j != i]
        met.sort()
        for s, j, _ in [m for m in met if m[2] == c][:5]:
            fit = [(t, k) for t, k, d in met if d != c and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(fit[:5])]
    return sorted(out)


def mined(frame, every):
    return sorted(tuple(r) for r in hardnegatives.mine(frame, F.col("vec_id") % every == 0).collect())


@pytest.mark.parametrize("scale", [1, 300, 1e5, 1e9, 1e16, 1e40])
def test_packed_products_are_exact(scale):
    draw = np.random.default_rng(3)
    rows, anchors = np.floor(draw.normal(0, scale, (70, 9))), np.floor(draw.normal(0, scale, (4, 9)))
    rows[5] = 0
    got = hardnegatives.Packed(rows).scores(anchors)
    assert got.shape == (4, 70)
    for i, a in enumerate(anchors):
        for j, c in enumerate(rows):
            assert int(got[i, j]) == sum(int(x) * int(y) for x, y in zip(a, c, strict=True))


def test_blocks_find_what_all_rows_hold(spark, monkeypatch):
    monkeypatch.setattr(hardnegatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hardnegatives, "LABEL_BUCKETS", 3)
    draw = np.random.default_rng(5)
    centre = draw.normal(size=(6, 8))
    rows = []
    for k in range(400):
        label = 0 if k % 3 == 0 else int(draw.integers(0, 9))  # one label holds a third
        vector = (centre[k % 6] + draw.normal(size=8) * 0.3).astype(np.float32).tolist()
        rows.append((k, label, vector))
    rows += [(1000 + k, k % 4, rows[30][2]) for k in range(60)]  # equal vectors: ties by id
    frame = spark.createDataFrame([(i, v, c, 1, "d", 2, "a") for i, c, v in rows], SCHEMA)
    got = mined(frame, 10)
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 300


def test_odd_rows(spark):
    base = [0.5, 0.25, -0.125]
    rows = [(0, 1, base), (1, 1, base), (2, 2, base), (2, 2, base), (3, None, base), (4, 2, None), (5, 2, [0.5, None, 0.1]), (6, 2, [math.nan, 1.0, 1.0])]
    rows += [(7, 2, [math.inf, 0.0, 0.0]), (None, 2, base), (8, 2, [0.4, 0.25, -0.125]), (9, 2, [0.5, 0.25]), (10, 1, [1.0, 1.0]), (20, 1, []), (21, 1, []), (22, 2, [])]
    rows += [(30, 5, base), (40, 1, [-0.5, -0.2, 0.0]), (0, 1, base), (50, 1, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, c, 1, "d", 2, "a") for i, c, v in rows], SCHEMA)
    assert mined(frame, 10) == brute(rows, lambda i: i % 10 == 0)
    assert mined(frame.limit(0), 10) == []


def test_large_components_stay_exact(spark):
    draw = np.random.default_rng(8)
    rows = [(k, k % 2, (draw.normal(size=4) * 1e5).astype(np.float32).tolist()) for k in range(60)]
    frame = spark.createDataFrame([(i, v, c, 1, "d", 2, "a") for i, c, v in rows], SCHEMA)
    assert mined(frame, 5) == brute(rows, lambda i: i % 5 == 0)


def test_query_equals_brute_force(spark, data):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, list(r.embedding)) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in hardnegatives.query(spark, data).collect())
    assert got == brute(rows, lambda i: i % 100 == 0)
