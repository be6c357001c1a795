import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfen.operators.quantiles import quantiles

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("value", ["id % 2", "id % 4", "if(id % 100 = 0, id, 7)", "5", "if(id % 3 = 0, 1, if(id % 3 = 1, 2, id))"])
def test_tied_ranks_above_the_limit(spark, value):
    frame = spark.range(30_000).select(F.expr(value).cast("double").alias("v"))
    found = quantiles(frame, ["v"], PROBABILITIES, limit=500)["v"]
    assert found == pytest.approx(np.quantile(frame.toPandas().v, PROBABILITIES).tolist())
