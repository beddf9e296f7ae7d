import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparquill.operators.quantiles import group_percentiles, value_counts


def test_against_numpy_with_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, rng.random() * 9])) for i in range(900)] + [("a", math.nan), ("a", None), ("b", math.inf)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in group_percentiles(value_counts(df, ["g"], F.col("v")), ["g"], [0.0, 0.37, 0.5, 1.0]).collect()}
    for g in ("hot", "a", "b", None):
        own = [v for k, v in rows if k == g and v is not None and math.isfinite(v)]
        assert got[g]["n"] == len(own)
        assert np.allclose([got[g][f"p{i}"] for i in range(4)], np.quantile(own, [0.0, 0.37, 0.5, 1.0]))


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0, 1.0, 1.0, 4.0], [float(i) for i in range(101)]])
def test_discrete_without_groups(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "value double")
    got = group_percentiles(value_counts(df, [], F.col("value")), [], [0.25, 0.75], discrete=True).collect()
    want = df.selectExpr("percentile_disc(0.25) WITHIN GROUP (ORDER BY value)", "percentile_disc(0.75) WITHIN GROUP (ORDER BY value)").first()
    assert [tuple(r)[1:] for r in got] == [tuple(want)]
    assert group_percentiles(value_counts(df.limit(0), [], F.col("value")), [], [0.5]).count() == 0
