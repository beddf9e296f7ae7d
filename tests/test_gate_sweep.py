import math
import random

import pytest

from sparquill.operators import log_analytics as A

SCORED = "query_id string, native_ms double, pick_ms double, mean double, std double"


def swept(spark, times):
    rows = [(f"q{i}", native, pick, -1.0, 0.0) for i, (native, pick) in enumerate(times)]
    return A.gate_sweep(spark.createDataFrame(rows, SCORED).coalesce(1), [0.0], [0.0]).first()


@pytest.mark.parametrize("seed", [39, 146, 194, 211, 236])
def test_net_time_does_not_depend_on_the_order_of_queries(spark, seed):
    """Times whose differences add up to half-way between two roundings."""
    rng = random.Random(seed)
    times = [(round(rng.uniform(20, 150), 4), round(rng.uniform(20, 150), 4)) for _ in range(200)]
    net = math.fsum(native - pick for native, pick in times)
    want = math.copysign(math.floor(abs(net) * 1000 + 0.5) / 1000, net)
    for order in (times, times[::-1], sorted(times)):
        row = swept(spark, order)
        assert row["net_ms"] == want
        assert row["net_pct"] == pytest.approx(net / math.fsum(n for n, _ in times) * 100, abs=5.1e-5)


def test_sums_that_decimals_cannot_hold_are_plain(spark):
    assert swept(spark, [(1e300, 1.0), (2.0, 1.0)])["net_ms"] == 1e300
    assert swept(spark, [(math.inf, 1.0), (2.0, 1.0)])["net_ms"] == math.inf
    assert math.isnan(swept(spark, [(2.0, math.nan), (2.0, 1.0)])["net_ms"])
    assert swept(spark, [(2.0, None), (3.0, 0.5)])["net_ms"] == 2.5
    assert swept(spark, [(2.0**52 + 0.0, 0.0), (1e-9, 0.0)])["net_ms"] == 2.0**52
    assert swept(spark, [(1.0, 3.5), (0.25, 0.0)])["net_ms"] == -2.25
