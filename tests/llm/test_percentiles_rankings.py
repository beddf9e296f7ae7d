import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparquill.llm.percentiles import daily_runs, join_runs, percentiles
from sparquill.llm.rankings import top_items

SCHEMA = "g string, h string, v double, at timestamp, n int, day string, value string"


def data(spark, rows):
    return spark.createDataFrame([(g, h, v, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 1, "d", "x") for i, (g, h, v) in enumerate(rows)], SCHEMA)


def test_percentiles_equal_numpy_and_join_over_days(spark):
    rng = random.Random(1)
    rows = [("hot", None, rng.choice([rng.random(), 5.0])) for _ in range(700)] + [(rng.choice([None, "a", ""]), rng.choice([None, "h"]), float(rng.randrange(9))) for _ in range(200)]
    rows += [("a", "h", math.nan), ("a", "h", math.inf), ("a", "h", None), ("only nulls", None, None)]
    probs = (0.0, 0.5, 0.9, 1.0)
    df = data(spark, rows)
    runs = daily_runs(df, ["g", "h"], "v", "at")
    halves = [daily_runs(df.where(F.dayofmonth("at") <= 10), ["g", "h"], "v", "at"), daily_runs(df.where(F.dayofmonth("at") > 10), ["g", "h"], "v", "at")]
    want = {}
    for g, h in {(g, h) for g, h, v in rows if v is not None and math.isfinite(v)}:
        vs = [v for a, b, v in rows if (a, b) == (g, h) and v is not None and math.isfinite(v)]
        want[(g, h)] = (len(vs), *np.quantile(vs, probs))
    for summary in (runs, join_runs(*halves)):
        got = {(r["g"], r["h"]): tuple(r)[2:] for r in percentiles(summary, ["g", "h"], probs).collect()}
        assert set(got) == set(want)
        for k, v in want.items():
            assert got[k][0] == v[0] and np.allclose(got[k][1:-1], v[1:]) and got[k][-1] == 0.0


def test_percentiles_of_nothing(spark):
    empty = data(spark, [("a", None, None)])
    assert percentiles(daily_runs(empty, ["g", "h"], "v"), ["g", "h"], (0.5,)).count() == 0


def brute(rows, n):
    out = set()
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2] is not None, (r[2] or "").encode(), r[3]))
        out |= {(g, k, r[3]) for k, r in enumerate(mine[:n], 1)}
    return out


@pytest.mark.parametrize("n", [1, 3, 1000])
def test_top_items(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["hot", "hot", None, "a", ""]), float(rng.randrange(4)), rng.choice([None, "", "Z", "a", "é"]), i) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, s double, hint string, id long").repartition(7)
    got = top_items(df, ["g"], [F.col("s").asc(), F.col("hint").asc_nulls_first(), F.col("id").asc()], n)
    assert {(r["g"], r["rank_no"], r["id"]) for r in got.collect()} == brute(rows, n)
    assert got.columns == ["g", "s", "hint", "id", "rank_no"]


def test_groups_across_arrow_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = spark.range(50).select((F.col("id") % 3).cast("string").alias("g"), F.col("id"))
        got = top_items(df, ["g"], [F.col("id").desc()], 7)
        assert sorted((r["g"], r["rank_no"], r["id"]) for r in got.collect()) == sorted((str(g), k + 1, i) for g in range(3) for k, i in enumerate([i for i in range(49, -1, -1) if i % 3 == g][:7]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_rank_column_is_replaced(spark):
    df = spark.createDataFrame([("a", 7, "x"), ("a", 8, "y")], "g string, rank_no int, id string")
    got = top_items(df, ["g"], [F.col("id").desc()], 1)
    assert [tuple(r) for r in got.collect()] == [("a", "y", 1)] and got.columns == ["g", "id", "rank_no"]


def test_top_of_nothing(spark):
    df = spark.createDataFrame([("a", 1)], "g string, id int")
    assert top_items(df.limit(0), ["g"], [F.col("id").asc()], 3).count() == 0
    assert top_items(df, ["g"], [F.col("id").asc()], 0).count() == 0
