from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparquill.operators import balance
from sparquill.operators.balance import balanced_aggregate, balanced_join, lookup, pack, plan_loads, spread


def counts(df, keys):
    return balanced_aggregate(df, keys, {"n": F.count(F.lit(1))}, {"n": F.sum("n")})


def test_packing_is_even():
    placed, sums = pack([5, 5, 4, 3, 3], 2)
    assert sorted(sums) == [8, 12] or max(sums) - min(sums) <= 4
    assert len(placed) == 5


def test_hot_key_is_split_evenly(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("key"), "id")
    plan = plan_loads(df, ["key"], 4)
    assert plan.heavy[0][0] == ("hot",)
    sizes = [r[1] for r in spread(df, ["key"], plan).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1.2 * 1000
    got = {r["key"]: r["n"] for r in counts(df, ["key"]).collect()}
    assert got == dict(Counter("hot" if i % 3 == 0 else f"k{i % 500}" for i in range(4000)))


def test_null_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("", 2), ("a", 3), ("a", 3)], "key string, v int")
    assert {r["key"]: r["n"] for r in counts(df, ["key"]).collect()} == {None: 2, "": 1, "a": 2}
    assert counts(df.limit(0), ["key"]).count() == 0


def test_two_keys_and_foreign_columns(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 1), ("a", "x", 1)], "key string, n string, task int")
    got = {(r["key"], r["n"]): r["rows"] for r in balanced_aggregate(df, ["key", "n"], {"rows": F.count(F.lit(1))}, {"rows": F.sum("rows")}).collect()}
    assert got == {("a", None): 2, ("a", "x"): 1}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_equals_plain_join(spark, how):
    left = spark.range(900).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 40).cast("string")).alias("key"), "id")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("3", 3), (None, 4), ("other", 5)], "key string, r int")
    rows = sorted(map(tuple, balanced_join(left, right, ["key"], how).select("key", "id", "r").collect()), key=str)
    assert rows == sorted(map(tuple, left.join(right, "key", how).select("key", "id", "r").collect()), key=str)


def test_join_of_clashing_names(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "key string, v int")
    got = balanced_join(df, df, ["key"])
    assert sorted(got.columns) == ["key", "v", "v_right"] and got.count() == 4
    assert sorted(lookup(df, df, ["key"]).columns) == ["key", "v", "v_right"]
    for join in (balanced_join, lookup):
        with pytest.raises(ValueError):
            join(df, df.select("key"), ["key"], "full")


def test_loads_are_estimated_from_a_sample(spark, monkeypatch):
    monkeypatch.setattr(balance, "SAMPLED_PER_TASK", 250)
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("key"), "id")
    plan = plan_loads(df, ["key"], 4)
    assert plan.heavy[0][0] == ("hot",) and abs(plan.heavy[0][1] - 13_334) < 2500
    assert counts(df, ["key"]).agg(F.sum("n")).first()[0] == 40_000
    sizes = [r[1] for r in spread(df, ["key"], plan).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) < 1.3 * 10_000


@pytest.mark.parametrize("limit", [0, 100])
def test_lookup_by_broadcast_and_by_shards(spark, monkeypatch, limit):
    monkeypatch.setattr(balance, "BROADCAST_ROWS", limit)
    left = spark.range(900).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 40).cast("string")).alias("key"), "id")
    right = spark.createDataFrame([("hot", 1), ("3", 3), (None, 4)], "key string, r int")
    for how in ("inner", "left"):
        assert lookup(left, right, ["key"], how).count() == left.join(right, "key", how).count()
