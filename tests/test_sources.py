import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparquill.functions.keys import query_key
from sparquill.operators.log_analytics import average_ranks, running_totals
from sparquill.operators.ordering import ordered_table, with_position
from pyspark.sql.functions import col as spark_col

from sparquill.sources.files import expanded, tpch_shaped, ecommerce, query_files, read_csv
from sparquill.storage import drop_scratch, materialize, scratch_root
from sparquill.streaming.log_stream import read_stream, retrain_on_arrival, windowed

LOG = "id long, query_id string, sql_text string, selector_used string, actual_total_time_ms double, created_at timestamp"


def test_csv_with_backslashes(spark, tmp_path):
    (tmp_path / "t.csv").write_text('1,"say \\"hi\\", all"\n2,plain\n3,\n')
    got = [tuple(r) for r in read_csv(spark, str(tmp_path / "t.csv"), "id int, text string").collect()]
    assert got == [(1, 'say "hi", all'), (2, "plain"), (3, None)]


def test_query_files(spark, tmp_path):
    for n, t in (("b.sql", "select 1 as x, 2 AS y"), ("a.sql", "select 1 as x"), ("schema.sql", "create"), ("c.txt", "no")):
        (tmp_path / n).write_text(t)
    assert [n for n, _ in query_files(spark, str(tmp_path))] == ["a.sql", "b.sql"]
    assert len(query_files(spark, str(tmp_path), 1)) == 1


def test_generated_tables(spark):
    t = {k: v.cache() for k, v in ecommerce(spark, 0.02).items()}
    assert t["orders"].count() == 4000 and t["users"].groupBy("city").agg(F.count_distinct("country").alias("n")).where("n > 1").count() == 0
    assert 0.3 < t["orders"].where("user_id <= 100").count() / 4000 < 0.75
    assert t["order_items"].join(t["orders"].select(F.col("id").alias("order_id")), "order_id", "left_anti").count() == 0


def test_positions_are_a_total_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit("x").alias("k"))
    out = with_position(ordered_table(df, ["k", "v"], "t", 5)).collect()
    assert all(r["v"] == r["_pos"] for r in out) and len({r["_part"] for r in out}) > 1
    assert with_position(ordered_table(df.limit(0), ["k", "v"], "t")).count() == 0


def test_running_totals_and_ranks(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(100)], "i long, v double")
    rows = sorted(running_totals(df, ["i"], {"s": "v"}).collect())
    total = 0.0
    for r in rows:
        total += r["v"]
        assert r["s"] == total
    ranks = {r["v"]: r["r"] for r in average_ranks(df, "v", "r").collect()}
    assert ranks == {0.0: 13.0, 1.0: 38.0, 2.0: 63.0, 3.0: 88.0}


def test_query_keys(spark):
    df = spark.createDataFrame([(1, "q", "x"), (2, None, " select\t1\n"), (3, None, "select 1"), (4, None, None)], "id long, query_id string, sql_text string")
    keys = [r[0] for r in df.orderBy("id").select(query_key()).collect()]
    assert keys[0] == "q" and keys[1] == keys[2] and keys[1].startswith("adhoc:") and keys[3] is None


def test_scratch(spark):
    root = scratch_root(spark)
    assert root and root == scratch_root(spark)
    df = materialize(spark.createDataFrame([], "a int, b string"), "empty")
    assert df.count() == 0 and df.columns == ["a", "b"]
    drop_scratch(spark)
    with pytest.raises(Exception, match="NOT_EXIST|not exist"):
        spark.read.parquet(*df.inputFiles() or ["file:/nowhere"]).count()
    drop_scratch(spark)


def log(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, "q" if i % 2 else None, "select 1", " Native" if i % 3 else "learned", float(i), at + dt.timedelta(minutes=10 * i)) for i in range(60)] + [(99, "q", "s", "x", float("nan"), at), (98, "adhoc:1", "s", "native", 5.0, at)]
    df = spark.createDataFrame(rows, LOG)
    df.write.parquet(str(tmp_path / "log"))
    return spark.read.parquet(str(tmp_path / "log"))


def test_stream_equals_batch(spark, tmp_path):
    batch = log(spark, tmp_path)
    stream = read_stream(spark, str(tmp_path / "log"), batch.schema)
    q = windowed(stream).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, windowed(batch).collect()))


@pytest.mark.parametrize("least,calls", [(10, 1), (1000, 0)])
def test_retraining_by_arrival(spark, tmp_path, least, calls):
    batch = log(spark, tmp_path)
    seen = []
    q = retrain_on_arrival(read_stream(spark, str(tmp_path / "log"), batch.schema), str(tmp_path / "c2"), seen.append, least)
    q.awaitTermination(120)
    assert len(seen) == calls and sum(seen) in (0, 30)


def test_periodic_retraining_survives_a_failure(spark, tmp_path):
    batch = log(spark, tmp_path)
    seen = []

    def train(n):
        seen.append(n)
        raise RuntimeError("no models today")

    with pytest.warns(UserWarning, match="no models today"):
        q = retrain_on_arrival(read_stream(spark, str(tmp_path / "log"), batch.schema), str(tmp_path / "c3"), train, 1, every="1 second")
        q.processAllAvailable()
    assert seen and q.isActive
    q.stop()


def test_benchmark_shaped_tables(spark):
    t = tpch_shaped(spark, 0.001)
    assert {k: t[k].count() for k in ("region", "nation", "supplier", "customer", "part", "partsupp", "orders")} == {"region": 5, "nation": 25, "supplier": 10, "customer": 150, "part": 200, "partsupp": 800, "orders": 1500}
    assert t["customer"].first()["c_name"] == "Customer#000000001"
    lines = t["lineitem"].groupBy("l_orderkey").agg({"l_linenumber": "max", "*": "count"}).toDF("k", "most", "n")
    assert lines.count() == 1500 and lines.where("most <> n OR n > 7").count() == 0
    hot = t["orders"].where("o_custkey <= 30").count() / 1500
    assert 0.5 < hot < 0.7
    assert t["nation"].where("n_regionkey = n_nationkey div 5").count() == 25
    assert t["lineitem"].join(t["part"], t["lineitem"]["l_partkey"] == t["part"]["p_partkey"], "left_anti").count() == 0
    assert expanded(spark.range(3), spark_col("id"), "k").count() == 3
