import pytest
from pyspark.sql import functions as F

from sparquill.llm.mixing import MixRules, load_vocabulary, mix, mix_report

TARGETS = "source string, target_share double, max_repeats int"
RULES = MixRules(block_tokens=64)


def corpus(spark):
    return spark.range(1200).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 800, "big").when(F.col("id") < 1100, "mid").when(F.col("id") < 1190, "small").when(F.col("id") < 1195, "unlisted").alias("source"),
        F.repeat(F.lit("some words here "), (1 + F.col("id") % 5).cast("int")).alias("text"), F.lit(1).alias("block"), F.lit(2).alias("slot"),
    )


def test_shares_and_repeats(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 3), ("absent", 0.05, 2)], TARGETS)
    mixed = mix(corpus(spark), targets, RULES)
    rows = {r["source"]: r for r in mix_report(mixed, targets).collect()}
    assert set(rows) == {"big", "mid", "small", "absent"} and rows["absent"]["tokens"] == 0
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert abs(rows[s]["reached_share"] - share / 0.95) < 0.02
        assert rows[s]["most_uses"] <= rows[s]["max_repeats"]
    # the scarcest source is used up
    assert max(r["uses"] / (r["max_repeats"] * n) for s, n in (("big", 800), ("mid", 300), ("small", 90)) for r in [rows[s]]) > 0.85
    uses = mixed.groupBy("doc_id", "repeat_no").count()
    assert uses.where("count > 1").count() == 0


def test_sequence_is_even_from_the_start(spark):
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.4, 1)], TARGETS)
    slots = mix(corpus(spark), targets, RULES).groupBy("slot").agg(F.first("source").alias("s"), F.count_distinct("source").alias("n")).orderBy("slot").collect()
    assert all(r["n"] == 1 for r in slots)
    first = [r["s"] for r in slots[:20]]
    assert 10 <= first.count("big") <= 14


def test_odd_tables(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    assert mix(corpus(spark).limit(0), targets, RULES).count() == 0
    assert mix(corpus(spark), targets.limit(0), RULES).count() == 0
    odd = spark.createDataFrame([(1, "big", None), (2, "big", ""), (3, "big", "word " * 30_000), (4, None, "x"), (3, "big", "again")], "doc_id long, source string, text string")
    got = mix(odd, targets, RULES)
    assert got.count() == 4 and got.agg(F.sum("n_tokens")).first()[0] > 25_000
    zero = spark.createDataFrame([("big", None, 1), (None, 1.0, 1), ("mid", 0.5, None)], TARGETS)
    assert mix(corpus(spark), zero, RULES).count() == 0


def test_vocabulary_bound(tmp_path):
    big = tmp_path / "v"
    big.write_bytes(b"\0" * ((64 << 20) + 1))
    with pytest.raises(ValueError):
        load_vocabulary(str(big))
