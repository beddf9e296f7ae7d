import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from sparquill.operators import hint_models as H

LOG = "id long, query_id string, sql_text string, hint string, is_baseline boolean, selector_used string, total_cost double, actual_total_time_ms double, is_chosen boolean, created_at timestamp, target double"
AT = dt.datetime(2024, 1, 1)


def log(spark, rows):
    """Rows (query_id, hint, ms, cost)."""
    return spark.createDataFrame([(i, q, "select 1", h, h is None, "collection", c, ms, False, AT, 0.0) for i, (q, h, ms, c) in enumerate(rows)], LOG)


def measured(spark, n=60):
    rng = random.Random(1)
    rows = []
    for k in range(n):
        native = rng.uniform(50, 100)
        rows += [(f"q{k}", None, native, 10.0), (f"q{k}", "fast", native * rng.uniform(0.2, 0.3), 11.0), (f"q{k}", "slow", native * rng.uniform(2, 3), 5.0), (f"q{k}", "vetoed", native * 0.1, 2e10)]
    return log(spark, [*rows, ("lone", "fast", 5.0, 1.0), ("adhoc:x", None, 5.0, 1.0), (None, None, 5.0, 1.0), ("bad", None, math.nan, 1.0)])


@pytest.fixture(scope="module")
def learned(spark):
    labelled = H.labels(measured(spark))
    return labelled, H.fit(labelled)


def test_labels_need_a_native_reading(learned):
    labelled, _ = learned
    assert labelled.count() == 240 and labelled.where("query_id IN ('lone', 'bad') OR query_id LIKE 'adhoc%'").count() == 0
    assert labelled.where("hint IS NULL AND target <> 0").count() == 0
    assert 0 < labelled.where("held_out").select("query_id").distinct().count() < 40


def test_gate_veto_and_policies(learned):
    labelled, model = learned
    means = {r["hint"]: r["mean"] for r in model.collect()}
    assert means["vetoed"] < means["fast"] < 0 < means["slow"]
    scored = H.scored(labelled, model)
    assert {r["reason"] for r in H.decisions(scored).collect()} == {"predicted_regression_vs_native"}
    safe = scored.where("hint <> 'vetoed'")
    got = H.decisions(safe).collect()
    assert {(r["pick"], r["reason"]) for r in got} == {("fast", "confident_gain")} and all(r["served_ms"] == r["pick_ms"] < r["native_ms"] for r in got)
    assert {r["reason"] for r in H.decisions(safe, min_gain=0.95).collect()} == {"no_confident_gain_over_native"}
    report = {r["policy"]: r for r in H.policy_report(labelled.where("hint IS NULL OR hint <> 'vetoed'"), model).collect()}
    assert report["greedy"]["captured_pct"] == pytest.approx(100.0) and report["native"]["captured_pct"] == 0.0 and report["heuristic"]["captured_pct"] < 0
    assert report["greedy"]["ties_heuristic"] == 1.0 and report["heuristic"]["avg_ms"] > report["native"]["avg_ms"]
    sweep = {(r["z"], r["min_gain"]): r["deviation_rate"] for r in H.sweep(labelled.where("hint IS NULL OR hint <> 'vetoed'"), model, [0.0, 1.0], [0.0, 0.99]).collect()}
    assert sweep == {(0.0, 0.0): 1.0, (1.0, 0.0): 1.0, (0.0, 0.99): 0.0, (1.0, 0.99): 0.0}
    assert H.model_errors(labelled, model).first()["mae"] < 0.2


def test_scores_for_promotion(learned):
    labelled, model = learned
    whole = H.challenger_score(labelled.where("hint IS NULL OR hint <> 'vetoed'"), model).first()
    native = H.challenger_score(labelled.where("hint IS NULL"), model).first()
    assert whole["n_queries"] == native["n_queries"] == 15 and whole["avg_ms"] < native["avg_ms"] / 3


def test_pairs(spark, learned):
    labelled, _ = learned
    pairs = H.pairwise_pairs(labelled.where("query_id IN ('q1', 'q2')"))
    rows = pairs.collect()
    assert len(rows) == 2 * 6 * 2 and sum(r["a_is_faster"] for r in rows) == 12
    both = {(r["query_id"], r["hint_a"], r["hint_b"]): r["target_diff"] for r in rows}
    assert all(both[q, b, a] == -d for (q, a, b), d in both.items())
    thin = H.pairwise_pairs(labelled.where("query_id = 'q1'"), most=2).collect()
    assert len(thin) == 2 * 2  # every fourth of six
    same = H.labels(log(spark, [("q", None, 5.0, None), ("q", "h", 5.0, None)]))
    assert H.pairwise_pairs(same).count() == 0


def test_empty_logs(spark):
    labelled = H.labels(log(spark, []))
    model = H.fit(labelled)
    assert labelled.count() == model.count() == H.decisions(H.scored(labelled, model)).count() == H.pairwise_pairs(labelled).count() == H.policy_report(labelled, model).count() == 0
    assert tuple(H.challenger_score(labelled, model).first()) == (0, None)


@pytest.mark.parametrize("values,p", [([1.0] * 4, 0.125), ([0.0, None], None), ([1.0, -1.0], 1.0), ([1.0] * 900 + [-1.0] * 1000, 0.02315), ([-1.0] * 3000, 0.0)])
def test_sign_test(spark, values, p):
    got = H.sign_test(spark.createDataFrame([(v,) for v in values], "d double"), "d").first()
    assert got["p_value"] == (None if p is None else pytest.approx(p, abs=1e-4))


def test_bootstrap(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("k"), (F.col("id") % 10).cast("double").alias("v"))
    r = H.bootstrap_interval(df, F.col("k"), "v").first()
    assert r["n"] == 400 and r["mean"] == 4.5 and 4.1 < r["low"] < 4.5 < r["high"] < 4.9
    one = H.bootstrap_interval(df.limit(1), F.col("k"), "v").first()
    assert one["n"] == 1 and one["low"] is None
    assert tuple(H.bootstrap_interval(df.limit(0), F.col("k"), "v").first()) == (0, None, None, None)
