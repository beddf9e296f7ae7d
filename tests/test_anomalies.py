import datetime as dt
import math
import random

import numpy as np
import pytest

from sparquill.operators.anomalies import _MOVES, NORMAL, SPIKE, STUCK, AnomalyRules, _emissions, forward_backward, implausible_readings, posteriors, reading_states, state_agreement

SCHEMA = "id long, q string, t timestamp, v double, w double, field string, run int"
START = dt.datetime(2024, 1, 1)


def rows_of(values, q="q", first=1):
    return [(first + i, q, START + dt.timedelta(seconds=i), v, None, "x", 0) for i, v in enumerate(values)]


def brute(rows, factor=3.0):
    out, by = set(), {}
    for i, q, t, v, *_ in sorted(rows, key=lambda r: (r[2], r[0])):
        if v is None:
            continue
        bad = not (v > 0 and v <= 86_400_000)
        if bad:
            out.add(i)
        if q is not None:
            by.setdefault(q, []).append((i, v, bad))
    for rs in by.values():
        stuck, k = set(), 0
        while k < len(rs):
            j = k
            while j + 1 < len(rs) and rs[j + 1][1] == rs[k][1]:
                j += 1
            if j - k >= 4:
                stuck |= {rs[m][0] for m in range(k, j + 1)}
            k = j + 1
        out |= stuck
        s = sorted(v for i, v, bad in rs if not bad and i not in stuck)
        if len(rs) < 20 or not s:
            continue
        lo = hi = (len(s) - 1) // 2 if len(s) % 2 else len(s) // 2
        while hi + 1 < len(s) and s[hi + 1] < factor * s[hi]:
            hi += 1
        while lo > 0 and s[lo] < factor * s[lo - 1]:
            lo -= 1
        out |= {i for i, v, bad in rs if not bad and i not in stuck and (v >= factor * s[hi] or v * factor <= s[lo])}
    return out


def found(spark, rows, **rules):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["id"] for r in implausible_readings(df, "id", "q", "t", ["v", "w"], AnomalyRules(**rules)).collect()}


def test_equals_brute_force_over_small_blocks(spark):
    rng = random.Random(5)
    rows, n = [], 1
    for s in range(12):
        values = [rng.lognormvariate(3 + s % 3, 0.3) for _ in range(rng.choice([3, 19, 20, 60, 300]))]
        for _ in range(len(values) // 25):
            values[rng.randrange(len(values))] *= rng.choice([50, 1 / 50])
        if len(values) > 50:
            k = rng.randrange(len(values) - 8)
            values[k : k + rng.choice([4, 5, 8])] = [values[k]] * rng.choice([4, 5, 8])
            values[3], values[7], values[9] = math.nan, -1.0, math.inf
            values[11] = None
        rows += rows_of(values, f"q{s}", n)
        n += len(values)
    rows += [(n, None, START, math.nan, None, "x", 0), (n + 1, None, START, 5.0, None, "x", 0)]
    assert found(spark, rows, block=64, halo=16, window=32) == brute(rows)


def test_empty_null_and_tied_times(spark):
    assert found(spark, rows_of([None, None])) == set()
    same = [(i, "q", START, 7.0, None, "x", 0) for i in range(1, 6)]
    assert found(spark, same) == {1, 2, 3, 4, 5}
    assert found(spark, same[:4]) == set()
    df = spark.createDataFrame([], SCHEMA)
    assert implausible_readings(df, "id", "q", "t", ["v"]).count() == 0


def test_states_are_probabilities(spark):
    df = spark.createDataFrame(rows_of([1.0, 1.1, 1.2, 0.9, 1.0] * 6 + [90.0]), SCHEMA)
    rows = reading_states(df, "id", "q", "t", ["v"]).collect()
    assert all(abs(r["p_normal"] + r["p_spike"] + r["p_stuck"] + r["p_out"] - 1) < 1e-9 for r in rows)
    worst = max(rows, key=lambda r: r["p_spike"])
    assert worst["value"] == 90.0 and worst["p_spike"] > 0.9


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    e, moves = rng.normal(size=(1, 4, 4)), rng.random((1, 4, 4))
    moves /= moves.sum(axis=2, keepdims=True)
    total, seen = np.zeros((4, 4)), np.zeros((4, 4))
    for path in np.ndindex(4, 4, 4, 4):
        p = moves[0, NORMAL, path[0]] * np.exp(e[0, 0, path[0]])
        for t in range(1, 4):
            p *= moves[0, path[t - 1], path[t]] * np.exp(e[0, t, path[t]])
        for t in range(4):
            total[t, path[t]] += p
        for t in range(1, 4):
            seen[path[t - 1], path[t]] += p
    p, expected = forward_backward(e, np.ones((1, 4), bool), moves)
    assert np.allclose(p[0], total / total.sum(axis=1, keepdims=True))
    assert np.allclose(expected[0], seen / total[0].sum())


def test_windows_agree_with_one_pass():
    rules = AnomalyRules(window=16, halo=16)
    rng = np.random.default_rng(2)
    v = np.exp(rng.normal(size=200) * 0.2)
    v[50] = 100
    one = np.ones(200)
    e = _emissions({"value": v, "bad": np.zeros(200, bool), "run": one, "n_readings": one * 200, "lo": one * 0.5, "hi": one * 2, "center": one * 0, "width": one * 0.2}, rules)
    moves = _MOVES[None]
    whole = forward_backward(e[None], np.ones((1, 200), bool), moves)[0][0]
    assert np.abs(posteriors(e, np.array([0, 200]), moves, rules)[0] - whole).max() < 0.05
    assert whole[50, SPIKE] > 0.9 and whole[10, NORMAL] > 0.9 and whole[10, STUCK] < 0.1


def test_repeated_impossible_values_are_out_of_range(spark):
    df = spark.createDataFrame(rows_of([5.0, 5.1, *[-1.0] * 7, 5.2]), SCHEMA)
    assert {r["reason"] for r in implausible_readings(df, "id", "q", "t", ["v"]).collect()} == {"out_of_range"}


def test_sources_have_models_of_their_own(spark):
    rng = random.Random(3)
    calm = [rng.lognormvariate(2, 0.1) for _ in range(400)]
    wild = [x * 100 if i % 4 == 0 else x for i, x in enumerate(calm)]
    df = spark.createDataFrame(rows_of(calm, "calm") + rows_of(wild, "wild", 1000), SCHEMA)
    assert {r["id"] for r in implausible_readings(df, "id", "q", "t", ["v"]).collect()} == set(range(1000, 1400, 4))
    states = reading_states(df, "id", "q", "t", ["v"])
    got = {r["state"]: (r["n_model"], r["n_rule"], r["n_both"]) for r in state_agreement(states).collect()}
    assert got == {"normal": (700, 700, 700), "spike": (100, 100, 100)}


@pytest.mark.parametrize("value,case", [(3.0, True), (2.99, False), (1 / 3 - 1e-9, True), (0.34, False)])
def test_spike_boundary(spark, value, case):
    assert (20 in found(spark, rows_of([1.0, *[1.0 - 1e-12 * i for i in range(1, 19)], value]))) is case
