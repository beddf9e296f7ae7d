import datetime as dt
import math
import threading
import time

import pytest

from sparquill.plans import experiment as X
from sparquill.plans.files import Files
from sparquill.plans.lifecycle import ModelStore, Profiles, SavedQueries, Settings, TrainingJob, model_fit, read_json, redacted, retrain, run_with_timeout, should_promote


def test_settings(tmp_path, monkeypatch):
    s = Settings(tmp_path / "s.json")
    assert s.values()["policy"] == "greedy"
    assert s.update({"policy": "risk_averse", "confidence_z": 2})["confidence_z"] == 2.0
    for bad in ({"policy": "x"}, {"confidence_z": 99}, {"guard_enabled": 1}, {"unknown": 1}, {"guard_min_observations": "many"}, {"confidence_z": True}):
        with pytest.raises(ValueError):
            s.update({"min_relative_gain": 0.5, **bad})
    assert s.values()["min_relative_gain"] == 0.05
    (tmp_path / "s.json").write_text("{damaged")
    monkeypatch.setenv("POLICY", "thompson")
    assert s.values()["policy"] == "thompson" and s.reset()["confidence_z"] == 1.0
    assert read_json(tmp_path / "none", [1]) == [1]


def test_profiles_and_saved_queries(tmp_path):
    assert redacted("db://me:secret@host/x") == "db://me:***@host/x" and redacted("/folder") == "/folder"
    p = Profiles(tmp_path / "p.json", lambda u: {"ok": "good" in u, "error": "no"})
    p.add("a", "db://me:pw@good/x")
    with pytest.raises(ValueError):
        p.add("b", "bad")
    assert p.activate("a").endswith("good/x") and p.all() == [{"name": "a", "url": "db://me:***@good/x", "active": True}]
    with pytest.raises(PermissionError):
        Profiles(tmp_path / "p.json", lambda u: {}, may_switch=False).activate("a")
    assert p.delete("a") and not p.delete("a") and p.all() == []
    q = SavedQueries(tmp_path, "url", lambda s: {"ok": s.startswith("select"), "error": "no query"})
    q.save("n", "select 1")
    q.save("n", "select 2")
    assert [(x["id"], x["sql"]) for x in q.all()] == [("user:n", "select 2")]
    with pytest.raises(ValueError):
        q.save("m", "drop")
    with pytest.raises(ValueError):
        q.save(" ", "select 1")
    assert q.delete("n") and SavedQueries(tmp_path, "other", lambda s: {}).all() == []
    assert model_fit({"a", "b"}, {"b", "c"}) == {"missing": ["a"], "new": ["c"], "fits": False}


def test_store_and_retraining(spark, tmp_path):
    files = Files(spark)
    s = ModelStore(files, str(tmp_path), lambda: dt.datetime(2024, 1, 1))
    assert s.versions() == [] and s.rollback() is None and s.current() is None

    def make(path):
        files.write_json(f"{path}/m.json", {"made": path})

    a, b = s.save(make, {"pending_rows": 5}), s.save(make)
    assert a != b and [v["version"] for v in s.versions()] == [b, a] and not any(v["current"] for v in s.versions())
    assert s.promote(b).endswith(b) and s.current() == b and s.rollback() == a and s.rollback() is None
    with pytest.raises(KeyError):
        s.promote("gone")
    assert s.save(make, version=a) == a and files.read_json(f"{s.path(a)}/m.json", {})["made"] == s.path(a)
    s.note(a, {"trained_until": "x"})
    assert [v for v in s.versions() if v["version"] == a][0]["trained_until"] == "x"
    files.delete(s.path(b))
    assert [v["version"] for v in s.versions()] == [a]
    (tmp_path / "registry.json").write_text("{broken")
    (tmp_path / ".registry.json.crc").unlink(missing_ok=True)
    assert s.versions() == []
    assert should_promote(100.0, 97.0)[0] and not should_promote(100.0, 99.0)[0] and not should_promote(None, None)[0] and should_promote(None, 5.0)[0]
    t = ModelStore(files, f"file://{tmp_path}/t", lambda: dt.datetime(2024, 1, 2))
    scores = iter([50.0, 50.0, 50.0, 40.0, 50.0, None])
    assert retrain(t, 10, make, lambda p: next(scores))["status"] == "skipped"
    assert retrain(t, 10, make, lambda p: next(scores), force=True)["status"] == "promoted"
    assert [retrain(t, 500, make, lambda p: next(scores))["status"] for _ in range(3)] == ["rejected", "promoted", "rejected"]


def test_training_job():
    job, go = TrainingJob(lines=2), threading.Event()

    def work(say, stopped):
        for i in range(5):
            say(str(i))
        go.wait(5)

    job.start(work)
    with pytest.raises(RuntimeError):
        job.start(work)
    assert job.stop() and job.status()["state"] == "stopping" and not job.stop()
    go.set()
    job.wait(5)
    assert job.status() == {"state": "stopped", "error": "", "lines": ["3", "4"]}
    job.start(lambda say, stopped: 1 / 0)
    job.wait(5)
    assert job.state == "failed" and "division" in job.error
    job.start(lambda say, stopped: None)
    job.wait(5)
    assert job.state == "done"


def test_timeouts(spark):
    assert run_with_timeout(spark, lambda: spark.range(5).count(), 60) == 5
    slow = lambda: spark.sparkContext.parallelize([1], 1).map(lambda x: time.sleep(30)).count()
    began = time.time()
    with pytest.raises(TimeoutError):
        run_with_timeout(spark, slow, 2)
    assert time.time() - began < 20
    with pytest.raises(ZeroDivisionError):
        run_with_timeout(spark, lambda: 1 / 0, 5)


def test_statistics():
    assert X.spread([10, 12, 11]) == pytest.approx(2 / 11)
    with pytest.raises(ValueError):
        X.spread([1, 2])
    n = X.noise({"a": [100, 10, 11, 12], "b": [10, 10, 10]})
    assert n["warm_spread"]["a"] == pytest.approx(2 / 11) and n["recommended_floor"] == pytest.approx(1 / 11)
    low, high = X.bootstrap_interval([1.0, 2.0, 3.0], resamples=500)
    assert 1 <= low < 2 < high <= 3 and math.isnan(X.bootstrap_interval([1.0])[0])
    assert X.sign_test([1, 1, 1, 1]) == 0.125 and X.sign_test([0]) is None and X.sign_test([1, -1]) == 1.0
    assert (X.verdict(1, 2), X.verdict(-2, -1), X.verdict(-1, 1)) == ("A", "B", "UNRESOLVED")
    order, calls = [], iter(range(100))

    def run(name, value):
        def go():
            order.append(name)
            if next(calls) == 2:
                raise RuntimeError
            return value

        return go

    r = X.compare(run("a", 5.0), run("b", 3.0), 4)
    assert r["n_pairs"] == 3 and r["mean_difference"] == 2.0 and r["verdict"] == "A" and order[:3] == ["a", "b", "b"]
    assert X.calibrate([{"deviation_rate": 0.0, "regression_rate": None, "net_ms": 9}, {"deviation_rate": 0.5, "regression_rate": 0.5, "net_ms": 8}, {"deviation_rate": 0.1, "regression_rate": 0.1, "net_ms": 2}])["net_ms"] == 2
    assert X.calibrate([]) is None
    assert X.bar_role(True, True, False, False) == "served" and X.bar_role(False, False, False, True) == "missed"
    assert X.choosing_share(1, 0) is None and X.saving_flag(10, 9.6) == "even" and X.saving_flag(10, 12) == "regressed"
    assert X.cost_flags(10, 20, 100, 50)["inverted"]
