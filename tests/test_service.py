import shutil

import pytest

from sparquill.plans.service import Service
from sparquill.plans.workload import WorkloadItem, join_queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    for name, tables in (("star", ("region", "nation", "customer", "orders")), ("bare", ("events",))):
        (root / name).mkdir()
        for t in tables:
            shutil.copy(f"{DATA}/{t}.parquet", root / name / f"{t}.parquet")
    return root


@pytest.fixture(scope="module")
def service(spark, folders, tmp_path_factory):
    home = tmp_path_factory.mktemp("home")
    return Service(spark, str(home), str(home / "shared"), str(folders / "star"))


def test_onboarding_serves_a_model(service):
    assert service.engine.health() == {"status": "ok"} and service.status()["mode"] == "heuristic"
    out = service.onboard(n=4, widths=(2, 3), reps=1, strategies=False)
    assert out["n_queries"] >= 2 and out["n_collected"] == out["n_queries"] and out["training"]["status"] == "promoted"
    s = service.status()
    assert s["mode"] == "learned" and s["version"] == out["training"]["version"] and s["pending_rows"] == 0 and len(s["versions"]) == 1
    assert service.retrain()["status"] == "skipped"
    again = service.retrain(force=True)
    assert again["status"] in ("promoted", "rejected") and len(service.status()["versions"]) == 2
    if again["status"] == "promoted":
        assert service.rollback() == out["training"]["version"]
    assert service.rollback() is None and service.engine.mode == "learned"
    sql = join_queries(service.engine.database)["spj_3way"]
    served = service.engine.optimize(sql, "mine")
    assert served.plan.n_rows == service.spark.sql(sql).count()


def test_settings_reach_the_engine(service):
    service.engine.cache.put("x", None)
    service.apply_settings({"policy": "risk_averse", "confidence_z": 0.5, "guard_enabled": False, "cache_size": 3, "cache_seconds": 60.0, "risk_lambda": 2.0})
    e = service.engine
    assert (e.policy, e.gate.z, e.guard.enabled, e.cache.size, e.risk_lambda) == ("risk_averse", 0.5, False, 3, 2.0) and e.cache.stats()["size"] == 0
    with pytest.raises(ValueError):
        service.apply_settings({"policy": "none"})
    assert e.policy == "risk_averse"
    # what was set goes before the gate that is stored with a model
    service.reload()
    assert service.engine.gate.z == 0.5
    service.settings.reset()
    service.apply_settings()
    assert service.engine.policy == "greedy"


def test_databases(service, folders):
    home = service.current()
    with pytest.raises(ValueError):
        service.profiles.add("nowhere", str(folders / "nothing"))
    service.profiles.add("bare", str(folders / "bare"))
    assert service.databases()[0]["models"]["new"] == ["events"]
    assert service.switch("bare").endswith("bare") and service.engine.mode == "heuristic" and service.engine.log.read().count() == 0
    with pytest.raises(ValueError):
        service.onboard()
    assert service.analyze_tables() == ["events"] and service.analyze_tables() == [] and service.engine.sizes() == {"events": 1000}
    assert service.reset() == home and service.engine.mode == "learned"
    service.profiles.may_switch = False
    with pytest.raises(PermissionError):
        service.switch("bare")


def test_training_job(service):
    with pytest.raises(RuntimeError):
        service.start_training()
    d = service.engine.database
    service.queries.save("two way", join_queries(d)["spj_2way_control"], "mine")
    assert [i.id for i in service.workload()] == ["user:two way"]
    service.start_training([WorkloadItem("w", join_queries(d)["spj_2way_trap"], "", 2)], reps=1, strategies=False)
    service.job.wait(240)
    state = service.job.status()
    assert state["state"] == "done" and state["lines"][:2] == ["w collected", "user:two way collected"] and len(state["lines"]) == 3
