"""A running service: an engine with its settings, databases, model versions and training."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from sparquill.operators import log_analytics as A
from sparquill.plans import catalog
from sparquill.plans.decide import DecisionCache, Gate, Guard, Models
from sparquill.plans.engine import Engine
from sparquill.plans.files import Files
from sparquill.plans.lifecycle import ModelStore, Profiles, SavedQueries, Settings, TrainingJob, model_fit, redacted, retrain
from sparquill.plans.log import ExecutionLog
from sparquill.plans.workload import WorkloadItem, generate


class Service:
    """``home``: a driver folder for settings; ``store``: a shared folder for logs and models.

    A database's address is a data folder; its tables are the folder's parquet files.
    """

    def __init__(self, spark: SparkSession, home: str, store: str, address: str, may_switch: bool = True):
        self.spark, self.home, self.store, self.default = spark, Path(home), store.rstrip("/"), address
        self.files, self.settings, self.job = Files(spark), Settings(self.home / "settings.json"), TrainingJob()
        self.profiles = Profiles(self.home / "profiles.json", self.probe, may_switch)
        self.engine = Engine(spark, "")
        self.trained_at = None
        self._serve(address)

    # -- databases ----------------------------------------------------------------------------

    def _tables(self, address: str) -> tuple[str, ...]:
        return tuple(n.removesuffix(".parquet") for n in self.files.names(address) if n.endswith(".parquet"))

    def probe(self, address: str) -> dict:
        """Can the address be served, and do the models know its tables?"""
        tables = self._tables(address)
        if not tables:
            return {"ok": False, "error": f"{redacted(address)} holds no tables"}
        return {"ok": True, "tables": list(tables), "models": model_fit(set(self.engine.models.tables), set(tables))}

    def _serve(self, address: str) -> None:
        self.address = address
        key = catalog.database_name(address)
        self.engine.use_database(catalog.register_folder(self.spark, address, self._tables(address), analyze=False))
        self.engine.log = ExecutionLog(self.spark, f"{self.store}/logs/{key}")
        self.models = ModelStore(self.files, f"{self.store}/models/{key}")
        self.queries = SavedQueries(self.home / "queries", address, self.engine.validate)
        self.apply_settings()
        self.reload()
        self.engine.refresh_guard()

    def current(self) -> str:
        """The served address, without a password."""
        return redacted(self.address)

    def databases(self) -> list[dict]:
        return [p | {"models": self.probe(self.profiles.address(p["name"])).get("models")} for p in self.profiles.all()]

    def switch(self, name: str) -> str:
        """Serve a profile's database: tables, log, models, guard and cache are its own."""
        self._serve(self.profiles.activate(name))
        return self.current()

    def reset(self) -> str:
        """Back to the address the service was made with."""
        self._serve(self.default)
        return self.current()

    def analyze_tables(self, only_missing: bool = True) -> list[str]:
        """Compute statistics, of all tables or of those that have none; plans are made anew."""
        done = catalog.refresh_statistics(self.spark, self.engine.database, only_missing)
        self.engine.forget_sizes()
        return done

    # -- settings -----------------------------------------------------------------------------

    def apply_settings(self, changes: dict | None = None) -> dict:
        """Store changes, all or none, and rebuild gate, guard and cache from all values."""
        values = self.settings.update(changes) if changes else self.settings.values()
        e = self.engine
        e.policy, e.risk_lambda = values["policy"], values["risk_lambda"]
        e.gate = Gate(values["confidence_z"], values["min_relative_gain"])
        blocked, served = e.guard.blocked, e.guard.served
        e.guard = Guard(values["guard_min_observations"], tolerance=values["guard_tolerance"], enabled=values["guard_enabled"])
        e.guard.blocked, e.guard.served = blocked, served
        e.cache = DecisionCache(values["cache_size"], values["cache_seconds"])
        return values

    # -- models -------------------------------------------------------------------------------

    def reload(self) -> bool:
        """Take the current version from the store; settings that were set go before its gate."""
        version = self.models.current()
        if version is None:
            self.engine.models, self.engine.corrector = Models(), None
        loaded = version is not None and self.engine.load_models(self.models.path(version))
        explicit = self.settings.explicit()
        if {"confidence_z", "min_relative_gain"} & explicit:
            values = self.settings.values()
            self.engine.gate = Gate(values["confidence_z"], values["min_relative_gain"])
        return loaded

    def pending_rows(self) -> int:
        """Trainable rows since the current version was made."""
        made = next((v.get("trained_until") for v in self.models.versions() if v["current"]), None)
        return A.pending_rows(self.engine.log.read(), made).first()[0]

    def retrain(self, force: bool = False, least_rows: int = 200) -> dict:
        """Train a challenger on the log and promote it if it serves the last queries better."""
        newest = A.trainable(self.engine.log.read()).selectExpr("cast(max(created_at) as string)").first()[0]
        trial = Engine(self.spark, self.engine.database, self.engine.log)

        def make(path: str) -> None:
            trial.train()
            trial.calibrate()
            trial.save_models(path)

        def score(path: str) -> float | None:
            return trial.served_average() if trial.load_models(path) else None

        out = retrain(self.models, self.pending_rows(), make, score, force, least_rows)
        if "version" in out:
            self.models.note(out["version"], {"trained_until": newest})
        if out["status"] == "promoted":
            self.reload()
            self.engine.train_corrector()
        return out

    def rollback(self) -> str | None:
        """Serve the version before; None if there is none."""
        version = self.models.rollback()
        if version:
            self.reload()
        return version

    def status(self) -> dict:
        """Mode, policy, version, pending rows, newest versions, blocked queries, cache; the guard is refreshed."""
        self.engine.refresh_guard()
        return self.engine.status() | {"version": self.models.current(), "pending_rows": self.pending_rows(), "versions": self.models.versions()[:10]}

    # -- training -----------------------------------------------------------------------------

    def workload(self, items: Sequence[WorkloadItem] = ()) -> list[WorkloadItem]:
        """Given items and the database's saved queries."""
        return [*items, *(WorkloadItem(q["id"], q["sql"], q["description"], 0) for q in self.queries.all())]

    def start_training(self, items: Sequence[WorkloadItem] = (), reps: int = 3, promote: bool = True, strategies: bool = True) -> None:
        """Collect a workload and retrain in the background; ``RuntimeError`` while another runs or
        without queries."""
        todo = self.workload(items)
        if not todo:
            raise RuntimeError("there are no queries to train on")

        def work(say: Callable[[str], None], stopped: Callable[[], bool]) -> None:
            for item in todo:
                if stopped():
                    return
                self.engine.collect([item], reps, strategies)
                say(f"{item.id} collected")
            if promote:
                out = self.retrain(force=True)
                say(f"{out['status']}: {out.get('reason', '')}")

        self.job.start(work)

    def onboard(self, n: int = 25, widths: tuple[int, ...] = (2, 3, 4), reps: int = 3, strategies: bool = True, seed: int = 42) -> dict:
        """From a new database to a served model: discover, generate, collect, train.

        ``ValueError`` for a database without edges or without any query that can be made.
        """
        graph = catalog.discover(self.spark, self.engine.database)
        if not graph.keys:
            raise ValueError("no foreign keys are known or can be inferred")
        items = generate(self.spark, self.engine.database, graph, n, widths, seed)
        if not items:
            raise ValueError("no queries can be made")
        self.files.write_json(f"{self.store}/workloads/{self.engine.database}.json", [vars(i) for i in items])
        done = self.engine.collect(items, reps, strategies)
        return {"schema": graph.summary(), "n_queries": len(items), "n_collected": done, "training": self.retrain(force=True)}
