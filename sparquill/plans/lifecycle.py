"""What outlives a session: settings, profiles, saved queries, model versions, training jobs.

Settings, profiles and saved queries are small JSON files of the driver, a damaged one counts as
absent; model versions lie on a shared file system.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import threading
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import md5
from pathlib import Path

from sparquill.plans.files import Files


def read_json(path: Path, default):
    """The file's value, or ``default`` for a missing or damaged file or another type."""
    try:
        value = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return default
    return value if isinstance(value, type(default)) else default


def write_json(path: Path, value) -> None:
    """Replace the file in one step."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(".part")
    part.write_text(json.dumps(value, indent=1, sort_keys=True))
    os.replace(part, path)


@dataclass(frozen=True)
class Setting:
    """A declared setting; ``options`` or a range limit it."""

    name: str
    kind: type
    default: object
    low: float | None = None
    high: float | None = None
    options: tuple = ()
    env: str = ""

    def check(self, value):
        """The value in its type; ``ValueError`` says what is wrong."""
        if self.kind is bool:
            if not isinstance(value, bool):
                raise ValueError(f"{self.name} must be true or false")
            return value
        if isinstance(value, bool):
            raise ValueError(f"{self.name} must be a {self.kind.__name__}")
        try:
            value = self.kind(value)
        except (TypeError, ValueError):
            raise ValueError(f"{self.name} must be a {self.kind.__name__}") from None
        if self.options and value not in self.options:
            raise ValueError(f"{self.name} must be one of {', '.join(map(str, self.options))}")
        if (self.low is not None and value < self.low) or (self.high is not None and value > self.high):
            raise ValueError(f"{self.name} must be between {self.low} and {self.high}")
        return value


SETTINGS = (
    Setting("risk_lambda", float, 1.0, 0.0, 10.0, env="RISK_LAMBDA"),
    Setting("cache_size", int, 512, 0, 1_000_000, env="CACHE_SIZE"),
    Setting("policy", str, "greedy", options=("greedy", "thompson", "risk_averse", "pairwise_rank"), env="POLICY"),
    Setting("confidence_z", float, 1.0, 0.0, 5.0, env="CONFIDENCE_Z"),
    Setting("min_relative_gain", float, 0.05, 0.0, 0.9, env="MIN_RELATIVE_GAIN"),
    Setting("guard_enabled", bool, True),
    Setting("guard_tolerance", float, 0.10, 0.0, 5.0, env="GUARD_TOLERANCE"),
    Setting("guard_min_observations", int, 3, 1, 1000, env="GUARD_MIN_OBSERVATIONS"),
    Setting("cache_seconds", float, 300.0, 0.0, 86400.0, env="CACHE_SECONDS"),
    Setting("auto_retrain_seconds", int, 0, 0, 604800, env="AUTO_RETRAIN_SECONDS"),
)


class Settings:
    """Values of the declared settings: file, then environment, then default."""

    def __init__(self, path: str | Path, declared: tuple[Setting, ...] = SETTINGS):
        self.path, self.declared = Path(path), {s.name: s for s in declared}

    def values(self) -> dict:
        held = read_json(self.path, {})
        out = {}
        for name, s in self.declared.items():
            out[name] = s.default
            for value in (held.get(name), os.environ.get(s.env) if s.env else None):
                if value is not None:
                    try:
                        out[name] = s.check(value)
                        break
                    except ValueError:
                        continue
        return out

    def explicit(self) -> set[str]:
        """Names of the settings that the file or the environment gives."""
        held = read_json(self.path, {})
        return {n for n, s in self.declared.items() if n in held or (s.env and s.env in os.environ)}

    def update(self, changes: dict) -> dict:
        """All of the changes or, with a ``ValueError``, none."""
        if unknown := set(changes) - set(self.declared):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        checked = {k: self.declared[k].check(v) for k, v in changes.items()}
        write_json(self.path, read_json(self.path, {}) | checked)
        return self.values()

    def reset(self) -> dict:
        self.path.unlink(missing_ok=True)
        return self.values()


_SECRET = re.compile(r"(?<=://)([^:/@\s]+):[^@\s]*@")


def redacted(url: str) -> str:
    """A URL without its password."""
    return _SECRET.sub(r"\1:***@", url)


class Profiles:
    """Named data folders (or databases), one of them active; each is probed before it is added."""

    def __init__(self, path: str | Path, probe: Callable[[str], dict], may_switch: bool = True):
        self.path, self.probe, self.may_switch = Path(path), probe, may_switch

    def _held(self) -> dict:
        return read_json(self.path, {"active": None, "profiles": {}})

    def all(self) -> list[dict]:
        held = self._held()
        return [{"name": n, "url": redacted(u), "active": n == held["active"]} for n, u in sorted(held["profiles"].items())]

    def add(self, name: str, url: str) -> dict:
        found = self.probe(url)
        if not found.get("ok"):
            raise ValueError(found.get("error", "the profile can't be reached"))
        held = self._held()
        held["profiles"][name] = url
        write_json(self.path, held)
        return found

    def delete(self, name: str) -> bool:
        held = self._held()
        gone = held["profiles"].pop(name, None) is not None
        held["active"] = None if held["active"] == name else held["active"]
        write_json(self.path, held)
        return gone

    def address(self, name: str) -> str:
        return self._held()["profiles"][name]

    def activate(self, name: str) -> str:
        if not self.may_switch:
            raise PermissionError("switching is disabled")
        held = self._held()
        url = held["profiles"][name]
        held["active"] = name
        write_json(self.path, held)
        return url


def model_fit(model_tables: set[str], tables: set[str]) -> dict:
    """Tables that a model knows and the database lacks, and the other way round."""
    return {"missing": sorted(model_tables - tables), "new": sorted(tables - model_tables), "fits": not model_tables - tables}


class SavedQueries:
    """A database's own queries, by name, as ``user:<name>``."""

    def __init__(self, folder: str | Path, url: str, validate: Callable[[str], dict]):
        self.path, self.validate = Path(folder) / f"{md5(url.encode()).hexdigest()[:12]}.json", validate

    def all(self) -> list[dict]:
        return [{"name": n, "id": f"user:{n}", **q} for n, q in sorted(read_json(self.path, {}).items())]

    def save(self, name: str, sql: str, description: str = "") -> dict:
        found = self.validate(sql)
        if not found.get("ok"):
            raise ValueError(found.get("error", "not a query"))
        if not name.strip():
            raise ValueError("a name is needed")
        write_json(self.path, read_json(self.path, {}) | {name.strip(): {"sql": sql, "description": description}})
        return found

    def delete(self, name: str) -> bool:
        held = read_json(self.path, {})
        gone = held.pop(name, None) is not None
        write_json(self.path, held)
        return gone


class ModelStore:
    """Versions of models in folders below ``root``, on a file system that executors share; one is
    current, named by a pointer file."""

    def __init__(self, files: Files, root: str, clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC)):
        self.files, self.root, self.clock = files, str(root).rstrip("/"), clock

    def path(self, version: str) -> str:
        return f"{self.root}/{version}"

    def save(self, write: Callable[[str], None], info: dict | None = None, version: str | None = None) -> str:
        """Write a version to its folder; a given version is replaced, a made one never clashes.

        A version counts once it is in the registry, which is written last.
        """
        if version is None:
            base = self.clock().strftime("%Y%m%dT%H%M%SZ")
            version, n = base, 2
            while self.files.exists(self.path(version)):
                version, n = f"{base}-{n}", n + 1
        self.files.delete(self.path(version))
        write(self.path(version))
        self.files.write_json(f"{self.root}/registry.json", self._registry() | {version: info or {}})
        return version

    def _registry(self) -> dict:
        return self.files.read_json(f"{self.root}/registry.json", {})

    def versions(self) -> list[dict]:
        """Newest first."""
        current, held, there = self.current(), self._registry(), set(self.files.names(self.root))
        return [{"version": v, "current": v == current, **held[v]} for v in sorted(held, reverse=True) if v in there]

    def note(self, version: str, facts: dict) -> None:
        """Add facts to what the registry says of a version."""
        held = self._registry()
        self.files.write_json(f"{self.root}/registry.json", held | {version: held[version] | facts})

    def current(self) -> str | None:
        return self.files.read_json(f"{self.root}/current.json", {}).get("version")

    def promote(self, version: str) -> str:
        if version not in self._registry() or not self.files.exists(self.path(version)):
            raise KeyError(version)
        self.files.write_json(f"{self.root}/current.json", {"version": version})
        return self.path(version)

    def rollback(self) -> str | None:
        """To the newest version older than the current one; None without one."""
        current = self.current()
        older = [v["version"] for v in self.versions() if current is not None and v["version"] < current]
        if not older:
            return None
        self.promote(older[0])
        return older[0]


def should_promote(champion_ms: float | None, challenger_ms: float | None, least_gain: float = 0.02) -> tuple[bool, str]:
    """Is the challenger's served time better by more than ``least_gain``?"""
    if challenger_ms is None:
        return False, "the challenger can't be scored"
    if champion_ms is None:
        return True, "there is no champion"
    gain = (champion_ms - challenger_ms) / champion_ms if champion_ms else 0.0
    return gain > least_gain, f"gain {gain:.1%}"


def retrain(store: ModelStore, pending: int, make: Callable[[str], None], score: Callable[[str], float | None], force: bool = False, least_rows: int = 200) -> dict:
    """Train a challenger if there are enough new rows, and promote it if it serves better.

    The first model needs no rival; a challenger that cannot be scored is rejected.
    """
    if pending < least_rows and not force:
        return {"status": "skipped", "reason": f"{pending} of {least_rows} new rows"}
    champion = store.current()
    version = store.save(make, {"pending_rows": pending})
    good, why = (True, "first model") if champion is None else should_promote(score(store.path(champion)), score(store.path(version)))
    if good:
        store.promote(version)
    return {"status": "promoted" if good else "rejected", "version": version, "reason": why}


class TrainingJob:
    """One background job at a time, with a state, a log of its last lines and a stop flag."""

    STATES = ("idle", "running", "stopping", "done", "failed", "stopped")

    def __init__(self, lines: int = 200):
        self.state, self.error, self._stop, self._lock = "idle", "", threading.Event(), threading.Lock()
        self.lines: deque[str] = deque(maxlen=lines)
        self._thread: threading.Thread | None = None

    def start(self, work: Callable[[Callable[[str], None], Callable[[], bool]], None]) -> None:
        """Run ``work(say, stopped)``; ``RuntimeError`` while another runs."""
        with self._lock:
            if self.state in ("running", "stopping"):
                raise RuntimeError("a job is running")
            self.state, self.error = "running", ""
            self.lines.clear()
            self._stop.clear()

        def run() -> None:
            try:
                work(self.lines.append, self._stop.is_set)
                self.state = "stopped" if self._stop.is_set() else "done"
            except Exception as e:
                self.error, self.state = str(e), "failed"

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def stop(self) -> bool:
        """Ask the job to end after its current step."""
        with self._lock:
            if self.state != "running":
                return False
            self._stop.set()
            self.state = "stopping"
            return True

    def wait(self, seconds: float | None = None) -> None:
        if self._thread:
            self._thread.join(seconds)

    def status(self) -> dict:
        return {"state": self.state, "error": self.error, "lines": list(self.lines)}


def run_with_timeout(spark, action: Callable[[], object], seconds: float):
    """Run an action in its own job group and cancel it when time is up (``TimeoutError``)."""
    from pyspark import InheritableThread

    group, box = f"sparquill-{threading.get_ident()}-{os.urandom(4).hex()}", {}

    def work() -> None:
        spark.sparkContext.setJobGroup(group, "timed", interruptOnCancel=True)
        try:
            box["value"] = action()
        except Exception as e:
            box["error"] = e

    thread = InheritableThread(target=work)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.sparkContext.cancelJobGroup(group)
        thread.join()
        raise TimeoutError(f"cancelled after {seconds} s")
    if "error" in box:
        raise box["error"]
    return box.get("value")
