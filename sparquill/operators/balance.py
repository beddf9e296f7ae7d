"""Per-key results when a few keys hold most rows.

Loads are estimated from a sample; keys are bin-packed to tasks, keys that would overfill a task
are split into proportionate shards, and the matching side of a join is replicated to exactly
those shards. The estimate only places rows: every row takes part in the result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sparquill.storage import materialize

#: Hash bins of light keys per task; the bins, not the keys, are packed.
BINS_PER_TASK = 16
#: A key is heavy from this part of a task's fair share on.
HEAVY_PART = 0.25
#: Sampled rows per task that loads are estimated from (a heavy key has 500 of them on average);
#: a table with fewer is counted whole.
SAMPLED_PER_TASK = 2000
#: Rows up to which a looked-up table is broadcast.
BROADCAST_ROWS = 50_000

_BIN, _SHARD, _TASK, _OWN = "__bin", "__shard", "__task", "__own_task"


@dataclass(frozen=True)
class LoadPlan:
    """Tasks of every heavy key's shards and of every bin of light keys.

    Holds at most ``tasks / HEAVY_PART`` heavy keys and ``tasks * BINS_PER_TASK`` bins,
    whatever the table holds.
    """

    tasks: int
    heavy: tuple[tuple[tuple, float, tuple[int, ...]], ...]
    bins: tuple[int, ...]
    loads: tuple[float, ...]


def pack(loads: Sequence[float], tasks: int) -> tuple[list[int], list[float]]:
    """Longest-processing-time packing: the task of each load, and each task's sum."""
    heap = [(0.0, t) for t in range(tasks)]
    placed = [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        at, t = heapq.heappop(heap)
        placed[i] = t
        heapq.heappush(heap, (at + loads[i], t))
    return placed, [x for x, _ in sorted(heap, key=lambda h: h[1])]


def _bin(keys: Sequence[str | Column], tasks: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) if isinstance(k, str) else k for k in keys]), F.lit(tasks * BINS_PER_TASK)).cast("int")


def plan_loads(df: DataFrame, keys: Sequence[str], tasks: int | None = None) -> LoadPlan:
    """Estimate the loads of the keys of ``df`` and pack them to ``tasks``.

    Null is a key like any other; for an empty table every bin gets a task and no key is heavy.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = df.count()
    part = min(1.0, SAMPLED_PER_TASK * tasks / max(1, total))
    seen = df.select(*keys) if part == 1.0 else df.select(*keys).sample(part, seed=17)
    per_key = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    is_heavy = F.col("__n") >= max(2.0, total * part / tasks * HEAVY_PART)
    rows = (
        per_key.withColumn(_BIN, _bin(keys, tasks))
        .groupBy(_BIN)
        .agg(
            F.sum(F.when(~is_heavy, F.col("__n"))).alias("light"),
            F.collect_list(F.when(is_heavy, F.struct(*keys, "__n"))).alias("heavy"),
        )
        .collect()
    )
    light = [0.0] * (tasks * BINS_PER_TASK)
    heavy: list[tuple[tuple, float]] = []
    for r in rows:
        light[r[_BIN]] = (r["light"] or 0) / part
        heavy += [(tuple(h[:-1]), h[-1] / part) for h in r["heavy"]]
    heavy.sort(key=lambda h: (-h[1], repr(h[0])))
    share = max(1.0, total / tasks)
    shards = [min(tasks, max(1, math.ceil(n / (share * HEAVY_PART)))) if n > share * HEAVY_PART else 1 for _, n in heavy]
    loads = [n / s for (_, n), s in zip(heavy, shards, strict=True) for _ in range(s)] + light
    placed, sums = pack(loads, tasks)
    out, at = [], 0
    for (key, n), s in zip(heavy, shards, strict=True):
        out.append((key, n, tuple(placed[at : at + s])))
        at += s
    return LoadPlan(tasks, tuple(out), tuple(placed[at:]), tuple(sums))


def _heavy_frame(df: DataFrame, keys: Sequence[str], plan: LoadPlan) -> DataFrame:
    schema = ", ".join(f"`__k{i}` {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    return df.sparkSession.createDataFrame([(*k, list(t)) for k, _, t in plan.heavy], f"{schema}, __tasks array<int>")


def _with_tasks(df: DataFrame, keys: Sequence[str], plan: LoadPlan) -> DataFrame:
    """``df`` with ``__tasks`` (of a heavy key's shards, else null) and ``__own_task`` (of the bin)."""
    heavy = _heavy_frame(df, keys, plan)
    same = [F.col(k).eqNullSafe(heavy[f"__k{i}"]) for i, k in enumerate(keys)]
    bins = df.sparkSession.createDataFrame(list(enumerate(plan.bins)), f"{_BIN} int, {_OWN} int")
    return (
        df.join(F.broadcast(heavy), same, "left")  # at most tasks / HEAVY_PART rows
        .drop(*[f"__k{i}" for i in range(len(keys))])
        .withColumn(_BIN, _bin(keys, plan.tasks))
        .join(F.broadcast(bins), _BIN)  # tasks * BINS_PER_TASK rows
        .drop(_BIN)
    )


def spread(df: DataFrame, keys: Sequence[str], plan: LoadPlan) -> DataFrame:
    """``df`` placed by ``plan``, with its task in ``__task``.

    Rows of a heavy key go to its shards in turn. ``df`` must be replayable in the same order
    (a scan or a written table), as for any round-robin placement.
    """
    turn = F.monotonically_increasing_id() % F.size("__tasks") + 1
    return (
        _with_tasks(df, keys, plan)
        .withColumn(_TASK, F.when(F.col("__tasks").isNull(), F.col(_OWN)).otherwise(F.element_at("__tasks", turn.cast("int"))))
        .drop("__tasks", _OWN)
        .repartitionById(plan.tasks, F.col(_TASK))
    )


def balanced_aggregate(df: DataFrame, keys: Sequence[str], partial: Mapping[str, Column], final: Mapping[str, Column], plan: LoadPlan | None = None) -> DataFrame:
    """Per-key results with the rows spread evenly over the tasks.

    ``partial`` are aggregates over a shard, ``final`` aggregates over the partial columns.
    Key columns keep their names; null keys form one group; an empty table has no groups.
    Columns of ``df`` other than the keys may have any names but ``__task``, ``__tasks``,
    ``__bin`` and ``__own_task``.
    """
    plan = plan or plan_loads(df, keys)
    shards = spread(df, keys, plan).groupBy(_TASK, *keys).agg(*[c.alias(k) for k, c in partial.items()])
    return shards.groupBy(*keys).agg(*[c.alias(k) for k, c in final.items()])


def _apart(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    for name in (set(left.columns) & set(right.columns)) - set(keys):
        right = right.withColumnRenamed(name, f"{name}_right")
    return right


def balanced_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", plan: LoadPlan | None = None) -> DataFrame:
    """Equi-join on ``keys`` (same names on both sides) with ``left``'s hot keys split.

    ``right``'s rows of a split key are replicated to that key's shards only; without a heavy
    key the plain join is even. ``how`` is inner or left. Null keys match nothing. A column of
    ``right`` whose name ``left`` has too gets the suffix ``_right``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    right = _apart(left, right, keys)
    plan = plan or plan_loads(left, keys)
    if not plan.heavy:
        return left.join(right, list(keys), how)
    placed = spread(left, keys, plan)
    copies = (
        _with_tasks(right, keys, plan)
        .withColumn(_TASK, F.explode(F.when(F.col("__tasks").isNull(), F.array(_OWN)).otherwise(F.array_distinct("__tasks"))))
        .drop("__tasks", _OWN)
        .repartitionById(plan.tasks, F.col(_TASK))
    )
    return placed.join(copies, [_TASK, *keys], how).drop(_TASK)


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", written: bool = True) -> DataFrame:
    """``balanced_join``, but with ``right`` broadcast while it has at most ``BROADCAST_ROWS`` rows.

    Both sides are scans or written tables, as they are read to be counted; a ``left`` that is
    not ``written`` is, where it has to be counted.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(_apart(left, right, keys)), list(keys), how)
    return balanced_join(left if written else materialize(left, "looked_up"), right, keys, how)


def task_shares(plan: LoadPlan) -> list[Row]:
    """Planned rows of each task, for reports."""
    return [Row(task=t, rows=x) for t, x in enumerate(plan.loads)]
