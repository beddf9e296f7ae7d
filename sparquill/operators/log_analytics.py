"""What the execution log says about decisions: matched runs, outcomes, regret, labels.

A run is one decision: the log rows of one query key and one time. Readings that are no
durations take no part. Every function returns a DataFrame over the whole log; a ``limit`` is
a report's newest runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions.keys import DISABLED_COST, is_duration, query_key, selector
from sparquill.operators.balance import lookup
from sparquill.operators.ordering import ordered_table, partition_offsets
from sparquill.operators.quantiles import group_percentiles, value_counts
from sparquill.storage import materialize

COLLECTION = "collection"
#: A plan is materially faster from this many ms and this part of the slower time on.
MATERIAL_MS, MATERIAL_PART = 2.0, 0.05
OUTCOMES = ("win", "wash", "loss", "held_correct", "held_missed")


def readings_of(log: DataFrame) -> DataFrame:
    """Log rows with a valid reading: with ``query_key``, ``ms``, ``selector`` and null flags as false."""
    flag = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_baseline", "is_chosen")}
    ms = F.col("actual_total_time_ms")
    return log.where(is_duration(ms)).select("id", "query_id", query_key().alias("query_key"), "sql_text", "hint", "total_cost", ms.alias("ms"), selector().alias("selector"), "created_at", *[v.alias(k) for k, v in flag.items()])


def _newest(runs: DataFrame, limit: int | None) -> DataFrame:
    """The newest ``limit`` runs, oldest first; all of them, in no order, without a limit."""
    if limit is None:
        return runs
    return runs.orderBy(F.desc("created_at"), F.desc("query_key")).limit(limit).orderBy("created_at", "query_key")


def matched_runs(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs with both a native and a served reading, without collected rows."""
    native, served = F.min(F.when(F.col("is_baseline"), F.col("ms"))), F.min(F.when(F.col("is_chosen"), F.col("ms")))
    runs = (
        readings_of(log)
        .where(F.col("selector") != COLLECTION)
        .groupBy("query_key", "created_at")
        .agg(
            F.min("sql_text").alias("sql_text"), native.alias("native_ms"), served.alias("served_ms"), F.min(F.col("ms")).alias("best_ms"), F.count(F.lit(1)).alias("n_plans"),
            F.bool_or(F.col("is_chosen") & F.col("hint").isNotNull()).alias("deviated"), F.min(F.when(F.col("is_chosen"), F.col("selector"))).alias("selector"),
        )
        .where(F.col("native_ms").isNotNull() & F.col("served_ms").isNotNull())
    )
    return _newest(runs, limit)


def materially_faster(fast: Column, slow: Column, part: float = MATERIAL_PART) -> Column:
    """Is ``fast`` faster than ``slow`` by more than noise?"""
    return (slow - fast >= MATERIAL_MS) & (slow > 0) & ((slow - fast) / slow >= part)


def with_outcome(runs: DataFrame, part: float = MATERIAL_PART) -> DataFrame:
    """Runs with ``outcome``: of a deviation win, loss or wash; of a held plan correct or missed."""
    n, s, b = F.col("native_ms"), F.col("served_ms"), F.col("best_ms")
    left = F.when(materially_faster(s, n, part), "win").when(materially_faster(n, s, part), "loss").otherwise("wash")
    held = F.when(materially_faster(b, n, part), "held_missed").otherwise("held_correct")
    return runs.withColumn("outcome", F.when(F.col("deviated"), left).otherwise(held))


def _totals() -> list[Column]:
    n, s, b = (F.sum(c) for c in ("native_ms", "served_ms", "best_ms"))
    room = n - b
    return [
        F.count(F.lit(1)).alias("n_runs"), F.round(n, 3).alias("native_ms"), F.round(s, 3).alias("served_ms"), F.round(b, 3).alias("best_ms"),
        F.round(F.avg("native_ms"), 8).alias("avg_native_ms"), F.round(F.avg("served_ms"), 8).alias("avg_served_ms"), F.round((n - s) / n * 100, 4).alias("improvement_pct"), F.round(room, 3).alias("headroom_ms"),
        F.round(F.when(room > 0, (n - s) / room * 100), 4).alias("captured_pct"),
        F.count_if("deviated").alias("n_deviated"), F.count_if(~F.col("deviated")).alias("n_kept_native"),
    ]


def summary(runs: DataFrame) -> DataFrame:
    """One row of totals; ``captured_pct`` is null without headroom."""
    return runs.agg(*_totals())


def by_query(runs: DataFrame) -> DataFrame:
    """Totals per query key; ``delta_ms`` above zero is a regression."""
    latest = F.max_by("sql_text", F.struct("created_at", "query_key"))
    return runs.groupBy("query_key").agg(
        *_totals(), F.round(F.sum("served_ms") - F.sum("native_ms"), 3).alias("delta_ms"), F.first(F.col("query_key").startswith("adhoc:")).alias("is_adhoc"), F.regexp_replace(F.trim(latest), r"\s+", " ").alias("sql_line")
    )


def regressions_first(runs: DataFrame) -> DataFrame:
    """``by_query``, the largest loss first, for reports."""
    return by_query(runs).orderBy(F.desc("delta_ms"), "query_key")


def _with_missed(rows: DataFrame) -> DataFrame:
    """Per run: the native time, whether another plan was served, and the fastest other plan."""
    other = ~F.col("is_baseline")
    fastest = F.min(F.when(other, F.struct("ms", "id", "hint")))
    runs = rows.groupBy("query_key", "created_at").agg(F.min(F.when(F.col("is_baseline"), F.col("ms"))).alias("native_ms"), F.bool_or(F.col("is_chosen") & other).alias("left_native"), fastest.alias("f"))
    return runs.withColumn("is_missed", ~F.col("left_native") & F.coalesce(F.col("f.ms") < F.col("native_ms"), F.lit(False)))


def missed_plans(log: DataFrame) -> DataFrame:
    """Runs that kept the native plan though a faster one was measured, with that plan."""
    runs = _with_missed(readings_of(log)).where("is_missed")
    return runs.select("query_key", "created_at", "native_ms", F.col("f.hint").alias("missed_hint"), F.col("f.ms").alias("missed_ms"))


def plan_roles(log: DataFrame) -> DataFrame:
    """(id, role) of every reading: served, native, vetoed (a disabled operator), missed or candidate."""
    rows = materialize(readings_of(log), "readings")
    runs = _with_missed(rows).select(F.col("query_key").alias("_k"), F.col("created_at").alias("_t"), "is_missed", F.col("f.id").alias("fastest"))
    both = rows.join(runs, (F.col("query_key") == F.col("_k")) & F.col("created_at").eqNullSafe(F.col("_t")))
    missed = F.col("is_missed") & (F.col("id") == F.col("fastest"))
    role = F.when(F.col("is_chosen"), "served").when(F.col("is_baseline"), "native").when(F.col("total_cost") >= DISABLED_COST, "vetoed").when(missed, "missed").otherwise("candidate")
    return both.select("id", role.alias("role"))


def by_day(runs: DataFrame) -> DataFrame:
    """Totals per calendar day."""
    return runs.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("n_runs"), F.round(F.sum("native_ms"), 3).alias("native_ms"), F.round(F.sum("served_ms"), 3).alias("served_ms"), F.round(F.sum("best_ms"), 3).alias("best_ms"), F.count_if("deviated").alias("n_deviated")
    )


def outcomes(runs: DataFrame, part: float = MATERIAL_PART) -> DataFrame:
    """Runs per outcome; all five appear."""
    every = runs.sparkSession.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    counted = with_outcome(runs, part).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counted, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n_runs"))


def decision_quality(runs: DataFrame, noise_floor: float | None = None) -> DataFrame:
    """Counts per outcome and ms saved, lost and missed; recounted at a noise floor above 5 %."""
    part = noise_floor if noise_floor is not None and noise_floor > MATERIAL_PART else MATERIAL_PART
    r = with_outcome(runs, part)
    gain = F.col("native_ms") - F.col("served_ms")
    is_ = F.col("outcome")
    return r.agg(
        *[F.count_if(is_ == o).alias(f"n_{o}") for o in OUTCOMES],
        F.round(F.coalesce(F.sum(F.when(is_ == "win", gain)), F.lit(0.0)), 3).alias("saved_ms"),
        F.round(F.coalesce(F.sum(F.when(is_ == "loss", -gain)), F.lit(0.0)), 3).alias("regression_ms"),
        F.round(F.coalesce(F.sum(F.when(is_ == "held_missed", F.col("native_ms") - F.col("best_ms"))), F.lit(0.0)), 3).alias("missed_ms"),
    )


def log_counts(log: DataFrame) -> DataFrame:
    """Rows, collected rows and query keys of the whole log."""
    return log.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(selector() == COLLECTION).alias("n_collection"), F.count_distinct(query_key()).alias("n_queries"))


def running_totals(df: DataFrame, order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with cumulative sums (new name -> column) in the total ``order``.

    Sorted by range; each partition sums its rows and begins at the total of those before, so
    no task holds more than a partition.
    """
    line = ordered_table(df, order, "running")
    own = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    out = line
    for name, column in sums.items():
        shift = partition_offsets(line, F.coalesce(F.col(column).cast("double"), F.lit(0.0))).withColumnRenamed("_offset", f"_shift_{name}")
        out = out.join(F.broadcast(shift), "_part")  # a row per partition
    for name, column in sums.items():
        out = out.withColumn(name, F.col(f"_shift_{name}") + F.sum(F.coalesce(F.col(column).cast("double"), F.lit(0.0))).over(own))
    return out.drop(*[f"_shift_{n}" for n in sums], "_part", "_row")


def regret_curve(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Regret of each decision and its cumulative sum, served and native."""
    runs = (
        readings_of(log)
        .groupBy("query_key", "created_at")
        .agg(F.min(F.col("ms")).alias("best_ms"), F.min(F.when(F.col("is_chosen"), F.col("ms"))).alias("served_ms"), F.min(F.when(F.col("is_baseline"), F.col("ms"))).alias("native_ms"))
        .where(F.col("served_ms").isNotNull())
    )
    each = _newest(runs, limit).select(
        "query_key", "created_at", F.greatest(F.col("served_ms") - F.col("best_ms"), F.lit(0.0)).alias("regret_ms"),
        F.greatest(F.coalesce("native_ms", "served_ms") - F.col("best_ms"), F.lit(0.0)).alias("native_regret_ms"),
    )
    total = running_totals(each, ["created_at", "query_key"], {"cum_regret": "regret_ms", "cum_native": "native_regret_ms"})
    return total.select("query_key", "created_at", F.round("regret_ms", 3).alias("regret_ms"), F.round("cum_regret", 3).alias("cumulative_regret_ms"), F.round("cum_native", 3).alias("native_cumulative_regret_ms"))


def regret_summary(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Decisions, total and mean regret, and its ratio to native's (null if that is 0)."""
    runs = readings_of(log).groupBy("query_key", "created_at").agg(F.min(F.col("ms")).alias("b"), F.min(F.when(F.col("is_chosen"), F.col("ms"))).alias("s"), F.min(F.when(F.col("is_baseline"), F.col("ms"))).alias("n")).where(F.col("s").isNotNull())
    served, native = F.sum(F.col("s") - F.col("b")), F.sum(F.coalesce("n", "s") - F.col("b"))
    return _newest(runs, limit).agg(F.count(F.lit(1)).alias("n_decisions"), F.round(served, 3).alias("regret_ms"), F.round(native, 3).alias("native_regret_ms"), F.round(served / F.count(F.lit(1)), 4).alias("mean_regret_ms"), F.round(F.when(native > 0, served / native), 6).alias("regret_ratio"))


def cumulative_totals(runs: DataFrame) -> DataFrame:
    """Cumulative native, served and best time and what was saved, by decision."""
    total = running_totals(runs.select("created_at", "query_key", "native_ms", "served_ms", "best_ms"), ["created_at", "query_key"], {"cum_native": "native_ms", "cum_served": "served_ms", "cum_best": "best_ms"})
    n, s, b = F.col("cum_native"), F.col("cum_served"), F.col("cum_best")
    return total.select("created_at", "query_key", F.round(n, 3).alias("cum_native_ms"), F.round(s, 3).alias("cum_served_ms"), F.round(b, 3).alias("cum_best_ms"), F.round(n - s, 3).alias("cum_saved_ms"), F.round(s - b, 3).alias("cum_regret_ms"))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` (a written table) with the rank of ``column``, ties averaged; nulls have no rank and go.

    Values are counted before they are sorted; a value's ranks follow from the counts before it.
    """
    counts = materialize(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), "counts")
    line = running_totals(counts, [column], {"_upto": "n"})
    ranks = line.select(F.col(column).alias("_value"), (F.col("_upto") - F.col("n") / 2 + 0.5).alias(name))
    return lookup(df, materialize(ranks.withColumnRenamed("_value", column), "ranks"), [column])


def cost_points(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Estimated cost and measured time of the plans without a disabled operator, with their kind."""
    kind = F.when(F.col("is_baseline"), "native").when(F.col("hint").isNotNull(), "hinted").otherwise("candidate")
    points = readings_of(log).where((F.col("total_cost") > 0) & (F.col("total_cost") < DISABLED_COST))
    if limit is not None:
        points = points.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return points.select("id", "total_cost", F.col("ms").alias("latency_ms"), kind.alias("kind"))


def cost_rank_correlation(points: DataFrame) -> DataFrame:
    """Spearman's rank correlation of cost and time; null below three points or without variance."""
    base = materialize(points.select("total_cost", "latency_ms"), "points")
    ranked = average_ranks(materialize(average_ranks(base, "total_cost", "rx"), "ranked"), "latency_ms", "ry")
    ok = (F.count(F.lit(1)) >= 3) & (F.stddev_pop("rx") > 0) & (F.stddev_pop("ry") > 0)
    return ranked.agg(F.count(F.lit(1)).alias("n_points"), F.round(F.when(ok, F.corr("rx", "ry")), 6).alias("rank_correlation"))


def guard_averages(log: DataFrame) -> DataFrame:
    """Per query_id: mean native and mean deviating time, and the number of deviations."""
    served = F.col("is_chosen") & F.col("hint").isNotNull()
    return readings_of(log).where(F.col("query_id").isNotNull()).groupBy("query_id").agg(
        F.avg(F.when(F.col("is_baseline"), F.col("ms"))).alias("native_avg"), F.avg(F.when(served, F.col("ms"))).alias("chosen_avg"), F.count_if(served).alias("n_chosen")
    )


def regressed_queries(log: DataFrame, tolerance: float = 0.10, min_observations: int = 3) -> DataFrame:
    """Queries whose deviations are slower than native by more than ``tolerance``."""
    g = guard_averages(log).where((F.col("n_chosen") >= min_observations) & (F.col("chosen_avg") > F.col("native_avg") * (1 + tolerance)))
    return g.select("query_id", F.round("native_avg", 4).alias("native_avg_ms"), F.round("chosen_avg", 4).alias("chosen_avg_ms"), F.round(F.col("chosen_avg") / F.col("native_avg"), 6).alias("regression_ratio"), F.col("n_chosen").alias("n_observations"))


def observation_counts(log: DataFrame, min_observations: int = 3, unseen_caution: float = 2.0) -> DataFrame:
    """Served rows of each query_id and the caution multiplier that follows, 2 falling to 1."""
    n = F.count_if("is_chosen")
    caution = F.lit(unseen_caution) - (unseen_caution - 1.0) * F.least(n / F.lit(float(max(1, min_observations))), F.lit(1.0))
    return readings_of(log).where(F.col("query_id").isNotNull()).groupBy("query_id").agg(n.alias("n_served"), F.round(caution, 6).alias("caution"))


def trainable(log: DataFrame) -> DataFrame:
    """Readings of named queries that are not ad hoc."""
    return readings_of(log).where(F.col("query_id").isNotNull() & ~F.col("query_id").like("adhoc:%"))


def pending_rows(log: DataFrame, since) -> DataFrame:
    """Trainable rows that came after ``since`` (a timestamp; None: all)."""
    rows = trainable(log)
    return (rows if since is None else rows.where(F.col("created_at") > F.lit(since))).agg(F.count(F.lit(1)).alias("n_pending"))


def _medians(named: DataFrame) -> DataFrame:
    """(query_id, hint, n, p0): the median time of each; a hot pair is sorted over many tasks."""
    return group_percentiles(value_counts(named, ["query_id", "hint"], F.col("ms")), ["query_id", "hint"], [0.5])


def median_labels(log: DataFrame) -> DataFrame:
    """Median time and repetitions of each named query and hint; no hint is a hint of its own."""
    named = trainable(log)
    base = named.groupBy("query_id", "hint").agg(F.bool_or("is_baseline").alias("is_baseline")).withColumnsRenamed({"query_id": "_q", "hint": "_h"})
    both = _medians(named).join(base, F.col("query_id").eqNullSafe(F.col("_q")) & F.col("hint").eqNullSafe(F.col("_h")))
    return both.select("query_id", "hint", F.round("p0", 6).alias("median_ms"), F.col("n").alias("n_reps"), "is_baseline")


def log_ratio_targets(log: DataFrame) -> DataFrame:
    """ln(median time / the query's native median); 0 where there is no native time.

    Of several baseline hints of a query, the one without a hint counts, else the first by name.
    """
    labels = materialize(median_labels(log), "labels")
    native = labels.where(F.col("is_baseline")).groupBy("query_id").agg(F.min_by("median_ms", F.struct(F.col("hint").isNotNull(), "hint")).alias("native_ms"))
    target = F.when(F.col("native_ms") > 0, F.log(F.col("median_ms") / F.col("native_ms"))).otherwise(0.0)
    return labels.join(native, "query_id", "left").select("query_id", "hint", "median_ms", F.round(target, 6).alias("target"))


def noise_spread(log: DataFrame, min_reps: int = 3, warm: bool = False) -> DataFrame:
    """Spread of repeated readings, (max - min) / median, per named query and hint with enough.

    ``warm`` leaves out the first reading (by time, then id) of those with more than ``min_reps``.
    """
    named = trainable(log)
    if warm:
        keys = ["query_id", "hint"]
        named = materialize(named.select(*keys, "ms", "id", "created_at"), "named")
        first = named.groupBy(*keys).agg(F.min(F.struct("created_at", "id")).alias("f"), F.count(F.lit(1)).alias("k")).where(F.col("k") > min_reps)
        cold = materialize(first.select(F.col("query_id").alias("_q"), F.col("hint").alias("_h"), F.col("f.id").alias("_id"), F.col("f.created_at").alias("_at")), "cold")
        same = (F.col("id") == F.col("_id")) & (F.col("created_at").eqNullSafe(F.col("_at"))) & F.col("query_id").eqNullSafe(F.col("_q")) & F.col("hint").eqNullSafe(F.col("_h"))
        named = named.join(cold, same, "left_anti")
    ends = named.groupBy("query_id", "hint").agg(F.min("ms").alias("least"), F.max("ms").alias("most")).withColumnsRenamed({"query_id": "_q", "hint": "_h"})
    both = _medians(named).where(F.col("n") >= min_reps).join(ends, F.col("query_id").eqNullSafe(F.col("_q")) & F.col("hint").eqNullSafe(F.col("_h")))
    return both.select("query_id", "hint", F.col("n").alias("n_reps"), F.round((F.col("most") - F.col("least")) / F.col("p0"), 6).alias("spread"))


def noise_floor(log: DataFrame, min_reps: int = 3, warm: bool = False) -> DataFrame:
    """The median spread: differences below it are no findings. One row; nulls without groups."""
    spreads = materialize(noise_spread(log, min_reps, warm), "spreads")
    middle = group_percentiles(value_counts(spreads, [], F.col("spread")), [], [0.5]).select(F.col("n"), F.col("p0"))
    none = F.lit(None).cast("double")
    both = middle.select("n", "p0", none.alias("most")).unionAll(spreads.agg(F.lit(0).cast("long"), none, F.max("spread")))
    return both.agg(F.max("n").alias("n_groups"), F.round(F.max("p0"), 6).alias("recommended_floor"), F.max("most").alias("max_spread"))


def exact_sum(value: Column) -> Column:
    """A sum of doubles that no order of the rows changes: whole parts and parts, in steps of
    2 ** -60, are added as decimals. With values from 2 ** 52 on, or not finite, the plain sum."""
    small = F.when(F.abs(value) < 2.0**52, value)
    whole = F.when(small < 0, F.ceil(small)).otherwise(F.floor(small))
    parts = ((small - whole) * 2.0**60).cast("long")
    total = F.sum(whole.cast("decimal(20,0)")).cast("double") + F.sum(parts.cast("decimal(20,0)")).cast("double") / 2.0**60
    return F.when(F.count(value) == F.count(small), total).otherwise(F.sum(value))


def gate_sweep(scored: DataFrame, zs: Sequence[float], gains: Sequence[float]) -> DataFrame:
    """Replay of every gate setting over scored decisions.

    ``scored``: query_id, native_ms, pick_ms, mean, std (of the predicted log ratio). A setting
    deviates where exp(mean + z * std) < 1 - gain. The settings, not rows, are multiplied in.
    Medians of readings of three decimals often leave the net time half-way between two roundings,
    so its sums are exact.
    """
    settings = F.explode(F.array(*[F.struct(F.lit(float(z)).alias("z"), F.lit(float(g)).alias("gain")) for z in zs for g in gains]))
    each = scored.withColumn("s", settings)
    goes = F.exp(F.col("mean") + F.col("s.z") * F.col("std")) < 1 - F.col("s.gain")
    served = F.when(goes, F.col("pick_ms")).otherwise(F.col("native_ms"))
    lost = goes & (F.col("pick_ms") > F.col("native_ms"))
    net = exact_sum(F.col("native_ms") - served)
    return each.groupBy(F.col("s.z").alias("z"), F.col("s.gain").alias("min_gain")).agg(
        F.round(F.avg(goes.cast("double")), 6).alias("deviation_rate"),
        F.round(F.when(F.count_if(goes) > 0, F.count_if(lost) / F.count_if(goes)), 6).alias("regression_rate"),
        F.round(net, 3).alias("net_ms"),
        F.round(net / exact_sum(F.col("native_ms")) * 100, 4).alias("net_pct"),
    )
