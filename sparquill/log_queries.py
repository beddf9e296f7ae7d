"""Queries over the execution log, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.operators import log_analytics as A
from sparquill.sources.tables import table
from sparquill.streaming.log_stream import windowed

LOG = "plan_execution_log"
#: Newest runs that a dashboard's reports show.
RECENT_RUNS, RECENT_REGRET, RECENT_POINTS = 2000, 500, 1500
SINCE = "2018-06-01 00:00:00"


def _on_log(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: f(table(spark, folder, LOG))


def _on_runs(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: f(A.matched_runs(table(spark, folder, LOG)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "matched_runs": _on_runs(lambda r: r),
    "recent_runs": _on_log(lambda log: A.matched_runs(log, RECENT_RUNS)),
    "run_sequence": _on_runs(lambda r: A.with_outcome(r).select("query_key", "created_at", "native_ms", "served_ms", "outcome")),
    "summary": _on_runs(A.summary),
    "outcomes": _on_runs(A.outcomes),
    "decision_quality": _on_runs(A.decision_quality),
    "decision_quality_at_noise": _on_runs(lambda r: A.decision_quality(r, 0.29)),
    "by_query": _on_runs(A.by_query),
    "by_day": _on_runs(A.by_day),
    "cumulative_totals": _on_runs(A.cumulative_totals),
    "regret_curve": _on_log(A.regret_curve),
    "recent_regret": _on_log(lambda log: A.regret_summary(log, RECENT_REGRET)),
    "regret_summary": _on_log(A.regret_summary),
    "cost_points": _on_log(A.cost_points),
    "recent_cost_points": _on_log(lambda log: A.cost_points(log, RECENT_POINTS)),
    "cost_rank_correlation": _on_log(lambda log: A.cost_rank_correlation(A.cost_points(log))),
    "regressed_queries": _on_log(A.regressed_queries),
    "observation_counts": _on_log(A.observation_counts),
    "log_counts": _on_log(A.log_counts),
    "pending_rows": _on_log(lambda log: A.pending_rows(log, SINCE)),
    "median_labels": _on_log(A.median_labels),
    "log_ratio_targets": _on_log(A.log_ratio_targets),
    "noise_spread": _on_log(A.noise_spread),
    "noise_floor": _on_log(A.noise_floor),
    "noise_floor_warm": _on_log(lambda log: A.noise_floor(log, warm=True)),
    "hourly_readings": _on_log(windowed),
}

_READINGS = r"""
v AS (
  SELECT id, query_id, coalesce(query_id, 'adhoc:' || md5(regexp_replace(trim(sql_text, E' \t\r\n'), '\s+', ' ', 'g'))) AS query_key, sql_text, hint, total_cost,
         actual_total_time_ms AS ms, lower(trim(selector_used)) AS selector, created_at::TIMESTAMP AS created_at, coalesce(is_baseline, false) AS is_baseline, coalesce(is_chosen, false) AS is_chosen
  FROM plan_execution_log WHERE NOT isnan(actual_total_time_ms) AND actual_total_time_ms > 0 AND actual_total_time_ms <= 86400000)"""
_RUNS = f"""
WITH {_READINGS}, runs AS (
  SELECT query_key, created_at, min(sql_text) AS sql_text, min(ms) FILTER (WHERE is_baseline) AS native_ms, min(ms) FILTER (WHERE is_chosen) AS served_ms, min(ms) AS best_ms,
         count(*) AS n_plans, bool_or(is_chosen AND hint IS NOT NULL) AS deviated, min(selector) FILTER (WHERE is_chosen) AS selector
  FROM v WHERE selector <> 'collection' GROUP BY query_key, created_at
  HAVING min(ms) FILTER (WHERE is_baseline) IS NOT NULL AND min(ms) FILTER (WHERE is_chosen) IS NOT NULL)"""


def _faster(fast: str, slow: str, part: float) -> str:
    return f"({slow} - {fast} >= 2.0 AND ({slow} - {fast}) / {slow} >= {part})"


def _outcome(part: float = 0.05) -> str:
    return f"""{_RUNS}, o AS (SELECT *, CASE WHEN deviated THEN CASE WHEN {_faster("served_ms", "native_ms", part)} THEN 'win' WHEN {_faster("native_ms", "served_ms", part)} THEN 'loss' ELSE 'wash' END
      WHEN {_faster("best_ms", "native_ms", part)} THEN 'held_missed' ELSE 'held_correct' END AS outcome FROM runs)"""


_TOTALS = """count(*) AS n_runs, round(sum(native_ms), 3) AS native_ms, round(sum(served_ms), 3) AS served_ms, round(sum(best_ms), 3) AS best_ms,
  round(avg(native_ms), 8) AS avg_native_ms, round(avg(served_ms), 8) AS avg_served_ms, round((sum(native_ms) - sum(served_ms)) / sum(native_ms) * 100, 4) AS improvement_pct, round(sum(native_ms) - sum(best_ms), 3) AS headroom_ms,
  round(CASE WHEN sum(native_ms) - sum(best_ms) > 0 THEN (sum(native_ms) - sum(served_ms)) / (sum(native_ms) - sum(best_ms)) * 100 END, 4) AS captured_pct,
  count(*) FILTER (WHERE deviated) AS n_deviated, count(*) FILTER (WHERE NOT deviated) AS n_kept_native"""


def _quality(part: float) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS n_{o}" for o in A.OUTCOMES)
    return f"""{_outcome(part)} SELECT {counts}, round(coalesce(sum(native_ms - served_ms) FILTER (WHERE outcome = 'win'), 0.0), 3) AS saved_ms,
      round(coalesce(sum(served_ms - native_ms) FILTER (WHERE outcome = 'loss'), 0.0), 3) AS regression_ms,
      round(coalesce(sum(native_ms - best_ms) FILTER (WHERE outcome = 'held_missed'), 0.0), 3) AS missed_ms FROM o"""


_REGRET = f"""
WITH {_READINGS}, r AS (
  SELECT query_key, created_at, min(ms) AS b, min(ms) FILTER (WHERE is_chosen) AS s, min(ms) FILTER (WHERE is_baseline) AS n FROM v GROUP BY query_key, created_at
  HAVING min(ms) FILTER (WHERE is_chosen) IS NOT NULL)"""
_REGRET_SUMS = """count(*) AS n_decisions, round(sum(s - b), 3) AS regret_ms, round(sum(coalesce(n, s) - b), 3) AS native_regret_ms, round(sum(s - b) / count(*), 4) AS mean_regret_ms,
  round(CASE WHEN sum(coalesce(n, s) - b) > 0 THEN sum(s - b) / sum(coalesce(n, s) - b) END, 6) AS regret_ratio"""
_POINTS = f"""WITH {_READINGS}, p AS (SELECT id, total_cost, ms AS latency_ms, created_at,
  CASE WHEN is_baseline THEN 'native' WHEN hint IS NOT NULL THEN 'hinted' ELSE 'candidate' END AS kind FROM v WHERE total_cost > 0 AND total_cost < 1e9)"""
_NAMED = f"WITH {_READINGS}, t AS (SELECT * FROM v WHERE query_id IS NOT NULL AND query_id NOT LIKE 'adhoc:%')"
_LABELS = f"{_NAMED}, l AS (SELECT query_id, hint, round(median(ms), 6) AS median_ms, count(*) AS n_reps, bool_or(is_baseline) AS is_baseline FROM t GROUP BY query_id, hint)"
_SPREAD = f"{_NAMED}, sp AS (SELECT query_id, hint, count(*) AS n_reps, round((max(ms) - min(ms)) / median(ms), 6) AS spread FROM t GROUP BY query_id, hint HAVING count(*) >= 3)"
READINGS_SQL, RUNS_SQL, LABELS_SQL = _READINGS, _RUNS, _LABELS
_CUM = "OVER (ORDER BY created_at, query_key ROWS UNBOUNDED PRECEDING)"

ORACLES = {
    "matched_runs": f"{_RUNS} SELECT * FROM runs",
    "recent_runs": f"{_RUNS} SELECT * FROM runs ORDER BY created_at DESC, query_key DESC LIMIT {RECENT_RUNS}",
    "run_sequence": f"{_outcome()} SELECT query_key, created_at, native_ms, served_ms, outcome FROM o",
    "summary": f"{_RUNS} SELECT {_TOTALS} FROM runs",
    "outcomes": f"{_outcome()} SELECT k.outcome, count(o.outcome) AS n_runs FROM (SELECT unnest({list(A.OUTCOMES)}) AS outcome) k LEFT JOIN o ON o.outcome = k.outcome GROUP BY k.outcome",
    "decision_quality": _quality(0.05),
    "decision_quality_at_noise": _quality(0.29),
    "by_query": rf"""{_RUNS} SELECT query_key, {_TOTALS}, round(sum(served_ms) - sum(native_ms), 3) AS delta_ms, query_key LIKE 'adhoc:%' AS is_adhoc,
        regexp_replace(trim(arg_max(sql_text, created_at)), '\s+', ' ', 'g') AS sql_line FROM runs GROUP BY query_key""",
    "by_day": f"{_RUNS} SELECT created_at::DATE AS day, count(*) AS n_runs, round(sum(native_ms), 3) AS native_ms, round(sum(served_ms), 3) AS served_ms, round(sum(best_ms), 3) AS best_ms, count(*) FILTER (WHERE deviated) AS n_deviated FROM runs GROUP BY 1",
    "cumulative_totals": f"""{_RUNS} SELECT created_at, query_key, round(sum(native_ms) {_CUM}, 3) AS cum_native_ms, round(sum(served_ms) {_CUM}, 3) AS cum_served_ms, round(sum(best_ms) {_CUM}, 3) AS cum_best_ms,
        round(sum(native_ms) {_CUM} - sum(served_ms) {_CUM}, 3) AS cum_saved_ms, round(sum(served_ms) {_CUM} - sum(best_ms) {_CUM}, 3) AS cum_regret_ms FROM runs""",
    "regret_curve": f"""{_REGRET} SELECT query_key, created_at, round(s - b, 3) AS regret_ms, round(sum(s - b) {_CUM}, 3) AS cumulative_regret_ms,
        round(sum(coalesce(n, s) - b) {_CUM}, 3) AS native_cumulative_regret_ms FROM r""",
    "recent_regret": f"{_REGRET} SELECT {_REGRET_SUMS} FROM (SELECT * FROM r ORDER BY created_at DESC, query_key DESC LIMIT {RECENT_REGRET})",
    "regret_summary": f"{_REGRET} SELECT {_REGRET_SUMS} FROM r",
    "cost_points": f"{_POINTS} SELECT id, total_cost, latency_ms, kind FROM p",
    "recent_cost_points": f"{_POINTS} SELECT id, total_cost, latency_ms, kind FROM p ORDER BY created_at DESC, id DESC LIMIT {RECENT_POINTS}",
    "cost_rank_correlation": f"""{_POINTS}, k AS (SELECT rank() OVER (ORDER BY total_cost) + (count(*) OVER (PARTITION BY total_cost) - 1) / 2.0 AS rx,
        rank() OVER (ORDER BY latency_ms) + (count(*) OVER (PARTITION BY latency_ms) - 1) / 2.0 AS ry FROM p) SELECT count(*) AS n_points, round(corr(rx, ry), 6) AS rank_correlation FROM k""",
    "regressed_queries": f"""WITH {_READINGS}, g AS (SELECT query_id, avg(ms) FILTER (WHERE is_baseline) AS n, avg(ms) FILTER (WHERE is_chosen AND hint IS NOT NULL) AS c,
        count(*) FILTER (WHERE is_chosen AND hint IS NOT NULL) AS k FROM v WHERE query_id IS NOT NULL GROUP BY query_id)
        SELECT query_id, round(n, 4) AS native_avg_ms, round(c, 4) AS chosen_avg_ms, round(c / n, 6) AS regression_ratio, k AS n_observations FROM g WHERE k >= 3 AND c > n * 1.1""",
    "observation_counts": f"""WITH {_READINGS} SELECT query_id, count(*) FILTER (WHERE is_chosen) AS n_served,
        round(2.0 - least(count(*) FILTER (WHERE is_chosen) / 3.0, 1.0), 6)::DOUBLE AS caution FROM v WHERE query_id IS NOT NULL GROUP BY query_id""",
    "log_counts": rf"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE lower(trim(selector_used)) = 'collection') AS n_collection,
        count(DISTINCT coalesce(query_id, 'adhoc:' || md5(regexp_replace(trim(sql_text, E' \t\r\n'), '\s+', ' ', 'g')))) AS n_queries FROM plan_execution_log""",
    "pending_rows": f"{_NAMED} SELECT count(*) AS n_pending FROM t WHERE created_at > TIMESTAMP '{SINCE}'",
    "median_labels": f"{_LABELS} SELECT * FROM l",
    "log_ratio_targets": f"""{_LABELS}, n AS (SELECT query_id, arg_min(median_ms, (hint IS NOT NULL)::INT || coalesce(hint, '')) AS native_ms FROM l WHERE is_baseline GROUP BY query_id)
        SELECT l.query_id, l.hint, l.median_ms, round(CASE WHEN n.native_ms > 0 THEN ln(l.median_ms / n.native_ms) ELSE 0.0 END, 6) AS target FROM l LEFT JOIN n ON l.query_id = n.query_id""",
    "noise_spread": f"{_SPREAD} SELECT * FROM sp",
    "noise_floor": f"{_SPREAD} SELECT count(*) AS n_groups, round(median(spread), 6) AS recommended_floor, max(spread) AS max_spread FROM sp",
    "noise_floor_warm": f"""{_NAMED}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, hint ORDER BY created_at, id) AS nth, count(*) OVER (PARTITION BY query_id, hint) AS c FROM t),
        sp AS (SELECT round((max(ms) - min(ms)) / median(ms), 6) AS spread FROM k WHERE NOT (nth = 1 AND c > 3) GROUP BY query_id, hint HAVING count(*) >= 3)
        SELECT count(*) AS n_groups, round(median(spread), 6) AS recommended_floor, max(spread) AS max_spread FROM sp""",
    "hourly_readings": f"""WITH {_READINGS} SELECT date_trunc('hour', created_at) AS window_start, selector, count(*) AS n, round(avg(ms), 6) AS mean_ms, min(ms) AS min_ms, max(ms) AS max_ms FROM v GROUP BY 1, 2""",
}
