"""Queries over what a log teaches: labels, hint models, gates, promotion; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.log_queries import LABELS_SQL, LOG, READINGS_SQL, RUNS_SQL
from sparquill.operators import hint_models as H
from sparquill.operators import log_analytics as A
from sparquill.plans import actions, catalog, spj
from sparquill.plans.workload import join_queries
from sparquill.sources.tables import table

ZS, GAINS = (0.0, 0.5, 1.0, 2.0), (0.0, 0.05, 0.2)
TPCH = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
KEYED = (*TPCH, "products", "suppliers", "product_suppliers")
#: Columns that tables are laid out by, of the layouts that the check of keys is run against.
LAYOUTS = (("lineitem", ["l_orderkey", "l_linenumber"]), ("orders", ["o_orderkey"]), ("product_suppliers", ["product_id"]))


def _on_labels(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: f(H.labels(table(spark, folder, LOG)))


def _on_model(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        labelled = H.labels(table(spark, folder, LOG))
        return f(labelled, H.fit(labelled))

    return run


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _promotion(labelled: DataFrame, model: DataFrame) -> DataFrame:
    """Is the model's mean served time, over the last quarter of the query ids, better than the
    native plans' by more than 2 %?"""
    challenger = H.challenger_score(labelled, model)
    champion = H.challenger_score(labelled.where(F.col("hint").isNull()), model)
    both = challenger.select(F.col("avg_ms").alias("challenger_ms"), F.lit(None).cast("double").alias("champion_ms")).unionAll(champion.select(F.lit(None).cast("double"), "avg_ms"))
    out = both.agg(F.max("champion_ms").alias("champion_ms"), F.max("challenger_ms").alias("challenger_ms"))
    gain = (F.col("champion_ms") - F.col("challenger_ms")) / F.col("champion_ms")
    return out.select("champion_ms", "challenger_ms", F.coalesce(gain > 0.02, F.lit(False)).alias("promote"))


def _sign(spark: SparkSession, folder: str) -> DataFrame:
    runs = A.matched_runs(table(spark, folder, LOG)).where("deviated")
    return H.sign_test(runs.select((F.col("native_ms") - F.col("served_ms")).alias("gain")), "gain")


def _interval(spark: SparkSession, folder: str) -> DataFrame:
    runs = A.matched_runs(table(spark, folder, LOG)).where("deviated")
    key = F.concat_ws("#", "query_key", F.unix_micros(F.col("created_at").cast("timestamp")).cast("string"))
    return H.bootstrap_interval(runs.withColumn("gain", F.col("native_ms") - F.col("served_ms")), key, "gain")


def _subsets(spark: SparkSession, folder: str) -> DataFrame:
    """Every set of three tables that edges connect."""
    columns = {t: {f.name: f.dataType for f in table(spark, folder, t).schema} for t in KEYED}
    graph = catalog.SchemaGraph(columns, {}, catalog.infer_keys(columns))
    return spark.createDataFrame([(", ".join(sorted(s)),) for s in graph.connected_subsets(3, limit=10_000)], "tables string")


def _shares(spark: SparkSession, folder: str) -> DataFrame:
    """The largest tables and their share of all rows, as a schema's summary gives them."""
    rows = {t: table(spark, folder, t).count() for t in KEYED}
    largest = catalog.SchemaGraph({t: {} for t in KEYED}, rows).summary()["largest"]
    return spark.createDataFrame([(r["table"], r["rows"], round(r["share"], 8)) for r in largest], "table_name string, n_rows long, share double")


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    columns = {t: {f.name: f.dataType for f in table(spark, folder, t).schema} for t in KEYED}
    return catalog.SchemaGraph(columns, {}, catalog.infer_keys(columns)).edges(spark)


def _unclustered(spark: SparkSession, folder: str) -> DataFrame:
    layouts = spark.createDataFrame(list(LAYOUTS), "src_table string, columns array<string>")
    return catalog.without_layout(_edges(spark, folder), layouts).select("src_table", "src_column", "tgt_table")


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    """Every connected join order of the six-way query."""
    database = catalog.register_folder(spark, folder, TPCH, analyze=False)
    query = spj.parse(spark, join_queries(database)["spj_6way_trap"])
    return spark.createDataFrame([(" ".join(o),) for o in actions.grown_orders(query.aliases, query.join_graph())], "join_order string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "hint_labels": _on_labels(lambda t: _rounded(t, "target")),
    "hint_model": _on_model(lambda t, m: _rounded(m, "mean", "std")),
    "hint_scores": _on_model(lambda t, m: _rounded(H.scored(t, m).select("query_id", "hint", "mean", "std"), "mean", "std")),
    "gate_decisions": _on_model(lambda t, m: _rounded(H.decisions(H.scored(t, m)), "mean", "std")),
    "risk_averse_decisions": _on_model(lambda t, m: _rounded(H.decisions(H.scored(t, m), 0.0, 0.0, 1.0), "mean", "std")),
    "policy_report": _on_model(H.policy_report),
    "model_errors": _on_model(H.model_errors),
    "calibration_sweep": _on_model(lambda t, m: H.sweep(t, m, ZS, GAINS)),
    "challenger_score": _on_model(H.challenger_score),
    "promotion_gate": _on_model(_promotion),
    "pairwise_pairs": _on_labels(H.pairwise_pairs),
    "sign_test": _sign,
    "bootstrap_ci": _interval,
    "connected_subsets": _subsets,
    "table_shares": _shares,
    "missed_plans": lambda spark, folder: A.missed_plans(table(spark, folder, LOG)),
    "plan_roles": lambda spark, folder: A.plan_roles(table(spark, folder, LOG)),
    "fk_inference": _edges,
    "unclustered_fk_anti_join": _unclustered,
    "connected_orders": _orders,
}


def _draw(salt: str) -> str:
    return f"('0x' || substr(md5(query_id || '|' || {salt}), 1, 4))::INT"


_H = f"""{LABELS_SQL}, nat AS (SELECT query_id, arg_min(median_ms, (hint IS NOT NULL)::INT || coalesce(hint, '')) AS native_ms FROM l WHERE is_baseline GROUP BY query_id),
  cost AS (SELECT query_id, hint, min(total_cost) AS least_cost FROM t GROUP BY query_id, hint),
  h AS (SELECT l.query_id, l.hint, l.median_ms, c.least_cost, n.native_ms, ln(l.median_ms / n.native_ms) AS target, {_draw("'split'").replace("query_id", "l.query_id")} % {H.HELD_OUT} = 0 AS held_out
    FROM l JOIN nat n ON l.query_id = n.query_id JOIN cost c ON c.query_id = l.query_id AND c.hint IS NOT DISTINCT FROM l.hint WHERE n.native_ms > 0)"""
_M = f"""{_H}, mm AS (SELECT hint, member, avg(target) AS m FROM h, (SELECT unnest(range({H.MEMBERS})) AS member) WHERE NOT held_out AND hint IS NOT NULL AND {_draw("member")} % {H.PARTS} < {H.SEEN} GROUP BY 1, 2),
  model AS (SELECT hint, avg(m) AS mean, stddev_pop(m) AS std, count(*) AS n_members FROM mm GROUP BY hint),
  sc AS (SELECT h.*, mean, std FROM h JOIN model USING (hint) WHERE held_out)"""


def _decided(z: float, gain: float, risk: float) -> str:
    by = f"(mean + {risk} * std, hint)"
    return f"""{_M}, pk AS (SELECT query_id, any_value(native_ms) AS native_ms, arg_min(hint, {by}) AS pick, arg_min(median_ms, {by}) AS pick_ms, arg_min(mean, {by}) AS mean, arg_min(std, {by}) AS std,
        arg_min(coalesce(least_cost, 0), {by}) AS cost FROM sc GROUP BY query_id),
      d AS (SELECT query_id, native_ms, pick, pick_ms, mean, std, CASE WHEN NOT exp(mean + {z} * std) < 1 - {gain} THEN 'no_confident_gain_over_native'
        WHEN cost >= 1e9 THEN 'predicted_regression_vs_native' ELSE 'confident_gain' END AS reason FROM pk)"""


_DECISION = "SELECT query_id, native_ms, pick, pick_ms, round(mean, 6) AS mean, round(std, 6) AS std, reason, CASE WHEN reason = 'confident_gain' THEN pick_ms ELSE native_ms END AS served_ms FROM d"
_EDGES = f"""WITH c AS (SELECT table_name AS t, column_name AS c, column_index AS i, min(column_index) OVER (PARTITION BY table_name) AS first, data_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') AS whole
    FROM duckdb_columns() WHERE table_name IN {KEYED}),
  heads AS (SELECT *, substr(c, instr(c, '_') + 1) AS name FROM c WHERE i = first AND instr(c, '_') > 0 AND c LIKE '%key' AND starts_with(t, replace(substr(c, instr(c, '_') + 1), 'key', ''))),
  edges AS (
    SELECT a.t AS src_table, a.c AS src_column, h.t AS tgt_table, h.c AS tgt_column, true AS inferred FROM c a JOIN heads h ON a.whole AND h.whole AND instr(a.c, '_') > 0 AND substr(a.c, instr(a.c, '_') + 1) = h.name
    WHERE a.t <> h.t AND (SELECT count(*) FROM heads k WHERE k.name = h.name) = 1
    UNION ALL SELECT a.t, a.c, b.t, 'id', true FROM c a JOIN c b ON a.whole AND b.whole AND b.c = 'id' AND a.c LIKE '%!_id' ESCAPE '!' AND b.t IN (a.c[:-4], a.c[:-4] || 's', a.c[:-4] || 'es') WHERE a.t <> b.t)"""

ORACLES = {
    "hint_labels": f"{_H} SELECT query_id, hint, median_ms, least_cost, native_ms, round(target, 6) AS target, held_out FROM h",
    "hint_model": f"{_M} SELECT hint, round(mean, 6) AS mean, round(std, 6) AS std, n_members FROM model",
    "hint_scores": f"{_M} SELECT query_id, hint, round(mean, 6) AS mean, round(std, 6) AS std FROM sc",
    "gate_decisions": f"{_decided(1.0, 0.05, 0.0)} {_DECISION}",
    "risk_averse_decisions": f"{_decided(0.0, 0.0, 1.0)} {_DECISION}",
    "policy_report": f"""{_M}, ev AS (SELECT query_id, hint, median_ms, native_ms, mean, std, coalesce(least_cost, 'inf'::DOUBLE) AS cost FROM sc
        UNION ALL SELECT s.query_id, NULL, s.native_ms, s.native_ms, 0, 0, coalesce(h.least_cost, 'inf'::DOUBLE) FROM (SELECT DISTINCT query_id, native_ms FROM sc) s LEFT JOIN h ON h.query_id = s.query_id AND h.hint IS NULL),
      sv AS (SELECT query_id, any_value(native_ms) AS nat, min(median_ms) AS ora, arg_min(median_ms, (cost, hint IS NOT NULL, coalesce(hint, ''))) AS heu, arg_min(median_ms, (mean, hint IS NOT NULL, coalesce(hint, ''))) AS gre,
        arg_min(median_ms, (mean + std, hint IS NOT NULL, coalesce(hint, ''))) AS ris FROM ev GROUP BY query_id),
      ps AS (SELECT nat, ora, heu, unnest([{{'p': 'native', 'ms': nat}}, {{'p': 'heuristic', 'ms': heu}}, {{'p': 'oracle', 'ms': ora}}, {{'p': 'greedy', 'ms': gre}}, {{'p': 'risk_averse', 'ms': ris}}]) AS x FROM sv)
      SELECT x.p AS policy, count(*) AS n_queries, round(avg(x.ms), 8) AS avg_ms, round(CASE WHEN sum(nat) - sum(ora) > 0 THEN (sum(nat) - sum(x.ms)) / (sum(nat) - sum(ora)) * 100 END, 4) AS captured_pct,
        round(avg((x.ms <= heu)::INT), 6) AS ties_heuristic FROM ps GROUP BY 1""",
    "model_errors": f"{_M} SELECT count(*) AS n_rows, round(avg(abs(target - mean)), 6) AS mae, round(exp(avg(abs(target - mean))), 6) AS typical_factor, round(avg(std), 6) AS mean_std FROM sc",
    "calibration_sweep": f"""{_decided(1.0, 0.05, 0.0)}, s AS (SELECT native_ms, pick_ms AS pick, exp(mean + z * std) < 1 - gain AS goes, z, gain
        FROM d, (SELECT unnest({list(ZS)})::DOUBLE AS z), (SELECT unnest({list(GAINS)})::DOUBLE AS gain))
        SELECT z, gain AS min_gain, round(avg(goes::INT), 6) AS deviation_rate,
          round(CASE WHEN count(*) FILTER (WHERE goes) > 0 THEN count(*) FILTER (WHERE goes AND pick > native_ms) / count(*) FILTER (WHERE goes) END, 6) AS regression_rate,
          round(sum(native_ms - CASE WHEN goes THEN pick ELSE native_ms END), 3) AS net_ms, round(sum(native_ms - CASE WHEN goes THEN pick ELSE native_ms END) / sum(native_ms) * 100, 4) AS net_pct
        FROM s GROUP BY z, gain""",
    "pairwise_pairs": f"""{_H}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hint IS NOT NULL, hint) AS i FROM h),
      p AS (SELECT a.query_id, a.hint AS ha, b.hint AS hb, a.median_ms AS ma, b.median_ms AS mb, a.target AS ta, b.target AS tb, row_number() OVER (PARTITION BY a.query_id ORDER BY a.i, b.i) - 1 AS k,
        count(*) OVER (PARTITION BY a.query_id) AS n FROM s a JOIN s b ON a.query_id = b.query_id AND a.i < b.i),
      q AS (SELECT * FROM p WHERE k % (CASE WHEN n > {H.MOST_PAIRS} THEN n // {H.MOST_PAIRS} + 1 ELSE 1 END) = 0 AND ma <> mb)
      SELECT query_id, ha AS hint_a, hb AS hint_b, round(ta - tb, 6) AS target_diff, ma < mb AS a_is_faster FROM q UNION ALL SELECT query_id, hb, ha, round(tb - ta, 6), mb < ma FROM q""",
    "sign_test": f"""{RUNS_SQL}, c AS (SELECT count(*) FILTER (WHERE native_ms > served_ms) AS a, count(*) FILTER (WHERE native_ms < served_ms) AS b FROM runs WHERE deviated),
      f AS (SELECT a, b, a + b AS n, unnest(range(0, least(a, b) + 1)) AS k FROM c)
      SELECT a AS n_positive, b AS n_negative, round(least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)))), 6) AS p_value FROM f GROUP BY a, b""",
    "bootstrap_ci": f"""{RUNS_SQL}, d AS (SELECT query_key || '#' || epoch_us(created_at) AS query_id, native_ms - served_ms AS v FROM runs WHERE deviated),
      u AS (SELECT b, v, {_draw("b")} / 65536.0 AS u FROM d, (SELECT unnest(range(200)) AS b)),
      w AS (SELECT b, v, {" + ".join(f"(u >= {t})::INT" for t in H._TAKEN)} AS w FROM u), m AS (SELECT list_sort(list(m)) AS ms FROM (SELECT sum(w * v) / sum(w) AS m FROM w GROUP BY b))
      SELECT (SELECT count(*) FROM d) AS n, (SELECT round(avg(v), 6) FROM d) AS mean, round(ms[floor(len(ms) * 0.025)::INT + 1], 6) AS low, round(ms[floor(len(ms) * 0.975)::INT + 1], 6) AS high FROM m""",
    "connected_subsets": f"""{_EDGES.replace("WITH c AS", "WITH RECURSIVE c AS")}, g AS (SELECT src_table AS a, tgt_table AS b FROM edges UNION SELECT tgt_table, src_table FROM edges),
      w AS (SELECT DISTINCT [a] AS s FROM g UNION SELECT DISTINCT list_sort(list_append(w.s, g.b)) FROM w JOIN g ON list_contains(w.s, g.a) AND NOT list_contains(w.s, g.b) WHERE len(w.s) < 3)
      SELECT array_to_string(s, ', ') AS tables FROM w WHERE len(s) = 3""",
    "table_shares": "WITH n AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in KEYED) + ") SELECT table_name, n_rows, round(n_rows / (SELECT sum(n_rows) FROM n), 8) AS share FROM n ORDER BY n_rows DESC LIMIT 10",
    "missed_plans": f"""WITH {READINGS_SQL}, g AS (SELECT query_key, created_at, min(ms) FILTER (WHERE is_baseline) AS native_ms, min(ms) FILTER (WHERE NOT is_baseline) AS missed_ms,
        arg_min(hint, (ms, id)) FILTER (WHERE NOT is_baseline) AS missed_hint, bool_or(is_chosen AND NOT is_baseline) AS left_native FROM v GROUP BY query_key, created_at)
      SELECT query_key, created_at, native_ms, missed_hint, missed_ms FROM g WHERE NOT left_native AND missed_ms < native_ms""",
    "plan_roles": f"""WITH {READINGS_SQL}, g AS (SELECT query_key, created_at, min(ms) FILTER (WHERE is_baseline) AS native_ms, bool_or(is_chosen AND NOT is_baseline) AS left_native,
        arg_min(id, (ms, id)) FILTER (WHERE NOT is_baseline) AS fastest, min(ms) FILTER (WHERE NOT is_baseline) AS fastest_ms FROM v GROUP BY query_key, created_at)
      SELECT v.id, CASE WHEN is_chosen THEN 'served' WHEN is_baseline THEN 'native' WHEN total_cost >= 1e9 THEN 'vetoed' WHEN v.id = fastest AND NOT left_native AND fastest_ms < native_ms THEN 'missed' ELSE 'candidate' END AS role
      FROM v JOIN g ON v.query_key = g.query_key AND v.created_at = g.created_at""",
    "fk_inference": f"{_EDGES} SELECT * FROM edges",
    "unclustered_fk_anti_join": f"""{_EDGES}, lay AS (SELECT * FROM (VALUES {", ".join(f"('{t}', {c})" for t, c in LAYOUTS)}) AS x(t, cols))
      SELECT src_table, src_column, tgt_table FROM edges e WHERE NOT EXISTS (SELECT 1 FROM lay WHERE lay.t = e.src_table AND lay.cols[1] = e.src_column)""",
    "connected_orders": """WITH RECURSIVE g AS (SELECT * FROM (VALUES ('l', 'o'), ('o', 'c'), ('l', 'p'), ('c', 'n'), ('n', 'r')) AS x(a, b)), e AS (SELECT a, b FROM g UNION ALL SELECT b, a FROM g),
      w AS (SELECT [a] AS o FROM (SELECT DISTINCT a FROM e) UNION ALL SELECT DISTINCT list_append(w.o, e.b) FROM w JOIN e ON list_contains(w.o, e.a) AND NOT list_contains(w.o, e.b))
      SELECT array_to_string(o, ' ') AS join_order FROM w WHERE len(o) = 6""",
}
ORACLES |= {
    "challenger_score": f"""{_M}, ids AS (SELECT query_id, row_number() OVER (ORDER BY query_id) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT query_id FROM h)),
      x AS (SELECT h.query_id, h.hint, h.median_ms, CASE WHEN h.hint IS NULL THEN 0 ELSE mean + std END AS score FROM h JOIN ids ON h.query_id = ids.query_id AND place > n - greatest(1, round_even(n * 0.25, 0)) LEFT JOIN model ON h.hint = model.hint
        WHERE h.hint IS NULL OR mean IS NOT NULL),
      y AS (SELECT query_id, arg_min(median_ms, (score, hint IS NOT NULL, coalesce(hint, ''))) AS ms FROM x GROUP BY query_id) SELECT count(*) AS n_queries, round(avg(ms), 8) AS avg_ms FROM y""",
    "promotion_gate": f"""{_M}, ids AS (SELECT query_id, row_number() OVER (ORDER BY query_id) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT query_id FROM h)),
      nid AS (SELECT query_id, row_number() OVER (ORDER BY query_id) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT query_id FROM h WHERE hint IS NULL)),
      x AS (SELECT h.query_id, h.hint, h.median_ms, CASE WHEN h.hint IS NULL THEN 0 ELSE mean + std END AS score FROM h JOIN ids ON h.query_id = ids.query_id AND place > n - greatest(1, round_even(n * 0.25, 0)) LEFT JOIN model ON h.hint = model.hint
        WHERE h.hint IS NULL OR mean IS NOT NULL),
      y AS (SELECT query_id, arg_min(median_ms, (score, hint IS NOT NULL, coalesce(hint, ''))) AS ms FROM x GROUP BY query_id),
      z AS (SELECT round(avg(h.median_ms), 8) AS a FROM h JOIN nid ON h.query_id = nid.query_id AND place > n - greatest(1, round_even(n * 0.25, 0)) WHERE hint IS NULL),
      r AS (SELECT (SELECT a FROM z) AS champion_ms, (SELECT round(avg(ms), 8) FROM y) AS challenger_ms)
      SELECT champion_ms, challenger_ms, coalesce((champion_ms - challenger_ms) / champion_ms > 0.02, false) AS promote FROM r""",
}
