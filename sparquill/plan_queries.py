"""Queries over logged plans and over catalog tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.operators.quantiles import group_percentiles, value_counts
from sparquill.plans import actions, catalog, extract, features, spj
from sparquill.plans.engine import Engine
from sparquill.plans.log import ExecutionLog, logged_nodes
from sparquill.plans.workload import join_queries
from sparquill.sources.tables import table
from sparquill.storage import application_folder

TPCH = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
STAR_AND_SHOP = (*TPCH, "products", "suppliers", "product_suppliers")
def _on_nodes(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: f(logged_nodes(table(spark, folder, "plan_execution_log")))


def _plan_features(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "plan_execution_log")
    return features.plan_features(logged_nodes(log), log)


#: Tables of the logged plans that the data folder holds.
SHOP = ("product_suppliers", "products", "suppliers")


def _table_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = {t: float(table(spark, folder, t).count()) for t in SHOP}
    return features.table_features(logged_nodes(table(spark, folder, "plan_execution_log")), rows)


def _spj(name: str, action: Callable[[spj.SpjQuery], actions.Action] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """A join query over catalog tables, as written or under an action."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        database = catalog.register_folder(spark, folder, STAR_AND_SHOP, analyze=False)
        sql = join_queries(database)[name]
        if action is None:
            return spark.sql(sql)
        query = spj.parse(spark, sql)
        chosen = action(query)
        return extract.plan_sql(spark, chosen.sql(query), chosen.label, chosen.confs).frame

    return run


def _last_order(query: spj.SpjQuery) -> actions.Action:
    order = actions.join_orders(query.aliases, query.join_graph())[-1]
    return actions.Action("last order", order=order)


def _shuffles(plan: extract.Plan) -> bool:
    """Do all joins of a plan shuffle their inputs?"""
    return {n.kind for n in plan.nodes if n.join_type} <= {"SortMergeJoin", "ShuffledHashJoin"}


LEARNED = ("spj_3way", "spj_4way_trap", "spj_5way")


def _derived_log(engine: Engine, statements: dict[str, str]) -> None:
    """Log every plan of some statements with a time that its joins alone decide: plans that neither
    broadcast nor multiply take a fifth of the native plan's time, others half as much again."""
    entries = []
    for name, sql in statements.items():
        for label, plan in engine.plans_of(sql).items():
            plan.actual_ms = 100.0 if label is None else 20.0 if _shuffles(plan) else 150.0
            entries.append({"query_id": name, "sql_text": sql, "plan": plan, "is_baseline": label is None, "is_chosen": False, "selector_used": "collection"})
    engine.log.append(entries)


def _learned(spark: SparkSession, folder: str) -> DataFrame:
    """What an engine trained on a derived log serves, and why; the served plans are run once."""
    database = catalog.register_folder(spark, folder, STAR_AND_SHOP, analyze=False)
    engine = Engine(spark, database, ExecutionLog(spark, f"{application_folder(spark)}/derived-{uuid.uuid4().hex}"), strategies=False)
    statements = {n: join_queries(database)[n] for n in LEARNED}
    _derived_log(engine, statements)
    engine.train(rank=False)
    out = []
    for name, sql in statements.items():
        decision, _, _ = engine.plan_query(sql, name)
        out.append((name, _shuffles(decision.plan), decision.reason, decision.deviated, extract.run_plan(decision.plan).n_rows))
    return spark.createDataFrame(out, "query string, shuffles boolean, reason string, deviated boolean, n_rows long")


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.orphan_rows(spark, folder, catalog.ForeignKey("product_suppliers", "supplier_id", "suppliers", "id"))


def _percentiles(spark: SparkSession, folder: str) -> DataFrame:
    counts = value_counts(table(spark, folder, "part"), [], F.col("p_retailprice"))
    return group_percentiles(counts, [], [0.25, 0.75], discrete=True).select(F.col("p0").alias("p25"), F.col("p1").alias("p75"))


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").limit(5)


def _bounds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").agg(F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"))


_NAMES = tuple(join_queries(""))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{n: _spj(n) for n in _NAMES},
    "order_rewrite": _spj("spj_4way_trap", _last_order),
    "strategy_merge": _spj("spj_4way_trap", lambda q: actions.Action("m", strategy="MERGE")),
    "strategy_shuffle_hash": _spj("spj_4way_trap", lambda q: actions.Action("h", strategy="SHUFFLE_HASH")),
    "strategy_broadcast": _spj("spj_4way_trap", lambda q: actions.Action("b", strategy="BROADCAST", targets=("c", "n", "r"))),
    "strategy_cartesian": _spj("spj_3way", lambda q: actions.Action("c", strategy="SHUFFLE_REPLICATE_NL", blocks=True)),
    "learned_pick": _learned,
    "plan_tree_features": _plan_features,
    "plan_table_features": _table_features,
    "scan_qerrors": _on_nodes(features.scan_qerrors),
    "join_qerrors": _on_nodes(features.join_qerrors),
    "advisor_rows": _on_nodes(features.advice),
    # the test log's filters have one column each, so the usual limits find nothing there
    "advisor_rows_strict": _on_nodes(lambda nodes: features.advice(nodes, q_limit=3.0, least_rows=1000, discarded=0.3, least_columns=1)),
    "orphan_rows": _orphans,
    "numeric_percentiles": _percentiles,
    "text_samples": _samples,
    "temporal_bounds": _bounds,
}

_NODES = """
WITH t AS (SELECT id, CASE WHEN json_valid(raw_plan) THEN raw_plan::JSON END AS j FROM plan_execution_log),
u AS (SELECT id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN (j ->> '$')::JSON END ELSE j END AS j FROM t),
w AS (SELECT u.id, e.id AS nid, e.fullkey AS path, e.value AS v FROM u, json_tree(u.j) e WHERE e.type = 'OBJECT' AND json_exists(e.value, '$."Node Type"')),
m AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY nid) - 1)::INT AS node_no FROM w),
n AS (SELECT a.id AS exec_id, a.node_no AS node_id, coalesce(max(b.node_no), -1)::INT AS parent_id, count(b.node_no)::INT AS depth, any_value(a.v) AS v, any_value(a.path) AS path
  FROM m a LEFT JOIN m b ON a.id = b.id AND b.nid < a.nid AND starts_with(a.path, b.path || '.') GROUP BY a.id, a.node_no),
nodes AS (SELECT exec_id, node_id, parent_id, depth, path, v ->> '$."Node Type"' AS node_type, v ->> '$."Relation Name"' AS relation, v ->> '$."Join Type"' AS join_type,
  coalesce(v ->> '$."Filter"', '') AS filter, coalesce(v ->> '$."Recheck Cond"', '') AS recheck, (v ->> '$."Plan Width"')::DOUBLE AS width,
  (v ->> '$."Plan Rows"')::DOUBLE AS est_rows, (v ->> '$."Plan Rows"')::DOUBLE * (v ->> '$."Plan Width"')::DOUBLE AS est_bytes, (v ->> '$."Total Cost"')::DOUBLE AS est_cost,
  (v ->> '$."Startup Cost"')::DOUBLE AS startup_cost, (v ->> '$."Actual Rows"')::DOUBLE AS actual_rows, (v ->> '$."Rows Removed by Filter"')::DOUBLE AS rows_removed FROM n)
"""
NODES_SQL = _NODES
_IN = {f: "(" + ", ".join(f"'{k}'" for k in kinds) + ")" for f, kinds in features.FAMILIES.items()}
_KIDS = ", kids AS (SELECT exec_id, parent_id AS node_id, count(*) AS n_kids, sum(coalesce(est_rows, 0)) AS kid_rows, min(coalesce(est_rows, 0)) AS least, max(coalesce(est_rows, 0)) AS most, arg_min(coalesce(est_rows, 0), node_id) AS l, arg_max(coalesce(est_rows, 0), node_id) AS r FROM nodes WHERE parent_id >= 0 GROUP BY 1, 2)"

def _advice_sql(q_limit: float, least_rows: int, discarded: float, least_columns: int) -> str:
    return f"""{_NODES}, s AS (SELECT relation, node_type,
        list_filter(list_distinct(regexp_extract_all(filter, '{features.FILTER_COLUMN}', 1)), lambda c: NOT list_contains({list(features.NO_COLUMNS)}, lower(c))) AS unordered, filter,
        greatest(greatest(coalesce(est_rows, 0), 1) / greatest(actual_rows, 1), greatest(actual_rows, 1) / greatest(coalesce(est_rows, 0), 1)) AS q,
        actual_rows + coalesce(rows_removed, 0) AS rd, CASE WHEN actual_rows + coalesce(rows_removed, 0) > 0 THEN coalesce(rows_removed, 0) / (actual_rows + coalesce(rows_removed, 0)) ELSE 0 END AS part
        FROM nodes WHERE relation IS NOT NULL AND actual_rows IS NOT NULL AND filter <> ''),
      d AS (SELECT *, array_to_string(list_sort(unordered), ', ') AS by_name,
        array_to_string(list_transform(list_sort(list_transform(unordered, lambda c: lpad(list_position(regexp_extract_all(filter, '{features.FILTER_COLUMN}', 1), c)::VARCHAR, 4, '0') || c)), lambda c: c[5:]), ', ') AS by_place FROM s)
      SELECT relation, by_name AS columns, 'statistics' AS kind, round(max(q), 4) AS worst, count(*) AS n_scans, CASE WHEN max(q) >= 20 THEN 'high' ELSE 'medium' END AS severity,
        'ANALYZE TABLE ' || relation || ' COMPUTE STATISTICS FOR COLUMNS ' || by_name AS statement FROM d WHERE len(unordered) >= {least_columns} AND q >= {q_limit} GROUP BY relation, by_name
      UNION ALL SELECT relation, by_place, 'layout', round(max(part), 4), count(*), CASE WHEN max(part) > 0.99 THEN 'high' ELSE 'medium' END, 'ALTER TABLE ' || relation || ' CLUSTER BY (' || by_place || ')' FROM d
      WHERE node_type IN {_IN["seq_scan"]} AND len(unordered) > 0 AND rd >= {least_rows} AND part >= {discarded} GROUP BY relation, by_place"""


ORACLES = {
    **{n: sql for n, sql in join_queries("").items()},
    **{n: join_queries("")["spj_4way_trap"] for n in ("order_rewrite", "strategy_merge", "strategy_shuffle_hash", "strategy_broadcast")},
    "learned_pick": " UNION ALL ".join(f"SELECT '{n}' AS query, true AS shuffles, 'confident_gain' AS reason, true AS deviated, count(*) AS n_rows FROM ({join_queries('')[n]})" for n in LEARNED),
    "strategy_cartesian": join_queries("")["spj_3way"],
    "plan_tree_features": f"""{_NODES}{_KIDS}, e AS (SELECT n.*, k.n_kids, k.kid_rows, k.least, k.most FROM nodes n LEFT JOIN kids k ON n.exec_id = k.exec_id AND n.node_id = k.node_id)
      SELECT exec_id, max(depth)::DOUBLE AS tree_depth, count(*) FILTER (WHERE n_kids IS NULL)::DOUBLE AS tree_leaves,
        round(coalesce(avg((least + 1) / (most + 1)) FILTER (WHERE n_kids = 2), 0), 6) AS tree_bushiness, round(ln(1 + max(coalesce(est_rows, 0))), 6) AS log_max_est_rows,
        round(ln(1 + sum(coalesce(est_rows, 0))), 6) AS log_sum_est_rows, round(ln(1 + max(coalesce(est_bytes, 0))), 6) AS log_max_intermediate_bytes,
        round(least(coalesce(max((coalesce(est_rows, 0) + 1) / (kid_rows + 1)), 0), 1e6), 6) AS max_child_rows_amplification,
        round(ln(1 + arg_min(coalesce(est_cost, 0), node_id)), 6) AS log_total_cost,
        round(CASE WHEN arg_min(coalesce(est_cost, 0), node_id) > 0 THEN arg_min(coalesce(startup_cost, 0), node_id) / arg_min(coalesce(est_cost, 0), node_id) ELSE 0 END, 6) AS startup_cost_fraction,
        coalesce(max(depth) FILTER (WHERE join_type IS NOT NULL), 0)::DOUBLE AS deepest_join_depth,
        count(*) FILTER (WHERE join_type IS NOT NULL AND contains(node_type, 'Hash')) AS n_hash_join, count(*) FILTER (WHERE join_type IS NOT NULL AND contains(node_type, 'Merge')) AS n_merge_join,
        count(*) FILTER (WHERE join_type IS NOT NULL AND contains(node_type, 'Nested Loop')) AS n_nestloop_join, count(*) FILTER (WHERE parent_id < 0) AS n_roots,
        {", ".join(f"count(*) FILTER (WHERE node_type IN {k})::DOUBLE AS n_{f}" for f, k in _IN.items())},
        count(relation) AS num_tables, greatest(count(relation) - 1, 0) AS num_joins, any_value(CASE WHEN length(l.hint) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS has_hint
      FROM e JOIN plan_execution_log l ON e.exec_id = l.id GROUP BY exec_id""",
    "plan_table_features": f"""{_NODES}, s AS (SELECT exec_id, relation, coalesce(est_rows, 0) AS r, contains(node_type, 'Index') OR contains(node_type, 'Bitmap') AS ix,
        row_number() OVER (PARTITION BY exec_id ORDER BY node_id) / count(*) OVER (PARTITION BY exec_id) AS pos FROM nodes WHERE relation IS NOT NULL)
      SELECT exec_id, {", ".join(f"""coalesce(max(1.0) FILTER (WHERE relation = '{t}'), 0)::DOUBLE AS {t}_present, coalesce(round(min(pos) FILTER (WHERE relation = '{t}'), 6), 0) AS {t}_join_position,
        coalesce(round(min(least(r / (SELECT count(*) FROM {t}), 5)) FILTER (WHERE relation = '{t}'), 6), 1) AS {t}_selectivity,
        coalesce(max(ix::INT) FILTER (WHERE relation = '{t}'), 0)::DOUBLE AS {t}_index_scan, (count(*) FILTER (WHERE relation = '{t}'))::DOUBLE AS {t}_occurrences""" for t in SHOP)}
      FROM s GROUP BY exec_id""",
    "scan_qerrors": f"""{_NODES} SELECT exec_id, node_id, relation, round(ln(1 + coalesce(est_rows, 0)), 6) AS log_estimated_rows, node_type IN {_IN["seq_scan"]} AS is_seq_scan,
      contains(node_type, 'Index') AS is_index_scan, filter <> '' AS has_filter, CASE WHEN filter = '' THEN 0 ELSE len(string_split(filter, ' AND '))::INT END AS n_filter_conjuncts, coalesce(width, 0) AS plan_width,
      depth AS depth_in_tree, round(ln((actual_rows + 1) / (coalesce(est_rows, 0) + 1)), 6) AS log_qerror FROM nodes WHERE relation IS NOT NULL AND actual_rows IS NOT NULL""",
    "join_qerrors": f"""{_NODES}, c AS (SELECT *, row_number() OVER (PARTITION BY exec_id, parent_id ORDER BY node_id) AS nth FROM nodes WHERE parent_id >= 0),
      k AS (SELECT exec_id, parent_id AS node_id, max(coalesce(est_rows, 0)) FILTER (WHERE nth = 1) AS l, max(coalesce(est_rows, 0)) FILTER (WHERE nth = 2) AS r,
        count(*) FILTER (WHERE filter <> '' OR recheck <> '') AS n_filtered_children FROM c GROUP BY 1, 2 HAVING count(*) >= 2)
      SELECT n.exec_id, n.node_id, round(ln(1 + coalesce(est_rows, 0)), 6) AS log_estimated_rows, round(ln(1 + l), 6) AS log_left_rows, round(ln(1 + r), 6) AS log_right_rows,
      round(ln((coalesce(est_rows, 0) + 1) / (greatest(l, 1) * greatest(r, 1))), 6) AS log_implied_selectivity,
      (SELECT count(*) FROM nodes b WHERE b.exec_id = n.exec_id AND b.relation IS NOT NULL AND starts_with(b.path, n.path || '.'))::INT AS n_relations, depth AS depth_in_tree, n_filtered_children,
      node_type = 'Nested Loop' AS is_nested_loop, node_type = 'Hash Join' AS is_hash_join, node_type = 'Merge Join' AS is_merge_join,
      round(ln((actual_rows + 1) / (coalesce(est_rows, 0) + 1)), 6) AS log_qerror
      FROM nodes n JOIN k ON n.exec_id = k.exec_id AND n.node_id = k.node_id WHERE node_type IN {features.JOINS} AND actual_rows IS NOT NULL""",
    "advisor_rows": _advice_sql(5, 10_000, 0.9, 2),
    "advisor_rows_strict": _advice_sql(3, 1000, 0.3, 1),
    "orphan_rows": "SELECT count(*) AS n_orphans FROM product_suppliers p WHERE supplier_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM suppliers s WHERE s.id = p.supplier_id)",
    "numeric_percentiles": "SELECT quantile_disc(p_retailprice, 0.25) AS p25, quantile_disc(p_retailprice, 0.75) AS p75 FROM part",
    "text_samples": "SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1 LIMIT 5",
    "temporal_bounds": "SELECT min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders",
}
