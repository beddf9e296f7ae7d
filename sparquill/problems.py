"""Queries p3, p4 and p7 over the execution log, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.operators.anomalies import implausible_readings, reading_states, state_agreement
from sparquill.operators.balance import balanced_aggregate, balanced_join
from sparquill.operators.nested import flatten_lists, flatten_nodes
from sparquill.sources.tables import table, widened

LOG = "plan_execution_log"
TIMES = ("actual_total_time_ms", "planning_time_ms")
#: A value is hot from this part of all rows on.
HOT_PERCENT = 2
#: Scalars of a plan node that become columns.
NODE_ATTRIBUTES = ("Node Type", "Relation Name", "Alias", "Join Type", "Plan Rows", "Total Cost", "Actual Rows", "Actual Total Time")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values of query_id and selector_used that are in at least 2 % of all log rows."""
    log = table(spark, folder, LOG)
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("key_value")) for f in ("query_id", "selector_used")]))
    keys = ["field_name", "key_value"]
    counts = balanced_aggregate(log.select(each), keys, {"n": F.count(F.lit(1))}, {"n": F.sum("n")})
    return counts.where(F.col("key_value").isNotNull() & (F.col("n") * 100 >= HOT_PERCENT * log.count())).select(*keys)


def p3_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, finite readings and their sum and extremes per query_id and selector_used."""
    log = table(spark, folder, LOG)
    ms = F.col("actual_total_time_ms")
    valid = F.when((ms > 0) & (ms <= 86_400_000.0), ms)
    keys = ["query_id", "selector_used"]
    partial = {"n_rows": F.count(F.lit(1)), "n_ms": F.count(valid), "sum_ms": F.sum(valid), "min_ms": F.min(valid), "max_ms": F.max(valid)}
    final = {"n_rows": F.sum("n_rows"), "n_ms": F.sum("n_ms"), "sum_ms": F.round(F.sum("sum_ms"), 3), "min_ms": F.min("min_ms"), "max_ms": F.max("max_ms")}
    return balanced_aggregate(log.select(*keys, "actual_total_time_ms"), keys, partial, final)


def p3_join(spark: SparkSession, folder: str) -> DataFrame:
    """Log rows per join width of their workload item, hot query_ids split over tasks."""
    log = table(spark, folder, LOG).select("query_id", "id")
    items = table(spark, folder, "workload_item").select(F.col("id").alias("query_id"), "join_width")
    joined = balanced_join(log, items, ["query_id"])
    return joined.groupBy("join_width").agg(F.count(F.lit(1)).alias("n_rows"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Readings that cannot be true for their query_id."""
    return implausible_readings(table(spark, folder, LOG), "id", "query_id", "created_at", TIMES).select("id", "field_name")


def p4_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """How many readings the model and plain rules flag, and both."""
    return state_agreement(reading_states(table(spark, folder, LOG), "id", "query_id", "created_at", TIMES))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every plan node of every log row, linked to its parent."""
    return flatten_nodes(widened(table(spark, folder, LOG).select("id", "raw_plan")), "id", "raw_plan", "Node Type").select("id", "node_no", "parent_no")


def p7_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Plan nodes with their scalars as typed columns."""
    nodes = flatten_nodes(widened(table(spark, folder, LOG).select("id", "raw_plan")), "id", "raw_plan", "Node Type", NODE_ATTRIBUTES)
    kinds = ("string", "string", "string", "string", "double", "double", "double", "double")
    named = [F.col(f"attr_{i}").try_cast(k).alias(a.lower().replace(" ", "_")) for i, (a, k) in enumerate(zip(NODE_ATTRIBUTES, kinds, strict=True))]
    return nodes.select("id", "node_no", "parent_no", "depth", *named)


#: Arrays of scalars inside plan nodes.
NODE_LISTS = ("Output", "Sort Key", "Group Key")


def p7_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Items of the plan nodes' arrays, linked to their nodes."""
    return flatten_lists(widened(table(spark, folder, LOG).select("id", "raw_plan")), "id", "raw_plan", "Node Type", NODE_LISTS)


def p7_buffers(spark: SparkSession, folder: str) -> DataFrame:
    """Block counts of the plan nodes that have them, from the objects inside the nodes."""
    paths = {"shared_hit": ("Buffers", "Shared", "Hit Blocks"), "shared_read": ("Buffers", "Shared", "Read Blocks"), "temp_written": ("Buffers", "Temp", "Written Blocks")}
    nodes = flatten_nodes(widened(table(spark, folder, LOG).select("id", "raw_plan")), "id", "raw_plan", "Node Type", list(paths.values()))
    counts = [F.col(f"attr_{i}").try_cast("double").alias(n) for i, n in enumerate(paths)]
    return nodes.select("id", "node_no", *counts).where(F.coalesce(*paths).isNotNull())


QUERIES = {f.__name__: f for f in (p3_found, p3_profile, p3_join, p4_found, p4_agreement, p7_found, p7_nodes, p7_lists, p7_buffers)}

_P4 = """
WITH r AS (
  SELECT id, query_id, created_at, 'actual_total_time_ms' AS field_name, actual_total_time_ms AS v FROM plan_execution_log WHERE actual_total_time_ms IS NOT NULL
  UNION ALL
  SELECT id, query_id, created_at, 'planning_time_ms', planning_time_ms FROM plan_execution_log WHERE planning_time_ms IS NOT NULL
), o AS (
  SELECT *, NOT (isfinite(v) AND v > 0 AND v <= 86400000) AS bad,
         row_number() OVER w - row_number() OVER (PARTITION BY field_name, query_id, v ORDER BY created_at, id) AS island
  FROM r WINDOW w AS (PARTITION BY field_name, query_id ORDER BY created_at, id)
), s AS (
  SELECT *, query_id IS NOT NULL AND count(*) OVER (PARTITION BY field_name, query_id, v, island) >= 5 AS stuck,
         count(*) OVER (PARTITION BY field_name, query_id) AS n FROM o
), g AS (
  SELECT *, CASE WHEN v >= 3 * lag(v) OVER w THEN 1 ELSE 0 END AS jump, row_number() OVER w AS k, count(*) OVER (PARTITION BY field_name, query_id) AS m
  FROM s WHERE NOT bad AND NOT stuck AND query_id IS NOT NULL
  WINDOW w AS (PARTITION BY field_name, query_id ORDER BY v, id)
), p AS (
  SELECT *, sum(jump) OVER (PARTITION BY field_name, query_id ORDER BY v, id ROWS UNBOUNDED PRECEDING) AS part FROM g
), c AS (
  SELECT field_name, query_id, max(part) AS part FROM p WHERE k = m // 2 + 1 GROUP BY ALL
)
SELECT id, field_name FROM s WHERE bad OR stuck
UNION ALL
SELECT p.id, p.field_name FROM p JOIN c ON p.field_name = c.field_name AND p.query_id = c.query_id WHERE p.n >= 20 AND p.part <> c.part
"""

_NODES = """
        WITH t AS (SELECT id, CASE WHEN json_valid(raw_plan) THEN raw_plan::JSON END AS j FROM plan_execution_log),
        u AS (SELECT id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN (j ->> '$')::JSON END ELSE j END AS j FROM t),
        w AS (SELECT u.id, e.id AS nid, e.fullkey AS path, e.value AS v FROM u, json_tree(u.j) e WHERE e.type = 'OBJECT' AND json_exists(e.value, '$."Node Type"')),
        n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY nid) - 1 AS node_no FROM w),
        p AS (SELECT a.id, a.node_no::INT AS node_no, coalesce(max(b.node_no), -1)::INT AS parent_no, count(b.node_no)::INT AS depth, any_value(a.v) AS v
          FROM n a LEFT JOIN n b ON a.id = b.id AND b.nid < a.nid AND starts_with(a.path, b.path || '.') GROUP BY a.id, a.node_no)"""

ORACLES = {
    "p3_found": """
        SELECT 'query_id' AS field_name, query_id AS key_value FROM plan_execution_log WHERE query_id IS NOT NULL
        GROUP BY query_id HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM plan_execution_log)
        UNION ALL
        SELECT 'selector_used', selector_used FROM plan_execution_log WHERE selector_used IS NOT NULL
        GROUP BY selector_used HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM plan_execution_log)""",
    "p3_profile": """
        WITH l AS (SELECT query_id, selector_used,
                   CASE WHEN NOT isnan(actual_total_time_ms) AND actual_total_time_ms > 0 AND actual_total_time_ms <= 86400000 THEN actual_total_time_ms END AS ms FROM plan_execution_log)
        SELECT query_id, selector_used, count(*) AS n_rows, count(ms) AS n_ms, round(sum(ms), 3) AS sum_ms, min(ms) AS min_ms, max(ms) AS max_ms
        FROM l GROUP BY query_id, selector_used""",
    "p3_join": """
        SELECT w.join_width, count(*) AS n_rows FROM plan_execution_log l JOIN workload_item w ON l.query_id = w.id GROUP BY w.join_width""",
    "p4_found": _P4,
    "p7_found": f"{_NODES} SELECT id, node_no, parent_no FROM p",
    "p7_lists": " UNION ALL ".join(
        f"""({_NODES} SELECT id, node_no, '{n}' AS list_name, unnest(range(len(x)))::INT AS item_no, unnest(x) AS value FROM (SELECT id, node_no, json_extract_string(v, '$."{n}"[*]') AS x FROM p))""" for n in NODE_LISTS
    ),
    "p7_buffers": f"""{_NODES} SELECT * FROM (SELECT id, node_no, try_cast(v ->> '$.Buffers.Shared."Hit Blocks"' AS DOUBLE) AS shared_hit, try_cast(v ->> '$.Buffers.Shared."Read Blocks"' AS DOUBLE) AS shared_read,
        try_cast(v ->> '$.Buffers.Temp."Written Blocks"' AS DOUBLE) AS temp_written FROM p) WHERE coalesce(shared_hit, shared_read, temp_written) IS NOT NULL""",
    "p7_nodes": f"""{_NODES} SELECT id, node_no, parent_no, depth, v ->> '$."Node Type"' AS node_type, v ->> '$."Relation Name"' AS relation_name, v ->> '$."Alias"' AS alias, v ->> '$."Join Type"' AS join_type,
        try_cast(v ->> '$."Plan Rows"' AS DOUBLE) AS plan_rows, try_cast(v ->> '$."Total Cost"' AS DOUBLE) AS total_cost, try_cast(v ->> '$."Actual Rows"' AS DOUBLE) AS actual_rows,
        try_cast(v ->> '$."Actual Total Time"' AS DOUBLE) AS actual_total_time FROM p""",
}
