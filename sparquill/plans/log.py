"""The execution log as an append-only parquet table, one append per decision."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.operators.nested import flatten_nodes
from sparquill.plans.extract import Plan
from sparquill.sources.tables import widened
from sparquill.storage import materialize

SCHEMA = "id long, query_id string, sql_text string, hint string, is_baseline boolean, selector_used string, raw_plan string, total_cost double, actual_total_time_ms double, planning_time_ms double, is_chosen boolean, created_at timestamp"


def nested_plan(plan: Plan) -> str:
    """A plan's nodes as nested JSON, in the form that the log's readers flatten."""
    made = {}
    for n in plan.nodes:
        node = {"Node Type": n.kind, "Plan Rows": n.est_rows, "Total Cost": n.est_cost, "Plan Width": n.est_bytes / n.est_rows if n.est_rows else None}
        node |= {k: v for k, v in (("Relation Name", n.relation), ("Join Type", n.join_type), ("Actual Rows", n.actual_rows), ("Filter", " AND ".join(n.filters) or None)) if v is not None}
        made[n.no] = node
        if n.parent in made:
            made[n.parent].setdefault("Plans", []).append(node)
    return json.dumps(made.get(0, {}))


class ExecutionLog:
    """Rows of executed plans below ``path``, partitioned by day."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, entries: list[dict]) -> None:
        """Log one decision: its rows get one time, minted here, and ids that grow with it."""
        now = dt.datetime.now(dt.UTC)
        first = int(now.timestamp() * 1_000_000) * 1000
        rows = [
            (first + i, e.get("query_id"), e["sql_text"], e["plan"].label, e["is_baseline"], e["selector_used"], nested_plan(e["plan"]), e["plan"].total_cost, e["plan"].actual_ms, e["plan"].planning_ms, e["is_chosen"], now)
            for i, e in enumerate(entries)
        ]
        frame = self.spark.createDataFrame(rows, SCHEMA).coalesce(1)
        frame.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(self.path)

    def read(self) -> DataFrame:
        """The log; empty before the first append."""
        try:
            return self.spark.read.schema(SCHEMA + ", day date").parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA + ", day date")


_TEXTS = ("Node Type", "Relation Name", "Join Type", "Filter", "Recheck Cond")
_NUMBERS = ("Plan Rows", "Plan Width", "Total Cost", "Startup Cost", "Actual Rows", "Rows Removed by Filter")


def logged_nodes(log: DataFrame) -> DataFrame:
    """The plan nodes of an execution log, typed and written once, so each text is indexed once."""
    raw = flatten_nodes(widened(log.select("id", "raw_plan")), "id", "raw_plan", "Node Type", (*_TEXTS, *_NUMBERS))
    value = {a: F.col(f"attr_{i}") for i, a in enumerate((*_TEXTS, *_NUMBERS))}
    number = {a: value[a].try_cast("double") for a in _NUMBERS}
    # strings come with their escapes
    text = {a: F.when(value[a].contains("\\"), F.get_json_object(F.concat(F.lit('{"a":"'), value[a], F.lit('"}')), "$.a")).otherwise(value[a]) for a in _TEXTS}
    typed = raw.select(
        F.col("id").alias("exec_id"), F.col("node_no").alias("node_id"), F.col("parent_no").alias("parent_id"), "depth", "inside", text["Node Type"].alias("node_type"), text["Relation Name"].alias("relation"),
        text["Join Type"].alias("join_type"), text["Filter"].alias("filter"), text["Recheck Cond"].alias("recheck"), number["Plan Rows"].alias("est_rows"), number["Plan Width"].alias("width"),
        (number["Plan Rows"] * number["Plan Width"]).alias("est_bytes"), number["Total Cost"].alias("est_cost"), number["Startup Cost"].alias("startup_cost"), number["Actual Rows"].alias("actual_rows"),
        number["Rows Removed by Filter"].alias("rows_removed"),
    )
    return materialize(typed, "nodes")
