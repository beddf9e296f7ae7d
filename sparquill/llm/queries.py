"""Queries over the execution log and the corpus, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.duplicates import collapse, copies
from sparquill.llm.leaks import leaked_items
from sparquill.llm.mixing import mix, mix_report
from sparquill.llm.percentiles import daily_runs, join_runs, percentiles, runs_of
from sparquill.llm.rankings import top_items
from sparquill.llm.screening import ScreenRules, fitted_screen, score_documents, source_rates
from sparquill.llm.splits import log_records, query_links, spanning_forest, split_report, split_rows
from sparquill.operators.balance import balanced_join, lookup
from sparquill.sources.tables import table, widened
from sparquill.storage import materialize

LOG = "plan_execution_log"
SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
PROBS = (0.5, 0.9, 0.95, 0.99)
GROUPS = ("query_id", "hint")


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return query_links(log_records(table(spark, folder, LOG)))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every query_id that is one query with others, and the least member of its group."""
    _, labels = spanning_forest(_links(spark, folder))
    least = materialize(labels.groupBy("root").agg(F.min("node").alias("group_id")), "least_members")
    return lookup(labels, least, ["root"]).select(F.col("node").alias("query_id"), "group_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of query_ids that are one query: the groups' members, paired as the list asks."""
    groups = materialize(p1_groups(spark, folder), "groups")
    pairs = balanced_join(groups, groups.withColumnRenamed("query_id", "other"), ["group_id"])
    return pairs.where(F.col("query_id") < F.col("other")).select(F.col("query_id").alias("query_id_1"), F.col("other").alias("query_id_2"))


def p1_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the spanning forest of related query_ids; rule 0: spelling, 1: statement."""
    forest, _ = spanning_forest(_links(spark, folder))
    return forest.select(F.col("u").alias("query_id_1"), F.col("v").alias("query_id_2"), F.col("w").alias("rule"))


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The split of every log row."""
    return split_rows(table(spark, folder, LOG), SHARES).select("id", "split")


def p1_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached shares of the splits."""
    return split_report(materialize(split_rows(table(spark, folder, LOG), SHARES), "assigned"), SHARES)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every log row that is not the first of its statement, with the first."""
    return copies(table(spark, folder, LOG), "id", "sql_text")


def p2_statements(spark: SparkSession, folder: str) -> DataFrame:
    """One row per statement with its first id and its rows."""
    return collapse(table(spark, folder, LOG), "id", "sql_text").select("first_id", "copies")


def _named(df: DataFrame) -> DataFrame:
    names = {f"p{i}": f"p{round(p * 100)}" for i, p in enumerate(PROBS)}
    return df.select(*GROUPS, "n", *[F.round(k, 6).alias(f"{v}_ms") for k, v in names.items()], "max_error")


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact percentiles of actual_total_time_ms per query_id and hint."""
    return _named(percentiles(runs_of(table(spark, folder, LOG), GROUPS, "actual_total_time_ms"), GROUPS, PROBS))


def p5_daily_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The joinable summary: how often each value occurred, per query_id, hint and day."""
    return daily_runs(table(spark, folder, LOG), GROUPS, "actual_total_time_ms", "created_at")


def p5_joined_days(spark: SparkSession, folder: str) -> DataFrame:
    """The same percentiles from two separately made and stored summaries, of even and odd days."""
    runs = daily_runs(table(spark, folder, LOG), GROUPS, "actual_total_time_ms", "created_at")
    even = F.pmod(F.unix_date("day"), F.lit(2)) == 0
    stored = [materialize(runs.where(F.coalesce(even, F.lit(False))), "even"), materialize(runs.where(~F.coalesce(even, F.lit(False))), "odd")]
    return _named(percentiles(join_runs(*stored), GROUPS, PROBS))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three fastest rows of every query_id; hint, then id decide ties."""
    ms = F.col("actual_total_time_ms")
    rows = table(spark, folder, LOG).select("query_id", "hint", "actual_total_time_ms", "id")
    valid = rows.where(F.col("query_id").isNotNull() & (ms > 0) & (ms < float("inf")))
    best = top_items(valid, ["query_id"], [ms.asc(), F.col("hint").asc_nulls_first(), F.col("id").asc()], 3)
    return best.select("query_id", "rank_no", "id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of an eval_item, with the item."""
    return leaked_items(widened(table(spark, folder, "documents").select("doc_id", "text")), table(spark, folder, "eval_item"), "doc_id", "text", "item_id", "text").select("doc_id", "item_id")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mixed sequence of documents."""
    return mix(widened(table(spark, folder, "documents").select("doc_id", "source", "text")), table(spark, folder, "mix_target"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached shares of the mixed sequence."""
    mixed = materialize(p9_mix(spark, folder), "mixed")
    return mix_report(mixed, table(spark, folder, "mix_target"))


def _scores(spark: SparkSession, folder: str, rules: ScreenRules) -> DataFrame:
    docs = table(spark, folder, "documents")
    screen = fitted_screen(docs, table(spark, folder, "doc_review"), rules, folder)
    return score_documents(widened(docs.select("doc_id", "source", "text")), screen)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with abusive, hateful or sexually explicit language."""
    rules = ScreenRules()
    return _scores(spark, folder, rules).where(F.col("score") >= rules.threshold).select("doc_id")


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every document."""
    return _scores(spark, folder, ScreenRules())


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, cases and their rate per source."""
    rules = ScreenRules()
    return source_rates(_scores(spark, folder, rules), rules)


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_groups, p1_forest, p1_splits, p1_shares, p2_found, p2_statements, p5_percentiles, p5_daily_runs, p5_joined_days, p6_found, p8_found, p9_mix, p9_shares, p10_found, p10_scores, p10_rates)
}

_P5 = """
SELECT query_id, hint, count(*) AS n,
       round(quantile_cont(actual_total_time_ms, 0.5), 6) AS p50_ms, round(quantile_cont(actual_total_time_ms, 0.9), 6) AS p90_ms,
       round(quantile_cont(actual_total_time_ms, 0.95), 6) AS p95_ms, round(quantile_cont(actual_total_time_ms, 0.99), 6) AS p99_ms, 0.0::DOUBLE AS max_error
FROM plan_execution_log WHERE isfinite(actual_total_time_ms) GROUP BY query_id, hint"""

#: The statements of the log are SELECT lists FROM joins WHERE AND-ed conditions throughout.
_KEYS = r"""
WITH RECURSIVE s AS (SELECT id, query_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(sql_text, '["`]', '', 'g'), '[();]', ' ', 'g')), '[\s\p{Z}]+', ' ', 'g')) AS t FROM plan_execution_log WHERE sql_text IS NOT NULL),
e AS (SELECT id, query_id, regexp_replace(t, '\s*([=<>,]+)\s*', '\1', 'g') AS t FROM s),
k AS (SELECT id, query_id, array_to_string(list_sort(string_split(regexp_extract(t, '^select (.*?) from ', 1), ',')), ',') || regexp_extract(t, '( from .*? where )', 1)
  || array_to_string(list_sort(string_split(regexp_extract(t, ' where (.*)$', 1), ' and ')), ' and ') AS key FROM e)"""
_GROUPS = _KEYS + r""",
m AS (SELECT DISTINCT query_id AS q, 'k ' || key AS h FROM k WHERE query_id IS NOT NULL UNION
  SELECT DISTINCT query_id, 's ' || regexp_replace(regexp_replace(regexp_replace(lower(query_id), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '[^\p{L}\p{N}:]+', '_', 'g'), '_?:_?', ':', 'g') FROM plan_execution_log WHERE query_id IS NOT NULL),
g AS (SELECT DISTINCT a.q AS a, b.q AS b FROM m a JOIN m b ON a.h = b.h WHERE a.q <> b.q),
r AS (SELECT DISTINCT a, a AS b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a)"""

ORACLES = {
    "p1_found": f"{_GROUPS} SELECT a AS query_id_1, b AS query_id_2 FROM r WHERE a < b",
    "p1_groups": f"{_GROUPS} SELECT a AS query_id, min(b) AS group_id FROM r GROUP BY a",
    "p2_found": f"{_KEYS}, f AS (SELECT id, min(id) OVER (PARTITION BY key) AS first_id FROM k) SELECT first_id, id AS copy_id FROM f WHERE id <> first_id",
    "p2_statements": f"{_KEYS} SELECT min(id) AS first_id, count(*) AS copies FROM k GROUP BY key",
    "p5_percentiles": _P5,
    "p5_joined_days": _P5,
    "p5_daily_runs": """
        SELECT query_id, hint, (created_at AT TIME ZONE 'UTC')::DATE AS day, actual_total_time_ms + 0.0 AS value, count(*) AS n
        FROM plan_execution_log WHERE isfinite(actual_total_time_ms) GROUP BY ALL""",
    "p6_found": """
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY actual_total_time_ms, hint NULLS FIRST, id)::INTEGER AS rank_no, id
        FROM plan_execution_log WHERE query_id IS NOT NULL AND isfinite(actual_total_time_ms) AND actual_total_time_ms > 0
        QUALIFY rank_no <= 3""",
}
