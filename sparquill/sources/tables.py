"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "plan_execution_log", "workload_item", "suppliers", "products",
    "product_suppliers", "eval_item", "mix_target", "doc_review",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def widened(scan: DataFrame) -> DataFrame:
    """A scan spread over all cores, if its files have splits for less than half of them.

    For work in Python on long texts, which small compressed files hold much of; select the
    columns first. Tables of many splits stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() * 2 <= cores else scan
