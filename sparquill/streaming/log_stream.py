"""The execution log as a stream: windowed summaries, and retraining when enough rows came."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparquill.functions.keys import is_duration, selector


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """A folder of parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(log: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Readings per time window and selector: number, mean and extremes.

    Works on batch and stream; on a stream a window is final when the watermark passes it, and
    rows later than ``late`` are dropped, as is usual there. Times without zone are taken as UTC.
    """
    ms = F.col("actual_total_time_ms")
    rows = log.where(is_duration(ms)).select(F.col("created_at").cast("timestamp").alias("at"), selector().alias("selector"), ms.alias("ms"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    w = F.window("at", window)
    return rows.groupBy(w.alias("w"), "selector").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms")).select(F.col("w.start").alias("window_start"), "selector", "n", F.round("mean_ms", 6).alias("mean_ms"), "min_ms", "max_ms")


def retrain_on_arrival(stream: DataFrame, checkpoint: str, train: Callable[[int], None], least_rows: int = 200, every: str | None = None):
    """A running query that calls ``train(new rows)`` whenever ``least_rows`` trainable rows came.

    ``every``: how often to look, as "10 minutes", until the query is stopped; without it what
    is there is read once. A training that fails is left for the next rows, not repeated.
    """
    held = {"n": 0}

    def batch(df: DataFrame, _: int) -> None:
        named = df.where(F.col("query_id").isNotNull() & ~F.col("query_id").startswith("adhoc:") & is_duration(F.col("actual_total_time_ms")))
        held["n"] += named.count()
        if held["n"] >= least_rows:
            n, held["n"] = held["n"], 0
            try:
                train(n)
            except Exception as e:
                warnings.warn(f"retraining on {n} rows failed: {e}", stacklevel=1)

    when = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**when).start()
