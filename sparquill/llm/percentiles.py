"""Exact percentiles per group, in a form that joins over days and partitions.

The summary of a day is its runs: how often each value occurred in each group. Runs of any
days are added up by union. Percentiles come from one distributed sort of the runs by group
and value, the number of readings in each partition of the sort, and the neighbouring order
statistics found at the offsets. The error is nil.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.operators.quantiles import group_percentiles, value_counts


def runs_of(df: DataFrame, groups: Sequence[str], value_col: str) -> DataFrame:
    """(groups..., value, n): the summary of all of ``df``, for percentiles that no day joins."""
    return value_counts(df, groups, F.col(value_col))


def daily_runs(df: DataFrame, groups: Sequence[str], value_col: str, time_col: str | None = None) -> DataFrame:
    """(groups..., day, value, n): the summary of each day; counted before the shuffle.

    ``day`` is the UTC date, null without a time. Null, NaN and infinite values take no part.
    Nulls in a group column form a group of their own.
    """
    micros = F.unix_micros(F.col(time_col).cast("timestamp")) if time_col else F.lit(None).cast("long")
    day = F.date_from_unix_date(F.floor(micros / F.lit(86_400_000_000)).cast("int"))
    return value_counts(df.select(*groups, F.col(value_col).alias("__value"), day.alias("day")), [*groups, "day"], F.col("__value"))


def join_runs(*days: DataFrame) -> DataFrame:
    """The summary of several summaries together."""
    out = days[0]
    for d in days[1:]:
        out = out.unionByName(d)
    return out


def percentiles(runs: DataFrame, groups: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(groups..., n, p<i>..., max_error): interpolated percentiles of each group.

    ``p<i>`` belongs to ``probs[i]``: at place h = (n - 1) * p of the sorted values, between
    the values at floor(h) and ceil(h). ``max_error`` is 0. A group of any size is sorted over as
    many tasks as its values need.
    """
    return group_percentiles(runs, groups, probs).withColumn("max_error", F.lit(0.0))
