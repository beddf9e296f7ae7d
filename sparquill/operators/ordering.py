"""Total orders over a distributed table, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.storage import materialize

#: Low bits of monotonically_increasing_id(): the row's number within its partition.
_ROW_BITS = 33


def ordered_table(df: DataFrame, order: Sequence[str | Column], label: str, partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, written once, with ``_part`` and ``_row``.

    ``_part`` is the range partition and ``_row`` the row's number in it, so (``_part``,
    ``_row``) is the total order. End ``order`` with unique columns: a hot prefix is then cut
    over as many partitions as it needs. The boundaries come from a sample, hence the write:
    a second evaluation could choose others. An empty table gives an empty table.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = (
        df.repartitionByRange(n, *columns)
        .sortWithinPartitions(*columns)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << _ROW_BITS) - 1))
    )
    return materialize(placed, label)


def partition_offsets(table: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row per ``_part`` of an ordered table: ``_offset``, the weight that lies before it.

    The driver holds one number per range partition, a count fixed by configuration.
    """
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    sizes = sorted((r[0], r[1]) for r in table.groupBy("_part").agg(amount.alias("n")).collect())
    real = any(isinstance(n, float) for _, n in sizes)
    rows, before = [], 0.0 if real else 0
    for part, n in sizes:
        rows.append((part, before))
        before += n
    kind = "double" if real else "long"
    return table.sparkSession.createDataFrame(rows, f"_part int, _offset {kind}")


def with_position(table: DataFrame, name: str = "_pos") -> DataFrame:
    """An ordered table with every row's 0-based place in the total order."""
    offsets = F.broadcast(partition_offsets(table))  # one row per range partition
    return table.join(offsets, "_part").withColumn(name, F.col("_offset") + F.col("_row")).drop("_offset")
