"""The best N items of every group, by secondary sort.

Each input partition first keeps its own best N of each group, so a group of any size sends at
most N rows per partition. These are hash-partitioned by group, sorted within partitions, and
streamed as Arrow batches that pass on the first N rows of a group; no group is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keeper(groups: int, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pass on the first ``n`` rows of every group of a sorted stream, with ``rank_no`` last.

    Across batches only the last group's key and count are carried.
    """

    def same(a: pa.Scalar, b: pa.Scalar) -> bool:
        return (a.is_valid, a.as_py()) == (b.is_valid, b.as_py())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[pa.Scalar] = []
        count = 0
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            change = np.zeros(size, bool)
            change[0] = True
            keys = [batch.column(i) for i in range(groups)]
            for k in keys:
                codes = k.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(change)
            begin = np.repeat(starts, np.diff(np.append(starts, size)))
            place = np.arange(size) - begin + 1
            if last and all(same(k[0], v) for k, v in zip(keys, last, strict=True)):
                place[: starts[1] if len(starts) > 1 else size] += count
            last, count = [k[size - 1] for k in keys], int(place[-1])
            kept = batch.drop_columns(["rank_no"]) if "rank_no" in batch.schema.names else batch
            kept = kept.append_column("rank_no", pa.array(place.astype(np.int32)))
            yield kept.filter(pc.less_equal(kept.column("rank_no"), n))

    return keep


def top_items(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """``df``'s first ``n`` rows of every group by ``order``, with ``rank_no`` from 1.

    End ``order`` with unique columns; rows equal in all of ``order`` are ranked in any order.
    Null group keys form a group; an empty table and n < 1 give no rows. A column ``rank_no``
    of ``df`` is replaced.
    """
    df = df.drop("rank_no")
    keys = [f"__g{i}" for i in range(len(groups))]
    placed = df.select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], "*")
    schema = placed.withColumn("rank_no", F.lit(0)).schema
    step = _keeper(len(keys), n)
    by = [F.col(k) for k in keys] + list(order)
    local = placed.sortWithinPartitions(*by).mapInArrow(step, schema)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    final = local.repartition(parts, *keys).sortWithinPartitions(*by).mapInArrow(step, schema)
    return final.drop(*keys)
